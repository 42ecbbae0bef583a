"""Signals at sample rate: kept in blocks, correlated by FFT, filtered by composing block states.

A signal is a row for each block of ``size`` samples: keys, b (the block's number) and y (array of doubles, shorter only
in the last block). Correlations are worked out a block pair or a window at a time, with energies from prefix sums; there
is no row for a pair of samples, none for a sample and a lag, and no task holds a whole signal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import streamed
from .joins import matched


def mapped(df: DataFrame, kept: list[str], work: Callable[[dict[str, list]], dict[str, pa.Array]], made: str) -> DataFrame:
    """``kept`` and what ``work`` makes of each batch's columns; made: the schema of that. Narrow."""
    kinds = dict(df.dtypes)
    names = [*kept, *(c.split()[0] for c in made.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # rows hold arrays, so few at a time
                part = batch.slice(at, 64)
                out = work({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *out.values()], names=names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + (", " if kept else "") + made)


def blocks(df: DataFrame, keys: list[str], i: str, v: str, size: int) -> DataFrame:
    """keys, b, y of samples (keys, i from 0 on, v): all blocks up to the last sample, with which the last one ends. Samples that
    are missing or null count 0, one that occurs twice counts twice; ones with a null number or one below 0 drop out."""
    inside = df.where(F.col(i) >= 0)
    grouped = inside.groupBy(*keys, F.floor(F.col(i) / size).alias("b")).agg(F.collect_list(F.struct((F.col(i) % size).cast("int").alias("j"), F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias("v"))).alias("_s"))
    last = inside.groupBy(*keys).agg(F.max(F.floor(F.col(i) / size)).alias("_last"))
    every = last.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    grouped = matched(every, grouped, [*keys, "b"], "left").select(*keys, "b", "_s", (F.col("b") == F.col("_last")).alias("_end"))

    def work(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for samples, end in zip(c["_s"], c["_end"].to_pylist(), strict=True):
            if not samples.is_valid:
                out.append(np.zeros(size))
                continue
            j, x = (np.asarray(samples.values.field(n)) for n in "jv")
            out.append(np.bincount(j, x, minlength=int(j.max()) + 1 if end else size))
        return {"y": lists(out)}

    return mapped(grouped, [*keys, "b"], work, "y array<double>")


def lists(arrays: list[np.ndarray], mask: list[np.ndarray] | None = None) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0), *arrays]).astype(float)
    values = pa.array(flat, mask=np.concatenate([np.zeros(0, bool), *mask])) if mask is not None else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), values)


def stretches(signal: DataFrame, keys: list[str], wanted: DataFrame, first: str, last: str) -> DataFrame:
    """wanted with parts: the signal's blocks number ``first`` to ``last`` that are there, in order, null without any. Each
    block is joined by its number to the distinct ranges that ask for it; a range's blocks come together, as many as it
    asks for."""
    asked = wanted.select(*keys, first, last).distinct().withColumn("b", F.explode(F.sequence(F.col(first), F.col(last))))
    parts = matched(asked, signal.select(*keys, "b", "y"), [*keys, "b"]).groupBy(*keys, first, last).agg(F.sort_array(F.collect_list(F.struct("b", "y"))).alias("parts"))
    return matched(wanted, parts, [*keys, first, last], "left")


def assembled(parts: pa.Scalar, size: int, start: int, stop: int) -> np.ndarray:
    """Samples ``start`` to ``stop`` out of blocks; 0 where there is none."""
    out = np.zeros(max(0, stop - start))
    if parts.is_valid:
        values = parts.values
        for b, y in zip(values.field("b").to_pylist(), values.field("y"), strict=True):
            x = np.asarray(y.values, float)
            a = max(start, b * size)
            z = min(stop, b * size + len(x))
            if z > a:
                out[a - start : z - start] = x[a - b * size : z - b * size]
    return out


def products(ref: np.ndarray, qry: np.ndarray, low: int, high: int) -> np.ndarray:
    """The sums of qry[i] * ref[i + lag] for lags ``low`` to ``high``; beyond its ends either is 0."""
    n = 1 << int(len(ref) + len(qry)).bit_length()
    full = np.fft.irfft(np.fft.rfft(ref, n) * np.conj(np.fft.rfft(qry, n)), n)
    lags = np.arange(low, high + 1)
    out = full[lags % n]
    out[(lags <= -len(qry)) | (lags >= len(ref))] = 0.0
    return out


def template_scores(ref: DataFrame, templates: DataFrame, keys: list[str], size: int, longest: int) -> DataFrame:
    """keys, id, lag, scores of templates (keys, id, q: array, first, last: the places in ref to try): scores[j] is the
    template's mean-removed samples times those of ref from lag + j on, over both norms, within -1 and 1.

    Overlap-save: a template meets one block of places at a time, with the reference ``longest`` samples beyond it; the
    energies of all places come from one prefix sum. Null are places next to silent (an energy below 1e-6, or below 1e-4
    of the template's). Places at which the template would not end within the reference have none; a flat template
    scores 0. Templates of more than ``longest`` samples are cut there; empty ones, and null bounds, have no row.
    """
    n = ref.groupBy(*keys).agg(F.max(F.col("b") * size + F.size("y")).alias("_n"))
    t = templates.where(F.col("first").isNotNull() & F.col("last").isNotNull()).select(*keys, "id", F.slice("q", 1, longest).alias("q"), F.greatest("first", F.lit(0)).cast("long").alias("_first"), F.col("last").cast("long").alias("_last"))
    t = matched(t, n, keys).select(*keys, "id", "q", "_first", F.least(F.col("_last"), F.col("_n") - F.size("q")).alias("_last"))
    t = t.where((F.size("q") > 0) & (F.col("_first") <= F.col("_last")))
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_first") / size), F.floor(F.col("_last") / size)))).withColumn("_to", F.col("_b") + -(-longest // size))
    rows = stretches(ref, keys, t, "_b", "_to")

    def work(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        scores, silent, lags = [], [], []
        for q, parts, b, first, last in zip(c["q"], c["parts"], *(c[x].to_pylist() for x in ("_b", "_first", "_last")), strict=True):
            x = np.nan_to_num(np.asarray(q.values.to_numpy(zero_copy_only=False), float))
            x = x - x.mean()
            low, high = max(first, b * size), min(last, (b + 1) * size - 1)
            r = assembled(parts, size, low, high + len(x))
            sums = np.concatenate([[0.0], np.cumsum(r * r)])
            energy, own = sums[len(x) :] - sums[: len(sums) - len(x)], float(x @ x)
            quiet = energy < max(1e-6, own * 1e-4)
            norm = np.sqrt(np.where(quiet, 1.0, energy) * own)
            scores.append(np.clip(products(r, x, 0, high - low) / np.where(norm > 0, norm, np.inf), -1.0, 1.0))
            silent.append(quiet)
            lags.append(low)
        return {"lag": pa.array(lags, pa.int64()), "scores": lists(scores, silent)}

    return mapped(rows, [*keys, "id"], work, "lag long, scores array<double>")


def best_places(scores: DataFrame, keys: list[str], apart: int, digits: int = 12) -> DataFrame:
    """keys, id, lag, score, ratio of template_scores(): the first best place, and its score over the best of those
    ``apart`` or more away (99 where there is none). Scores are rounded first, so that equal ones tie. Templates without a
    place that counts have no row."""
    at = lambda keep=None: F.array_max(F.transform("scores", lambda s, j: F.when(s.isNotNull() if keep is None else s.isNotNull() & keep(F.col("lag") + j), F.struct(F.round(s, digits).alias("s"), (-(F.col("lag") + j)).alias("l")))))
    best = scores.groupBy(*keys, "id").agg(F.max(at()).alias("_b")).where("_b is not null")
    both = matched(scores, best, [*keys, "id"])
    second = both.groupBy(*keys, "id", "_b").agg(F.max(at(lambda lag: F.abs(lag + F.col("_b.l")) >= apart)).alias("_s"))
    ratio = F.when(F.col("_s").isNull(), 99.0).otherwise(F.try_divide("_b.s", F.col("_s.s") + 1e-9))
    return second.select(*keys, "id", (-F.col("_b.l")).alias("lag"), F.col("_b.s").alias("score"), ratio.alias("ratio"))


def score_near(ref: DataFrame, templates: DataFrame, keys: list[str], size: int, longest: int, look: int, within: int) -> DataFrame:
    """keys, id, near: how well a template (keys, id, q, at) matches the reference at ``at``: its best score among the places
    from ``look`` before to ``look`` after; 0 where that best one lies more than ``within`` away, so that another phrase
    next to it does not count, or where no place counts."""
    t = templates.withColumns({"first": F.greatest(F.lit(0), F.col("at") - look), "last": F.greatest(F.lit(0), F.col("at") - look) + 2 * look})
    best = best_places(template_scores(ref, t, keys, size, longest), keys, 1).select(*keys, "id", "lag", "score")
    d = matched(templates.select(*keys, "id", "at"), best, [*keys, "id"], "left")
    return d.select(*keys, "id", F.when(F.abs(F.col("lag") - F.col("at")) <= within, F.col("score")).otherwise(0.0).alias("near"))


def window_peaks(ref: DataFrame, qry: DataFrame, keys: list[str], size: int, window: int, most: int, apart: int, extra: int | None = None, digits: int = 12) -> DataFrame:
    """keys, win, lag, best, second_lag, second: of each window of ``window`` samples of qry, begun every ``size``, the first
    best of its correlations with the reference at lags within ``most``, and the first best of those ``apart`` or more away
    (second 0, at the first lag, if there is none).

    Both slices are mean-removed and divided by their whole norms; the reference's is as long as the window and ``extra``
    (``most`` if not given) longer, and ends with the reference. A window that qry does not fill is one only where there
    is no other. Slices of fewer than 8 samples give four zeros, flat ones zeros at the first lag.
    """
    extra = most if extra is None else extra
    ends = lambda df, name: df.groupBy(*keys).agg(F.max(F.col("b") * size + F.size("y")).alias(name))
    n = matched(ends(qry, "_n"), ends(ref, "_m"), keys)
    wins = n.withColumn("win", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("_n") - window) / size).cast("int") - 1))))
    rows = stretches(qry, keys, wins.withColumns({"_a": F.col("win").cast("long"), "_z": F.floor((F.col("win") * size + window - 1) / size)}), "_a", "_z").withColumnRenamed("parts", "_q")
    rows = stretches(ref, keys, rows.withColumn("_z", F.floor((F.col("win") * size + window + extra - 1) / size)), "_a", "_z")

    def work(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for win, qs, rs, n, m in zip(c["win"].to_pylist(), c["_q"], c["parts"], c["_n"].to_pylist(), c["_m"].to_pylist(), strict=True):
            start, stop = win * size, min(n, win * size + window)
            x, y = assembled(qs, size, start, stop), assembled(rs, size, start, min(m, stop + extra))
            if min(len(x), len(y)) < 8:
                out.append((0, 0.0, 0, 0.0))
                continue
            x, y = x - x.mean(), y - y.mean()
            low, high = max(-most, 1 - len(x)), min(most, len(y) - 1)
            norm = float(np.linalg.norm(x) * np.linalg.norm(y)) or 1e-12
            s = np.round(products(y, x, low, high) / norm, digits)
            i = int(s.argmax())
            far = np.abs(np.arange(len(s)) - i) >= apart
            j = int(np.where(far, s, -np.inf).argmax()) if far.any() else i
            out.append((low + i, s[i], low + j, s[j] if far.any() else 0.0))
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64())
        return {n: pa.array([o[k] for o in out], kind) for k, (n, kind) in enumerate(zip(("lag", "best", "second_lag", "second"), kinds, strict=True))}

    return mapped(rows, [*keys, "win"], work, "lag long, best double, second_lag long, second double")


def samples_of(signal: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, i, v: a row for each sample of a signal's blocks."""
    return signal.select(*keys, "b", F.posexplode("y").alias("_j", "v")).select(*keys, (F.col("b") * size + F.col("_j")).alias("i"), "v")


def activity_floors(signal: DataFrame, keys: list[str], size: int, share: float = 0.25) -> DataFrame:
    """keys, floor: ``share`` of the samples' 95th percentile, 0.001 at least."""
    return samples_of(signal, keys, size).groupBy(*keys).agg(F.greatest(F.lit(1e-3), share * F.percentile("v", 0.95)).alias("floor"))


def clock_starts(signal: DataFrame, keys: list[str], size: int, every: int, window: int) -> DataFrame:
    """keys, start: where checkpoints begin on a clock: half of ``every``, then each ``every``, before half a window from the
    signal's end; a short signal has the first of them."""
    n = signal.groupBy(*keys).agg(F.max(F.col("b") * size + F.size("y")).alias("_n"))
    last = F.greatest(F.col("_n") - window / 2, F.lit(every / 2))
    steps = F.greatest(F.ceil((last - every / 2) / every), F.lit(1)) - 1
    return n.withColumn("_i", F.explode(F.sequence(F.lit(0), steps.cast("int")))).select(*keys, (F.col("_i") * every + every // 2).cast("long").alias("start"))


def checkpoints(ref: DataFrame, qry: DataFrame, starts: DataFrame, keys: list[str], size: int, window: int, near: int, wide: int | None = None, gain: float = 1.12, digits: int = 9) -> DataFrame:
    """keys, start, at, lag, railed, confirmed: the offset of two envelopes in windows from each start on (keys, start, and
    ref_floor and qry_floor, null for none); at is the window's middle.

    The windows end with the shorter envelope and need half their length; ones whose 90th percentile is below its floor have
    no row. Both are mean-removed; the first highest sum of products at a lag within ``near`` counts. With ``wide``, the
    first highest within that takes its place, if it lies beyond ``near`` and is positive and ``gain`` times the near one,
    or the near one is not positive. The lag moves to the vertex through its neighbours, by 1 at most; railed are peaks
    within 1 of the searched edge. Null starts, and ones below 0 or beyond the envelopes, have no row.
    """
    ends = lambda df, name: df.groupBy(*keys).agg(F.max(F.col("b") * size + F.size("y")).alias(name))
    n = matched(ends(ref, "_n"), ends(qry, "_m"), keys).select(*keys, F.least("_n", "_m").alias("_n"))
    rows = matched(starts.where("start >= 0"), n, keys).withColumn("_stop", F.least(F.col("_n"), F.col("start") + window)).where(F.col("_stop") - F.col("start") >= window // 2)
    rows = rows.withColumns({"_f": F.floor(F.col("start") / size), "_l": F.floor((F.col("_stop") - 1) / size)})
    rows = stretches(qry, keys, stretches(ref, keys, rows, "_f", "_l").withColumnRenamed("parts", "_r"), "_f", "_l")

    def work(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for r, q, start, stop, *floors in zip(c["_r"], c["parts"], *(c[x].to_pylist() for x in ("start", "_stop", "ref_floor", "qry_floor")), strict=True):
            x, y = assembled(r, size, start, stop), assembled(q, size, start, stop)
            if any(floor is not None and np.percentile(z, 90) < floor for z, floor in zip((x, y), floors, strict=True)):
                out.append((None, None, None, None))
                continue
            most = len(x) - 1
            sums = np.round(products(x - x.mean(), y - y.mean(), -most, most), digits)
            top = lambda reach: max(0, most - reach) + int(sums[max(0, most - reach) : most + reach + 1].argmax())
            peak, reach, confirmed = top(near), near, False
            if wide is not None and wide > near:
                far = top(wide)
                if abs(far - most) > near and sums[far] > 0 and (sums[peak] <= 0 or sums[far] >= gain * sums[peak]):
                    peak, reach, confirmed = far, wide, True
            move = 0.0
            if 0 < peak < len(sums) - 1:
                before, here, after = sums[peak - 1 : peak + 2]
                bend = before - 2 * here + after
                move = float(np.clip(0.5 * (before - after) / bend, -1.0, 1.0)) if abs(bend) > 1e-12 else 0.0
            out.append(((start + stop) / 2, peak - most + move, abs(peak - most) >= reach - 1, confirmed))
        kinds = (pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
        return {name: pa.array([o[i] for o in out], kind) for i, (name, kind) in enumerate(zip(("at", "lag", "railed", "confirmed"), kinds, strict=True))}

    return mapped(rows, [*keys, "start"], work, "at double, lag double, railed boolean, confirmed boolean").where("lag is not null")


def band_pass(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of the Butterworth band-pass of ``order``, by the bilinear transform;
    high is at most 100 below half the rate."""
    high = min(high, rate / 2 - 100)
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    lo, hi = warp(low), warp(high)
    centre, width = np.sqrt(lo * hi), hi - lo
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2 + 0j)
    analog = np.concatenate([poles + root, poles - root])
    digital = (2 * rate + analog) / (2 * rate - analog)
    gain = np.real((width * 2 * rate) ** order / np.prod(2 * rate - analog))
    upper = digital[digital.imag > 0]
    upper = upper[np.argsort(np.abs(upper))]
    if len(upper) != order:
        raise ValueError("a band too wide for conjugate pairs of poles")
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    sections[0, :3] *= gain
    return sections


def state_space(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(A, B, C, D) of the sections one after another: s' = A s + B x, y = C s + D x; two states a section."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    # Each section in direct form two, transposed; its input is c s + d x of those before it.
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        j = 2 * i
        row, gain = c.copy(), d
        a[j], b[j] = (b1 - a1 * b0) * row, (b1 - a1 * b0) * gain
        a[j + 1], b[j + 1] = (b2 - a2 * b0) * row, (b2 - a2 * b0) * gain
        a[j, j] += -a1
        a[j, j + 1] += 1.0
        a[j + 1, j] += -a2
        c, d = b0 * row, b0 * gain
        c[j] += 1.0
    return a, b, c, d


def samples(y: pa.Scalar) -> np.ndarray:
    return np.asarray(y.values.to_numpy(zero_copy_only=False), float) if y.is_valid else np.zeros(0)


def filtered(signal: DataFrame, k: str, size: int, sections: np.ndarray, fan: int = 64) -> DataFrame:
    """The signal (k, b, y) after a causal recursive filter, from rest; a key is not one task.

    What a block does to the filter's state is linear: out = A^size in + own, where ``own`` is the state after the block
    from rest. So blocks give their own states side by side; ``fan`` blocks in a row compose to one such map; a streamed
    fold over these, a number of few bytes each, gives the states in which they are entered, and each of them those of its
    blocks; then blocks are filtered side by side, by their impulse response and their entry state's. Missing blocks are
    silent; a key of null is one as others.
    """
    a, b, c, d = state_space(sections)
    n = len(b)
    taps, echo = [b], [c]
    for _ in range(size - 1):
        taps.append(a @ taps[-1])
        echo.append(echo[-1] @ a)
    tail, echoes = np.array(taps)[::-1], np.array(echo)  # what a sample adds to the end's state, a state to later samples
    response = np.concatenate([[d], np.array(taps) @ c])[:size]
    step = np.linalg.matrix_power(a, size)
    power = lambda m: np.linalg.matrix_power(step, int(m))

    def own(col: dict[str, pa.Array]) -> dict[str, pa.Array]:
        return {"own": lists([(x := samples(y)) @ tail[size - len(x) :] if y.is_valid and len(y) else np.zeros(n) for y in col["y"]])}

    owned = mapped(signal.select(k, "b", "y"), [k, "b"], own, "own array<double>").withColumn("g", F.floor(F.col("b") / fan))
    groups = owned.groupBy(k, "g").agg(F.sort_array(F.collect_list(F.struct("b", "own"))).alias("s"))  # fan states at most

    def composed(col: dict[str, pa.Array]) -> dict[str, pa.Array]:
        return {"through": lists([sum((power(g * fan + fan - 1 - x["b"]) @ np.array(x["own"]) for x in s.as_py()), np.zeros(n)) for g, s in zip(col["g"].to_pylist(), col["s"], strict=True)])}

    def fold(state, row):
        g, through = row
        last, held = state or (g, np.zeros(n))
        entered = power((g - last) * fan) @ held
        return (g + 1, power(fan) @ entered + np.array(through)), [(g, entered.tolist())]

    entered = streamed(mapped(groups, [k, "g"], composed, "through array<double>"), k, ["g", "through"], fold, "g long, entry array<double>")
    groups = matched(groups, entered, [k, "g"])

    def inside(col: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for g, s, entry in zip(col["g"].to_pylist(), col["s"], col["entry"].to_pylist(), strict=True):
            at, state, states = g * fan, np.array(entry), []
            for x in s.as_py():
                state = power(x["b"] - at) @ state
                states.append(state)
                at, state = x["b"] + 1, step @ state + np.array(x["own"])
            out.append(np.concatenate(states))
        return {"states": lists(out)}

    each = mapped(groups, [k, "s"], inside, "states array<double>").select(k, "states", F.posexplode("s").alias("_i", "_x"))
    each = each.select(k, F.col("_x.b").alias("b"), F.slice("states", F.col("_i") * n + 1, n).alias("_in"))
    rows = matched(signal.select(k, "b", "y"), each, [k, "b"])

    def work(col: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for y, state in zip(col["y"], col["_in"], strict=True):
            x = samples(y)
            width = 1 << (len(x) + size).bit_length()
            made = np.fft.irfft(np.fft.rfft(x, width) * np.fft.rfft(response, width), width)[: len(x)]
            out.append(made + echoes[: len(x)] @ samples(state))
        return {"filtered": lists(out)}

    return mapped(rows, [k, "b"], work, "filtered array<double>").withColumnRenamed("filtered", "y")


def spectral_peak(signal: DataFrame, k: str, size: int, rate: float) -> DataFrame:
    """k, hz: the first strongest frequency of the mean power spectrum of the signal's full blocks, each mean-removed and
    under a Hann window; a key without a full block has none. Blocks are transformed side by side and summed by key and
    frequency, so that a key's blocks are never together."""
    full = signal.where(F.size("y") == size).select(k, "y")
    window = np.hanning(size)

    def work(col: dict[str, pa.Array]) -> dict[str, pa.Array]:
        return {"p": lists([np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 for x in map(samples, col["y"])])}

    power = mapped(full, [k], work, "p array<double>").select(k, F.posexplode("p").alias("j", "p"))
    total = power.groupBy(k, "j").agg(F.sum("p").alias("p"))
    return total.groupBy(k).agg(F.max(F.struct(F.round("p", 3).alias("p"), (-F.col("j")).alias("j"))).alias("_m")).select(k, (-F.col("_m.j") * rate / size).alias("hz"))
