"""Runs, collocations and the BPE codec against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagwright.llm import bpe_codec, periodic_runs, phrases
from lagwright.llm.common import text_buffer

from ..oracle import connect, rows_of

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " \n\t ", "a", "A b", "the cat sat on the mat " * 40, "x" * 9000, "naïve café — “q” <|endoftext|> it's we'll  two\n\n three", "the cat sat on the mat", "the cat sat on the mat", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", "ids", "w") for i, t in enumerate(TEXTS)] + [(3, "a", None, None, None, None), (None, "the cat", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, ids string, phrase string")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def direct_runs(w, shortest):
    """All runs by trying each period."""
    found = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(2 * p, shortest) and not any(w[i : i + length - q] == w[i + q : i + length] for q in range(1, p)):
                found.add((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_all_periods_tried():
    rng = random.Random(4)
    for _ in range(300):
        rows = []
        for _ in range(rng.randrange(1, 6)):
            n, kinds = rng.choice([0, 1, 2, 7, 30, 80]), rng.choice([1, 2, 3, 6])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.4:
                a, p = rng.randrange(n), rng.randrange(1, n + 1)
                w = [w[min(n - 1, a + (i - a) % p)] if i >= a else w[i] for i in range(n)]
            rows.append(w)
        shortest = rng.choice([2, 5, 12])
        got = periodic_runs.runs_of(np.array(sum(rows, []), np.int64), np.cumsum([0, *map(len, rows)]), shortest)
        assert [tuple(map(int, r)) for r in got] == [(k, *r) for k, w in enumerate(rows) for r in direct_runs(w, shortest)]


def test_suffix_arrays_and_minima():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        signs = np.append(rng.integers(1, 3, n), 0)
        e = periodic_runs.Extents(signs)
        tails = [tuple(signs[i:]) for i in range(len(signs))]
        assert e.order.tolist() == sorted(range(len(signs)), key=tails.__getitem__)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        common = lambda a, b: next(k for k in range(n + 1) if a[k] != b[k])
        assert e(i, j).tolist() == [common(tails[a], tails[b]) for a, b in zip(i, j, strict=True)]


def test_runs_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in periodic_runs.query(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got) and sum(r.n_runs > 0 for r in got.values()) > 10
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        if n > 1500:
            continue  # tried periods are quadratic
        runs = direct_runs(w, 12)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_edges(spark, docs):
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r.doc_id: r for r in got if r.doc_id not in (3, None)}
    assert by[0].runs == [] and by[0].collapsed == "" and by[2].n_words == 0 and by[8].runs == []
    assert [tuple(x) for x in by[5].runs] == [(0, 240, 6)] and by[5].collapsed == "the cat sat on the mat"
    assert [tuple(x) for x in by[10].runs] == [(0, 3000, 1)] and by[10].collapsed == "word"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def direct_phrases(rows, least, longest, top, share=100):
    """All phrases counted, cut and ranked in plain Python."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {p: n for p, n in counts.items() if n >= least and len(p) > 2}
    longer: dict = {}
    for p, n in frequent.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                longer[(p[0], *p[i : i + k])] = max(n, longer.get((p[0], *p[i : i + k]), 0))
    for p, a in frequent.items():
        if 100 * longer.get(p, 0) >= share * a:
            continue
        n = totals[p[0]]
        score, k = min((1000 * a * n // (counts[p[: k + 1]] * counts[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
        out.append((p[0], " ".join(p[1:]), a, counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])], n, score))
    ranked = []
    for lang in totals:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("places,buckets,pair_buckets", [(20_000, 1 << 20, 1 << 23), (3, 64, 100), (1, 1, 1)])
def test_phrases_equal_brute_force(spark, places, buckets, pair_buckets):
    """Also with salts for nearly every pivot, and with one bucket for all words."""
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "the", "of", "é", "zz", "Yy", "q1", "q2"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", ". ", "\n"]) for _ in range(60)) for _ in range(40)]
    texts += ["the the the the the the, a a a a", "one passage that many share. " * 3] * 12 + [None, "", " . ", "a", "hot " * 700]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = phrases.collocations(df, least=4, top=60, places=places, buckets=buckets, pair_buckets=pair_buckets)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == direct_phrases(rows, 4, 5, 60)


def test_phrases_share_and_edges(spark, docs):
    rows = [("en", "x y z. x y. " * 5 + "x y z. " * 15)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for share in (70, 90):
        got = phrases.collocations(df, least=3, share=share).collect()
        assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == direct_phrases(rows, 3, 5, 2000, share)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert {r.phrase for r in phrases.collocations(docs, least=2000).collect()} == {" ".join(["word"] * k) for k in (2, 3, 4, 5)}


def test_phrases_fragments_follow_frequent_phrases(spark, monkeypatch):
    """A frequent word between ever other frequent neighbours: each pair is frequent, hardly a longer phrase is. A task passes
    on the phrases that may be frequent, not each surrounding of a word."""
    rng = random.Random(8)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    rows = [("en", ". ".join(f"{rng.choice(left)} hub {rng.choice(right)}" for _ in range(50))) for _ in range(200)]
    made = []
    monkeypatch.setattr(phrases, "fragments", lambda *a, cut=phrases.fragments: made.append(cut(*a)) or made[-1])
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = phrases.collocations(df, least=100).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == direct_phrases(rows, 100, 5, 2000)
    assert len(got) == 80 and 80 <= made[0].count() <= 4 * 80


def test_scores_pass_64_bits(spark):
    table = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    found, singles = table([("en", "a b", 10**15)]), table([("en", "a", 2 * 10**15), ("en", "b", 3 * 10**15)])
    got = phrases.ranked(found, singles, spark.createDataFrame([("en", 10**17)], "lang string, total long")).first()
    assert got.score == 1000 * 10**15 * 10**17 // (6 * 10**30)


def test_phrases_query_equals_sql(spark):
    data = "/root/testdata/sf0.01"
    assert rows_of(phrases.query(spark, data).toPandas()) == rows_of(connect(data).sql(phrases.SQL).df())


@pytest.fixture(scope="module")
def encoder():
    return bpe_codec.Encoder(PATH)


def test_codec_equals_the_library(encoder):
    library, rng = Tokenizer.from_file(PATH), random.Random(7)
    tokens = [t.decode("utf-8", "ignore") for t in encoder.model.tokens]
    parts = tokens + list("aeiouéñ世界 \n'’!!##--==   \U0001f600") * 200 + ["'s", "'re", "<|endoftext|>", "<|end", "oftext|>"] * 30
    texts = [t or "" for t in TEXTS] + ["ab" * 900, "=" * 777, " " * 900 + "x", "".join(rng.choice(tokens[:3000]) for _ in range(200)).replace(" ", "")]
    texts += ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 10, 100, 300]))) for _ in range(400)]
    ids, ends = encoder.rows(*text_buffer(pa.array(texts)))
    decoded, places = bpe_codec.Decoder(PATH).rows(ids, ends)
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == want
        assert decoded[places[i] : places[i + 1]].tobytes().decode() == library.decode(want, skip_special_tokens=False)


def test_tokens_beyond_the_lookahead_are_stable(encoder):
    """Whatever comes after, and emitted as soon as the lookahead is there; what is held stays bounded."""
    rng, model = random.Random(8), encoder.model
    letters = [t for t in model.tokens if t.isalpha()]
    library = Tokenizer.from_file(PATH)
    for _ in range(30):
        head = b"".join(rng.choice(letters) for _ in range(250))
        machine = bpe_codec.Transducer(model, encoder.lookahead)
        early, most = [], 0
        for k in range(0, len(head), 50):
            early += machine.feed(head[k : k + 50])
            most = max(most, len(machine.held))
        assert early and most <= 2 * encoder.lookahead
        for tail in (b"", b"ing", *(b"".join(rng.choice(letters) for _ in range(20)) for _ in range(3))):
            want = library.encode((head + tail).decode("ascii"), add_special_tokens=False).ids
            assert encoder.id[early].tolist() == want[: len(early)]
    assert encoder.id[[*early, *machine.finish()]].tolist() == library.encode(head.decode(), add_special_tokens=False).ids


def test_lookahead_of_small_merge_lists():
    """The chains counted are those of the definition: no text's tokens change further to the left than that."""

    class Model:
        def __init__(self, merges):
            self.tokens, self.parts = [bytes([b]) for b in range(256)], [(b, b) for b in range(256)]
            for a, b in merges:
                self.parts.append((self.tokens.index(a), self.tokens.index(b)))
                self.tokens.append(a + b)

    def encode(model, text):
        w = [text[i : i + 1] for i in range(len(text))]
        for a, b in model.parts[256:]:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == (model.tokens[a], model.tokens[b]):
                    w[i : i + 2] = [w[i] + w[i + 1]]
                i += 1
        return w

    rng = random.Random(9)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        for _ in range(12):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        model = Model(merges)
        far = bpe_codec.sufficient_lookahead(model)
        for _ in range(200):
            head, tail = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25))) for _ in range(2))
            short, long = encode(model, head), encode(model, head + tail)
            end = 0
            for x, y in zip(short, long):  # noqa: B905
                end += len(x)
                assert end > len(head) - far or x == y


def test_decoder_in_portions_equals_the_library():
    library, rng, decoder = Tokenizer.from_file(PATH), random.Random(10), bpe_codec.Decoder(PATH)
    for _ in range(500):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(90, 256) for _ in range(rng.randrange(30))]
        got, k = b"", 0
        while k < len(ids):
            n = rng.randrange(1, 4)
            got += decoder.feed(np.array(ids[k : k + n], np.uint32))
            assert len(decoder.held) < 4
            k += n
        assert (got + decoder.finish()).decode() == library.decode(ids, skip_special_tokens=False)
    assert decoder.feed(np.array([60000, 4294967295], np.uint32)) == b""


def test_codec_query_and_edges(spark, docs):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe_codec.query(spark, SMALL).collect()}
    for d, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert got[d].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    coded = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH, text="n_tokens")
    assert sorted(r.n_tokens for r in coded.collect()) == sorted([*(t or "" for t in TEXTS), "a", "the cat"])
    nothing = bpe_codec.decode(docs.select("doc_id", F.lit(None).cast("binary").alias("ids")), PATH)
    assert {r.decoded for r in nothing.collect()} == {""}
    assert bpe_codec.decode(bpe_codec.encode(docs.limit(0), PATH), PATH).count() == 0
