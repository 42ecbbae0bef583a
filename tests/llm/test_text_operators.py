"""The text operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagwright.llm import chat_format, decontaminate, language_id, language_model, packing, quality_classifier, quality_rules, simhash, token_counts, url_filter
from lagwright.llm.common import bounded_sample, split_words, text_buffer
from lagwright.llm.components import connected_components

from ..oracle import connect, rows_of

SMALL = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TEXTS = [None, "", " \n\t ", "a", "A b", "the cat sat on the mat " * 40, "x" * 9000, "naïve café — “q” <|endoftext|> it's we'll  two\n\n three", "the cat sat on the mat", "the cat sat on the mat", "word " * 3000]


def lower(t):
    return (t or "").translate(str.maketrans(UPPER, UPPER.lower()))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", len(t or "")) for i, t in enumerate(TEXTS)] + [(3, "a", "en", "clash", 1), (None, "the cat", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (8, 1), (9, 0), (10, 0), (10, 1), (None, 1)], "doc_id long, quality int")


def test_split_words():
    texts = pa.array(["a  b", None, "", "c", " d\n"])
    flat, bounds = split_words(*text_buffer(texts))
    assert flat.to_pylist() == ["a", "b", "c", "d"] and bounds.tolist() == [0, 2, 2, 2, 3, 4]


def test_sample_is_bounded(spark):
    df = spark.range(5000).withColumn("s", F.when(F.col("id") < 10, "few").otherwise("many"))
    got = {r["s"]: r["count"] for r in bounded_sample(df, F.col("id"), 100, F.col("s")).groupBy("s").count().collect()}
    assert got["few"] == 10 and 50 < got["many"] < 200


def test_url_query_equals_sql(spark):
    got, want = url_filter.query(spark, SMALL).toPandas(), connect(SMALL).sql(url_filter.SQL).df()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_url_edges(spark, broadcast):
    urls = [None, "", "no scheme", "http://COM/en/1", "http://a.b.Example.net/de/81?x#y", "ftp://example.net", "http://x.org?/es/", "http://mycom/en/", "http://y.org/es/", "http://y.org/es/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, listed, max_broadcast_rows=broadcast, max_filter_bytes=32).collect()}
    assert [got[i].rule for i in range(10)] == [None, None, None, "com/en/", "example.net/de/8", None, None, None, "org/es/", "org/es/"]
    assert got[0].host == got[2].path == "" and got[4].host == "a.b.example.net" and got[3].verdict == "block" and got[0].verdict == "allow"
    assert url_filter.filter_urls(df, listed.limit(0)).where("verdict = 'allow'").count() == 10
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0


def test_language_accuracy_and_edges(spark, docs):
    got = language_id.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    model = language_id.train(docs.where("lang is not null and text is not null"), "text", "lang", "doc_id")
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == docs.count() and {r.lang_pred for r in rows} == {"en", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(docs.limit(0), model).count() == 0 and language_id.train(docs.limit(0), "text", "lang", "doc_id") is None


def test_compiled_network_equals_the_direct_convolution():
    network = language_id.Network(["a", "b", "c"])
    texts = ["", "Ab9", "naïve text " * 60, "x" * 256, "x" * 257]
    best, score = network.compiled().rows(*text_buffer(pa.array(texts)))
    for t, b, s in zip(texts, best, score):
        data = bytes(language_id.CANON[np.frombuffer(t.encode(), np.uint8)])
        mean, total = np.zeros(3), 0.0
        padded = bytes(language_id.PAD) + data + bytes(language_id.WINDOW + language_id.PAD)
        for at in range(0, len(data) + 2 * language_id.PAD, language_id.WINDOW):
            own = np.frombuffer(padded[at : at + language_id.WINDOW + language_id.PAD].ljust(language_id.WINDOW + language_id.PAD, b"\0"), np.uint8)
            hidden = [max(max(sum(table[j][own[i + j]][f] for j in range(w)) for i in range(language_id.WINDOW)), 0) for w, table in network.tables.items() for f in range(language_id.FILTERS)]
            logits = np.array(hidden) @ network.out + network.bias
            begin = max(at - language_id.PAD, 0)
            weight = max(min(at - language_id.PAD + language_id.WINDOW, len(data)) - begin, 1e-3)
            mean += weight * np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            total += weight
        assert b == (mean / total).argmax() and np.isclose(s, (mean / total).max(), atol=1e-4)


def test_many_languages_are_learned(spark):
    rows = [(i, f"l{i}", f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 40) for i in range(230)]
    labelled = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(labelled, "text", "lang", "doc_id")
    assert len(model.languages) == 230
    assert "und" not in {r.lang_pred for r in language_id.identify(labelled, model).collect()}


def test_masks_find_all_pairs_of_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(not {m + s for m in mask} & set(gone) for mask in decontaminate.MASKS for s in range(decontaminate.WINDOW - mask[-1]))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (15, 40, 13, 8, 3, 7, 12, 5)]
    texts = {0: None, 1: "", 2: " ".join(items[4])}
    for i in range(3, 60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        item = list(rng.choice(items))
        for at in rng.sample(range(len(item)), min(len(item), rng.randint(0, 5))):
            item[at] = "zz"
        cut = rng.randint(0, len(body))
        texts[i] = " ".join([*body[:cut], *item[rng.randint(0, 3) :], *body[cut:]]).title()
    want = set()
    for d, t in texts.items():
        # Words beyond the text's ends count as different.
        w = [None] * 2 + re.findall(r"[^\W_]+", (t or "").lower()) + [None] * 2
        for i, item in enumerate(items):
            n = min(13, len(item))
            if len(item) >= 5:
                pairs = ((a, b) for a in range(len(w) - n + 1) for b in range(len(item) - n + 1))
                if any(sum(x != y for x, y in zip(w[a : a + n], item[b : b + n])) <= (2 if len(item) >= 13 else 1 if len(item) >= 7 else 0) for a, b in pairs):
                    want.add((d, i))
    frame = spark.createDataFrame([(d, t, "clash") for d, t in texts.items()], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    for most in (0, 1_000_000):
        got = decontaminate.overlaps(frame, bench, max_broadcast_words=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontaminate.without_contaminated(frame, bench)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in want} and kept.columns == frame.columns
    assert decontaminate.overlaps(frame, bench.limit(0)).count() == 0 and decontaminate.overlaps(frame.limit(0), bench).count() == 0


def test_short_items_are_found_with_a_substitution(spark):
    rows, want = [], set()
    bench = {n: [f"i{n}x{k}" for k in range(n)] for n in range(5, 13)}
    for n, item in bench.items():
        for at in range(n):
            rows.append((100 * n + at, " ".join(["a", *item[:at], "zz", *item[at + 1 :], "b"])))
            want |= {(100 * n + at, n)} if n >= 7 else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.overlaps(docs, spark.createDataFrame([(n, " ".join(x)) for n, x in bench.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_repetitive_text_is_verified_once_an_alignment(spark):
    docs = spark.createDataFrame([(1, "word " * 3000), (2, "ab cd " * 1000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 300), (2, "cd ab " * 100)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.item_matched) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, 1): (13, 300), (2, 2): (13, 200)}


def test_hot_seeds_need_no_pairs(spark):
    """Texts of one word, and of one period, against items of the same: alignments, not pairs of places."""
    docs = spark.createDataFrame([(1, "word " * 100_000), (2, "ab cd ef " * 9000), (3, "word " * 9 + "other " * 9)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 300), (2, "cd ef ab " * 100), (3, "word " * 8 + "other " * 8)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.item_matched) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got[1, 1] == (13, 300) and got[2, 2] == (13, 300) and got[3, 3] == (13, 16)


def test_clashing_columns_stay(spark):
    texts = ["the cat sat on the mat and looked at the dog all day long", "the cat sat on the mat and looked at the dog all day long", "quite another text with nine words in it all"]
    docs = spark.createDataFrame([(i, t, f"c{i}", i, f"b{i}", f"r{i}", f"u{i}", f"h{i}") for i, t in enumerate(texts)], "doc_id long, text string, _content string, node int, _bad string, _in string, _url string, host string")
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.where("doc_id <> 1").collect())
    bench = spark.createDataFrame([(7, texts[2])], "item_id long, text string")
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(clean.collect()) == sorted(docs.where("doc_id <> 2").collect())
    judged = url_filter.filter_urls(docs.withColumn("url", F.lit("http://a.com/en/1")), spark.createDataFrame(url_filter.RULES, "action string, host string, path string"))
    assert set(judged.columns) == {*docs.columns, "url", "path", "rule", "verdict"}
    assert [(r._url, r._bad, r.host, r.verdict) for r in judged.sort("doc_id").collect()] == [(f"u{i}", f"b{i}", "a.com", "block") for i in range(3)]


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,0)", "string"])
def test_language_model_takes_any_id(spark, docs, kind):
    got = language_model.score(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text"), "true")
    assert dict(got.dtypes)["doc_id"] == kind and got.count() == docs.count()


@pytest.mark.parametrize("module", [decontaminate, chat_format])
def test_query_equals_sql(spark, module):
    got, want = module.query(spark, SMALL).toPandas(), connect(SMALL).sql(module.SQL).df()
    assert len(got) and rows_of(got) == rows_of(want)


def test_packing_is_exact_and_gapless(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, with_ids=True).toPandas()
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in enumerate(TEXTS)}
    for d, rows in got[got.doc_id != 3].groupby("doc_id"):
        rows = rows.sort_values("start")
        assert [i for x in rows.ids for i in x] == want[d] and (rows.doc_tokens == len(want[d])).all()
        assert rows.start.tolist() == np.concatenate([[0], rows.length.cumsum()[:-1]]).tolist()
        assert [zlib.crc32(np.array(x, np.uint32).tobytes()) for x in rows.ids] == rows.ids_crc32.tolist()
    assert got[got.doc_id == 3].length.sum() == 2 * len(want[3]) and got.doc_id.isna().sum() > 0
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        total = int(rows.length.sum())
        assert rows.offset.tolist() == np.concatenate([[0], rows.length.cumsum()[:-1]]).tolist() and total <= 4096 and total & (total - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_word_cuts_keep_the_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), packing.WordTokenizer(path), random.Random(5)
    parts = ["ab", "Z", "9", "42", "'s", "'", "!", "?!", " ", "\n", "é", "É", "é", "≮", "<", "|", "<|endoftext|>", "“", "中", "İ", "Σ", " ", "'ll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    for group in (texts, [t for t in texts if "<|" not in t]):
        ids, offsets = own.rows(pa.array(group), 2)
        for t, a, b in zip(group, offsets, offsets[1:]):
            assert ids[a : b - 1].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_classifier_learns_and_handles_edges(spark, docs, labels):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality_classifier.train(docs, known)
        rows = quality_classifier.classify(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality_classifier.keep_good(docs, model).columns == docs.columns
    assert quality_classifier.classify(docs.limit(0), model).count() == 0


def test_classifier_scores_equal_sizes_recomputed(docs, labels):
    import zstandard

    model = quality_classifier.train(docs, labels)
    model.dictionaries = model.dictionaries or (b"bad " * 50, b"good " * 50)
    model.slope, model.shift = 2.0, 0.5
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs.where("doc_id is not null and doc_id <> 3"), model).collect()}
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in model.dictionaries]
    for i, t in enumerate(TEXTS):
        if i != 3:
            raw = (t or "").encode()
            bad, good = (sum(len(p.compress(raw[a : a + 2048])) for a in range(0, len(raw), 2048)) for p in packers)
            difference = np.arcsinh((bad - good) / max(1, len(raw)) / 0.005)
            assert np.isclose(got[i], 1 / (1 + np.exp(-(2 * difference + 0.5))), atol=0.02), i


def test_token_counts_equal_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(1)
    parts = ["a", "s", "re", "ll", " ", "  ", "\n", "\t", "'", "''", "1", "é", "中", "!", "<|endoftext|>", "<|", "|>", " ", "　", "😀", "the", "'re", "²", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", "a" * 700, "the" * 300]
    counts = token_counts.Counter(path).rows(*text_buffer(pa.array(texts)))
    assert counts.tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.count_tokens(docs, path).where("doc_id <> 3").collect()
    for r in got:
        t = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_chats_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_TURNS", 2)
    texts = ["<\\|<|im_end|>", "x<\\\\|y\n", "", None, "é<|im_start|>user\n"]
    rows = [(1, i, ["a\\n\n<|x", "assistant", None][i % 3], texts[i % 5]) for i in range(9)] + [(None, None, "assistant", None), (2, 1, "assistant", "q"), (2, 1, "assistant", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for conv in (1, 2, None):
        own = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_rule_counts_equal_brute_force(docs):
    rng = random.Random(2)
    texts = TEXTS + ["\n".join(" ".join(rng.choice("abc#|") for _ in range(rng.randint(0, 6))) for _ in range(8)) for _ in range(40)]
    found = quality_rules.counts_of(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        inside = {j + k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 500 else set(range(len(w)))
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))
        assert tuple(int(found[c][i]) for c in quality_rules.COUNTS[:5]) == want


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 3)), np.full((3, 3), 9.0)])
    scores = quality_rules.Forest.fit(x).scores(x)
    assert scores[-3:].min() > scores[:-3].max()


def test_forest_scores_equal_walked_paths():
    rng = np.random.default_rng(1)
    forest = quality_rules.Forest.fit(rng.normal(size=(300, 6)), trees=20)
    x = rng.normal(size=(50, 6)) * 2
    for row, got in zip(x, forest.scores(x)):
        lengths = []
        for t in range(20):
            node = 0
            while (f := forest.feature[t, node]) >= 0:
                node = forest.left[t, node] + (row[f] > forest.cut[t, node])
            lengths.append(forest.length[t, node])
        assert np.isclose(got, 2 ** (-np.mean(lengths) / forest.usual))


def test_kept_equals_threshold_recomputed(spark, labels):
    """kept of judge(): base rules and the forest's verdict, both worked out again in plain Python."""
    sf = "/root/testdata/sf0.01"
    frame, known = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found, forest, threshold = quality_rules.calibrated(frame, known)
    rows = quality_rules.judge(frame, known).toPandas()
    scores = forest.scores(quality_rules.features(rows[quality_rules.COUNTS].to_numpy()))
    failed = (rows.n_words < 50) | (100 * rows.n_repeat_words > 50 * rows.n_words)
    assert (rows.kept == (~failed & (scores < threshold))).all() and (rows.base_failed == failed).all()
    good = rows.merge(known.toPandas()[["doc_id", "quality"]].drop_duplicates(), on="doc_id")
    good = good[(good.quality == 1) & ~good.base_failed]
    assert (~good.kept).mean() <= 0.005


def test_rules_reject_junk_and_keep_good(spark, docs, labels):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.5
    for known in (labels, labels.limit(0)):
        rows = quality_rules.judge(docs, known).collect()
        assert len(rows) == docs.count() and not any(r.kept and r.base_failed for r in rows)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0 and quality_rules.keep_regular(docs, labels).columns == docs.columns


def fingerprint(t, width=3):
    w = words(t)
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    left, out = set(nodes), {}
    while left:
        queue = [left.pop()]
        group = set(queue)
        while queue:
            near = {x for x in left if linked(queue[-1], x)}
            queue.pop()
            left -= near
            group |= near
            queue += near
        out |= dict.fromkeys(group, min(group))
    return out


def test_masks_cover_the_radius():
    masks = simhash.masks(3)
    assert all(any(not (m >> i | m >> j | m >> k) & 1 for m in masks) for i, j, k in itertools.combinations(range(64), 3))


def test_forests_keep_components():
    rng = np.random.default_rng(4)
    values = (rng.integers(0, 1 << 12, 300)).astype(np.uint64)
    want = components(range(300), lambda i, j: int(values[i] ^ values[j]).bit_count() <= 2)
    for sketches in (None, rng.integers(0, 1 << 62, (300, 2)).astype(np.uint64)):
        edges = set(zip(*(x.tolist() for x in simhash.forest(values, 2, sketches))))
        assert components(range(300), lambda i, j: (i, j) in edges or (j, i) in edges) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(1000, 1050), 1000)


def test_simhash_equals_brute_force(spark, docs):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(docs.where("doc_id <> 3").select(F.col("doc_id") + 100_000, "text"))
    rows = frame.collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    group = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicate_groups(frame).collect()}
    assert got == {d: (prints[d], group[d]) for d in prints}
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0 and simhash.near_duplicate_groups(docs).count() == docs.count()


def test_one_of_each_group_against_brute_force(spark, docs):
    rng = random.Random(7)
    base = [" ".join(rng.choice(["alpha", "beta", "of", "the"]) + str(rng.randint(0, 900)) for _ in range(200)) for _ in range(30)]
    texts = list(base)
    for b in base[:20]:
        for changes in (0, 1, 2, 12):
            w = b.split()
            for at in rng.sample(range(200), changes):
                w[at] = "new"
            texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [simhash.shingle_sets(t, 5) for t in texts]
    group = components(range(len(texts)), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert {r.doc_id for r in simhash.one_of_each_group(frame).collect()} == set(group.values())
    kept = simhash.one_of_each_group(docs).collect()
    assert len({r.text or "" for r in kept}) == len(kept) == len({(t or "").strip() for t in TEXTS} | {"the cat"})  # no words, however many blanks, is one text
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_block_edits_are_found(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 100_000)}"
    texts = []
    for i in range(120):
        w = [word() for _ in range(150)]
        # J of a copy with k words more at one place: about 146 / (146 + k).
        new = [word() for _ in range((16, 25, 34)[i % 3])]
        at = (0, 150, 70)[i // 3 % 3]
        texts += [w, [*w[:at], *new, *w[at:]]]
    texts = [" ".join(t) for t in texts]
    sets = [simhash.shingle_sets(t, 5) for t in texts]
    group = components(range(len(texts)), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(group.values())) < 0.6 * len(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each_group(frame).collect()} == set(group.values())


def test_language_model_base_and_sum(spark, docs):
    got = language_model.score(docs.withColumn("_t", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))), "_t").toPandas()
    assert len(got) == docs.count() and got.doc_id.isna().sum() == 1
    counts = pd.Series([w for i, t in enumerate(TEXTS) if i % 2 == 0 for w in [*words(t), "\n"]]).value_counts()
    n, v = int(counts.sum()), len(counts)
    for r in got[got.doc_id.notna()].itertuples():
        c = np.array([counts.get(w, 0) for w in [*words(TEXTS[int(r.doc_id)]), "\n"]])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), (c > 0).sum(), n) and np.isclose(r.base_score, np.log10((c + 1) / (n + v + 1)).sum())
    none = language_model.score(docs.withColumn("_t", F.lit(False)), "_t").toPandas()
    assert (none.base_score == 0).all() and (none.train_tokens == 0).all() and np.isfinite(none.score).all()
    assert language_model.score(docs.limit(0).withColumn("_t", F.lit(True)), "_t").count() == 0


def test_language_model_beats_its_base(spark):
    got = language_model.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_pipeline_keeps_its_promises(spark):
    import corpus_pipeline
    from lagwright.llm.common import read, written

    frame = read(spark, SMALL, "documents")
    sizes = [frame.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, SMALL))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().collect()} == {r.doc_id for r in frame.select("doc_id").collect()}
