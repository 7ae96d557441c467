"""Resampling, spelling variants and the quality classifier against brute force, hostile rows and held-out rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import classifier, crc, resampling, variants
from factgraph.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score long, rank string, word string, nodes int, part int, quality string"


def docs(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(k, t, "en", "src0", 1, 7, "x", "y", 1, 2, "z") for k, t in zip(ids, texts)], SCHEMA)


def lowered(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdé", k=rng.randint(2, 9))) for _ in range(150)]
    out = [rng.choice(" \n").join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(120)]
    return out + [out[3]] * 4 + ["", None, " \t", "ÀÉ×÷ÿ Été,中文 x1", "z" * 20_000, "Word " * 30_000, "a-b_c'd", "ab\x00cd\x0b" * 50, "9" * 70 + " x"]


def test_crcs_of_parts_and_concatenations():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 20_000).astype(np.uint8)
    start = rng.integers(0, 9_000, 300)
    end = start + rng.choice([0, 1, 5, 63, 64, 65, 128, 1_000, 10_000], 300)
    got, data = crc.crc32s(raw, start, end), raw.tobytes()
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
    both = crc.shifted(got[::-1].copy(), end - start) ^ got
    assert both.tolist() == [zlib.crc32(data[a:b] + data[c:d]) for a, b, c, d in zip(start[::-1], end[::-1], start, end)]


def brute_resampling(rows, target):
    def features(text):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    def buckets(values):
        return collections.Counter(zlib.crc32(f.encode()) % 10_000 for t in values for f in features(t)[1])

    s, t = buckets([x for _, x in rows]), buckets(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + 10_000) / ((s[k] + 1) * (all_t + 10_000)))) for k in range(10_000)]
    out = []
    for key, text in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found)
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0]))
    drawn = able[:5 * len(able) // 100]
    return sorted(x[:4] for x in out), [(x[0], x[3], k + 1) for k, x in enumerate(drawn)]


def test_resampling_against_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 50)
    target = [x for x in texts[:9]] + [None]
    rows = list(enumerate(texts))
    got = resampling.resampled(docs(spark, texts), docs(spark, target).select("text", "rank")).collect()
    all_, drawn = brute_resampling(rows, target)
    assert sorted(tuple(x)[:4] for x in got) == all_
    assert sorted((x.doc_id, x.score, x["rank"]) for x in got if x["rank"]) == sorted(drawn)


def test_resampling_of_repeated_and_missing_rows(spark, texts):
    ids = [None, 5, 5, 5] * 60
    many = [texts[5]] * 240
    got = resampling.resampled(docs(spark, many, ids), docs(spark, texts[:3])).collect()
    assert len(got) == 240 and sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 13))
    best = sorted(((x.score, x.doc_id) for x in got), key=lambda x: (-x[0], x[1] is not None))[:12]
    assert sorted((x.score, str(x.doc_id)) for x in got if x["rank"]) == sorted((s, str(d)) for s, d in best)
    for none in (docs(spark, []), docs(spark, [None, ""])):
        assert [x["rank"] for x in resampling.resampled(none, docs(spark, [])).collect()] == [None] * none.count()


@pytest.mark.parametrize("most", [1, 2, 7, 60, 99, 100])
def test_cutoff_counts_agree_with_sorting(spark, most):
    values = [random.Random(2).randint(-50, 50) ** 3 for _ in range(20)] * 4 + [0] * 20
    v, n = resampling.cutoff(spark.createDataFrame([(x,) for x in values], "v long"), most, "v", True)
    want = sorted(values, reverse=True)[most - 1]
    assert v == want and n == sum(x > want for x in values)


def brute_words(rows, letters=6, least=5):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= letters
    return {w: n for w, n in counts.items() if n >= least}


def brute_near(words):
    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    return {w: [x for x in words if abs(len(x) - len(w)) < 2 and close(x, w)] for w in words}


def brute_groups(words):
    near, form = brute_near(words), {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found_groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_against_brute_force(spark, texts):
    rng = random.Random(9)
    base = ["abcdefg", "häusern", "zzzzzzz", "abababab"]
    noise = []
    for w in base:
        for _ in range(40):
            i = rng.randrange(len(w))
            noise.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abzé") + w[i:], w[:i] + rng.choice("abzé") + w[i + 1:]]))
    rows = list(texts) + [" ".join(base * 40) + " " + ", ".join(x for x in noise for _ in range(rng.randint(1, 8)))] * 3
    want = brute_groups(brute_words(list(enumerate(rows))))
    assert found_groups(variants.grouped(docs(spark, rows))) == want and sum(v[0] is not None for v in want.values()) > 10
    again = brute_groups(brute_words([(None, x) for x in rows]))
    assert found_groups(variants.grouped(docs(spark, rows, [None] * len(rows)))) == again
    assert variants.grouped(docs(spark, [])).count() == 0 and variants.grouped(docs(spark, [None, "", "aaaaaa"])).count() == 0


def test_chains_of_forms_and_very_long_words(spark):
    long = "ab" * 3_000
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "bbbbbb": 1, long: 9, long[:-1]: 2, long + "é": 50, long[:2_000] + "z" + long[2_000:]: 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = variants.neighbours(df).collect()
    want = brute_near(counts)
    assert {r.word: r.n_near for r in near} == {w: len(x) for w, x in want.items()}
    names = {r.id: r.word for r in near}
    assert sorted(names.items()) == list(enumerate(sorted(counts)))
    for r in near:
        assert names.get(r.best) == min(want[r.word], key=lambda x: (-counts[x], x), default=None)
    chain = spark.createDataFrame([(k, k + 1) for k in range(21)], "id long, form long")
    assert {r.root for r in variants.roots(chain).collect()} == {21}


def test_trie_nodes_are_prefixes_whatever_the_ranges(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(400)})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = variants.trie_nodes(spark.createDataFrame([(w, w) for w in words], "word string, spelling string"), "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    node = {}
    for r in rows:
        assert words[r.id] == r.word and len(r.nodes) == len(r.word) + 1
        for k, v in enumerate(r.nodes):
            assert node.setdefault(r.word[:k], v) == v
    assert len(set(node.values())) == len(node)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op13_quality_classifier"](spark, sf).cache()
    rows = scored.collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    report = classifier.held_out_report(scored, spark.read.parquet(f"{sf}/labels.parquet")).first()
    assert report.n > 50 and report.accuracy > 0.95 and report.kept_good > 0.95 and report.caught_bad > 0.8


def test_classifier_learns_nothing_from_held_out_labels(spark):
    sf = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (classifier.classified(documents, x).collect() for x in (labels, flipped))
    assert np.allclose([r.score for r in sorted(one)], [r.score for r in sorted(two)], atol=1e-9)


def test_classifier_of_hostile_rows(spark, texts):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, None), (70, 1, 0), (70, 0, 0)], "doc_id long, quality int, toxic int")
    got = classifier.classified(docs(spark, texts + [texts[0]], [*range(len(texts)), None]), labels).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id in (3, 120, 121, 122, 123)}
    assert max(same) - min(same) < 1e-12
    assert {r.score for r in classifier.classified(docs(spark, ["a", None]), labels.filter("quality = 1")).collect()} == {0.5}
    assert classifier.classified(docs(spark, []), labels).count() == 0


def test_cached_factors_give_the_normal_density():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4, 4))
    cov = a @ a.T + np.eye(4)
    lower, x, m = np.linalg.cholesky(cov), rng.normal(size=(6, 4)), rng.normal(size=4)
    model = classifier.Discriminant([m, np.zeros(4)], [np.linalg.inv(lower), np.eye(4)], [2 * np.log(np.diag(lower)).sum(), 0.0])
    direct = [-0.5 * v @ v + 0.5 * (v - m) @ np.linalg.inv(cov) @ (v - m) + 0.5 * np.log(np.linalg.det(cov)) for v in x]
    assert np.allclose(model.difference(x), direct)


def test_pipeline_of_hostile_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, a very long text, further columns, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(2)
    words = ["".join(rng.choices(["ta", "re", "on", "mi", "sol"], k=rng.randint(1, 4))) for _ in range(900)]
    text = [" ".join(rng.choices(words, k=60)) for _ in range(6)] + [" ".join(rng.choices(words, k=60_000))]
    rows = [(k, t, None, None, None, "clash", 1) for k, t in enumerate(text)] + [(3, text[3], "en", "s", 9, "x", 2)] * 2
    rows += [(None, text[4], "en", "s", 1, "x", 3), (None, None, None, None, None, None, None), (8, None, "en", "s", 0, "x", 4), (9, "", "en", "s", 0, "x", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard int"
    empty = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table, df in zip(("benchmark", "labels"), empty):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    kept = sorted((r.doc_id, r.decoded_sha256) for r in got if r.doc_id is not None)
    assert kept == [(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(text)]
    assert [r.decoded_sha256 for r in got if r.doc_id is None] == [hashlib.sha256(text[4].encode()).hexdigest()]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
