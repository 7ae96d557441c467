import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from factgraph.functions import text as X
from factgraph.operators import evaluation, graph, maintenance, retrieval, visibility, writes
from factgraph.operators.components import connected_components
from factgraph.plans import reports
from factgraph.sources import derived


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 240)] + [(None, 3), (7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: find(x) for x in list(top)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("vector, lexical, want", [
    (["a", "b"], ["b", "c"], ["b", "a", "c"]), ([], ["x"], ["x"]), (["x"], [], ["x"]), (["a", "b"], ["b", "a"], ["a", "b"])])
def test_fusion(spark, vector, lexical, want):
    def leg(ids):
        return spark.createDataFrame([(1, x, k + 1) for k, x in enumerate(ids)], "request_id long, id string, rank int")

    nodes = spark.createDataFrame([(x, 0) for x in "abcx"], "id string, created_at long")
    got = retrieval.fused(leg(vector), leg(lexical), nodes).orderBy("place").collect()
    assert [r.id for r in got] == want


def test_collapse_follows_kept_rows_only(spark):
    results = spark.createDataFrame([(1, k, 1.0 / k, k) for k in (1, 2, 3)], "request_id long, id long, score double, place int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert [r.id for r in retrieval.collapsed(results, pairs).orderBy("place").collect()] == [1, 3]


def test_rank_fusion_keeps_the_base(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "z", 2)], "request_id long, list int, id string, rank int")
    assert [r.id for r in retrieval.rank_fusion(lists).orderBy("place").collect()] == ["b", "a"]


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("one two", "two one", 1.0), ("a b c d", "a b c d e", 0.8), ("a", "b", 0.0)])
def test_jaccard(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(X.jaccard(X.tokens(F.col("a")), X.tokens(F.col("b")))).first()
    assert row[0] == pytest.approx(want)


def test_bands_include_their_lower_bounds(spark):
    df = spark.createDataFrame([(0.9,), (0.8999,), (0.97,), (None,)], "s double")
    assert [r[0] for r in df.select(X.band(F.col("s"), 0.9, 0.97)).collect()] == ["pending", "insert", "merge", "insert"]


def test_walk_directions_cycles_and_limit(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t")], "src string, dst string, type string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert [r.node for r in graph.walk(starts, graph.steps(edges, "out"), 4).orderBy("rn").collect()] == ["b", "c"]
    assert graph.walk(starts, graph.steps(edges, "both"), 4, limit=3).count() == 3


def test_canonical_leaves_endless_chains_without_root(spark):
    links = spark.createDataFrame([(k, k - 1 if k else None) for k in range(30)] + [(100, 101), (101, 100)], "id long, parent long")
    got = {r.id: r.root for r in graph.canonical(links).collect()}
    assert got[16] == 0 and got[100] is None


def test_visibility(spark):
    scopes = spark.createDataFrame([("s", "p0", "private", False, False), ("t", "p0", "team-read", False, False), ("old", "p0", "team-write", False, True)],
                                   "scope_id string, owner string, visibility string, ambient boolean, archived boolean")
    grants = spark.createDataFrame([("s", "p1", "read")], "scope_id string, principal string, level string")
    people = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "principal string")
    assert {(r.principal, r.scope_id) for r in visibility.readable(scopes, grants, people).collect()} == {
        ("p0", "s"), ("p1", "s"), ("p0", "t"), ("p1", "t"), ("p2", "t")}
    assert rows(visibility.writable(scopes, grants, people)) == [("p0", "s"), ("p0", "t")]


def test_similarity_join_is_exact(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(40)]
    texts += [t + " extra" for t in texts[:10]]
    nodes = spark.createDataFrame([(k, "x", t, t) for k, t in enumerate(texts)], "id long, type string, title string, body string")
    got = {(r.a, r.b): r.similarity for r in retrieval.near_pairs(nodes, 0.7).collect()}
    every = {(r.a, r.b): r.similarity for r in retrieval.near_pairs(nodes, 0.01).collect()}
    assert got == {k: v for k, v in every.items() if v >= 0.7} and len(got) >= 10
    kinds = nodes.withColumn("type", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y"))
    for share, size in ((9.0, 8), (-1.0, 1000), (-1.0, 8), (0.5, 8)):  # all by prefixes, all in one tile, in many, and mixed
        assert {(r.a, r.b): r.similarity for r in retrieval.near_pairs(nodes, 0.7, share=share, size=size).collect()} == got
        own = {(r.a, r.b): r.similarity for r in retrieval.near_pairs(kinds, 0.7, share=share, size=size).collect()}
        assert own == {(a, b): s for (a, b), s in got.items() if a % 3 == b % 3 != 2}


def plain_window(spark, nodes):
    pairs = retrieval.near_pairs(nodes, 0.9)
    return rows(evaluation.threshold_window(pairs.select(F.concat_ws("-", "a", "b").alias("pair"), "similarity", (F.col("a") % 3 == F.col("b") % 3).alias("same"))))


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_class_window_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(60)}" for _ in range(14)] for _ in range(5)]
    texts = [" ".join([*b, f"x{k}"][k % 2:]) for b in base for k in range(5)] + ["alone"]
    ids = rng.sample(range(-20, 130), 60)
    step = 3 if seed == 2 else 1  # with 3 all pairs are of one label
    drawn = rng.sample(texts, 26) if seed == 3 else rng.choices(texts, k=60)  # without copies, and with
    nodes = spark.createDataFrame([(i * step, "xy"[t < "w3"], t, t) for i, t in zip(ids, drawn)], "id long, type string, title string, body string")
    members = retrieval.text_classes(nodes)
    pairs = retrieval.near_pairs(nodes.join(members.filter("id = rep").select("id"), "id", "left_semi"), 0.9)
    got = rows(evaluation.class_window(members.withColumn("label", F.col("id") % 3), pairs))
    assert got == plain_window(spark, nodes) and got[0].count(None) in ((3, 4) if step == 3 else (0, 1))
    if step == 3:
        none = evaluation.class_window(members.filter("false").withColumn("label", F.col("id")), pairs.filter("false"))
        assert rows(none) == [(None,) * 6]


def test_threshold_window_counts_copies(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    docs = [(3, text, "en"), (9, text, "en"), (10, text, "en"), (4, f"{text} eleven", "en"), (7, f"{text} eleven", "en"),
            (20, "...", "en"), (90, "...", "en"), (91, "...", "en"), (92, text, None), (93, text, None), (94, None, "fr"), (95, None, "fr")]
    spark.createDataFrame([(k, t, lang, "src1", len(t or "")) for k, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (got,) = rows(reports.threshold_window(spark, str(tmp_path)))
    assert got[:4] == (1.0, "94-95", pytest.approx(cosine(f"{text}\n{text}", f"{text} eleven\n{text} eleven")), "4-10")
    assert [got] == plain_window(spark, derived.nodes(spark, str(tmp_path)))


def cosine(a, b):
    def dims(text):
        out = collections.Counter()
        for t in re.findall(r"[^\W_]+", text.lower()):
            out[int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 4096] += 1
        return out
    x, y = dims(a), dims(b)
    return sum(n * y[d] for d, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()) or 1)


def one_by_one(writes_, store, low, high, sees=None, ties=()):
    """The outcomes of writes (id, type, text, scope) in order, by a plain loop."""
    rows, links, out = {x[0]: x[1:] for x in store}, collections.defaultdict(set), {}
    bodies = {x[0]: x[2] for x in store + writes_}
    for a, b in ties:
        links[a].add(b)
    for i, kind, text, scope in writes_:
        own = text + "\n" + text
        seen = sees[i] if sees else {scope}
        near = sorted((-cosine(own, x + "\n" + x), k) for k, (t, x, s) in rows.items() if t == kind and s in seen)
        near = [(-s, k) for s, k in near if -s >= low]
        if not near or near[0][0] < high:
            out[i] = ("pending", near[0][1]) if near else ("insert", None)
        else:
            c = near[0][1]
            corpus = set().union(*(re.findall(r"[^\W_]+", bodies[k].lower()) for k in {c} | links[c]))
            mine = set(re.findall(r"[^\W_]+", text.lower()))
            novel = len(mine & corpus) / len(mine | corpus) < 0.8 if mine | corpus else False
            out[i] = ("merge_linked" if novel else "merged", c)
            if novel:
                links[i].add(c)
                links[c].add(i)
        if out[i][0] in ("insert", "merge_linked"):
            rows[i] = (kind, text, scope)
    return out


def stream_of_facts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    base = [rng.choices(words, k=rng.randint(3, 14)) for _ in range(6)]
    texts = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
            t.insert(rng.randrange(len(t) + 1), rng.choice(words) if rng.random() < 0.5 else f"n{k}")
        texts.append(" ".join(t))
    return [(k, rng.choice(["x", "x", "y"]), t, rng.choice(["s", "t", "u"])) for k, t in enumerate(texts)]


def facts(spark, some):
    schema = "id long, type string, title string, body string, scope_id string, status string"
    return spark.createDataFrame([(k, t, x, x, s, "active") for k, t, x, s in some], schema)


@pytest.mark.parametrize("seed, fold, scoped", [(1, 0, False), (2, 2_000, False), (3, 9, True), (4, 2_000, True)])
def test_sequential_writes_equal_a_plain_loop(spark, seed, fold, scoped):
    rng = random.Random(seed)
    rows = stream_of_facts(seed)
    if not scoped:
        rows = [(*x[:3], "") for x in rows]
    store, new = [(k + 1000, *x) for k, *x in rows[:8]], rows[8:]
    sees = {x[0]: {x[3]} | set(rng.sample(["s", "t", "u"], rng.randint(0, 1))) for x in new} if scoped else None
    ties = [(1000, 1001), (1001, 1000), (12, 1003)]
    sets = spark.createDataFrame([(i, s) for i, own in (sees or {}).items() for s in own], "seq long, scope_id string") if scoped else None
    got = writes.sequential(facts(spark, new), facts(spark, store), spark.createDataFrame(ties, "id long, peer long"), 0.7, 0.9, sets, fold)
    want = one_by_one(new, store, 0.7, 0.9, sees, ties)
    assert {r.seq: (r.outcome, r.candidate) for r in got.collect()} == want
    assert {x for x, _ in want.values()} == {"insert", "pending", "merged", "merge_linked"}


def test_sequential_writes_without_rows(spark):
    none = facts(spark, [])
    assert writes.sequential(none, none, spark.createDataFrame([], "id long, peer long"), 0.7, 0.9).count() == 0


def test_outcomes(spark):
    store = spark.createDataFrame([(1, "alpha beta", "active"), (9, "gamma delta", "archived")], "id long, body string, status string")
    new = spark.createDataFrame([(2, "alpha beta"), (3, "alpha beta gamma delta"), (4, "")], "id long, body string")
    near = spark.createDataFrame([(2, 1, 1.0, 1), (3, 1, 0.98, 1)], "seq long, candidate long, similarity double, rank int")
    bands = writes.banded(new, near, 0.9, 0.97)
    none = spark.createDataFrame([], "id long, peer long")
    assert {r.seq: r.outcome for r in writes.with_novelty(bands, new, store, none).collect()} == {2: "merged", 3: "merge_linked", 4: "insert"}
    peers = spark.createDataFrame([(1, 9)], "id long, peer long")  # an archived peer counts
    outcomes = writes.with_novelty(bands, new, store, peers)
    assert {r.seq: r.outcome for r in outcomes.collect()} == {2: "merge_linked", 3: "merged", 4: "insert"}
    left = writes.effects(outcomes, new.withColumn("type", F.lit("error")).withColumn("happened_at", F.lit("2024")), spark.sql("SELECT 'error' AS type"))
    assert rows(left["edges"]) == [(2, 1, "same_topic")] and rows(left["addenda"]) == [(1, 3)] and left["rows"].count() == 2 and left["log"].count() == 3


def test_conformance_order_of_errors(spark):
    attrs = spark.createDataFrame([(1, {"k": "99x", "z": "1"}), (2, {"kind": "a", "k": "5"})], "id long, attrs map<string,string>")
    got = {r.id: r.errors for r in maintenance.conformance(attrs, ["kind"], {"kind": "a|b", "k": "[0-9]+"}).collect()}
    assert got == {1: ["missing kind", "unknown z", "bad k"], 2: []}


def test_nearest_rank_of_one_row(spark):
    df = spark.createDataFrame([("a", 3.0)], "g string, v double")
    assert rows(evaluation.nearest_rank(df, ["g"], "v", (50, 95))) == [("a", 3.0, 3.0)]


def test_stream_equals_batch(spark, tmp_path):
    from factgraph.streaming import jobs

    rows_ = spark.sql("SELECT id AS event_id, concat('u', id % 3) AS principal, element_at(array('view','click'), cast(id % 2 as int) + 1) AS event_type,"
                      " timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id, 0, 0) AS ts FROM range(100)")
    rows_.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows_.schema).parquet(str(tmp_path / "in"))
    q = jobs.usage_stream(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("usage")) == rows(evaluation.usage_rollup(rows_))


def test_document_edges_of_uneven_sources(spark, tmp_path, monkeypatch):
    from factgraph.sources import derived

    monkeypatch.setattr(derived, "EDGE_BLOCK", 4)
    rows = [(k, "hot" if k % 3 else "rare") for k in range(60) if k not in (7, 8, 20, 21, 22, 23, 24, 25, 26, 27)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for source in ("hot", "rare"):
        ids = [k for k, s in rows if s == source]
        want |= set(zip(ids, ids[1:]))
    assert {(r.src, r.dst) for r in derived.document_edges(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("block, floor", [(512, None), (3, None), (3, 0.4)])
def test_vector_leg_equals_all_cosines_in_scope(spark, block, floor):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(25)]
    nodes = [(k, "x", " ".join(rng.choices(words, k=rng.randint(0, 9))), "", rng.choice("stu"), rng.choice(["active"] * 4 + ["archived"])) for k in range(90)]
    asked = [(k, " ".join(rng.choices(words, k=4))) for k in range(7)] + [(7, ""), (8, "w1")]
    sees = {k: set(rng.sample("stu", rng.randint(0, 2))) for k, _ in asked}
    df = spark.createDataFrame(nodes, "id long, type string, title string, body string, scope_id string, status string")
    sets = spark.createDataFrame([(k, s) for k, own in sees.items() for s in own], "request_id long, scope_id string")
    got = retrieval.vector_leg(spark.createDataFrame(asked, "request_id long, query string"), df, sets, floor, 5, block).collect()
    want = []
    for k, query in asked:
        near = sorted((-cosine(query, f"{t}\n{b}"), i) for i, _, t, b, s, status in nodes if status == "active" and s in sees[k])
        want += [(k, i, n) for n, (s, i) in enumerate([x for x in near if -x[0] > 0 and (floor is None or -x[0] >= floor)][:5], 1)]
    assert sorted((r.request_id, r.id, r["rank"]) for r in got) == sorted(want) and len(want) > 15


def test_min_hops_shuffle_only_edges_of_kinds_that_are_reached(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(f"{a}:{rng.randrange(6)}", f"{b}:{rng.randrange(6)}", "t") for a, b in ("op", "ps", "oc", "cn") for _ in range(12)] * 2
    hops = {"s:0": 0, "s:1": 0}
    for depth in (1, 2, 3):
        for a, b, _ in edges:
            for x, y in ((a, b), (b, a)):
                if hops.get(x) == depth - 1:
                    hops.setdefault(y, depth)
    frame, seeds = spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame([("s:0",), ("s:1",), ("s:1",)], "node string")
    cuts, cut = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: cuts.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, name))
    for kind in (None, lambda node: F.substring_index(node, ":", 1)):
        got = graph.min_hops(seeds, frame, 3, kind)
        assert {r.node: r.hops for r in got.collect()} == hops
    assert len(cuts) == 6 and "substring_index" in cuts[3] and "substring_index" not in cuts[0]
