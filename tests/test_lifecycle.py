import random

import pytest
from pyspark.sql import functions as F

from factgraph.operators import briefing, lifecycle, maintenance
from factgraph.sources import bundles


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pages_clamp_and_tell_of_more(spark):
    df = spark.createDataFrame([("a", k) for k in range(150)] + [("b", 1), (None, 2)], "g string, k long")
    got = lifecycle.page(df, ["g"], 1000, 10, "k")
    assert [(r.k, r.more) for r in got.filter("g = 'a'").orderBy("k").collect()] == [(k, True) for k in range(10, 110)]
    assert got.filter("g = 'b'").count() == 0
    assert rows(lifecycle.page(df, ["g"], 0, -3, "k").filter("g IS NULL OR g = 'b'").select("k", "place", "more")) == [(1, 1, False), (2, 1, False)]
    assert lifecycle.page(df.limit(0), ["g"], 5, 0, "k").count() == 0


def test_admission_against_a_plain_loop(spark):
    rng = random.Random(2)
    events = sorted((rng.choice([rng.randrange(400), 900 + 60 * rng.randrange(9), rng.randrange(2_000, 9_000)]), k, rng.choice([0, 1, None]),
                     rng.choice(["read", "write"])) for k in range(900))
    limits, kept, want = {"read": 9, "write": 4}, {}, {}
    for s, k, key, kind in events:
        past = kept.setdefault((key, kind), [])
        want[k] = sum(x > s - 60 for x in past) < limits[kind]
        if want[k]:
            past.append(s)
    df = spark.createDataFrame([(k, key, kind, s) for s, k, key, kind in events], "event_id long, key long, kind string, s long")
    assert {r.event_id: r.admitted for r in lifecycle.admitted(df, limits).collect()} == want
    assert not all(want.values())
    assert lifecycle.admitted(df.limit(0), limits).count() == 0


def test_parked_writes_end(spark):
    nodes = spark.createDataFrame([(1, "active"), (2, "archived"), (3, "active")], "id long, status string")
    parked = spark.createDataFrame([(10, [2, 1]), (11, [2, 3]), (12, [3]), (13, [2]), (14, [9, 1])], "seq long, candidates array<long>")
    verdicts = spark.createDataFrame([(10, "distinct", False), (11, "merge", False), (12, "merge", False), (13, "distinct", False),
                                      (14, "merge", True)], "seq long, verdict string, late boolean")
    assert rows(lifecycle.resolved(verdicts, parked, nodes)) == [
        (10, "inserted", 1), (11, "expired", None), (12, "merged", 3), (13, "inserted", None), (14, "expired", None)]


def test_triage(spark):
    inbox = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending"), (4, "promoted"), (5, "pending")], "id long, status string")
    decided = spark.createDataFrame([(1, "discard", None), (2, "promote", "merge"), (3, "promote", "pending"), (4, "discard", None), (9, "discard", None)],
                                    "id long, action string, band string")
    assert rows(lifecycle.triaged(inbox, decided)) == [(1, "discarded"), (2, "promoted"), (3, "pending"), (4, "promoted"), (5, "pending")]
    assert lifecycle.triaged(inbox.limit(0), decided).count() == 0


def test_links_and_remaps(spark):
    edges = spark.createDataFrame([(1, 2, "t"), (1, 2, "t")], "src long, dst long, type string")
    seen = spark.createDataFrame([(1, "active"), (2, "active"), (3, "archived"), (4, "active")], "id long, status string")
    asked = spark.createDataFrame([(1, 2, "t"), (1, 3, "t"), (4, 1, "t"), (4, 1, "t"), (4, 4, "t"), (1, 8, "t")], edges.schema)
    assert rows(lifecycle.linked(asked, edges, seen)) == [
        (1, 2, "t", "skipped"), (1, 3, "t", "archived"), (1, 8, "t", "missing"), (4, 1, "t", "attached"), (4, 4, "t", "self loop")]
    ids = spark.createDataFrame([(5, 1), (6, 2), (7, 1), (9, 4)], "old long, new long")
    moved = spark.createDataFrame([(5, 6, "t"), (5, 7, "t"), (9, 6, "t"), (9, 8, "t")], edges.schema)
    assert rows(lifecycle.remapped(moved, ids, edges)) == [
        (1, 1, "t", "same node"), (1, 2, "t", "present"), (4, 2, "t", "added"), (4, 8, "t", "unmapped")]


def test_sections_keep_empty_ones(spark):
    seen = spark.createDataFrame([("p", k, "active", k % 3 or None, k) for k in range(20)], "principal string, id long, status string, w int, created_at long")
    edges = spark.createDataFrame([(k, 0, "t") for k in range(18)], "src long, dst long, type string")
    people = spark.createDataFrame([("p",), ("q",)], "principal string")
    got = briefing.briefing([briefing.Section("all", order="w"), briefing.Section("bare", without_edge="t", order="w")], seen, edges, people)
    assert [r.id for r in got.filter("principal = 'p' AND section = 'all'").orderBy("place").collect()] == [19, 16, 13, 10, 7, 4, 1, 17, 14, 11]
    assert rows(got.filter("section = 'bare'")) == [("p", "bare", 18, 2), ("p", "bare", 19, 1), ("q", "bare", None, 0)]


def test_fact_lines(spark, tmp_path):
    good = ['{"type": "a", "title": "t", "body": "b"}', '{"type": "a", "title": "t", "body": "b", "attrs": {"k": 1}, "links": []}']
    bad = {"{": "invalid JSON", "[1]": "not an object", '{"type": "a", "title": "t", "body": "b", "x": 1}': "unknown key x",
           '{"type": "a", "title": "", "body": "b"}': "missing title", '{"type": 3, "title": "t", "body": "b"}': "missing type",
           '{"type": "a", "title": "t"}': "missing body", '{"type": "a", "title": "t", "body": "b", "attrs": 3}': "attrs is not an object",
           '{"type": "a", "title": "t", "body": "b", "links": {}}': "links is not a list"}
    (tmp_path / "x.jsonl").write_text("\n\n".join([*good, *bad]) + "\n  \n")
    ok, no = bundles.read_facts(spark, str(tmp_path))
    assert rows(ok) == [("a", "t", "b", '{"k":1}', "[]"), ("a", "t", "b", None, None)]
    assert {r.value: r.reason for r in no.collect()} == bad
    text = "\n\n".join([*good, *bad]).split("\n")
    assert {(r.line, r.value) for r in no.collect()} == {(n, x) for n, x in enumerate(text, 1) if x in bad}


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 900), ("b.txt", 7), ("empty.txt", 0)):
        (tmp_path / name).write_text("".join("\n" if k % 5 == 0 else f"{k} " + "x" * (k % 90) + "\n" for k in range(1, n + 1)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("1000", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            found = bundles.numbered_lines(spark, str(tmp_path)).collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert len(found) == 907
        for r in found:
            assert r.value == "" if r.line % 5 == 0 else r.value.split(" ")[0] == str(r.line)


def test_bundle_in_one_file(spark, tmp_path):
    schemas = {"scope": "scope_id string", "node": "id long, type string"}
    good = ['{"kind": "header", "version": 1}', '{"kind": "scope", "scope_id": "s"}', "", '{"kind": "node", "id": 3, "type": "a"}', '{"kind": "edge"}']
    (tmp_path / "good").write_text("\n".join(good))
    back = bundles.read_bundle_file(spark, str(tmp_path / "good"), schemas)
    assert rows(back["scope"]) == [("s",)] and rows(back["node"]) == [(3, "a")]
    for name, lines, line in (("late", good[1:] + good[:1], 1), ("old", [good[0].replace("1", "9")], 1), ("twice", good + good[:1], 6), ("odd", good[:2] + ["[]"], 3), ("none", [], 1)):
        (tmp_path / name).write_text("\n".join(lines))
        with pytest.raises(ValueError, match=f"line {line}:"):
            bundles.read_bundle_file(spark, str(tmp_path / name), schemas)


def test_bundle_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "r")], "id long, type string, scope_id string")
    edges = spark.createDataFrame([(1, 2, "t"), (1, 3, "t")], "src long, dst long, type string")
    parts = bundles.bundle(nodes, edges, spark.createDataFrame([("s",)], "scope_id string"))
    path = str(tmp_path / "out")
    bundles.write_bundle(parts, path)
    schemas = {"scope": "scope_id string", "node_type": "name string", "node": "id long, type string, scope_id string",
               "edge": "src long, dst long, type string"}
    back = bundles.read_bundle(spark, path, schemas)
    for k in schemas:
        cols = sorted(back[k].columns)
        assert rows(back[k].select(cols)) == rows(parts[k].select(cols))
    assert rows(back["edge"].select("src", "dst", "type")) == [(1, 2, "t")]
    back["scope"].select(F.lit('{"kind": "x"}').alias("value")).write.text(f"{path}/part=other")
    with pytest.raises(ValueError):
        bundles.read_bundle(spark, path, schemas)


def test_review_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", title', [3, 4])], "id long, title string, near array<long>")
    assert not bundles.write_review(df.limit(0), str(tmp_path / "none"))
    assert bundles.write_review(df, str(tmp_path / "some"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "some"))
    assert rows(back) == [("1", 'a "quoted", title', "3;4")]


def test_parts_of_a_killed_run_are_not_made_again(spark, tmp_path):
    from factgraph.runtime import in_parts

    rows_ = spark.createDataFrame([(k if k % 9 else None, k) for k in range(50)], "id long, v long")
    made = []

    def make(df):
        if len(made) == 2:
            made.append("killed")
            raise InterruptedError
        made.append(df.count())
        return df.withColumn("w", F.col("v") * 2)

    with pytest.raises(InterruptedError):
        in_parts(rows_, "id", str(tmp_path / "out"), 4, make)
    done = in_parts(rows_, "id", str(tmp_path / "out"), 4, make)
    assert sorted(map(tuple, done.select("v", "w").collect())) == [(k, 2 * k) for k in range(50)] and len(made) == 5
    assert in_parts(rows_, "id", str(tmp_path / "out"), 4, make).count() == 50 and len(made) == 5
    assert in_parts(rows_.limit(0), "id", str(tmp_path / "none"), 2, lambda df: df).count() == 0


def test_copies_are_compared_on_both_sides(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id long, c string")
    two = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e"), (6, "f")], "id long, c string")
    assert rows(maintenance.compared(one, two, "id", "c", F.lit("g"))) == [("g", 6, 2, 1, 1, 2)]


def test_semantic_sections_without_hint_or_scope_are_empty(spark):
    nodes = spark.createDataFrame([(1, "a", "red fox", "", "s", "active", 1), (2, "b", "red fox", "", "s", "active", 2), (3, "a", "red dog", "", "t", "active", 3)],
                                  "id long, type string, title string, body string, scope_id string, status string, created_at long")
    asked = spark.createDataFrame([(1, "p", "red fox", "all"), (2, "p", " ", "all"), (3, "q", "red", "t"), (4, "q", "red", "all")], "request_id long, principal string, query string, scope string")
    sets = spark.createDataFrame([(1, "s"), (1, "t"), (2, "s"), (3, "t")], "request_id long, scope_id string")
    found = briefing.hinted([briefing.Semantic("a", ("a",)), briefing.Semantic("any", top=1)], asked, nodes, sets)
    assert rows(found) == [(1, "a", 1, 1), (1, "a", 3, 2), (1, "any", 1, 1), (2, "a", None, 0), (2, "any", None, 0), (3, "a", 3, 1), (3, "any", 3, 1), (4, "a", None, 0), (4, "any", None, 0)]
    assert rows(briefing.audited(found, asked)) == [(1, "p", 2, 2), (2, "p", 2, 0), (4, "q", 2, 0)]
    assert rows(briefing.surfaced(found)) == [(1, 1), (1, 3), (3, 3)]
