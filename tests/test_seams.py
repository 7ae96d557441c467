"""Embedders, policies and strategies given by name."""

import pytest
from pyspark.sql import functions as F

from factgraph.operators import seams
from test_operators import facts, one_by_one


def test_an_embedder_gives_its_prefix_and_stamp_and_keeps_its_dims(spark):
    rows = spark.createDataFrame([(1, "red fox")], "id long, text string")
    lengths = seams.Embedder("len-9", 9, lambda df: df.select("id", F.length("text").alias("dim"), F.lit(1).alias("w")), {"query": "q"})
    assert [tuple(r) for r in lengths.vectors(rows, "query").collect()] == [(1, 8, 1, "len-9")]
    assert lengths.vectors(rows, "document").first().dim == 7
    with pytest.raises(Exception, match="out of range"):
        lengths.vectors(rows.withColumn("text", F.lit("x" * 20)), "query").collect()
    assert seams.HASHED.vectors(rows, "document").count() == 2


def test_distinct_writes_are_banded_against_the_store_as_it_is(spark):
    store = [(100, "x", "a b c d e f", "s"), (101, "x", "k l m n o p", "s")]
    new = [(1, "x", "a b c d e f g", "s"), (2, "x", "a b c d e f g", "s"), (3, "x", "a b c d e g", "s"), (4, "x", "k l m n o p q", "s"), (5, "x", "k l m n o", "s")]
    parked = spark.createDataFrame([(1, [100]), (2, [100]), (3, [100]), (4, [101]), (5, [101])], "seq long, candidates array<long>")
    none, late = spark.createDataFrame([], "id long, peer long"), spark.createDataFrame([(5,)], "seq long")
    got = {r.seq: (r.outcome, r.target) for r in seams.settled("always_distinct", parked, facts(spark, new), facts(spark, store), none, 0.97, None, late).collect()}
    want = one_by_one(new[:4], store, 0.97, 0.97)
    assert got[5] == ("expired", None) and want[2] == ("merged", 1)
    for seq, (outcome, candidate) in want.items():
        assert got[seq] == (("inserted", 100 if seq < 4 else 101) if outcome == "insert" else (outcome, candidate))
    merged = seams.settled("always_merge", parked, facts(spark, new), facts(spark, store), none, 0.97).collect()
    assert {(r.outcome, r.target) for r in merged} == {("merged", 100), ("merged", 101)}


def test_strategies_by_name(spark):
    nodes = facts(spark, [(1, "x", "red fox", "s"), (2, "x", "blue fox", "s"), (3, "x", "red", "t")]).withColumn("created_at", F.col("id"))
    asked = spark.createDataFrame([(7, "red fox")], "request_id long, query string")
    sets = spark.createDataFrame([(7, "s")], "request_id long, scope_id string")
    got = {(r.strategy, r.id): r.place for r in seams.compared(["search_only", "lexical_only"], asked, nodes, sets, 5).collect()}
    assert got == {("search_only", 1): 1, ("search_only", 2): 2, ("lexical_only", 1): 1, ("lexical_only", 2): 2}
