"""Ingest by micro-batches against a plain loop; replays, repeats and a control arm."""

import pytest
from pyspark.sql import functions as F

from factgraph.streaming import state
from factgraph.streaming.ingest import Store
from test_operators import facts, one_by_one, stream_of_facts


def log_of(store):
    return {r.seq: (r.outcome, r.candidate) for r in store.log().collect()}


def test_ingest_equals_a_plain_loop_and_replays_change_nothing(spark, tmp_path):
    rows = stream_of_facts(11, 48)
    base, new = [(k + 1000, *x) for k, *x in rows[:8]], rows[8:]
    peers = spark.createDataFrame([], "id long, peer long")
    sent = facts(spark, new).withColumn("at", F.timestamp_millis(F.col("id") * 1000))
    store = Store(spark, f"{tmp_path}/store", facts(spark, base))
    stream = state.landed(sent, "at", 3)
    store.ingest(stream, peers, 0.7, 0.9).awaitTermination()
    want = one_by_one(new, base, 0.7, 0.9)
    assert log_of(store) == want and len({x for x, _ in want.values()}) == 4
    kept = {i for i, (x, _) in want.items() if x in ("insert", "merge_linked")} | {x[0] for x in base}
    assert {r.id for r in store.nodes().collect()} == kept
    # A batch that is sent again, as it was or with the same facts under a new number, changes nothing.
    store.write(sent.filter("id < 20"), 1, peers, 0.7, 0.9)
    store.write(sent, 7, peers, 0.7, 0.9)
    assert log_of(store) == want and {r.id for r in store.nodes().collect()} == kept


def test_a_batch_that_failed_before_its_marker_is_written_anew(spark, tmp_path, monkeypatch):
    rows = stream_of_facts(12, 20)
    peers = spark.createDataFrame([], "id long, peer long")
    store = Store(spark, f"{tmp_path}/store", facts(spark, []))
    whole = facts(spark, rows)
    range_ = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.write(whole, 0, peers, 0.7, 0.9)
    monkeypatch.setattr(type(spark), "range", range_)
    assert store.log().count() == 0
    store.write(whole.union(whole), 0, peers, 0.7, 0.9)
    assert log_of(store) == one_by_one(rows, [], 0.7, 0.9)


def test_restated_facts_add_no_rows_and_a_control_arm_keeps_all(spark, tmp_path):
    texts = [("x", "alpha beta gamma"), ("x", "delta epsilon"), ("y", "alpha beta gamma"), ("x", "alpha beta gamma")]
    rows = [(k, t, x, "s") for k, (t, x) in enumerate(texts)]
    peers = spark.createDataFrame([], "id long, peer long")
    store = Store(spark, f"{tmp_path}/store", facts(spark, []))
    store.write(facts(spark, rows), 0, peers, 0.9, 0.97)
    before = store.nodes().count()
    store.write(facts(spark, [(k + 100, *x) for k, *x in rows]), 1, peers, 0.9, 0.97)
    assert before == 3 == store.nodes().count()
    assert {r.outcome for r in store.log().filter("seq >= 100").collect()} == {"merged"}
    control = Store(spark, f"{tmp_path}/control", facts(spark, []))
    control.write(facts(spark, rows), 0, peers, 1.1, 1.1)
    assert control.nodes().count() == 4 and log_of(control) == {k: ("insert", None) for k in range(4)}
    control.write(facts(spark, []), 1, peers, 1.1, 1.1)
    assert control.nodes().count() == 4
