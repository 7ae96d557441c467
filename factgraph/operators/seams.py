"""Seams for a user's own parts: embedders with their stamp and prefixes, policies that resolve parked writes, retrieval strategies."""

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import attrs as A
from factgraph.functions import text as X
from factgraph.operators.lifecycle import resolved
from factgraph.operators.retrieval import fused, lexical_leg, limited, vector_leg
from factgraph.operators.writes import sequential


@dataclass(frozen=True)
class Embedder:
    """What turns texts into sparse vectors: embed takes (id, text) and gives (id, dim, w) with dim in 0 to dims - 1.

    stamp names the model and its dims, so that vectors of another one are told apart; prefixes has the text that the
    model wants before a 'document' or a 'query'.
    """

    stamp: str
    dims: int
    embed: Callable[[DataFrame], DataFrame]
    prefixes: Mapping[str, str] = field(default_factory=dict)

    def vectors(self, rows: DataFrame, task: str) -> DataFrame:
        """(id, dim, w, stamp) of rows (id, text); a dimension out of range fails the job."""
        out = self.embed(rows.select("id", A.prefixed(F.col("text"), task, dict(self.prefixes)).alias("text")))
        inside = (F.col("dim") >= 0) & (F.col("dim") < self.dims)
        return out.select("id", F.when(inside, F.col("dim")).otherwise(F.raise_error(F.lit("dimension out of range"))).cast("long").alias("dim"), "w", F.lit(self.stamp).alias("stamp"))


HASHED = Embedder(f"z2-{X.DIMS}", X.DIMS, lambda rows: X.hashed_vectors(rows, "id", F.col("text")))


def always_distinct(parked: DataFrame) -> DataFrame:
    """(seq, verdict): no parked write is a restatement; none is lost, and the store grows instead."""
    return parked.select("seq", F.lit("distinct").alias("verdict"))


def always_merge(parked: DataFrame) -> DataFrame:
    """(seq, verdict): every parked write restates its nearest candidate."""
    return parked.select("seq", F.lit("merge").alias("verdict"))


#: A policy takes parked writes (seq, candidates) and gives each a verdict.
POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {"always_distinct": always_distinct, "always_merge": always_merge}


def settled(policy: str, parked: DataFrame, writes: DataFrame, store: DataFrame, peers: DataFrame, high: float, sets: DataFrame | None = None,
            late: DataFrame | None = None) -> DataFrame:
    """(seq, outcome, target): how parked writes end by a policy, against the store as it is now.

    Merges end as resolved() says. Distinct ones are written one after another: one whose twin (high or more) has come
    to the store meanwhile, an earlier distinct one included, is merged or linked to it, the others are inserted.
    late (seq) expire; a write of which the policy says nothing stays parked and has no row.
    """
    verdicts = POLICIES[policy](parked).select("seq", "verdict")
    gone = late.select("seq", F.lit(True).alias("late")) if late is not None else parked.select("seq", F.lit(False).alias("late"))
    verdicts = verdicts.join(gone, "seq", "left").select("seq", "verdict", F.coalesce("late", F.lit(False)).alias("late"))
    ended = resolved(verdicts, parked, store)
    again = ended.filter("outcome = 'inserted'").select(F.col("seq").alias("id"))
    banded = sequential(writes.join(again, "id", "left_semi"), store, peers, high, high, sets)
    kind = F.when(F.col("b.outcome") == "insert", "inserted").otherwise(F.col("b.outcome"))
    return ended.alias("e").join(banded.alias("b"), "seq", "left").select(
        "seq", F.coalesce(kind, F.col("e.outcome")).alias("outcome"),
        F.when(F.col("b.outcome").isin("merged", "merge_linked"), F.col("b.candidate")).otherwise(F.col("e.target")).alias("target"))


def search_only(requests: DataFrame, nodes: DataFrame, sets: DataFrame, limit: int = 10) -> DataFrame:
    """(request_id, id, place) of hybrid search."""
    found = fused(vector_leg(requests, nodes, sets), lexical_leg(requests, nodes, sets), nodes)
    return limited(found, limit).select("request_id", "id", "place")


def lexical_only(requests: DataFrame, nodes: DataFrame, sets: DataFrame, limit: int = 10) -> DataFrame:
    """(request_id, id, place) of the lexical leg alone."""
    return lexical_leg(requests, nodes, sets).filter(F.col("rank") <= limit).select("request_id", "id", F.col("rank").alias("place"))


#: A strategy takes requests, nodes and scope sets and gives places; graph.beyond_hits() and graph.combined() build on them.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"search_only": search_only, "lexical_only": lexical_only}


def compared(names: list[str], requests: DataFrame, nodes: DataFrame, sets: DataFrame, limit: int = 10) -> DataFrame:
    """(strategy, request_id, id, place) of several strategies over the same requests."""
    out = None
    for name in names:
        own = STRATEGIES[name](requests, nodes, sets, limit).select(F.lit(name).alias("strategy"), "request_id", "id", "place")
        out = own if out is None else out.unionByName(own)
    return out
