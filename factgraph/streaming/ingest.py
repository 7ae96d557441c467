"""Continuous deduplicating ingest: each micro-batch of facts is written one by one into a versioned store.

A store is a folder of three tables partitioned by micro-batch: the rows that a batch left in the store, the log of its
decisions, and a marker written last. A batch reads what earlier batches left and replaces only its own partitions, so
one that is run again after a failure gives the same store, and one that is done changes nothing. Facts whose id the
log already has are skipped, so sending a fact twice changes nothing either.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators.writes import sequential
from factgraph.runtime import exists, materialize

LOG = "seq long, candidate long, similarity double, outcome string"


class Store:
    """The store in `path` over a base of facts (id, type, title, body, scope_id, status) that is never changed."""

    def __init__(self, spark: SparkSession, path: str, base: DataFrame):
        self.spark, self.path, self.base = spark, path, base
        self.columns = ["id", "type", "title", "body", "scope_id", "status"]

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        if not exists(self.spark, f"{self.path}/done"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*")
        done = self.spark.read.schema("batch long").option("basePath", f"{self.path}/done").parquet(f"{self.path}/done/batch=*").select("batch").distinct()
        rows = rows.join(done, "batch", "left_semi")
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def nodes(self, before: int | None = None) -> DataFrame:
        """The base and the rows of finished batches, those with a smaller number than `before` only if it is given."""
        kinds = ", ".join(f"{c} {self.base.schema[c].dataType.simpleString()}" for c in self.columns)
        return self.base.select(*self.columns).unionByName(self._read("nodes", kinds, before))

    def log(self, before: int | None = None) -> DataFrame:
        """(seq, candidate, similarity, outcome) of every fact that was written."""
        return self._read("log", LOG, before)

    def links(self, before: int | None = None) -> DataFrame:
        """(id, peer) both ways of facts that were linked to the one they restate."""
        rows = self.log(before).filter("outcome = 'merge_linked'").select(F.col("seq").alias("id"), F.col("candidate").alias("peer"))
        return rows.union(rows.select("peer", "id"))

    def write(self, facts: DataFrame, batch: int, peers: DataFrame, low: float, high: float, sets: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write a micro-batch of facts by id; of several facts of one id the least text counts, null ids are left out.

        peers (id, peer) are declared beside the links that merges made; sets gives the scopes (seq, scope_id) that the
        facts may see, all of their own scope if it is not given. Thresholds over 1 insert everything: a control arm.
        """
        if exists(self.spark, f"{self.path}/done/batch={batch}"):
            return
        known = self.log(batch).select(F.col("seq").alias("id"))
        fresh = facts.filter(F.col("id").isNotNull()).join(known, "id", "left_anti").groupBy("id").agg(
            F.min(F.struct(*[c for c in self.columns if c not in ("id", "status")])).alias("x")).select("id", "x.*")
        fresh = materialize(fresh.withColumn("status", F.lit("active")), "fresh")
        seen = sets(fresh) if sets else fresh.select(F.col("id").alias("seq"), "scope_id")
        log = materialize(sequential(fresh, self.nodes(batch), peers.select("id", "peer").union(self.links(batch)), low, high, seen), "outcomes")
        log.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        kept = log.filter("outcome IN ('insert', 'merge_linked')").select(F.col("seq").alias("id"))
        fresh.join(kept, "id", "left_semi").select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/nodes/batch={batch}")
        self.spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")

    def ingest(self, stream: DataFrame, peers: DataFrame, low: float, high: float, sets=None):
        """A started query that writes every micro-batch of a stream of facts; its checkpoint lies in the store."""
        return stream.writeStream.foreachBatch(lambda df, k: self.write(df, k, peers, low, high, sets)).option(
            "checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
