"""Structured Streaming forms of capture, usage rollup and recall statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.evaluation import METRIC_OF


def captures(stream: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Pending inbox rows, each key once within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key]).withColumn(
        "status", F.lit("pending"))


def usage_stream(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(principal, metric, day, n) over tumbling UTC days; events later than the watermark are dropped."""
    metric = F.lit(None).cast("array<string>")
    for kind, names in METRIC_OF.items():
        metric = F.when(F.col("event_type") == kind, F.array(*map(F.lit, names))).otherwise(metric)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("metric", F.explode(metric))
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "principal", "metric").agg(F.count("*").alias("n")).select(
        "principal", "metric", F.to_date("w.start").alias("day"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(principal, first, last, n): runs of activity without a pause of `gap`."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("principal", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "principal", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")
