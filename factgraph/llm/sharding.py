"""Sharding along a Hilbert curve over metadata, by native functions only.

Each dimension is quantised at quantiles (strings by the bytes after their common prefix), a row's codes give its
cell on the curve, and rows in curve order are cut into runs of equal length, so a shard covers a compact box of
the dimensions and its files can be skipped by any of them.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.runtime import materialize

#: Bits of a dimension's code, and rows of one cell that one task numbers.
BITS, RUN = 4, 20_000
#: Bytes of a string after the common prefix that count, accuracy of the quantiles.
HEAD, ACCURACY = 6, 1_000


def hilbert_index(codes, bits: int, dims: int):
    """Index on the Hilbert curve of an array of codes below 2 ** bits: undo the excess work, Gray-code, interleave."""
    steps = F.sequence(F.lit(0), F.lit((bits - 1) * dims - 1))

    def step(x, k):
        q = F.call_function("shiftright", F.lit(1 << (bits - 1)), (k / dims).cast("int"))
        i = (k % dims).cast("int")
        p, own, first = q - 1, F.get(x, i), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        return F.transform(x, lambda v, j: F.when(
            own.bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).when(
            (j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))

    x = F.aggregate(steps, codes, step) if bits > 1 else codes
    x = F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, y: a.bitwiseXOR(y)))
    levels = F.sequence(F.lit(bits - 1), F.lit(1)) if bits > 1 else F.array().cast("array<int>")
    top = F.get(x, F.lit(dims - 1))
    t = F.aggregate(levels, F.lit(0), lambda a, b: F.when(
        F.call_function("shiftright", top, b).bitwiseAND(1) != 0,
        a.bitwiseXOR(F.call_function("shiftleft", F.lit(1), b) - 1)).otherwise(a))
    x = F.transform(x, lambda v: v.bitwiseXOR(t))
    places = F.sequence(F.lit(0), F.lit(bits * dims - 1))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, k: (a * 2 + F.call_function(
        "shiftright", F.get(x, (k % dims).cast("int")), (F.lit(bits - 1) - (k / dims).cast("int"))).bitwiseAND(1)))


def quantised(docs: DataFrame, dims: list[str], bits: int) -> list:
    """A code column for each dimension, from one pass for the prefixes and one for the quantiles; null has code 0."""
    texts = [d for d in dims if isinstance(docs.schema[d].dataType, T.StringType)]
    ends = docs.agg(F.lit(1), *[f(d) for d in texts for f in (F.min, F.max)]).first()
    numbers = {d: F.col(d).cast("double") for d in dims}
    for k, d in enumerate(texts):
        low, high = (ends[1 + 2 * k] or "").encode(), (ends[2 + 2 * k] or "").encode()
        n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        head = F.rpad(F.hex(F.substring(F.col(d).cast("binary"), n + 1, HEAD)), 2 * HEAD, "0")
        numbers[d] = F.conv(head, 16, 10).cast("double")
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = docs.agg(*[F.percentile_approx(numbers[d], cuts, ACCURACY) for d in dims]).first()
    return [F.coalesce(spread(numbers[d], sorted(set(found[k] or [])), bits), F.lit(0)).alias(f"code_{d}")
            for k, d in enumerate(dims)]


def spread(value, cuts: list[float], bits: int):
    """Number of cuts below value, stretched over all codes where there are few cuts."""
    below = sum(((value > c).cast("int") for c in cuts), F.lit(0))
    return F.floor(below * (1 << bits) / (len(cuts) + 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int, dims: list[str], key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, size, text_crc32, cell, shard, slot): rows in curve order cut into `shards` runs, counts at most one apart.

    size: UTF-8 bytes of the text plus 8; a null text has none and the checksum 0. Order: cell, a hash of the key
    in crowded cells, then key, size and checksum; equal rows take neighbouring slots. An empty table gives no rows.
    """
    rows = materialize(docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("crc"), *quantised(docs, dims, bits)), "codes")
    # The curve is followed once for each combination of codes: 2 ** (bits * dims) rows at most.
    codes = [f"code_{d}" for d in dims]
    places = materialize(rows.select(*codes).distinct(), "boxes").withColumn("cell", hilbert_index(F.array(*codes), bits, len(dims)))
    rows = rows.join(F.broadcast(materialize(places, "places")), codes).drop(*codes)
    # A row for each cell of the curve: 2 ** (bits * dims) at most.
    cells = rows.groupBy("cell").count().select(
        "cell", F.ceil(F.col("count") / RUN).cast("int").alias("runs"),
        F.coalesce(F.sum("count").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("count").over(Window.partitionBy()).alias("n"))
    rows = rows.join(F.broadcast(cells), "cell").withColumn("run", F.pmod(F.xxhash64("key", "size", "crc"), "runs").cast("int"))
    runs = rows.groupBy("cell", "run").count().select("cell", "run", F.coalesce(F.sum("count").over(
        Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("cell", "run").orderBy("key", "size", "crc")
    ranked = rows.withColumn("own", F.row_number().over(order) - 1).join(runs, ["cell", "run"]).withColumn(
        "rank", F.col("base") + F.col("ahead") + F.col("own"))
    shard = F.expr(f"cast(rank * {shards} div n as int)")
    return ranked.withColumn("shard", shard).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "cell", "shard",
        (F.col("rank") - F.expr(f"(cast(shard as long) * n + {shards - 1}) div {shards}")).alias("slot"))


def op8(docs: DataFrame) -> DataFrame:
    return hilbert_shards(docs, 24, ["lang", "source", "n_chars"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
