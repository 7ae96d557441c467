"""Exact joins and searches of dense vectors by blocked matrix products.

Vectors go to the cell of their nearest pivot, cells are cut into chunks by nearness to it, and a chunk is one packed
matrix with its centre and radius. By the triangle inequality of angles two chunks can hold a pair in reach only if
their centres are no further apart than both radii and the angle of the threshold; other pairs of chunks are not met.
What is left is one matrix product for each pair of chunks: two matrices move for SIZE squared comparisons, and no
pairs of rows are made but those in reach.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.runtime import materialize

#: Vectors that serve as pivots, at most, and vectors of a chunk, about.
PIVOTS, SIZE = 64, 1024
#: Angles are compared with this much room for rounding.
ROOM = 1e-6


def _matrix(column) -> np.ndarray:
    """Unit rows of a list column without nulls; a zero vector stays zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _usable(vectors: DataFrame, v: str) -> DataFrame:
    return vectors.filter(F.col(v).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))))


def chunks(vectors: DataFrame, block: str | None = None, key: str = "id", v: str = "v", size: int = SIZE) -> DataFrame:
    """(block, chunk, ids, m, centre, radius): unit vectors packed by chunk; rows without a key or a whole vector are left out.

    All vectors of a block have one length. m is the chunk's matrix of doubles, radius the widest angle to its centre.
    """
    rows = _usable(vectors, v).filter(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), (F.col(block) if block else F.lit(0)).cast("string").alias("block"), F.col(v).alias("v"))
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()  # PIVOTS vectors at most
    sizes = {len(p.v) for p in pivots}
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)}")
    pivot = _matrix(pa.array([p.v for p in pivots], pa.list_(pa.float64())))

    def cells(batches):
        for batch in batches:
            near = _matrix(batch.column("v")) @ pivot.T
            cell = near.argmax(axis=1) if len(near) else np.zeros(0, np.int64)
            ring = near[np.arange(len(near)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(ring)], names=["id", "block", "v", "cell", "ring"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(cells, f"id {kind}, block string, v {rows.schema['v'].dataType.simpleString()}, cell int, ring double")
    placed = materialize(placed, "cells")
    # Rings of a cell: its quantiles of nearness; equal nearness, as of copies, is dealt by hash inside a ring.
    rings = placed.groupBy("block", "cell").agg(F.count("*").alias("n"), F.percentile_approx(
        "ring", F.array(*[F.lit(k / 16) for k in range(1, 16)]), 1000).alias("cuts"))
    dealt = placed.alias("p").join(rings.alias("r"), F.expr("p.block <=> r.block AND p.cell = r.cell")).select(
        "p.id", "p.block", "p.v", "p.cell", "n", F.size(F.filter("r.cuts", lambda x: x < F.col("p.ring"))).alias("nth"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (16 * size))).cast("int")
    nth = F.when(F.col("n") > size, F.col("nth")).otherwise(0)
    dealt = dealt.withColumn("chunk", F.xxhash64("block", "cell", nth, F.pmod(F.xxhash64("id"), parts))).select("chunk", "block", "id", "v")

    def packed(of, ids, m, id_type):
        """One row for each 2 * size vectors at most of the chunk `of`, named by its first id too, since a long chunk is packed in several goes."""
        for i in range(0, len(ids), 2 * size):
            part, own = m[i:i + 2 * size], ids[i:i + 2 * size]
            centre = part.mean(axis=0)
            length = np.sqrt(centre @ centre)
            centre = centre / length if length > 1e-9 else np.eye(1, part.shape[1])[0]
            radius = float(np.arccos(np.clip((part @ centre).min(), -1, 1)))
            yield pa.RecordBatch.from_arrays([
                pa.array([of[1]], pa.string()), pa.array([f"{of[0]}:{own[0]}:{i}"]), pa.array([own], pa.list_(id_type)), pa.array([part.tobytes()], pa.binary()),
                pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=["block", "chunk", "ids", "m", "centre", "radius"])

    def pack(batches):
        held, n, of = [], 0, None

        def done(id_type):
            if held:
                yield from packed(of, [i for x, _ in held for i in x], np.concatenate([m for _, m in held]), id_type)

        for batch in (x for x in batches if x.num_rows):
            chunk, id_type = batch.column("chunk").to_numpy(), batch.column("id").type
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                now = int(chunk[start]), part.column("block")[0].as_py()
                if now != of or n >= 2 * size:
                    yield from done(id_type)
                    held, n, of = [], 0, now
                held.append((part.column("id").to_pylist(), _matrix(part.column("v"))))
                n += end - start
        if held:
            yield from done(id_type)

    sorted_ = dealt.repartition("chunk").sortWithinPartitions("chunk", "id")
    return materialize(sorted_.mapInArrow(pack, f"block string, chunk string, ids array<{kind}>, m binary, centre array<double>, radius double"), "chunks")


def chunk_pairs(packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of chunks, a <= b, of one block that can hold a pair in reach; heads of chunks are compared, not rows.

    Chunks of a block meet by a grid over the angles to one far vector: two chunks whose angles to it differ by more
    than the radii and the threshold's angle can't be in reach, and fall into cells that do not meet.
    """
    angle = math.acos(max(-1.0, min(1.0, threshold))) + ROOM
    heads = packed.select("block", "chunk", "centre", "radius")
    first = packed.groupBy("block").agg(F.min_by("centre", "chunk").alias("pole"))
    heads = heads.alias("h").join(F.broadcast(first).alias("p"), F.expr("h.block <=> p.block")).select("h.*", "pole")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def arc(x):
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))

    step = max(angle, 0.05)
    heads = heads.withColumn("theta", arc(dot(F.col("centre"), F.col("pole"))))
    reach = (F.col("radius") + angle / 2 + ROOM)
    cells = heads.withColumn("slot", F.explode(F.sequence(F.floor((F.col("theta") - reach) / step), F.floor((F.col("theta") + reach) / step))))
    x, y = cells.alias("x"), cells.alias("y")
    met = x.join(y, F.expr("x.block <=> y.block AND x.slot = y.slot AND x.chunk <= y.chunk"))
    near = arc(dot(F.col("x.centre"), F.col("y.centre"))) <= F.col("x.radius") + F.col("y.radius") + angle
    return met.filter(near | (F.col("x.chunk") == F.col("y.chunk"))).select(F.col("x.chunk").alias("a"), F.col("y.chunk").alias("b")).distinct()


def dense_pairs(vectors: DataFrame, threshold: float, block: str | None = None, key: str = "id", v: str = "v", size: int = SIZE) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of a block with a cosine of threshold (over 0) or more, exactly.

    Null and zero vectors, vectors with null or NaN values and null keys are in no pair; repeated keys with equal
    vectors are no pair either. A null block is a block.
    """
    if threshold <= 0:
        raise ValueError("a threshold over 0 is needed: below it zero vectors count")
    packed = chunks(vectors, block, key, v, size)
    pairs = chunk_pairs(packed, threshold)
    sides = pairs.join(packed.select(F.col("chunk").alias("a"), F.col("ids").alias("ia"), F.col("m").alias("ma")), "a").join(
        packed.select(F.col("chunk").alias("b"), F.col("ids").alias("ib"), F.col("m").alias("mb")), "b").select("a", "b", "ia", "ma", "ib", "mb")
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def products(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, ia, ma, ib, mb = (batch.column(k)[row].as_py() for k in range(6))
                x, y = (np.frombuffer(m).reshape(len(i), -1) for m, i in ((ma, ia), (mb, ib)))
                s = x @ y.T
                i, j = np.nonzero(np.triu(s >= threshold, 1) if a == b else s >= threshold)
                left, right = np.array(ia, object)[i], np.array(ib, object)[j]
                swap = left > right
                low, high = np.where(swap, right, left), np.where(swap, left, right)
                keep = low != high
                yield pa.RecordBatch.from_arrays([pa.array(low[keep].tolist(), batch.schema.field(2).type.value_type), pa.array(high[keep].tolist(), batch.schema.field(2).type.value_type),
                                                  pa.array(s[i, j][keep])], names=["a", "b", "similarity"])

    return sides.mapInArrow(products, f"a {kind}, b {kind}, similarity double")


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, query_rows: int = 4096) -> DataFrame:
    """(request_id, id, similarity, rank): the k nearest of all vectors (id, v) to each query (request_id, v), ties by id.

    Queries go to the tasks in blocks of query_rows, one pass over the vectors each; a task keeps k rows of a query.
    Rows without a whole vector take no part; similarity is the cosine, and below `floor` nothing is ranked.
    """
    asked = _usable(queries, "v").select("request_id", "v").orderBy("request_id")
    kind_q, kind_v = queries.schema["request_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    rows = _usable(vectors, "v").select("id", "v")

    def search(names, m):
        def run(batches):
            best = [[] for _ in names]
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                ids, s = batch.column(0).to_pylist(), m @ _matrix(batch.column(1)).T
                for q in range(len(names)):
                    own = s[q]
                    least = best[q][-1][0] if len(best[q]) >= k else -np.inf
                    at = np.flatnonzero((own >= least) & (own >= (floor if floor is not None else -np.inf)))
                    if len(at):
                        best[q] = sorted(best[q] + [(float(own[i]), ids[i]) for i in at], key=lambda x: (-x[0], x[1]))[:k]
            flat = [(names[q], i, s) for q, found in enumerate(best) for s, i in found]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat]), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat])],
                                                 names=["request_id", "id", "similarity"])
        return run

    found, block = None, []
    stream = asked.toLocalIterator()
    while block := [x for _, x in zip(range(query_rows), stream)]:
        own = rows.mapInArrow(search([x.request_id for x in block], _matrix(pa.array([x.v for x in block], pa.list_(pa.float64())))),
                              f"request_id {kind_q}, id {kind_v}, similarity double")
        found = own if found is None else found.union(own)
    if found is None:
        found = rows.sparkSession.createDataFrame([], f"request_id {kind_q}, id {kind_v}, similarity double")
    order = Window.partitionBy("request_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
