"""Batch hybrid retrieval: two ranked legs, reciprocal rank fusion, near-duplicate collapse, limit."""

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as X
from factgraph.operators import tiles
from factgraph.runtime import materialize

LEG, RRF = 30, 60
#: Requests that go to the tasks at a time, and nodes whose products with them a task adds up at once.
REQUESTS, NODES = 512, 256
#: Share of a block's pairs that may meet in near_pairs() before its vectors are multiplied in tiles.
SPARSE = 0.02


def ranked(df: DataFrame, k: int, *order) -> DataFrame:
    """Rows of rank k or better within each request."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).filter(F.col("rank") <= k)


def vector_leg(requests: DataFrame, nodes: DataFrame, sets: DataFrame, floor: float | None = None, k: int = LEG,
               block: int = REQUESTS) -> DataFrame:
    """(request_id, id, similarity, rank): top k by cosine of hashed token vectors, ties by id.

    Requests go to the tasks as postings by dimension, `block` of them at a time, with the scopes that sets (request_id, scope_id)
    gives them; each task adds up the products of its packed nodes and keeps k rows of a request, so no pairs are
    shuffled but the best. Nodes that share no dimension have similarity 0 and are not ranked.
    """
    live = searchable(nodes.filter("status = 'active'"))
    w = F.col("w")
    v = live.select("id", "scope_id", F.explode(X.all_tokens(F.col("searchable"))).alias("t")).groupBy(
        "id", "scope_id", X.dimension(F.col("t")).alias("dim")).agg(F.count("*").alias("w"))
    v = v.groupBy("id", "scope_id").agg(F.sum(w * w).alias("nn"), F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), "w")).alias("v")).select(
        "id", "scope_id", "nn", F.col("v.dim").alias("dims"), F.col("v.w").alias("ws"))
    q = X.hashed_vectors(requests, "request_id", F.col("query")).groupBy("request_id").agg(
        F.sum(w * w).alias("nn"), F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), "w")).alias("v"))
    q = q.join(sets.groupBy("request_id").agg(F.collect_set("scope_id").alias("scopes")), "request_id").orderBy("request_id")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((q, "request_id"), (v, "id"))]
    schema = f"request_id {kinds[0]}, id {kinds[1]}, similarity double"
    stream, parts = q.toLocalIterator(), []
    while rows := list(itertools.islice(stream, block)):
        if parts == [] and len(rows) == block:
            v = materialize(v, "vectors")  # more blocks may follow
        parts.append(v.mapInArrow(_nearest(rows, floor, k), schema))
    found = functools.reduce(DataFrame.union, parts) if parts else requests.sparkSession.createDataFrame([], schema)
    return ranked(found, k, F.desc("similarity"), "id")


def _nearest(rows, floor: float | None, k: int):
    """A task that ranks packed nodes for the requests in rows (request_id, nn, v, scopes)."""
    own = np.array([float(r.nn) for r in rows])
    postings = sorted((x.dim, at, float(x.w)) for at, r in enumerate(rows) for x in r.v)  # by dimension: which requests have it, and how often
    held = np.bincount([d for d, _, _ in postings], minlength=X.DIMS) if postings else np.zeros(X.DIMS, np.int64)
    start = np.cumsum(held) - held
    which, weight = np.array([at for _, at, _ in postings], np.int64), np.array([w for *_, w in postings])
    names, masks, none = [r.request_id for r in rows], {}, np.zeros(len(rows), bool)
    for at, r in enumerate(rows):
        for scope in r.scopes:
            masks.setdefault(scope, none.copy())[at] = True

    def run(batches):
        best, kind = [[] for _ in names], None
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in (batch.slice(i, NODES) for i in range(0, batch.num_rows, NODES)):
                dims = part.column("dims")
                row = np.repeat(np.arange(part.num_rows), dims.value_lengths().to_numpy(zero_copy_only=False))
                dim = dims.flatten().to_numpy()
                n = held[dim]
                at = np.repeat(start[dim] - np.cumsum(n) + n, n) + np.arange(n.sum())
                dot = np.bincount(np.repeat(row, n) * len(rows) + which[at], np.repeat(part.column("ws").flatten().to_numpy(), n) * weight[at],
                                  part.num_rows * len(rows)).reshape(part.num_rows, -1)
                seen = np.array([masks.get(s, none) for s in part.column("scope_id").to_pylist()]).reshape(len(dot), -1)
                near = np.where(seen & (dot > 0), dot / np.sqrt(part.column("nn").to_numpy().astype(float)[:, None] * own), -1.0)
                ids = part.column("id").to_pylist()
                for at in np.flatnonzero(near.max(axis=0, initial=-1.0) >= max(floor or 0.0, 0.0)).tolist():
                    column = near[:, at]
                    least = max(best[at][-1][0] if len(best[at]) >= k else 0.0, floor or 0.0)
                    hits = np.flatnonzero((column >= least) & (column > 0))
                    if len(hits):
                        best[at] = sorted(best[at] + [(float(column[i]), ids[i]) for i in hits], key=lambda x: (-x[0], x[1]))[:k]
        flat = [(names[at], i, s) for at, found in enumerate(best) for s, i in found]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat]), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat])],
                                             names=["request_id", "id", "similarity"])
    return run


def lexical_leg(requests: DataFrame, nodes: DataFrame, sets: DataFrame, share: float = 0.5, k: int = LEG) -> DataFrame:
    """(request_id, id, hits, rank): nodes with at least `share` of the query's distinct tokens, by number matched, then id.

    Tokens meet inside the scopes that sets (request_id, scope_id) gives a request, so no others are counted.
    """
    live = nodes.filter("status = 'active'")
    postings = live.select("id", "scope_id", F.explode(X.tokens(F.concat_ws("\n", "title", "body"))).alias("token"))
    terms = requests.select("request_id", F.explode(X.tokens(F.col("query"))).alias("token"))
    need = terms.groupBy("request_id").agg(F.count("*").alias("n"))
    asked = terms.join(sets.select("request_id", "scope_id").distinct(), "request_id")
    found = postings.join(asked, ["token", "scope_id"]).groupBy("request_id", "id").agg(F.count("*").alias("hits"))
    found = found.join(need, "request_id").filter(F.col("hits") >= F.col("n") * share)
    return ranked(found.select("request_id", "id", "hits"), k, F.desc("hits"), "id")


def fused(vector: DataFrame, lexical: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, id, score, place): reciprocal rank fusion, ties by newest, then id."""
    both = vector.select("request_id", "id", F.col("rank").alias("rv")).join(
        lexical.select("request_id", "id", F.col("rank").alias("rl")), ["request_id", "id"], "full_outer")

    def part(c):
        return F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(c)), F.lit(0.0))

    scored = both.withColumn("raw", part("rv") + part("rl")).join(nodes.select("id", "created_at"), "id")
    order = Window.partitionBy("request_id").orderBy(F.desc("raw"), F.desc("created_at"), "id")
    return scored.select("request_id", "id", F.round("raw", 6).alias("score"), F.row_number().over(order).alias("place"))


def collapsed(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """results without rows that are near-duplicates (pairs a, b) of a better-placed row that stays.

    A request has twice LEG rows at most, so its walk is a fold over one small array.
    """
    near = pairs.select(F.col("a").alias("id"), F.col("b").alias("peer")).union(pairs.select("b", "a"))
    peers = results.select("request_id", "id").join(near, "id").groupBy("request_id", "id").agg(F.collect_set("peer").alias("peers"))
    rows = results.join(peers, ["request_id", "id"], "left").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", "id", "score", F.coalesce("peers", F.expr("array()").cast("array<bigint>")).alias("peers")))).alias("rows"))
    keep = F.aggregate("rows", F.expr("cast(array() as array<bigint>)"), lambda kept, x: F.when(
        F.arrays_overlap(kept, x["peers"]), kept).otherwise(F.array_append(kept, x["id"])))
    return rows.withColumn("kept", keep).select("request_id", F.posexplode(F.filter("rows", lambda x: F.array_contains("kept", x["id"])))).select(
        "request_id", "col.id", "col.score", (F.col("pos") + 1).alias("place"))


def limited(results: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` rows of each request, and whether there were more."""
    total = F.count("*").over(Window.partitionBy("request_id"))
    return results.withColumn("truncated", total > limit).filter(F.col("place") <= limit)


def rank_fusion(lists: DataFrame) -> DataFrame:
    """(request_id, id, place) from (request_id, list, id, rank): list 0 is the base, other lists only reorder it."""
    base = lists.filter("list = 0").select("request_id", "id", F.col("rank").alias("base"))
    both = lists.join(base, ["request_id", "id"])
    parts = both.groupBy("request_id", "id").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.struct("list", "rank"))).alias("r"))
    score = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.lit(1.0) / (RRF + x["rank"]))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "base")
    return parts.withColumn("score", score).select("request_id", "id", F.row_number().over(order).alias("place"))


def searchable(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("searchable", F.concat_ws("\n", "title", "body"))


def text_classes(nodes: DataFrame, block: str = "type") -> DataFrame:
    """(id, rep): rep is the least id of the same block, title and body, so copies have one."""
    digest = F.sha2(F.to_json(F.struct(F.col(block).alias("b"), "title", "body")).cast("binary"), 256)
    rows = nodes.select("id", digest.alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep")


def near_pairs(nodes: DataFrame, threshold: float, block: str = "type", share: float = SPARSE, size: int = tiles.PART) -> DataFrame:
    """(a, b, similarity), a < b: pairs within a block with cosine of hashed token vectors >= threshold.

    Exact, in one of two ways for each block. By prefix filtering: a vector's tail is its most common dimensions whose
    squared weights sum to less than threshold squared of its squared norm. A pair in reach shares a dimension outside
    both tails, so only those meet; the pairs that met are verified on whole vectors. Where more than `share` of a
    block's pairs would meet that way, as in texts of one small vocabulary, its vectors are dealt to tiles instead,
    which are multiplied whole. Vectors stay packed, one row each, but for the dimensions by which they meet. Copies
    are pairs too: pass the rows of text_classes() that represent themselves where there may be many.
    """
    v = materialize(tiles.packed_vectors(nodes.select("id", F.col(block).alias("block"), "title", "body"), "id", "block"), "vectors")
    common = np.zeros(X.DIMS, np.int64)
    for r in v.select(F.explode("dims").alias("dim")).groupBy("dim").count().collect():  # a number for each dimension
        common[r.dim] = r["count"]
    heads = v.mapInArrow(_heads(common, threshold), f"id {tiles.id_type(v)}, block {v.schema['block'].dataType.simpleString()}, dim smallint")
    meets = heads.groupBy("block", "dim").agg(F.count("*").alias("n")).groupBy("block").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("meets"))
    rows = v.groupBy("block").agg(F.count("*").alias("rows"))
    ways = materialize(rows.join(meets, "block").select("block", (F.col("meets") > share * F.col("rows") * (F.col("rows") - 1)).alias("tiled")), "ways")
    head = heads.join(ways.filter("NOT tiled").select("block"), "block", "left_semi")
    met = head.alias("x").join(head.alias("y"), ["block", "dim"]).filter("x.id < y.id").select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    found = similarities(met, v.select("id", "nn", "dims", "ws")).filter(F.col("similarity") >= threshold)
    return found.union(tiles.pairs(v.join(ways.filter("tiled").select("block"), "block", "left_semi"), threshold, size))


def _heads(common: np.ndarray, threshold: float):
    """A task that gives (id, block, dim) of the dimensions outside the tail of packed vectors; common has the vectors of each dimension."""
    def run(batches):
        for batch in batches:
            dims, n = batch.column("dims"), batch.column("dims").value_lengths().to_numpy(zero_copy_only=False)
            row, dim = np.repeat(np.arange(batch.num_rows), n), dims.flatten().to_numpy()
            order = np.lexsort((dim, -common[dim], row))
            squares = batch.column("ws").flatten().to_numpy()[order].astype(float) ** 2
            total = np.cumsum(squares)
            start = np.cumsum(n) - n
            before = np.concatenate([[0.0], total])[start]
            own = total - np.repeat(before, n) >= threshold * threshold * 0.999999 * np.repeat(batch.column("nn").to_numpy(), n)
            at = pa.array(row[order][own])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("block").take(at), pa.array(dim[order][own])], names=["id", "block", "dim"])
    return run


def packed(vectors: DataFrame) -> DataFrame:
    """(id, nn, dims, ws) of sparse vectors (id, dim, w, nn): one row for each, its dimensions in order."""
    rows = vectors.groupBy("id").agg(F.first("nn").alias("nn"), F.array_sort(F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), F.col("w").cast("long").alias("w")))).alias("v"))
    return rows.select("id", "nn", F.col("v.dim").alias("dims"), F.col("v.w").alias("ws"))


def similarities(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) by packed() vectors; pairs without a common dimension are left out.

    A pair meets its two vectors once each, and an Arrow batch of pairs is one intersection of sorted numbers.
    """
    x, y = (vectors.select(F.col("id").alias(k), F.col("nn").alias(f"n{k}"), F.col("dims").alias(f"d{k}"), F.col("ws").alias(f"w{k}")) for k in "ab")
    rows = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", (F.col("na") * F.col("nb")).alias("nn"), "da", "wa", "db", "wb")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("a", "b", "nn")]

    def dots(batches):
        for batch in batches:
            sides = []
            for d, w in (("da", "wa"), ("db", "wb")):
                dims = batch.column(d)
                row = np.repeat(np.arange(batch.num_rows), dims.value_lengths().to_numpy(zero_copy_only=False))
                sides.append((row * X.DIMS + dims.flatten().to_numpy(), batch.column(w).flatten().to_numpy().astype(np.int64)))
            (ka, wa), (kb, wb) = sides
            both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            dot = np.zeros(batch.num_rows, np.int64)
            np.add.at(dot, both // X.DIMS, wa[i] * wb[j])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dot)], names=["a", "b", "nn", "dot"])

    found = rows.mapInArrow(dots, f"a {kinds[0]}, b {kinds[1]}, nn {kinds[2]}, dot long").filter("dot > 0")
    return found.select("a", "b", (F.col("dot") / F.sqrt(F.col("nn").cast("double"))).alias("similarity"))


def pairs_in_results(results: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of near duplicates that meet in a result set; a request has twice LEG rows at most."""
    ids = results.select("request_id", "id")
    met = ids.alias("x").join(ids.alias("y"), "request_id").filter("x.id < y.id").select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    hits = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    v = X.hashed_vectors(searchable(hits), "id", F.col("searchable"))
    v = v.join(X.with_norm(v, "id"), "id")
    return similarities(met, packed(v)).filter(F.col("similarity") >= threshold)


def undeclared(pairs: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("same_topic", "relates_to")) -> DataFrame:
    """pairs without those that an edge of one of the kinds, either way, declares distinct."""
    told = edges.filter(F.col("type").isin(*kinds)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.join(told.distinct(), ["a", "b"], "left_anti")
