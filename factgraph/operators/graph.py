"""Bounded walks, hop distances and canonical chains over edge tables, as unrolled equi-joins."""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.runtime import materialize


def steps(edges: DataFrame, direction: str = "both", both_ways: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, src, dst, type): the moves from a to b that the direction allows; both_ways types go either way."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "type")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "src", "dst", "type")
    either = F.col("type").isin(*both_ways) if both_ways else F.lit(False)
    if direction == "both":
        return out.union(back)
    return out.union(back.filter(either)) if direction == "out" else back.union(out.filter(either))


def walk(starts: DataFrame, moves: DataFrame, max_depth: int = 4, limit: int = 50) -> DataFrame:
    """(start, depth, src, dst, type, node, rn): simple paths from each start, in order of depth, src, dst, type.

    The depth is clamped to 1 to 4 and the limit to 1 to 50; `more` says whether a start had rows beyond it. Deeper
    rows come later, so a start with more than limit rows goes no further, and others have limit paths at most to
    extend. Of a node's moves the first ones in order suffice: limit + 1, and one for each node of a path.
    """
    last, depths = max(1, min(50, limit)), max(1, min(4, max_depth))
    by_edge = Window.partitionBy("a").orderBy("src", "dst", "type", "b")
    moves = moves.withColumn("nth", F.row_number().over(by_edge)).filter(F.col("nth") <= last + 1 + depths).drop("nth")
    front = starts.select(F.col("start"), F.col("start").alias("node"), F.array("start").alias("path"))
    order = Window.partitionBy("start").orderBy("src", "dst", "type", F.array_join("path", ">"))
    found = None
    for depth in range(1, depths + 1):
        nxt = front.join(moves, front["node"] == moves["a"]).filter(~F.array_contains("path", F.col("b"))).select(
            "start", F.lit(depth).alias("depth"), "src", "dst", "type", F.col("b").alias("node"),
            F.array_append("path", F.col("b")).alias("path"))
        nxt = materialize(nxt.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= last + 1), "walk")
        own = nxt.drop("path")
        found = own if found is None else found.unionByName(own)
        full = found.groupBy("start").count().filter(F.col("count") > last).select("start")
        front = nxt.join(full, "start", "left_anti").select("start", "node", "path")
    whole = Window.partitionBy("start")
    return found.withColumn("more", F.count("*").over(whole) > last).withColumn(
        "rn", F.row_number().over(whole.orderBy("depth", "rn"))).filter(F.col("rn") <= last)


def hydrated(walked: DataFrame, starts: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(start, id, depth, resolved_from): the nodes of a walk, the start at depth 0, merged ones as their canonical node.

    nodes has (id, status) of what may be read, roots (id, root) of merged nodes. A node counts once at its least
    depth; ones that resolve to an archived node, but for the start, are left out.
    """
    reached = walked.groupBy("start", F.col("node").alias("raw")).agg(F.min("depth").alias("depth")).unionByName(
        starts.select("start", F.col("start").alias("raw"), F.lit(0).alias("depth")))
    named = reached.join(roots.select(F.col("id").alias("raw"), "root"), "raw", "left").withColumn(
        "id", F.when(F.col("depth") == 0, F.col("raw")).otherwise(F.coalesce("root", "raw")))
    best = named.groupBy("start", "id").agg(F.min(F.struct(
        "depth", F.when(F.col("id") != F.col("raw"), F.col("raw")).alias("resolved_from"))).alias("x"))
    return best.join(nodes.select("id", "status"), "id").filter("status <> 'archived' OR id = start").select(
        "start", "id", F.col("x.depth").alias("depth"), F.col("x.resolved_from").alias("resolved_from"))


def long_chains(links: DataFrame, longer_than: int = 3, cap: int = 50) -> DataFrame:
    """(id, hops) of chains (id, parent) over more than longer_than hops; a cycle counts as cap hops."""
    now = links.filter("parent IS NOT NULL").select("id", F.col("parent").alias("to"), F.lit(1).alias("hops"))
    for _ in range(math.ceil(math.log2(cap)) + 1):
        far = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("h2"))
        now = now.join(far, "to", "left").select(
            "id", F.coalesce("to2", "to").alias("to"), F.least(F.lit(cap), F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"))
        now = materialize(now, "chains")
    return now.filter(F.col("hops") > longer_than).select("id", "hops")


def by_distance(base: DataFrame, hops: DataFrame) -> DataFrame:
    """(request_id, id, place): base (request_id, id, place) by hops (request_id, id, hops), unreached rows last."""
    order = Window.partitionBy("request_id").orderBy(F.asc_nulls_last("hops"), "base")
    return base.withColumnRenamed("place", "base").join(hops, ["request_id", "id"], "left").select(
        "request_id", "id", F.row_number().over(order).alias("place"))


def min_hops(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, kind: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node, hops) within max_depth of any seed, edges taken either way; one row for each node at each round.

    Repeated edges change nothing, so they need not be sorted out. kind may name what a node is, of a few kinds: then
    only edges from a kind that the last round has reached are shuffled.
    """
    moves = steps(edges).select("a", "b")
    seen = seeds.groupBy("node").agg(F.lit(0).alias("hops"))
    for depth in range(1, max_depth + 1):
        front, own = seen.filter(F.col("hops") == depth - 1).select(F.col("node").alias("a")), moves
        if kind:
            own = moves.filter(kind(F.col("a")).isin([r[0] for r in front.select(kind(F.col("a"))).distinct().collect()]))
        nxt = own.join(front, "a", "left_semi").select(F.col("b").alias("node"), F.lit(depth).alias("hops"))
        seen = materialize(seen.union(nxt).groupBy("node").agg(F.min("hops").alias("hops")), "hops")
    return seen


def canonical(links: DataFrame, doublings: int = 4) -> DataFrame:
    """(id, root, hops) from (id, parent), parent null at a root: pointer doubling; an unfinished chain has no root."""
    now = links.select("id", F.coalesce("parent", "id").alias("to"), F.col("parent").isNotNull().cast("int").alias("hops"))
    for _ in range(doublings):
        far = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("h2"))
        now = now.join(far, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"))
    roots = links.filter("parent IS NULL").select(F.col("id").alias("to"), F.col("id").alias("root"))
    return now.join(roots, "to", "left").select("id", "root", "hops")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


def summaries(edges: DataFrame, k: int = 10) -> DataFrame:
    """(id, direction, type, peer): the first k edges of each node and direction by peer, then type."""
    both = edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "type", F.col("dst").alias("peer")).union(
        edges.select(F.col("dst"), F.lit("in"), "type", F.col("src")))
    order = Window.partitionBy("id", "direction").orderBy("peer", "type")
    return both.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")


def neighbour_links(ids: DataFrame, edges: DataFrame, titles: DataFrame, k: int = 5) -> DataFrame:
    """(id, direction, type, peer, title): the first k edges of each node by direction, type and peer, with the peer's title."""
    both = edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "type", F.col("dst").alias("peer")).union(
        edges.select("dst", F.lit("in"), "type", "src"))
    order = Window.partitionBy("id").orderBy("direction", "type", "peer")
    rows = both.join(ids.select("id").distinct(), "id", "left_semi").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")
    return rows.join(titles.select(F.col("id").alias("peer"), "title"), "peer").select("id", "direction", "type", "peer", "title")


def beyond_hits(hits: DataFrame, moves: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """(request_id, id, depth): nodes that walks from a request's hits reach and that are no hits of it, at their least depth."""
    starts = hits.select(F.col("id").alias("start")).distinct()
    reached = hydrated(walk(starts, moves, depth, limit), starts, nodes, roots)
    rows = hits.select("request_id", F.col("id").alias("start")).join(reached, "start").filter("depth > 0")
    return rows.groupBy("request_id", "id").agg(F.min("depth").alias("depth")).join(hits.select("request_id", "id"), ["request_id", "id"], "left_anti")


def combined(first: DataFrame, second: DataFrame, limit: int = 12) -> DataFrame:
    """(request_id, id, source, place): rows (request_id, id, place) of two retrievals, the first ones before, each id once."""
    rows = first.select("request_id", "id", "place", F.lit(0).alias("s")).union(second.select("request_id", "id", "place", F.lit(1)))
    once = rows.groupBy("request_id", "id").agg(F.min(F.struct("s", "place")).alias("x"))
    order = Window.partitionBy("request_id").orderBy("x.s", "x.place", "id")
    return once.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).select(
        "request_id", "id", F.when(F.col("x.s") == 0, "briefing").otherwise("search").alias("source"), F.col("rn").alias("place"))
