"""Briefings: declared sections of a node table, ranked for all principals in one plan."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.retrieval import fused, lexical_leg, vector_leg

TOP = 10


@dataclass(frozen=True)
class Semantic:
    """A section filled by hybrid search with a request's hint: node types (none: all), the rows kept, and the vector leg's floor."""

    name: str
    types: tuple[str, ...] = ()
    top: int = TOP
    floor: float | None = None


@dataclass(frozen=True)
class Section:
    """A named filter: an SQL predicate on node columns, and edge types that a row must not have going out."""

    name: str
    where: str = "true"
    without_edge: str | None = None
    status: str = "active"
    order: str = "created_at"


def rows_of(section: Section, seen: DataFrame, edges: DataFrame) -> DataFrame:
    """(principal, section, id, place): the first TOP rows of a section, nulls of its order last, then newest, then id."""
    rows = seen.filter((F.col("status") == section.status) & F.expr(section.where))
    if section.without_edge:
        rows = rows.join(edges.filter(F.col("type") == section.without_edge).select(F.col("src").alias("id")), "id", "left_anti")
    order = Window.partitionBy("principal").orderBy(F.asc_nulls_last(section.order), F.desc("created_at"), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP).select(
        "principal", F.lit(section.name).alias("section"), "id", "place")


def briefing(sections: list[Section], seen: DataFrame, edges: DataFrame, principals: DataFrame) -> DataFrame:
    """rows_of each section; a section without rows for a principal is one row with null id and place 0."""
    found = reduce(DataFrame.unionByName, [rows_of(s, seen, edges) for s in sections])
    wanted = principals.select("principal", F.explode(F.array(*[F.lit(s.name) for s in sections])).alias("section"))
    return wanted.join(found, ["principal", "section"], "left").select(
        "principal", "section", "id", F.coalesce("place", F.lit(0)).alias("place"))


def semantic_rows(section: Semantic, requests: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(request_id, section, id, place): the best active nodes of the section's types for each request (request_id, query), by both legs.

    sets (request_id, scope_id) gives the scopes of a request. A null or blank query has no rows; all requests are one plan.
    """
    asked = requests.filter("trim(query) <> ''")
    nodes = nodes.filter(F.col("type").isin(*section.types)) if section.types else nodes
    found = fused(vector_leg(asked, nodes, sets, section.floor), lexical_leg(asked, nodes, sets), nodes)
    return found.filter(F.col("place") <= section.top).select("request_id", F.lit(section.name).alias("section"), "id", "place")


def hinted(sections: list[Semantic], requests: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """semantic_rows of each section; a section without rows for a request is one row with null id and place 0."""
    found = reduce(DataFrame.unionByName, [semantic_rows(s, requests, nodes, sets) for s in sections])
    wanted = requests.select("request_id", F.explode(F.array(*[F.lit(s.name) for s in sections])).alias("section"))
    return wanted.join(found, ["request_id", "section"], "left").select("request_id", "section", "id", F.coalesce("place", F.lit(0)).alias("place"))


def audited(found: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, principal, sections, nodes): an audit row for each request over all scopes, with what it showed."""
    shown = found.groupBy("request_id").agg(F.count_distinct("section").alias("sections"), F.count_distinct("id").alias("nodes"))
    return requests.filter("scope = 'all'").select("request_id", "principal").join(shown, "request_id")


def surfaced(found: DataFrame) -> DataFrame:
    """(request_id, id): each node that a request showed, once, whatever the sections: what recall statistics count."""
    return found.filter("id IS NOT NULL").select("request_id", "id").distinct()


def with_linked(found: DataFrame, edges: DataFrame, seen: DataFrame, kind: str) -> DataFrame:
    """(principal, section, id, peer, nth): the visible nodes that an edge of `kind` leads to, newest first, all of them."""
    out = edges.filter(F.col("type") == kind).select(F.col("src").alias("id"), F.col("dst").alias("peer"))
    peers = seen.select("principal", F.col("id").alias("peer"), "created_at")
    rows = found.join(out, "id").join(peers, ["principal", "peer"])
    order = Window.partitionBy("principal", "section", "id").orderBy(F.desc("created_at"), "peer")
    return rows.select("principal", "section", "id", "peer", F.row_number().over(order).alias("nth"))


def overdue(inbox: DataFrame, now, days: int = 14) -> DataFrame:
    """(principal, overdue): pending rows of each principal that are `days` old or older at `now`."""
    old = inbox.filter("status = 'pending'").filter(F.col("created_at") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY"))
    return old.groupBy("principal").agg(F.count("*").alias("overdue"))
