"""Who may read and write which scopes, nodes and edges, as joins on small scope tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def readable(scopes: DataFrame, grants: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal, scope_id, ambient): not archived, and shared, owned or granted."""
    live = scopes.filter("NOT archived")
    shared = live.filter("visibility <> 'private'").select("scope_id", "ambient").join(principals)
    owned = live.select("scope_id", "ambient", F.col("owner").alias("principal"))
    granted = live.select("scope_id", "ambient").join(grants.select("scope_id", "principal"), "scope_id")
    return shared.unionByName(owned).unionByName(granted).join(principals, "principal", "left_semi").distinct()


def writable(scopes: DataFrame, grants: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal, scope_id): not archived, and open to all, owned or granted for writing."""
    live = scopes.filter("NOT archived")
    shared = live.filter("visibility = 'team-write'").select("scope_id").join(principals)
    owned = live.select("scope_id", F.col("owner").alias("principal"))
    granted = live.select("scope_id").join(grants.filter("level = 'write'").select("scope_id", "principal"), "scope_id")
    return shared.unionByName(owned).unionByName(granted).join(principals, "principal", "left_semi").distinct()


def visible_nodes(nodes: DataFrame, readable_: DataFrame) -> DataFrame:
    """(principal, node columns): a row for each principal that may read the node's scope."""
    return nodes.join(readable_.select("principal", "scope_id"), "scope_id")


def visible_edges(edges: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose two ends are both among the visible node ids."""
    return (edges.join(seen.select(F.col(key).alias("src")), "src", "left_semi")
            .join(seen.select(F.col(key).alias("dst")), "dst", "left_semi").select("src", "dst", "type"))


def edge_permission(edges: DataFrame, nodes: DataFrame, readable_: DataFrame, writable_: DataFrame) -> DataFrame:
    """(principal, src, dst, type): both ends readable and one writable."""
    ends = nodes.select("id", "scope_id")
    may = readable_.select("principal", "scope_id").join(
        writable_.select("principal", "scope_id", F.lit(True).alias("w")), ["principal", "scope_id"], "left")
    pairs = edges.join(ends.select(F.col("id").alias("src"), F.col("scope_id").alias("a")), "src").join(
        ends.select(F.col("id").alias("dst"), F.col("scope_id").alias("b")), "dst")
    left = may.select("principal", F.col("scope_id").alias("a"), F.col("w").alias("wa"))
    right = may.select("principal", F.col("scope_id").alias("b"), F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, ["principal", "b"]).filter("wa OR wb").select("principal", "src", "dst", "type")


def scope_sets(requests: DataFrame, readable_: DataFrame) -> DataFrame:
    """(request_id, scope_id): the requested scope and the ambient ones, as far as readable; 'all' takes all readable."""
    return requests.join(readable_, "principal").filter("scope = 'all' OR ambient OR scope_id = scope").select(
        "request_id", "scope_id").distinct()


def refused_all(requests: DataFrame, restricted: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a request for all scopes by a restricted principal is refused, not narrowed."""
    bad = (F.col("scope") == "all") & F.expr(restricted)
    return requests.filter(~bad), requests.filter(bad)
