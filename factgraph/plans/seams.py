"""Registered queries of strategies and policies, and the SQL that checks them."""

from pyspark.sql import functions as F

from factgraph.operators import lifecycle as L
from factgraph.operators import seams
from factgraph.operators import visibility as V
from factgraph.operators import writes as D
from factgraph.plans.registry import LEGS_SQL, access, incoming, query
from factgraph.sources import derived as S


@query(f"{LEGS_SQL} SELECT 'search_only' AS strategy, request_id, id, CAST(place AS INT) AS place FROM placed WHERE place <= 10 UNION ALL SELECT 'lexical_only', request_id, id, CAST(rank AS INT) FROM lleg WHERE rank <= 10")
def strategies(spark, sf_dir):
    """Two retrieval strategies over the same requests."""
    requests = S.requests(spark, sf_dir)
    sets = V.scope_sets(requests, access(spark, sf_dir)[1])
    return seams.compared(["search_only", "lexical_only"], requests, S.nodes(spark, sf_dir), sets)


@query()
def confirm_policy(spark, sf_dir):
    """Parked writes settled as always distinct, one after another against the store; tests hold it against a plain loop."""
    writes, store, near = incoming(spark, sf_dir)
    parked = L.parked(D.banded(writes, near, 0.9, 0.97), near)
    edges = S.document_edges(spark, sf_dir)
    peers = edges.select(F.col("src").alias("id"), F.col("dst").alias("peer")).union(edges.select("dst", "src"))
    return seams.settled("always_distinct", parked, writes, store, peers, 0.97)
