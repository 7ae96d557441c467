"""Fact-graph tables derived from the given tables; NODES_SQL and the others are the same derivations in SQL."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions.text import heading
from factgraph.runtime import table

AS_OF = "2024-02-01 00:00:00"
#: Values of doc_id in a block of one source.
EDGE_BLOCK = 65_536


def nodes(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    return docs.join(toxic, "doc_id", "left").select(
        F.lit("s1").alias("space_id"), F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("scope_id"),
        heading(F.col("text")).alias("title"), F.coalesce("text", F.lit("")).alias("body"), "n_chars",
        F.when(F.col("toxic"), "archived").otherwise("active").alias("status"),
        F.concat(F.lit("p"), F.col("doc_id") % 5).alias("author"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)").alias("created_at"))


def scopes(spark, sf_dir) -> DataFrame:
    i = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return table(spark, sf_dir, "documents").select("source").distinct().withColumn("i", i).select(
        F.col("source").alias("scope_id"), "i", F.concat(F.lit("p"), F.col("i") % 5).alias("owner"),
        F.expr("element_at(array('private', 'team-read', 'team-write'), cast(i % 3 as int) + 1)").alias("visibility"),
        (F.col("i") % 10 == 0).alias("ambient"), (F.col("i") == 19).alias("archived"))


def grants(scopes_: DataFrame) -> DataFrame:
    return scopes_.select("scope_id", F.concat(F.lit("p"), (F.col("i") + 1) % 5).alias("principal"),
                          F.when(F.col("i") % 2 == 1, "write").otherwise("read").alias("level"))


def principals(spark) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("p"), "id").alias("principal"))


def requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), F.col("text").alias("query"), F.concat(F.lit("p"), F.col("item_id") % 5).alias("principal"),
        F.when(F.col("item_id") % 3 == 0, "all").otherwise(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("scope"))


def business_edges(spark, sf_dir, once: bool = True) -> DataFrame:
    """(src, dst, type), each edge once unless the caller has no need of that."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer = table(spark, sf_dir, "customer")

    def name(prefix, c):
        return F.concat(F.lit(prefix), F.col(c))

    def edge(df, kind, a, b):
        rows = df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
        return rows.distinct() if once else rows

    return (
        edge(orders, "placed_by", name("o:", "o_orderkey"), name("c:", "o_custkey"))
        .union(edge(items, "contains", name("o:", "l_orderkey"), name("p:", "l_partkey")))
        .union(edge(items, "supplied_by", name("p:", "l_partkey"), name("s:", "l_suppkey")))
        .union(edge(customer, "located_in", name("c:", "c_custkey"), name("n:", "c_nationkey"))))


def document_edges(spark, sf_dir) -> DataFrame:
    """relates_to between neighbours (by doc_id) of one source; a source is dealt in blocks of doc_id."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL AND source IS NOT NULL").select(
        "source", "doc_id", F.floor(F.col("doc_id") / EDGE_BLOCK).alias("block")).distinct()
    firsts = docs.groupBy("source", "block").agg(F.min("doc_id").alias("first"))
    after = firsts.select("source", "block", F.lead("first").over(Window.partitionBy("source").orderBy("block")).alias("next"))
    inside = F.lead("doc_id").over(Window.partitionBy("source", "block").orderBy("doc_id"))
    return docs.withColumn("inside", inside).join(after, ["source", "block"]).select(
        F.col("doc_id").alias("src"), F.coalesce("inside", "next").alias("dst"), F.lit("relates_to").alias("type")).filter("dst IS NOT NULL")


def usage_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("principal"), "event_type",
                                                 F.col("ts").cast("timestamp").alias("ts"), "value")


HEADING_SQL = r"""(SELECT CASE WHEN h IS NULL OR h = '' THEN 'untitled' WHEN length(h) > 200 THEN substr(h, 1, 199) || '…' ELSE h END
  FROM (SELECT regexp_extract({0}, '^[ \t\n\r]*([^.!?\n]*[.!?]?)', 1) AS h))"""
NODES_SQL = """nodes AS (SELECT 's1' AS space_id, doc_id AS id, lang AS type, source AS scope_id, """ + HEADING_SQL.format("text") + """ AS title,
  coalesce(text, '') AS body, n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'archived' ELSE 'active' END AS status,
  'p' || (doc_id % 5) AS author, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at FROM documents)"""
SCOPES_SQL = """scopes AS (SELECT source AS scope_id, i, 'p' || (i % 5) AS owner,
  CASE i % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'team-read' ELSE 'team-write' END AS visibility, i % 10 = 0 AS ambient, i = 19 AS archived
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS i FROM documents)),
grants AS (SELECT scope_id, 'p' || ((i + 1) % 5) AS principal, CASE WHEN i % 2 = 1 THEN 'write' ELSE 'read' END AS level FROM scopes),
principals AS (SELECT 'p' || range AS principal FROM range(5)),
readable AS (SELECT DISTINCT p.principal, s.scope_id, s.ambient FROM principals p, scopes s LEFT JOIN grants g ON g.scope_id = s.scope_id
  WHERE NOT s.archived AND (s.visibility <> 'private' OR s.owner = p.principal OR g.principal = p.principal)),
writable AS (SELECT DISTINCT p.principal, s.scope_id FROM principals p, scopes s LEFT JOIN grants g ON g.scope_id = s.scope_id
  WHERE NOT s.archived AND (s.visibility = 'team-write' OR s.owner = p.principal OR (g.principal = p.principal AND g.level = 'write')))"""
REQUESTS_SQL = """requests AS (SELECT item_id AS request_id, text AS query, 'p' || (item_id % 5) AS principal,
  CASE WHEN item_id % 3 = 0 THEN 'all' ELSE 'src' || (item_id % 20) END AS scope FROM benchmark),
scope_sets AS (SELECT DISTINCT r.request_id, v.scope_id FROM requests r JOIN readable v ON v.principal = r.principal
  WHERE r.scope = 'all' OR v.ambient OR v.scope_id = r.scope)"""
BUSINESS_SQL = """edges AS (SELECT DISTINCT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'placed_by' AS type FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'contains' FROM lineitem
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'supplied_by' FROM lineitem
  UNION ALL SELECT DISTINCT 'c:' || c_custkey, 'n:' || c_nationkey, 'located_in' FROM customer)"""
DOC_EDGES_SQL = """doc_edges AS (SELECT a.doc_id AS src, b.doc_id AS dst, 'relates_to' AS type
  FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM (SELECT DISTINCT source, doc_id FROM documents WHERE source IS NOT NULL)) a
  JOIN (SELECT DISTINCT doc_id FROM documents) b ON b.doc_id = a.next)"""
USAGE_SQL = "usage AS (SELECT event_id, 'u' || user_id AS principal, event_type, ts, value FROM events)"
