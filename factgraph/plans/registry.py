"""Registered queries of the fact graph and the SQL that checks them."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as X
from factgraph.operators import dense as N
from factgraph.operators import evaluation as E
from factgraph.operators import graph as G
from factgraph.operators import maintenance as M
from factgraph.operators import retrieval as R
from factgraph.operators import visibility as V
from factgraph.operators import writes as D
from factgraph.runtime import materialize, table
from factgraph.sources import derived as S

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + sql.strip() if not sql.lstrip().startswith(("SELECT", "WITH")) else sql.strip()
        return f
    return register


def access(spark, sf_dir):
    scopes = S.scopes(spark, sf_dir)
    grants, people = S.grants(scopes), S.principals(spark)
    return scopes, V.readable(scopes, grants, people), V.writable(scopes, grants, people)


@query(f"{S.NODES_SQL} SELECT id, type, scope_id, title, n_chars, status, author FROM nodes WHERE status = 'active' AND type IN ('en', 'fr')")
def node_envelope(spark, sf_dir):
    return S.nodes(spark, sf_dir).filter("status = 'active' AND type IN ('en', 'fr')").select(
        "id", "type", "scope_id", "title", "n_chars", "status", "author")


@query(f"{S.SCOPES_SQL} SELECT principal, scope_id FROM readable")
def readable_scopes(spark, sf_dir):
    return access(spark, sf_dir)[1].select("principal", "scope_id")


@query(f"{S.SCOPES_SQL} SELECT principal, scope_id FROM writable")
def writable_scopes(spark, sf_dir):
    return access(spark, sf_dir)[2]


@query(f"{S.NODES_SQL}, {S.SCOPES_SQL} SELECT principal, id, status FROM nodes JOIN readable USING (scope_id)")
def visible_nodes(spark, sf_dir):
    return V.visible_nodes(S.nodes(spark, sf_dir), access(spark, sf_dir)[1]).select("principal", "id", "status")


@query(f"{S.NODES_SQL}, {S.SCOPES_SQL}, {S.DOC_EDGES_SQL} SELECT e.src, e.dst, e.type FROM doc_edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst "
       "WHERE a.scope_id IN (SELECT scope_id FROM readable WHERE principal = 'p1') AND b.scope_id IN (SELECT scope_id FROM readable WHERE principal = 'p1')")
def visible_edges(spark, sf_dir):
    mine = access(spark, sf_dir)[1].filter("principal = 'p1'")
    return V.visible_edges(S.document_edges(spark, sf_dir), V.visible_nodes(S.nodes(spark, sf_dir), mine))


@query(f"{S.NODES_SQL}, {S.SCOPES_SQL}, {S.DOC_EDGES_SQL} SELECT ra.principal, e.src, e.dst, e.type FROM doc_edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst "
       "JOIN readable ra ON ra.scope_id = a.scope_id JOIN readable rb ON rb.scope_id = b.scope_id AND rb.principal = ra.principal "
       "WHERE EXISTS (SELECT 1 FROM writable w WHERE w.principal = ra.principal AND w.scope_id IN (a.scope_id, b.scope_id))")
def edge_write_permission(spark, sf_dir):
    _, readable, writable = access(spark, sf_dir)
    return V.edge_permission(S.document_edges(spark, sf_dir), S.nodes(spark, sf_dir), readable, writable)


@query(f"{S.SCOPES_SQL}, {S.REQUESTS_SQL} SELECT request_id, scope_id FROM scope_sets")
def scope_sets(spark, sf_dir):
    return V.scope_sets(S.requests(spark, sf_dir), access(spark, sf_dir)[1])


@query(f"{S.SCOPES_SQL}, {S.REQUESTS_SQL} SELECT request_id, scope = 'all' AND principal = 'p3' AS refused FROM requests")
def scope_all_refusal(spark, sf_dir):
    good, bad = V.refused_all(S.requests(spark, sf_dir), "principal = 'p3'")
    return good.select("request_id", F.lit(False).alias("refused")).union(bad.select("request_id", F.lit(True)))


@query(f"{S.NODES_SQL} SELECT id FROM nodes WHERE status = 'active' AND n_chars >= 1000 AND created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 31 DAY")
def section_filter(spark, sf_dir):
    recent = F.col("created_at") >= F.expr(f"timestamp'{S.AS_OF}' - INTERVAL '31' DAY")
    return S.nodes(spark, sf_dir).filter((F.col("status") == "active") & (F.col("n_chars") >= 1000) & recent).select("id")


@query(f"{S.NODES_SQL} SELECT id, title || ' — ' || rtrim(substr(body, 1, 280), ' ') || CASE WHEN length(body) > 280 THEN '…' ELSE '' END AS preview FROM nodes")
def pending_preview(spark, sf_dir):
    return S.nodes(spark, sf_dir).select("id", X.preview(F.col("title"), F.col("body")).alias("preview"))


@query(f"{S.NODES_SQL}, {S.SCOPES_SQL}, {S.REQUESTS_SQL}, asked AS (SELECT request_id, principal, request_id * 7 + k AS id FROM requests, range(30) t(k)), "
       "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY id) AS rn FROM asked) WHERE rn <= 25) "
       "SELECT request_id, k.id, n.id IS NOT NULL AS found FROM kept k LEFT JOIN (SELECT id, principal FROM nodes JOIN readable USING (scope_id)) n ON n.id = k.id AND n.principal = k.principal")
def point_lookup(spark, sf_dir):
    asked = S.requests(spark, sf_dir).select("request_id", "principal", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k")).select(
        "request_id", "principal", (F.col("request_id") * 7 + F.col("k")).alias("id"))
    kept = asked.withColumn("rn", F.row_number().over(Window.partitionBy("request_id").orderBy("id"))).filter("rn <= 25")
    seen = V.visible_nodes(S.nodes(spark, sf_dir), access(spark, sf_dir)[1]).select("id", "principal", F.lit(True).alias("found"))
    return kept.join(seen, ["id", "principal"], "left").select("request_id", "id", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"{S.BUSINESS_SQL}, both_ways AS (SELECT src AS id, 'out' AS direction, type, dst AS peer FROM edges UNION ALL SELECT dst, 'in', type, src FROM edges) "
       "SELECT id, direction, type, peer FROM (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY peer, type) AS rn FROM both_ways) WHERE rn <= 10")
def edge_summaries(spark, sf_dir):
    return G.summaries(S.business_edges(spark, sf_dir), 10)


@query(f"{S.BUSINESS_SQL} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def edge_degree(spark, sf_dir):
    return G.degrees(S.business_edges(spark, sf_dir))


@query(f"{S.BUSINESS_SQL}, rules(type, a, b) AS (VALUES ('placed_by', 'o', 'c'), ('contains', 'o', 'p'), ('supplied_by', 'p', 's')) "
       "SELECT src, dst, e.type AS type, 'no rule' AS reason FROM edges e LEFT JOIN rules r ON r.type = e.type AND r.a = split_part(src, ':', 1) AND r.b = split_part(dst, ':', 1) WHERE r.type IS NULL")
def edge_rule_check(spark, sf_dir):
    edges = S.business_edges(spark, sf_dir)
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    rules = spark.sql("SELECT * FROM VALUES ('placed_by', 'o', 'c'), ('contains', 'o', 'p'), ('supplied_by', 'p', 's') AS t(type, src_type, dst_type)")
    return M.edge_violations(edges, ids.select("id", F.substring_index("id", ":", 1).alias("type")), rules)


def walk_sql(starts, edges, either, depth, limit, direction="out"):
    """CTEs of a bounded walk: moves, w1 to w<depth>, walked. `starts` and `edges` name CTEs, `either` lists types that go both ways."""
    back = "true" if direction == "both" else f"type IN ({', '.join(map(repr, either))})"
    levels = [f"moves AS (SELECT src AS a, dst AS b, src, dst, type FROM {edges} UNION ALL SELECT dst, src, src, dst, type FROM {edges} WHERE {back})",
              f"w1 AS (SELECT start, 1 AS depth, src, dst, type, b AS node, [start, b] AS path FROM {starts} JOIN moves ON a = start WHERE b <> start)"]
    levels += [f"w{k} AS (SELECT start, {k} AS depth, m.src, m.dst, m.type, m.b AS node, list_append(path, m.b) AS path FROM w{k - 1} JOIN moves m ON m.a = node WHERE NOT list_contains(path, m.b))"
               for k in range(2, depth + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, depth + 1))
    return ", ".join(levels) + (f", walked AS (SELECT start, depth, src, dst, type, node, rn, n > {limit} AS more FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, src, dst, type, "
                                f"array_to_string(path, '>')) AS rn, count(*) OVER (PARTITION BY start) AS n FROM ({union})) WHERE rn <= {limit})")


@query(f"{S.BUSINESS_SQL}, starts AS (SELECT 'c:' || c_custkey AS start FROM customer), {walk_sql('starts', 'edges', ('located_in',), 4, 50)} "
       "SELECT start, depth, src, dst, type, node, rn, more FROM walked")
def bounded_walk(spark, sf_dir):
    starts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("start"))
    return G.walk(starts, G.steps(S.business_edges(spark, sf_dir), "out", ("located_in",)), 4, 50)


@query(f"{S.BUSINESS_SQL}, m AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT 's:' || s_suppkey AS node FROM supplier WHERE s_suppkey % 10 = 0), "
       "h1 AS (SELECT DISTINCT b AS node FROM h0 JOIN m ON a = node), h2 AS (SELECT DISTINCT b AS node FROM h1 JOIN m ON a = node) "
       "SELECT node, min(hops) AS hops FROM (SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node")
def min_hop_distance(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 0").select(F.concat(F.lit("s:"), "s_suppkey").alias("node"))
    return G.min_hops(seeds, S.business_edges(spark, sf_dir, once=False), 2, lambda node: F.substring_index(node, ":", 1))


@query("SELECT doc_id AS id, doc_id - doc_id % 7 AS root, CAST(doc_id % 7 AS INT) AS hops FROM documents")
def canonical_resolution(spark, sf_dir):
    links = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") - 1).alias("parent"))
    return G.canonical(links)


TOKENS_SQL = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
LEGS_SQL = f"""{S.NODES_SQL}, {S.SCOPES_SQL}, {S.REQUESTS_SQL}, live AS (SELECT id, scope_id, created_at, {TOKENS_SQL.format("title || chr(10) || body")} AS toks FROM nodes WHERE status = 'active'),
qs AS (SELECT request_id, {TOKENS_SQL.format("query")} AS toks FROM requests),
nv AS (SELECT id, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 4096 AS dim, count(*) AS w FROM (SELECT id, unnest(toks) AS t FROM live) GROUP BY ALL),
qv AS (SELECT request_id, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 4096 AS dim, count(*) AS w FROM (SELECT request_id, unnest(toks) AS t FROM qs) GROUP BY ALL),
nn AS (SELECT id, sum(w * w) AS nn FROM nv GROUP BY id), qn AS (SELECT request_id, sum(w * w) AS qn FROM qv GROUP BY request_id),
dots AS (SELECT request_id, id, sum(nv.w * qv.w) AS dot FROM nv JOIN qv USING (dim) GROUP BY request_id, id),
vec AS (SELECT request_id, id, CAST(dot AS DOUBLE) / sqrt(CAST(nn * qn AS DOUBLE)) AS similarity FROM dots JOIN nn USING (id) JOIN qn USING (request_id)
  JOIN live USING (id) JOIN scope_sets USING (request_id, scope_id)),
vleg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, id) AS rank FROM vec) WHERE rank <= 30),
terms AS (SELECT request_id, unnest(list_distinct(toks)) AS token FROM qs), need AS (SELECT request_id, count(*) AS n FROM terms GROUP BY request_id),
hit AS (SELECT request_id, id, count(*) AS hits FROM (SELECT id, unnest(list_distinct(toks)) AS token FROM live) JOIN terms USING (token) GROUP BY request_id, id),
lex AS (SELECT request_id, id, hits FROM hit JOIN need USING (request_id) JOIN live USING (id) JOIN scope_sets USING (request_id, scope_id) WHERE hits >= n * 0.5),
lleg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hits DESC, id) AS rank FROM lex) WHERE rank <= 30),
fuse AS (SELECT request_id, id, coalesce(1e0 / (60 + v.rank), 0e0) + coalesce(1e0 / (60 + l.rank), 0e0) AS raw FROM vleg v FULL JOIN lleg l USING (request_id, id)),
placed AS (SELECT request_id, id, round(raw, 6) AS score, row_number() OVER (PARTITION BY request_id ORDER BY raw DESC, created_at DESC, id) AS place FROM fuse JOIN live USING (id))"""


def legs(spark, sf_dir):
    nodes, requests = S.nodes(spark, sf_dir), S.requests(spark, sf_dir)
    sets = V.scope_sets(requests, access(spark, sf_dir)[1])
    return nodes, R.vector_leg(requests, nodes, sets), R.lexical_leg(requests, nodes, sets)


@query(f"{LEGS_SQL} SELECT request_id, id, similarity, rank FROM vleg")
def vector_leg(spark, sf_dir):
    return legs(spark, sf_dir)[1]


@query(f"{LEGS_SQL} SELECT request_id, id, hits, rank FROM lleg")
def lexical_leg(spark, sf_dir):
    return legs(spark, sf_dir)[2]


@query(f"{LEGS_SQL} SELECT request_id, id, score, place, count(*) OVER (PARTITION BY request_id) > 10 AS truncated FROM placed QUALIFY place <= 10")
def search_batch(spark, sf_dir):
    nodes, vector, lexical = legs(spark, sf_dir)
    return R.limited(R.fused(vector, lexical, nodes), 10)


NEAR_SQL = """nodes_near AS (SELECT DISTINCT x.request_id, x.id AS a, y.id AS b FROM placed x JOIN placed y ON y.request_id = x.request_id AND x.id <> y.id),
near AS (SELECT a, b FROM (SELECT a, b, CAST(sum(x.w * y.w) AS DOUBLE) / sqrt(CAST(any_value(p.nn) * any_value(q.nn) AS DOUBLE)) AS similarity FROM (SELECT DISTINCT a, b FROM nodes_near) m
  JOIN nv x ON x.id = a JOIN nv y ON y.id = b AND y.dim = x.dim JOIN nn p ON p.id = a JOIN nn q ON q.id = b GROUP BY a, b) WHERE similarity >= 0.9),
told AS (SELECT src AS a, dst AS b FROM doc_edges UNION SELECT dst, src FROM doc_edges), close AS (SELECT a AS id, list(b) AS peers FROM near ANTI JOIN told USING (a, b) GROUP BY a),
lined AS MATERIALIZED (SELECT request_id, p.id, place, coalesce(peers, CAST([] AS BIGINT[])) AS peers FROM placed p LEFT JOIN close c ON c.id = p.id),
kept(request_id, place, ids) AS (SELECT request_id, 0, CAST([] AS BIGINT[]) FROM (SELECT DISTINCT request_id FROM placed) UNION ALL
  SELECT k.request_id, k.place + 1, CASE WHEN list_has_any(k.ids, p.peers) THEN k.ids ELSE list_append(k.ids, p.id) END
  FROM kept k JOIN lined p ON p.request_id = k.request_id AND p.place = k.place + 1),
final AS (SELECT request_id, ids FROM kept QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY place DESC) = 1),
alone AS (SELECT request_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM final)"""
SEARCH_SQL = LEGS_SQL + f", {S.DOC_EDGES_SQL}, {NEAR_SQL}"


def searched(spark, sf_dir):
    """Nodes and all collapsed results, best first."""
    nodes, vector, lexical = legs(spark, sf_dir)
    found = materialize(R.fused(vector, lexical, nodes), "fused")
    pairs = R.undeclared(R.pairs_in_results(found, nodes, 0.9), S.document_edges(spark, sf_dir))
    return nodes, R.collapsed(found, pairs)


@query(f"RECURSIVE {SEARCH_SQL} SELECT request_id, id, score, CAST(a.place AS INT) AS place, count(*) OVER (PARTITION BY request_id) > 10 AS truncated FROM alone a JOIN placed USING (request_id, id) QUALIFY a.place <= 10")
def search_collapsed(spark, sf_dir):
    return R.limited(searched(spark, sf_dir)[1], 10)


@query(f"RECURSIVE {SEARCH_SQL}, deg AS (SELECT r.principal, e.id, count(*) AS n FROM (SELECT src AS id, dst AS other FROM doc_edges UNION ALL SELECT dst, src FROM doc_edges) e "
       "JOIN nodes x ON x.id = e.id JOIN nodes y ON y.id = e.other JOIN readable r ON r.scope_id = x.scope_id JOIN readable v ON v.scope_id = y.scope_id AND v.principal = r.principal GROUP BY ALL) "
       "SELECT request_id, a.id, p.score, CAST(a.place AS INT) AS place, t.truncated, n.type, n.scope_id AS scope, n.title, n.status, n.author, coalesce(d.n, 0) AS edge_count FROM alone a JOIN placed p USING (request_id, id) "
       "JOIN requests q USING (request_id) JOIN nodes n ON n.id = a.id LEFT JOIN deg d ON d.id = a.id AND d.principal = q.principal "
       "JOIN (SELECT request_id, count(*) > 10 AS truncated FROM alone GROUP BY request_id) t USING (request_id) WHERE a.place <= 10 AND NOT (q.scope = 'all' AND q.principal = 'p3')")
def search_enveloped(spark, sf_dir):
    nodes, found = searched(spark, sf_dir)
    asked, _ = V.refused_all(S.requests(spark, sf_dir), "principal = 'p3'")
    edges, may = S.document_edges(spark, sf_dir), access(spark, sf_dir)[1]
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    scopes = nodes.select("id", "scope_id")
    seen = ends.join(scopes, "id").join(scopes.withColumnsRenamed({"id": "other", "scope_id": "there"}), "other")
    both = seen.join(may.select("principal", "scope_id"), "scope_id").join(
        may.select("principal", F.col("scope_id").alias("there")), ["principal", "there"], "left_semi")
    degree = both.groupBy("principal", "id").agg(F.count("*").alias("edge_count"))
    rows = R.limited(found, 10).join(asked.select("request_id", "principal"), "request_id").join(nodes, "id").join(degree, ["principal", "id"], "left")
    return rows.select("request_id", "id", "score", "place", "truncated", "type", F.col("scope_id").alias("scope"), "title", "status", "author",
                       F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


VECTORS_SQL = f"""{S.NODES_SQL}, toks AS (SELECT id, type, unnest({TOKENS_SQL.format("title || chr(10) || body")}) AS t FROM nodes),
v AS (SELECT id, type, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 4096 AS dim, count(*) AS w FROM toks GROUP BY ALL), nn AS (SELECT id, sum(w * w) AS nn FROM v GROUP BY id)"""
PAIRS_SQL = f"""{VECTORS_SQL}, pairs AS (SELECT a, b, similarity FROM (SELECT x.id AS a, y.id AS b, CAST(sum(x.w * y.w) AS DOUBLE) / sqrt(CAST(any_value(p.nn) * any_value(q.nn) AS DOUBLE)) AS similarity
  FROM v x JOIN v y ON x.dim = y.dim AND x.type = y.type AND x.id < y.id JOIN nn p ON p.id = x.id JOIN nn q ON q.id = y.id GROUP BY x.id, y.id) WHERE similarity >= 0.9),
reps AS (SELECT id, min(id) OVER (PARTITION BY type, title, body) AS rep FROM nodes)"""
BANDS_SQL = f"""{PAIRS_SQL}, {S.SCOPES_SQL}, sets AS (SELECT id AS seq, scope_id FROM nodes WHERE id % 2 = 1 UNION SELECT n.id, r.scope_id FROM nodes n JOIN readable r ON r.principal = n.author AND r.ambient WHERE n.id % 2 = 1),
near AS (SELECT p.seq, candidate, similarity, row_number() OVER (PARTITION BY p.seq ORDER BY similarity DESC, candidate) AS rank FROM (SELECT a AS seq, b AS candidate, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs) p
  JOIN nodes s ON s.id = candidate AND s.status = 'active' AND s.id % 2 = 0 JOIN sets ON sets.seq = p.seq AND sets.scope_id = s.scope_id WHERE p.seq % 2 = 1),
bands AS (SELECT id AS seq, candidate, similarity, CASE WHEN similarity >= 0.97 THEN 'merge' WHEN similarity >= 0.9 THEN 'pending' ELSE 'insert' END AS band
  FROM (SELECT id FROM nodes WHERE id % 2 = 1) LEFT JOIN (SELECT * FROM near WHERE rank = 1) ON seq = id)"""


def incoming(spark, sf_dir):
    """(writes, store, candidates): facts of odd id written to those of even id, each in the writer's scopes."""
    nodes = S.nodes(spark, sf_dir)
    writes, store = nodes.filter("id % 2 = 1"), nodes.filter("id % 2 = 0")
    ambient = access(spark, sf_dir)[1].filter("ambient").select(F.col("principal").alias("author"), "scope_id")
    sets = writes.select(F.col("id").alias("seq"), "scope_id").union(
        writes.select(F.col("id").alias("seq"), "author").join(ambient, "author").select("seq", "scope_id")).distinct()
    return writes, store, materialize(D.candidates(writes, store, sets, 0.9), "candidates")


@query(f"{PAIRS_SQL} SELECT 'pair' AS kind, a, b, similarity FROM pairs WHERE a IN (SELECT rep FROM reps) AND b IN (SELECT rep FROM reps) UNION ALL SELECT 'copy', rep, id, 1e0 FROM reps WHERE id <> rep")
def similarity_join(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir)
    members = materialize(R.text_classes(nodes), "members")
    pairs = R.near_pairs(nodes.join(members.filter("id = rep").select("id"), "id", "left_semi"), 0.9)
    return pairs.select(F.lit("pair").alias("kind"), "a", "b", "similarity").union(
        members.filter("id <> rep").select(F.lit("copy"), "rep", "id", F.lit(1.0)))


@query(f"{BANDS_SQL} SELECT seq, candidate, similarity, band FROM bands")
def band_writes(spark, sf_dir):
    writes, _, near = incoming(spark, sf_dir)
    return D.banded(writes, near, 0.9, 0.97)


OUTCOMES_SQL = f"""{BANDS_SQL}, {S.DOC_EDGES_SQL}, words AS (SELECT id, unnest(list_distinct({TOKENS_SQL.format("body")})) AS token FROM nodes),
merges AS (SELECT seq, candidate FROM bands WHERE band = 'merge'), cluster AS (SELECT candidate, candidate AS peer FROM merges UNION SELECT src, dst FROM doc_edges UNION SELECT dst, src FROM doc_edges),
corpus AS (SELECT DISTINCT candidate, token FROM cluster JOIN words ON id = peer WHERE peer % 2 = 0), counts AS (SELECT m.seq, (SELECT count(*) FROM words w WHERE w.id = m.seq) AS n,
  (SELECT count(*) FROM corpus c WHERE c.candidate = m.candidate) AS size, (SELECT count(*) FROM words w JOIN corpus c USING (token) WHERE w.id = m.seq AND c.candidate = m.candidate) AS shared FROM merges m),
outcomes AS (SELECT b.seq, candidate, similarity, CASE WHEN band <> 'merge' THEN band WHEN n + size > 0 AND shared / (n + size - shared) < 0.8 THEN 'merge_linked' ELSE 'merged' END AS outcome FROM bands b LEFT JOIN counts USING (seq))"""


def outcomes(spark, sf_dir):
    writes, store, near = incoming(spark, sf_dir)
    edges = S.document_edges(spark, sf_dir)
    peers = edges.select(F.col("src").alias("id"), F.col("dst").alias("peer")).union(edges.select("dst", "src"))
    return writes, store, D.with_novelty(D.banded(writes, near, 0.9, 0.97), writes, store, peers)


@query(f"{OUTCOMES_SQL} SELECT seq, candidate, similarity, outcome FROM outcomes")
def band_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir)[2]


@query(f"{OUTCOMES_SQL}, o AS (SELECT outcomes.*, n.type, CASE WHEN seq % 3 = 0 THEN '2024' END AS happened_at FROM outcomes JOIN nodes n ON n.id = seq) SELECT 'rows' AS output, count(*) AS n FROM o WHERE outcome IN ('insert', 'merge_linked') "
       "UNION ALL SELECT 'edges', count(*) FROM o WHERE outcome = 'merge_linked' AND type IN ('en', 'de', 'error') UNION ALL SELECT 'addenda', count(*) FROM o WHERE outcome = 'merged' AND type = 'error' AND happened_at IS NOT NULL "
       "UNION ALL SELECT 'parked', count(*) FROM o WHERE outcome = 'pending' UNION ALL SELECT 'log', count(*) FROM o")
def write_effects(spark, sf_dir):
    writes, _, ends = outcomes(spark, sf_dir)
    writes = writes.withColumn("happened_at", F.when(F.col("id") % 3 == 0, "2024"))
    made = D.effects(materialize(ends, "outcomes"), writes, spark.sql("SELECT * FROM VALUES ('en'), ('de'), ('error') AS t(type)"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("output"), "n") for k, df in made.items()]
    return reduce(DataFrame.union, parts)


@query()
def sequential_writes(spark, sf_dir):
    """Facts of odd id written one after another to those of even id."""
    nodes = S.nodes(spark, sf_dir)
    edges = S.document_edges(spark, sf_dir)
    peers = edges.select(F.col("src").alias("id"), F.col("dst").alias("peer")).union(edges.select("dst", "src"))
    return D.sequential(nodes.filter("id % 2 = 1"), nodes.filter("id % 2 = 0"), peers, 0.9, 0.97)


@query(f"RECURSIVE {PAIRS_SQL}, e AS (SELECT a, b FROM pairs WHERE similarity >= 0.95 UNION SELECT b, a FROM pairs WHERE similarity >= 0.95), "
       "reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other) SELECT id, min(other) AS component FROM reach GROUP BY id")
def similarity_components(spark, sf_dir):
    return D.clusters(S.nodes(spark, sf_dir), 0.95)


@query(f"{S.USAGE_SQL}, m(kind, metric) AS (VALUES ('signup', 'facts_stored'), ('click', 'duplicates_prevented'), ('view', 'questions_asked'), ('view', 'answered'), ('error', 'questions_asked'), ('purchase', 'promotes')) "
       "SELECT principal, metric, CAST(ts AS DATE) AS day, count(*) AS n FROM usage JOIN m ON kind = event_type GROUP BY ALL")
def usage_rollup(spark, sf_dir):
    return E.usage_rollup(S.usage_events(spark, sf_dir))


@query("SELECT CAST(d AS DATE) AS day, " + ", ".join(
    f"(SELECT count(*) FROM events WHERE CAST(ts AS DATE) = CAST(d AS DATE) AND event_type IN ({', '.join(repr(k) for k, v in E.METRIC_OF.items() if m in v)})) AS {m}" for m in E.METRICS)
    + " FROM generate_series((SELECT CAST(max(ts) AS DATE) FROM events) - 13, (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY) t(d)")
def stats_series(spark, sf_dir):
    events = S.usage_events(spark, sf_dir)
    return E.stats_series(E.usage_rollup(events), events.agg(F.max(F.to_date("ts"))).first()[0], 14)


@query("SELECT event_type, p50, p95 FROM (SELECT event_type, max(CASE WHEN rn = greatest(1, least(n, CAST(round_even(50 * n / 100.0 + 0.5, 0) AS BIGINT))) THEN value END) AS p50, "
       "max(CASE WHEN rn = greatest(1, least(n, CAST(round_even(95 * n / 100.0 + 0.5, 0) AS BIGINT))) THEN value END) AS p95 FROM "
       "(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type)")
def nearest_rank_percentiles(spark, sf_dir):
    return E.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", (50, 95))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id)) AS turn FROM documents) ORDER BY turn, lang LIMIT 100")
def stratified_sample(spark, sf_dir):
    return E.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", "7", 100).select("doc_id", "lang")


@query("WITH per AS (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, total, CAST(unnest(range(0, 1 + greatest(0, CAST(ceil((total - 4) / 3.0) AS BIGINT)))) AS INT) AS win FROM per) "
       "SELECT conv_id, win AS \"window\", CAST(win * 3 + 1 AS BIGINT) AS first, least(total, win * 3 + 4) AS last, least(total, win * 3 + 4) - win * 3 AS n FROM w")
def turn_windows(spark, sf_dir):
    return E.turn_windows(table(spark, sf_dir, "conversations"), 4, 1)


ANSWERS_SQL = "answers AS (SELECT d.doc_id, 'arm' || (d.doc_id % 2) AS arm, lang AS category, quality AS correct, toxic AS abstained FROM documents d JOIN labels l USING (doc_id))"


def answers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.concat(F.lit("arm"), F.col("doc_id") % 2).alias("arm"), F.col("lang").alias("category"),
        F.col("quality").cast("long").alias("correct"), F.col("toxic").cast("long").alias("abstained"))


@query(f"{ANSWERS_SQL}, g AS (SELECT arm, category, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(abstained) AS BIGINT) AS abstained FROM answers GROUP BY ALL), "
       "p AS (SELECT *, CAST(correct AS DOUBLE) / n AS p, 1.96::DOUBLE AS z FROM g) SELECT arm, category, n, correct, round(p, 4) AS accuracy, "
       "round(greatest(0e0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, "
       "round(least(1e0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high, abstained FROM p")
def accuracy_buckets(spark, sf_dir):
    return E.accuracy(answers(spark, sf_dir), ["arm", "category"])


@query("SELECT doc_id, source, doc_id > min(doc_id) OVER (PARTITION BY source) AS opportunity FROM documents")
def first_seen(spark, sf_dir):
    return E.first_seen(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query(f"{LEGS_SQL}, ev AS (SELECT item_id AS request_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), "
       "best AS (SELECT request_id, min(place) AS best FROM placed JOIN ev USING (request_id, id) GROUP BY request_id) "
       "SELECT k, count(*) AS questions, CAST(sum(CASE WHEN best <= k THEN 1 ELSE 0 END) AS BIGINT) AS recalled FROM (SELECT DISTINCT request_id FROM ev) LEFT JOIN best USING (request_id), (VALUES (1), (5), (10), (30)) t(k) GROUP BY k")
def recall_at_k(spark, sf_dir):
    nodes, vector, lexical = legs(spark, sf_dir)
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    evidence = E.evidence_of(bench.select(F.col("item_id").alias("request_id"), F.col("text").alias("q")), docs.select(F.col("doc_id").alias("id"), "text"))
    return E.recall_at(R.fused(vector, lexical, nodes), evidence, (1, 5, 10, 30))


@query(f"{S.NODES_SQL} SELECT CAST(id AS VARCHAR) AS id, rule FROM (SELECT id, unnest([CASE WHEN length(title) BETWEEN 3 AND 200 THEN NULL ELSE 'title_length' END, "
       "CASE WHEN length(body) BETWEEN 1 AND 8000 THEN NULL ELSE 'body_length' END, CASE WHEN n_chars <= 8000 THEN NULL ELSE 'long_text' END]) AS rule FROM nodes) WHERE rule IS NOT NULL")
def constraint_audit(spark, sf_dir):
    return M.violations(S.nodes(spark, sf_dir), "id", {
        "title_length": "length(title) BETWEEN 3 AND 200", "body_length": "length(body) BETWEEN 1 AND 8000", "long_text": "n_chars <= 8000"})


@query("WITH a AS (SELECT event_id AS id, regexp_extract(props, '\"k\": *([^,}]*)', 1) AS k, event_type FROM events) SELECT id, errors FROM (SELECT id, "
       "CASE WHEN event_type IN ('click', 'view') THEN '' ELSE 'bad event_type' END || CASE WHEN event_type NOT IN ('click', 'view') AND NOT regexp_full_match(k, '[0-4]?[0-9]') THEN ',' ELSE '' END "
       "|| CASE WHEN regexp_full_match(k, '[0-4]?[0-9]') THEN '' ELSE 'bad k' END AS errors FROM a) WHERE errors <> ''")
def conformance_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    attrs = events.select(F.col("event_id").alias("id"), F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit("event_type"), F.col("event_type"))).alias("attrs"))
    found = M.conformance(attrs, ["event_type"], {"event_type": "click|view", "k": "[0-4]?[0-9]"})
    return found.select("id", F.array_join("errors", ",").alias("errors")).filter("errors <> ''")


@query(f"{S.NODES_SQL} SELECT x.id, min(y.id) AS match FROM nodes x JOIN nodes y ON x.title = y.title AND x.body = y.body AND x.type = y.type AND y.id % 2 = 0 WHERE x.id % 2 = 1 GROUP BY x.id")
def content_match(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir)
    return M.content_matches(nodes.filter("id % 2 = 1"), nodes.filter("id % 2 = 0"), ["type", "title", "body"])


@query("WITH a AS (SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0) "
       "SELECT doc_id, CASE WHEN b.lang IS NULL THEN 'missing' WHEN a.lang IS NULL THEN 'extra' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id) WHERE a.lang IS DISTINCT FROM b.lang")
def registry_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    new = docs.filter("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return M.drift(docs.filter("doc_id % 10 <> 0"), new, ["doc_id"], ["lang"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_snapshot(spark, sf_dir):
    return M.latest(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id "
       "WHERE a.vec_id % 20 = 0 AND list_dot_product(a.e, b.e) >= 0.3")
def dense_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    a = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("ea"))
    b = rows.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("eb"))
    return a.join(b, "label").filter("a <> b").filter(X.cosine(F.col("ea"), F.col("eb")) >= 0.3).select("a", "b")


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 4) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id "
       "WHERE list_cosine_similarity(a.e, b.e) >= 0.3")
def dense_pairs(spark, sf_dir):
    """All pairs of one label in reach, by blocked matrix products."""
    found = N.dense_pairs(table(spark, sf_dir, "embeddings"), 0.3, "label", "vec_id", "embedding")
    return found.select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS request_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS similarity FROM v a, v b WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.e, b.e) >= 0.1), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT request_id, id, round(similarity, 4) AS similarity, rank FROM r WHERE rank <= 10")
def dense_leg(spark, sf_dir):
    """The ten nearest of all vectors to every vector whose id 20 divides."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = N.dense_top(rows.filter("id % 20 = 0").withColumnRenamed("id", "request_id"), rows, 10, 0.1)
    return found.select("request_id", "id", F.round("similarity", 4).alias("similarity"), "rank")


@query("SELECT url_id AS id, slug FROM (SELECT page_id AS url_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63) AS slug FROM pages)")
def slug_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), X.slug(F.col("url")).alias("slug"))


@query(f"SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 1e0 ELSE CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))) END, 6) AS jaccard "
       f"FROM (SELECT doc_id, list_distinct({TOKENS_SQL.format('text')}) AS ta FROM documents) a JOIN (SELECT doc_id, list_distinct({TOKENS_SQL.format('text')}) AS tb FROM documents) b ON b.doc_id = a.doc_id + 1")
def jaccard_neighbours(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    after = t.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    return t.withColumnRenamed("doc_id", "a").join(after, "a").select("a", "b", F.round(X.jaccard(F.col("t"), F.col("tb")), 6).alias("jaccard"))
