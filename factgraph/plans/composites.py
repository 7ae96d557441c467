"""Registered queries of walks over documents, composites, imports, health and audits, and the SQL that checks them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factgraph.functions import text as X
from factgraph.operators import graph as G
from factgraph.operators import lexical as W
from factgraph.operators import maintenance as M
from factgraph.operators import retrieval as R
from factgraph.operators import transfer as T
from factgraph.operators import visibility as V
from factgraph.operators import writes as D
from factgraph.plans.registry import BANDS_SQL, LEGS_SQL, OUTCOMES_SQL, VECTORS_SQL, access, legs, outcomes, query, walk_sql
from factgraph.runtime import materialize, table
from factgraph.sources import derived as S

#: Documents of which some are merged into the document two before.
CHAIN_SQL = "linked AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 IN (2, 3) AND doc_id >= 7 THEN doc_id - 2 END AS canonical FROM documents), roots AS (SELECT id, CASE WHEN id % 7 = 3 AND id >= 7 THEN id - id % 7 + 1 WHEN id % 7 = 2 AND id >= 7 THEN id - id % 7 ELSE id END AS root FROM linked)"


def linked_nodes(spark, sf_dir):
    n = F.col("id") % 7
    return S.nodes(spark, sf_dir).withColumn("canonical", F.when(n.isin(2, 3) & (F.col("id") >= 7), F.col("id") - 2))


def roots_of(nodes):
    return G.canonical(nodes.select("id", F.col("canonical").alias("parent"))).select("id", "root")


WALK_SQL = f"{S.NODES_SQL}, {S.DOC_EDGES_SQL}, {CHAIN_SQL}, starts AS (SELECT doc_id AS start FROM documents), {walk_sql('starts', 'doc_edges', (), 2, 50, 'both')}"


@query(f"{WALK_SQL}, reached AS (SELECT start, node AS raw, min(depth) AS depth FROM walked GROUP BY ALL UNION ALL SELECT start, start, 0 FROM starts), "
       "named AS (SELECT start, depth, raw, CASE WHEN depth = 0 THEN raw ELSE root END AS id FROM reached JOIN roots ON roots.id = raw), "
       "best AS (SELECT start, id, min((depth, CASE WHEN id <> raw THEN raw ELSE -1 END)) AS x FROM named GROUP BY start, id) "
       "SELECT start, b.id, x[1] AS depth, nullif(x[2], -1) AS resolved_from FROM best b JOIN nodes n ON n.id = b.id WHERE n.status <> 'archived' OR b.id = start")
def hydrated_walk(spark, sf_dir):
    nodes = linked_nodes(spark, sf_dir)
    starts = nodes.select(F.col("id").alias("start"))
    walked = G.walk(starts, G.steps(S.document_edges(spark, sf_dir), "both"), 2, 50)
    return G.hydrated(walked, starts, nodes, roots_of(nodes))


@query("SELECT doc_id AS id, CAST(doc_id % 7 AS INT) AS hops FROM documents WHERE doc_id % 7 > 3")
def chain_report(spark, sf_dir):
    n = F.col("doc_id") % 7
    return G.long_chains(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(n != 0, F.col("doc_id") - 1).alias("parent")))


@query(f"{S.NODES_SQL}, {S.DOC_EDGES_SQL}, b AS (SELECT src AS id, 'out' AS direction, type, dst AS peer FROM doc_edges UNION ALL SELECT dst, 'in', type, src FROM doc_edges) "
       "SELECT b.id, direction, b.type, peer, title FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY direction, type, peer) <= 5) b JOIN nodes n ON n.id = peer")
def neighbour_links(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir)
    return G.neighbour_links(nodes, S.document_edges(spark, sf_dir), nodes)


@query(f"{LEGS_SQL}, {S.DOC_EDGES_SQL}, {CHAIN_SQL}, hits AS (SELECT request_id, id FROM placed WHERE place <= 10), starts AS (SELECT DISTINCT id AS start FROM hits), {walk_sql('starts', 'doc_edges', (), 2, 50, 'both')}, "
       "named AS (SELECT start, min(depth) AS depth, root AS id FROM walked JOIN roots ON roots.id = node GROUP BY start, root), r AS (SELECT request_id, named.id, min(depth) AS depth FROM hits JOIN named ON start = hits.id "
       "JOIN nodes n ON n.id = named.id WHERE n.status <> 'archived' AND named.id <> start GROUP BY ALL) SELECT request_id, id, depth FROM r ANTI JOIN hits USING (request_id, id)")
def search_then_traverse(spark, sf_dir):
    _, vector, lexical = legs(spark, sf_dir)
    nodes = linked_nodes(spark, sf_dir)
    hits = materialize(R.limited(R.fused(vector, lexical, nodes), 10).select("request_id", "id"), "hits")
    return G.beyond_hits(hits, G.steps(S.document_edges(spark, sf_dir), "both"), nodes, roots_of(nodes))


@query(f"{LEGS_SQL}, brief AS (SELECT request_id, n.id, row_number() OVER (PARTITION BY request_id ORDER BY n.created_at DESC, n.id) AS place FROM scope_sets JOIN nodes n USING (scope_id) WHERE n.status = 'active' AND n.n_chars BETWEEN 200 AND 400 QUALIFY place <= 10), "
       "rows AS (SELECT request_id, id, 0 AS s, place FROM brief UNION ALL SELECT request_id, id, 1, place FROM placed WHERE place <= 5), once AS (SELECT request_id, id, min((s, place)) AS x FROM rows GROUP BY ALL) "
       "SELECT request_id, id, CASE WHEN x[1] = 0 THEN 'briefing' ELSE 'search' END AS source, CAST(row_number() OVER (PARTITION BY request_id ORDER BY x, id) AS INT) AS place FROM once QUALIFY place <= 12")
def briefing_then_search(spark, sf_dir):
    nodes, vector, lexical = legs(spark, sf_dir)
    sets = V.scope_sets(S.requests(spark, sf_dir), access(spark, sf_dir)[1])
    short = nodes.filter("status = 'active' AND n_chars BETWEEN 200 AND 400").join(sets, "scope_id")
    order = Window.partitionBy("request_id").orderBy(F.desc("created_at"), "id")
    brief = short.withColumn("place", F.row_number().over(order)).filter("place <= 10").select("request_id", "id", "place")
    found = R.limited(R.fused(vector, lexical, nodes), 5)
    return G.combined(brief, found, 12)


@query(f"{LEGS_SQL}, {S.DOC_EDGES_SQL}, m AS (SELECT src AS a, dst AS b FROM doc_edges UNION SELECT dst, src FROM doc_edges), base AS (SELECT request_id, id, place FROM placed WHERE place <= 10), "
       "h0 AS (SELECT request_id, id FROM base WHERE place = 1), h1 AS (SELECT request_id, b AS id FROM h0 JOIN m ON a = id), h2 AS (SELECT request_id, b AS id FROM h1 JOIN m ON a = id), "
       "h AS (SELECT request_id, id, min(hops) AS hops FROM (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL) "
       "SELECT request_id, id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY hops NULLS LAST, place) AS INT) AS place FROM base LEFT JOIN h USING (request_id, id)")
def distance_rerank(spark, sf_dir):
    nodes, vector, lexical = legs(spark, sf_dir)
    base = materialize(R.limited(R.fused(vector, lexical, nodes), 10).select("request_id", "id", "place"), "base")
    moves = G.steps(S.document_edges(spark, sf_dir)).select("a", "b").distinct()
    front = base.filter("place = 1").select("request_id", "id", F.lit(0).alias("hops"))
    seen = front
    for k in (1, 2):
        front = front.join(moves, F.col("id") == F.col("a")).select("request_id", F.col("b").alias("id"), F.lit(k).alias("hops")).distinct()
        seen = seen.union(front)
    return G.by_distance(base, seen.groupBy("request_id", "id").agg(F.min("hops").alias("hops")))


@query(f"{BANDS_SQL}, reach AS (SELECT p.seq, candidate, similarity, row_number() OVER (PARTITION BY p.seq ORDER BY similarity DESC, candidate) AS rank FROM (SELECT a AS seq, b AS candidate, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs) p "
       "JOIN nodes s ON s.id = candidate AND s.status = 'active' AND s.id % 2 = 0 JOIN nodes w ON w.id = p.seq JOIN readable r ON r.principal = w.author AND r.scope_id = s.scope_id WHERE p.seq % 2 = 1) SELECT seq, candidate, similarity, rank FROM reach WHERE rank <= 3")
def resonance(spark, sf_dir):
    """The three nearest stored facts of each write in all that its author may read."""
    nodes = S.nodes(spark, sf_dir)
    may = access(spark, sf_dir)[1].select(F.col("principal").alias("author"), "scope_id")
    writes = nodes.filter("id % 2 = 1")
    sets = writes.select(F.col("id").alias("seq"), "author").join(may, "author").select("seq", "scope_id")
    return D.candidates(writes, nodes.filter("id % 2 = 0"), sets, 0.9, 3)


PLAN_SQL = "told AS (SELECT scope_id, CASE WHEN i % 4 = 0 THEN 'src1' WHEN visibility = 'private' THEN 'own-' || owner ELSE scope_id END AS target FROM scopes), plan AS (SELECT scope_id, target, CASE WHEN target NOT IN (SELECT scope_id FROM scopes WHERE i < 15) THEN 'missing' WHEN target NOT IN (SELECT scope_id FROM writable WHERE principal = 'p1') THEN 'unwritable' END AS problem FROM told)"


def planned(spark, sf_dir):
    scopes, _, writable = access(spark, sf_dir)
    told = scopes.filter("i % 4 = 0").select("scope_id", F.lit("src1").alias("target"))
    owners = scopes.filter("visibility = 'private'").select("scope_id", F.concat(F.lit("own-"), "owner").alias("target"))
    return T.scope_plan(scopes, told, owners, scopes.filter("i < 15"), writable.filter("principal = 'p1'"))


@query(f"{S.SCOPES_SQL}, {PLAN_SQL} SELECT scope_id, target, problem FROM plan")
def scope_plan(spark, sf_dir):
    return planned(spark, sf_dir)


@query(f"{S.NODES_SQL}, q AS (SELECT id AS seq, CASE id % 4 WHEN 0 THEN 'draft-' || (id - 4) WHEN 1 THEN (SELECT title FROM nodes o WHERE o.id = n.id - 1) WHEN 2 THEN CAST(id - 2 AS VARCHAR) ELSE 'nothing ' || id END AS name FROM nodes n), t AS (SELECT title AS name, min(id) AS id FROM nodes GROUP BY title) "
       "SELECT seq, q.name, coalesce(l.id, t.id, n.id) AS target, CASE WHEN l.id IS NOT NULL THEN 'local' WHEN t.id IS NOT NULL THEN 'title' WHEN n.id IS NOT NULL THEN 'id' ELSE 'unresolved' END AS how FROM q "
       "LEFT JOIN (SELECT 'draft-' || id AS name, id FROM nodes WHERE id % 8 = 0) l USING (name) LEFT JOIN t USING (name) LEFT JOIN nodes n ON CAST(n.id AS VARCHAR) = q.name")
def supersede_targets(spark, sf_dir):
    nodes, n = S.nodes(spark, sf_dir), F.col("id") % 4
    before = nodes.select((F.col("id") + 1).alias("id"), F.col("title").alias("before"))
    name = F.when(n == 0, F.concat(F.lit("draft-"), F.col("id") - 4)).when(n == 1, F.col("before")).when(n == 2, (F.col("id") - 2).cast("string")).otherwise(F.concat(F.lit("nothing "), "id"))
    named = nodes.select("id").join(before, "id", "left").select(F.col("id").alias("seq"), name.alias("name"))
    return T.supersede_targets(named, nodes.filter("id % 8 = 0").select(F.concat(F.lit("draft-"), "id").alias("name"), "id"), nodes)


REPLAY_SQL = (f"{OUTCOMES_SQL}, {PLAN_SQL}, m AS (SELECT x.id AS seq, min(y.id) AS match FROM nodes x JOIN nodes y ON x.title = y.title AND x.body = y.body AND x.type = y.type AND y.id % 2 = 0 WHERE x.id % 2 = 1 GROUP BY x.id), "
              "actions AS (SELECT w.id AS seq, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN match IS NOT NULL THEN 'reused' WHEN outcome = 'pending' THEN 'review_queued' WHEN outcome = 'insert' THEN 'inserted' ELSE outcome END AS action, match, candidate "
              "FROM nodes w LEFT JOIN plan USING (scope_id) LEFT JOIN m ON m.seq = w.id LEFT JOIN outcomes o ON o.seq = w.id WHERE w.id % 2 = 1)")


def replay(spark, sf_dir):
    writes, store, ends = outcomes(spark, sf_dir)
    matches = M.content_matches(writes, store, ["type", "title", "body"])
    return T.replayed(writes.select(F.col("id").alias("seq"), "scope_id"), matches, ends, planned(spark, sf_dir))


@query(f"{REPLAY_SQL} SELECT seq, action, CASE WHEN action = 'reused' THEN match WHEN action IN ('merged', 'merge_linked', 'review_queued') THEN candidate END AS target FROM actions")
def import_replay(spark, sf_dir):
    return replay(spark, sf_dir)


@query(f"{REPLAY_SQL} SELECT count(*) FILTER (action IN ('inserted', 'merged', 'merge_linked', 'review_queued')) AS total, " + ", ".join(
    f"count(*) FILTER (action = '{k}') AS {k}" for k in ("inserted", "merged", "merge_linked", "review_queued", "refused", "reused")) + " FROM actions")
def import_summary(spark, sf_dir):
    return T.import_summary(replay(spark, sf_dir))


STATE_SQL = f"{S.NODES_SQL}, st AS (SELECT id, type, space_id, CASE WHEN id % 9 = 1 THEN 'merged' ELSE status END AS status, CASE WHEN id % 9 = 1 AND id % 2 = 0 THEN id - 1 WHEN id % 27 = 1 THEN id + 1000000 WHEN id % 45 = 4 THEN id - 1 END AS canonical, CASE WHEN id % 10 = 0 THEN 25 ELSE 2 END AS addenda FROM nodes)"


def stated(spark, sf_dir):
    i = F.col("id")
    canonical = F.when((i % 9 == 1) & (i % 2 == 0), i - 1).when(i % 27 == 1, i + 1_000_000).when(i % 45 == 4, i - 1)
    notes = F.to_json(F.array_repeat(F.lit("x"), F.when(i % 10 == 0, 25).otherwise(2).cast("int")))
    return S.nodes(spark, sf_dir).select("id", "type", "space_id", "created_at", F.when(i % 9 == 1, "merged").otherwise(F.col("status")).alias("status"),
                                         canonical.alias("canonical"), notes.alias("addenda"))


@query(f"{STATE_SQL} SELECT 'stale pendings' AS \"check\", NULL AS detail, (SELECT count(*) FROM nodes WHERE created_at + INTERVAL 24 HOUR < TIMESTAMP '2024-01-02 06:00:00') AS n UNION ALL SELECT 'nonconforming', type, count(*) FROM st WHERE status = 'active' AND id % 5 = 2 GROUP BY type "
       "UNION ALL SELECT 'orphaned merges', NULL, count(*) FROM st a JOIN st c ON c.id = a.canonical WHERE a.status = 'merged' AND c.status <> 'active' UNION ALL SELECT 'long chains', NULL, 0 UNION ALL SELECT 'many addenda', NULL, count(*) FROM st WHERE addenda > 20")
def health_report(spark, sf_dir):
    nodes = stated(spark, sf_dir)
    pending = nodes.select((F.col("created_at") + F.expr("INTERVAL '24' HOUR")).alias("expires_at"))
    return T.health(nodes, pending, nodes.filter("id % 5 = 2").select("id"), "2024-01-02 06:00:00")


@query(f"{STATE_SQL}, {S.DOC_EDGES_SQL}, e AS (SELECT src, CASE WHEN src % 30 = 0 THEN dst + 1000000 WHEN src % 30 = 1 THEN src ELSE dst END AS dst, type FROM doc_edges), f AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE src % 30 = 2) "
       "SELECT CAST(a.id AS VARCHAR) AS item, CASE WHEN a.status = 'merged' AND a.canonical IS NULL THEN 'merged without canonical' WHEN a.status <> 'merged' AND a.canonical IS NOT NULL THEN 'canonical without merge' WHEN c.id IS NULL THEN 'canonical is missing' ELSE 'canonical of another kind' END AS rule "
       "FROM st a LEFT JOIN st c ON c.id = a.canonical WHERE (a.status = 'merged' AND a.canonical IS NULL) OR (a.status <> 'merged' AND a.canonical IS NOT NULL) OR (a.canonical IS NOT NULL AND (c.id IS NULL OR c.type <> a.type)) "
       "UNION ALL SELECT src || '>' || dst, 'dst is missing' FROM f WHERE dst NOT IN (SELECT id FROM st) UNION ALL SELECT src || '>' || dst, 'self loop' FROM f WHERE src = dst UNION ALL SELECT src || '>' || dst, 'repeated edge' FROM f GROUP BY src, dst, type HAVING count(*) > 1")
def integrity_audit(spark, sf_dir):
    n = F.col("src") % 30
    edges = S.document_edges(spark, sf_dir).select("src", F.when(n == 0, F.col("dst") + 1_000_000).when(n == 1, F.col("src")).otherwise(F.col("dst")).alias("dst"), "type")
    return T.integrity(stated(spark, sf_dir), edges.union(edges.filter("src % 30 = 2")))


@query(f"{S.NODES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' WHEN id % 7 = 0 AND status IS NULL THEN NULL ELSE created_at END AS updated_at FROM nodes")
def touch_rule(spark, sf_dir):
    before = S.nodes(spark, sf_dir).withColumn("updated_at", F.col("created_at")).withColumn("recalls", F.lit(0))
    after = before.select("id", F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), "body",
                          F.lit(7).alias("recalls"), F.expr("timestamp'2024-06-01 00:00:00'").alias("updated_at"))
    return T.touched(before, after, ("title", "body"))


@query("WITH a AS (SELECT doc_id AS id, lang AS type, coalesce(text, '') AS body FROM documents), w AS (SELECT id, type, list_distinct(list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM a) "
       "SELECT id, pos, 'merge_linked_promoted' AS band, type IN ('en', 'de') AS edge FROM w, (VALUES (0), (1)) p(pos) WHERE 2e0 * pos / (len(t) + 2) < 0.8")
def addenda_promotion(spark, sf_dir):
    """Each document with three addenda: one of new words, the same again, and one that was promoted before."""
    notes = """to_json(array(named_struct('body', 'zzqx zzqy', 'merged_at', '2024-01-01'), named_struct('body', 'Zzqx, zzqy!', 'merged_at', '2024-01-02')))"""
    nodes = S.nodes(spark, sf_dir).select("id", "type", "body", F.expr(notes).alias("addenda"))
    rows, edges = T.promoted_addenda(nodes, spark.sql("SELECT * FROM VALUES ('en'), ('de') AS t(type)"))
    ends = edges.select(F.substring_index("src", "#", 1).cast("long").alias("id"), F.lit(True).alias("edge")).distinct()
    return rows.join(ends, "id", "left").select("id", "pos", "band", F.coalesce("edge", F.lit(False)).alias("edge"))


@query(f"{VECTORS_SQL}, s AS (SELECT id, dim, w FROM v WHERE id % 6 <> 0 OR dim % 2 = 0), d AS (SELECT v.id, sum(v.w * s.w) AS dot FROM v JOIN s USING (id, dim) GROUP BY v.id), sn AS (SELECT id, sum(w * w) AS sn FROM s GROUP BY id) "
       "SELECT id, round(coalesce(dot / sqrt(CAST(nn * sn AS DOUBLE)), 0e0), 6) AS cosine FROM nodes JOIN nn USING (id) LEFT JOIN d USING (id) LEFT JOIN sn USING (id) WHERE status = 'active' AND coalesce(dot / sqrt(CAST(nn * sn AS DOUBLE)), 0e0) < 0.9999")
def stale_vectors(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir)
    fresh = materialize(X.hashed_vectors(R.searchable(nodes), "id", F.col("searchable")), "fresh")
    return T.stale_vectors(nodes, fresh.filter("id % 6 <> 0 OR dim % 2 = 0"), fresh)


#: Web-style queries made of each request's words: two words, or a phrase of two others, without a third.
WEB = """concat(regexp_extract(lower(element_at(w, 2)), '[\\\\p{L}\\\\p{N}]+', 0), ' ', regexp_extract(lower(element_at(w, 6)), '[\\\\p{L}\\\\p{N}]+', 0), ' or "', element_at(w, 3), ' ', element_at(w, 4), '" -', regexp_extract(lower(element_at(w, 9)), '[\\\\p{L}\\\\p{N}]+', 0))"""
LOW = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
PHRASE = "w[3] || ' ' || w[4]"
WEB_SQL = f"""{LEGS_SQL}, t AS (SELECT id, unnest(list_concat(tt, [''], bt)) AS lexeme, unnest(range(len(tt) + 1 + len(bt))) AS pos, len(tt) AS cut FROM (SELECT id, {LOW.format("title")} AS tt, {LOW.format("body")} AS bt FROM nodes)),
post AS (SELECT id, lexeme, pos, CASE WHEN pos < cut THEN 1.0e0 ELSE 0.4e0 END AS weight FROM t WHERE lexeme <> ''),
ask AS (SELECT request_id, list_filter(string_split(query, ' '), lambda x: x <> '') AS w FROM requests),
words1 AS (SELECT request_id, [regexp_extract(lower(w[2]), '[\\p{{L}}\\p{{N}}]+', 0)] AS one, [regexp_extract(lower(w[6]), '[\\p{{L}}\\p{{N}}]+', 0)] AS two, {LOW.format(PHRASE)} AS p, regexp_extract(lower(w[9]), '[\\p{{L}}\\p{{N}}]+', 0) AS neg FROM ask),
hit1 AS (SELECT DISTINCT request_id, 0 AS alt, id, item, pos, weight FROM (SELECT request_id, unnest(one) AS lexeme, 0 AS item FROM words1 UNION ALL SELECT request_id, unnest(two), 1 FROM words1) JOIN post USING (lexeme)),
hit2 AS (SELECT request_id, 1 AS alt, a.id, 3 AS item, a.pos, least(a.weight, b.weight) AS weight FROM words1 JOIN post a ON a.lexeme = p[1] JOIN post b ON b.id = a.id AND b.pos = a.pos + 1 AND b.lexeme = p[2] ANTI JOIN post x ON x.id = a.id AND x.lexeme = neg),
occ AS (SELECT * FROM hit1 JOIN (SELECT request_id, id FROM hit1 GROUP BY ALL HAVING count(DISTINCT item) = 2) USING (request_id, id) UNION ALL SELECT * FROM hit2),
ends AS (SELECT DISTINCT request_id, alt, id, pos AS p FROM occ), last AS (SELECT e.request_id, e.alt, e.id, p, item, max(pos) AS spot, arg_max(weight, pos) AS weight FROM ends e JOIN occ o ON o.request_id = e.request_id AND o.alt = e.alt AND o.id = e.id AND o.pos <= p GROUP BY ALL),
cover AS (SELECT request_id, alt, id, p, min(spot) AS l, sum(1 / weight) AS inv, count(*) AS n FROM last GROUP BY ALL HAVING count(*) = CASE WHEN alt = 0 THEN 2 ELSE 1 END),
best AS (SELECT request_id, id, max(score) AS score FROM (SELECT request_id, alt, id, sum(n / inv * least(1e0, 4e0 / (p - l + 1))) AS score FROM (SELECT * FROM cover QUALIFY row_number() OVER (PARTITION BY request_id, alt, id, l ORDER BY p) = 1) GROUP BY ALL) GROUP BY ALL)"""


@query(WEB_SQL + " SELECT request_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, id) AS INT) AS rank FROM best JOIN live USING (id) JOIN scope_sets USING (request_id, scope_id) QUALIFY rank <= 30")
def web_search(spark, sf_dir):
    nodes, requests = S.nodes(spark, sf_dir), S.requests(spark, sf_dir)
    sets = V.scope_sets(requests, access(spark, sf_dir)[1])
    asked = requests.select("request_id", F.filter(F.split("query", " "), lambda x: x != "").alias("w")).select("request_id", F.expr(WEB).alias("query"))
    return W.best_in_texts(asked, nodes, {"A": "title", "B": "body"}, sets)


@query()
def web_search_english(spark, sf_dir):
    """The same search by stems, without stop words; tests hold stems and matches against plain versions."""
    nodes, requests = S.nodes(spark, sf_dir), S.requests(spark, sf_dir)
    sets = V.scope_sets(requests, access(spark, sf_dir)[1])
    asked = requests.select("request_id", F.filter(F.split("query", " "), lambda x: x != "").alias("w")).select("request_id", F.expr(WEB).alias("query"))
    return W.best_in_texts(asked, nodes, {"A": "title", "B": "body"}, sets, mode="english")
