"""Registered queries of lifecycles, briefings, exports and graded answers, and the SQL that checks them."""

from pyspark.sql import functions as F

from factgraph.functions import text as X
from factgraph.operators import briefing as B
from factgraph.operators import evaluation as E
from factgraph.operators import lifecycle as L
from factgraph.operators import visibility as V
from factgraph.operators import writes as D
from factgraph.plans.registry import BANDS_SQL, LEGS_SQL, access, incoming, query
from factgraph.runtime import table
from factgraph.sources import bundles
from factgraph.sources import derived as S

NOW = "2024-01-02 06:00:00"
INBOX_SQL = ("inbox AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'src' || (user_id % 20) END AS scope_id, ts AS created_at FROM events WHERE event_type = 'click'), "
             "mine AS (SELECT principal, i.* FROM inbox i JOIN readable r USING (scope_id) UNION ALL BY NAME SELECT p.principal, i.* FROM inbox i, principals p WHERE i.scope_id IS NULL)")


def inbox(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'click'").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("src"), F.col("user_id") % 20)).alias("scope_id"),
        F.col("ts").cast("timestamp").alias("created_at"), F.lit("pending").alias("status"))
    return L.inbox_visible(rows, access(spark, sf_dir)[1], S.principals(spark))


@query(f"{S.NODES_SQL} SELECT author, id, place, more, preview FROM (SELECT author, id, title || ' — ' || rtrim(substr(body, 1, 280), ' ') || CASE WHEN length(body) > 280 THEN '…' ELSE '' END AS preview, "
       "CAST(row_number() OVER (PARTITION BY author ORDER BY created_at DESC, id) AS INT) AS place, count(*) OVER (PARTITION BY author) > 25 AS more FROM nodes) WHERE place BETWEEN 6 AND 25")
def pending_page(spark, sf_dir):
    return L.page(S.nodes(spark, sf_dir), ["author"], 20, 5, F.desc("created_at"), "id").select(
        "author", "id", "place", "more", X.preview(F.col("title"), F.col("body")).alias("preview"))


@query(f"{S.NODES_SQL} SELECT author, count(*) AS expired FROM nodes WHERE created_at + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}' GROUP BY author")
def pending_expiry(spark, sf_dir):
    return L.expired(S.nodes(spark, sf_dir), NOW).groupBy("author").agg(F.count("*").alias("expired"))


@query(f"{S.SCOPES_SQL}, {INBOX_SQL} SELECT principal, id, place, more FROM (SELECT principal, id, CAST(row_number() OVER (PARTITION BY principal ORDER BY created_at, id) AS INT) AS place, "
       "count(*) OVER (PARTITION BY principal) > 50 AS more FROM mine) WHERE place <= 50")
def inbox_page(spark, sf_dir):
    return L.page(inbox(spark, sf_dir), ["principal"], 50, 0, "created_at", "id").select("principal", "id", "place", "more")


@query(f"{S.SCOPES_SQL}, {INBOX_SQL} SELECT principal, count(*) AS overdue FROM mine WHERE created_at <= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY principal")
def inbox_overdue(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return B.overdue(inbox(spark, sf_dir), now)


TOP5_SQL = BANDS_SQL + ", waiting AS (SELECT seq FROM bands WHERE band = 'pending'), snap AS (SELECT n.* FROM near n JOIN waiting USING (seq) WHERE rank <= 5)"


def waiting(spark, sf_dir):
    writes, _, near = incoming(spark, sf_dir)
    return S.nodes(spark, sf_dir), L.parked(D.banded(writes, near, 0.9, 0.97), near)


@query(f"{TOP5_SQL} SELECT seq, string_agg(candidate, ';' ORDER BY rank) AS candidates FROM snap GROUP BY seq")
def review_queue(spark, sf_dir):
    return waiting(spark, sf_dir)[1].select("seq", F.array_join("candidates", ";").alias("candidates"))


@query(f"{TOP5_SQL}, best AS (SELECT seq, arg_min(candidate, rank) AS nearest, arg_min(status = 'active', rank) AS alive, arg_min(candidate, rank) FILTER (status = 'active') AS related "
       f"FROM snap JOIN nodes ON id = candidate GROUP BY seq), done AS (SELECT b.*, CASE WHEN created_at + INTERVAL 24 HOUR <= TIMESTAMP '{NOW}' OR (seq % 4 = 1 AND NOT alive) THEN 'expired' "
       "WHEN seq % 4 = 1 THEN 'merged' ELSE 'inserted' END AS outcome FROM best b JOIN nodes ON id = seq) "
       "SELECT seq, outcome, CASE outcome WHEN 'merged' THEN nearest WHEN 'inserted' THEN related END AS target FROM done")
def resolve_pending(spark, sf_dir):
    nodes, parked = waiting(spark, sf_dir)
    late = F.col("created_at") + F.expr("INTERVAL '24' HOUR") <= F.expr(f"timestamp'{NOW}'")
    verdicts = nodes.select(F.col("id").alias("seq"), F.when(F.col("id") % 4 == 1, "merge").otherwise("distinct").alias("verdict"), late.alias("late"))
    return L.resolved(verdicts, parked, nodes)


@query(f"{BANDS_SQL} SELECT n.id AS new, n.id - 20 AS old, CASE WHEN o.id IS NULL THEN 'missing' "
       "WHEN o.status <> 'active' OR band <> 'insert' THEN 'downgraded' WHEN o.type <> n.type THEN 'related' ELSE 'superseded' END AS outcome "
       "FROM nodes n LEFT JOIN nodes o ON o.id = n.id - 20 LEFT JOIN bands ON seq = n.id")
def supersede(spark, sf_dir):
    writes, _, near = incoming(spark, sf_dir)
    nodes = S.nodes(spark, sf_dir)
    asked = nodes.select(F.col("id").alias("new"), (F.col("id") - 20).alias("old"))
    return L.superseded(asked, nodes, D.banded(writes, near, 0.9, 0.97))


@query(f"{BANDS_SQL} SELECT n.id, CASE WHEN status <> 'active' THEN 'discarded' WHEN n.id % 5 = 0 THEN 'discarded' "
       "WHEN n.id % 5 = 1 OR band = 'pending' OR band IS NULL THEN 'pending' ELSE 'promoted' END AS status FROM nodes n LEFT JOIN bands ON seq = n.id")
def inbox_triage(spark, sf_dir):
    nodes = S.nodes(spark, sf_dir)
    writes, _, near = incoming(spark, sf_dir)
    captured = nodes.select("id", F.when(F.col("status") == "active", "pending").otherwise("discarded").alias("status"))
    bands = D.banded(writes, near, 0.9, 0.97).select(F.col("seq").alias("id"), "band")
    action = F.when(F.col("id") % 5 == 0, "discard").when(F.col("id") % 5 > 1, "promote")
    return L.triaged(captured, nodes.select("id").join(bands, "id", "left").withColumn("action", action))


@query(f"{S.NODES_SQL}, u AS (SELECT doc_id * 2 AS id, CASE WHEN doc_id % 3 = 0 THEN 'New title ' || doc_id END AS title FROM documents) SELECT u.id, "
       "CASE WHEN n.id IS NULL THEN 'missing' WHEN status <> 'active' THEN 'rejected' ELSE 'updated' END AS outcome, "
       "coalesce(status = 'active' AND u.title IS NOT NULL AND u.title <> n.title, false) AS need_reembed FROM u LEFT JOIN nodes n USING (id)")
def update_outcomes(spark, sf_dir):
    updates = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 2).alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("New title "), "doc_id")).alias("title"),
        F.lit(None).cast("string").alias("body"))
    return L.updated(updates, S.nodes(spark, sf_dir)).select("id", "outcome", "need_reembed")


@query(f"{S.NODES_SQL}, {S.SCOPES_SQL}, {S.DOC_EDGES_SQL}, p AS (SELECT doc_id AS src, doc_id + 20 AS dst FROM documents UNION SELECT doc_id, doc_id + doc_id % 5 FROM documents), "
       "seen AS (SELECT id, status FROM nodes JOIN readable USING (scope_id) WHERE principal = 'p1') SELECT p.src, p.dst, 'relates_to' AS type, CASE WHEN p.src = p.dst THEN 'self loop' "
       "WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN a.status = 'archived' OR b.status = 'archived' THEN 'archived' WHEN e.src IS NOT NULL THEN 'skipped' ELSE 'attached' END AS outcome "
       "FROM p LEFT JOIN seen a ON a.id = p.src LEFT JOIN seen b ON b.id = p.dst LEFT JOIN doc_edges e ON e.src = p.src AND e.dst = p.dst")
def link_attach(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"))
    asked = ids.withColumn("dst", F.col("src") + 20).union(ids.withColumn("dst", F.col("src") + F.col("src") % 5)).withColumn("type", F.lit("relates_to"))
    mine = access(spark, sf_dir)[1].filter("principal = 'p1'")
    return L.linked(asked, S.document_edges(spark, sf_dir), V.visible_nodes(S.nodes(spark, sf_dir), mine))


@query(f"{S.DOC_EDGES_SQL}, ids AS (SELECT doc_id AS old, doc_id - doc_id % 30 AS new FROM documents WHERE doc_id % 11 <> 0), "
       "m AS (SELECT DISTINCT coalesce(a.new, src) AS src, coalesce(b.new, dst) AS dst, type, a.new IS NULL OR b.new IS NULL AS lost FROM doc_edges LEFT JOIN ids a ON a.old = src LEFT JOIN ids b ON b.old = dst) "
       "SELECT m.src, m.dst, m.type, CASE WHEN lost THEN 'unmapped' WHEN m.src = m.dst THEN 'same node' WHEN e.src IS NOT NULL THEN 'present' ELSE 'added' END AS outcome "
       "FROM m LEFT JOIN doc_edges e ON e.src = m.src AND e.dst = m.dst")
def edge_remap(spark, sf_dir):
    edges = S.document_edges(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0").select(
        F.col("doc_id").alias("old"), (F.col("doc_id") - F.col("doc_id") % 30).alias("new"))
    return L.remapped(edges, ids, edges)


SECTIONS = [B.Section("short", "type IN ('en', 'fr') AND n_chars >= 200", order="n_chars"),
            B.Section("unlinked", without_edge="relates_to", order="n_chars"), B.Section("withdrawn", status="archived", order="n_chars")]
BRIEFING_SQL = f"""{S.NODES_SQL}, {S.SCOPES_SQL}, {S.DOC_EDGES_SQL}, seen AS (SELECT principal, n.* FROM nodes n JOIN readable USING (scope_id)),
found AS (SELECT principal, 'short' AS section, id, n_chars, created_at FROM seen WHERE status = 'active' AND type IN ('en', 'fr') AND n_chars >= 200
  UNION ALL SELECT principal, 'unlinked', id, n_chars, created_at FROM seen WHERE status = 'active' AND id NOT IN (SELECT src FROM doc_edges)
  UNION ALL SELECT principal, 'withdrawn', id, n_chars, created_at FROM seen WHERE status = 'archived'),
top AS (SELECT principal, section, id, row_number() OVER (PARTITION BY principal, section ORDER BY n_chars NULLS LAST, created_at DESC, id) AS place FROM found QUALIFY place <= 10),
brief AS (SELECT principal, section, id, coalesce(place, 0) AS place FROM (SELECT principal, unnest(['short', 'unlinked', 'withdrawn']) AS section FROM principals) LEFT JOIN top USING (principal, section))"""


def brief(spark, sf_dir):
    seen, edges = V.visible_nodes(S.nodes(spark, sf_dir), access(spark, sf_dir)[1]), S.document_edges(spark, sf_dir)
    return B.briefing(SECTIONS, seen, edges, S.principals(spark)), edges, seen


@query(f"{BRIEFING_SQL} SELECT principal, section, id, place FROM brief")
def briefing_batch(spark, sf_dir):
    return brief(spark, sf_dir)[0]


@query(f"{BRIEFING_SQL} SELECT b.principal, section, b.id, s.id AS peer, row_number() OVER (PARTITION BY b.principal, section, b.id ORDER BY s.created_at DESC, s.id) AS nth "
       "FROM brief b JOIN doc_edges e ON e.src = b.id JOIN seen s ON s.id = e.dst AND s.principal = b.principal")
def briefing_linked(spark, sf_dir):
    found, edges, seen = brief(spark, sf_dir)
    return B.with_linked(found, edges, seen, "relates_to")


HINTS = [B.Semantic("related", ("en", "fr"), 5, 0.2), B.Semantic("german", ("de",), 3)]


def hints_sql(types: str, floor: float, top: int, name: str) -> str:
    """A query of LEGS_SQL over some types and with a floor, as rows of a section."""
    legs = LEGS_SQL.replace("FROM nodes WHERE status = 'active'", f"FROM nodes WHERE status = 'active' AND type IN ({types})").replace("FROM vec) WHERE rank", f"FROM vec WHERE similarity >= {floor}) WHERE rank")
    return f"(WITH {legs} SELECT request_id, '{name}' AS section, id, place FROM placed WHERE place <= {top})"


HINTS_SQL = (f"found AS ({hints_sql(chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'fr' + chr(39), 0.2, 5, 'related')} UNION ALL {hints_sql(chr(39) + 'de' + chr(39), 0, 3, 'german')}), "
             "hinted AS (SELECT request_id, section, id, CAST(coalesce(place, 0) AS INT) AS place FROM (SELECT item_id AS request_id, unnest(['related', 'german']) AS section FROM benchmark) LEFT JOIN found USING (request_id, section))")


def hints(spark, sf_dir):
    requests = S.requests(spark, sf_dir)
    return requests, B.hinted(HINTS, requests, S.nodes(spark, sf_dir), V.scope_sets(requests, access(spark, sf_dir)[1]))


@query(f"{HINTS_SQL} SELECT request_id, section, id, place FROM hinted")
def briefing_semantic(spark, sf_dir):
    """Sections filled by hybrid search with each request's hint."""
    return hints(spark, sf_dir)[1]


@query(f"{HINTS_SQL} SELECT request_id, 'p' || (request_id % 5) AS principal, count(DISTINCT section) AS sections, count(DISTINCT id) AS nodes FROM hinted WHERE request_id % 3 = 0 GROUP BY request_id")
def briefing_audit(spark, sf_dir):
    """Audit rows of the briefings over all scopes."""
    requests, found = hints(spark, sf_dir)
    return B.audited(found, requests)


@query(f"{HINTS_SQL} SELECT id, count(DISTINCT request_id) AS recalls FROM hinted WHERE id IS NOT NULL GROUP BY id")
def briefing_recalls(spark, sf_dir):
    """How many briefings showed each node; one counts once, whatever its sections."""
    rows = B.surfaced(hints(spark, sf_dir)[1]).withColumn("ts", F.lit(S.AS_OF).cast("timestamp"))
    return L.recall_statistics(rows).select("id", "recalls")


@query(f"{S.NODES_SQL}, {S.SCOPES_SQL}, {S.DOC_EDGES_SQL}, s AS (SELECT scope_id FROM scopes WHERE visibility <> 'private'), k AS (SELECT id, type FROM nodes JOIN s USING (scope_id)) "
       "SELECT 'scope' AS kind, scope_id AS key FROM s UNION ALL SELECT DISTINCT 'node_type', type FROM k UNION ALL SELECT 'node', CAST(id AS VARCHAR) FROM k "
       "UNION ALL SELECT 'edge', src || '>' || dst FROM doc_edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def bundle_export(spark, sf_dir):
    open_scopes = S.scopes(spark, sf_dir).filter("visibility <> 'private'").select("scope_id")
    parts = bundles.bundle(S.nodes(spark, sf_dir), S.document_edges(spark, sf_dir), open_scopes)
    keys = {"scope": F.col("scope_id"), "node_type": F.col("name"), "node": F.col("id").cast("string"), "edge": F.concat_ws(">", "src", "dst")}
    rows = [parts[k].select(F.lit(k).alias("kind"), key.alias("key")) for k, key in keys.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("SELECT user_id AS id, count(*) AS recalls FROM events WHERE event_type = 'view' GROUP BY user_id")
def recall_statistics(spark, sf_dir):
    return L.recall_statistics(table(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.col("user_id").alias("id"), "ts")).select("id", "recalls")


@query("SELECT user_id AS item, count(*) AS passes, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN 2 * count(*) FILTER (value >= 50) > count(*) THEN 'correct' ELSE 'wrong' END AS verdict "
       "FROM events GROUP BY user_id")
def majority_vote(spark, sf_dir):
    return E.majority(table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"), (F.col("value") >= 50).alias("correct"), (F.col("event_type") == "error").alias("error")))


@query("SELECT cause, n, sample FROM (SELECT source AS cause, count(*) AS n, arg_min(lang, doc_id) AS sample FROM documents WHERE n_chars < 500 GROUP BY source)")
def loss_report(spark, sf_dir):
    return E.losses(table(spark, sf_dir, "documents").filter("n_chars < 500").select(
        F.col("source").alias("cause"), F.col("lang").alias("detail"), F.col("doc_id").alias("seq")))


@query()
def admission(spark, sf_dir):
    """Batch form of admission in a sliding window, over minutes of three keys."""
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 3).alias("key"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return L.admitted(events, {"read": 60, "write": 30})
