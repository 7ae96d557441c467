"""Registered queries of attributes, registries, permissions and table maintenance, and the SQL that checks them."""

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import attrs as A
from factgraph.functions import text as X
from factgraph.operators import maintenance as M
from factgraph.operators import registries as Y
from factgraph.plans.registry import TOKENS_SQL, access, query
from factgraph.runtime import in_parts, shared_folder, table
from factgraph.sources import derived as S

#: Attributes of events, some of them wrong, as an expression of both engines.
ATTRS = """concat(CASE WHEN event_id % 17 = 0 THEN '{"note":"x"' ELSE concat('{"event_type":"', event_type, '"') END,
  CASE WHEN event_id % 7 = 0 THEN ',"k":"bad"' WHEN event_id % 7 = 1 THEN ',"k":2.5' ELSE concat(',"k":', CAST(event_id % 50 AS STRING)) END,
  CASE event_id % 9 WHEN 0 THEN ',"day":"2024-13"' WHEN 1 THEN ',"day":"2024-02-30"' WHEN 2 THEN ',"day":"2024"' WHEN 3 THEN ',"day":7' WHEN 4 THEN ',"day":"0000-01-01"' ELSE '' END,
  CASE WHEN event_id % 11 = 0 THEN ',"zz":1' ELSE '' END, CASE WHEN event_id % 13 = 0 THEN ',"flag":null' WHEN event_id % 13 = 1 THEN ',"flag":true' ELSE '' END, '}')"""
SPEC = """SELECT 'event' AS type, section, key, kind, CASE WHEN kind = 'enum' THEN array('click', 'view', 'signup') END AS choices, CAST(NULL AS BOOLEAN) AS searchable
  FROM VALUES ('required', 'event_type', 'enum'), ('optional', 'k', 'int'), ('optional', 'day', 'date'), ('optional', 'flag', 'bool'), ('optional', 'note', 'string') AS t(section, key, kind)"""
CHECKS_SQL = f"""a AS (SELECT event_id AS id, CAST({ATTRS} AS JSON) AS a FROM events),
t AS (SELECT *, json_extract_string(a, '$.event_type') AS et, json_extract_string(a, '$.day') AS day, json_type(a, '$.day') AS dt, json_type(a, '$.k') AS kt, json_type(a, '$.flag') AS ft FROM a),
bad AS (SELECT id, 'day' AS key, CASE WHEN dt <> 'VARCHAR' THEN 'attrs.day must be a date' WHEN day LIKE '0000%' OR TRY_CAST(rpad(day, 10, '-01') AS DATE) IS NULL THEN 'attrs.day must be a valid ISO date' END AS error, json_extract(a, '$.day') AS value FROM t WHERE dt IS NOT NULL
  UNION ALL SELECT id, 'event_type', CASE WHEN et NOT IN ('click', 'view', 'signup') THEN 'attrs.event_type must be one of click|view|signup' END, json_extract(a, '$.event_type') FROM t
  UNION ALL SELECT id, 'flag', CASE WHEN ft <> 'BOOLEAN' THEN 'attrs.flag must be a bool' END, json_extract(a, '$.flag') FROM t WHERE ft IS NOT NULL
  UNION ALL SELECT id, 'k', CASE WHEN kt NOT IN ('UBIGINT', 'BIGINT') THEN 'attrs.k must be a int' END, json_extract(a, '$.k') FROM t),
errs AS (SELECT id, 1 AS phase, 'event_type' AS place, 'attrs.event_type is required' AS e FROM t WHERE et IS NULL UNION ALL SELECT id, 2, '0', 'attrs.day is required when event_type=click' FROM t WHERE et = 'click' AND dt IS NULL
  UNION ALL SELECT id, 3, 'zz', 'attrs.zz is not allowed (closed spec)' FROM t WHERE json_exists(a, '$.zz') UNION ALL SELECT id, 4, key, error FROM bad WHERE error IS NOT NULL)"""


def checked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("type"), F.expr(ATTRS).alias("attrs"))
    asked = spark.sql("SELECT 'event' AS type, 0 AS pos, 'event_type' AS when_key, 'click' AS equals, 'day' AS key")
    return Y.conformance(events, spark.sql(SPEC), asked)


@query(f"{CHECKS_SQL} SELECT id, string_agg(e, '; ' ORDER BY phase, place) AS errors FROM errs GROUP BY id")
def attr_conformance(spark, sf_dir):
    return checked(spark, sf_dir)[0].select("id", F.array_join("errors", "; ").alias("errors"))


@query(f"{CHECKS_SQL} SELECT id, key, CAST(value AS VARCHAR) AS value, error FROM bad WHERE error IS NOT NULL")
def attr_quarantine(spark, sf_dir):
    return checked(spark, sf_dir)[1]


@query(f"WITH a AS (SELECT event_id AS id, CAST({ATTRS} AS JSON) AS a FROM events) SELECT id, key, CASE json_type(a, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind "
       "FROM (SELECT id, a, unnest(json_keys(a)) AS key FROM a)")
def attr_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(A.members(F.expr(ATTRS))).alias("key", "v"))
    return rows.select("id", "key", A.json_type(F.col("v")).alias("kind"))


MAP = "map('event_type', event_type, 'k', get_json_object(props, '$.k'), 'dropped', 'x', 'empty', '', 'area', concat('a', event_id % 3))"


@query("SELECT event_id AS id, concat('area: a', event_id % 3, chr(10), 'event_type: ', event_type, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN chr(10) || 'k: ' || json_extract_string(props, '$.k') ELSE '' END) AS surface, "
       "'T' || chr(10) || 'B' || chr(10) || concat('area: a', event_id % 3, chr(10), 'event_type: ', event_type, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN chr(10) || 'k: ' || json_extract_string(props, '$.k') ELSE '' END) AS searched, 4 AS kept FROM events")
def attr_surface(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(MAP).alias("m")).withColumn("surface", A.surface(F.col("m")))
    return rows.select("id", "surface", A.searchable_text(F.lit("T"), F.lit("B"), F.col("surface")).alias("searched"), F.size(A.without_reserved(F.col("m"))).alias("kept"))


@query("WITH d AS (SELECT event_id AS id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events), m AS (SELECT max(day) AS top FROM d) "
       "SELECT id FROM d, m WHERE event_type = 'view' AND day > strftime(CAST('2024-01-20' AS DATE) - 10, '%Y-%m-%d') AND day < '2024-01-25'")
def attr_section(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    late = A.satisfies(F.col("day"), after="-10d", as_of="2024-01-20") & A.satisfies(F.col("day"), before="2024-01-25")
    return rows.filter(A.satisfies(F.col("event_type"), equals="view") & late).select(F.col("event_id").alias("id"))


SPEC_SQL = """kinds AS (SELECT DISTINCT lang AS type, source AS key, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS i FROM documents),
spec AS (SELECT type, CASE WHEN i % 2 = 0 THEN 'required' ELSE 'optional' END AS section, CASE WHEN i = 7 THEN 'addenda' ELSE key END AS key,
  CASE i % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'date' WHEN 2 THEN 'int' WHEN 3 THEN 'bool' WHEN 4 THEN 'number' ELSE 'colour' END AS kind, CASE i % 5 WHEN 0 THEN true WHEN 1 THEN false END AS searchable FROM kinds)"""


def spec_of(spark, sf_dir) -> DataFrame:
    i = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("type"), F.col("source").alias("key"), i.alias("i")).distinct()
    return rows.select(
        "type", F.when(F.col("i") % 2 == 0, "required").otherwise("optional").alias("section"), F.when(F.col("i") == 7, "addenda").otherwise(F.col("key")).alias("key"),
        F.expr("element_at(array('string', 'date', 'int', 'bool', 'number', 'colour'), i % 6 + 1)").alias("kind"), F.lit(None).cast("array<string>").alias("choices"),
        F.when(F.col("i") % 5 == 0, True).when(F.col("i") % 5 == 1, False).alias("searchable"))


@query(f"{SPEC_SQL} SELECT DISTINCT type, key FROM spec WHERE key <> 'addenda' AND coalesce(searchable, kind IN ('string', 'date'))")
def searchable_keys(spark, sf_dir):
    return Y.searchable_keys(spec_of(spark, sf_dir))


RULES = "VALUES ('relates_to', '*', '*'), ('same_topic', 'en', '*'), ('follows', 'xx', 'de')"


@query(f"WITH types AS (SELECT DISTINCT lang AS name FROM documents), r(type, a, b) AS ({RULES}) SELECT DISTINCT r.type, x.name AS src_type, y.name AS dst_type FROM r "
       "JOIN (SELECT name FROM types UNION SELECT 'xx') x ON x.name = r.a OR (r.a = '*' AND x.name <> 'xx') JOIN types y ON y.name = r.b OR r.b = '*'")
def concrete_rules(spark, sf_dir):
    types = table(spark, sf_dir, "documents").select(F.col("lang").alias("name"))
    return Y.concrete_rules(spark.sql(f"SELECT * FROM {RULES} AS t(type, src_type, dst_type)"), types)


@query(f"{SPEC_SQL}, r(type, a, b) AS ({RULES}) SELECT DISTINCT type || '.' || key AS item, 'bad kind' AS problem FROM spec WHERE kind = 'colour' UNION SELECT type || '.' || key, 'reserved key' FROM spec WHERE key = 'addenda' "
       "UNION SELECT type, 'spec of unknown type' FROM spec WHERE type = 'fr' UNION SELECT 'follows.xx', 'rule of unknown type' UNION SELECT 'follows', 'rule of unknown edge type' UNION SELECT 'Bad Name', 'bad name'")
def registry_problems(spark, sf_dir):
    types = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).filter("name <> 'fr'").distinct()
    edge_types = spark.sql("SELECT * FROM VALUES ('relates_to'), ('same_topic'), ('Bad Name') AS t(name)")
    rules = spark.sql(f"SELECT * FROM {RULES} AS t(type, src_type, dst_type)")
    return Y.registry_problems(types, spec_of(spark, sf_dir), edge_types, rules)


@query(f"{SPEC_SQL}, new AS (SELECT * FROM spec WHERE NOT (type = 'de' AND key = 'src3') AND type <> 'es' UNION ALL SELECT 'it', section, key, kind, searchable FROM spec WHERE type = 'en'), "
       "types AS (SELECT type FROM spec UNION SELECT type FROM new) SELECT type, CASE WHEN type = 'it' THEN 'add' WHEN type = 'es' THEN 'remove' ELSE 'change' END AS step, "
       "CASE WHEN type = 'it' THEN 0 WHEN type = 'es' THEN (SELECT count(*) FROM documents WHERE lang = 'es') ELSE (SELECT count(*) FROM documents WHERE lang = types.type AND n_chars > 5000) END AS blocked FROM types WHERE type IN ('it', 'es', 'de')")
def upgrade_plan(spark, sf_dir):
    old = spec_of(spark, sf_dir)
    new = old.filter("NOT (type = 'de' AND key = 'src3') AND type <> 'es'").unionByName(old.filter("type = 'en'").withColumn("type", F.lit("it")))
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "type")
    count = F.count("*").alias("n")
    return Y.upgrade_plan(old, new, docs.groupBy("type").agg(count), docs.filter("n_chars > 5000").groupBy("type").agg(count))


@query("SELECT doc_id AS seq, CASE WHEN doc_id % 10 = 0 THEN 0.5e0 WHEN source IN ('src1', 'src3') THEN 0.6e0 ELSE 0.8e0 END AS t_low, CASE WHEN source = 'src3' THEN 0.95e0 ELSE 0.9e0 END AS t_high FROM documents")
def threshold_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    config = docs.select("source").distinct().select(F.col("source").alias("space_id"), F.explode(F.expr(
        "CASE source WHEN 'src1' THEN map('t_low', '0.6') WHEN 'src3' THEN map('t_low', '0.6', 't_high', '0.95') ELSE map() END")).alias("key", "value"))
    writes = docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("space_id"), F.when(F.col("doc_id") % 10 == 0, 0.5).alias("low"), F.lit(None).cast("double").alias("high"))
    return Y.resolved_thresholds(writes, config, 0.8, 0.9).select("seq", "t_low", "t_high")


@query("""SELECT doc_id AS seq, CASE WHEN doc_id % 6 = 0 THEN 'reserved type' WHEN doc_id % 6 = 1 THEN 'attrs is not an object' WHEN doc_id % 6 = 2 THEN 'reserved attribute' ELSE 'bad link' END AS reason FROM documents WHERE doc_id % 6 <= 4""")
def shape_refusals(spark, sf_dir):
    n = F.col("doc_id") % 6
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.when(n == 0, "sentinel").otherwise(F.col("lang")).alias("type"),
        F.when(n == 1, "[1]").when(n == 2, '{"addenda": []}').otherwise('{"a": 1}').alias("attrs"),
        F.when(n == 3, '{"type": "x"}').when(n == 4, '[{"type": "x"}]').when(n == 5, '[{"type": "x", "target": "y"}]').alias("links"))
    return Y.shape_errors(rows)


def bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "n_chars")


@query("SELECT doc_id, octet_length(encode(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars}))) AS bytes FROM documents")
def payload_sizes(spark, sf_dir):
    return bodies(spark, sf_dir).select("doc_id", A.payload_bytes("doc_id", "lang", "n_chars").alias("bytes"))


@query("WITH c AS (SELECT doc_id, coalesce(text, '') AS cited, CASE WHEN doc_id % 3 = 0 THEN substr(coalesce(text, ''), 5, 20) ELSE repeat('s', CAST(doc_id % 9000 AS BIGINT)) END AS source FROM documents), "
       "m AS (SELECT *, CASE WHEN cited = '' THEN source ELSE cited || chr(10) || source END AS more FROM c) SELECT doc_id, CASE WHEN contains(cited, source) OR length(more) > 8000 THEN length(cited) ELSE length(more) END AS size FROM m")
def cited_sources(spark, sf_dir):
    source = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 5, 20)).otherwise(F.expr("repeat('s', cast(doc_id % 9000 as int))"))
    rows = bodies(spark, sf_dir).select("doc_id", F.col("text").alias("cited"), source.alias("source"))
    return rows.select("doc_id", F.length(A.with_source(F.col("cited"), F.col("source"))).alias("size"))


WORDS_SQL = ("list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({}), '\\b([0-9]+)(st|nd|rd|th)\\b', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ("
             + ", ".join(map(repr, A.FILLER)) + ")), lambda x: CASE x " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in A.NUMBERS.items()) + " ELSE x END))")


@query(f"WITH q AS (SELECT item_id, 'The 2nd of two ' || text AS gold, {WORDS_SQL.format(chr(39) + 'The 2nd of two ' + chr(39) + ' || text')} AS words FROM benchmark), d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) "
       "SELECT item_id, doc_id, round(CAST(len(list_filter(words, lambda w: contains(low, w))) AS DOUBLE) / len(words), 6) AS share FROM q JOIN d ON d.doc_id BETWEEN item_id * 5 AND item_id * 5 + 4")
def gold_support(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("The 2nd of two "), "text").alias("gold"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    rows = gold.withColumn("doc_id", F.col("item_id") * 5 + F.col("k")).join(bodies(spark, sf_dir), "doc_id")
    return rows.select("item_id", "doc_id", F.round(A.support(F.col("gold"), F.col("text")), 6).alias("share"))


@query("SELECT doc_id, regexp_matches(upper(text), 'INSUFFICIENT') AND length(text) <= 80 AS abstains FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'insufficient ' ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL)")
def abstentions(spark, sf_dir):
    reply = F.concat(F.when(F.col("doc_id") % 3 == 0, "insufficient ").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", A.abstains(reply).alias("abstains"))


@query("WITH v AS (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(list_dot_product(e, list_transform(range(32), lambda x: 1 / sqrt(32.0))) / sqrt(list_dot_product(e, e)), 6) AS level FROM v")
def unit_levels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.cosine(X.unit(F.col("embedding"), 32), A.constant_unit(32)), 6).alias("level"))


@query(f"{S.NODES_SQL}, {S.SCOPES_SQL} SELECT p.principal, n.id, (w.scope_id IS NOT NULL) AS may_insert, (r.scope_id IS NOT NULL AND w.scope_id IS NOT NULL) AS may_update FROM nodes n CROSS JOIN principals p "
       "LEFT JOIN writable w ON w.principal = p.principal AND w.scope_id = n.scope_id LEFT JOIN readable r ON r.principal = p.principal AND r.scope_id = n.scope_id WHERE p.principal = 'p' || (n.id % 5)")
def node_write_permission(spark, sf_dir):
    _, readable, writable = access(spark, sf_dir)
    asked = S.nodes(spark, sf_dir).select("id", "scope_id", F.concat(F.lit("p"), F.col("id") % 5).alias("principal"))
    rows = asked.join(writable.withColumn("w", F.lit(True)), ["principal", "scope_id"], "left").join(
        readable.select("principal", "scope_id", F.lit(True).alias("r")), ["principal", "scope_id"], "left")
    return rows.select("principal", "id", F.coalesce("w", F.lit(False)).alias("may_insert"), F.coalesce(F.col("r") & F.col("w"), F.lit(False)).alias("may_update"))


@query(f"{S.SCOPES_SQL} SELECT principal, scope_id, 'Facts of ' || scope_id AS description, CAST(row_number() OVER (PARTITION BY principal ORDER BY scope_id) AS INT) AS nth FROM readable")
def scope_manifest(spark, sf_dir):
    scopes, readable, _ = access(spark, sf_dir)
    told = scopes.select("scope_id", F.concat(F.lit("Facts of "), "scope_id").alias("description"))
    return readable.select("principal", "scope_id").join(told, "scope_id").select(
        "principal", "scope_id", "description", F.row_number().over(Window.partitionBy("principal").orderBy("scope_id")).alias("nth"))


@query(f"{S.SCOPES_SQL}, i AS (SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN 'src' || (user_id % 20) END AS scope_id, 'p' || (user_id % 5) AS principal FROM events WHERE event_type = 'click') "
       "SELECT i.principal, i.id, i.scope_id IS NULL OR w.scope_id IS NOT NULL AS actionable FROM i LEFT JOIN readable r USING (principal, scope_id) LEFT JOIN writable w ON w.principal = i.principal AND w.scope_id = i.scope_id WHERE i.scope_id IS NULL OR r.scope_id IS NOT NULL")
def inbox_actionable(spark, sf_dir):
    _, readable, writable = access(spark, sf_dir)
    rows = table(spark, sf_dir, "events").filter("event_type = 'click'").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("src"), F.col("user_id") % 20)).alias("scope_id"),
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("principal"))
    rows = rows.join(readable.select("principal", "scope_id", F.lit(True).alias("r")), ["principal", "scope_id"], "left").join(
        writable.withColumn("w", F.lit(True)), ["principal", "scope_id"], "left").filter("scope_id IS NULL OR r")
    return rows.select("principal", "id", (F.col("scope_id").isNull() | F.coalesce("w", F.lit(False))).alias("actionable"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE user_id % 5 = 1 GROUP BY ALL")
def own_metrics(spark, sf_dir):
    """A principal reads the rows of its own; others only those of the whole space, which are not asked for here."""
    mine = S.usage_events(spark, sf_dir).withColumn("principal", F.concat(F.lit("p"), F.regexp_extract("principal", "([0-9]+)", 1).cast("long") % 5))
    return mine.filter("principal = 'p1'").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(f"{S.NODES_SQL} SELECT id, title, n_chars FROM nodes WHERE author = 'p2' AND status = 'active'")
def pending_mine(spark, sf_dir):
    return S.nodes(spark, sf_dir).filter("author = 'p2' AND status = 'active'").select("id", "title", "n_chars")


@query("WITH c AS (SELECT doc_id, doc_id % 4 = 0 AS lost, doc_id % 4 = 1 AS moved, doc_id % 3 = 1 AND text IS NOT NULL AS other FROM documents), r AS (SELECT doc_id % 3 AS side, CASE WHEN lost OR moved THEN 'missing' WHEN other THEN 'changed' ELSE 'same' END AS state FROM c "
       "UNION ALL SELECT -(doc_id + 1) % 3, 'extra' FROM c WHERE moved) SELECT side, count(*) AS n, count(*) FILTER (state = 'same') AS same, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'extra') AS extra FROM r GROUP BY side")
def snapshot_compare(spark, sf_dir):
    """A copy that lacks every fourth document, holds others under another id and has others changed, compared by content; rows on one side only count."""
    docs = bodies(spark, sf_dir)
    content = F.sha2(F.to_json(F.struct("text", "lang")).cast("binary"), 256)
    copy = docs.filter("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    copy = copy.withColumn("doc_id", F.when(F.col("doc_id") % 4 == 1, -(F.col("doc_id") + 1)).otherwise(F.col("doc_id")))
    return M.compared(docs.select("doc_id", content.alias("a")), copy.select("doc_id", content.alias("a")), "doc_id", "a", F.col("doc_id") % 3).withColumnRenamed("group", "side")


def reembedding(spark, sf_dir):
    """Nodes with the stamp of the model that their vector is of, and the surface they were embedded with."""
    return S.nodes(spark, sf_dir).select(
        "id", "scope_id", "type", "title", "body", F.when(F.col("id") % 4 == 0, "z2-4096").otherwise("old").alias("stamp"),
        F.concat(F.lit("lang: "), "type").alias("surface"), F.when(F.col("id") % 5 == 0, "lang: ??").otherwise(F.concat(F.lit("lang: "), "type")).alias("stored_surface"))


@query(f"{S.NODES_SQL} SELECT scope_id, count(*) AS scanned, count(*) FILTER (id % 4 = 0) AS current, count(*) FILTER (id % 4 <> 0) AS stale, count(*) FILTER (id % 5 = 0) AS surface_changed, count(*) FILTER (id % 4 <> 0 OR id % 5 = 0) AS to_embed FROM nodes GROUP BY scope_id")
def reembed_summary(spark, sf_dir):
    return M.reembed_summary(reembedding(spark, sf_dir), "z2-4096")


DUE_SQL = (f"{S.NODES_SQL}, due AS (SELECT id, unnest({TOKENS_SQL.format('title || chr(10) || body || chr(10) || ' + chr(39) + 'lang: ' + chr(39) + ' || type')}) AS t FROM nodes WHERE id % 4 <> 0 OR id % 5 = 0) "
           "SELECT id, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 4096 AS dim, count(*) AS w, 'z2-4096' AS stamp FROM due GROUP BY ALL")


@query(DUE_SQL)
def reembedded_vectors(spark, sf_dir):
    """Vectors of the rows whose stamp or surface is out of date, by the default embedder."""
    return M.reembedded(reembedding(spark, sf_dir), "z2-4096")


@query(DUE_SQL)
def reembedded_resumed(spark, sf_dir):
    """The same in four parts by a run that fails after two of them and is started again."""
    path, left = f"{shared_folder(spark)}/reembedded-{uuid.uuid4().hex}", [2]

    def embed(rows):
        left[0] -= 1
        if left[0] == -1:
            raise InterruptedError
        return M.reembedded(rows, "z2-4096")

    try:
        in_parts(reembedding(spark, sf_dir), "id", path, 4, embed)
    except InterruptedError:
        pass
    return in_parts(reembedding(spark, sf_dir), "id", path, 4, embed)
