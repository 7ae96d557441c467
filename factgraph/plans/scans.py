"""Registered queries of file scans: the given tables are written as files of a form, scanned, and compared with SQL over the tables."""

import uuid

from pyspark.sql import functions as F

from factgraph.plans.registry import query
from factgraph.runtime import shared_folder, table
from factgraph.sources import bundles
from factgraph.sources import conversations as C

SESSION = 3  # turns of a session


def written(lines, kind: str) -> str:
    """A folder of text files with the given lines."""
    path = f"{shared_folder(lines.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def sessions_of(spark, sf_dir):
    """(conv_id, session, turns) with turns in order, of any conversation table."""
    turns = table(spark, sf_dir, "conversations").withColumn("session", F.floor(F.col("turn") / SESSION) + 1)
    return turns.groupBy("conv_id", "session").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def as_object(by):
    """One JSON object of the fields (name, JSON) collected in `by`."""
    return F.concat(F.lit("{"), F.array_join(F.transform(by, lambda x: F.concat(F.lit('"'), x["name"], F.lit('": '), x["json"])), ", "), F.lit("}"))


@query(f"WITH t AS (SELECT conv_id, turn // {SESSION} + 1 AS session, turn, role, text FROM conversations WHERE trim(coalesce(text, ''), ' ') <> '') SELECT CAST(conv_id AS VARCHAR) AS haystack_id, session, "
       "row_number() OVER (PARTITION BY conv_id, session ORDER BY turn, role, text) - 1 AS place, 'D' || session || ':' || turn AS turn_id, role AS speaker, text, 'day ' || session AS timestamp FROM t")
def numbered_session_turns(spark, sf_dir):
    """Conversations written in the form of numbered sessions, scanned back to turns."""
    said = F.transform("turns", lambda x: F.struct(x["role"].alias("speaker"), F.concat(F.lit("D"), "session", F.lit(":"), x["turn"]).alias("dia_id"), x["text"].alias("text")))
    rows = sessions_of(spark, sf_dir).select("conv_id", F.explode(F.array(
        F.struct(F.concat(F.lit("session_"), "session").alias("name"), F.to_json(said).alias("json")),
        F.struct(F.concat(F.lit("session_"), "session", F.lit("_date_time")).alias("name"), F.concat(F.lit('"day '), "session", F.lit('"')).alias("json")))).alias("x"))
    talks = rows.groupBy("conv_id").agg(as_object(F.array_sort(F.collect_list("x"))).alias("talk"))
    lines = talks.select(F.concat(F.lit('{"sample_id": "'), "conv_id", F.lit('", "qa": [], "conversation": '), "talk", F.lit("}")).alias("value"))
    return C.numbered_sessions(spark, written(lines, "sessions"), multi_line=False).turns.drop("session_id")


@query(f"WITH t AS (SELECT conv_id, turn // {SESSION} AS session, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, turn // {SESSION} ORDER BY turn, role, text) - 1 AS k FROM conversations), "
       "e AS (SELECT conv_id, string_agg('s' || session || ':' || k, ';' ORDER BY session, k) AS evidence FROM t WHERE role = 'assistant' AND turn % 2 = 1 AND trim(text, ' ') <> '' GROUP BY conv_id), q AS (SELECT DISTINCT conv_id FROM conversations) "
       "SELECT conv_id || CASE WHEN conv_id % 4 = 0 THEN '_abs' ELSE '' END AS question_id, coalesce(evidence, '') AS evidence, conv_id % 4 = 0 AS declines FROM q LEFT JOIN e USING (conv_id) WHERE conv_id % 7 <> 0")
def parallel_session_questions(spark, sf_dir):
    """Conversations written as questions with parallel arrays of sessions and ids, one id too few in every seventh; scanned back to questions."""
    said = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["text"], F.lit("")).alias("content"), ((x["role"] == "assistant") & (x["turn"] % 2 == 1)).alias("has_answer")))
    rows = sessions_of(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("session", F.to_json(said).alias("json")))).alias("s"))
    ids = F.transform("s", lambda x: F.concat(F.lit('"s'), x["session"] - 1, F.lit('"')))
    ids = F.when(F.col("conv_id") % 7 == 0, F.concat(ids, F.array(F.lit('"more"')))).otherwise(ids)
    name = F.concat("conv_id", F.when(F.col("conv_id") % 4 == 0, C.DECLINED).otherwise(""))
    lines = rows.select(F.concat(
        F.lit('{"question_type": "multi-session", "question": "q", "question_id": "'), name, F.lit('", "haystack_session_ids": ['), F.array_join(ids, ", "), F.lit('], "haystack_sessions": ['),
        F.array_join(F.transform("s", lambda x: x["json"]), ", "), F.lit("]}")).alias("value"))
    found = C.parallel_sessions(spark, written(lines, "questions"), multi_line=False).questions
    return found.select("question_id", F.array_join("evidence", ";").alias("evidence"), "declines")


@query("WITH t AS (SELECT conv_id, turn FROM conversations WHERE role IS NULL AND trim(coalesce(text, ''), ' ') <> '') SELECT 'ids and sessions differ in length' AS problem, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 7 = 0 HAVING count(*) > 0 "
       "UNION ALL SELECT 'content is empty or not a string', count(*) FROM conversations WHERE conv_id % 7 <> 0 AND trim(coalesce(text, ''), ' ') = '' HAVING count(*) > 0 UNION ALL SELECT 'no role', count(*) FROM conversations WHERE conv_id % 7 <> 0 AND role IS NULL HAVING count(*) > 0")
def parallel_session_problems(spark, sf_dir):
    """The problems of the same scan, counted."""
    said = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["text"], F.lit("")).alias("content")))
    rows = sessions_of(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("session", F.to_json(said).alias("json")))).alias("s"))
    ids = F.when(F.col("conv_id") % 7 == 0, F.array_repeat(F.lit('"more"'), F.size("s") + 1)).otherwise(F.expr("cast(array() as array<string>)"))
    lines = rows.select(F.concat(
        F.lit('{"question_type": "multi-session", "question": "q", "question_id": "'), F.col("conv_id").cast("string"), F.lit('", "haystack_session_ids": ['), F.array_join(ids, ", "), F.lit('], "haystack_sessions": ['),
        F.array_join(F.transform("s", lambda x: x["json"]), ", "), F.lit("]}")).alias("value"))
    return C.parallel_sessions(spark, written(lines, "questions"), multi_line=False).problems.groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY doc_id) AS line, CASE doc_id % 7 WHEN 0 THEN 'invalid JSON' WHEN 2 THEN 'missing body' END AS reason FROM documents QUALIFY doc_id % 7 IN (0, 2)")
def refused_fact_lines(spark, sf_dir):
    """Documents written as one file of fact lines, some broken and some blank: the refused ones by their line."""
    kind = F.col("doc_id") % 7
    fact = F.to_json(F.struct(F.lit("note").alias("type"), F.lit("title").alias("title"), F.concat(F.lit("body "), "source").alias("body")))
    value = F.when(kind == 0, "{").when(kind == 1, "").when(kind == 2, F.regexp_replace(fact, '"body":[^}]*', '"links":[]')).otherwise(fact)
    ordered = table(spark, sf_dir, "documents").select("doc_id", value.alias("value")).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id")
    return bundles.read_facts(spark, written(ordered.select("value"), "facts"))[1].select("line", "reason")
