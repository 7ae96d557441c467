"""Scans of evaluation conversations in two JSON forms, as tables of turns, questions and problems.

In the first form an object holds numbered sessions and a list of questions; in the second one question holds parallel
arrays of sessions, ids and dates. A file is a list of such objects, or with multi_line=False one object a line, which
is read in parallel. What is wrong with an item is a row of `problems`; its other parts are kept.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories of the first form by their numbers, the one whose right answer is to decline, the question
# types of the second form, and the end of the ids of its questions that are to be declined.
CATEGORIES = {1: "multi-hop", 2: "temporal-reasoning", 3: "open-domain-knowledge", 4: "single-hop", 5: "adversarial"}
ADVERSARIAL = 5
QUESTION_TYPES = ("single-session-user", "single-session-assistant", "single-session-preference", "multi-session", "knowledge-update", "temporal-reasoning")
DECLINED = "_abs"
ROLES = ("user", "assistant")


class Scan(NamedTuple):
    """turns (haystack_id, session, session_id, place, turn_id, speaker, text, timestamp), questions (question_id, haystack_id,
    text, category, gold, coerced, evidence, declines), problems (item, problem), notes (note, n)."""

    turns: DataFrame
    questions: DataFrame
    problems: DataFrame
    notes: DataFrame


def _items(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    read = spark.read.option("singleVariantColumn", "v").option("multiLine", multi_line).json(path)
    return read.select(F.explode(F.expr("coalesce(try_variant_get(v, '$', 'array<variant>'), array(v))")).alias("v"))


def _text(v: str, path: str = "$") -> str:
    return f"try_variant_get({v}, '{path}', 'string')"


def _kind(v: str, path: str) -> str:
    return f"coalesce(schema_of_variant(try_variant_get({v}, '{path}', 'variant')), 'none')"


def _gold(v: str, path: str) -> str:
    """A string as it is, what is no string as JSON, nothing as the empty text."""
    return f"coalesce(CASE WHEN {_kind(v, path)} = 'STRING' THEN {_text(v, path)} WHEN {_kind(v, path)} NOT IN ('none', 'VOID') THEN to_json(try_variant_get({v}, '{path}', 'variant')) END, '')"


def _say(df: DataFrame, item: str, problem: str) -> DataFrame:
    return df.select(F.expr(item).cast("string").alias("item"), F.lit(problem).alias("problem"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def numbered_sessions(spark: SparkSession, path: str, multi_line: bool = True) -> Scan:
    """The first form: {sample_id, conversation: {session_N: [{speaker, dia_id, text}], session_N_date_time}, qa: [{question, answer, category, evidence}]}.

    Sessions are in the order of their numbers, not of their names. Turns without a text, such as images, are dropped
    and counted; place counts the others of a session from 0. Answers that are no strings are coerced and counted.
    """
    rows = _items(spark, path, multi_line).select(
        F.expr(_text("v", "$.sample_id")).alias("haystack_id"), F.expr("try_variant_get(v, '$.conversation', 'map<string,variant>')").alias("talk"),
        F.expr("try_variant_get(v, '$.qa', 'array<variant>')").alias("qa"), F.expr(_kind("v", "$.conversation")).alias("kind"))
    named = rows.filter("haystack_id IS NOT NULL")
    sessions = named.select("haystack_id", "talk", F.explode("talk").alias("key", "list")).filter(r"key rlike '^session_[0-9]+$'")
    sessions = sessions.withColumn("session", F.regexp_extract("key", "([0-9]+)$", 1).cast("long")).withColumn(
        "timestamp", F.expr(_text("try_element_at(talk, concat('session_', session, '_date_time'))"))).withColumn(
        "turns", F.expr("try_variant_get(list, '$', 'array<variant>')")).drop("talk", "list")
    said = sessions.select("haystack_id", "session", "key", "timestamp", F.posexplode("turns").alias("k", "t"))
    said = said.withColumn("object", F.expr("schema_of_variant(t) LIKE 'OBJECT%'")).withColumn(
        "text", F.expr(f"CASE WHEN {_kind('t', '$.text')} = 'STRING' THEN {_text('t', '$.text')} END")).withColumn("speaker", F.expr(_text("t", "$.speaker")))
    usable = (F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("object")
    kept = said.filter(usable)
    before = F.expr("size(filter(slice(turns, 1, k), x -> trim(coalesce(CASE WHEN coalesce(schema_of_variant(try_variant_get(x, '$.text', 'variant')), '') = 'STRING' THEN try_variant_get(x, '$.text', 'string') END, '')) <> ''))")
    places = sessions.select("haystack_id", "session", "turns", F.posexplode("turns").alias("k", "t")).select("haystack_id", "session", "k", before.cast("long").alias("place"))
    turns = kept.join(places, ["haystack_id", "session", "k"]).select(
        "haystack_id", "session", F.concat(F.lit("session_"), "session").alias("session_id"), "place", F.expr(_text("t", "$.dia_id")).alias("turn_id"), "speaker", "text", "timestamp")
    asked = named.select("haystack_id", F.posexplode("qa").alias("j", "q")).withColumn("question_id", F.concat_ws(":q", "haystack_id", "j"))
    category = F.expr("try_variant_get(q, '$.category', 'int')")
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    asked = asked.withColumn("code", category).withColumn("category", names[F.col("code")]).withColumn("declines", F.coalesce(F.col("code") == ADVERSARIAL, F.lit(False)))
    own = f"CASE WHEN declines AND {_kind('q', '$.adversarial_answer')} <> 'none' THEN {{0}} ELSE {{1}} END"
    asked = asked.withColumn("gold", F.expr(own.format(_gold("q", "$.adversarial_answer"), _gold("q", "$.answer")))).withColumn(
        "answer_kind", F.expr(own.format(_kind("q", "$.adversarial_answer"), _kind("q", "$.answer"))))
    coerced = ~F.col("answer_kind").isin("STRING", "none")
    evidence = F.expr(f"CASE WHEN {_kind('q', '$.evidence')} = 'STRING' THEN array({_text('q', '$.evidence')}) ELSE coalesce(transform(try_variant_get(q, '$.evidence', 'array<variant>'), x -> {_text('x')}), cast(array() as array<string>)) END")
    questions = asked.filter(F.col("category").isNotNull()).select(
        "question_id", "haystack_id", F.expr(_text("q", "$.question")).alias("text"), "category", "gold", coerced.alias("coerced"), evidence.alias("evidence"), "declines")
    place = "concat(haystack_id, '.', key)"
    talks = named.filter("kind LIKE 'OBJECT%'").join(sessions.select("haystack_id").distinct(), "haystack_id", "left")
    problems = _union([
        _say(rows.filter("haystack_id IS NULL"), "'?'", "no sample_id"), _say(named.filter("kind NOT LIKE 'OBJECT%'"), "haystack_id", "conversation is not an object"),
        _say(talks.join(sessions.select("haystack_id").distinct(), "haystack_id", "left_anti"), "haystack_id", "no sessions"),
        _say(sessions.select("haystack_id").distinct().join(kept.select("haystack_id").distinct(), "haystack_id", "left_anti"), "haystack_id", "no turn with a text"),
        _say(named.filter("qa IS NULL"), "haystack_id", "qa is not a list"), _say(sessions.filter("turns IS NULL"), place, "session is not a list"),
        _say(said.filter("NOT object"), f"concat({place}, ':', k)", "turn is not an object"), _say(kept.filter("speaker IS NULL"), f"concat({place}, ':', k)", "no speaker"),
        _say(asked.filter("code IS NULL"), "question_id", "category is not an integer"), _say(asked.filter("code IS NOT NULL AND category IS NULL"), "question_id", "unknown category"),
        _say(asked.filter(f"category IS NOT NULL AND NOT declines AND {_kind('q', '$.answer')} = 'none'"), "question_id", "no answer"),
        _say(asked.filter(f"{_text('q', '$.question')} IS NULL"), "question_id", "no question")])
    notes = said.filter(F.col("object") & ~usable).agg(F.count("*").alias("n")).select(F.lit("dropped turns without a text").alias("note"), "n").union(
        questions.filter("coerced").agg(F.count("*")).select(F.lit("coerced answers"), "count(1)"))
    return Scan(turns, questions, problems, notes)


def parallel_sessions(spark: SparkSession, path: str, multi_line: bool = True) -> Scan:
    """The second form: {question_id, question_type, question, answer, haystack_sessions: [[{role, content, has_answer}]], haystack_session_ids, haystack_dates}.

    Ids and dates go with the sessions by position; where the ids have another length the item is a problem and no
    part of it is read. Turns with has_answer are the question's evidence. Roles stay as they are; unknown ones are noted.
    """
    rows = _items(spark, path, multi_line).select(
        "v", F.expr(_text("v", "$.question_id")).alias("question_id"), F.expr(_text("v", "$.question_type")).alias("category"),
        *[F.expr(f"try_variant_get(v, '$.haystack_{c}', 'array<variant>')").alias(c) for c in ("sessions", "session_ids", "dates")])
    known = F.coalesce(F.col("category").isin(*QUESTION_TYPES), F.lit(False))
    ids = F.coalesce(F.size("session_ids"), F.lit(0))
    even = F.col("sessions").isNotNull() & ((F.col("session_ids").isNull()) | (ids == 0) | (ids == F.size("sessions")))
    good = rows.filter(F.col("question_id").isNotNull() & known & even & (F.size("sessions") > 0))
    each = good.select("question_id", "session_ids", "dates", F.posexplode("sessions").alias("n", "list")).select(
        "question_id", F.col("n").cast("long").alias("session"), F.coalesce(F.expr(_text("get(session_ids, n)")), F.concat(F.lit("session_"), "n")).alias("session_id"),
        F.expr(_text("get(dates, n)")).alias("timestamp"), F.expr("try_variant_get(list, '$', 'array<variant>')").alias("turns"))
    said = each.select("question_id", "session", "session_id", "timestamp", F.posexplode("turns").alias("k", "t")).withColumn(
        "text", F.expr(f"CASE WHEN {_kind('t', '$.content')} = 'STRING' THEN {_text('t', '$.content')} END")).withColumn("speaker", F.expr(_text("t", "$.role"))).withColumn(
        "turn_id", F.concat_ws(":", "session_id", "k"))
    kept = said.filter("trim(coalesce(text, '')) <> ''")
    turns = kept.select(F.col("question_id").alias("haystack_id"), "session", "session_id", F.col("k").cast("long").alias("place"), "turn_id", "speaker", "text", "timestamp")
    marked = kept.filter("try_variant_get(t, '$.has_answer', 'boolean')").groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("session", "k", "turn_id"))).alias("e"))
    questions = good.join(marked, "question_id", "left").select(
        "question_id", F.col("question_id").alias("haystack_id"), F.expr(_text("v", "$.question")).alias("text"), "category", F.expr(_gold("v", "$.answer")).alias("gold"),
        F.expr(f"{_kind('v', '$.answer')} NOT IN ('STRING', 'none')").alias("coerced"), F.coalesce(F.col("e.turn_id"), F.expr("cast(array() as array<string>)")).alias("evidence"),
        F.endswith("question_id", F.lit(DECLINED)).alias("declines"))
    place = "concat(question_id, '.', session)"
    named = rows.filter("question_id IS NOT NULL")
    problems = _union([
        _say(rows.filter("question_id IS NULL"), "'?'", "no question_id"), _say(named.filter(~known), "question_id", "unknown question_type"),
        _say(named.filter("sessions IS NULL"), "question_id", "haystack_sessions is not a list"), _say(named.filter("size(sessions) = 0"), "question_id", "no sessions"),
        _say(named.filter(F.col("sessions").isNotNull() & ~even), "question_id", "ids and sessions differ in length"),
        _say(each.filter("turns IS NULL"), place, "session is not a list"), _say(each.filter("size(turns) = 0"), place, "no turns"),
        _say(said.filter("trim(coalesce(text, '')) = ''"), f"concat({place}, ':', k)", "content is empty or not a string"),
        _say(said.filter("speaker IS NULL"), f"concat({place}, ':', k)", "no role"), _say(named.filter(f"{_text('v', '$.question')} IS NULL"), "question_id", "no question")])
    notes = kept.filter(~F.col("speaker").isin(*ROLES)).groupBy("speaker").agg(F.count("*").alias("n")).select(F.concat(F.lit("role "), "speaker").alias("note"), "n")
    return Scan(turns, questions, problems, notes)
