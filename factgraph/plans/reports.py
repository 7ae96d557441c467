"""Registered queries of evaluation tables and reports, and the SQL that checks them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from factgraph.functions import attrs as A
from factgraph.functions import scoring as rules
from factgraph.operators import evaluation as E
from factgraph.operators import retrieval as R
from factgraph.operators import tiles
from factgraph.plans.registry import LEGS_SQL, OUTCOMES_SQL, PAIRS_SQL, legs, outcomes, query
from factgraph.runtime import materialize, table
from factgraph.sources import derived as S

ANSWERS_SQL = ("answers AS (SELECT d.doc_id AS item, 'arm' || (d.doc_id % 2) AS arm, lang AS category, CAST(quality AS BIGINT) AS correct, CAST(toxic AS BIGINT) AS abstained, d.doc_id % 17 = 0 AS reader_error, "
               "d.doc_id % 19 = 0 AS judge_error, n_chars AS bytes, n_chars * 7 % 997 AS ms, d.doc_id % 5 = 0 AS declined FROM documents d JOIN labels l USING (doc_id))")


def answers(spark, sf_dir):
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        n.alias("item"), F.concat(F.lit("arm"), n % 2).alias("arm"), F.col("lang").alias("category"), F.col("quality").cast("long").alias("correct"),
        F.col("toxic").cast("long").alias("abstained"), (n % 17 == 0).alias("reader_error"), (n % 19 == 0).alias("judge_error"), F.col("n_chars").alias("bytes"),
        (F.col("n_chars") * 7 % 997).alias("ms"), (n % 5 == 0).alias("declined"))


def rank_sql(value, p):
    return f"max(CASE WHEN r_{value} = greatest(1, least(n_all, CAST(round_even({p} * n_all / 100.0 + 0.5, 0) AS BIGINT))) THEN {value} END)"


@query(f"{ANSWERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, category ORDER BY bytes) AS r_bytes, row_number() OVER (PARTITION BY arm, category ORDER BY ms) AS r_ms, count(*) OVER (PARTITION BY arm, category) AS n_all FROM answers), "
       f"g AS (SELECT arm, category, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(abstained) AS BIGINT) AS abstained, count(*) FILTER (reader_error) AS reader_errors, count(*) FILTER (judge_error) AS judge_errors, avg(bytes) AS m, "
       f"{rank_sql('bytes', 50)} AS bytes_p50, {rank_sql('bytes', 95)} AS bytes_p95, {rank_sql('ms', 50)} AS ms_p50, {rank_sql('ms', 95)} AS ms_p95 FROM r GROUP BY ALL), p AS (SELECT *, CAST(correct AS DOUBLE) / n AS p, 1.96::DOUBLE AS z FROM g) "
       "SELECT arm, category, n, correct, round(p, 4) AS accuracy, round(greatest(0e0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, "
       "round(least(1e0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high, abstained, reader_errors, judge_errors, round(m, 4) AS bytes_mean, round(p / (m / 1000), 6) AS per_kb, bytes_p50, bytes_p95, ms_p50, ms_p95 FROM p")
def accuracy_report(spark, sf_dir):
    return E.full_accuracy(answers(spark, sf_dir), ["arm", "category"])


@query(f"{ANSWERS_SQL} SELECT arm, category, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS scope, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct FROM answers GROUP BY GROUPING SETS ((arm), (arm, category)) "
       "UNION ALL SELECT arm, NULL, 'without declines', count(*), CAST(sum(correct) AS BIGINT) FROM answers WHERE abstained = 0 GROUP BY arm")
def accuracy_sets(spark, sf_dir):
    return E.accuracy_sets(answers(spark, sf_dir))


@query(f"{ANSWERS_SQL}, f AS (SELECT arm, CASE WHEN correct = 1 THEN 'correct' WHEN abstained = 1 THEN 'reader-over-answered' WHEN item % 3 = 0 THEN 'unattributed' WHEN bytes % 10 >= 5 THEN 'reader-miss' WHEN ms % 10 >= 5 THEN 'retrieval-miss' ELSE 'extraction-miss' END AS mode FROM answers) "
       "SELECT arm, mode, count(*) AS n FROM f GROUP BY ALL")
def failure_modes(spark, sf_dir):
    shares = F.when(F.col("item") % 3 != 0, (F.col("bytes") % 10) / 10), (F.col("ms") % 10) / 10
    mode = E.failure_mode(F.col("correct") == 1, F.col("abstained") == 1, *shares)
    return answers(spark, sf_dir).select("arm", mode.alias("mode")).groupBy("arm", "mode").agg(F.count("*").alias("n"))


@query("WITH one AS (SELECT doc_id AS item, quality AS a FROM labels WHERE doc_id % 17 <> 0), two AS (SELECT doc_id AS item, CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS b FROM labels WHERE doc_id % 19 <> 0) "
       "SELECT count(*) AS n, count(*) FILTER (a <> b) AS changed, round(count(*) FILTER (a <> b) / count(*), 6) AS rate FROM one JOIN two USING (item)")
def grader_instability(spark, sf_dir):
    rows, n = table(spark, sf_dir, "labels"), F.col("doc_id")
    one = rows.select(n.alias("item"), F.col("quality").alias("correct"), (n % 17 == 0).alias("error"))
    two = rows.select(n.alias("item"), F.when(n % 6 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("correct"), (n % 19 == 0).alias("error"))
    return E.disagreement(one, two)


@query("WITH a AS (SELECT doc_id - doc_id % 2 AS item, doc_id % 2 AS arm, quality FROM labels) SELECT item, x.quality AS first, y.quality AS second FROM (SELECT * FROM a WHERE arm = 0) x JOIN (SELECT * FROM a WHERE arm = 1) y USING (item)")
def paired_answers(spark, sf_dir):
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select((n - n % 2).alias("item"), F.concat(F.lit("arm"), n % 2).alias("arm"), F.col("quality").alias("correct"))
    return E.paired(rows, ("arm0", "arm1"))


LABELLED_SQL = (OUTCOMES_SQL + ", s AS (SELECT doc_id AS seq, lang || (n_chars % 7) AS cls, CASE WHEN doc_id % 11 = 0 THEN 'contradiction' ELSE 'restated' END AS kind, doc_id > min(doc_id) OVER (PARTITION BY lang || (n_chars % 7)) AS again FROM documents), "
                "o AS (SELECT seq, outcome, candidate FROM outcomes)")


@query(f"{LABELLED_SQL}, r AS (SELECT s.*, o.outcome, w.cls AS owner, outcome IN ('merged', 'merge_linked') AS merged, s.kind = 'contradiction' AS against FROM s JOIN o USING (seq) LEFT JOIN s w ON w.seq = o.candidate), "
       "t AS (SELECT count(*) FILTER (merged AND NOT against AND owner = cls) AS within, count(*) FILTER (merged AND NOT against AND owner <> cls) AS across, count(*) FILTER (merged AND against) AS contradictions, count(*) FILTER (merged AND NOT against AND owner IS NULL) AS unattributed, "
       "count(*) FILTER (again AND NOT against) AS opportunities, count(*) FILTER (outcome = 'pending') AS waiting, count(*) FILTER (outcome IN ('insert', 'merge_linked')) AS nodes, count(DISTINCT cls) AS classes, count(*) AS writes FROM r) "
       "SELECT within, across, contradictions, unattributed, opportunities, round(CASE WHEN within + across > 0 THEN within / (within + across) ELSE 1e0 END, 6) AS precision, round(CASE WHEN within + across + contradictions > 0 THEN within / (within + across + contradictions) ELSE 1e0 END, 6) AS precision_all, "
       "round(CASE WHEN opportunities > 0 THEN within / opportunities ELSE 0e0 END, 6) AS recall, round(nodes / classes, 6) AS growth, round(waiting / writes, 6) AS confirm_rate FROM t")
def dedup_quality(spark, sf_dir):
    n, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    stream = docs.select(n.alias("seq"), F.concat("lang", F.col("n_chars") % 7).alias("cls"), F.when(n % 11 == 0, "contradiction").otherwise("restated").alias("kind"))
    return E.dedup_quality(stream, outcomes(spark, sf_dir)[2])


@query(f"{LABELLED_SQL}, d AS (SELECT source, outcome FROM o JOIN documents ON doc_id = seq) SELECT source, count(*) AS total, count(*) FILTER (outcome = 'insert') AS \"insert\", count(*) FILTER (outcome = 'merged') AS merged, "
       "count(*) FILTER (outcome = 'merge_linked') AS merge_linked, count(*) FILTER (outcome = 'pending') AS pending FROM d GROUP BY source")
def ingest_tally(spark, sf_dir):
    """What became of the written facts, by source."""
    rows = outcomes(spark, sf_dir)[2].join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "source"), "seq")
    return E.outcome_tally(rows, ["source"], ("insert", "merged", "merge_linked", "pending"))


@query("SELECT lang AS extractor, count(*) AS drafts, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(CASE WHEN doc_id % 4 = 3 THEN 1e0 ELSE 0e0 END), 6) AS confirm_rate, round(sum(n_chars) / 1000.0, 3) AS seconds FROM documents GROUP BY lang")
def extractor_costs(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("extractor")).agg(
        F.count("*").alias("drafts"), F.sum("n_chars").alias("chars"), F.round(F.avg((F.col("doc_id") % 4 == 3).cast("double")), 6).alias("confirm_rate"),
        F.round(F.sum("n_chars") / 1000.0, 3).alias("seconds"))


@query(f"{PAIRS_SQL}, l AS (SELECT a || '-' || b AS pair, similarity, a % 3 = b % 3 AS same FROM pairs), x AS (SELECT max((similarity, pair)) FILTER (NOT same) AS b, min((similarity, pair)) FILTER (same) AS a FROM l) "
       "SELECT b[1] AS low, b[2] AS low_pair, a[1] AS high, a[2] AS high_pair, round(a[1] - b[1], 6) AS width, CASE WHEN a[1] > b[1] THEN round((a[1] + b[1]) / 2, 6) END AS middle FROM x")
def threshold_window(spark, sf_dir):
    """All pairs, those of copies too, which are counted by class; tiles hand on their ends. Texts without tokens or without a type are in no pair."""
    v = materialize(tiles.packed_vectors(S.nodes(spark, sf_dir).select("id", F.col("type").alias("block"), "title", "body"), "id", "block"), "vectors")
    members = materialize(tiles.vector_classes(v).withColumn("label", F.col("id") % 3), "members")
    labels = members.groupBy(F.col("rep").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(label + 2 AS int))")).alias("labels"))
    return E.class_window(members, tiles.ends(v.join(labels, "id"), 0.9))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_rows(spark, sf_dir):
    return E.not_done(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, regexp_replace(substr(coalesce(text, ''), 1, 80), '\\s+\\S*$', '') AS cut FROM conversations) "
       "SELECT conv_id, turn, CASE WHEN length(text) <= 80 THEN text WHEN cut = '' THEN substr(text, 1, 80) ELSE cut END AS title, length(text) AS body_chars FROM c")
def turn_drafts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return E.drafts(turns).select("conv_id", "turn", "title", F.length("body").alias("body_chars"))


@query("WITH t AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS seq, conv_id, role || turn AS title FROM conversations), s AS (SELECT conv_id, min(seq) AS start FROM t GROUP BY conv_id) "
       "SELECT s.conv_id, string_agg(t.title, ',' ORDER BY t.seq) AS priors FROM s JOIN t ON t.seq < start AND t.seq >= start - 20 GROUP BY s.conv_id")
def prior_titles(spark, sf_dir):
    turns = E.numbered(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    found = E.prior_titles(turns.select("seq", "conv_id", F.concat("role", "turn").alias("title")), 20)
    return found.select("conv_id", F.array_join("priors", ",").alias("priors"))


@query(f"{ANSWERS_SQL}, g AS (SELECT item, CASE WHEN abstained = 1 THEN 'adversarial' WHEN declined THEN 'declined' WHEN correct = 1 THEN 'correct' ELSE 'wrong' END AS \"group\" FROM answers) "
       "SELECT item, \"group\" FROM g QUALIFY row_number() OVER (PARTITION BY \"group\" ORDER BY sha256('r:' || item)) <= 10")
def replay_groups(spark, sf_dir):
    return E.replay_groups(answers(spark, sf_dir), 10, "r")


@query(f"{ANSWERS_SQL} SELECT item, arm, category FROM (SELECT *, row_number() OVER (PARTITION BY arm, category ORDER BY sha256('g:' || item)) AS turn FROM answers) ORDER BY turn, arm, category LIMIT 60")
def grading_order(spark, sf_dir):
    return E.stratified_sample(answers(spark, sf_dir).select("item", "arm", "category"), "item", ["arm", "category"], "g", 60).select("item", "arm", "category")


@query(f"{ANSWERS_SQL} SELECT item, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('cal:' || arm || ':' || item)) AS turn FROM answers) ORDER BY turn, category LIMIT 40")
def calibration_sample(spark, sf_dir):
    rows = answers(spark, sf_dir).select("item", "category", F.concat_ws(":", "arm", "item").alias("name"))
    return E.stratified_sample(rows, "name", "category", "cal", 40).select("item", "category")


@query("WITH q AS (SELECT item_id % 30 AS question_id, item_id * 3 AS conv_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE text END AS gold, item_id % 8 = 0 AS declines FROM benchmark) SELECT item, problem FROM ("
       "SELECT conv_id || ':' || turn AS item, 'empty speaker' AS problem FROM conversations WHERE coalesce(role, '') = '' UNION ALL SELECT conv_id || ':' || turn, 'empty text' FROM conversations WHERE coalesce(text, '') = '' "
       "UNION ALL SELECT conv_id || ':' || turn, 'repeated turn' FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1 UNION ALL SELECT CAST(question_id AS VARCHAR), 'repeated question' FROM q GROUP BY question_id HAVING count(*) > 1 "
       "UNION ALL SELECT CAST(question_id AS VARCHAR), 'unknown conversation' FROM q WHERE conv_id NOT IN (SELECT conv_id FROM conversations) UNION ALL SELECT CAST(question_id AS VARCHAR), 'missing gold' FROM q WHERE NOT declines AND gold = '')")
def corpus_problems(spark, sf_dir):
    n = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select((n % 30).alias("question_id"), (n * 3).alias("conv_id"), F.when(n % 4 == 0, "").otherwise(F.col("text")).alias("gold"), (n % 8 == 0).alias("declines"))
    return E.corpus_problems(table(spark, sf_dir, "conversations"), asked)


FORM_SQL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"{LEGS_SQL}, ev AS (SELECT item_id AS request_id, d.lang AS category, substr({FORM_SQL.format('b.text')}, 1, 60) AS head FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), "
       f"best AS (SELECT request_id, min(place) AS best FROM ev JOIN placed USING (request_id) JOIN nodes n USING (id) WHERE contains({FORM_SQL.format('n.body')}, head) GROUP BY request_id), r AS (SELECT k, category, best FROM ev LEFT JOIN best USING (request_id), (VALUES (1), (5), (10)) t(k)) "
       "SELECT k, category, count(*) AS turns, count(*) FILTER (best <= k) AS found FROM r GROUP BY GROUPING SETS ((k), (k, category))")
def evidence_sweep(spark, sf_dir):
    nodes, vector, lexical = legs(spark, sf_dir)
    found = R.fused(vector, lexical, nodes).join(nodes.select("id", A.plain_form(F.col("body")).alias("form")), "id").select("request_id", "place", "form")
    asked = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("category")), "item_id")
    return E.evidence_sweep(found, asked.select(F.col("item_id").alias("request_id"), "category", A.plain_form(F.col("text")).alias("form")), (1, 5, 10))


@query(f"{LEGS_SQL}, p AS (SELECT item_id AS request_id, lower(split_part(text, ' ', 5)) AS answer FROM benchmark), h AS (SELECT request_id, max(CASE WHEN contains(lower(body), answer) THEN 1 ELSE 0 END) AS hit, sum(octet_length(encode(body))) AS bytes FROM p JOIN placed USING (request_id) JOIN nodes USING (id) WHERE place <= 5 GROUP BY request_id) "
       "SELECT count(*) AS probes, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS hits, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes FROM p LEFT JOIN h USING (request_id)")
def probe_hits(spark, sf_dir):
    nodes, vector, lexical = legs(spark, sf_dir)
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.lower(F.split_part("text", F.lit(" "), F.lit(5))).alias("answer"))
    return E.probe_hits(R.fused(vector, lexical, nodes), nodes, probes, 5)


def event_answers(spark, sf_dir):
    """(item, arm, gold, answer, correct, adversarial): what a user did on which day, and replies that tell it in several forms from the event before."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("kind", F.coalesce(F.lag("event_type").over(before), F.lit("nothing"))).withColumn("then", F.coalesce(F.lag("ts").over(before), "ts"))
    part = F.when(F.dayofmonth("then") <= 10, "early").when(F.dayofmonth("then") <= 20, "mid").otherwise("late")
    n, day = F.col("event_id"), F.date_format("ts", "d MMMM yyyy")
    answer = (
        F.when(n % 6 == 0, F.concat(F.lit("It was "), "kind", F.lit(", then "), "event_type", F.date_format("ts", "', on' yyyy-MM-dd")))
        .when(n % 6 == 1, F.concat(part, F.date_format("then", " MMMM yyyy"), F.lit(": "), "event_type"))
        .when(n % 6 == 2, F.concat(F.lit("before "), day, F.lit(", "), "event_type", F.lit(" and "), "kind"))
        .when(n % 6 == 3, F.lit("INSUFFICIENT")).when(n % 6 == 4, F.concat("event_type", F.date_format("then", "' in' MMM yyyy"))))
    return rows.select(
        n.alias("item"), F.concat(F.lit("arm"), F.col("user_id") % 2).alias("arm"), F.concat("event_type", F.lit(" and "), "kind", F.lit(", "), day).alias("gold"),
        answer.alias("answer"), (F.col("value") >= 50).alias("correct"), (F.col("event_type") == "error").alias("adversarial"))


@query()
def rescored_answers(spark, sf_dir):
    """The rule-based score of each reply; tests hold it against a plain version."""
    return rules.rescored(event_answers(spark, sf_dir)).select("item", "n_parts", F.round("coverage", 6).alias("coverage"), "covered", "is_answer")


@query()
def fair_scores(spark, sf_dir):
    """Strict, fair and partial accuracy of each arm."""
    return rules.fair_scores(event_answers(spark, sf_dir))
