"""URL filters by a sort-merge range join, by native functions only.

A rule (host, path) holds for its host and all subdomains and for paths that start with its path. The key of a
host and path is the host's labels in reverse, a separator and the path; a rule is the interval of the keys that
it prefixes. Each URL asks once per ancestor host that a rule could name. Rules and questions are range-sorted
together; a sweep hands each question the stack of rules open at its place, innermost last.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; both empty where the URL is null or has no ://."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def reversed_host(labels):
    return F.array_join(F.reverse(labels), ".")


def key_of(labels, path):
    return F.concat(reversed_host(labels), F.lit("\0"), path)


def with_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): a rule's key, and the rules whose intervals hold its own, itself last.

    The rules of a host that enclose a rule have a prefix of its path; they are looked up for each length that a
    path of that host has, so a stack is no longer than a path.
    """
    rules = rules.select(
        "host", "path", "verdict", F.concat("host", "path").alias("rule"),
        key_of(F.split("host", F.lit(r"\.")), F.col("path")).alias("key"))
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))
    asks = rules.join(sizes, "host").select("host", "path", "key", F.explode("sizes").alias("n")).filter("n <= length(path)").select(
        "host", F.col("key").alias("own"), F.expr("substring(path, 1, n)").alias("path"))
    return asks.join(rules, ["host", "path"]).groupBy("own").agg(
        F.array_sort(F.collect_list(F.struct("key", "rule", "verdict"))).alias("stack")).withColumnRenamed("own", "key")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: host (lower case), path, verdict ('allow' or 'block'). The longest rule that fits wins, of equally long
    ones that of the longer host, of repeated ones the greatest verdict; rules with a null are left out. Where none fits, rule is null and
    verdict is `default`. Null URLs have an empty host and path; repeated rows stay; columns of pages named host,
    path, rule or verdict are replaced.
    """
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    depth = rules.agg(F.max(F.size(F.split("host", F.lit(r"\."))))).first()[0] or 0
    pages = with_parts(pages.drop("rule", "verdict"), url)
    labels = F.split("host", F.lit(r"\."))
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth))))
    asks = (
        pages.select("host", "path").distinct()
        .withColumn("level", F.explode(levels))
        .select(key_of(F.slice(labels, -F.col("level"), F.col("level")), F.col("path")).alias("key"),
                F.lit(1).alias("kind"), F.xxhash64("host", "path").alias("tie"), "host", "path",
                F.expr("cast(null as array<struct<key: string, rule: string, verdict: string>>)").alias("stack")))
    opens = with_stacks(rules).select(
        "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"), "stack")
    ranged = materialize(asks.unionByName(opens).repartitionByRange("key", "kind", "tie")
                         .withColumn("part", F.spark_partition_id()), "urls")
    sweep = Window.partitionBy("part").orderBy("key", "kind", "tie")
    ends = ranged.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("carried"))
    # A row for each range partition: a bound that the session sets, not the data.
    carried = ends.select("part", F.last("carried", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(
        sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("kind = 1")
    swept = swept.join(F.broadcast(carried), "part", "left").withColumn("open", F.coalesce("open", "carried"))
    fits = F.filter("open", lambda x: F.startswith(F.col("key"), x["key"]))
    best = swept.withColumn("top", F.try_element_at(fits, F.lit(-1))).filter("top IS NOT NULL").groupBy("host", "path").agg(
        F.max(F.struct(F.length("top.rule").alias("n"), F.length("top.key").alias("k"), "top.rule", "top.verdict")).alias("top"))
    return pages.join(best, ["host", "path"], "left").select(
        *[pages[c] for c in pages.columns], F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def op7(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.sql("""SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS t(host, path, verdict)""")
    return url_verdicts(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
found AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host AS host, parts.path AS path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN found ON parts.host = found.host AND parts.path = found.path
"""
