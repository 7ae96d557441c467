"""Line-delimited JSON: scans of facts with the reasons for refused lines, space bundles, and review files."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.runtime import materialize

#: The keys of a fact line, and the kinds of a bundle line.
REQUIRED, OPTIONAL = ("type", "title", "body"), ("attrs", "links")
KINDS = ("header", "scope", "node_type", "node", "edge")
VERSION = 1


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines numbered from 1 in each file, however files are split.

    The lines of a split are numbered as they are read and written once; the splits of a file are then counted, and
    prefix sums over them, a row for each split, give the number that a split starts with.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    read = materialize(read, "lines")
    splits = read.groupBy("file", "start").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("low")).alias("base"))
    return read.join(splits, ["file", "start"]).select("file", (F.col("at") + F.col("base")).alias("line"), "value")


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of JSON files: good has the fact's columns, bad (file, line, value, reason). Blank lines are skipped, but count.

    attrs and links stay JSON.
    """
    lines = numbered_lines(spark, path).filter("trim(value) <> ''")
    kind = F.substring(F.ltrim("value"), 1, 1)
    parsed = lines.withColumn("fact", F.when(kind == "{", F.expr("try_variant_get(try_parse_json(value), '$', 'map<string,variant>')")))
    fields = {k: F.expr(f"to_json(fact['{k}'])") for k in REQUIRED + OPTIONAL}
    known = F.array(*[F.lit(k) for k in REQUIRED + OPTIONAL])
    extra = F.array_sort(F.filter(F.map_keys("fact"), lambda k: ~F.array_contains(known, k)))
    reason = F.when(F.col("fact").isNull(), F.when(kind == "{", "invalid JSON").otherwise("not an object"))
    reason = reason.when(F.size(extra) > 0, F.concat(F.lit("unknown key "), extra[0]))
    for k in REQUIRED:
        text = F.coalesce(F.expr(f"try_variant_get(fact['{k}'], '$', 'string')"), F.lit(""))
        reason = reason.when(~F.coalesce(fields[k].startswith('"'), F.lit(False)) | (F.trim(text) == ""), f"missing {k}")
    reason = reason.when(fields["attrs"].isNotNull() & ~fields["attrs"].startswith("{"), "attrs is not an object")
    reason = reason.when(fields["links"].isNotNull() & ~fields["links"].startswith("["), "links is not a list")
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(
        *[F.expr(f"variant_get(fact['{k}'], '$', 'string')").alias(k) for k in REQUIRED], *[fields[k].alias(k) for k in OPTIONAL])
    return good, judged.filter("reason IS NOT NULL").select("file", "line", "value", "reason")


def bundle(nodes: DataFrame, edges: DataFrame, scopes: DataFrame) -> dict[str, DataFrame]:
    """The tables of an export: the scopes given, their nodes, node types in use, and edges with both ends exported."""
    kept = nodes.join(scopes.select("scope_id"), "scope_id", "left_semi")
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return {"scope": scopes, "node_type": kept.select(F.col("type").alias("name")).distinct(), "node": kept, "edge": inside}


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A folder for each kind, of lines {"kind", ...}, and a header with the counts; kinds are written and read apart."""
    spark = tables["node"].sparkSession
    counts = {}
    for kind, df in tables.items():
        df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value")).write.text(f"{path}/part={kind}")
        counts[kind] = spark.read.text(f"{path}/part={kind}").count()
    header = spark.range(1).select(F.to_json(F.struct(
        F.lit("header").alias("kind"), F.lit(VERSION).alias("version"), *[F.lit(n).alias(k) for k, n in counts.items()])).alias("value"))
    header.write.text(f"{path}/part=header")


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle by kind; raises ValueError on a wrong version, an unknown kind or a count that differs."""
    lines = spark.read.text(path)
    head = lines.filter("part = 'header'").select(F.from_json("value", "version int, " + ", ".join(f"{k} long" for k in schemas)).alias("h")).select("h.*").take(2)
    if len(head) != 1 or head[0]["version"] != VERSION:
        raise ValueError("a bundle needs one header of a known version")
    kinds = {r["part"]: r["n"] for r in lines.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each kind
    if set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds {sorted(set(kinds) - set(KINDS))}")
    wrong = [k for k in schemas if kinds.get(k, 0) != (head[0][k] or 0)]
    if wrong:
        raise ValueError(f"counts differ from the header for {wrong}")
    return {k: lines.filter(F.col("part") == k).select(F.from_json("value", s).alias("r")).select("r.*") for k, s in schemas.items()}


def read_bundle_file(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle in one file of lines {"kind", ...}, whose first line is the header.

    Raises ValueError on a first line that is no header of a known version, on further headers, unknown kinds, and
    lines that are no objects, naming the first of them. Blank lines are skipped.
    """
    lines = numbered_lines(spark, path).filter("trim(value) <> ''").withColumn("kind", F.get_json_object("value", "$.kind"))
    head = lines.filter("line = 1").select("kind", F.get_json_object("value", "$.version").cast("int").alias("version")).take(2)
    if len(head) != 1 or tuple(head[0]) != ("header", VERSION):
        raise ValueError("line 1: a bundle starts with one header of a known version")
    wrong = lines.filter((F.col("line") > 1) & ~F.coalesce(F.col("kind").isin(*[k for k in KINDS if k != "header"]), F.lit(False)))
    first = wrong.agg(F.min(F.struct("line", "kind")).alias("x")).first().x
    if first is not None:
        raise ValueError(f"line {first.line}: unknown kind {first.kind}")
    return {k: lines.filter(F.col("kind") == k).select(F.from_json("value", s).alias("r")).select("r.*") for k, s in schemas.items()}


def write_review(rows: DataFrame, path: str) -> bool:
    """rows as CSV files with a header, arrays joined by semicolons; nothing is written when there are none."""
    if rows.isEmpty():
        return False
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.option("header", True).option("escape", '"').csv(path)
    return True
