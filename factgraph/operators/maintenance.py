"""Table audits: constraints, conformance, drift and content matches, as rows that name what is wrong."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import attrs as A
from factgraph.functions import text as X


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(id, rule) for each rule, an SQL predicate of what must hold, that a row breaks; an unknown result breaks it."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in rules.items()])
    return df.select(F.col(key).cast("string").alias("id"), F.explode(F.array_compact(broken)).alias("rule"))


def edge_violations(edges: DataFrame, types: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, type, reason): self loops, missing ends, and end types that no rule allows."""
    a, b = types.select(F.col("id").alias("src"), F.col("type").alias("ta")), types.select(F.col("id").alias("dst"), F.col("type").alias("tb"))
    legal = rules.select("type", F.col("src_type").alias("ta"), F.col("dst_type").alias("tb"), F.lit(True).alias("legal"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left").join(legal, ["type", "ta", "tb"], "left")
    reason = F.when(F.col("src") == F.col("dst"), "self loop").when(F.col("ta").isNull() | F.col("tb").isNull(), "missing end").when(
        F.col("legal").isNull(), "no rule")
    return rows.select("src", "dst", "type", reason.alias("reason")).filter("reason IS NOT NULL")


def conformance(attrs: DataFrame, required: list[str], values: dict[str, str], closed: bool = True) -> DataFrame:
    """(id, errors) of (id, attrs map<string, string>): missing keys, then unknown ones, then values that break their pattern."""
    missing = F.filter(F.array(*map(F.lit, sorted(required))), lambda k: ~F.array_contains(F.map_keys("attrs"), k))
    known = F.array(*map(F.lit, sorted(values)))
    unknown = F.array_sort(F.filter(F.map_keys("attrs"), lambda k: ~F.array_contains(known, k)))
    bad = [F.when(F.map_contains_key("attrs", k) & ~F.coalesce(F.col("attrs")[k].rlike(f"^(?:{p})$"), F.lit(False)), F.lit(k))
           for k, p in sorted(values.items())]
    errors = F.concat(
        F.transform(missing, lambda k: F.concat(F.lit("missing "), k)),
        F.transform(unknown, lambda k: F.concat(F.lit("unknown "), k)) if closed else F.expr("cast(array() as array<string>)"),
        F.transform(F.array_compact(F.array(*bad)), lambda k: F.concat(F.lit("bad "), k)))
    return attrs.select("id", errors.alias("errors"))


def content_matches(incoming: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """(id, match): the earliest stored row (by created_at, id) whose columns all equal the incoming row's."""
    digest = F.sha2(F.concat_ws("\0", *columns).cast("binary"), 256)
    order = Window.partitionBy("digest", *columns).orderBy("created_at", "id")
    first = stored.select(*columns, "id", "created_at", digest.alias("digest")).withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return incoming.select("id", *columns, digest.alias("digest")).join(
        first.select("digest", *columns, F.col("id").alias("match")), ["digest", *columns]).select("id", "match")


def drift(old: DataFrame, new: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """(key..., change): rows that are missing, extra or changed in `new`."""
    a = old.select(*key, F.struct(*value).alias("a"))
    b = new.select(*key, F.struct(*value).alias("b"))
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).filter("change IS NOT NULL")


def compared(one: DataFrame, two: DataFrame, key: str, content: str, group) -> DataFrame:
    """(group, n, same, changed, missing, extra) of two copies (key, content): rows that only one side has count too.

    Contents are equal null to null; a key that repeats meets each row of that key on the other side.
    """
    a = one.select(key, F.col(content).alias("a"), F.lit(True).alias("in_a"))
    b = two.select(key, F.col(content).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    rows = a.join(b, key, "full_outer").select(group.alias("group"), state.alias("state"))
    return rows.groupBy("group").agg(F.count("*").alias("n"), *[F.sum((F.col("state") == k).cast("long")).alias(k) for k in ("same", "changed", "missing", "extra")])


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The current snapshot of an append-only log: each key's row of greatest seq."""
    return log.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter("rn = 1").drop("rn")


def reembed_summary(nodes: DataFrame, stamp: str) -> DataFrame:
    """(scope_id, scanned, current, stale, surface_changed, to_embed) of nodes with stamp, surface and stored_surface."""
    stale, changed = F.col("stamp") != stamp, ~F.col("surface").eqNullSafe(F.col("stored_surface"))

    def n(c):
        return F.sum(c.cast("long"))

    return nodes.groupBy("scope_id").agg(
        F.count("*").alias("scanned"), n(~stale).alias("current"), n(stale).alias("stale"), n(changed).alias("surface_changed"),
        n(stale | changed).alias("to_embed"))


def reembedded(nodes: DataFrame, stamp: str, embed=None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(id, dim, w, stamp) of nodes whose stamp or surface is out of date; rows that are current are not read further.

    embed takes (id, text) and gives (id, dim, w); the default hashes tokens. A run that is repeated after its result
    was stored finds nothing to do.
    """
    due = nodes.filter((F.col("stamp") != stamp) | ~F.col("surface").eqNullSafe(F.col("stored_surface")))
    text = A.prefixed(A.searchable_text(F.col("title"), F.col("body"), F.col("surface")), "document", prefixes or {})
    rows = due.select("id", text.alias("text"))
    vectors = embed(rows) if embed else X.hashed_vectors(rows, "id", F.col("text"))
    return vectors.withColumn("stamp", F.lit(stamp))
