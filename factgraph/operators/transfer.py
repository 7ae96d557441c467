"""Moving facts between spaces: scope plans, target resolution, replay, health and audits of what is stored."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.graph import long_chains


def scope_plan(scopes: DataFrame, told: DataFrame, owners: DataFrame, there: DataFrame, writable: DataFrame) -> DataFrame:
    """(scope_id, target, problem): an explicit map (scope_id, target), else the owner's own scope, else the same id.

    owners (scope_id, target) names private scopes by their owner's scope; there and writable (scope_id) are the
    destination's scopes. A target that is not there is `missing`, one that may not be written `unwritable`.
    """
    rows = scopes.select("scope_id").distinct().join(told.withColumnRenamed("target", "explicit"), "scope_id", "left").join(
        owners.withColumnRenamed("target", "own"), "scope_id", "left").withColumn("target", F.coalesce("explicit", "own", "scope_id"))
    rows = rows.join(there.select(F.col("scope_id").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left").join(
        writable.select(F.col("scope_id").alias("target"), F.lit(True).alias("may")).distinct(), "target", "left")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("may").isNull(), "unwritable")
    return rows.select("scope_id", "target", problem.alias("problem"))


def supersede_targets(named: DataFrame, local: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq, name, target, how): a local id of the same run, else an exact title (the least id), else an id that is there."""
    titles = nodes.groupBy(F.col("title").alias("name")).agg(F.min("id").alias("by_title"))
    ids = nodes.select(F.col("id").cast("string").alias("name"), F.col("id").alias("by_id"))
    rows = named.join(local.select(F.col("name"), F.col("id").alias("by_local")), "name", "left").join(titles, "name", "left").join(ids, "name", "left")
    how = F.when(F.col("by_local").isNotNull(), "local").when(F.col("by_title").isNotNull(), "title").when(F.col("by_id").isNotNull(), "id").otherwise("unresolved")
    return rows.select("seq", "name", F.coalesce("by_local", "by_title", "by_id").alias("target"), how.alias("how"))


def replayed(incoming: DataFrame, matches: DataFrame, outcomes: DataFrame, plan: DataFrame) -> DataFrame:
    """(seq, action, target) of an import: what each row (seq, scope_id, status) of a bundle becomes.

    Rows of scopes with a problem are refused; rows that match stored content (id, match) are reused; others follow
    their outcome (seq, outcome, candidate), where a near duplicate within the bundle is kept as distinct and one of
    the destination is put up for review.
    """
    rows = incoming.join(plan, "scope_id", "left").join(matches.select(F.col("id").alias("seq"), "match"), "seq", "left").join(
        outcomes.select("seq", "outcome", "candidate"), "seq", "left")
    action = F.when(F.col("problem").isNotNull(), "refused").when(F.col("match").isNotNull(), "reused").when(
        F.col("outcome") == "pending", "review_queued").when(F.col("outcome") == "insert", "inserted").otherwise(F.coalesce("outcome", F.lit("inserted")))
    target = F.when(action == "reused", F.col("match")).when(action.isin("merged", "merge_linked", "review_queued"), F.col("candidate"))
    return rows.select("seq", action.alias("action"), target.alias("target"))


def import_summary(actions: DataFrame) -> DataFrame:
    """One row: counts by action; total leaves out what was refused or reused."""
    def n(*names):
        return F.sum(F.col("action").isin(*names).cast("long"))

    return actions.agg(n("inserted", "merged", "merge_linked", "review_queued").alias("total"), *[
        n(k).alias(k) for k in ("inserted", "merged", "merge_linked", "review_queued", "refused", "reused")])


def health(nodes: DataFrame, pending: DataFrame, errors: DataFrame, now: str) -> DataFrame:
    """(check, detail, n) of nodes (id, type, status, canonical, addenda as JSON) and pending (expires_at).

    errors (id, errors) is conformance() of the nodes. Checks: stale pendings, nonconforming rows by type, merges into
    rows that are not active, canonical chains over 3 hops, rows with over 20 addenda.
    """
    def line(df, check, detail=None):
        return df.agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), F.lit(detail).cast("string").alias("detail"), "n")

    wrong = nodes.filter("status = 'active'").join(errors.select("id"), "id", "left_semi").groupBy("type").agg(F.count("*").alias("n"))
    into = nodes.select(F.col("id").alias("canonical"), F.col("status").alias("to"))
    orphans = nodes.filter("status = 'merged'").join(into, "canonical").filter("to <> 'active'")
    links = nodes.select("id", F.when(F.col("status") == "merged", F.col("canonical")).alias("parent"))
    many = nodes.filter(F.size(F.from_json("addenda", "array<string>")) > 20)
    return line(pending.filter(F.col("expires_at") < F.lit(now).cast("timestamp")), "stale pendings").union(
        wrong.select(F.lit("nonconforming"), "type", "n")).union(line(orphans, "orphaned merges")).union(
        line(long_chains(links), "long chains")).union(line(many, "many addenda"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, rule) of nodes (id, type, space_id, status, canonical) and edges (src, dst, type) that break a reference.

    A merged row needs a canonical row and others have none; a canonical row is of the same space and type; edges
    have both ends, differ in them, and come once.
    """
    into = nodes.select(F.col("id").alias("canonical"), F.col("type").alias("ct"), F.col("space_id").alias("cs"), F.lit(True).alias("there"))
    rows = nodes.join(into, "canonical", "left")
    rule = F.when((F.col("status") == "merged") & F.col("canonical").isNull(), "merged without canonical").when(
        (F.col("status") != "merged") & F.col("canonical").isNotNull(), "canonical without merge").when(
        F.col("canonical").isNotNull() & F.col("there").isNull(), "canonical is missing").when(
        (F.col("ct") != F.col("type")) | (F.col("cs") != F.col("space_id")), "canonical of another kind")
    out = rows.select(F.col("id").cast("string").alias("item"), rule.alias("rule")).filter("rule IS NOT NULL")
    name = F.concat_ws(">", "src", "dst")
    for side in ("src", "dst"):
        lost = edges.join(nodes.select(F.col("id").alias(side)), side, "left_anti")
        out = out.union(lost.select(name.alias("item"), F.lit(f"{side} is missing").alias("rule")))
    twice = edges.groupBy("src", "dst", "type").count().filter("count > 1")
    return out.union(edges.filter("src = dst").select(name, F.lit("self loop"))).union(twice.select(name, F.lit("repeated edge")))


def touched(before: DataFrame, after: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """(id, updated_at): the time of a row stays unless one of its content columns has changed."""
    old = before.select("id", F.struct(*content).alias("old"), F.col("updated_at").alias("was"))
    rows = after.withColumn("new", F.struct(*content)).join(old, "id", "left")
    return rows.select("id", F.when(F.col("was").isNotNull() & F.col("new").eqNullSafe(F.col("old")), F.col("was")).otherwise(F.col("updated_at")).alias("updated_at"))


def promoted_addenda(nodes: DataFrame, linkable: DataFrame, novel: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows (id, pos, body, merged_at, band), edges (src, dst, type)) of addenda that say something new.

    nodes has (id, type, body, addenda as JSON [{body, merged_at, promoted_to}]). In order, an addendum without a
    promoted_to whose tokens overlap those of the body and of what was promoted before with a Jaccard similarity under
    `novel` becomes a row; its edge to the node needs a rule for the type. A node's addenda are one array of it.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    parsed = F.from_json("addenda", "array<struct<body:string,merged_at:string,promoted_to:string>>")
    rows = nodes.select("id", "type", words(F.col("body")).alias("own"), F.transform(parsed, lambda x, i: F.struct(
        i.alias("pos"), x["body"].alias("body"), x["merged_at"].alias("merged_at"), x["promoted_to"].alias("promoted_to"), words(x["body"]).alias("t"))).alias("a"))

    def step(state, x):
        share = F.size(F.array_intersect(state["corpus"], x["t"])) / F.size(F.array_union(state["corpus"], x["t"]))
        pick = x["promoted_to"].isNull() & (F.size(F.array_union(state["corpus"], x["t"])) > 0) & (share < novel)
        return F.when(pick, F.struct(F.array_union(state["corpus"], x["t"]).alias("corpus"), F.array_append(state["picks"], x["pos"]).alias("picks"))).otherwise(state)

    start = F.struct(F.col("own").alias("corpus"), F.expr("cast(array() as array<int>)").alias("picks"))
    picked = rows.withColumn("picks", F.aggregate("a", start, step, lambda s: s["picks"]))
    new = picked.select("id", "type", F.explode(F.filter("a", lambda x: F.array_contains("picks", x["pos"]))).alias("x")).select(
        "id", "type", "x.pos", "x.body", "x.merged_at", F.lit("merge_linked_promoted").alias("band"))
    edges = new.join(linkable, "type", "left_semi").select(F.concat_ws("#", "id", "pos").alias("src"), F.col("id").cast("string").alias("dst"), F.lit("same_topic").alias("type"))
    return new.drop("type"), edges


def stale_vectors(nodes: DataFrame, vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, dot): active nodes whose stored sparse vector (id, dim, w) is not that of their text; cosine under 0.9999."""
    live = nodes.filter("status = 'active'").select("id")
    norm = lambda v, name: v.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias(name))
    dots = vectors.join(fresh.withColumnRenamed("w", "v"), ["id", "dim"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    rows = live.join(dots, "id", "left").join(norm(vectors, "a"), "id", "left").join(norm(fresh, "b"), "id", "left")
    cosine = F.coalesce(F.col("dot") / F.sqrt((F.col("a") * F.col("b")).cast("double")), F.lit(0.0))
    return rows.filter((cosine < 0.9999) & F.col("b").isNotNull()).select("id", F.round(cosine, 6).alias("cosine"))
