"""Type registries as tables: loading, validation, conformance of attributes, upgrades and drift.

A spec is one row for each declared key: (type, section, key, kind, choices, searchable), section required or optional,
kind string, int, number, bool, date or enum. Conditions are (type, pos, when_key, equals, key).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import attrs as A

KINDS = ("string", "int", "number", "bool", "date", "enum")


def concrete_rules(rules: DataFrame, types: DataFrame) -> DataFrame:
    """(type, src_type, dst_type) with `*` on either side expanded to every type (name)."""
    names = types.select("name").distinct()
    for c in ("src_type", "dst_type"):
        every = rules.filter(F.col(c) == "*").drop(c).join(names.withColumnRenamed("name", c))
        rules = rules.filter(F.col(c) != "*").unionByName(every)
    return rules.select("type", "src_type", "dst_type").distinct()


def searchable_keys(spec: DataFrame) -> DataFrame:
    """(type, key) whose values are searched: as said, else strings and dates; reserved keys never."""
    return spec.filter(~F.col("key").isin(*A.RESERVED) & F.coalesce("searchable", F.col("kind").isin("string", "date"))).select("type", "key").distinct()


def value_error(kind, choices, key, v):
    """Message of a value (variant) that does not fit its declared kind, else null."""
    of, text = A.json_type(v), F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))
    number = F.call_function("try_variant_get", v, F.lit("$"), F.lit("double"))
    whole = F.coalesce(number == F.floor(number), F.lit(False))
    name = F.concat(F.lit("attrs."), key)
    wrong = {"string": of != "string", "int": (of != "number") | ~whole, "number": of != "number", "bool": of != "boolean"}
    message = F.when(kind == "enum", F.when((of != "string") | ~F.coalesce(F.array_contains(choices, text), F.lit(False)),
                                            F.concat(name, F.lit(" must be one of "), F.array_join(choices, "|"))))
    for k, bad in wrong.items():
        message = message.when((kind == k) & bad, F.concat(name, F.lit(f" must be a {k}")))
    message = message.when((kind == "string") & (F.length(text) > 2000), F.concat(name, F.lit(" must be at most 2000 characters")))
    shape = (of == "string") & text.rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$")
    return message.when((kind == "date") & ~F.coalesce(shape, F.lit(False)), F.concat(name, F.lit(" must be a date"))).when(
        (kind == "date") & ~A.is_partial_date(text), F.concat(name, F.lit(" must be a valid ISO date")))


def conformance(nodes: DataFrame, spec: DataFrame, conditions: DataFrame, open_types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(errors (id, errors array), dropped (id, key, value, error)) of nodes (id, type, attrs as JSON objects).

    Errors come by phase: required keys that are absent (one in the object `dropped` counts as present), keys that a
    condition asks for in its order, unknown keys unless the type is in open_types (type), then values. Only the last
    kind is droppable: its value can be set aside under `dropped` and the row kept. JSON null is present.
    """
    rows = nodes.select("id", "type", A.members(F.col("attrs")).alias("m")).withColumn(
        "aside", F.map_keys(F.call_function("try_variant_get", F.col("m")["dropped"], F.lit("$"), F.lit("map<string,variant>"))))
    keys = rows.select("id", "type", F.explode("m").alias("key", "v"))
    known = spec.select("type", "key", "kind", "choices")

    def message(phase, place, text):
        return F.struct(F.lit(phase).alias("phase"), place.alias("place"), text.alias("text")).alias("e")

    first = rows.join(spec.filter("section = 'required'").select("type", "key"), "type").filter(
        ~F.map_contains_key("m", F.col("key")) & ~F.coalesce(F.array_contains("aside", F.col("key")), F.lit(False)))
    first = first.select("id", message(1, F.col("key"), F.concat(F.lit("attrs."), "key", F.lit(" is required"))))
    told = F.call_function("try_variant_get", F.col("m")[F.col("when_key")], F.lit("$"), F.lit("string"))
    asked = rows.join(conditions, "type").filter(
        (A.json_type(F.col("m")[F.col("when_key")]) == "string") & (told == F.col("equals")) & ~F.map_contains_key("m", F.col("key")))
    second = asked.select("id", message(2, F.lpad(F.col("pos").cast("string"), 9, "0"), F.concat(
        F.lit("attrs."), "key", F.lit(" is required when "), "when_key", F.lit("="), "equals")))
    stray = keys.filter(~F.col("key").isin(*A.RESERVED)).join(known.select("type", "key"), ["type", "key"], "left_anti")
    if open_types is not None:
        stray = stray.join(open_types, "type", "left_anti")
    third = stray.select("id", message(3, F.col("key"), F.concat(F.lit("attrs."), "key", F.lit(" is not allowed (closed spec)"))))
    wrong = keys.join(known, ["type", "key"]).withColumn("error", value_error(F.col("kind"), F.col("choices"), F.col("key"), F.col("v"))).filter(
        "error IS NOT NULL")
    fourth = wrong.select("id", message(4, F.col("key"), F.col("error")))
    every = first.union(second).union(third).union(fourth).groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    errors = every.select("id", F.transform("e", lambda x: x["text"]).alias("errors"))
    return errors, wrong.select("id", "key", F.to_json("v").alias("value"), "error")


def registry_problems(types: DataFrame, spec: DataFrame, edge_types: DataFrame, rules: DataFrame) -> DataFrame:
    """(item, problem): names, kinds and references that do not fit, over all registries at once."""
    shaped = "^[a-z][a-z0-9_]{0,62}$"
    names = types.select("name").union(edge_types.select("name")).filter(~F.col("name").rlike(shaped)).select(F.col("name").alias("item"), F.lit("bad name").alias("problem"))
    kinds = spec.filter(~F.col("kind").isin(*KINDS)).select(F.concat_ws(".", "type", "key").alias("item"), F.lit("bad kind").alias("problem"))
    kept = spec.filter(F.col("key").isin(*A.RESERVED)).select(F.concat_ws(".", "type", "key").alias("item"), F.lit("reserved key").alias("problem"))
    lone = spec.select("type").distinct().join(types.select(F.col("name").alias("type")), "type", "left_anti").select(
        F.col("type").alias("item"), F.lit("spec of unknown type").alias("problem"))
    ends = rules.select("type", F.explode(F.array("src_type", "dst_type")).alias("name")).filter("name <> '*'").join(types.select("name"), "name", "left_anti")
    ends = ends.select(F.concat_ws(".", "type", "name").alias("item"), F.lit("rule of unknown type").alias("problem"))
    loose = rules.select(F.col("type").alias("name")).join(edge_types.select("name"), "name", "left_anti").select(
        F.col("name").alias("item"), F.lit("rule of unknown edge type").alias("problem"))
    out = names
    for df in (kinds, kept, lone, ends, loose):
        out = out.union(df)
    return out.distinct()


def upgrade_plan(old: DataFrame, new: DataFrame, live: DataFrame, broken: DataFrame) -> DataFrame:
    """(type, step, blocked) from specs old to new: added, tightened and removed types.

    live (type, n) counts the rows of a type and broken (type, n) those that the new spec would refuse. A removal is
    blocked by live rows, a change by refused ones; an upgrade is applied only if no step is blocked.
    """
    def shape(spec, name):
        return spec.groupBy("type").agg(F.array_sort(F.collect_set(F.to_json(F.struct("section", "key", "kind", "choices")))).alias(name))

    both = shape(old, "a").join(shape(new, "b"), "type", "full_outer").filter("NOT (a <=> b)")
    step = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").otherwise("change")
    rows = both.withColumn("step", step).join(live.withColumnRenamed("n", "live"), "type", "left").join(
        broken.withColumnRenamed("n", "broken"), "type", "left").fillna(0, ["live", "broken"])
    return rows.select("type", "step", F.when(F.col("step") == "remove", F.col("live")).when(
        F.col("step") == "change", F.col("broken")).otherwise(0).alias("blocked"))


def resolved_thresholds(writes: DataFrame, config: DataFrame, low: float, high: float) -> DataFrame:
    """writes (seq, space_id, low, high) with t_low and t_high: the caller's, else the space's config row, else defaults.

    config is (space_id, key, value as JSON). A value that is not a number, or bounds that are not 0 < low <= high <= 1,
    are an error of the job.
    """
    def set_for(key):
        number = F.when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col("value").cast("double")).otherwise(
            F.raise_error(F.concat(F.lit(f"{key} is not a number: "), "value")).cast("double"))
        return config.filter(F.col("key") == key).select("space_id", number.alias(key))

    rows = writes.join(set_for("t_low"), "space_id", "left").join(set_for("t_high"), "space_id", "left").select(
        "seq", "space_id", F.coalesce("low", "t_low", F.lit(low)).alias("t_low"), F.coalesce("high", "t_high", F.lit(high)).alias("t_high"))
    fine = (F.col("t_low") > 0) & (F.col("t_low") <= F.col("t_high")) & (F.col("t_high") <= 1)
    return rows.withColumn("t_low", F.when(fine, F.col("t_low")).otherwise(F.raise_error(F.lit("thresholds must be 0 < low <= high <= 1")).cast("double")))


def shape_errors(writes: DataFrame, sentinel: str = "sentinel") -> DataFrame:
    """(seq, reason) of writes (seq, type, attrs, links as JSON) that are refused: reserved type or attribute, bad links."""
    m = A.members(F.coalesce("attrs", F.lit("{}")))
    links = F.from_json("links", "array<struct<type:string,target:string>>")
    reason = F.when(F.col("type") == sentinel, "reserved type").when(m.isNull(), "attrs is not an object").when(
        F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, A.RESERVED))), "reserved attribute").when(
        F.col("links").isNotNull() & (~F.ltrim("links").startswith("[") | links.isNull() | F.exists(links, lambda x: x["type"].isNull() | x["target"].isNull())), "bad link")
    return writes.select("seq", reason.alias("reason")).filter("reason IS NOT NULL")
