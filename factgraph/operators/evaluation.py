"""Usage rollups, samples, percentiles and quality aggregates of evaluation tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as X
from factgraph.runtime import materialize

METRICS = ("facts_stored", "duplicates_prevented", "questions_asked", "answered", "promotes")
#: Which metrics an event counts towards.
METRIC_OF = {"signup": ("facts_stored",), "click": ("duplicates_prevented",), "view": ("questions_asked", "answered"),
             "error": ("questions_asked",), "purchase": ("promotes",)}


def usage_rollup(events: DataFrame) -> DataFrame:
    """(principal, metric, day, n): counts by UTC day."""
    metric = F.lit(None).cast("array<string>")
    for kind, names in METRIC_OF.items():
        metric = F.when(F.col("event_type") == kind, F.array(*map(F.lit, names))).otherwise(metric)
    return events.select("principal", F.explode(metric).alias("metric"), F.to_date("ts").alias("day")).groupBy(
        "principal", "metric", "day").agg(F.count("*").alias("n"))


def stats_series(rollup: DataFrame, last_day, days: int) -> DataFrame:
    """(day, one column for each metric) for the `days` days up to last_day, zero where nothing happened."""
    spark = rollup.sparkSession
    calendar = spark.range(max(1, min(3650, days))).select(F.date_sub(F.lit(last_day).cast("date"), F.col("id").cast("int")).alias("day"))
    wide = rollup.groupBy("day").pivot("metric", list(METRICS)).agg(F.sum("n"))
    return calendar.join(wide, "day", "left").fillna(0, list(METRICS))


#: Parts that a group's values are cut into by rank before one of them is sorted.
PARTS = 64


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """(by..., p<k>...): the value of rank round-half-even(k / 100 * n + 0.5), within 1 and n; null values do not count.

    Approximate quantiles cut each group into parts; counts of the parts tell which holds a rank, and only those parts
    are sorted, so a group of any size is dealt to many tasks.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    shares = F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])
    cuts = rows.groupBy(*by).agg(F.percentile_approx("v", shares, 10_000).alias("cuts"), F.count("*").alias("n"))
    rank = [F.greatest(F.lit(1), F.least(F.col("n"), F.expr(f"cast(bround({p} * n / 100.0 + 0.5) as bigint)"))) for p in percents]
    parts = rows.join(cuts, by).select(*by, "v", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part"))
    counts = parts.groupBy(*by, "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    asked = cuts.select(*by, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), r.alias("rank")) for p, r in zip(percents, rank)])).alias("q")).select(*by, "q.*")
    held = asked.join(counts, by).filter("rank > before AND rank <= before + own").select(*by, "part", "p", (F.col("rank") - F.col("before")).alias("place"))
    wanted = parts.join(held.select(*by, "part").distinct(), [*by, "part"], "left_semi")
    order = Window.partitionBy(*by, "part").orderBy("v")
    found = wanted.withColumn("place", F.row_number().over(order)).join(held, [*by, "part", "place"])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def stratified_sample(df: DataFrame, key: str, category, seed: str, n: int) -> DataFrame:
    """n rows dealt round robin over the categories, each in the order of a seeded hash; the first n of each can count."""
    by = [category] if isinstance(category, str) else list(category)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(digest))
    return df.withColumn("turn", rn).filter(F.col("turn") <= n).orderBy("turn", *by).limit(n)


def turn_windows(turns: DataFrame, size: int, overlap: int) -> DataFrame:
    """(conv_id, window, first, last, n): runs of `size` turns of a session, `overlap` shared, the last one ends with it."""
    step = size - overlap
    per = turns.groupBy("conv_id").agg(F.count("*").alias("total"))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - size) / step)).cast("int")
    return per.select("conv_id", "total", F.explode(F.sequence(F.lit(0), last)).alias("window")).select(
        "conv_id", "window", (F.col("window") * step + 1).cast("long").alias("first"),
        F.least(F.col("total"), F.col("window") * step + size).alias("last")).withColumn("n", F.col("last") - F.col("first") + 1)


def accuracy(answers: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, correct, accuracy, low, high, abstained): with the Wilson 95 % interval."""
    rows = answers.groupBy(*by).agg(F.count("*").alias("n"), F.sum("correct").alias("correct"), F.sum("abstained").alias("abstained"))
    low, high = X.wilson(F.col("correct"), F.col("n"))
    return rows.select(*by, "n", "correct", F.round(F.col("correct") / F.col("n"), 4).alias("accuracy"),
                       F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "abstained")


def first_seen(stream: DataFrame, cls: str, seq: str) -> DataFrame:
    """stream with `opportunity`: whether the class came earlier in the stream."""
    first = stream.groupBy(cls).agg(F.min(seq).alias("first"))
    return stream.join(first, cls).withColumn("opportunity", F.col("first") < F.col(seq)).drop("first")


def evidence_of(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(request_id, id): docs (id, text) whose text holds a question's text (request_id, q) as it is.

    The rarest token inside the question, its ends aside, is a token of such a doc: an equi-join on it nominates
    docs. Questions without an inner token meet every substring of their length instead.
    """
    words = F.filter(F.split("q", r"[^\p{L}\p{N}]+"), lambda x: x != "")
    inner = questions.select("request_id", "q", F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).alias("inner"))
    tokens = docs.select("id", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("token"))
    asked = inner.select("request_id", F.explode("inner").alias("token"))
    met = tokens.join(asked.select("token").distinct(), "token", "left_semi")
    rare = asked.join(met.groupBy("token").agg(F.count("*").alias("df")), "token", "left").groupBy("request_id").agg(
        F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    likely = rare.join(met, "token").select("request_id", "id")
    short = inner.filter("size(inner) = 0 AND q <> ''")
    sizes = short.select(F.length("q").alias("size")).distinct()
    pieces = docs.join(sizes, F.length("text") >= F.col("size")).select("id", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("text") - F.col("size") + 1), lambda i: F.substring("text", i, F.col("size")))).alias("q")).distinct()
    found = likely.join(questions, "request_id").join(docs, "id").filter(F.contains("text", "q")).select("request_id", "id")
    return found.union(pieces.join(short, "q").select("request_id", "id"))


def recall_at(results: DataFrame, evidence: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, questions, recalled): questions with evidence of which a result of place k or better is evidence."""
    hit = results.join(evidence, ["request_id", "id"]).groupBy("request_id").agg(F.min("place").alias("best"))
    asked = evidence.select("request_id").distinct().join(hit, "request_id", "left")
    return asked.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "best").groupBy("k").agg(
        F.count("*").alias("questions"), F.sum((F.coalesce("best", F.lit(1 << 30)) <= F.col("k")).cast("long")).alias("recalled"))


def majority(passes: DataFrame) -> DataFrame:
    """(item, passes, verdict) of gradings (item, correct, error): an error in any pass wins, then more than half."""
    right = F.sum(F.col("correct").cast("long")) * 2 > F.count("*")
    return passes.groupBy("item").agg(F.count("*").alias("passes"), F.when(F.max("error"), "error").when(right, "correct").otherwise("wrong").alias("verdict"))


def losses(refusals: DataFrame) -> DataFrame:
    """(cause, n, sample) of refusals (cause, detail, seq): how many, and the detail of the first."""
    return refusals.groupBy("cause").agg(F.count("*").alias("n"), F.min_by("detail", "seq").alias("sample"))


def full_accuracy(answers: DataFrame, by: list[str]) -> DataFrame:
    """accuracy() with errors, payload and latency of answers (correct, abstained, reader_error, judge_error, bytes, ms)."""
    sums = answers.groupBy(*by).agg(
        F.sum(F.col("reader_error").cast("long")).alias("reader_errors"), F.sum(F.col("judge_error").cast("long")).alias("judge_errors"),
        F.round(F.avg("bytes"), 4).alias("bytes_mean"), F.round(F.sum("correct") / F.count("*") / (F.avg("bytes") / 1000), 6).alias("per_kb"))
    out = accuracy(answers, by).join(sums, by)
    for c in ("bytes", "ms"):
        out = out.join(nearest_rank(answers, by, c, (50, 95)).withColumnsRenamed({"p50": f"{c}_p50", "p95": f"{c}_p95"}), by)
    return out


def accuracy_sets(answers: DataFrame) -> DataFrame:
    """(arm, category, scope, n, correct): by arm, by arm without questions to decline, and by arm and category."""
    sets = answers.groupingSets([("arm",), ("arm", "category")], "arm", "category").agg(
        F.count("*").alias("n"), F.sum("correct").alias("correct"), F.grouping("category").alias("whole"))
    told = sets.select("arm", "category", F.when(F.col("whole") == 1, "overall").otherwise("category").alias("scope"), "n", "correct")
    some = answers.filter("abstained = 0").groupBy("arm").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    return told.union(some.select("arm", F.lit(None).cast("string"), F.lit("without declines"), "n", "correct"))


def failure_mode(correct, declines, in_context, in_store):
    """Why an answer failed, from shares of gold in the context and in the store; 0.5 counts as supported."""
    context, store = in_context >= 0.5, in_store >= 0.5
    return F.when(correct, "correct").when(declines, "reader-over-answered").when(context, "reader-miss").when(
        ~context & store, "retrieval-miss").when(~context & ~store, "extraction-miss").otherwise("unattributed")


def paired(answers: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """(item, first, second) of items answered in both arms."""
    a, b = (answers.filter(F.col("arm") == arm).select("item", F.col("correct").alias(name)) for arm, name in zip(arms, ("first", "second")))
    return a.join(b, "item")


def dedup_quality(stream: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of quality of outcomes (seq, outcome, candidate) over a labelled stream (seq, cls, kind).

    A node belongs to the class of the write that made it. Merges across classes and of contradictions destroy facts;
    an opportunity is a write, no contradiction, whose class came earlier.
    """
    rows = first_seen(stream, "cls", "seq").join(outcomes.select("seq", "outcome", "candidate"), "seq")
    owner = stream.select(F.col("seq").alias("candidate"), F.col("cls").alias("owner"))
    rows = rows.join(owner, "candidate", "left")
    merged, against = F.col("outcome").isin("merged", "merge_linked"), F.col("kind") == "contradiction"

    def n(c):
        return F.sum(F.coalesce(c, F.lit(False)).cast("long"))

    out = rows.agg(
        n(merged & ~against & (F.col("owner") == F.col("cls"))).alias("within"), n(merged & ~against & (F.col("owner") != F.col("cls"))).alias("across"),
        n(merged & against).alias("contradictions"), n(merged & ~against & F.col("owner").isNull()).alias("unattributed"),
        n(F.col("opportunity") & ~against).alias("opportunities"), n(F.col("outcome") == "pending").alias("waiting"),
        n(F.col("outcome").isin("insert", "merge_linked")).alias("nodes"), F.count_distinct("cls").alias("classes"), F.count("*").alias("writes"))

    def share(a, b, none):
        return F.round(F.when(b > 0, a / b).otherwise(none), 6)

    merges, bad = F.col("within") + F.col("across"), F.col("across") + F.col("contradictions")
    return out.select(
        "within", "across", "contradictions", "unattributed", "opportunities", share(F.col("within"), merges, 1.0).alias("precision"),
        share(merges + F.col("contradictions") - bad, merges + F.col("contradictions"), 1.0).alias("precision_all"),
        share(F.col("within"), F.col("opportunities"), 0.0).alias("recall"), share(F.col("nodes"), F.col("classes"), 0.0).alias("growth"),
        share(F.col("waiting"), F.col("writes"), 0.0).alias("confirm_rate"))


def evidence_sweep(results: DataFrame, evidence: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, category, turns, found): evidence (request_id, category, form) whose first 60 characters a returned body of rank k has.

    results is (request_id, place, form) in plain form; category null is overall.
    """
    head = evidence.withColumn("head", F.substring("form", 1, 60)).filter("head <> ''").withColumn("turn", F.monotonically_increasing_id())
    hit = head.join(results.select("request_id", "place", F.col("form").alias("body")), "request_id").filter(F.contains("body", "head"))
    best = hit.groupBy("turn").agg(F.min("place").alias("best"))
    rows = head.join(best, "turn", "left").select("category", "best", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return rows.groupingSets([("k",), ("k", "category")], "k", "category").agg(
        F.count("*").alias("turns"), F.sum((F.coalesce("best", F.lit(1 << 30)) <= F.col("k")).cast("long")).alias("found"))


def disagreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: items graded twice without an error, how many verdicts differ, and their share."""
    both = one.filter("NOT error").select("item", F.col("correct").alias("a")).join(two.filter("NOT error").select("item", F.col("correct").alias("b")), "item")
    return both.agg(F.count("*").alias("n"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("changed")).withColumn(
        "rate", F.round(F.when(F.col("n") > 0, F.col("changed") / F.col("n")).otherwise(0.0), 6))


def outcome_tally(outcomes: DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    """(by..., total, one column for each outcome name) of outcome rows."""
    return outcomes.groupBy(*by).agg(F.count("*").alias("total"), *[F.sum((F.col("outcome") == k).cast("long")).alias(k) for k in names])


def threshold_window(pairs: DataFrame) -> DataFrame:
    """One row for labelled pairs (pair, similarity, same): the highest that must stay below, the lowest that must reach.

    A threshold in (low, high] separates them; there is none where low >= high.
    """
    out = pairs.agg(F.max(F.when(~F.col("same"), F.struct("similarity", "pair"))).alias("b"), F.min(F.when(F.col("same"), F.struct("similarity", "pair"))).alias("a"))
    return window_row(out.select(F.col("b.similarity").alias("low"), F.col("b.pair").alias("low_pair"), F.col("a.similarity").alias("high"), F.col("a.pair").alias("high_pair")))


def window_row(ends: DataFrame) -> DataFrame:
    width = F.col("high") - F.col("low")
    return ends.select("low", "low_pair", "high", "high_pair", F.round(width, 6).alias("width"), F.when(width > 0, F.round((F.col("high") + F.col("low")) / 2, 6)).alias("middle"))


def class_window(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """threshold_window() of all pairs of members (id, rep, label), `a-b` with a < b, same where their labels are equal.

    Members of one rep are copies, with similarity 1; others have that of their reps, of which pairs (a, b, similarity)
    has those in reach. Copies count in full, but their pairs are not made: the labels in two classes tell which kinds
    of pairs they have, and among the classes that meet at an end's similarity the greatest id of each label tells
    whether a member is the lesser id of such a pair. Ids are integers; there are few labels, and none is null.
    """
    tops = members.groupBy("rep", "label").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    classes = materialize(tops.groupBy("rep").agg(F.collect_list(F.struct("label", "n", "top")).alias("tops")), "classes")
    one, two = (classes.select(F.col("rep").alias(k), F.col("tops").alias(f"tops_{k}")) for k in "ab")
    own = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"), F.col("tops").alias("tops_a"), F.col("tops").alias("tops_b"))
    met = pairs.select("a", "b", "similarity").join(one, "a").join(two, "b").select(own.columns).union(own)
    here, there = (F.transform(f"tops_{k}", lambda x: x["label"]) for k in "ab")
    same = F.when(F.col("a") == F.col("b"), F.exists("tops_a", lambda x: x["n"] > 1)).otherwise(F.arrays_overlap(here, there))
    links = materialize(met.select("a", "b", "similarity", same.alias("same"), (F.size(F.array_union(here, there)) > 1).alias("other")), "links")
    ends = materialize(links.agg(F.max(F.when(F.col("other"), F.col("similarity"))).alias("low"), F.min(F.when(F.col("same"), F.col("similarity"))).alias("high")), "ends")

    def end(kind, value, pick):
        """One row with the first or last by name of the pairs of a kind that have the end's similarity."""
        tied = links.filter(kind).join(F.broadcast(ends), F.col("similarity") == F.col(value)).select("a", "b")
        ways = materialize(tied.union(tied.select("b", "a")).toDF("rep", "near").distinct(), "ways")
        held = ways.join(classes.select(F.col("rep").alias("near"), F.explode("tops").alias("x")), "near").groupBy("rep", F.col("x.label").alias("label")).agg(F.max("x.top").alias("top"))
        held = materialize(held.groupBy("rep").agg(F.collect_list(F.struct("label", "top")).alias("held")), "held")  # a join of its own, so that a large class can be split

        def fits(label, mine):
            return label == mine if kind == "same" else label != mine

        lesser = members.join(held, "rep").filter(F.exists("held", lambda x: (x["top"] > F.col("id")) & fits(x["label"], F.col("label"))))
        lesser = lesser.agg(pick(F.struct(F.col("id").cast("string").alias("name"), "id", "rep", "label")).alias("x"))
        near = ways.join(F.broadcast(lesser), F.col("rep") == F.col("x.rep")).select(F.col("near").alias("rep"), "x")
        greater = members.join(near, "rep").filter((F.col("id") > F.col("x.id")) & fits(F.col("label"), F.col("x.label")))
        return greater.agg(pick(F.concat("x.name", F.lit("-"), F.col("id").cast("string"))).alias(f"{value}_pair"))

    return window_row(ends.crossJoin(end("other", "low", F.max)).crossJoin(end("same", "high", F.min)))


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no finished row has: what a resumed run has left to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def drafts(turns: DataFrame, size: int = 80) -> DataFrame:
    """(conv_id, turn, title, body): one node of each turn; a long title ends at a word."""
    cut = F.regexp_replace(F.substring("text", 1, size), r"\s+\S*\z", "")
    title = F.when(F.length("text") <= size, F.col("text")).when(cut == "", F.substring("text", 1, size)).otherwise(cut)
    return turns.select("conv_id", "turn", title.alias("title"), F.col("text").alias("body"))


def prior_titles(titles: DataFrame, n: int = 200) -> DataFrame:
    """(conv_id, priors): the titles of the last n turns (seq, conv_id, title) before each conversation starts.

    Only turns among the last n before some start count, found by rank ranges, so no history is gathered whole.
    """
    starts = titles.groupBy("conv_id").agg(F.min("seq").alias("start"))
    back = starts.select("conv_id", "start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - n), F.col("start") - 1)).alias("seq")).filter("seq < start AND seq >= 0")
    return back.join(titles.select("seq", "title"), "seq").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]).alias("priors"))


def replay_groups(answers: DataFrame, n: int, seed: str) -> DataFrame:
    """(item, group): the first n by hash of each of declined, correct, wrong and adversarial answers."""
    group = F.when(F.col("abstained") == 1, "adversarial").when(F.col("declined"), "declined").when(F.col("correct") == 1, "correct").otherwise("wrong")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item").cast("string")).cast("binary"), 256)
    rows = answers.select("item", group.alias("group"), digest.alias("digest"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("group").orderBy("digest"))).filter(F.col("rn") <= n).select("item", "group")


def corpus_problems(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """(item, problem) of turns (conv_id, turn, role, text) and questions (question_id, conv_id, gold, declines)."""
    place = F.concat_ws(":", "conv_id", "turn")

    def say(df, item, problem):
        return df.select(item.cast("string").alias("item"), F.lit(problem).alias("problem"))

    q = F.col("question_id")
    return say(turns.filter("coalesce(role, '') = ''"), place, "empty speaker").union(
        say(turns.filter("coalesce(text, '') = ''"), place, "empty text")).union(
        say(turns.groupBy("conv_id", "turn").count().filter("count > 1"), place, "repeated turn")).union(
        say(questions.groupBy("question_id").count().filter("count > 1"), q, "repeated question")).union(
        say(questions.join(turns.select("conv_id").distinct(), "conv_id", "left_anti"), q, "unknown conversation")).union(
        say(questions.filter("NOT declines AND coalesce(gold, '') = ''"), q, "missing gold"))


def probe_hits(results: DataFrame, nodes: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """One row: probes (request_id, answer), how many have the answer in a body of the first k, and the bytes of those bodies."""
    top = results.filter(F.col("place") <= k).join(nodes.select("id", "body"), "id").join(probes, "request_id")
    per = top.groupBy("request_id").agg(F.max(F.contains(F.lower("body"), F.col("answer"))).alias("hit"), F.sum(F.octet_length("body")).alias("bytes"))
    return probes.join(per, "request_id", "left").agg(
        F.count("*").alias("probes"), F.sum(F.coalesce("hit", F.lit(False)).cast("long")).alias("hits"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with seq, gapless from 0 in the order of the columns: range partitions are counted, then numbered apart."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("nth", inside).join(base, "part").withColumn("seq", F.col("base") + F.col("nth") - 1).drop("part", "nth", "base")
