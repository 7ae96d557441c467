"""Lifecycles of facts: pages of pending and inbox rows, parking, resolving, superseding, updating and linking."""

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 100


def page(df: DataFrame, by: list[str], limit: int, offset: int, *order) -> DataFrame:
    """Rows offset + 1 to offset + limit of each group, with their `place` and whether `more` follow.

    The limit is clamped to 1 to 100. Ranking keeps offset + limit + 1 rows of a group, before the shuffle too.
    """
    last = max(0, offset) + max(1, min(MAX_PAGE, limit))
    rows = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= last + 1)
    more = F.max("place").over(Window.partitionBy(*by)) > last
    return rows.withColumn("more", more).filter((F.col("place") > max(0, offset)) & (F.col("place") <= last))


def inbox_visible(inbox: DataFrame, readable: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal, inbox columns): rows of no scope are for everybody, others for those who may read the scope."""
    everybody = inbox.filter("scope_id IS NULL").join(principals)
    scoped = inbox.join(readable.select("principal", "scope_id"), "scope_id")
    return scoped.unionByName(everybody)


def expired(pending: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Rows whose time has come at `now`: created_at + hours is not after it."""
    return pending.filter(F.col("created_at") + F.expr(f"INTERVAL '{hours}' HOUR") <= F.expr(f"timestamp'{now}'"))


def parked(bands: DataFrame, candidates: DataFrame) -> DataFrame:
    """(seq, candidates): writes of the pending band with their nearest candidates, nearest first.

    candidates has the few best of each write (seq, candidate, rank), so the array is small.
    """
    near = candidates.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("near"))
    return bands.filter("band = 'pending'").select("seq").join(near, "seq").select(
        "seq", F.transform("near", lambda x: x["candidate"]).alias("candidates"))


def resolved(verdicts: DataFrame, parked_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq, outcome, target) of (seq, verdict, late): how a parked write ends.

    late rows and merges into an inactive nearest candidate expire; merge takes the nearest candidate as target;
    distinct inserts, and is related to the nearest candidate that is still active, if any.
    """
    snapshot = parked_.select("seq", F.posexplode("candidates").alias("rank", "id")).join(nodes.select("id", "status"), "id", "left")
    active = F.col("status") == "active"
    best = snapshot.groupBy("seq").agg(
        F.min_by("id", "rank").alias("nearest"), F.min_by(F.coalesce(active, F.lit(False)), "rank").alias("alive"),
        F.min(F.when(active, F.struct("rank", "id")))["id"].alias("related"))
    merges = F.col("verdict") == "merge"
    outcome = F.when(F.col("late") | (merges & ~F.col("alive")), "expired").when(merges, "merged").otherwise("inserted")
    rows = verdicts.join(best, "seq").withColumn("outcome", outcome)
    return rows.select("seq", "outcome", F.when(F.col("outcome") == "merged", F.col("nearest")).when(
        F.col("outcome") == "inserted", F.col("related")).alias("target"))


def triaged(inbox: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, status) of inbox rows after decisions (id, action, band), one for a row at most.

    A discarded row is `discarded`; a promoted one is `promoted` once its write has ended, and stays while the write
    waits in the pending band. Rows that were not pending, or of which nothing was decided, keep their status.
    """
    rows = inbox.select("id", "status").join(decisions.select("id", "action", "band"), "id", "left")
    ended = (F.col("action") == "promote") & (F.col("band") != "pending")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("action") == "discard", "discarded").when(ended, "promoted")
    return rows.select("id", status.otherwise(F.col("status")).alias("status"))


def superseded(requests: DataFrame, nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """(new, old, outcome) of (new, old): a new fact replaces an active one of its type unless it was parked or merged.

    `superseded` flips the old fact and links the two; `downgraded` keeps it, `related` where only the types differ;
    an old fact that is not there is `missing`.
    """
    old = nodes.select(F.col("id").alias("old"), F.col("type").alias("old_type"), F.col("status").alias("old_status"))
    new = nodes.select(F.col("id").alias("new"), F.col("type").alias("new_type"))
    rows = requests.join(new, "new").join(old, "old", "left").join(
        bands.select(F.col("seq").alias("new"), "band"), "new", "left")
    outcome = (
        F.when(F.col("old_status").isNull(), "missing")
        .when((F.col("old_status") != "active") | F.col("band").isin("pending", "merge"), "downgraded")
        .when(F.col("old_type") != F.col("new_type"), "related").otherwise("superseded"))
    return rows.select("new", "old", outcome.alias("outcome"))


def updated(updates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, outcome, title, body, need_reembed) of updates (id, title, body), null meaning unchanged.

    Unknown ids are `missing`, archived ones `rejected`; both keep what was stored. need_reembed says whether the
    text that is searched has changed.
    """
    stored = nodes.select("id", F.col("title").alias("t"), F.col("body").alias("b"), "status")
    rows = updates.join(stored, "id", "left")
    outcome = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "active", "rejected").otherwise("updated")
    title = F.when(outcome == "updated", F.coalesce("title", "t")).otherwise(F.col("t"))
    body = F.when(outcome == "updated", F.coalesce("body", "b")).otherwise(F.col("b"))
    changed = ~(title.eqNullSafe(F.col("t")) & body.eqNullSafe(F.col("b")))
    return rows.select("id", outcome.alias("outcome"), title.alias("title"), body.alias("body"), changed.alias("need_reembed"))


def linked(proposals: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(src, dst, type, outcome) for each distinct proposal: attached, or why not.

    seen holds the visible nodes (id, status); what is not among them is `missing`, like what does not exist.
    """
    ends = seen.select("id", "status")
    rows = (
        proposals.dropDuplicates(["src", "dst", "type"])
        .join(ends.select(F.col("id").alias("src"), F.col("status").alias("sa")), "src", "left")
        .join(ends.select(F.col("id").alias("dst"), F.col("status").alias("sb")), "dst", "left")
        .join(edges.select("src", "dst", "type").distinct().withColumn("known", F.lit(True)), ["src", "dst", "type"], "left"))
    outcome = (
        F.when(F.col("src") == F.col("dst"), "self loop").when(F.col("sa").isNull() | F.col("sb").isNull(), "missing")
        .when((F.col("sa") == "archived") | (F.col("sb") == "archived"), "archived").when(F.col("known"), "skipped").otherwise("attached"))
    return rows.select("src", "dst", "type", outcome.alias("outcome"))


def remapped(edges: DataFrame, ids: DataFrame, present: DataFrame) -> DataFrame:
    """(src, dst, type, outcome): edges with both ends taken through (old, new); repeats after mapping count once.

    An end without a new id is kept as it was and makes the edge `unmapped`.
    """
    a, b = ids.select(F.col("old").alias("src"), F.col("new").alias("na")), ids.select(F.col("old").alias("dst"), F.col("new").alias("nb"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left").select(
        F.coalesce("na", "src").alias("src"), F.coalesce("nb", "dst").alias("dst"), "type",
        (F.col("na").isNull() | F.col("nb").isNull()).alias("lost")).distinct()
    known = present.select("src", "dst", "type").distinct().withColumn("known", F.lit(True))
    outcome = F.when(F.col("lost"), "unmapped").when(F.col("src") == F.col("dst"), "same node").when(F.col("known"), "present").otherwise("added")
    return rows.join(known, ["src", "dst", "type"], "left").select("src", "dst", "type", outcome.alias("outcome"))


def recall_statistics(surfaced: DataFrame) -> DataFrame:
    """(id, recalls, last) of surfaced (id, ts)."""
    return surfaced.groupBy("id").agg(F.count("*").alias("recalls"), F.max("ts").alias("last"))


def admitted(events: DataFrame, limits: dict[str, int], window_s: int = 60) -> DataFrame:
    """(event_id, key, kind, admitted) of events (event_id, key, kind, s), s in whole seconds.

    At most limits[kind] events of a key and kind are admitted in any window; refused ones do not count, and kinds
    without a limit are always admitted. An event depends on the window before it only, so a pause of a whole window
    cuts a key's events into runs that are decided apart. Runs are found on counts by window length, not on events;
    a run within its limit is admitted as it is, and only the others go through Python, as a sorted stream of which
    no more than a window's admitted times are held. A run that never pauses is one task's: each decision in it rests
    on the one before.
    """
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("kind")]
    rows = events.select("event_id", "key", "kind", "s", F.floor(F.col("s") / window_s).alias("slot"))
    slots = rows.groupBy("key", "kind", "slot").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    order = Window.partitionBy("key", "kind").orderBy("slot")
    rest = F.coalesce(F.col("lo") - F.lag("hi").over(order) >= window_s, F.lit(True))
    slots = slots.withColumn("fresh", rest.cast("int")).withColumn("run", F.sum("fresh").over(order)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("key", "kind", "run")))
    slots = slots.select("key", "kind", "slot", "run", F.coalesce(F.col("total") <= limit, F.lit(True)).alias("within"))
    runs = rows.alias("e").join(slots.alias("r"), F.expr("e.key <=> r.key AND e.kind <=> r.kind AND e.slot = r.slot")).select(
        "e.event_id", "e.key", "e.kind", "e.s", "r.run", "r.within")

    def decide(batches):
        group, kept = None, deque()  # the admitted times of the window, as many as the limit at most
        for batch in batches:
            out = []
            for *at, s in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "run", "s"))):
                if at != group:
                    group, kept = at, deque()
                while kept and kept[0] <= s - window_s:
                    kept.popleft()
                out.append(len(kept) < limits[at[1]])
                if out[-1]:
                    kept.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("event_id", "key", "kind")] + [pa.array(out, pa.bool_())],
                                             names=["event_id", "key", "kind", "admitted"])

    types = runs.schema
    schema = ", ".join(f"{c} {types[c].dataType.simpleString()}" for c in ("event_id", "key", "kind"))
    busy = runs.filter("NOT within").repartition("key", "kind", "run").sortWithinPartitions("key", "kind", "run", "s", "event_id")
    return runs.filter("within").select("event_id", "key", "kind", F.lit(True).alias("admitted")).union(
        busy.mapInArrow(decide, f"{schema}, admitted boolean"))
