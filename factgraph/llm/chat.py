"""Chat formatting in budgeted windows of whole turns, by native functions only.

Prefix sums of turn tokens choose the spans: a window takes turns as long as the sum from its first one stays
within the budget less its system turn and repeated history. Spans are chosen in blocks of BLOCK turns, each a
bounded array, so one conversation of any length is dealt to many tasks; a block starts a window. A window starts
with the system turn and with turns repeated from the window before, whose targets are masked.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings; texts and roles escape their first characters.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens of a window, and of repeated history in it.
BUDGET, HISTORY = 2048, 256
#: Tokens that the template adds to a turn, and turns of a block whose spans are chosen together.
MARKS, BLOCK = 3, 512


def escaped(c):
    """Reversible: ~ as ~0, < as ~1, [ as ~2, so no control string of any usual template is left."""
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text, tokens, place, at): each turn's position from 1 on and the tokens before it."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")).cast("long") + MARKS)
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("place", F.row_number().over(inside)).withColumn("sum", F.sum("tokens").over(running) - F.col("tokens"))
    blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("all"))
    before = before.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           *[F.coalesce(F.sum(k).over(blocks), F.lit(0)).alias(f"base_{k}") for k in ("n", "all")])
    return turns.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(
        "conv_id", "role", "text", "tokens", (F.col("place") + F.col("base_n")).alias("place"),
        (F.col("sum") + F.col("base_all")).alias("at"))


def spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, place, first, again, n_system): the windows, by their first new turn, that each turn goes to."""
    block = F.floor((F.col("place") - 1) / BLOCK).alias("block")
    is_system = ((F.col("place") == 1) & (F.col("role") == "system")).alias("system")
    rows = turns.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("place", "at", "tokens", is_system))).alias("t"))
    heads = turns.filter("place = 1 AND role = 'system'").select(F.col("conv_id").alias("hc"), F.col("tokens").alias("head"))
    rows = rows.join(heads, F.col("conv_id").eqNullSafe(F.col("hc")), "left")
    # Room that a turn leaves for the system turn (kept where both fit the budget) and then for history, as a window's first.
    rows = rows.withColumn("t", F.expr(f"""transform(transform(t, x -> named_struct('x', x, 'head',
        CASE WHEN x.place > 1 AND head + x.tokens <= {budget} THEN head ELSE 0L END)), y -> named_struct(
        'place', y.x.place, 'at', y.x.at, 'tokens', y.x.tokens, 'system', y.x.system, 'head', y.head,
        'room', CASE WHEN y.x.place = 1 THEN 0L ELSE greatest(0L, least({history}L, {budget} - y.head - y.x.tokens)) END))"""))
    opened = f"""named_struct(
        'windows', array_append(s.windows, named_struct('first', x.place, 'at', x.at, 'room', x.room, 'head', x.head)),
        'cap', {budget} - x.head - CASE WHEN size(s.windows) = 0 THEN x.room
            ELSE coalesce(x.at - array_min(filter(s.recent, a -> x.at - a <= x.room)), 0L) END,
        'recent', CASE WHEN x.system THEN CAST(array() AS array<bigint>) ELSE array(x.at) END)"""
    taken = "named_struct('windows', s.windows, 'cap', s.cap, 'recent', array_append(s.recent, x.at))"
    rows = rows.withColumn("windows", F.expr(f"""aggregate(t, named_struct(
        'windows', CAST(array() AS array<struct<first:bigint,at:bigint,room:bigint,head:bigint>>), 'cap', 0L,
        'recent', CAST(array() AS array<bigint>)),
        (s, x) -> CASE WHEN size(s.windows) = 0 OR x.at + x.tokens - element_at(s.windows, -1).at > s.cap
                       THEN {opened} ELSE {taken} END, s -> s.windows)"""))
    after = rows.select(F.col("conv_id").alias("c"), (F.col("block") - 1).alias("b"), F.col("windows")[0].alias("after"))
    rows = rows.join(after, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    each = rows.select("conv_id", "t", F.explode(F.expr(
        "transform(windows, (w, i) -> named_struct('w', w, 'next', coalesce(get(windows, i + 1), after)))")).alias("of"))
    sent = each.select("conv_id", F.explode(F.expr("""flatten(transform(
        filter(t, x -> x.place >= of.w.first AND (of.next IS NULL OR x.place < of.next.first)), x -> CASE
        WHEN of.next IS NOT NULL AND NOT x.system AND of.next.at - x.at <= of.next.room THEN array(
            named_struct('place', x.place, 'first', of.w.first, 'again', 0, 'n_system', CAST(of.w.head > 0 AS int)),
            named_struct('place', x.place, 'first', of.next.first, 'again', 1, 'n_system', CAST(of.next.head > 0 AS int)))
        ELSE array(named_struct('place', x.place, 'first', of.w.first, 'again', 0, 'n_system', CAST(of.w.head > 0 AS int))) END))""")).alias("to"))
    return sent.select("conv_id", "to.*")


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, first (position of its first new turn), n_system, n_repeated, n_turns (new ones),
    tokens, text, loss (array<struct<start, size>>, code points of the assistant texts that are not repeated).

    Input: conv_id, turn, role, text; rows by turn, then role and text; a null role or text is empty, a null turn
    comes first, a null conv_id is a conversation; repeated rows are turns each; other columns are ignored. A window
    is over the budget only where one turn is, which is then alone. Only the first turn can be the system turn; it
    is left out of a window whose first new turn leaves no room for it. An empty table gives no rows.
    """
    turns = placed(conversations)
    first_system = turns.filter((F.col("place") == 1) & (F.col("role") == "system"))
    to = spans(turns, budget, history).withColumnsRenamed({"conv_id": "c", "place": "p"})
    dealt = turns.join(to, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")))
    dealt = dealt.select("conv_id", "first", "again", "n_system", "place", "role", "tokens",
                         F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"), escaped(F.col("text")).alias("body"))
    dealt = dealt.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id", "first").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    target = (F.col("role") == "assistant") & (F.col("again") == 0)
    windows = dealt.groupBy("conv_id", "first").agg(
        F.max("n_system").alias("n_system"), F.sum("again").alias("n_repeated"), F.sum(1 - F.col("again")).alias("n_turns"), F.sum("tokens").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "").alias("text"),
        F.array_sort(F.collect_list(F.when(target, F.struct(
            (F.col("offset") + F.length("head")).alias("start"), F.length("body").alias("size"))))).alias("loss"))
    heads = first_system.select(F.col("conv_id").alias("c"), F.col("tokens").alias("head_tokens"), F.concat(
        F.lit(TURN), escaped(F.col("role")), F.lit(TEXT), escaped(F.col("text")), F.lit(END)).alias("head"))
    windows = windows.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("n_system") == 1), "left")
    shift = F.coalesce(F.length("head"), F.lit(0))
    return windows.select(
        "conv_id", "first", "n_system", "n_repeated", "n_turns",
        (F.col("tokens") + F.coalesce("head_tokens", F.lit(0))).alias("tokens"),
        F.concat(F.coalesce("head", F.lit("")), F.col("text")).alias("text"),
        F.transform("loss", lambda x: F.struct((x["start"] + shift).alias("start"), x["size"].alias("size"))).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, first, turns array<struct<role, text>>, targets array<string>) of each window, without repeats.

    Roles and texts are never null; a null conv_id stays, and no windows give no rows.
    """
    parts = F.slice(F.split("text", F.lit(r"<\|turn\|>")), F.lit(2) + F.col("n_system") + F.col("n_repeated"), F.col("n_turns"))
    return windows.select(
        "conv_id", "first", "text",
        F.transform(parts, lambda x: F.struct(
            unescaped(F.substring_index(x, TEXT, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text"))).alias("turns"),
        F.transform("loss", lambda x: unescaped(F.substring(F.col("text"), x["start"] + 1, x["size"]))).alias("targets"))


def op1(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.sql("""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(chat_windows(rows))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")

    def whole(name):
        return F.array_join(F.transform("windows", lambda x: x[name]), "")

    per = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "first", F.size("turns").cast("long").alias("n"), line.alias("line"), F.array_join("targets", "").alias("loss"),
        F.length("text").cast("long").alias("chars")))).alias("windows"))

    def total(name):
        return F.aggregate(F.transform("windows", lambda x: x[name]), F.lit(0).cast("long"), lambda a, x: a + x)

    return per.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(whole("line").cast("binary"), 256).alias("turns_sha256"),
        F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss").cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"))
