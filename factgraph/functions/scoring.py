"""Rule-based re-score of answers against gold: parts, dates with day ranges, relation words; native expressions throughout."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions.attrs import NUMBERS, abstains

# Months, words that name part of a month with their days, words that say nothing, words that relate to a date,
# what divides the parts of a gold answer, and the longest reply that declines.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PART_OF_MONTH = {"early": (1, 10), "beginning": (1, 10), "start": (1, 10), "mid": (11, 20), "middle": (11, 20), "late": (21, 31), "end": (21, 31)}
DROPPED = ("the", "a", "an", "of", "in", "on", "at", "and", "or", "to", "her", "his", "she", "he", "they", "about", "around", "approximately", "roughly",
           "early", "mid", "late", "beginning", "end", "start", "middle")
RELATION = r"\b(before|after|prior|following|leading\s+up|ago|since|until|by)\b"
DIVIDER = r"(?i)\s*(?:,| and | & |;|/|\bplus\b)\s*"
DECLINE = 52

ANY = (0, 99)
_MONTH = "(" + "|".join(MONTHS) + ")"
_DATE = "struct<y:int,m:int,low:int,high:int>"


def _empty(kind):
    return F.expr(f"cast(array() as array<{kind}>)")


def normal_tokens(text):
    """Lower-case words and numbers as they are compared: ordinals and number words as digits, words that say nothing left out."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([0-9]+)(st|nd|rd|th)\b", "$1")
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*DROPPED))
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.transform(words, lambda x: F.coalesce(table[x], x))


def content(tokens):
    """The tokens of three letters or more, and the numbers."""
    return F.filter(tokens, lambda x: (F.length(x) >= 3) | x.rlike("^[0-9]+$"))


def gold_parts(gold):
    """What an answer has to name: the trimmed parts of gold; the whole of it where it has none; empty for an empty gold."""
    text = F.coalesce(gold, F.lit(""))
    parts = F.filter(F.transform(F.split(text, DIVIDER), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).when(F.trim(text) != "", F.array(F.trim(text))).otherwise(_empty("string"))


def dates(text):
    """array<struct<y, m, low, high>>: the dates a text names, day ranges for parts of months, ANY where no day is given.

    A month and year count without a day only where no date of that month has one, and a bare year only where there is
    no other date.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def found(pattern, make, groups):
        columns = [F.regexp_extract_all(low, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
        rows = F.arrays_zip(*[c.alias(f"g{k}") for k, c in enumerate(columns)])
        return F.transform(rows, lambda x: make(*[x[f"g{k}"] for k in range(groups)]).cast(_DATE))

    def month(x):
        return F.array_position(F.array(*map(F.lit, MONTHS)), x).cast("int")

    def date(y, m, first, last):
        return F.struct(y.cast("int").alias("y"), m.alias("m"), first.cast("int").alias("low"), last.cast("int").alias("high"))

    bounds = F.create_map(*[x for k, (a, b) in PART_OF_MONTH.items() for x in (F.lit(k), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    named = [
        found(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", lambda y, m, d: date(y, m.cast("int"), d, d), 3),
        found(rf"\b({'|'.join(PART_OF_MONTH)})(?:\s+of)?[\s-]+{_MONTH}[a-z]*\.?,?\s+(\d{{4}})\b", lambda q, m, y: date(y, month(m), bounds[q]["a"], bounds[q]["b"]), 3),
        found(rf"\b(\d{{1,2}})\s+{_MONTH}[a-z]*\.?,?\s+(\d{{4}})\b", lambda d, m, y: date(y, month(m), d, d), 3),
        found(rf"\b{_MONTH}[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", lambda m, d, y: date(y, month(m), d, d), 3)]
    with_day = F.concat(*named)
    of_month = found(rf"\b{_MONTH}[a-z]*\.?,?\s+(\d{{4}})\b", lambda m, y: date(y, month(m), F.lit(ANY[0]), F.lit(ANY[1])), 2)
    free = F.filter(of_month, lambda x: ~F.exists(with_day, lambda d: (d["y"] == x["y"]) & (d["m"] == x["m"])))
    whole = F.concat(with_day, free)
    years = found(r"\b(20\d{2}|19\d{2})\b", lambda y: date(y, F.lit(None).cast("int"), F.lit(ANY[0]), F.lit(ANY[1])), 1)
    return F.when(F.size(whole) > 0, whole).otherwise(years)


def same_date(a, b):
    """Whether two dates can be one: same year, same month where both name it, and days that overlap."""
    month = a["m"].isNull() | b["m"].isNull() | (a["m"] == b["m"])
    return (a["y"] == b["y"]) & month & (a["low"] <= b["high"]) & (b["low"] <= a["high"])


def _relates(text):
    return F.lower(F.coalesce(text, F.lit(""))).rlike(RELATION)


def prepared(text):
    """struct<dates, relates, tokens>: what is compared of a part or an answer, computed once."""
    return F.struct(dates(text).alias("dates"), _relates(text).alias("relates"), normal_tokens(text).alias("tokens"))


def part_present(part, answer):
    """Whether a prepared() answer names a prepared() part.

    A part with a date needs one that can be the same, and a relation word (before, after...) on both sides or on
    neither, since it moves the date that is meant. Other parts need their tokens as a run of the answer's text, or all
    of their content words.
    """
    dated = (part["relates"] == answer["relates"]) & F.exists(part["dates"], lambda x: F.exists(answer["dates"], lambda y: same_date(x, y)))
    run, own = F.array_join(part["tokens"], " "), content(part["tokens"])
    worded = (run == "") | F.contains(F.array_join(answer["tokens"], " "), run) | (
        (F.size(own) > 0) & (F.size(F.array_except(own, content(answer["tokens"]))) == 0))
    return F.when(F.size(part["dates"]) > 0, dated).otherwise(worded)


def rescored(answers: DataFrame) -> DataFrame:
    """answers (gold, answer, ...) with n_parts, coverage, covered (every part is named) and is_answer.

    A null or empty answer and one that declines is no answer and covers nothing; so does any answer to an empty gold.
    """
    reply = F.trim(F.coalesce(F.col("answer"), F.lit("")))
    rows = answers.withColumn("_parts", F.transform(gold_parts(F.col("gold")), prepared)).withColumn("_answer", prepared(F.col("answer")))
    rows = rows.withColumn("is_answer", (reply != "") & ~abstains(reply, DECLINE)).withColumn("n_parts", F.size("_parts"))
    met = F.size(F.filter("_parts", lambda x: part_present(x, F.col("_answer"))))
    judged = F.col("is_answer") & (F.col("n_parts") > 0)
    rows = rows.withColumn("_met", F.when(judged, met).otherwise(0))
    return rows.withColumn("coverage", F.when(judged, F.col("_met") / F.col("n_parts")).otherwise(0.0)).withColumn(
        "covered", judged & (F.col("_met") == F.col("n_parts"))).drop("_parts", "_answer", "_met")


def fair_scores(answers: DataFrame, by: str = "arm") -> DataFrame:
    """(by, n, strict, fair, partial, flips) of answers (by, gold, answer, correct boolean, adversarial boolean).

    strict is the given verdict; fair also counts answers that cover all parts, partial their share of the parts.
    Adversarial questions, whose right answer is to decline, keep their verdict. flips are the verdicts that fair turns.
    """
    right, open_ = F.coalesce(F.col("correct"), F.lit(False)), ~F.coalesce(F.col("adversarial"), F.lit(False))
    flip = open_ & ~right & F.col("covered")
    part = F.when(right, 1.0).when(open_, F.col("coverage")).otherwise(0.0)
    n = F.count("*")
    return rescored(answers).groupBy(by).agg(
        n.alias("n"), F.round(F.sum(right.cast("long")) / n, 6).alias("strict"), F.round(F.sum((right | flip).cast("long")) / n, 6).alias("fair"),
        F.round(F.sum(part) / n, 6).alias("partial"), F.sum(flip.cast("long")).alias("flips"))
