"""Typed attributes of facts as JSON text or string maps, native throughout."""

from pyspark.sql import functions as F

# Attribute keys that the engine keeps for itself.
RESERVED = ("addenda", "dropped")


def members(json):
    """Map of an object's members as variants; null where the text is not an object."""
    text = F.when(F.ltrim(json).startswith("{"), json)
    return F.call_function("try_variant_get", F.call_function("try_parse_json", text), F.lit("$"), F.lit("map<string,variant>"))


def json_type(v):
    """null, boolean, number, string, array or object, of a variant; null for what is absent."""
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), F.lit(None)).when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(
        kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")


def is_partial_date(c):
    """YYYY, YYYY-MM or YYYY-MM-DD that is a real day of year 1 or later, the missing parts as 01."""
    shape = c.rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$") & ~c.startswith("0000")
    return F.coalesce(shape & F.try_to_date(F.when(shape, F.rpad(c, 10, "-01")), "yyyy-MM-dd").isNotNull(), F.lit(False))


def surface(attrs):
    """Sorted `key: value` lines of a map, without null and empty values and reserved keys."""
    kept = F.map_filter(attrs, lambda k, v: v.isNotNull() & (v != "") & ~k.isin(*RESERVED))
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n")


def without_reserved(attrs):
    return F.map_filter(attrs, lambda k, v: ~k.isin(*RESERVED))


def addenda_text(json):
    """The bodies of a JSON array of addenda, joined by blanks."""
    return F.array_join(F.transform(F.from_json(json, "array<struct<body:string>>"), lambda x: x["body"]), " ")


def searchable_text(title, body, surface_=None):
    lines = F.concat(title, F.lit("\n"), body)
    return lines if surface_ is None else F.when(F.coalesce(surface_, F.lit("")) == "", lines).otherwise(F.concat(lines, F.lit("\n"), surface_))


def date_bound(bound, as_of: str):
    """ISO text of a bound: an ISO date as it is, or +Nd and -Nd relative to as_of; null where it is neither."""
    days = F.regexp_extract(bound, r"^([+-]?[0-9]+)d$", 1)
    shifted = F.date_add(F.lit(as_of).cast("date"), F.when(days != "", days).cast("int")).cast("string")
    return F.when(days != "", shifted).when(is_partial_date(bound), bound)


def satisfies(value, equals=None, before=None, after=None, as_of: str = "1970-01-01"):
    """The attr predicate of a section: string comparison, bounds by date_bound()."""
    ok = F.lit(True)
    for c, test in ((equals, lambda v, b: v == b), (before, lambda v, b: v < b), (after, lambda v, b: v > b)):
        if c is not None:
            ok = ok & test(value, F.lit(c) if c is equals else date_bound(F.lit(c), as_of))
    return F.coalesce(ok, F.lit(False))


def prefixed(text, task: str, prefixes: dict[str, str]):
    """Text with the prefix that an embedder wants for a task (document or query), if any."""
    return F.concat(F.lit(prefixes.get(task, "")), text)


def constant_unit(dims: int):
    return F.array_repeat(F.lit(1.0) / F.sqrt(F.lit(float(dims))), dims)


def payload_bytes(*columns):
    """UTF-8 bytes of the columns as one JSON object."""
    return F.octet_length(F.to_json(F.struct(*columns)))


def with_source(cited, source, bound: int = 8000):
    """cited with a source's text appended on a line of its own, unless it holds it already or would pass the bound."""
    more = F.concat_ws("\n", F.when(cited != "", cited), source)
    return F.when(F.contains(cited, source) | (F.length(more) > bound), cited).otherwise(more)


# Number words and filler words of the evaluation's text comparison.
NUMBERS = {w: str(n) for n, w in enumerate(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {w: str(10 * n) for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
FILLER = ("a", "an", "the", "of", "to", "in", "on", "at", "and", "is", "was", "were", "are")


def content_words(text):
    """Distinct lower-case words that say something: number words as digits, ordinals as numbers, filler dropped."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"\b([0-9]+)(st|nd|rd|th)\b", "$1"), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.isin(*FILLER))
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.array_distinct(F.transform(words, lambda x: F.coalesce(table[x], x)))


def plain_form(text):
    """Lower case, runs of all but letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def support(gold, text):
    """Share of gold's content words that occur in the text; null where gold has none."""
    words = content_words(gold)
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words))


def abstains(reply, longest: int = 80):
    """A short reply that says INSUFFICIENT."""
    return F.contains(F.upper(reply), F.lit("INSUFFICIENT")) & (F.length(reply) <= longest)
