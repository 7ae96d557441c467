"""Text and vector expressions, native throughout."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 4096


def tokens(c):
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(all_tokens(c))


def all_tokens(c):
    return F.filter(F.split(F.lower(c), F.lit(r"[^\p{L}\p{N}]+")), lambda x: x != "")


def has_tokens(c):
    return F.lower(c).rlike(r"[\p{L}\p{N}]")


def jaccard(a, b):
    """Of token arrays; 1.0 when both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def dimension(token):
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 6), 16, 10).cast("long") % DIMS


def hashed_vectors(df: DataFrame, key: str, text) -> DataFrame:
    """(key, dim, w): integer counts of tokens hashed into DIMS dimensions, sparse."""
    return df.select(key, F.explode(all_tokens(text)).alias("t")).groupBy(key, dimension(F.col("t")).alias("dim")).agg(
        F.count("*").alias("w"))


def with_norm(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.groupBy(key).agg(F.sum(F.col("w") * F.col("w")).alias("nn"))


def cosine(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v, dims: int):
    """First `dims` values over their norm; the zero vector stays."""
    cut = F.transform(F.slice(v, 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform(cut, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.when(norm == 0, cut).otherwise(F.transform(cut, lambda x: x / norm))


def band(similarity, low: float, high: float):
    return F.when(similarity >= high, "merge").when(similarity >= low, "pending").otherwise("insert")


def wilson(successes, n, z: float = 1.96):
    """(low, high) of the Wilson score interval, within 0 and 1."""
    p = successes / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale)


def slug(c):
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 63)


def preview(title, body, size: int = 280):
    return F.concat(title, F.lit(" — "), F.rtrim(F.substring(body, 1, size)), F.when(F.length(body) > size, "…").otherwise(""))


def heading(c, size: int = 200):
    """The first sentence or line of a text, cut with an ellipsis to `size` characters; a text without one is untitled."""
    first = F.regexp_extract(c, r"^[ \t\n\r]*([^.!?\n]*[.!?]?)", 1)
    return F.when(F.coalesce(first, F.lit("")) == "", "untitled").when(F.length(first) > size, F.concat(F.substring(first, 1, size - 1), F.lit("…"))).otherwise(first)
