"""Target-distribution importance resampling: n-gram gains, Gumbel scores, and a draw by threshold bisection.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and all beyond ASCII; features are runs of 1 to 3 words,
hashed by CRC-32 to a fixed number of buckets. One pass over the texts counts the buckets of the documents, one those
of the target; a bucket's gain is the floored log ratio of the two smoothed shares. A second pass scores each whole
text in Arrow batches. The scores are written as a table; the draw is the `most` best of (score, doc_id), whose cutoff
is found by counting jobs over that table, and the ranks of the drawn rows by range partitions. Nothing but the bucket
counts, of a fixed number, and the counts of the bisection reaches the driver.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps
from factgraph.llm.crc import crc32s, shifted
from factgraph.runtime import materialize

BUCKETS, LONGEST = 10_000, 3
#: Words below which a document cannot be drawn, and the share (percent) of the others that is drawn.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of text that a step handles, words whose features are hashed at once, and thresholds that a counting job tries.
STEP, CHUNK, PROBES = 1 << 20, 1 << 17, 15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words of each text) of whole texts."""
    raw = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    edge = np.diff(IN_WORD[raw].astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    past = np.cumsum([len(x) + 1 for x in texts])
    return raw, start, end, np.diff(np.searchsorted(start, past), prepend=0)


def buckets(texts: list[bytes]):
    """Yield (text of each feature, bucket of each feature), a chunk of words at a time, and at last (None, words of each text)."""
    raw, start, end, counts = words(texts)
    of = np.repeat(np.arange(len(texts)), counts)
    blank = crc32s(np.frombuffer(b" ", np.uint8), np.array([0]), np.array([1]))
    for i in range(0, len(start), CHUNK):
        s, e, doc = start[i:i + CHUNK + LONGEST - 1], end[i:i + CHUNK + LONGEST - 1], of[i:i + CHUNK + LONGEST - 1]
        own, size = crc32s(raw, s, e), e - s
        after = shifted(np.broadcast_to(blank, len(own)), size) ^ own  # a blank and the word
        run = own
        for n in range(LONGEST):
            if n:
                run = shifted(run[:len(own) - n], size[n:] + 1) ^ after[n:]
            whole = doc[:len(run)] == doc[n:]
            whole[CHUNK:] = False  # the next chunk starts there
            yield doc[:len(run)][whole], (run[whole] % np.uint32(BUCKETS)).astype(np.int64)
    yield None, counts


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how often each bucket occurs in all texts; one row for each bucket and task is shuffled."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, held in steps(batches, size=STEP):
            for doc, at in buckets(held):
                if doc is not None:
                    total += np.bincount(at, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from the counts of both; they are BUCKETS rows each at most."""
    s, t = ({x.bucket: x.n for x in bucket_counts(df).collect()} for df in (docs, target))
    all_s, all_t = sum(s.values()) + BUCKETS, sum(t.values()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t.get(k, 0) + 1) * all_s / ((s.get(k, 0) + 1) * all_t))) for k in range(BUCKETS)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight) of every whole text."""
    def run(batches):
        for batch, held in steps(batches, size=STEP):
            n, weight = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
            for doc, at in buckets(held):
                if doc is None:
                    n_words = at
                else:
                    np.add.at(weight, doc, gain[at])
                    n += np.bincount(doc, minlength=len(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n_words, n, weight))], names=[key, "n_words", "n_features", "weight"])

    rows = docs.select(key, "text")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long")


def with_score(rows: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """rows with `score`: weight and a floored Gumbel number of the key's digest. A null key counts as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def cutoff(rows: DataFrame, most: int, value: str, largest: bool) -> tuple[int, int]:
    """(v, n): the draw of the `most` largest (or smallest) values holds all n rows beyond v and some at v; most is 1 to the rows.

    Each job counts the rows beyond PROBES thresholds, which cut the interval that is left into equal parts.
    """
    c = F.col(value) if largest else -F.col(value)
    low, high = rows.agg(F.min(c), F.max(c)).first()
    beyond = 0  # rows of more than `high`
    while low < high:  # the cutoff is in [low, high]: rows of low or more are enough, rows of more than high are not
        cuts = sorted({low + (high - low + 1) * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {low})
        counts = rows.agg(*[F.sum((c >= x).cast("long")) for x in cuts]).first()
        for x, n in zip(cuts, counts):
            if n < most:
                high, beyond = x - 1, n
                break
            low = x
    return (low if largest else -low), beyond


def draw(scored: DataFrame, most: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(drawn, others) of a table of rows (key, score, uid): the `most` highest scores, ties to the smaller key, then uid.

    key is a whole number; null keys come before all others. uid is unique, so that repeated rows have an order too.
    """
    if most <= 0:
        return scored.filter("false"), scored
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62)))
    rows = scored.select("score", at.alias("at"), "uid")
    score, n = cutoff(rows, most, "score", True)
    rows = rows.filter(F.col("score") == score)
    tied, more = cutoff(rows, most - n, "at", False)
    last, _ = cutoff(rows.filter(F.col("at") == tied), most - n - more, "uid", False)
    inside = (F.col("score") > score) | ((F.col("score") == score) & ((at < tied) | ((at == tied) & (F.col("uid") <= last))))
    return scored.filter(inside), scored.filter(~inside)


def ranked(drawn: DataFrame, *order) -> DataFrame:
    """drawn with rank 1, 2, 3... in the given order, which leaves no ties: ranges are sorted and numbered apart, then counted before each other."""
    def run(batches):
        n = 0
        for batch in batches:
            yield batch.append_column("nth", pa.array(np.arange(n + 1, n + 1 + batch.num_rows)))
            n += batch.num_rows

    schema = drawn.schema.simpleString()[len("struct<"):-1]
    cut = drawn.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = materialize(cut.mapInArrow(run, f"{schema}, nth long").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted(cut.groupBy("part").agg(F.max("nth").alias("n")).collect())  # one row for each partition
    before = dict(zip([x.part for x in sizes], np.cumsum([0, *[x.n for x in sizes]]).tolist()))
    bases = drawn.sparkSession.createDataFrame(list(before.items()), "part int, base long")
    return cut.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); the target has texts (text).

    floor(percent * N / 100) of the N rows with at least_words words or more are drawn. Null and empty texts have no
    feature and weight 0. Equal scores go to the smaller doc_id, repeated rows are drawn one by one, a null doc_id
    comes first among ties. Without rows, or without drawable ones, no rank is given. Other columns are ignored.
    """
    rows = with_score(weighed(docs, gains(docs, target)), seed=seed)
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    most = rows.filter(able).count() * percent // 100
    drawn, others = draw(rows.filter(able), most)
    drawn = ranked(drawn, F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("uid"))
    rest = others.unionByName(rows.filter(~able)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
