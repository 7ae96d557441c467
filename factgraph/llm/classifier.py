"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole texts.

Each text gives a fixed number of statistics (lengths, shares of kinds of characters, repetition, words and lines), each
taken through a logarithm or a log odds; they are written once, in one pass over the texts. Tasks add up the rows, the sums and the products of the statistics of all
labelled training rows by class; these few numbers give each class a mean and a covariance, which is shrunk towards the
pooled one and towards its own diagonal. A text's score is the calibrated difference of the two log densities, from
Mahalanobis distances by Cholesky factors that are computed once and travel with the model.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps
from factgraph.llm.quality import known_labels, repeated_words, word_hashes
from factgraph.runtime import materialize

#: Texts of this score are predicted to be of quality 1; rows whose digest of doc_id is 0 modulo FOLDS are held out.
KEEP_AT, FOLDS = 0.3, 5
#: Weights of the pooled covariance and of the own diagonal in a class's covariance, and the least variance of a statistic.
POOLED, DIAGONAL, RIDGE = 0.15, 0.1, 1e-3
#: Bytes of text that a step handles, and bins of the log density difference (within SPAN either way) for its calibration.
STEP, BINS, SPAN = 1 << 18, 400, 40.0
#: Rows of statistics that are scored at once.
STEP_ROWS = 4096

KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r\n\x0b\x0c", "stop": b".!?", "pause": b",;:'\"()-",
         "symbol": b"#*$%&|<>@^~=+\\/_[]{}`", "beyond": range(128, 256)}
KIND = np.full(256, len(KINDS), np.uint8)
for _k, _values in enumerate(KINDS.values()):
    KIND[list(_values)] = _k
NAMES = ("words", "word_mean", "word_sd", "line_words", "distinct", "twice", "repeat_lines", "repeat_runs", "odd_ends", "entropy", "pairs", *KINDS)


def odds(part, whole):
    """Log odds of a share, with half a case added to either side."""
    return np.log((part + 0.5) / (whole - part + 0.5))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each whole text; empty texts too."""
    h, counts = word_hashes(texts)
    out = np.zeros((len(texts), len(NAMES)))
    repeats, ends = repeated_words(h, counts), np.cumsum(counts)
    for k, text in enumerate(texts):
        raw, n = np.frombuffer(text, np.uint8), int(counts[k])
        own = h[ends[k] - n:ends[k]]
        values, times = np.unique(own, return_counts=True)
        kinds = np.bincount(KIND[raw], minlength=len(KINDS) + 1)
        blank = KIND[raw] == 3
        edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.astype(np.int8), [1]])))
        sizes = (edge[1::2] - edge[::2]).astype(float)
        last = raw[edge[1::2] - 1] if n else raw[:0]
        lines = [x for x in text.split(b"\n") if x.strip()]
        share = np.bincount(raw, minlength=256) / max(1, len(raw))
        share = share[share > 0]
        chars = len(raw) - kinds[3]
        out[k] = (np.log1p(n), np.log1p(sizes.mean() if n else 0), np.log1p(sizes.std() if n else 0), np.log1p(n / max(1, len(lines))),
                  odds(len(values) / (1 + np.log1p(n / 100)), max(n, len(values))), odds(int((own[1:] == own[:-1]).sum()), max(0, n - 1)),
                  odds(len(lines) - len(set(lines)), len(lines)), odds(int(repeats[k]), n),
                  odds(int(np.isin(KIND[last], (4, 6, 8)).sum()), n), float(-(share * np.log(share)).sum()), np.log1p(times.max() / n if n else 0),
                  *(odds(int(kinds[i]), int(max(chars, kinds[i]))) for i in range(len(KINDS))))
    return out


class Discriminant:
    """Two classes' means, inverse Cholesky factors and log determinants, and the calibration of their difference."""

    def __init__(self, means, factors, logdets, bins=None):
        self.means, self.factors, self.logdets, self.bins = means, factors, logdets, bins

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        log = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return np.clip(log[1] - log[0], -SPAN, SPAN)

    def score(self, x: np.ndarray) -> np.ndarray:
        scale, bias = self.bins
        return 1 / (1 + np.exp(-(scale * self.difference(x) + bias)))


def is_held_out(key):
    """Whether a row of this doc_id is held out; a null one counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): the statistics of every row's whole text, packed; a table that fitting and scoring share."""
    def run(batches):
        for batch, texts in steps(batches, size=STEP):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.tobytes() for x in statistics(texts)], pa.binary())], names=["doc_id", "held_out", "x"])

    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return materialize(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, x binary"), "statistics")


def training(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, x) of all labelled rows of described() outside the held-out part; labels that contradict each other do not count.

    Both sides grow with the corpus, so only statistics are shuffled, and no texts.
    """
    known = known_labels(labels).select("doc_id", F.col("quality").cast("int").alias("quality"))
    return rows.filter("NOT held_out").select("doc_id", "x").join(known, "doc_id").select("quality", "x")


def unpacked(batches):
    """Yield (record batch of STEP_ROWS rows at most, their statistics), given batches whose last column is x."""
    for whole in batches:
        for batch in (whole.slice(i, STEP_ROWS) for i in range(0, whole.num_rows, STEP_ROWS)):
            yield batch, np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist())).reshape(-1, len(NAMES))


def moments(rows: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For class 0 and 1 the number of rows, and sums and products of their statistics: one row for each task and class is added up."""
    d = len(NAMES)

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch, x in unpacked(batches):
            y = np.asarray(batch.column(0).to_pylist())
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["quality", "sums"])

    parts = rows.mapInArrow(run, "quality int, sums array<double>").select("quality", F.posexplode("sums").alias("at", "v"))
    sums = parts.groupBy("quality", "at").agg(F.sum("v").alias("v")).collect()  # two rows for each number of the model
    out = np.zeros((2, 1 + d + d * d))
    for x in sums:
        out[x.quality, x["at"]] = x.v
    return [(int(s[0]), s[1:1 + d], s[1 + d:].reshape(d, d)) for s in out]


def fit(rows: DataFrame) -> Discriminant | None:
    """The model of training rows (quality, x); None where one of the two classes has no row.

    Platt's two numbers are fitted to the counts of both classes in bins of the difference, taken over all training rows.
    """
    (n0, s0, p0), (n1, s1, p1) = moments(rows)
    if not n0 or not n1:
        return None
    means = [s0 / n0, s1 / n1]
    own = [p / n - np.outer(m, m) for p, n, m in zip((p0, p1), (n0, n1), means)]
    pooled = (n0 * own[0] + n1 * own[1]) / (n0 + n1)
    factors, logdets = [], []
    for c, n in zip(own, (n0, n1)):
        weight = max(POOLED, len(NAMES) / (len(NAMES) + n))  # a class of few rows leans on the pooled covariance
        mixed = (1 - weight) * c + weight * pooled
        mixed = (1 - DIAGONAL) * mixed + np.diag(DIAGONAL * np.diag(mixed) + RIDGE)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    model = Discriminant(means, factors, logdets)

    def run(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch, x in unpacked(batches):
            at = np.minimum(((model.difference(x) + SPAN) * (BINS / (2 * SPAN))).astype(np.int64), BINS - 1)
            np.add.at(total, (np.asarray(batch.column(0).to_pylist()), at), 1)
        y, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(total[y, at])], names=["quality", "at", "n"])

    counts = rows.mapInArrow(run, "quality int, at int, n long").groupBy("quality", "at").agg(F.sum("n").alias("n")).collect()  # two rows a bin at most
    x = np.array([(r["at"] + 0.5) * (2 * SPAN / BINS) - SPAN for r in counts])
    y, w = np.array([r.quality for r in counts], float), np.array([r.n for r in counts], float)
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.1, float(np.log(n1 / n0))
    for _ in range(100):  # Newton's steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g, v = w * (p - goal), w * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[(v * x * x).sum() + 1e-6, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]]), [(g * x).sum(), g.sum()])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.bins = (max(a, 1e-3), b)  # a higher difference never means a lower score
    return model


def classified(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Null texts are empty, and empty ones are scored like any other. Repeated rows stay, and as many copies of a labelled
    document are as many training rows; a null doc_id is held out or not as the empty text is. Only the text is seen by
    the model: other columns are ignored. Without training rows of both classes every score is 0.5. A very long text is
    a step of its own, read whole.
    """
    rows = described(docs)
    model = fit(training(rows, labels))

    def run(batches):
        for batch, x in unpacked(batches):
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= keep_at).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def held_out_report(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of the held-out labelled rows: n, accuracy, and recall of quality 1 and of quality 0."""
    rows = scored.filter("held_out").join(known_labels(labels), "doc_id")
    right = (F.col("predicted") == F.col("quality")).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(F.when(F.col("quality") == 1, right)).alias("kept_good"),
                    F.avg(F.when(F.col("quality") == 0, right)).alias("caught_bad"))
