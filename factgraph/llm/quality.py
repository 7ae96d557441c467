"""Quality rules: counted base rules, and a hashed n-gram classifier with calibrated probabilities.

The classifier is a logistic regression over hashed word n-grams (1 and 2 words) and character n-grams (3 to 5
code points), each family as shares of the text's n-grams, so a text's length does not matter. It is trained on
a bounded sample of labelled rows, calibrated by Platt scaling on a held-out fifth, and scores Arrow batches.
Texts are featurised whole in the tasks and written as sparse vectors; what reaches the driver are sums of 2**BITS
places, one for each of the sample's PARTS partitions and round.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps
from factgraph.runtime import discard, materialize

#: Labelled rows the classifier is fitted on at most.
SAMPLE_ROWS = 1_500
#: A text is kept where its calibrated probability of quality 1 reaches this.
KEEP_AT = 0.5
#: Bytes of text that a step handles at once, and n-grams that are hashed at once, of whatever text.
STEP, CHUNK = 1 << 18, 1 << 17
#: Partitions of the sample.
PARTS = 6
BITS, FAMILIES = 18, 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\f"


#: Word hashes: a fixed random number for each byte value, times powers of an odd number by place.
BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
ODD = 0x9E3779B97F4A7C15
UNDO = pow(ODD, -1, 1 << 64)
IS_SPACE = np.isin(np.arange(256), list(SPACES))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = powers(ODD, STEP + 4096), powers(UNDO, STEP + 4096)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each h[start:end], from running sums of h times powers of an odd number."""
    n = len(h) + 1
    up, down = (UP, DOWN) if n <= len(UP) else (powers(ODD, n), powers(UNDO, n))
    sums = np.zeros(n, np.uint64)
    np.cumsum(h * up[:n - 1], dtype=np.uint64, out=sums[1:])
    own = (sums[end] - sums[start]) * down[start]
    return (own ^ (own >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as 64-bit hashes, and the number in each text."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    edge = np.diff(IS_SPACE[raw].astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    past = np.cumsum([len(x) + 1 for x in texts])
    return span_hashes(BYTES[raw], start, end), np.diff(np.searchsorted(start, past), prepend=0)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` values."""
    a = np.uint64(0x9E3779B97F4A7C15)
    out = h[: len(h) - size + 1].copy() if len(h) >= size else h[:0].copy()
    for k in range(1, size):
        out *= a
        out ^= out >> np.uint64(29)
        out += h[k: len(h) - size + 1 + k]
    return out


def repeated_words(h: np.ndarray, counts: np.ndarray, window: int = 8) -> np.ndarray:
    """For each text its words inside runs of `window` words found twice or more in that text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(h) < window:
        return np.zeros(len(counts), np.int64)
    runs = rolled(h, window)
    whole = doc[: len(runs)] == doc[window - 1:]
    at = np.flatnonzero(whole)
    runs = runs[at] + doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    by = np.argsort(runs)
    same = runs[by][1:] == runs[by][:-1]
    hit = at[by][np.append(same, False) | np.append(False, same)]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(counts))


def base_counts(texts: list[bytes], h: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    chars, symbols, lines = [], [], []
    for x in texts:
        chars.append(len(x.translate(None, SPACES).decode(errors="replace")))
        symbols.append(len(x) - len(x.translate(None, SYMBOLS)))
        own = [s for s in x.split(b"\n") if s.strip()]
        lines.append(len(own) - len(set(own)))
    return {"n_words": counts, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64),
            "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeated_words(h, counts)}


def base_failed(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])


def families(texts: list[bytes], h: np.ndarray, counts: np.ndarray):
    """(family, feature indices, text of each index), a chunk at a time, of n-grams inside one text each."""
    shift = np.uint64(64 - BITS)
    points = [np.frombuffer(x.decode(errors="replace").encode("utf-32-le"), np.uint32) for x in texts]
    wide = np.array([len(x) for x in points], np.int64)
    for values, sizes, kinds in ((h, counts, ((0, 1), (1, 2))),
                                 (np.concatenate(points) if points else np.empty(0, np.uint32), wide, ((2, 3), (3, 4), (4, 5)))):
        of = np.repeat(np.arange(len(sizes)), sizes)
        for i in range(0, len(values), CHUNK):
            for family, n in kinds:
                part = values[i:i + CHUNK + n - 1].astype(np.uint64)
                if len(part) < n:
                    continue
                code = rolled(part, n)
                doc = of[i:i + len(code)]
                own = doc == of[i + n - 1:i + n - 1 + len(code)]
                yield family, (code[own] * np.uint64(0xD6E8FEB86659FD93 + 2 * family) >> shift).astype(np.int32), doc[own]


class Classifier:
    """Weights by hashed n-gram, and the calibration of their mean to a probability."""

    def __init__(self, weights, scale, bias):
        self.weights, self.scale, self.bias = weights, scale, bias

    def scores(self, texts, h, counts) -> np.ndarray:
        total, n = np.zeros((FAMILIES, len(texts))), np.zeros((FAMILIES, len(texts)), np.int64)
        for family, at, doc in families(texts, h, counts):
            total[family] += np.bincount(doc, self.weights[at], len(texts))
            n[family] += np.bincount(doc, minlength=len(texts))
        return (total / np.maximum(n, 1)).sum(axis=0)

    def probability(self, score):
        return 1 / (1 + np.exp(-np.clip(self.scale * score + self.bias, -30, 30)))


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text: places in rising order, and the sums of their shares of each family."""
    h, counts = word_hashes([text])
    parts: list = [[] for _ in range(FAMILIES)]
    for family, at, _ in families([text], h, counts):
        parts[family].append(np.unique(at, return_counts=True))
    places, shares = [np.empty(0, np.int32)], [np.empty(0)]
    for own in parts:
        if own:
            n = np.concatenate([c for _, c in own])
            places.append(np.concatenate([u for u, _ in own]))
            shares.append(n / max(1, n.sum()))
    at, to = np.unique(np.concatenate(places), return_inverse=True)
    return at, np.bincount(to, np.concatenate(shares), len(at)).astype(np.float32)


def fit(sample: DataFrame, rounds: int = 20) -> Classifier | None:
    """The classifier of a table (quality, held, places, shares) of vector() rows; None where it lacks one of the two labels.

    Each round is a job over the table whose tasks add up the gradient of their rows, so neither the driver nor a task
    holds more than one vector and 2**BITS sums besides the weights. Rows of `held` calibrate, if both labels are among them.
    """
    sizes = {(x.quality, x.held): x.n for x in sample.groupBy("quality", "held").agg(F.count("*").alias("n")).collect()}  # four at most
    n = [[sizes.get((q, h), 0) for h in (False, True)] for q in (0, 1)]
    if not all(map(sum, n)):
        return None
    whole = not all(map(all, n))  # too few rows to hold some out
    share = [0.5 / (sum(x) if whole else x[0]) for x in n]

    def raw_scores(batch, w):
        vectors = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(batch.column("places").to_pylist(), batch.column("shares").to_pylist())]
        return vectors, np.array([float(w[a] @ v) for a, v in vectors])

    def gradient(w, bias):
        sent = sample.sparkSession.sparkContext.broadcast(w)  # 2**BITS numbers, of no more use after the round

        def run(batches):
            g, slope, w = np.zeros(1 << BITS), 0.0, sent.value
            for part in batches:
                for batch in (part.slice(i, 16) for i in range(0, part.num_rows, 16)):
                    y = np.asarray(batch.column("quality").to_pylist(), float)
                    held = np.asarray(batch.column("held").to_pylist()) & (not whole)
                    vectors, score = raw_scores(batch, w)
                    error = (1 / (1 + np.exp(-np.clip(score + bias, -30, 30))) - y) * np.where(held, 0, np.where(y == 1, share[1], share[0]))
                    for (at, v), e in zip(vectors, error):
                        if e:
                            g[at] += e * v
                    slope += error.sum()
            yield pa.RecordBatch.from_arrays([pa.array([g.astype(np.float32).tobytes()], pa.binary()), pa.array([slope])], names=["g", "slope"])

        def add(batches):
            g, slope = np.zeros(1 << BITS, np.float32), 0.0
            for batch in batches:
                for own, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    g, slope = g + np.frombuffer(own, np.float32), slope + part
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([slope])], names=["g", "slope"])

        # The sums of the few partitions are added up in a task, so that one of them reaches the driver, and none stays there.
        total = sample.mapInArrow(run, "g binary, slope double").repartition(1).mapInArrow(add, "g binary, slope double").first()
        sent.destroy()
        return np.frombuffer(total.g, np.float32).astype(float), total.slope

    w, bias, square, slope = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):  # AdaGrad
        g, own = gradient(w.astype(np.float32), bias)
        square += g * g
        w -= g / np.sqrt(square)
        slope += own ** 2
        bias -= 0.5 * own / np.sqrt(slope)
    weights = w.astype(np.float32)

    def run(batches):
        for part in batches:
            for batch in (part.slice(i, 16) for i in range(0, part.num_rows, 16)):
                yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(raw_scores(batch, weights)[1])], names=["quality", "score"])

    use = sample if whole else sample.filter("held")
    found = use.mapInArrow(run, "quality int, score double").collect()  # two numbers for each row of the bounded sample
    s, t = np.array([x.score for x in found]), np.array([x.quality for x in found], float)
    s0, sd = s.mean(), s.std() or 1.0
    s = (s - s0) / sd
    a, b = 1.0, 0.0
    for _ in range(500):  # Platt scaling
        e = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))) - t
        a, b = a - 0.5 * ((e * s).mean() + 0.001 * a), b - 0.5 * e.mean()
    return Classifier(weights, a / sd, b - a * s0 / sd)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), without labels that lack one of the two or give a doc_id two qualities."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("high")).filter("quality = high").drop("high")


def sampled_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The labels that come first by a hash of doc_id: `rows` of them at most, a bounded sample."""
    return known_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier | None:
    """Fit on the whole texts of sampled_labels(). Of several texts of one doc_id the least one counts."""
    def run(batches):
        for batch, texts in steps(batches, size=STEP):
            for k, x in enumerate(texts):
                at, share = vector(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(k, 1).column(1), pa.array([xxhash.xxh3_64_intdigest(x) % 5 == 4]),
                     pa.array([at.tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())],
                    names=["quality", "held", "places", "shares"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled_labels(labels, rows)), "doc_id")
    chosen = chosen.filter("text IS NOT NULL").groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.min("text").alias("text"))
    found = chosen.mapInArrow(run, "quality int, held boolean, places binary, shares binary")
    sample = materialize(found.repartition(PARTS), "sample")
    model = fit(sample)
    discard(sample)
    return model


def held_out(docs: DataFrame, labels: DataFrame, model: Classifier, rows: int = SAMPLE_ROWS, bins: int = 10) -> DataFrame:
    """One row: accuracy, Brier score and calibration error of the model on the labelled rows that it was not fitted on.

    The calibration error is the mean distance, by rows, of mean probability and share of quality 1 in `bins` bins.
    """
    rest = known_labels(labels).join(sampled_labels(labels, rows).select("doc_id"), "doc_id", "left_anti")
    judged_ = quality_rules(docs, model).select("doc_id", "probability").join(rest, "doc_id")
    cells = judged_.groupBy(F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("probability").alias("p"), F.sum("quality").alias("y"),
        F.sum(((F.col("probability") >= KEEP_AT) == (F.col("quality") == 1)).cast("int")).alias("right"),
        F.sum(F.pow(F.col("probability") - F.col("quality"), 2)).alias("square"))
    return cells.agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.sum("square") / F.sum("n")).alias("brier"),
                     (F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("calibration_error"))


def judged(texts: list[bytes], model: Classifier | None, keep_at: float):
    """(base counts, base_failed, probability, kept) of each text."""
    h, counts = word_hashes(texts)
    base = base_counts(texts, h, counts)
    failed = base_failed(base)
    p = model.probability(model.scores(texts, h, counts)) if model else np.ones(len(texts))
    return base, failed, p, ~failed & (p >= keep_at)


def quality_rules(docs: DataFrame, model: Classifier | None, keep_at: float = KEEP_AT,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, base_failed, probability and kept for every whole text.

    A null text has no words and fails the base rules; without a model (no usable labels) the base rules alone
    decide. Repeated rows and null keys stay; other columns are ignored. A very long text is a step of its own, whose
    n-grams are hashed by chunks; bytes that are not UTF-8 count as U+FFFD.
    """
    def run(batches):
        for batch, texts in steps(batches, size=STEP):
            base, failed, p, kept = judged(texts, model, keep_at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in base.values()), pa.array(failed), pa.array(p), pa.array(kept)],
                names=[key, *base, "base_failed", "probability", "kept"])

    rows = docs.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_words long, word_chars long, "
                           "n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def kept_rows(docs: DataFrame, model: Classifier | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, all columns, whose text quality_rules() keeps; nulls, repeats and long texts as there."""
    def run(batches):
        for batch, texts in steps(batches, size=STEP):
            yield batch.filter(pa.array(judged(texts, model, keep_at)[3]))

    return docs.mapInArrow(run, docs.schema)
