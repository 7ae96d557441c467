"""Substring dedup: runs of words that occur earlier in the corpus, found in FM-indexes by shard.

1. Every 20-word window elects its least-hashed gram of 6 words, its anchor; equal windows elect equal anchors,
   and neighbouring windows mostly share one. Each run of windows with one anchor is a segment, known by the 128
   bits of its anchor's and its own hash. Only anchors that occur twice or more can hold a repeated window.
2. Equal segments meet in one row, their first place; whole repeats of it are settled. Anchors with several
   texts are left, whose windows may repeat in part.
3. Their segments are dealt to shards by anchor, so equal windows share a shard. A task builds a compressed FM-index
   (Burrows-Wheeler transform in a wavelet matrix of packed bits, sampled places) over its segments, and streams the
   segments' words past it: backward search computes the matching statistic of each end, and where it reaches 20
   words the interval names all places of that window, which are located, and the least of them is its first.
4. An anchor with very many texts is dealt window by window, each window to several salted shards. What is first
   in its salt meets once more, so no task holds a window's rows whole.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps
from factgraph.llm.quality import rolled, span_hashes, word_hashes
from factgraph.runtime import discard, materialize

#: Words of an anchor gram; distinct segments of one anchor beyond which they are dealt out window by window, and
#: about as many rows of one window that meet in a task.
GRAM, CROWD = 6, 500
#: Words that a task gathers, shards whole, before it builds their index.
GATHER = 400_000
#: Every so many places of a text the index keeps the position; every so many ends are searched before the others.
SAMPLE, STRIDE = 8, 5


def anchors(h: np.ndarray, counts: np.ndarray, window: int):
    """(window starts, anchor position of each, gram hashes): of the windows inside one text."""
    grams, span = rolled(h, GRAM), window - GRAM + 1
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), grams
    low, at, held = grams, np.zeros(len(grams), np.int64), 1  # least value by doubling, the leftmost of equal ones
    while held < span:
        step = min(held, span - held)
        left, right = low[:-step], low[step:]
        take = right < left
        at = np.where(take, at[step:] + step, at[:-step])
        low = np.where(take, right, left)
        held += step
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1:])
    return starts, starts + at[starts], grams


def runs_of(anchor: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    return np.flatnonzero(np.append(True, np.diff(anchor) != 0)) if len(anchor) else np.empty(0, np.int64)


class WaveletMatrix:
    """Rank queries over a sequence of small integers: one packed bit vector per bit, highest bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            zeros = len(bit) - int(bit.sum())
            self.levels.append((b, words, ones, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Occurrences of value[i] before low[i] and before high[i], less a common start."""
        first = np.zeros(len(value), np.int64)
        for b, words, ones, zeros in self.levels:
            bit = (value >> b & 1).astype(bool)
            out = []
            for at in (first, low, high):
                n = ones[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
                out.append(np.where(bit, zeros + n, at - n))
            first, low, high = out
        return low - first, high - first

    def access(self, at: np.ndarray):
        """The value at each place, and how often it occurs before."""
        value, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for _, words, ones, zeros in self.levels:
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out = []
            for x in (first, at):
                n = ones[x >> 6] + np.bitwise_count(words[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                out.append(np.where(bit, zeros + n, x - n))
            first, at = out
            value = value << 1 | bit
        return value, at - first


class FmIndex:
    """Compressed self-index of an integer text of values from 0 on: its Burrows-Wheeler transform in a wavelet matrix, and
    the text positions of every SAMPLE-th place. Neither the text nor the suffix array is kept."""

    def __init__(self, text: np.ndarray):
        text = np.append(text.astype(np.int64) + 1, 0)  # 0 ends the text and occurs once
        n, rank, step = len(text), text, 1
        while True:  # prefix doubling, until all suffixes differ
            nxt = np.zeros(n, np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (int(nxt.max()) + 1) + nxt
            suffixes = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(np.append(0, np.diff(key[suffixes]) != 0))
            if rank[suffixes[-1]] == n - 1:
                break
            step *= 2
        sigma = int(text.max()) + 1
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        self.matrix = WaveletMatrix(text[suffixes - 1], max(1, (sigma - 1).bit_length()))
        sampled = suffixes % SAMPLE == 0
        self.marks = WaveletMatrix(sampled.astype(np.int64), 1)
        self.samples = suffixes[sampled].astype(np.int32)

    def statistics(self, text: np.ndarray, ends: np.ndarray, most: int):
        """(size, low, high): the matching statistic of each end, up to `most`, and the interval of its match.

        That is the longest run of values up to text[end] that occurs twice or more in the index, found by backward steps
        until the interval would shrink to the run itself. text may hold values that the index has not.
        """
        size, low, high = (np.zeros(len(ends), np.int64) for _ in range(3))
        a, b, at = np.zeros(len(ends), np.int64), np.full(len(ends), self.before[-1]), np.arange(len(ends))
        for k in range(most):
            c = text[ends[at] - k].astype(np.int64) + 1
            known = c < len(self.before) - 1
            a, b, at, c = a[known], b[known], at[known], c[known]
            x, y = self.matrix.rank(c, a, b)
            a, b = self.before[c] + x, self.before[c] + y
            more = b - a > 1
            a, b, at = a[more], b[more], at[more]
            size[at], low[at], high[at] = k + 1, a, b
        return size, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the index: steps back through the transform to the nearest sampled place."""
        out, steps_, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(at):
            known, place = self.marks.access(rows)
            found = known == 1
            out[at[found]] = self.samples[place[found]] + steps_
            at, rows = at[~found], rows[~found]
            value, nth = self.matrix.access(rows)
            rows, steps_ = self.before[value] + nth, steps_ + 1
        return out


def repeats(index: FmIndex, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray, window: int):
    """(window starts, low, high) of the windows of a streamed text whose matching statistic reaches `window`.

    A statistic grows by one a place at most, so after every STRIDE-th end only the ends that can still reach it are searched.
    """
    wide = np.maximum(0, sizes - window + 1)
    offset = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    ends = np.repeat(begin, wide) + offset + window - 1
    size, low, high = (np.zeros(len(ends), np.int64) for _ in range(3))
    first = np.flatnonzero(offset % STRIDE == 0)
    size[first], low[first], high[first] = index.statistics(text, ends[first], window)
    back = offset % STRIDE
    rest = np.flatnonzero((back > 0) & (size[np.arange(len(ends)) - back] + back >= window))
    size[rest], low[rest], high[rest] = index.statistics(text, ends[rest], window)
    whole = size == window
    return (ends - window + 1)[whole], low[whole], high[whole]


def earlier_windows(segments: list[list[bytes]], docs: np.ndarray, starts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment its window offsets whose words also start earlier, by (doc, start), in any segment."""
    ids: dict[bytes, int] = {}
    text, sizes = [], []
    for words in segments:
        text += [ids.setdefault(w, len(ids) + 1) for w in words]
        text.append(0)
        sizes.append(len(words))
    text, sizes = np.array(text, np.int64), np.array(sizes)
    index = FmIndex(text)
    begin = np.cumsum(sizes + 1) - sizes - 1
    query, low, high = repeats(index, text, begin, sizes, window)
    # The places of each distinct interval, and the first of them by (doc, start).
    low, back = np.unique(low, return_inverse=True)
    ends = np.zeros(len(low), np.int64)
    ends[back] = high
    n = ends - low
    rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    at = index.locate(rows)
    segment = np.searchsorted(begin, at, side="right") - 1
    doc, start = docs[segment], starts[segment] + at - begin[segment]
    order = np.lexsort((start, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)))[:len(order)]
    least = np.minimum.reduceat(rank, np.cumsum(n) - n) if len(n) else rank
    lead = np.zeros(len(n), np.int64)
    lead[np.repeat(np.arange(len(n)), n)[np.flatnonzero(rank == np.repeat(least, n))]] = np.flatnonzero(rank == np.repeat(least, n))
    own = np.searchsorted(begin, query, side="right") - 1
    place = starts[own] + query - begin[own]
    hit = (docs[own] != doc[lead[back]]) | (place != start[lead[back]])
    of, offset = own[hit], (query - begin[own])[hit]
    return np.split(offset, np.searchsorted(of, np.arange(1, len(sizes))))


WINDOWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("skip", pa.int32()), ("shard", pa.int64()), ("words", pa.binary())])


def repeated_windows(docs: DataFrame, window: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, starts array<int>, wide array<int>): per document runs of windows [start, start + wide) that occur earlier."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text <> ''")

    def elect(batches):
        for batch, texts in steps(batches):
            h, counts = word_hashes(texts)
            starts, anchor, grams = anchors(h, counts, window)
            first = runs_of(anchor)
            wide = np.diff(np.append(first, len(anchor)))
            doc = np.repeat(np.arange(len(counts)), counts)[starts[first]]
            base = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array((starts[first] - base[doc]).astype(np.int32)),
                 pa.array(wide.astype(np.int32)), pa.array(grams[anchor[first]].view(np.int64)),
                 pa.array(span_hashes(h, starts[first], starts[first] + wide + window - 1).view(np.int64))],
                names=["doc_id", "start", "wide", "anchor", "segment"])

    def cut(batches):
        for batch, texts in steps(batches):
            out = []
            for d, x, runs in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                x = x.split()
                for run in runs:
                    a, g = run["start"], run["anchor"]
                    if not run["crowded"]:
                        out.append((d, a, 0, g, b" ".join(x[a:a + run["wide"] + window - 1])))
                    for k in range(run["wide"] if run["crowded"] else 0):
                        part = b" ".join(x[a + k:a + k + window])
                        salt = xxhash.xxh3_64_intdigest(b"%d" % d) % run["salts"] + 1
                        out.append((d, a, k, xxhash.xxh3_64_intdigest(part, salt) - (1 << 63), part))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(WINDOWS.types)], schema=WINDOWS)

    every = materialize(rows.mapInArrow(elect, "doc_id long, start int, wide int, anchor long, segment long"), "segments")
    # Written before the joins, so that hot anchors are split there.
    twice = materialize(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "twice")
    segments = materialize(every.join(twice, "anchor", "left_semi"), "repeated")
    discard(every)
    firsts = materialize(segments.groupBy("anchor", "segment").agg(
        F.min(F.struct("doc_id", "start", "wide")).alias("first")).select("anchor", "first.*"), "firsts")
    # An anchor's only text has no other place for its windows; the segments that repeat it whole are known.
    several = materialize(firsts.groupBy("anchor").count().filter("count > 1").select(
        "anchor", (F.col("count") > CROWD).alias("crowded"), F.ceil(F.col("count") / CROWD).alias("salts")), "several")
    wanted = firsts.join(several, "anchor").groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "wide", "anchor", "crowded", "salts")).alias("runs"))
    dealt = rows.join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(
        cut, "doc_id long, start int, skip int, shard long, words binary")

    crowded = not several.filter("crowded").isEmpty()

    def judge(batches, last=False):
        """Masks of the windows that occur earlier in their shard; windows of a crowd that do not are passed on."""
        rows_, size = [], 0

        def flush(rows_):
            doc, start, skip = (np.array([x[k] for x in rows_], np.int64) for k in range(3))
            found = earlier_windows([x[4] for x in rows_], doc, start + skip, window)
            mask = [int(sum(1 << int(o) for o in f)) << x[2] for f, x in zip(found, rows_)]
            more = [] if last or not crowded else [k for k, m in enumerate(mask) if not m and len(rows_[k][4]) == window]
            keep = [k for k, m in enumerate(mask) if m] + more
            return pa.RecordBatch.from_arrays(
                [*(pa.array([rows_[k][c] for k in keep], t) for c, t in zip((0, 1, 2), WINDOWS.types)), pa.array([mask[k] for k in keep], pa.int64()),
                 pa.array([xxhash.xxh3_64_intdigest(rows_[k][5]) - (1 << 63) if not mask[k] else 0 for k in keep], pa.int64()),
                 pa.array([None if mask[k] else rows_[k][5] for k in keep], pa.binary())], names=["doc_id", "start", "skip", "mask", "shard", "words"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size >= GATHER and row[3] != rows_[-1][3]:
                    yield flush(rows_)
                    rows_, size = [], 0
                rows_.append((*row[:4], row[4].split(), row[4]))
                size += len(rows_[-1][4])
        if rows_:
            yield flush(rows_)

    kind = "doc_id long, start int, skip int, mask long, shard long, words binary"
    masks = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(judge, kind)
    if crowded:
        masks = materialize(masks, "firsts-of-salts")
        again = masks.filter("mask = 0").select("doc_id", "start", "skip", "shard", "words")
        again = again.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda x: judge(x, True), kind)
        masks = masks.filter("mask <> 0").unionByName(again)
    masks = masks.groupBy("doc_id", "start").agg(F.bit_or("mask").alias("mask"))
    own = materialize(firsts.join(masks, ["doc_id", "start"], "left").select(
        "doc_id", "start", F.coalesce("mask", F.lit(0)).alias("mask")), "masks")
    judged = segments.select("doc_id", "start", "wide").join(own, ["doc_id", "start"], "left").select(
        "doc_id", "start", F.coalesce("mask", F.expr("shiftleft(1L, wide) - 1")).alias("mask")).filter("mask <> 0")
    return judged.groupBy("doc_id").agg(F.collect_set(F.struct("start", "mask")).alias("runs")).select(
        F.col("doc_id").alias(key), "runs")


def substring_dedup(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_text): each text without the words of windows that start earlier elsewhere.

    Earlier: a smaller key, or the same document and an earlier start. Null and wordless texts have no words and
    keep the empty text; rows with a null key are neither judged nor sources. The key must be a whole number and
    name one text: rows that repeat a document whole are returned as often, all alike. Words are joined by blanks.
    """
    found = repeated_windows(docs, window, key, text)

    def strip(batches):
        for batch, texts in steps(batches):
            words, removed, kept = [], [], []
            for x, runs in zip(texts, batch.column(2)):
                x = x.split()
                gone = np.zeros(len(x) + 1, np.int64)
                for run in runs.as_py() or ():
                    mask, at = run["mask"], run["start"]
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        gone[at + low] += 1
                        gone[min(at + low + window, len(x))] -= 1
                        mask &= mask - 1
                gone = np.cumsum(gone[:-1]) > 0
                n = int(gone.sum())
                words.append(len(x))
                removed.append(n)
                kept.append(b" ".join([w for w, g in zip(x, gone.tolist()) if not g] if n else x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "kept_text"])

    rows = docs.select(key, F.col(text).alias("text")).join(found, key, "left").select(key, "text", "runs")
    return rows.mapInArrow(strip, f"{key} {rows.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def op9(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
