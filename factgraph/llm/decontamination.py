"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A window of w bytes of a benchmark text that occurs in a document with at most e edits shares w - q + 1 - q * e
of its q-grams with it, all on diagonals (document minus benchmark offset) at most e apart. Each hit is counted
in two overlapping diagonal bands, so one of them holds them all; a band with that many hits within w + e bytes is
a candidate. Its hits form exact blocks. A window that holds a block lies around it, so the block is extended to
both sides by alignment in a band of 2 * e + 1 diagonals, for every split of the window's rest at once: nothing
that the edit budget allows is missed, and nothing beyond it is reported.

Windows have 64 bytes, or the whole of a shorter benchmark text. The edit budget is one for each 16 bytes, three
at most, and q is chosen by it so that the bound stays positive.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps

#: Bytes of a window (a shorter benchmark text is one window), edits allowed in it at most, bytes for each edit.
WINDOW, EDITS, PER_EDIT = 64, 3, 16
#: Benchmark bytes that one pass broadcasts at most; a larger benchmark takes several passes over the documents.
PASS_BYTES = 16 << 20
#: Bytes of text that a step searches, and hits that are grouped at once.
STEP, HITS = 1 << 20, 1 << 19
SLOTS = 22
PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def normal(text: bytes) -> tuple[bytes, np.ndarray]:
    """(lower case with each run of ASCII punctuation and white space as one blank, the character of each byte)."""
    plain = text.decode(errors="replace").replace("İ", "i")
    low = plain.lower()
    if len(low) != len(plain):  # a character whose lower case is not one character
        low = "".join(x if len(x := c.lower()) == 1 else c for c in plain)
    raw = np.frombuffer(low.encode().translate(PLAIN), np.uint8)
    keep = np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))[:len(raw)]
    return raw[keep].tobytes(), (np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1)[keep]


def budget(size: int) -> tuple[int, int]:
    """(edits, q) for windows of `size` bytes: size - q + 1 - q * edits is at least 1."""
    edits = min(EDITS, size // PER_EDIT)
    return edits, (8, 8, 10, 12)[edits] if size >= 8 else size


def grams(text: bytes, q: int) -> np.ndarray:
    """64-bit codes of the q-grams of text, 16 >= q >= 1."""
    n = len(text) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray((n,), "<u8", text + bytes(8), strides=(1,))
    if q >= 8:
        code = words * np.uint64(0x9E3779B97F4A7C15)
        if q > 8:
            code += np.ndarray((n,), "<u8", text, q - 8, (1,)) * np.uint64(0xC2B2AE3D27D4EB4F)
    else:
        code = (words & np.uint64((1 << 8 * q) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return code ^ (code >> np.uint64(29))


def costs(pattern: np.ndarray, text: np.ndarray, edits: int):
    """(least edits, bytes of text used) of each prefix of each pattern row at the start of its text row.

    pattern is (rows, n), text (rows, n + edits); costs beyond the budget are given as edits + 1. Both results
    have a column for each prefix length, 0 included.
    """
    rows, n = pattern.shape
    far = edits + 1
    now = np.full((rows, 2 * edits + 1), far, np.int8)  # column d: text minus pattern bytes used, less edits
    now[:, edits:] = np.arange(edits + 1)
    least, used = np.zeros((rows, n + 1), np.int8), np.zeros((rows, n + 1), np.int32)
    order = np.argsort(np.abs(np.arange(-edits, edits + 1)), kind="stable")
    for i in range(1, n + 1):
        new = np.full_like(now, far)
        for c in range(2 * edits + 1):
            j = i - 1 + c - edits  # text byte that meets this pattern byte
            best = now[:, c] + (pattern[:, i - 1] != text[:, j]) if j >= 0 else np.full(rows, far, np.int8)
            if c < 2 * edits:
                best = np.minimum(best, now[:, c + 1] + 1)
            if c and j >= 0:
                best = np.minimum(best, new[:, c - 1] + 1)
            new[:, c] = np.minimum(best, far)
        now = new
        pick = order[np.argmin(now[:, order], axis=1)]
        least[:, i], used[:, i] = now[np.arange(rows), pick], np.maximum(0, i + pick - edits)
    return least, used


class Index:
    """Q-grams of the benchmark texts that share an edit budget and a q."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.sizes = np.array([len(t) for t in self.texts])
        self.windows = np.minimum(WINDOW, self.sizes)
        self.edits, self.q = budget(int(self.windows[0]))
        self.need = self.windows - self.q + 1 - self.q * self.edits
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.whole = np.frombuffer(b"\n".join([*self.texts, b""]), np.uint8)
        codes = [grams(t, self.q) for t in self.texts]
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])
        codes = np.concatenate(codes)
        by = np.argsort(codes, kind="stable")
        self.codes, self.item, self.at = codes[by], item[by], at[by]
        self.slots = np.zeros(1 << SLOTS, bool)
        self.slots[(codes >> np.uint64(64 - SLOTS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray):
        """Batches of (place, item, place in the item) of equal q-grams; what lies within a window shares a batch."""
        hit = np.flatnonzero(self.slots[(codes >> np.uint64(64 - SLOTS)).astype(np.int64)])
        low = np.searchsorted(self.codes, codes[hit])
        count = np.searchsorted(self.codes, codes[hit], side="right") - low
        reach, start, total = int(self.windows.max()) + self.edits, 0, np.append(0, np.cumsum(count))
        while start < len(hit):
            end = max(int(np.searchsorted(total, total[start] + HITS)), int(np.searchsorted(hit, hit[start] + 2 * reach)))
            end = min(end, len(hit))
            n = count[start:end]
            where = np.repeat(hit[start:end], n)
            index = np.repeat(low[start:end] - np.cumsum(n) + n, n) + np.arange(len(where))
            yield where, self.item[index], self.at[index]
            if end == len(hit):
                return
            start = max(start + 1, int(np.searchsorted(hit, hit[end - 1] - reach)))

    def find(self, whole: bytes, ends: np.ndarray):
        """Arrays (text, item, start, end, edits) of the windows found in the texts that end at `ends`, unmerged."""
        raw = np.frombuffer(whole, np.uint8)
        for where, item, at in self.hits(grams(whole, self.q)):
            if len(where):
                blocks = self.candidates(where, item, at, np.searchsorted(ends, where, side="right"), len(whole))
                for k in range(0, len(blocks[0]), 4096):
                    yield self.extended(raw, ends, *(x[k:k + 4096] for x in blocks))

    def candidates(self, where, item, at, text, size):
        """Exact blocks (text, item, first place, first place in the item, length) with a hit of a full band."""
        q, e = self.q, self.edits
        wide = 2 * e + 2
        diagonal = where - at + 2 * size
        hot = np.zeros(len(where), bool)
        for half in (0, wide // 2):
            band = (diagonal + half) // wide
            by = np.lexsort((where, band, item, text))
            t, i, b, p = text[by], item[by], band[by], where[by]
            last = np.arange(len(by)) + self.need[i] - 1
            ok = last < len(by)
            last = np.minimum(last, len(by) - 1)
            ok &= (t == t[last]) & (i == i[last]) & (b == b[last]) & (p[last] - p <= self.windows[i] + e - q)
            hot[by[ok]] = True
        by = np.lexsort((where, diagonal, item, text))
        t, i, d, p = text[by], item[by], diagonal[by], where[by]
        new = np.append(True, (np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(d) != 0) | (np.diff(p) != 1))
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(by)))
        use = np.add.reduceat(hot[by].astype(np.int64), first) > 0
        first, run = first[use], run[use]
        return t[first], i[first], p[first], at[by][first], run + q - 1

    def extended(self, raw, ends, text, item, p, x, block):
        """The windows around exact blocks that the budget allows, as spans of the text."""
        w, e, low = self.windows[item], self.edits, np.append(0, ends)[text]
        high, size, base = ends[text] - 1, self.sizes[item], self.starts[item]
        whole = block >= w
        rest = np.where(whole, 0, w - block)
        n = int(rest.max(initial=0))
        left, left_used = self.side(raw, low, high, base, size, p - 1, x - 1, n, -1)
        right, right_used = self.side(raw, low, high, base, size, p + block, x + block, n, 1)
        rows = np.arange(len(p))
        best, start, end = np.full(len(p), e + 1), p.copy(), p + block
        for i in range(n + 1):  # bytes of the window before the block
            j = rest - i
            fits = (j >= 0) & (i <= x) & (x + block + j <= size)
            j = np.maximum(j, 0)
            cost = np.where(fits, left[rows, i].astype(np.int64) + right[rows, j], e + 1)
            better = cost < best
            best = np.where(better, cost, best)
            start = np.where(better, p - left_used[rows, i], start)
            end = np.where(better, p + block + right_used[rows, j], end)
        best, start, end = np.where(whole, 0, best), np.where(whole, p, np.maximum(start, low)), np.where(whole, p + block, np.minimum(end, high))
        ok = best <= e
        if self.q < 8:  # a whole word or words
            ok &= ((start == low) | (raw[start - 1] == 32)) & ((end == high) | (raw[np.minimum(end, len(raw) - 1)] == 32))
        return text[ok], item[ok], start[ok] - low[ok], end[ok] - low[ok], best[ok]

    def side(self, raw, low, high, base, size, p, x, n, step):
        """costs() of the n benchmark bytes from x on and the text bytes from p on, in the direction of step."""
        i = x[:, None] + step * np.arange(n)
        pattern = np.where((i >= 0) & (i < size[:, None]), self.whole[np.clip(base[:, None] + i, 0, len(self.whole) - 1)], 1)
        j = p[:, None] + step * np.arange(n + self.edits)
        text = np.where((j >= low[:, None]) & (j < high[:, None]), raw[np.clip(j, 0, len(raw) - 1)], 2)
        return costs(pattern, text, self.edits)


class Benchmark:
    """The indexes of some benchmark texts, (item id, text) each."""

    def __init__(self, items: list[tuple[int, bytes]]):
        kinds: dict = {}
        for i, text in items:
            if text := normal(text)[0].strip(b" "):
                kinds.setdefault(budget(min(WINDOW, len(text))), []).append((i, text))
        self.indexes = [Index(own) for _, own in sorted(kinds.items())]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, start, end, edits), offsets in characters, of the regions of each text."""
        plain = [normal(x) for x in texts]
        whole = b"\n".join([*(x for x, _ in plain), b""])  # no benchmark gram holds a line end
        ends = np.cumsum([len(x) + 1 for x, _ in plain])
        out = []
        for index in self.indexes:
            parts = [x for x in index.find(whole, ends) if len(x[0])]
            if parts:
                out += [(t, index.ids[i], int(plain[t][1][a]), int(plain[t][1][b - 1]) + 1, e)
                        for t, i, a, b, e in merged(*(np.concatenate(x) for x in zip(*parts)))]
        return sorted(out)


def merged(text, item, start, end, edits):
    """(text, item, start, end, edits) of spans of one text and item that overlap or lie up to EDITS bytes apart, as one."""
    by = np.lexsort((start, item, text))
    held: list = []
    for t, i, a, b, e in zip(*(x[by].tolist() for x in (text, item, start, end, edits))):
        if held and held[:2] == [t, i] and a <= held[3] + EDITS:
            held[3:] = max(held[3], b), max(held[4], e)
        else:
            if held:
                yield tuple(held)
            held = [t, i, a, b, e]
    if held:
        yield tuple(held)


def blocks(benchmark: DataFrame):
    """The benchmark's texts in blocks of PASS_BYTES at most (a longer text is a block of its own)."""
    block, held = [], 0
    rows = benchmark.filter("item_id IS NOT NULL AND octet_length(text) > 0").select("item_id", "text").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        raw = row.text.encode()
        if block and held + len(raw) > PASS_BYTES:
            yield block
            block, held = [], 0
        block.append((row.item_id, raw))
        held += len(raw)
    if block:
        yield block


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, start, end, edits): regions of each whole text that repeat benchmark text.

    Case aside, and with each run of ASCII punctuation and white space as one blank, a region holds a window of 64
    bytes with 3 edits at most, or the whole of a shorter item with one edit for each full 16 bytes; an item under
    16 bytes must occur as it is, one under 8 bytes between blanks. Every document and item with such a window is
    reported, and no other. Regions up to 3 bytes apart are one; start and end count characters.

    Null, empty and wordless texts and items have none, repeated rows give their regions each, null keys stay, and an
    empty benchmark gives no rows. A very long text is a step of its own, whose hits are grouped by parts that
    overlap by a window. Other columns are ignored.
    """
    rows = docs.select(key, F.col(text).alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, item_id long, start int, end int, edits int"
    found = None
    for block in blocks(benchmark):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Benchmark(shared.value)
            for batch, texts in steps(batches, size=STEP):
                regions = index.find(texts)
                at = pa.array([r[0] for r in regions], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), *(pa.array([r[k] for r in regions], pa.int64() if k == 1 else pa.int32())
                                                 for k in (1, 2, 3, 4))], names=[key, "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found if found is not None else rows.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no region of contaminated_regions(), whose cases apply."""
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Benchmark(shared.value)
            for batch, texts in steps(batches, size=STEP):
                bad = {r[0] for r in index.find(texts)}
                yield batch.take(pa.array([k for k in range(len(texts)) if k not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
