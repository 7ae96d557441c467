"""Byte-level BPE encoding and decoding.

A pre-token's pairs wait in a rank queue: one bucket of positions per merge rank, and a bitmap of three
levels over the buckets whose lowest set bit is the next rank. Positions form a linked list; an entry whose
pair has changed since is skipped. The work for a pre-token of n bytes is O(n log n) for any n.
"""

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import lists, steps

#: Bytes of each of an encoder's two cache generations, with ENTRY for an entry beside its text and ids.
CACHE, ENTRY = 48 << 20, 240
#: Bytes of text that the encoder handles at once, and of uncached pre-tokens that one queue serves.
STEP = 1 << 18
NONE = 1 << 30


class RankQueue:
    """Buckets of positions by merge rank under a bitmap of three levels; the lowest set bit is the next rank."""

    def __init__(self, size):
        self.low, self.mid, self.top = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1), 0
        self.buckets = {}

    def push(self, rank, positions):
        """A rank that has no bucket yet."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self):
        """(rank, positions in order) of the smallest rank, or None when empty."""
        top = self.top
        if not top:
            return None
        i = (top & -top).bit_length() - 1
        word = self.mid[i]
        j = i << 6 | (word & -word).bit_length() - 1
        word = self.low[j]
        rank = j << 6 | (word & -word).bit_length() - 1
        self.low[j] = word = word & (word - 1)
        if not word:
            self.mid[i] = word = self.mid[i] & ~(1 << (j & 63))
            if not word:
                self.top = top & ~(1 << i)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


def letters_below(limit):
    """Character classes of a regular expression for the letters and numbers of code points below limit."""
    import unicodedata

    of = {"L": [], "N": []}
    for c in map(chr, range(limit)):
        if (kind := unicodedata.category(c)[0]) in of:
            of[kind].append(re.escape(c))
    return "".join(of["L"]), "".join(of["N"])


class Bpe:
    """Encoder for a rank file. It keeps the ids of recent pre-tokens in two generations."""

    def __init__(self, path, pattern):
        ranks = self.ranks = read_ranks(path)
        size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.byte_pairs = {}
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = ranks.get(bytes([a, b]), NONE)
        self.byte_pairs = np.array(list(self.byte_pairs.values()), np.int64)
        self.queue = RankQueue(size)
        self.forget()
        # White space as Unicode defines it; below U+0180 the classes are spelled out for the plain engine.
        self.any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        let, num = letters_below(0x180)
        space = "\\t-\\r \\x85\\xa0"
        self.few = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{let}{num}]").replace(r"\p{L}", f"[{let}]")
                              .replace(r"\p{N}", f"[{num}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        self.beyond = re.compile("[^\x00-ſ]")

    def forget(self):
        """Drop the cache: a worker outlives its task, and serves other stages next."""
        self.young, self.old, self.held = {}, {}, 0

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian bytes; one queue serves all of them."""
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ids = self.byte_id[raw]
        ends = np.cumsum([len(x) for x in pieces])
        n, pairs, queue = len(ids), self.pairs, self.queue
        buckets = queue.buckets
        ranks = np.append(self.byte_pairs[raw[:-1] << 8 | raw[1:]], NONE)
        ranks[ends - 1] = NONE
        order = np.argsort(ranks, kind="stable")
        order = order[: np.searchsorted(ranks[order], NONE)]
        for part in np.split(order, np.flatnonzero(np.diff(ranks[order])) + 1):
            if len(part):
                queue.push(int(ranks[part[0]]), part.tolist())
        due, ids = ranks.tolist(), ids.tolist()  # due: the rank of the pair that starts here
        after = np.arange(1, n + 1)
        after[ends - 1] = n
        before = np.arange(-1, n - 1)
        before[np.append(0, ends[:-1])] = -1
        after, before = after.tolist(), before.tolist()
        while (found := queue.pop()) is not None:
            rank, positions = found
            for at, i in enumerate(positions):
                if due[i] != rank:  # stale
                    continue
                j = after[i]
                k = after[j]
                ids[i], after[i], due[j], ids[j], due[i] = rank, k, NONE, -1, NONE
                lower = False
                if k < n:
                    before[k] = i
                    if (r := pairs.get(rank << 20 | ids[k], NONE)) != NONE:
                        due[i] = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            queue.push(r, [i])
                        lower = r < rank
                if (h := before[i]) >= 0:
                    due[h] = r = pairs.get(ids[h] << 20 | rank, NONE)
                    if r != NONE:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            queue.push(r, [h])
                        lower = lower or r < rank
                if lower:  # that pair comes before what is left of this bucket
                    if rest := positions[at + 1:]:
                        if rank in buckets:
                            buckets[rank] += rest
                        else:
                            queue.push(rank, rest)
                    break
        ids = np.array(ids, np.int64)
        left = np.add.reduceat(ids >= 0, np.append(0, ends[:-1]))
        out, at = ids[ids >= 0].astype("<u4").tobytes(), (np.cumsum(left) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *at], at)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        strings = [x.decode(errors="replace") for x in texts]
        tokens = [(self.any if self.beyond.search(x) else self.few).findall(x) for x in strings]
        if self.held >= CACHE:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        new = set()
        for x in tokens:
            new.update(set(x).difference(young))
        hard, size = [], 0
        for token in new:
            if (ids := old.get(token)) is None:
                raw = token.encode()
                if (whole := self.ranks.get(raw)) is None:
                    hard.append(token)
                    size += len(raw)
                    if size >= STEP:
                        self.solve(hard)
                        hard, size = [], 0
                    continue
                ids = whole.to_bytes(4, "little")
            young[token] = ids
            self.held += ENTRY
        if hard:
            self.solve(hard)
        return [np.frombuffer(b"".join(map(young.__getitem__, x)), "<u4") for x in tokens]

    def solve(self, tokens: list[str]):
        """Merge pre-tokens that no cache holds."""
        raw = [x.encode() for x in tokens]
        ids = self.merge(raw)
        self.young.update(zip(tokens, ids))
        self.held += ENTRY * len(raw) + sum(map(len, raw)) + sum(map(len, ids))


def read_ranks(path) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Decoder:
    """The bytes of every id, end to end."""

    def __init__(self, path):
        by_id = {rank: token for token, rank in read_ranks(path).items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(x) for x in tokens], np.int32)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.bytes[at + np.arange(len(at))].tobytes()


_LOADED: dict = {}


def loaded(kind, *args):
    """One encoder or decoder for each worker: its tables stay, its cache goes with the task."""
    if (kind.__name__, *args) not in _LOADED:
        _LOADED[kind.__name__, *args] = kind(*args)
    return _LOADED[kind.__name__, *args]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, packed: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text, without special tokens.

    ids is array<int>, or with packed a binary of little-endian unsigned 32-bit integers. A null text is empty and
    has no ids, and bytes that are not UTF-8 count as U+FFFD; repeated rows and null keys stay; other columns are
    ignored. A very long text is a step of its own, a very long pre-token a queue of its own. ranks_path is read by the workers, so
    it names a file that each of them has.
    """
    def run(batches):
        bpe = loaded(Bpe, ranks_path, pattern)
        try:
            for batch, texts in steps(batches, size=STEP):
                found = bpe.encode(texts)
                ids = pa.array([x.tobytes() for x in found], pa.binary()) if packed else lists(
                    np.concatenate(found).astype(np.int32), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])
        finally:
            bpe.forget()

    rows = docs.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids {'binary' if packed else 'array<int>'}")


def bpe_decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, bytes binary): the text that the ids stand for, in either form of ids. Null ids decode to no bytes."""
    rows = tokens.select(key, F.col(ids).alias("ids"))
    kind = rows.schema["ids"].dataType.simpleString()

    def run(batches):
        bpe = loaded(Decoder, ranks_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                own = [np.empty(0, np.int32) if not x.is_valid else np.frombuffer(x.as_py(), "<u4") if kind == "binary" else x.values.to_numpy()
                       for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(bpe.decode, own), pa.binary())],
                                                 names=[key, "ids", "bytes"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids {kind}, bytes binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named, n_tokens, ids_sha256 and decoded_sha256 of packed ids and their bytes."""
    return decoded.select("doc_id", *more, F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
