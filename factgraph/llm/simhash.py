"""SimHash near-duplicate classes: Hamming neighbours found in BK-trees, one forest per shard task.

Fingerprints are dealt to shards so that every pair within the radius shares one, coarse enough that a shard has
about TREE codes. They form a BK-tree, whose children are keyed by their integer Hamming distance to the parent; a
query follows only edges within the radius of its own distance. All trees of a task are built and searched level
by level as arrays. The trees grow with the corpus, so they are shuffled to their queries by shard instead of
being broadcast.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps
from factgraph.operators.components import connected_components
from factgraph.runtime import materialize

#: Rows of one shard that meet in one task; a larger shard is dealt out as pairs of blocks of this size.
BLOCK = 20_000
#: Codes of a tree, by which the bits of the shard keys are chosen.
TREE = 2_000
#: Rows that a task gathers, shards whole, before it builds their forest; rows it searches for at once.
GATHER, ASKS = 100_000, 500
#: Rows and shingles of a block of a shard whose sets are compared; bytes of sets that a task gathers, shards whole.
SET_BLOCK, SET_BLOCK_SIZE, GATHER_BYTES = 2_000, 2_000_000, 32 << 20


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, A-Z lower-cased; fewer words: of the whole sequence."""
    words = text.lower().split()  # bytes split at and lower only ASCII
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words)))
    starts = [0, *(e + k for k, e in enumerate(ends, 1))]
    return np.array([h(line[a:b + size - 1], 42) for a, b in zip(starts, _ends(ends, size))], np.uint64)


def _ends(ends, size):
    return (e + k for k, e in enumerate(ends[size - 1:]))


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` unsigned 64-bit words whose bits are set in over half of the hashes (mixed anew for each word)."""
    out = np.zeros(words, np.uint64)
    if len(hashes):
        for k in range(words):
            h = hashes if k == 0 else mixed(hashes, k)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            total = np.zeros(64, np.int64)
            for i in range(0, len(bits), 255):
                total += np.add.reduce(bits[i:i + 255], axis=0, dtype=np.uint8)
            out[k] = np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same values."""
    h = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, min_keys: int = 0,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, code binary of 8 * words bytes, big-endian words, keys array<long>): keys are min_keys min-hashes.

    Null and wordless texts have the code zero and no keys. Repeated rows and null keys stay.
    """
    def run(batches):
        for batch, texts in steps(batches):
            codes, keys = [], []
            for x in texts:
                h = shingle_hashes(x, shingle)
                codes.append(majority(h, words).astype(">u8").tobytes())
                keys.append([int(mixed(h, 100 + k).min()) >> 8 << 4 | k for k in range(min_keys)] if len(h) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[key, "code", "keys"])

    rows = docs.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, code binary, keys array<long>")


def shard_keys(n: int, radius: int, bits: int = 64, code: str = "code"):
    """Shard keys of an 8-byte code, about TREE of n evenly spread codes each.

    Codes within the radius agree on k of radius + k blocks of bits, whatever k, and so on the first bits of those
    blocks. k is the least one whose blocks have bits enough.
    """
    need = max(0, math.ceil(math.log2(max(1, n) / TREE)))
    if not need:
        return F.array(F.lit(0).cast("long"))
    k = next((k for k in (1, 2, 3) if need <= k * (bits // (radius + k))), 3)
    size = bits // (radius + k)
    first = min(size, -(-need // k))
    value = F.conv(F.hex(code), 16, -10).cast("long")
    blocks = [F.shiftrightunsigned(value, bits - i * size - first).bitwiseAND((1 << first) - 1) for i in range(radius + k)]
    keys = []
    for i, some in enumerate(itertools.combinations(blocks, k)):
        key = F.lit(i).cast("long")
        for x in some:
            key = F.shiftleft(key, first).bitwiseOR(x)
        keys.append(key)
    return F.array(*keys)


def refined(shards: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Rows (node, code, shard) with each shard of over BLOCK codes dealt anew, by every one of radius + 1 bit sets.

    Bit sets take every (radius + 1)-th bit, so codes within the radius agree on one of them.
    """
    hot = shards.groupBy("shard").count().filter(F.col("count") > BLOCK).select("shard", F.lit(True).alias("hot"))
    value = F.conv(F.hex("code"), 16, -10).cast("long")
    masks = [sum(1 << i for i in range(j, bits, radius + 1)) for j in range(radius + 1)]
    anew = F.array(*[F.xxhash64("shard", F.lit(j), value.bitwiseAND(m - (1 << 64) if m >> 63 else m)) for j, m in enumerate(masks)])
    return shards.join(hot, "shard", "left").select(
        "node", "code", F.explode(F.when(F.col("hot"), anew).otherwise(F.array("shard"))).alias("shard"))


def popcount(a, b):
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def forest_links(shard: np.ndarray, codes: np.ndarray, radius: int, visits: list | None = None) -> np.ndarray:
    """For each row the first row of its class under links within the radius inside its shard.

    The number of tree nodes that were compared is appended to `visits`.
    """
    n, span = len(shard), codes.shape[1] * 64 + 1
    order = np.argsort(shard, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
    sizes = np.diff(np.append(first, n))
    root = np.repeat(first, sizes)
    edge_keys, edge_child = [], []
    active, at = np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)]
    while len(active):  # place the rows of each tree, a level at a time
        edge = at * span + popcount(codes[active], codes[at])
        by = np.argsort(edge, kind="stable")
        lead = np.append(True, np.diff(edge[by]) != 0)
        child = active[by][lead]
        edge_keys.append(edge[by][lead])
        edge_child.append(child)
        below = np.repeat(child, np.diff(np.append(np.flatnonzero(lead), len(by))))
        rest = ~lead
        active, at = active[by][rest], below[rest]
    keys = np.concatenate(edge_keys) if edge_keys else np.empty(0, np.int64)
    by = np.argsort(keys)
    keys, child = keys[by], (np.concatenate(edge_child)[by] if edge_child else keys)
    label = np.arange(n)
    asks = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    compared = 0
    for query in np.split(asks, range(ASKS, len(asks), ASKS)):
        node = root[query]
        while len(query):
            compared += len(query)
            d = popcount(codes[query], codes[node])
            near = (d <= radius) & (label[query] != label[node])
            unite(label, query[near], node[near])
            a = np.searchsorted(keys, node * span + np.maximum(d - radius, 0))
            b = np.searchsorted(keys, node * span + np.minimum(d + radius, span - 1), side="right")
            count = b - a
            query = np.repeat(query, count)
            node = child[np.repeat(a - np.cumsum(count) + count, count) + np.arange(len(query))]
    if visits is not None:
        visits.append(compared)
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def unite(label, a, b):
    """Merge the classes of a[i] and b[i] in place; a class is known by its least row."""
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up
        rest = label[a] != label[b]
        a, b = a[rest], b[rest]


def linked(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all nodes (node long, code, shard) within the radius in a shared shard."""
    hot = nodes.groupBy("shard").count().filter(F.col("count") > BLOCK)
    hot = hot.select("shard", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    dealt = (
        nodes.join(hot, "shard", "left").withColumn("mine", mine)
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                                       .otherwise(F.filter(others, lambda x: x != F.col("mine")))))
        .select(F.when(F.col("blocks").isNull(), F.col("shard"))
                .otherwise(F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other"))).alias("shard"),
                "node", "code"))

    def run(batches):
        held = []

        def flush(table):
            code = np.array([np.frombuffer(x, ">u8") for x in table.column(2).to_pylist()]).astype(np.uint64)
            node = table.column(1).to_numpy()
            top = forest_links(table.column(0).to_numpy(), code, radius)
            pick = np.flatnonzero(top != np.arange(len(top)))
            return pa.RecordBatch.from_arrays([pa.array(node[pick]), pa.array(node[top[pick]])], names=["a", "b"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GATHER:
                table = pa.Table.from_batches(held).combine_chunks()
                shard = table.column(0).to_numpy()
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if cut:
                    yield flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
        if rows:
            yield flush(pa.Table.from_batches(held))

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def simhash_classes(docs: DataFrame, shingle: int = 4, radius: int = 4, words: int = 1, min_keys: int = 0,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, code, component): codes of all rows, linked where they differ in `radius` bits or fewer.

    component is the smallest key reachable over links, the row's own included. With min_keys = 0 the codes have
    64 bits and shards of bit blocks, which miss no pair; else shards are min-hash values of the shingles,
    for wide radii. Equal codes are one node, so copies add no links. A null text counts as empty (code zero); a
    null key takes part in no link and gets the component of its code's other rows, or null. Repeated rows stay.
    """
    prints = materialize(fingerprints(docs, shingle, words, min_keys, key, text), "prints")
    nodes = prints.filter(F.col(key).isNotNull()).groupBy("code").agg(
        F.min(F.struct(F.col(key).alias("node"), "keys")).alias("x")).select("code", "x.node", "x.keys")
    nodes = materialize(nodes, "nodes")
    if min_keys:
        shards = nodes.select("node", "code", F.explode("keys").alias("shard"))
    else:
        shards = refined(nodes.select("node", "code", F.explode(shard_keys(nodes.count(), radius)).alias("shard")), radius)
    links = linked(shards, radius)
    tops = connected_components(links)
    found = nodes.select("code", "node").join(tops, "node", "left").select(
        "code", F.coalesce("component", "node").alias("component"))
    return prints.drop("keys").join(found, "code", "left").select(key, "code", "component")


def similarity_radius(similarity: float, bits: int, slack: float = 2.0) -> int:
    """Bits that two sets of the given Jaccard similarity differ in, plus `slack` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def set_prints(docs: DataFrame, shingle: int, words: int, min_keys: int, key: str = "doc_id",
               text: str = "text", sets: bool = False) -> DataFrame:
    """(key, digest, size, code, keys) of each text's set of distinct shingles, or (key, digest, set) with `sets`.

    digest is a 128-bit hash of the set's 64-bit hashes, set the sorted upper halves of those, code its majority code
    of `words` words. A null or wordless text has the empty set and no keys.
    """
    def run(batches):
        for batch, texts in steps(batches):
            own = [np.unique(shingle_hashes(x, shingle)) for x in texts]
            digest = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in own], pa.binary())
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), digest, pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in own], pa.binary())],
                    names=[key, "digest", "set"])
                continue
            codes = [majority(h, words).astype(">u8").tobytes() for h in own]
            keys = [[int(mixed(h, 100 + k).min()) >> 8 << 4 | k for k in range(min_keys)] if len(h) else [] for h in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), digest, pa.array([len(h) for h in own], pa.int64()), pa.array(codes, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=[key, "digest", "size", "code", "keys"])

    rows = docs.select(key, F.col(text).alias("text"))
    more = "set binary" if sets else "size long, code binary, keys array<long>"
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, digest binary, {more}")


def similar_links(codes: np.ndarray, sets: list, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the rows of one shard whose sets have the Jaccard similarity and codes the radius.

    Every pair within the radius whose rows are not yet connected is compared exactly.
    """
    links, label = [], np.arange(len(sets))
    sizes = np.array([len(x) for x in sets])
    for i in range(1, len(sets)):
        low, high = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        near = np.flatnonzero((low >= similarity * high - 1e-6) & (popcount(codes[:i], codes[i]) <= radius))
        step = 1
        while len(near := near[label[near] != label[i]]):
            some, near = near[:step], near[step:]
            step = min(step * 4, 64)
            ends = np.cumsum(sizes[some])
            values = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
            shared = np.add.reduceat((sets[i][at] == values).astype(np.int64), ends - sizes[some])
            for j in some[shared / (sizes[some] + sizes[i] - shared) >= similarity].tolist():
                if label[j] != label[i]:
                    links.append((i, j))
                    label[label == label[j]] = label[i]
    return links


def verified(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) of rows (shard, node, code, set), each of the Jaccard similarity; a shard's rows meet in one task."""
    def run(batches):
        held, size = [], 0

        def flush(table):
            shard = table.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            a, b = [], []
            for start, end in itertools.pairwise(cuts):
                if end - start > 1:
                    part = table.slice(start, end - start)
                    code = np.array([np.frombuffer(x, ">u8") for x in part.column(2).to_pylist()]).astype(np.uint64)
                    own = [np.frombuffer(x, np.uint32) for x in part.column(3).to_pylist()]
                    node = part.column(1).to_pylist()
                    for i, j in similar_links(code, own, radius, similarity):
                        a.append(node[i])
                        b.append(node[j])
            return pa.RecordBatch.from_arrays([pa.array(a, table.schema.field(1).type), pa.array(b, table.schema.field(1).type)],
                                              names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHER_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                shard = table.column(0).to_numpy()
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if cut:
                    yield flush(table.slice(0, cut))
                rest = table.slice(cut)
                held, size = rest.to_batches(), rest.nbytes
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    kind = rows.schema["node"].dataType.simpleString()
    return rows.repartition("shard").sortWithinPartitions("shard").select("shard", "node", "code", "set").mapInArrow(
        run, f"a {kind}, b {kind}")


def dealt_by_size(nodes: DataFrame) -> DataFrame:
    """Rows (node, digest, code, shard) of shards with two rows or more; a large shard is dealt as pairs of blocks.

    Of shards that hold the same rows, which near copies share by the handful, one is dealt.
    """
    parts = F.greatest(F.count("*") / SET_BLOCK, F.sum("size") / SET_BLOCK_SIZE)
    shards = nodes.groupBy("shard").agg(
        F.count("*").alias("rows"), F.ceil(parts).cast("int").alias("blocks"),
        *[F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"members{k}") for k in (0, 1)]).filter("rows > 1")
    shards = shards.groupBy("rows", "members0", "members1").agg(F.min(F.struct("shard", "blocks")).alias("x")).select("x.*")
    mine = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine"))
    return (
        nodes.join(shards, "shard").withColumn("mine", mine)
        .withColumn("other", F.explode(F.when(F.col("blocks") < 2, F.array(F.lit(0))).otherwise(others)))
        .select("node", "digest", "code", F.when(F.col("blocks") < 2, F.col("shard")).otherwise(
            F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other"))).alias("shard")))


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """(key, code, component): classes of texts linked by a Jaccard similarity of their sets of five-word shingles.

    Codes of 256 bits within a radius of six standard deviations, in one of eight min-hash shards, only nominate
    pairs; a link needs the similarity of the sets, computed on 32-bit hashes: for sets of n shingles it is off by
    about n / 2**32 of itself. A pair at 0.8 shares no shard once in 390,000 pairs.
    Equal sets are one node. Null texts and keys, and repeated rows, are as in simhash_classes.
    """
    radius = similarity_radius(similarity, 256, 6.0)
    prints = materialize(set_prints(docs, shingle, 4, 8, key, text), "prints")
    nodes = prints.filter(F.col(key).isNotNull()).groupBy("digest").agg(
        F.min(F.struct(F.col(key).alias("node"), "size", "code", "keys")).alias("x")).select("digest", "x.*")
    nodes = materialize(nodes, "nodes")
    shards = nodes.select("node", "digest", "size", "code", F.explode("keys").alias("shard"))
    # Nodes are named by hashes here, since two sets may share a repeated key.
    likely = linked(shards.select(F.xxhash64("digest").alias("node"), "code", "shard"), radius)
    likely = materialize(likely.select("a").union(likely.select("b")).distinct(), "likely")
    asked = shards.join(likely, F.xxhash64("digest") == F.col("a"), "left_semi")
    dealt = materialize(dealt_by_size(asked), "dealt")
    ours = dealt.select(F.col("node").alias(key)).distinct()
    sets = set_prints(docs.join(ours, key, "left_semi"), shingle, 4, 8, key, text, sets=True)
    sets = sets.withColumnRenamed(key, "node").dropDuplicates(["node", "digest"])
    links = verified(dealt.join(sets, ["node", "digest"]), radius, similarity)
    tops = connected_components(links)
    found = nodes.select("digest", "node").join(tops, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    return prints.select(key, "code", "digest").join(found, "digest", "left").select(key, "code", "component")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without those that have a near duplicate of smaller doc_id in their class.

    Repeats of a doc_id go too; rows without a doc_id stay, since nothing names them.
    """
    classes = near_duplicate_classes(docs, shingle, similarity)
    tops = classes.filter("doc_id = component").groupBy("doc_id").count()
    tops = materialize(tops, "tops")
    # Both sides grow with the corpus: a sort-merge join at every size.
    kept = docs.join(tops.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if not tops.filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def op3(docs: DataFrame) -> DataFrame:
    found = simhash_classes(docs)
    return found.select("doc_id", F.lower(F.hex("code")).alias("fingerprint"), F.col("component").alias("component_id"))
