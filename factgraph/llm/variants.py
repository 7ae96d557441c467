"""Spelling variant grouping: words one edit apart, by pairs of trie nodes, and the form each rare word stands for.

Words are runs of Latin letters, counted over all whole texts. Their distinct spellings are sorted; a node of the trie of
all spellings (a prefix) is numbered by the first spelling that has it, and its depth. The same is done for the reversed
spellings (suffixes). Two spellings differ by one replaced letter where they have the same (prefix node, suffix node) on
both sides of a skipped letter, and by one inserted letter where the pair beside a skipped letter of the longer one is
the pair at a cut of the shorter one. These are equi-joins of integer pairs, and exact. All spellings that skip to one
pair differ in one letter only, so a pair holds no more of them than the alphabet has letters; no pairs of words are made.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps
from factgraph.llm.crc import crc32s, shifted
from factgraph.runtime import discard, materialize

#: Spellings of fewer letters or fewer occurrences are no words; a form occurs so many times as often.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many runs, by a digest of document and run, is read with a letter missing.
SLIPS = 199
STEP = 1 << 20
#: A node's number is its first spelling's number and its depth in these low bits: spellings have fewer than 2^24 letters.
DEPTH_BITS = 24

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII = np.zeros(256, bool)
ASCII[97:123] = True


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, run starts, run ends, runs of each text): a-z, A-Z lower-cased, and U+00C0 to U+00FF, which are C3 and one more byte."""
    raw = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    lead = raw == 0xC3
    inside = ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    past = np.cumsum([len(x) + 1 for x in texts])
    return raw, start, end, np.diff(np.searchsorted(start, past), prepend=0)


def gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The runs raw[start:start + size] as a binary array."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw[at])])


def counted(names: list[str], texts: list[bytes], least: int) -> pa.StructArray:
    """Distinct spellings of at least `least` letters in texts with their counts; names are the documents' ids as text."""
    raw, start, end, counts = runs(texts)
    size = end - start
    heads = [f"{x}:".encode() for x in names]
    crc = shifted(np.repeat(np.array([zlib.crc32(x) for x in heads], np.uint32), counts), size) ^ crc32s(raw, start, end)
    letters = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
    letters = letters[end] - letters[start]
    slip = crc % np.uint32(SLIPS) == 0
    whole = np.flatnonzero(~slip & (letters >= least))
    parts = [gathered(raw, start[whole], size[whole])]
    cut = []
    for k in np.flatnonzero(slip & (letters > least)):
        word, at = raw[start[k]:end[k]].tobytes().decode(), int(crc[k]) % int(letters[k])
        cut.append((word[:at] + word[at + 1:]).encode())
    return pc.value_counts(pa.concat_arrays([*parts, pa.array(cut, pa.binary())]))


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the whole texts of docs (doc_id, text): spellings with enough letters and occurrences."""
    def run(batches):
        for batch, texts in steps(batches, size=STEP):
            found = counted(batch.column(0).to_pylist(), texts, least_letters)
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def trie_nodes(spellings: DataFrame, name: str) -> DataFrame:
    """(word, id, nodes) of distinct spellings (word, spelling): id is a spelling's place in sorted order, nodes those of its prefixes, from none to all of it.

    Ranges of the sorted spellings are walked apart, each with the path of the spelling before only. A prefix that goes
    on from one range into the next belongs to the first that has it; the driver passes the paths at the ends of the
    ranges on, one spelling for each range.
    """
    def walk(batches):
        number, before, path = 0, "", [0]
        for batch in batches:
            ids, nodes = [], []
            for word in batch.column("spelling").to_pylist():
                k = 0
                while k < len(word) and k < len(before) and word[k] == before[k]:
                    k += 1
                path = path[:k + 1] + [number] * (len(word) - k)
                ids.append(number)
                nodes.append(path)
                before, number = word, number + 1
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("spelling"), pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))],
                                             names=["word", "spelling", "id", "nodes"])

    cut = spellings.repartitionByRange("spelling").sortWithinPartitions("spelling").mapInArrow(
        walk, "word string, spelling string, id long, nodes array<long>").withColumn("part", F.spark_partition_id())
    cut = materialize(cut, name)
    ends = sorted(cut.groupBy("part").agg(F.count("*").alias("n"), F.min("spelling").alias("first"), F.max("spelling").alias("last"),
                                          F.max_by("nodes", "spelling").alias("path")).collect())  # one row for each range
    rows, base, before, path = [], 0, "", []
    for x in ends:
        shared = 0
        while shared < min(len(before), len(x.first)) and before[shared] == x.first[shared]:
            shared += 1
        owners = path[:shared + 1]  # of the first spelling's prefixes, where they began before this range
        rows.append((x.part, base, x.first[:shared], owners))
        kept = 0
        while kept < min(shared, len(x.last)) and x.last[kept] == before[kept]:
            kept += 1
        path = owners[:kept + 1] + [base + v for v in x.path[len(owners[:kept + 1]):]]
        base, before = base + x.n, x.last
    bases = F.broadcast(spellings.sparkSession.createDataFrame(rows, "part int, base long, head string, owners array<long>"))
    rows = cut.join(bases, "part").withColumn("a", F.split("spelling", "")).withColumn("b", F.split("head", ""))
    common = F.when(F.length("head") == 0, 0).otherwise(F.aggregate(  # letters that the spelling shares with the head
        F.sequence(F.lit(0), F.length("head") - 1), F.lit(0), lambda n, k: F.when((n == k) & (F.get("a", k) == F.get("b", k)), k + 1).otherwise(n)))
    owner = F.transform("nodes", lambda v, k: F.when((k <= F.col("common")) & (k < F.size("owners")), F.get("owners", k)).otherwise(v + F.col("base")))
    return rows.withColumn("common", common).select("word", (F.col("id") + F.col("base")).alias("id"), F.transform(
        owner, lambda v, k: F.shiftleft(v, DEPTH_BITS) + k).alias("nodes"))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, word, n, n_near, best, best_n) of distinct words (word, n): id is the place in sorted order, best the near word of largest n, then least id.

    n_near counts each near word once: of letters that repeat, only the first one is skipped where a pair leads to a
    shorter word. Words without near words have n_near 0 and no best.
    """
    forward = trie_nodes(words.select("word", F.col("word").alias("spelling")), "forward")
    backward = trie_nodes(words.select("word", F.reverse("word").alias("spelling")), "backward")
    rows = words.join(forward, "word").join(backward.select("word", F.col("nodes").alias("back")), "word")
    rows = materialize(rows, "spellings")
    size, letters = F.length("word"), F.split("word", "")

    def pair(i, j, skip, first):
        return F.struct(F.get("nodes", i).alias("p"), F.get("back", j).alias("s"), F.lit(skip).alias("skip"), first.alias("first"))

    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(
        i, size - 1 - i, True, (i == 0) | (F.get("letters", i) != F.get("letters", F.greatest(i - 1, F.lit(0))))))
    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, size - i, False, F.lit(False)))
    pairs = rows.filter(size > 0).withColumn("letters", letters).select("id", "n", F.explode(F.concat(skips, cuts)).alias("x")).select("id", "n", "x.*")
    entry = F.struct((-F.col("n")).alias("less"), "id", "first")
    met = pairs.groupBy("p", "s").agg(  # at most one spelling for each letter, and one at the cut
        F.array_sort(F.collect_list(F.when(F.col("skip"), entry))).alias("skips"), F.min(F.when(~F.col("skip"), entry)).alias("cut"))
    met = met.filter((F.size("skips") > 1) | ((F.size("skips") > 0) & F.col("cut").isNotNull()))

    def side(id_, links, best):
        return F.struct(id_.alias("id"), links.cast("long").alias("links"), F.struct(best["less"].alias("less"), best["id"].alias("id")).alias("best"))

    shorter = F.col("cut").isNotNull()
    firsts = F.filter("skips", lambda x: x["first"])
    none = F.lit(None).cast("struct<less:bigint,id:bigint,first:boolean>")
    of_skips = F.transform("skips", lambda x, k: side(
        x["id"], F.size("skips") - 1 + (x["first"] & shorter).cast("int"),
        F.least(F.get("skips", F.when(k == 0, 1).otherwise(0)), F.when(x["first"] & shorter, F.col("cut")), none)))
    of_cut = F.when(shorter & (F.size(firsts) > 0), F.array(side(F.col("cut.id"), F.size(firsts), F.get(firsts, 0))))
    sides = met.select(F.explode(F.concat(of_skips, F.coalesce(of_cut, F.slice(of_skips, 1, 0)))).alias("x")).select("x.*")
    near = sides.groupBy("id").agg(F.sum("links").alias("n_near"), F.min(F.when(F.col("best.id").isNotNull(), F.col("best"))).alias("best"))
    return rows.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.id").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, form), at most one for each id and without circles: the last of the chain, by doubling its length each round."""
    hops = materialize(links.select("id", F.col("form").alias("root")), "hops")
    while True:
        on = hops.select(F.col("id").alias("root"), F.col("root").alias("next"))
        more = materialize(hops.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "hops")
        discard(hops)
        hops = more.drop("moved")
        if more.filter("moved").isEmpty():
            return hops


def grouped(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    A word's form is its near word of largest n (ties: the least in code-point order) if that occurs `times` times as
    often; root follows forms to the last, and is the word itself if it has none. n grows along forms, so they have no
    circles. Null and empty texts have no words; repeated rows count again; a null doc_id is the empty text in the
    digest; other columns are ignored; without words there are no rows. Words have fewer than 2^24 letters.
    """
    words = materialize(word_counts(docs, least_letters, least_count), "words")
    near = materialize(neighbours(words), "near")
    forms = near.filter(F.col("best_n") >= times * F.col("n")).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    names = near.select("id", "word")
    rows = near.join(forms, "id", "left").join(roots(forms), "id", "left")
    rows = rows.join(names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form", "left")
    rows = rows.join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root", "left")
    return rows.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
