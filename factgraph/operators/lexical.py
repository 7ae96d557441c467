"""Lexical search: postings with weights and positions, web-style queries, and cover-density ranking.

A query is alternatives divided by `or`; each asks for all of its words and "phrases" and for none that a minus sign
precedes. Ranking follows covers: shortest runs of positions that hold every asked item (Clarke, Cormack and Tudhope).
"""

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions.stemming import stem, stems

#: Weights of title, body, attribute surface and addenda; a cover of up to FLAT positions counts whole.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
FLAT = 4
# English words that carry no meaning of their own, as published with the stemmer.
STOP = tuple("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())


def words(c):
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def lexeme(word, mode: str = "simple"):
    """A word as it is searched: simple leaves it, english takes its stem; stop words are left out by the caller."""
    return word if mode == "simple" else stems(word)


def postings(nodes: DataFrame, sections: dict[str, str], mode: str = "simple") -> DataFrame:
    """(id, lexeme, pos, weight): sections maps weights A to D to columns, whose words are counted on in that order."""
    rows, before = nodes.select("id", *set(sections.values())), F.lit(0)
    parts = None
    for letter, column in sections.items():
        own = rows.select("id", F.posexplode(words(F.col(column))).alias("k", "word"), before.alias("base"))
        own = own.select("id", lexeme(F.col("word"), mode).alias("lexeme"), (F.col("base") + F.col("k")).cast("int").alias("pos"), F.lit(WEIGHTS[letter]).alias("weight"), "word")
        parts = own if parts is None else parts.unionByName(own)
        before = before + F.size(words(F.col(column))) + 1
    return parts.filter(~F.col("word").isin(*STOP) if mode == "english" else F.lit(True)).drop("word")


def clauses(requests: DataFrame, mode: str = "simple") -> DataFrame:
    """(request_id, alt, item, negative, k, lexeme): the items of each alternative of a query, lexeme by lexeme."""
    raw = requests.select("request_id", F.posexplode(F.regexp_extract_all("query", F.lit('-?"[^"]*"|\\S+'), F.lit(0))).alias("item", "raw"))
    alt = F.sum((F.lower("raw") == "or").cast("int")).over(Window.partitionBy("request_id").orderBy("item"))
    items = raw.withColumn("alt", alt).filter("lower(raw) <> 'or'").withColumn("negative", F.col("raw").startswith("-"))
    found = items.select("request_id", "alt", "item", "negative", F.posexplode(words(F.col("raw"))).alias("k", "word"))
    if mode == "english":
        found = found.filter(~F.col("word").isin(*STOP))
    return found.select("request_id", "alt", "item", "negative", "k", lexeme(F.col("word"), mode).alias("lexeme"))


def matches(asked: DataFrame, postings_: DataFrame) -> DataFrame:
    """(request_id, alt, id, item, pos, weight): where the items asked for occur, in nodes that satisfy an alternative."""
    sizes = asked.groupBy("request_id", "alt", "item", "negative").agg(F.count("*").alias("n"))
    met = asked.join(postings_, "lexeme").select("request_id", "alt", "item", "negative", "id", (F.col("pos") - F.col("k")).alias("pos"), "weight")
    at = met.groupBy("request_id", "alt", "item", "negative", "id", "pos").agg(F.count("*").alias("hit"), F.min("weight").alias("weight"))
    at = at.join(sizes, ["request_id", "alt", "item", "negative"]).filter("hit = n")
    need = sizes.filter("NOT negative").groupBy("request_id", "alt").agg(F.count("*").alias("need"))
    fit = at.groupBy("request_id", "alt", "id").agg(F.count_distinct(F.when(~F.col("negative"), F.col("item"))).alias("have"), F.max("negative").alias("bad"))
    fit = fit.join(need, ["request_id", "alt"]).filter("have = need AND NOT bad").select("request_id", "alt", "id", "need")
    return at.filter("NOT negative").join(fit, ["request_id", "alt", "id"]).select("request_id", "alt", "id", "item", "pos", "weight", "need")


def cover_density(found: DataFrame) -> DataFrame:
    """(request_id, id, score): the sum over covers of the harmonic mean of weights, less for covers over FLAT positions; best alternative.

    A node's matched positions are folded in order; only the last place of each item is kept.
    """
    rows = found.groupBy("request_id", "alt", "id").agg(F.max("need").alias("need"), F.array_sort(F.collect_list(F.struct("pos", "item", "weight"))).alias("at"))
    start = F.expr("named_struct('last', cast(array() as array<struct<item:int,pos:int,inv:double>>), 'left', -1, 'score', 0D)")

    def step(s, x):
        last = F.array_append(F.filter(s["last"], lambda y: y["item"] != x["item"]), F.struct(
            x["item"].alias("item"), x["pos"].alias("pos"), (1 / x["weight"]).alias("inv")))
        left = F.array_min(F.transform(last, lambda y: y["pos"]))
        inv = F.aggregate(F.transform(last, lambda y: y["inv"]), F.lit(0.0), lambda a, y: a + y)
        new = (F.size(last) == F.col("need")) & (left > s["left"])
        gain = F.col("need") / inv * F.least(F.lit(1.0), F.lit(float(FLAT)) / (x["pos"] - left + 1))
        return F.struct(last.alias("last"), F.when(new, left).otherwise(s["left"]).alias("left"), F.when(new, s["score"] + gain).otherwise(s["score"]).alias("score"))

    return rows.withColumn("score", F.aggregate("at", start, step, lambda s: s["score"])).groupBy("request_id", "id").agg(F.max("score").alias("score"))


def ranked_leg(requests: DataFrame, postings_: DataFrame, nodes: DataFrame, sets: DataFrame, k: int = 30, mode: str = "simple") -> DataFrame:
    """(request_id, id, score, rank): the k best active nodes in the request's scopes, ties by id."""
    scored = cover_density(matches(clauses(requests, mode), postings_)).withColumn("score", F.round("score", 6))
    live = nodes.filter("status = 'active'").select("id", "scope_id").join(sets, "scope_id").select("request_id", "id")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    return scored.join(live, ["request_id", "id"], "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_in_texts(requests: DataFrame, nodes: DataFrame, sections: dict[str, str], sets: DataFrame, k: int = 30, mode: str = "simple", block: int = 256) -> DataFrame:
    """ranked_leg() over the postings() of nodes, found text by text.

    Requests go to the tasks in blocks, with the scopes that sets (request_id, scope_id) gives them. A task counts the
    words asked for in its texts, leaves out texts whose counts allow no score among the k best so far, ranks covers in
    the others and keeps k rows of a request, so no postings are shuffled.
    """
    live = nodes.filter("status = 'active'").select("id", "scope_id", *[words(F.col(c)).alias(letter) for letter, c in sections.items()])
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((requests, "request_id"), (nodes, "id"))]
    item = F.struct("alt", "item", "negative", "k", "lexeme")
    asked = clauses(requests, mode).groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("terms"))
    asked = asked.join(sets.groupBy("request_id").agg(F.collect_set("scope_id").alias("scopes")), "request_id").orderBy("request_id")
    schema, stream, parts = f"request_id {kinds[0]}, id {kinds[1]}, score double", asked.toLocalIterator(), []
    while rows := list(itertools.islice(stream, block)):
        parts.append(live.mapInArrow(_ranks(rows, list(sections), k, mode), schema))
    found = functools.reduce(DataFrame.union, parts) if parts else requests.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Texts whose words a task of best_in_texts() counts at once, and words that it remembers.
TEXTS, KNOWN = 256, 500_000


def _alternatives(rows, codes: dict[str, int]) -> list[tuple[int, list, list]]:
    """(place of the request, wanted, unwanted) of each alternative that wants something; an item is its lexemes (code, k)."""
    out = []
    for at, r in enumerate(rows):
        for _, terms in itertools.groupby(r.terms, key=lambda x: x.alt):
            items = [(x[0].negative, [(codes.setdefault(y.lexeme, len(codes)), y.k) for y in x]) for x in (list(g) for _, g in itertools.groupby(terms, key=lambda x: x.item))]
            wanted = [x for negative, x in items if not negative]
            if wanted:
                out.append((at, wanted, [x for negative, x in items if negative]))
    return out


def _places(item, spots):
    """Where an item occurs in a text, and its weight there, by spots(code) -> (places, weights)."""
    place, weight = spots(item[0][0])
    place = place - item[0][1]
    for code, k in item[1:]:
        other, own = spots(code)
        place, i, j = np.intersect1d(place, other - k, assume_unique=True, return_indices=True)
        weight = np.minimum(weight[i], own[j])
    return place, weight


def _density(found) -> float:
    """cover_density() of one alternative's items, each (places, weights)."""
    need = len(found)
    if need == 1:
        return math.fsum(found[0][1])
    pos, weight = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    item = np.repeat(np.arange(need), [len(x[0]) for x in found])
    order = np.lexsort((item, pos))
    pos, weight, item = pos[order], weight[order], item[order]
    if need == 2:  # a cover ends where the other item came just before
        end = np.flatnonzero(np.diff(item)) + 1
        end = end[np.diff(pos[end - 1], prepend=-1) > 0]
        return math.fsum(2 / (1 / weight[end - 1] + 1 / weight[end]) * np.minimum(1.0, FLAT / (pos[end] - pos[end - 1] + 1)))
    last, left, score = {}, -1, 0.0
    for i, p, w in zip(item.tolist(), pos.tolist(), weight.tolist()):
        last[i] = (p, 1 / w)
        if len(last) == need and (low := min(x for x, _ in last.values())) > left:
            left = low
            score += need / sum(x for _, x in last.values()) * min(1.0, FLAT / (p - left + 1))
    return score


def _ranks(rows, letters: list[str], k: int, mode: str):
    """A task that ranks texts (id, scope_id, words of each section) for the requests in rows (request_id, terms, scopes)."""
    codes: dict[str, int] = {}
    alternatives = _alternatives(rows, codes)
    names, masks, none = [r.request_id for r in rows], {}, np.zeros(len(rows), bool)
    for at, r in enumerate(rows):
        for scope in r.scopes:
            masks.setdefault(scope, none.copy())[at] = True
    weights = [WEIGHTS[x] for x in letters]
    top = max(weights)
    rest = max([x for x in weights if x < top], default=top)
    stop = frozenset(STOP) if mode == "english" else frozenset()

    def code(word):
        return -1 if word in stop else codes.get(stem(word) if mode == "english" else word, -1)

    def run(batches):
        best, known, kind = [[] for _ in names], {}, None
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS)):
                n, base, held = part.num_rows, np.zeros(part.num_rows, np.int64), []
                for letter, weight in zip(letters, weights):
                    column = part.column(letter)
                    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    coded = column.flatten().dictionary_encode()
                    if len(known) > KNOWN:
                        known.clear()
                    own = coded.dictionary.to_pylist()
                    for word in own:
                        if word not in known:
                            known[word] = code(word)
                    found = np.array([known[x] for x in own], np.int64)[coded.indices.to_numpy()]
                    row = np.repeat(np.arange(n), size)
                    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + base[row]
                    some = found >= 0
                    held.append((row[some], found[some], pos[some], np.full(some.sum(), weight)))
                    base += size + 1
                row, found, pos, weight = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((pos, found, row))
                key, pos, weight = (row * len(codes) + found)[order], pos[order], weight[order]
                count = np.bincount(key, minlength=n * len(codes))
                starts = np.concatenate([[0], np.cumsum(count)])
                count = count.reshape(n, -1)
                first = np.bincount(key[weight == top], minlength=n * len(codes)).reshape(n, -1)
                seen = np.array([masks.get(s, none) for s in part.column("scope_id").to_pylist()]).reshape(n, -1)
                chances = [[] for _ in names]  # (greatest score that counts allow, place of the text, alternative)
                for alternative in alternatives:
                    at, wanted, _ = alternative
                    of, ahead = (np.stack([x[:, [c for c, _ in item]].min(axis=1) for item in wanted]) for x in (count, first))
                    covers = of[0] if len(wanted) == 1 else 2 * of.min(axis=0) if len(wanted) == 2 else of.sum(axis=0)
                    bound = top * covers if len(wanted) > 2 else rest * covers + (top - rest) * np.minimum(covers, len(wanted) * ahead.sum(axis=0))
                    fit = np.flatnonzero(seen[:, at] & (of.min(axis=0) > 0))
                    chances[at] += [(b, i, alternative) for b, i in zip(bound[fit].tolist(), fit.tolist())]
                ids = part.column("id").to_pylist()
                for at, some in enumerate(chances):
                    scores, enough = {}, -best[at][-1][0] if len(best[at]) >= k else 0
                    for bound, i, (_, wanted, unwanted) in sorted(some, key=lambda x: -x[0]):
                        if bound * 1e6 + 1 < enough:
                            break

                        def spots(c, i=i):
                            place = slice(starts[i * len(codes) + c], starts[i * len(codes) + c + 1])
                            return pos[place], weight[place]

                        places = [_places(x, spots) for x in wanted]
                        if all(len(x[0]) for x in places) and not any(len(_places(x, spots)[0]) for x in unwanted):
                            scores[i] = max(scores.get(i, 0.0), _density(places))
                            if len(scores) % k == 0:
                                whole = sorted([*(-x[0] for x in best[at]), *(math.floor(x * 1e6 + 0.5) for x in scores.values())], reverse=True)
                                enough = whole[k - 1] if len(whole) >= k else 0
                    if scores:
                        best[at] = sorted([*best[at], *((-math.floor(x * 1e6 + 0.5), ids[i], x) for i, x in scores.items())])[:k]
        flat = [(names[at], i, x) for at, some in enumerate(best) for _, i, x in some]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat]), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat])],
                                             names=["request_id", "id", "score"])
    return run
