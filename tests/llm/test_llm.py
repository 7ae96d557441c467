"""Each corpus operation against a brute-force version and on hostile rows."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from factgraph.llm import bpe, chat, decontamination, pii, quality, secrets, sharding, simhash, substrings, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, code string, spans string"


def docs(spark, texts, **more):
    return spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t or ""), 1, "x", "y") for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choices(["ta", "re", "on", "é", "the", "ß"], k=rng.randint(1, 4))) for _ in range(400)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=60))
    out += [out[3], out[3], out[5] + " tail", " ".join(out[7].split()[:40]) + "\n" + passage, passage.upper(), "x " + passage + " y"]
    out += ["", None, " \t\n", "a", "one two three", "Ab\x0bcd\x1cef", "w " * 300, "the same line\nthe same line\n" * 9, "z" * 20_000, " ".join(words * 12)]
    return out


def by_id(df):
    return {r[0]: r for r in df.collect()}


def hostile(spark):
    """Null keys, repeated rows, nulls in every column, and no rows at all."""
    rows = [(None, None, None, None, None, None, None, None), (1, "a b c", None, None, None, None, None, None)] * 2
    return [spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)]


def test_bpe_equals_library_and_round_trips(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hard = texts + ["<|endoftext|>", "a'll  \n x", "１²Ⅷ\x85\x1c 中文 ſ\U0001F600", "aaaa" * 500]
    got = by_id(bpe.bpe_decode(bpe.bpe_encode(docs(spark, hard), path, public_tokenizers.PATTERN), path))
    for k, t in enumerate(hard):
        assert got[k].ids == want.encode_ordinary(t or "") and bytes(got[k].bytes) == (t or "").encode()
    for df in hostile(spark):
        out = bpe.digests(bpe.bpe_decode(bpe.bpe_encode(df, path, public_tokenizers.PATTERN, packed=True), path))
        assert out.count() == df.count()


def ascii_lower(t):
    return "".join(c.lower() if c < "\x80" else c for c in t)


def fingerprint(t):
    w = WORD.findall(ascii_lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_classes(spark, texts):
    got = by_id(simhash.op3(docs(spark, texts)))
    prints = [fingerprint(t) for t in texts]
    top = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            top[a] = min(top[b] for b in range(len(texts)) if (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{p:016x}", top[k]) for k, p in enumerate(prints)}
    for df in hostile(spark):
        assert simhash.op3(df).count() == df.count()
    assert rows_of(simhash.one_of_each(hostile(spark)[0])) == [1, None, None]


def rows_of(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))


@pytest.mark.parametrize("radius, words", [(4, 1), (30, 4)])
def test_forest_links_are_the_brute_force_classes(radius, words):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (30, words), dtype=np.uint64)
    codes = np.repeat(base, 12, axis=0)
    for k in range(len(codes)):
        for b in rng.integers(0, 64 * words, rng.integers(0, radius)):
            codes[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    shard = rng.integers(0, 3, len(codes))
    got = simhash.forest_links(shard, codes, radius)
    label = np.arange(len(codes))
    for _ in range(60):
        for k in range(len(codes)):
            near = (np.bitwise_count(codes ^ codes[k]).sum(axis=1) <= radius) & (shard == shard[k])
            label[near] = label[near].min()
    assert (got == label).all()


def test_hot_shards_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 10)
    codes = [(k, (1 << k % 30 | 1 << 40).to_bytes(8, "big"), 5) for k in range(64)]
    links = simhash.linked(spark.createDataFrame(codes, "node long, code binary, shard long"), 4)
    from factgraph.operators.components import connected_components
    assert {r.component for r in connected_components(links).collect()} == {0}


def test_quality_counts(spark, texts):
    got = by_id(quality.quality_rules(docs(spark, texts), None))
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        runs = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and r.kept != r.base_failed
    for df in hostile(spark):
        assert quality.quality_rules(df, None).count() == df.count() and quality.kept_rows(df, None).count() == 0


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["river", "stone", "of", "the", "morning", "light"], k=60)) for _ in range(120)]
    bad = [" ".join(rng.choices(["BUY!!", "now***", "CHEAP$$", "click", "here"], k=60)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(x for pair in zip(good, bad) for x in pair)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(160)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    got = by_id(quality.quality_rules(table, model))
    assert np.mean([(got[k].probability >= 0.5) == (k % 2 == 0) for k in range(160, 240)]) > 0.95
    assert quality.train(table, labels.filter("quality = 7")) is None


def near_codes(n, seed=3):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 2)]
    return out + [rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(n - len(out))]


@pytest.mark.parametrize("n", [10, 5_000, 10 ** 7, 10 ** 10])
def test_codes_within_the_radius_share_a_shard(spark, monkeypatch, n):
    codes = near_codes(600)
    nodes = spark.createDataFrame([(k, c.to_bytes(8, "big")) for k, c in enumerate(codes)], "node long, code binary")
    shards = nodes.select("node", "code", F.explode(simhash.shard_keys(n, 4)).alias("shard"))
    monkeypatch.setattr(simhash, "BLOCK", 30)
    for dealt in (shards, simhash.refined(shards, 4)):
        own = collections.defaultdict(set)
        for r in dealt.collect():
            own[r.node].add(r.shard)
        for a in range(600):
            for b in range(a):
                if (codes[a] ^ codes[b]).bit_count() <= 4:
                    assert own[a] & own[b]


def test_trees_prune():
    codes = np.array(near_codes(simhash.TREE), np.uint64).reshape(-1, 1)
    visits = []
    top = simhash.forest_links(np.zeros(len(codes), np.int64), codes, 4, visits)
    want = {(a, b) for a in range(len(codes)) for b in np.flatnonzero(np.bitwise_count(codes[:a, 0] ^ codes[a, 0]) <= 4).tolist()}
    assert all(top[a] == top[b] for a, b in want) and len(want) > 500
    assert sum(visits) < 0.6 * len(codes) ** 2  # random codes are the worst case; texts visit a seventh


def test_personal_data(spark, texts):
    samples = ["mail jo.98@mail5.example.com now", "+1 (729) 555-7725", "ip 240.56.125.154.", "card 4111 1111 1111 1111", "x%x@d.e@f.g 1.2.3.999", None, ""] + texts
    assert pii.fit(["a @ b", ""]).best([("a", 0, 1)]) == []
    model = pii.fit([t for t in samples if t])
    got = by_id(pii.personal_data(docs(spark, samples), model))
    assert [(s.kind, samples[0][s.start:s.end]) for s in got[0].base] == [("email", "jo.98@mail5.example.com")]
    assert [s.kind for s in got[1].base] == ["phone"] and [s.kind for s in got[2].base] == ["ip"] and [s.kind for s in got[3].base] == ["card"]
    assert got[5].spans == [] and got[6].spans == []
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got.values())
    for df in hostile(spark):
        assert pii.op5(df).count() == df.count()


def labellings(parts, n, at=0):
    """Every way to cover tokens with outside tokens and labelled candidates: lists of (part or None, kind, first token)."""
    if at == n:
        yield []
        return
    for rest in labellings(parts, n, at + 1):
        yield [(None, 0, at), *rest]
    for p, (i, j, _) in enumerate(parts):
        if i == at:
            for c in range(len(pii.KINDS)):
                for rest in labellings(parts, n, j):
                    yield [(p, c + 1, at), *rest]


def total_score(model, tokens, score, labelling):
    last, total = 0, 0.0
    for p, c, at in labelling:
        total += model.move[last, c] + (score[p][c - 1] if p is not None else model.out[int(tokens[at][0].isdigit())])
        last = c
    return total


def test_field_against_enumeration(monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 2)
    rng = np.random.default_rng(5)
    for text in ("a at b dot c", "12 345 67", "x@y.z 1", "+1 (23) 456"):
        (tokens,) = pii.regions("zz " + text) or [[(m[0], *m.span()) for m in pii.TOKEN.finditer(text)]]
        model = pii.SemiMarkov()
        model.w, model.move, model.out = (rng.normal(0, 0.4, x.shape) for x in (model.w, model.move, model.out))
        parts, index, score = model.scored(tokens)
        every = list(labellings(parts, len(tokens)))
        values = np.array([total_score(model, tokens, score, x) for x in every])
        best = every[int(values.argmax())]
        assert model.best(tokens) == [(pii.KINDS[c - 1], *parts[p][:2]) for p, c, _ in best if p is not None]
        gold = next((x for x in every if any(p is not None for p, *_ in x)), every[0])
        chance = np.exp(values - values.max())
        chance /= chance.sum()
        counts = lambda x, f: sum(f(*y) for y in x)
        moves, outs, weights = np.zeros_like(model.move), np.zeros(2), np.zeros_like(model.w)
        for share, x in [*zip(-chance, every), (1.0, gold)]:
            last = 0
            for p, c, at in x:
                moves[last, c] += share
                last = c
                if p is None:
                    outs[int(tokens[at][0].isdigit())] += share
                else:
                    np.add.at(weights[c], index[p], share)
        old = [x.copy() for x in (model.w, model.move, model.out)]
        model.learn(tokens, {parts[p][:2]: c for p, c, _ in gold if p is not None}, 1e-3)
        for new, was, want in zip((model.w, model.move, model.out), old, (weights, moves, outs)):
            assert np.allclose((new - was) / 1e-3, want, atol=2e-3)


def test_field_finds_held_out_forms_and_whole_regions(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices(["ta", "re", "on", "ing", "the", "au"], k=rng.randint(1, 4))) for _ in range(500)]

    def text():
        d = "".join(rng.choices("0123456789", k=15))
        card = next(d + c for c in "0123456789" if pii.luhn(d + c))
        own = [f"{rng.choice(words)}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", card, f"+{rng.randint(1, 99)} ({d[:3]}) 555-{d[3:7]}", f"{rng.randint(1, 255)}.2.3.4"]
        return " ".join(" ".join(rng.choices(words, k=12)) + " " + x for x in rng.sample(own, 2)) + ". " + " ".join(rng.choices(words, k=9))

    model = pii.fit([text() for _ in range(150)])
    tally = pii.held_out([text() for _ in range(150)], model)
    for kind in ("email", "card", "phone"):
        right, added, forms = tally[kind]
        assert forms > 50 and right >= 0.9 * forms and right >= 0.9 * added, tally
    spoken = "write to anna dot smith at posteo dot de or john (at) mail.org today"
    assert [spoken[a:b] for _, a, b, _ in pii.find_personal(spoken, model)] == ["anna dot smith at posteo dot de", "john (at) mail.org"]
    near = "12 34 5 " * 4_000 + spoken  # one region of over 30,000 characters
    assert len(pii.regions(near)) == 1
    assert [near[a:b] for k, a, b, _ in pii.find_personal(near, model) if k == "email"] == ["anna dot smith at posteo dot de", "john (at) mail.org"]


def test_base_spans_against_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(4)
    for _ in range(20_000):
        t = "".join(rng.choices("a1@.+-% ()25", k=rng.randint(0, 24)))
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or \
                        kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                    want.append((kind, *m.span()))
        assert pii.base_spans(t) == want


def test_decontamination(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghiklmnoprst", k=rng.randint(2, 9))) for _ in range(3000)]
    items = [" ".join(rng.choices(words, k=25)) for _ in range(20)]
    clean = [" ".join(rng.choices(words, k=150)) for _ in range(20)]
    dirty = [clean[k] + " " + items[k].upper() + ". " + clean[k] for k in range(10)]
    dirty += [clean[k] + "\n" + items[k].replace("e", "x", 1) for k in range(10)]
    table = docs(spark, clean + dirty + [None, "", "short"])
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, "q"), (99, None), (98, "")], "item_id long, text string")
    found = decontamination.contaminated_regions(table, bench)
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    assert pairs == {(20 + k, k % 10) for k in range(20)}
    assert rows_of(decontamination.clean(table, bench)) == [*range(20), 40, 41, 42]
    assert decontamination.contaminated_regions(table, bench.limit(0)).count() == 0
    for df in hostile(spark):
        assert decontamination.clean(df, bench).count() == df.count()


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row, old = [i], row
        for j, d in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return min(row)


def edited(rng, text, n):
    out = bytearray(text)
    for _ in range(n):
        at = rng.randrange(len(out)) if out else 0
        rng.choice([lambda: out.insert(at, rng.choice(b"xyz")), lambda: out and out.pop(at), lambda: out and out.__setitem__(at, rng.choice(b"xyz"))])()
    return bytes(out)


@pytest.mark.parametrize("hits", [1 << 19, 7])
def test_decontamination_finds_all_and_only_windows_in_budget(monkeypatch, hits):
    monkeypatch.setattr(decontamination, "HITS", hits)
    rng = random.Random(hits)
    plain = decontamination.normal
    for _ in range(150):
        size = rng.choice([3, 7, 8, 12, 15, 16, 20, 31, 32, 40, 47, 48, 63, 64, 90, 150, 300])
        letters = rng.choice([b"abcdefghij ", b"ab c", b"abcdefghijklmnopqrstuvwxyz     "])
        raw = bytes(rng.choices(letters, k=size))
        item = plain(raw)[0].strip(b" ")
        if not item:
            continue
        window = min(64, len(item))
        edits, _ = decontamination.budget(window)
        at = rng.randrange(len(item) - window + 1)
        part = edited(rng, item[at:at + window], rng.choice([0, 1, 2, 3, 3, 4, 5]) if window >= 16 else rng.choice([0, 0, 1]))
        text = b"".join([*rng.choices([b"a", b"b ", b"q"], k=rng.randrange(60)), b" ", part, b" ", *rng.choices([b"a", b" c"], k=rng.randrange(60))])
        low = plain(text)[0]
        if window < 8:
            want = b" " + item + b" " in b" " + low + b" "
        else:
            want = min(edit_distance_inside(item[k:k + window], low) for k in range(len(item) - window + 1)) <= edits
        found = decontamination.Benchmark([(5, raw)]).find([b"other", text, b""])
        assert bool(found) == want, (item, text)
        assert all(x[:2] == (1, 5) and 0 <= x[2] < x[3] <= len(text) for x in found)


def test_decontamination_regions_count_characters(spark):
    item = "Die Größe des Flußes übertraf alle Erwartungen, denn er war sehr breit und tief. " * 2
    text = "é" * 50 + " – " + item.upper().replace("ß".upper(), "ß") + "ü" * 9
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (r,) = decontamination.contaminated_regions(docs(spark, [text]), bench).collect()
    assert text[r.start:r.end].strip().lower() == item.strip().lower().rstrip(".") + "." * text[r.start:r.end].strip().endswith(".")
    long = "filler words of no note " * 9_000 + item + " more filler of no note" * 9_000
    assert decontamination.contaminated_regions(docs(spark, [long]), bench).count() == 1


def test_url_rules_against_plain_matching(spark):
    rng = random.Random(8)
    hosts = ["net", "example.net", "WWW.Example.NET", "badexample.net", "a.b.example.com", "example.com", "org", "x.org", "", "a.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/enx", "/de/1?q=/en/", "/fr/#x", "?/en/"]
    pages = [(k, rng.choice(["http://", "https://", "", "x"]) + rng.choice(hosts) + rng.choice(paths)) for k in range(300)] + [(900, None), (None, "http://example.net/en/"), (1, "dup")]
    rules = [("net", "/", "block"), ("example.net", "/en", "allow"), ("example.net", "/en/", "block"), ("com", "", "block"), ("example.com", "/de/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block")]
    got = urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")),
                            spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(pages)
    for r in got:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fit)[2:] if fit else (None, "allow")))
    empty = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.op7(empty).count() == 0 and urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), none).count() == len(pages)


def test_shards(spark, texts):
    got = sharding.op8(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(24))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    for df in hostile(spark):
        assert sharding.op8(df).count() == df.count()


def test_hilbert_curve_visits_neighbours(spark):
    codes = spark.range(512).select(F.array(*[((F.col("id") / 8 ** k).cast("int") % 8) for k in range(3)]).alias("c"))
    got = codes.select("c", sharding.hilbert_index(F.col("c"), 3, 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(x.c, y.c)) == 1 for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("crowd", [4000, 1])
def test_substring_dedup(spark, texts, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "GATHER", 500)
    got = by_id(substrings.op9(docs(spark, texts)))
    seen = set()
    for k, t in enumerate(texts):
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - 19):
            run = tuple(w[i:i + 20])
            gone |= set(range(i, i + 20)) if run in seen else set()
            seen.add(run)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), k
    for df in hostile(spark):
        assert substrings.op9(df).count() == df.count()


def test_secrets(spark, texts):
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', json.dumps({"sub": "x" * 20}).encode(), b"s" * 32))
    pkcs8 = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))
    samples = ['api_key = "abcdefghijkl"', "PASSWORD:'short'", "AKIA" + "Z" * 14, "ab" * 8, "see " + token, base64.b64encode(pkcs8).decode(), pkcs8.hex(),
               base64.b64encode(bytes(range(64))).decode(), "ſecret: abcdefghijklmn", None, ""] + texts
    got = by_id(secrets.secret_scan(docs(spark, samples)))
    kinds = [[s.kind for s in got[k].spans] for k in range(11)]
    assert kinds == [["assign"], [], ["access"], ["hex"], ["token"], ["key"], ["hex", "key"], [], [], [], []]
    clean = by_id(secrets.masked(docs(spark, samples)))
    assert clean[4].text == "see [SECRET]" and clean[9].text is None and clean[11].text == texts[0]
    for df in hostile(spark):
        assert secrets.op10(df).count() == df.count() and secrets.masked(df).count() == df.count()


def test_base_secrets_against_every_start(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    rules = [("assign", assign, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
             ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    rng = random.Random(21)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", '"', "'", " ", "AKIA", "ZX09", "0af9", "deadbeef", "+/_.-", "é", "\n", "long" * 4, "\U0001F600"]
    samples = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)] + ["x" * 30_000 + "secret=" + "a" * 30_000, None, ""]
    got = by_id(secrets.op10(docs(spark, samples)))
    for k, t in enumerate(samples):
        want, at = [], 0
        for n, (kind, rule, fine) in enumerate(rules):
            at = 0
            while at < len(t or ""):
                m = rule.match(t, at)
                if m and fine(m):
                    want.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
                at = m.end() if m else at + 1
        assert got[k].base_sha256 == hashlib.sha256(",".join(x for *_, x in sorted(want)).encode()).hexdigest(), t
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(n == i for _, n, _ in want) for i in range(3)]


def test_key_encodings_are_followed_to_the_innermost_length():
    def item(tag, *parts):
        body = b"".join(parts)
        size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big") if len(body) > 255 else b"\x81" + bytes([len(body)])
        return bytes([tag]) + size + body

    name = item(0x30, item(0x06, b"\x2a\x86\x48"), item(0x30, item(0x04, b"salt"), item(0x02, b"\x08")))
    encrypted = item(0x30, name, item(0x04, bytes(160)))
    broken = item(0x30, item(0x30, item(0x06, b"\x2a"), b"\x30\x09\x04\x01a"), item(0x04, bytes(160)))
    assert secrets.key_structure(encrypted) and not secrets.key_structure(broken)
    assert not secrets.key_structure(item(0x30, item(0x30, item(0x02, b"\x01")), item(0x04, bytes(160))))
    whole = base64.b64encode(encrypted).decode()
    lines = "\n".join(whole[k:k + 64] for k in range(0, len(whole), 64))
    assert [k for k, *_ in secrets.find_secrets(f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{lines}\n-----END".encode())] == ["key"]


def greedy_windows(tokens, system, budget, history, block):
    """(first, repeated, n_system) of each window by a plain loop: positions from 1 on."""
    out, first, start, cap, rooms = [], None, 0, 0, []
    at = [0]
    for n in tokens:
        at.append(at[-1] + n)
    for k, n in enumerate(tokens):
        new_block = k % block == 0
        if first is None or new_block or at[k] + n - start > cap:
            head = tokens[0] if system and k and tokens[0] + n <= budget else 0
            room = 0 if k == 0 else max(0, min(history, budget - head - n))
            own = [j for j in range(first or 0, k) if at[k] - at[j] <= room and not (system and j == 0)] if first is not None else []
            used = 0 if k == 0 else room if new_block else (at[k] - at[own[0]] if own else 0)
            out.append((k + 1, len(own), int(head > 0)))
            first, start, cap = k, at[k], budget - head - used
    return out


def test_chat_windows_read_back(spark):
    rng = random.Random(12)
    odd = ["", "~0<[", "<|end|>x<|turn|>", "</s>[INST] ok [/INST]", "~1~2", "word " * 400, "é" * 30]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|text|>"]), rng.choice(odd + [None])) for c in (1, 2, 3, None) for t in range(rng.randint(1, 40))]
    rows += [(4, None, "assistant", "x"), (4, None, "assistant", "x"), (5, 0, "system", "rules"), *((5, t, "assistant" if t % 2 else "user", f"say {t} " * 30) for t in range(1, 30))]
    rows += [(6, 0, "system", "long rules " * 600), *((6, t, "user", "and so " * rng.randint(1, 90)) for t in range(1, 60))]
    rows += [(7, 0, "system", "rules " * 40), *((7, t, "assistant", "on " * rng.randint(1, 60)) for t in range(1, 1300))]
    table = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, first string")
    windows = chat.chat_windows(table, budget=400, history=60)
    back = chat.read_back(windows).orderBy("first").collect()
    found = windows.collect()
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for w in back if w.conv_id == c for t in w.turns] == [x[2:] for x in own]
        assert "".join(t for w in back if w.conv_id == c for t in w.targets) == "".join(x[3] for x in own if x[2] == "assistant")
        tokens = [len(re.findall(r"[^\W\d_]+|\d+|[^\w\s]", x[3])) + 3 for x in own]
        assert sorted((r.first, r.n_repeated, r.n_system) for r in found if r.conv_id == c) == greedy_windows(tokens, own[0][2] == "system", 400, 60, 512)
    assert all(r.tokens <= 400 or (r.n_turns, r.n_repeated, r.n_system) == (1, 0, 0) for r in found)
    long = [r.tokens for r in found if r.conv_id == 7]
    assert sum(long) / len(long) > 0.85 * 400  # packed
    assert chat.chat_windows(table.limit(0)).count() == 0


def test_op1_columns_against_plain_python(spark):
    rows = [(1, 0, "system", "be <kind>"), (1, 1, "user", "hi"), (1, 2, "assistant", "~1 yes"), (None, 0, "assistant", None), (2, 3, "assistant", "a"), (2, 3, "assistant", "b")]
    got = {r.conv_id: r for r in chat.op1(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in {r[0] for r in rows}:
        own = [x for x in rows if x[0] == c]
        turns = "".join(f"{r}\n{x or ''}\n" for *_, r, x in own)
        loss = "".join(x or "" for *_, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4


def test_pipeline_equals_its_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    words = ["".join(rng.choices(["ta", "re", "on", "mi", "sol"], k=rng.randint(1, 4))) for _ in range(900)]
    good = [" ".join(rng.choices(words, k=80)) for _ in range(30)]
    bench = [" ".join(rng.choices(words, k=30)) for _ in range(3)]
    table = [*good, good[0], good[1] + " end", good[2] + " " + bench[0], good[3][::-1] + ' token = "0123456789abcdef0123"', "too short", None]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(table)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]
    got = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert sorted(got) == [*range(30), 33]
    want = re.sub(r'token = "[0-9a-f]+', "[SECRET]", table[33])
    assert got[33].decoded_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[5].decoded_sha256 == hashlib.sha256(table[5].encode()).hexdigest()


def test_near_duplicates_are_linked_by_exact_similarity(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    samples = [" ".join(base)]
    for k in range(60):  # heads and tails of other words, Jaccard 0.5 to 1, and a repeated tail
        cut, own = rng.randint(0, 40), [f"v{k}x{i}" for i in range(rng.randint(0, 25))]
        samples.append(" ".join(base[cut:] + own) + (" again and again and over" * 20 if k % 9 == 0 else ""))
    samples += ["a b c d e f g h", "a b c d e f g h i", samples[3], "", None]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in samples]
    want = list(range(len(samples)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                want = [want[j] if c == want[i] else c for c in want]
    lead = {c: want.index(c) for c in want}
    got = by_id(simhash.near_duplicate_classes(docs(spark, samples)))
    assert {k: r.component for k, r in got.items()} == {k: lead[c] for k, c in enumerate(want)}


def test_keys_over_several_lines():
    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + body

    def field(x):
        return len(x).to_bytes(4, "big") + x

    rng = random.Random(5)
    rsa = der(0x30, der(2, b"\0") + b"".join(der(2, b"\1" + rng.randbytes(n)) for n in (256, 3, 255, 128, 128, 128, 128, 128)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, bytes.fromhex("06092a864886f70d0101010500")) + der(4, rsa))
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + b"\0\0\0\1" + field(rng.randbytes(51)) + field(b"abcdabcd" + rng.randbytes(128))
    for data, width, end in ((rsa, 64, "\n"), (pkcs8, 64, "\r\n"), (rsa, 76, "\\n"), (ssh, 70, "\n"), (pkcs8, 64, "\n    "), (rsa, 4000, "\\n")):
        run = base64.b64encode(data).decode()
        body = end.join(run[i:i + width] for i in range(0, len(run), width))
        for before, after in (("-----BEGIN PRIVATE KEY-----" + end, end + "-----END PRIVATE KEY-----"), ("note" + end, end + "words"), ("k = '", "'")):
            keys = [x for x in secrets.find_secrets((before + body + after).encode()) if x[0] == "key"]
            assert keys == [("key", len(before), len(before) + len(body))], (width, end, before)
        cut = body[:len(body) // 2]
        assert not [x for x in secrets.find_secrets(cut.encode()) if x[0] == "key"]
    assert ("key", 0, 2 * len(rsa)) in secrets.find_secrets(rsa.hex().upper().encode())
    assert not secrets.find_secrets(b"word MAN MIT\nMAP") and secrets.find_secrets(b"eyJhbGciOiJub25lIn0.eyJhIjoxfQ.") == [("token", 0, 31)]
