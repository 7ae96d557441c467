"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments of tokens (their digit groups, separators, check sums, at and dot forms
and neighbours) for each kind; dynamic programming over segments of bounded length picks boundaries and kinds
together. It is trained on a bounded sample of the documents: base spans are the labels, and rewritten forms of
them (a phone without its plus, a spelled-out mail address) teach what the patterns cannot match.
"""

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.batches import steps
from factgraph.llm.secrets import SPANS, joined_spans

# The base patterns by kind. Look-behinds only skip starts that cannot be leftmost.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
#: Rows of the training sample, tokens of a segment, words before and after a trigger that a region holds at least.
SAMPLE_DOCS, LONGEST, BEFORE, AFTER = 300, 28, 5, 10
#: Segment starts that are scored at once, of a region of any length.
CHUNK = 256
FEATURES = 1 << 13
WIDTH = 12  # features of a segment
#: A region opens at five digits with separators, an @, or an at that a bracket or a dotted name follows.
TRIGGER = re.compile(r"[0-9](?:[ ().+/-]{0,3}[0-9]){4,}|@|(?i:[(\[{] ?at ?[)\]}]|\bat\s+[\w-]+\s?(?:\.\w|[(\[{]? ?dot\b))")
MAY_HOLD = re.compile(rb"[0-9][ ().+/0-9-]{4}|@|[aA][tT][)\]} \t\r\n]|[0-9]\.[0-9]")
MAIL_MARKS, NUMBER_MARKS, OPEN, CLOSE = frozenset("._%+-"), frozenset("+().-/"), frozenset("([{"), frozenset(")]}")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
DIGITS = re.compile(r"[0-9]")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCALS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def regions(text: str) -> list[list[tuple[str, int, int]]]:
    """Token runs around triggers, BEFORE and AFTER words on; a run of triggers is one region, however long."""
    marks = [m.span() for m in TRIGGER.finditer(text)]
    if not marks:
        return []
    blanks = [m.start() for m in re.finditer(r"\s", text)]
    out, spans = [], []
    for a, b in marks:
        k = bisect.bisect_left(blanks, a) - BEFORE
        a = blanks[k] + 1 if k >= 0 else 0
        k = bisect.bisect_left(blanks, b) + AFTER
        b = blanks[k] if k < len(blanks) else len(text)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for a, b in spans:
        out.append([(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, a, b)])
    return out


def segments(tokens, first=0, last=None):
    """(first token, past the last, feature indices) of each candidate that starts in tokens[first:last]."""
    out = []
    for i in range(first, len(tokens) if last is None else min(last, len(tokens))):
        head = tokens[i][0]
        if head[0] in "+(" or head.isascii() and head.isdigit():
            numbers(tokens, i, out)
        if head[0].isalnum():
            mails(tokens, i, out)
    return out


def numbers(tokens, i, out):
    """Candidates of digits and their separators: five digits or more, a digit at the end."""
    groups, marks, gaps = [], set(), 0
    for j in range(i, min(len(tokens), i + LONGEST)):
        word, start, _ = tokens[j]
        gap = start - tokens[j - 1][2] if j > i else 0
        if gap > 1:
            return
        gaps += gap
        if word.isascii() and word.isdigit():
            groups.append(word)
            if sum(map(len, groups)) >= 5:
                out.append((i, j + 1, number_features(tokens, i, j + 1, groups, marks, gaps)))
        elif word in NUMBER_MARKS and not (word == "+" and j > i):
            marks.add(word)
        else:
            return


def mails(tokens, i, out):
    """Candidates of a name, an at (sign or word, with or without brackets) and a host with a dot of either kind."""
    if i and tokens[i - 1][2] == tokens[i][1] and (tokens[i - 1][0][0].isalnum() or tokens[i - 1][0] in MAIL_MARKS):
        return  # inside a name
    at, dots, form, wide, glue = 0, 0, "", 0, False  # glue: a word may follow after a blank
    for j in range(i, min(len(tokens), i + LONGEST)):
        word, start, _ = tokens[j]
        gap = start - tokens[j - 1][2] if j > i else 0
        before = tokens[j - 1][0] if j > i else ""
        after = tokens[j + 1][0].lower() if j + 1 < len(tokens) else ""
        low = word.lower()
        if gap > 1:
            return
        wide += gap
        if word == "@" or low == "at" and j > i and (gap or before in OPEN):
            at, form, glue = at + 1, form + low, True
            if at > 1:
                return
        elif low == "dot" and j > i and (gap or before in OPEN):
            dots, form, glue = dots + bool(at), form + ("d" if at else "n"), True
        elif word in OPEN:
            if j == i or after not in ("at", "dot", "@"):
                return
            form += word
        elif word in CLOSE:
            if before.lower() not in ("at", "dot", "@"):
                return
            form, glue = form + word, True
        elif word[0].isalnum():
            if gap and not glue:
                return
            glue = False
            if at and dots and len(before) and (before in ".-)]}" or before.lower() == "dot" or before[0].isalnum()):
                out.append((i, j + 1, mail_features(tokens, i, j + 1, form, dots, wide)))
        elif word in MAIL_MARKS and not gap and not (at and word not in ".-"):
            if word == "." and at:
                dots, form = dots + 1, form + "."
        else:
            return


def near(tokens, i, j):
    """Classes of the neighbours, and whether they touch."""
    before = tokens[i - 1] if i else ("", -9, -9)
    after = tokens[j] if j < len(tokens) else ("", 1 << 40, 0)
    sort = lambda x: x if not x[:1].isalnum() else "9" if x.isdigit() else "w"
    return (f"{sort(before[0])}{before[2] == tokens[i][1]}", f"{sort(after[0])}{after[1] == tokens[j - 1][2]}",
            f"{sort(after[0])}{after[1] - tokens[j - 1][2] < 2}")


def number_features(tokens, i, j, groups, marks, gaps):
    """One hashed index for each whole-span feature."""
    digits = "".join(groups)
    n, sizes, shape = min(len(digits), 21), ".".join(str(len(g)) for g in groups[:7]), "".join(sorted(marks))
    before, after, beside = near(tokens, i, j)
    card = 16 <= len(digits) <= 19 and luhn(digits)
    quad = len(groups) == 4 and shape == "." and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    lead = "+" if tokens[i][0] == "+" else "(" if tokens[i][0] == "(" else digits[:2] if digits[0] == "0" else "1" if digits[0] == "1" else "n"
    return [stable(x) for x in (
        f"n{n}", f"g{min(len(groups), 8)}", f"s{sizes}", f"m{shape}{gaps > 0}", f"b{before}", f"a{after}", f"c{beside}{n > 7}",
        f"l{card}{len(groups) == 1}", f"q{quad}", f"h{lead}{min(len(groups), 4)}", f"k{lead}{n}", f"e{len(groups[-1])}{min(len(groups), 3)}{gaps > 0}")]


def mail_features(tokens, i, j, form, dots, wide):
    before, after, beside = near(tokens, i, j)
    last = tokens[j - 1][0]
    sort = "9" if last.isdigit() else "w" if last.isascii() else "u"
    signs, spelled = form.replace(".", "").replace("d", ""), "d" in form
    return [stable("@" + x) for x in (
        f"f{signs}", f"d{min(dots, 4)}{spelled}{'.' in form}", f"w{min(wide, 8)}{spelled}", f"b{before}", f"a{after}", f"c{beside}{spelled}",
        f"t{sort}{min(len(last), 6)}", f"u{tokens[i][0][0].isdigit()}", f"x{signs}{spelled}{'.' in form}",
        f"v{'.' if j < len(tokens) and tokens[j][0] == '.' and j + 1 < len(tokens) and tokens[j + 1][1] == tokens[j][2] and tokens[j + 1][0][0].isalnum() else ''}",
        f"y{j < len(tokens) and tokens[j][0].lower() in ('dot', '[', '(', '{', '-')}", "one")]


#: Places of names seen so far, so many at most; a plain dict, since a decorated function is pickled by its name only.
PLACES, MOST_PLACES = {}, 1 << 14


def stable(name: str) -> int:
    if name in PLACES:
        return PLACES[name]
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    if len(PLACES) >= MOST_PLACES:
        PLACES.clear()
    PLACES[name] = h % FEATURES
    return PLACES[name]


def logsum(x, axis=None):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis)) if axis is not None else top.item() + np.log(np.exp(x - top).sum())


class SemiMarkov:
    """Weights of segment features by kind, of moves between kinds, and of a token outside; kind 0 is outside."""

    def __init__(self):
        k = len(KINDS) + 1
        self.w, self.move, self.out = np.zeros((k, FEATURES)), np.zeros((k, k)), np.zeros(2)

    def scored(self, tokens, first=0, last=None):
        """Candidates that start in tokens[first:last], their features, and their scores by kind."""
        parts = segments(tokens, first, last)
        index = np.array([f for *_, f in parts], np.int64).reshape(len(parts), WIDTH)
        return parts, index, self.w[1:, index].sum(axis=2).T if len(parts) else np.zeros((0, len(KINDS)))

    def best(self, tokens) -> list[tuple[str, int, int]]:
        """Kinds and token bounds of the segments of the best labelling.

        The search goes forward a token at a time; candidates are made and scored CHUNK starts at a time.
        """
        n, k = len(tokens), len(KINDS) + 1
        value, back = np.full((n + 1, k), -np.inf), {}
        value[0, 0] = 0
        for first in range(0, n, CHUNK):
            parts, _, score = self.scored(tokens, first, first + CHUNK)
            at = 0
            for i in range(first, min(n, first + CHUNK)):
                into = value[i][:, None] + self.move
                if (top := into[:, 0].max() + self.out[int(tokens[i][0].isdigit())]) > value[i + 1, 0]:
                    value[i + 1, 0], back[i + 1, 0] = top, (i, int(into[:, 0].argmax()))
                while at < len(parts) and parts[at][0] == i:
                    j, tops = parts[at][1], into[:, 1:].max(axis=0) + score[at]
                    for c in np.flatnonzero(tops > value[j, 1:]).tolist():
                        value[j, c + 1], back[j, c + 1] = tops[c], (i, int(into[:, c + 1].argmax()))
                    at += 1
        out, j, c = [], n, int(value[n].argmax())
        while j:
            i, before = back[j, c]
            if c:
                out.append((KINDS[c - 1], i, j))
            j, c = i, before
        return out[::-1]

    def learn(self, tokens, gold: dict[tuple[int, int], int], rate: float, cached=None):
        """One step of stochastic gradient on the log-likelihood of the gold segments, all of them candidates."""
        parts, index, _ = cached or self.scored(tokens)
        score = self.w[1:, index].sum(axis=2).T if len(parts) else np.zeros((0, len(KINDS)))
        plain = np.array([self.out[int(t[0].isdigit())] for t in tokens])
        n, k = len(tokens), len(KINDS) + 1
        by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for p, (i, j, _) in enumerate(parts):
            by_end[j].append(p)
            by_start[i].append(p)
        low = -1e9
        alpha, beta = np.full((n + 1, k), low), np.full((n + 1, k), low)
        into = np.full((n + 1, k), low)
        alpha[0, 0] = 0
        for j in range(n + 1):
            if j:
                alpha[j, 0] = into[j - 1, 0] + plain[j - 1]
                if by_end[j]:
                    alpha[j, 1:] = logsum(np.array([into[parts[p][0], 1:] + score[p] for p in by_end[j]]), 0)
            into[j] = logsum(alpha[j][:, None] + self.move, 0)
        beta[n] = 0
        ahead = np.full((n + 1, k), low)
        for i in range(n - 1, -1, -1):
            ahead[i, 0] = plain[i] + beta[i + 1, 0]
            if by_start[i]:
                ahead[i, 1:] = logsum(np.array([score[p] + beta[parts[p][1], 1:] for p in by_start[i]]), 0)
            beta[i] = logsum(self.move + ahead[i][None, :], 1)
        total = logsum(alpha[n])
        for p, (i, j, _) in enumerate(parts):
            chance = np.exp(np.minimum(0, into[i, 1:] + score[p] + beta[j, 1:] - total))
            if (c := gold.get((i, j))):
                chance[c - 1] -= 1
            for c in np.flatnonzero(np.abs(chance) > 1e-4).tolist():
                self.w[c + 1, index[p]] -= rate * chance[c]
        real, last, at = np.zeros((k, k)), 0, 0
        starts = {i: (j, c) for (i, j), c in gold.items()}
        outside = np.zeros(2)
        while at < n:
            j, c = starts.get(at, (at + 1, 0))
            real[last, c] += 1
            if not c:
                outside[int(tokens[at][0].isdigit())] += 1
            last, at = c, j
        expected = np.zeros((k, k))
        for i in range(n):
            expected += np.exp(np.minimum(0, alpha[i][:, None] + self.move + ahead[i][None, :] - total))
            outside[int(tokens[i][0].isdigit())] -= np.exp(min(0.0, into[i, 0] + plain[i] + beta[i + 1, 0] - total))
        self.move += rate * (real - expected)
        self.out += rate * outside


def spelled_mails(user: str, host: str) -> list[str]:
    dotted = host.replace(".", " dot ")
    return [f"{user} at {dotted}", f"{user}(at){host}", f"{user} (at) {dotted}", f"{user} @ {host}", f"{user}[at]{host.replace('.', '[dot]')}",
            f"{user} [at] {host}", f"{user} AT {dotted.upper()}", f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user}@{dotted}", f"{user} (at) {host}",
            f"{user.replace('.', ' dot ')} at {dotted}"]


def other_phones(own: str) -> list[str]:
    groups = re.findall(r"[0-9]+", own)
    rest = groups[1:] if len(groups) > 2 else groups
    return [" ".join(rest), "-".join(rest), ".".join(rest), "00" + own[1:], "00" + " ".join(groups), "00" + groups[0] + " " + "-".join(rest),
            f"({rest[0]}) " + "-".join(rest[1:]) if len(rest) > 1 else "0" + rest[0], "0" + "/".join([rest[0], "".join(rest[1:])])]


def other_dates(y: int, m: int, d: int) -> list[str]:
    """Written forms of a date, and of a date with a time, which are no phone numbers."""
    forms = [f"{y}{x}{m:02}{x}{d:02}" for x in "-/."] + [f"{a:02}{x}{b:02}{x}{y}" for x in "-/." for a, b in ((d, m), (m, d))]
    forms += [f"{a}{x}{b}{x}{y % 100:02}" for x in "-/." for a, b in ((d, m), (m, d))] + [f"{y}{m:02}{d:02}", f"{y}-{y + 1}"]
    return forms + [f"{y}-{m:02}-{d:02} {d % 24:02}:{m * 4:02}", f"{y}-{m:02}-{d:02}T{d % 24:02}:{m * 4:02}:{d:02}", f"{d:02}.{m:02}.{y}, {d % 24}:{m * 4:02}"]


def rewritten(text: str, spans, rng):
    """Other written forms of base spans in their surroundings, each as (text, kind, start, end).

    Names, hosts and digit counts vary: words of the text make names, and hosts get and lose labels.
    """
    words = re.findall(r"[A-Za-z]{2,9}", text)[:400] or ["anna"]
    for kind, a, b in spans:
        left, own, right = text[max(0, a - 60):a], text[a:b], text[b:b + 60]
        forms = []
        if kind == "phone":
            groups = re.findall(r"[0-9]+", own)
            if len(groups) > 2:
                cut = int(rng.integers(2, 5))
                own = f"+{rng.integers(1, 400)} {groups[1][:int(rng.integers(2, 4))]} {groups[2]} {(groups[-1] + groups[1])[:cut]}" if rng.random() < 0.6 else own
            forms = other_phones(own)
        elif kind == "email":
            one, two, three = (words[int(rng.integers(len(words)))].lower() for _ in range(3))
            user = (own.rsplit("@", 1)[0], one, f"{one}.{two}", f"{one}{rng.integers(1, 100)}", f"{one}_{two[:1]}", f"{one[:1]}-{two}")[int(rng.integers(6))]
            host = (own.rsplit("@", 1)[1], f"{three}.org", f"{three}{rng.integers(1, 10)}.example.com", f"mail.{three}.de", f"{three}-{two}.co.uk", "example.com")[int(rng.integers(6))]
            forms = spelled_mails(user, host)
        elif kind == "card":
            digits = "".join(re.findall("[0-9]", own))
            fours = [digits[k:k + 4] for k in range(0, len(digits), 4)]
            forms = [".".join(fours), "/".join(fours)]
        for k in rng.permutation(len(forms))[:3].tolist():
            yield left + forms[k] + right, kind, len(left), len(left) + len(forms[k])
        if kind == "email":  # what only looks like one
            yield f"{left}{one} at {two} and {three}{right}", None, 0, 0
            yield f"{left}look at {three}.{right}", None, 0, 0
            yield f"{left}{one} at www.{two}.com{right}", None, 0, 0
        if kind == "phone":
            dates = other_dates(int(rng.integers(1900, 2100)), int(rng.integers(1, 13)), int(rng.integers(1, 32)))
            for k in rng.permutation(len(dates))[:3].tolist():
                yield left + dates[k] + right, None, 0, 0
            yield f"{left}{rng.integers(1, 400)}.{rng.integers(100, 999)}.{rng.integers(100, 999)}{right}", None, 0, 0
            yield f"{left}{rng.integers(10 ** 5, 10 ** 13)}{right}", None, 0, 0


def examples_of(text: str, rng, plain: bool = True):
    """(tokens, gold by token bounds, the rewritten span or None) of regions of a text and of its rewritten forms."""
    spans = base_spans(text)
    cases = [(text, spans, None)] if plain else []
    for t, kind, a, b in rewritten(text, spans[:6], rng):
        new = (kind, a, b) if kind else None
        cases.append((t, [x for x in base_spans(t) if not new or x[2] <= a or b <= x[1]] + [new] * bool(new), new))
    for t, known, new in cases:
        for tokens in regions(t):
            start, end = {s: i for i, (_, s, _) in enumerate(tokens)}, {e: i + 1 for i, (*_, e) in enumerate(tokens)}
            own = [x for x in known if x[1] < tokens[-1][2] and tokens[0][1] < x[2]]
            gold = {(start.get(a), end.get(b)): KINDS.index(k) + 1 for k, a, b in own}
            yield t, tokens, gold, new if new in own else None


def fit(texts: list[str], epochs: int = 6) -> SemiMarkov:
    model, cases, rng = SemiMarkov(), [], np.random.default_rng(3)
    for text in texts:
        for _, tokens, gold, _ in examples_of(text, rng):
            scored = model.scored(tokens)
            if gold.keys() <= {(i, j) for i, j, _ in scored[0]}:  # else the field can't express it
                cases.append((tokens, gold, scored))
    cases = [cases[i] for i in rng.permutation(len(cases))[: 5 * SAMPLE_DOCS]]
    for epoch in range(epochs):
        for tokens, gold, scored in cases:
            model.learn(tokens, gold, 0.2 / (1 + epoch), scored)
    return model


def sample(docs: DataFrame, rows: int = SAMPLE_DOCS, skip: int = 0) -> list[str]:
    """Whole texts that may hold personal data, by a hash of doc_id: `rows` of them at most, after the first `skip`."""
    found = docs.select("doc_id", "text").filter(
        F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]([ -]?[0-9]){15}") & F.col("doc_id").isNotNull())
    # Names first, then their texts: what each task sends does not grow with the texts.
    names = found.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows + skip)
    found = found.join(F.broadcast(names), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return [x.text for x in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[skip:]]  # rows + skip at most


def train(docs: DataFrame, rows: int = SAMPLE_DOCS) -> SemiMarkov:
    """Fit on sample(docs): a bounded sample."""
    return fit(sample(docs, rows))


def held_out(texts: list[str], model: SemiMarkov) -> dict[str, tuple[int, int, int]]:
    """By kind (right, added, rewritten): added spans on rewritten forms of texts that the model was not fitted on."""
    rng, tally = np.random.default_rng(9), {k: [0, 0, 0] for k in KINDS}
    for text in texts:
        for t, kind, a, b in rewritten(text, base_spans(text)[:6], rng):
            added = [(k, x, y) for k, x, y, own in find_personal(t, model) if not own]
            base = [(k, x, y) for k, x, y, own in find_personal(t, None) if own]
            if kind and not any(x < b and a < y for _, x, y in base):
                tally[kind][2] += 1
                tally[kind][0] += (kind, a, b) in added
            for k, *_ in added:
                tally[k][1] += 1
    return {k: tuple(x) for k, x in tally.items()}


def find_personal(text: str, model: SemiMarkov | None):
    """(kind, start, end, whether a base pattern found it); added spans overlap no base span."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    top, high = [], 0  # the furthest end of the base spans up to each
    for _, b in taken:
        top.append(high := max(high, b))
    added = []
    for tokens in regions(text) if model else ():
        for kind, i, j in model.best(tokens):
            a, b = tokens[i][1], tokens[j - 1][2]
            k = bisect.bisect_left(taken, (b,))
            if not k or top[k - 1] <= a:
                added.append((kind, a, b))
    return [(*x, True) for x in base] + [(*x, False) for x in added]


def personal_data(docs: DataFrame, model: SemiMarkov | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans, base): arrays of struct<kind, start, end>, all spans and those of the base patterns.

    Whole texts are searched; a null text is empty and has no spans. Repeated rows and null keys stay; other
    columns are ignored. Without a model only the base patterns apply. A very long text is a step of its own, and a
    region of any length is scored whole, CHUNK segment starts at a time; bytes that are not UTF-8 count as U+FFFD.
    """
    def run(batches):
        for batch, texts in steps(batches):
            every, base = [], []
            for x in texts:
                found = find_personal(x.decode(errors="replace"), model) if MAY_HOLD.search(x) else []
                every.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in found])
                base.append([{"kind": k, "start": a, "end": b} for k, a, b, own in found if own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, SPANS), pa.array(base, SPANS)],
                                             names=[key, "spans", "base"])

    rows = docs.select(key, F.col(text).alias("text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, spans {spans}, base {spans}")


def op5(docs: DataFrame) -> DataFrame:
    found = personal_data(docs, train(docs))
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans("base", KINDS, True).cast("binary"), 256).alias("base_sha256"),
        joined_spans("spans", KINDS, True).alias("spans"))
