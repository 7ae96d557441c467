"""The answer re-score against a plain version, on written cases and on all events."""

import itertools
import re

import pytest

from factgraph.functions import scoring as R
from factgraph.plans import reports

MONTH = {m: k for k, m in enumerate(R.MONTHS, 1)}
NAMES = "|".join(R.MONTHS)


def plain_dates(text):
    low, out = (text or "").lower(), []
    out += [(int(y), int(m), int(d), int(d)) for y, m, d in re.findall(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", low)]
    for q, m, y in re.findall(rf"\b({'|'.join(R.PART_OF_MONTH)})(?:\s+of)?[\s-]+({NAMES})[a-z]*\.?,?\s+(\d{{4}})\b", low):
        out.append((int(y), MONTH[m], *R.PART_OF_MONTH[q]))
    out += [(int(y), MONTH[m], int(d), int(d)) for d, m, y in re.findall(rf"\b(\d{{1,2}})\s+({NAMES})[a-z]*\.?,?\s+(\d{{4}})\b", low)]
    out += [(int(y), MONTH[m], int(d), int(d)) for m, d, y in re.findall(rf"\b({NAMES})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", low)]
    with_day = {x[:2] for x in out}
    out += [(int(y), MONTH[m], 0, 99) for m, y in re.findall(rf"\b({NAMES})[a-z]*\.?,?\s+(\d{{4}})\b", low) if (int(y), MONTH[m]) not in with_day]
    return out or [(int(y), None, 0, 99) for y in re.findall(r"\b(20\d{2}|19\d{2})\b", low)]


def plain_tokens(text):
    words = re.findall("[a-z0-9]+", re.sub(r"(\d+)(st|nd|rd|th)\b", r"\1", (text or "").lower()))
    return [R.NUMBERS.get(w, w) for w in words if w not in R.DROPPED]


def plain_score(gold, answer):
    parts = [p.strip() for p in re.split(R.DIVIDER, gold or "") if p.strip()]
    parts = parts or ([gold.strip()] if (gold or "").strip() else [])
    reply = (answer or "").strip()
    if not reply or ("INSUFFICIENT" in reply.upper() and len(reply) <= 52) or not parts:
        return 0.0, bool(reply) and not ("INSUFFICIENT" in reply.upper() and len(reply) <= 52)
    met = 0
    for part in parts:
        if own := plain_dates(part):
            sides = [bool(re.search(R.RELATION, x.lower())) for x in (part, answer)]
            met += sides[0] == sides[1] and any(
                a[0] == b[0] and (a[1] is None or b[1] is None or a[1] == b[1]) and a[2] <= b[3] and b[2] <= a[3]
                for a, b in itertools.product(own, plain_dates(answer)))
        else:
            words = {w for w in plain_tokens(part) if len(w) > 2 or w.isdigit()}
            run = " ".join(plain_tokens(part))
            met += not run or run in " ".join(plain_tokens(answer)) or (bool(words) and words <= set(plain_tokens(answer)))
    return met / len(parts), True


CASES = [
    ("running, pottery", "She runs, reads, and does pottery and running", 1.0), ("early July 2023", "on 2 July 2023", 1.0), ("mid-May 2023", "25 May 2023", 0.0),
    ("two cats", "2 cats", 1.0), ("week before 23 June 2023", "the week of 23 June 2023", 0.0), ("2023", "July 2023", 1.0), ("July 2, 2023", "2023-07-02", 0.5),
    ("a dog and a cat & a bird", "a cat", 1 / 3), ("the", "anything", 1.0), ("", "x", 0.0), (None, "x", 0.0), ("x", None, 0.0), ("x", "insufficient.", 0.0),
    ("end of March 2021", "late March, 2021", 1.0), ("ninety", "90 or so", 1.0), ("3rd May 2020", "May 2020", 1.0), ("Paris/London", "LONDON plus Paris", 1.0)]


def test_written_cases_and_the_plain_version(spark):
    texts = sorted({x for g, a, _ in CASES for x in (g, a) if x is not None}) + [" ", "45 May 2023", "may", "Sept. 3, 1999 after dinner", "beginning of dec 2001; by 2002"]
    pairs = [(g, a) for g, a, _ in CASES] + list(itertools.product(texts, texts))
    rows = R.rescored(spark.createDataFrame(pairs, "gold string, answer string")).collect()
    for r in rows:
        assert (pytest.approx(r.coverage), r.is_answer) == plain_score(r.gold, r.answer), (r.gold, r.answer)
        assert r.covered == (r.coverage == 1.0)
    got = {(r.gold, r.answer): r.coverage for r in rows}
    for g, a, want in CASES:
        assert got[g, a] == pytest.approx(want), (g, a)


def test_fair_scores_over_events_equal_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in reports.event_answers(spark, sf).collect():
        share, answered = plain_score(r.gold, r.answer)
        n, strict, fair, partial, flips = want.get(r.arm, (0, 0, 0, 0.0, 0))
        flip = not r.adversarial and not r.correct and share == 1.0
        want[r.arm] = (n + 1, strict + r.correct, fair + (r.correct or flip), partial + (1.0 if r.correct else 0.0 if r.adversarial else share), flips + flip)
    got = {r.arm: r for r in reports.fair_scores(spark, sf).collect()}
    assert got.keys() == want.keys()
    for arm, (n, strict, fair, partial, flips) in want.items():
        r = got[arm]
        assert (r.n, r.flips) == (n, flips) and flips > 0
        assert (r.strict, r.fair, r.partial) == (round(strict / n, 6), round(fair / n, 6), pytest.approx(partial / n, abs=1e-6))
