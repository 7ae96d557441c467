"""Ranks found text by text against those of the postings."""

import random

import pytest

from factgraph.operators import lexical


def rows(df):
    return {(r.request_id, r.rank): (r.id, round(r.score, 6)) for r in df.select("request_id", "id", "score", "rank").collect()}


@pytest.mark.parametrize("seed, mode, block", [(1, "simple", 256), (2, "english", 3)])
def test_ranks_text_by_text_are_those_of_the_postings(spark, seed, mode, block, monkeypatch):
    rng = random.Random(seed)
    some = "running runs run the cat cats and alpha beta gamma delta of".split()

    def text(n):
        return " ".join(rng.choices(some, k=n))

    nodes = spark.createDataFrame([(k, text(rng.randrange(0, 5)), text(rng.randrange(0, 40)) if k % 9 else None, rng.choice("stu"), "archived" if k % 8 == 3 else "active") for k in range(120)],
                                  "id long, title string, body string, scope_id string, status string")
    forms = ["{} {}", '"{} {}"', '{} {} or "{} {}" -{}', "{} {} {}", "-{}", '{} -"{} {}"', "{}"]
    asked = [(k, forms[k % 7].format(*rng.choices(some, k=5))) for k in range(21)] + [(21, "the"), (22, ""), (23, "absent"), (24, "cat cat")]
    requests = spark.createDataFrame(asked, "request_id long, query string")
    sets = spark.createDataFrame([(k, s) for k, _ in asked for s in rng.sample("stu", rng.randrange(1, 4))], "request_id long, scope_id string")
    sections = {"A": "title", "B": "body"}
    want = rows(lexical.ranked_leg(requests, lexical.postings(nodes, sections, mode), nodes, sets, 5, mode))
    monkeypatch.setattr(lexical, "postings", lambda *_: pytest.fail("postings were made"))
    assert rows(lexical.best_in_texts(requests, nodes, sections, sets, 5, mode, block)) == want and len(want) > 40
