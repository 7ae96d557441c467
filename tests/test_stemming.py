"""Stems against the sample that was published with the algorithm, and english search by them."""

from pyspark.sql import functions as F

from factgraph.functions import stemming
from factgraph.operators import lexical

PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()

# Examples of the rules' own descriptions.
RULES = {"gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "ties": "tie", "cries": "cri", "cry": "cri", "by": "by", "say": "say", "hopping": "hop", "hoping": "hope",
         "luxuriated": "luxuri", "generate": "generat", "general": "general", "generic": "generic", "communism": "communism", "arsenal": "arsenal", "skies": "sky", "dying": "die",
         "succeeding": "succeed", "inning": "inning", "agreed": "agre", "feed": "feed", "sized": "size", "falling": "fall", "tanned": "tan", "relational": "relat",
         "conditional": "condit", "hopefulness": "hope", "sensibiliti": "sensibl", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "roll": "roll", "beed": "beed",
         "youth": "youth", "happy": "happi", "enjoyed": "enjoy", "o": "o", "": "", "rate": "rate", "cease": "ceas", "geology": "geolog", "bed": "bed", "abilities": "abil"}


def test_stems_of_the_published_sample():
    for word, want in zip(PUBLISHED[::2], PUBLISHED[1::2]):
        assert stemming.stem(word) == want, word


def test_stems_of_the_rules_examples():
    assert {w: stemming.stem(w) for w in RULES} == RULES


def test_stems_of_a_column_keep_nulls(spark):
    df = spark.createDataFrame([("knives",), (None,), ("knives",), ("",)], "w string")
    assert [r[0] for r in df.select(stemming.stems("w")).collect()] == ["knive", None, "knive", ""]


def test_english_search_finds_other_forms_and_skips_stop_words(spark):
    nodes = spark.createDataFrame([(1, "Knocked doors", "the kneeling knights", "s", "active"), (2, "A knight", "consolation", "s", "active"), (3, "", "the and", "s", "active")],
                                  "id long, title string, body string, scope_id string, status string")
    asked = spark.createDataFrame([(1, "knights"), (2, '"kneels knight"'), (3, "the"), (4, "knocking -consoling"), (5, "consoled or kneel")], "request_id long, query string")
    sets = spark.createDataFrame([(k, "s") for k in range(1, 6)], "request_id long, scope_id string")
    english = lexical.postings(nodes, {"A": "title", "B": "body"}, "english")
    found = lexical.ranked_leg(asked, english, nodes, sets, mode="english")
    assert {(r.request_id, r.id) for r in found.collect()} == {(1, 1), (1, 2), (2, 1), (4, 1), (5, 1), (5, 2)}
    simple = lexical.ranked_leg(asked, lexical.postings(nodes, {"A": "title", "B": "body"}), nodes, sets)
    assert {(r.request_id, r.id) for r in simple.filter(F.col("request_id") < 3).collect()} == {(1, 1)}
