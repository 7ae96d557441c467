"""English stemming by the published rules of the second Porter stemmer, and its stop words, in Arrow batches of distinct words.

A word's regions R1 and R2 begin after the first and second consonant that follows a vowel; the steps take off or replace
the longest of their endings that lies in the region a rule asks for. The rules are data, and one short routine applies
them. A word meets the routine once in a batch, however often it occurs.
"""

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf

# The published algorithm's vowels, doubled letters, endings with what replaces them, and exceptional words.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
R1_STARTS = ("gener", "commun", "arsen")
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
         "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
         "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
         "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
LI_AFTER = "cdeghkmnrt"

_REGION = re.compile("[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    first = next((len(x) for x in R1_STARTS if w.startswith(x)), None)
    if first is None:
        found = _REGION.search(w)
        first = found.end() if found else len(w)
    found = _REGION.search(w, first)
    return first, found.end() if found else len(w)


def _short_end(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _ending(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer stay."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(r"(?<=[aeiouy])y", "Y", "Y" + w[1:] if w.startswith("y") else w)
    r1, r2 = _regions(w)
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[:-len(e)]
            break
    # Plurals.
    e = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in AFTER_PLURALS:
        return w
    # Past forms.
    e = _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[:-len(e)] + "ee"
    elif e and re.search("[aeiouy]", w[:-len(e)]):
        w = w[:-len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # Derived forms, whose endings lie in R1.
    e = _ending(w, STEP2)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w[-4:-3] == "l") and (e != "li" or w[-3:-2] in LI_AFTER and len(w) > 2):
        w = w[:-len(e)] + STEP2[e]
    e = _ending(w, STEP3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[:-len(e)] + STEP3[e]
    # Endings in R2.
    e = _ending(w, STEP4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[:-len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stemmed(words: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(words)
    table = [stem(w) for w in distinct]
    return pd.Series([table[c] if c >= 0 else None for c in codes], dtype=object)


def stems(words):
    """The stems of a column of lower-case words; null stays null."""
    return pandas_udf(_stemmed, "string")(words)
