"""The compressed index: places, matching statistics and earlier windows against plain searches."""

import random

import numpy as np
import pytest

from factgraph.llm import substrings


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_places_and_matching_statistics(letters):
    rng = random.Random(letters)
    text = np.array([rng.randint(1, letters) for _ in range(200)])
    index, plain = substrings.FmIndex(text), "".join(map(str, text))
    assert sorted(index.locate(np.arange(201)).tolist()) == list(range(201))
    ends = np.arange(25, 200)
    for end, m, low, high in zip(ends, *index.statistics(text, ends, 25)):
        runs = [plain[end - k + 1:end + 1] for k in range(1, 26)]
        places = [[i for i in range(200) if plain.startswith(x, i)] for x in runs]
        assert m == sum(len(x) > 1 for x in places)
        assert not m or sorted(index.locate(np.arange(low, high)).tolist()) == places[m - 1]


def test_statistics_of_values_that_the_index_has_once():
    index = substrings.FmIndex(np.array([5, 1, 2, 3, 1, 2, 4]))
    size, low, high = index.statistics(np.array([9, 1, 2, 4]), np.array([0, 2, 3]), 1)
    assert size.tolist() == [0, 1, 0] and high[1] - low[1] == 2


@pytest.mark.parametrize("seed", range(12))
def test_earlier_windows(seed):
    rng = random.Random(seed)
    vocab = [b"w%d" % k for k in range(rng.choice([2, 3, 30]))]
    base = [rng.choice(vocab) for _ in range(200)]
    segments = []
    for _ in range(rng.randint(1, 25)):
        i = rng.randrange(150)
        segments.append(base[i:i + rng.randint(5, 50)] if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randint(1, 40))])
    docs, starts = (np.array([rng.randrange(n) for _ in segments]) for n in (5, 1000))
    window = rng.choice([5, 8, 20])
    first = {}
    for d, s, x in zip(docs, starts, segments):
        for o in range(len(x) - window + 1):
            key = tuple(x[o:o + window])
            first[key] = min(first.get(key, (9, 0)), (d, s + o))
    found = substrings.earlier_windows(segments, docs, starts, window)
    for d, s, x, own in zip(docs, starts, segments, found):
        assert own.tolist() == [o for o in range(len(x) - window + 1) if first[tuple(x[o:o + window])] < (d, s + o)]
