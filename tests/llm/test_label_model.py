"""The label model decides from the votes: overlaps speak, a lone vote among votes of good does not."""

import random
from collections import Counter

import pytest

from inkseam.llm import weak_quality


@pytest.mark.parametrize("share", [0.9, 0.5])
@pytest.mark.parametrize("scale", [1, 1_000_000])
def test_label_model(share, scale):
    pick, seen = random.Random(8), Counter()
    for _ in range(4_000):
        good = pick.random() < share
        # three labellers that are mostly right, and one that fires on good and bad alike
        pattern = (*((1 if good else -1) * (1 if pick.random() < 0.9 else -1) for _ in range(3)), -1 if pick.random() < 0.3 else 1)
        seen[pattern] += scale
    got = weak_quality.label_model(dict(seen))
    assert got[(1, 1, 1, -1)] > 0.9 and got[(-1, -1, -1, 1)] < 0.1
    assert sum(got[p] * n for p, n in seen.items()) / sum(seen.values()) == pytest.approx(share, abs=0.03)
    for p in ((1, 1, -1, 1), (-1, -1, 1, 1), (1, 1, 1, 1)):
        k = p[:3].count(1)
        good, bad = share * 0.9**k * 0.1 ** (3 - k), (1 - share) * 0.1**k * 0.9 ** (3 - k)
        assert got[p] == pytest.approx(good / (good + bad), abs=0.08)


def test_labellers_vote_good():
    prose = b"The river turned north there, and all the boats we had seen came back. " * 2 + b"Nobody asked why."
    assert min(weak_quality.votes(prose)) >= 0 and sum(weak_quality.votes(prose)) >= 5
    assert weak_quality.label_model({(0, 0, 0): 5, (1, 1, 1): 40, (-1, -1, -1): 60})[(0, 0, 0)] < 0.6
