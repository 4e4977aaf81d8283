"""The forward recursion against every segmentation, one by one."""

import math

import numpy as np
import public_tokenizers
import pytest

from inkseam.llm import lm_scoring

PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "é", "bé"]


def _lattice():
    pieces = PIECES + [""] * 256
    weights = np.log(np.random.default_rng(3).dirichlet(np.ones(len(pieces) + 1)))
    return lm_scoring.Lattice(pieces, {b: len(PIECES) + b for b in range(256)}, weights), weights


def _sum(text, weights):
    """The probability of text: every way to part it into pieces and spelled signs."""
    if not text:
        return 1.0
    total = math.exp(sum(weights[len(PIECES) + b] for b in text[0].encode())) * _sum(text[1:], weights)
    return total + sum(math.exp(weights[i]) * _sum(text[len(p) :], weights) for i, p in enumerate(PIECES) if text.startswith(p))


@pytest.mark.parametrize("word", ["a", "ab", "aba", "abab", "béba", "猫a", "😀", "b" * 8, "▁a▁"])
def test_marginal(word):
    lattice, weights = _lattice()
    assert lattice.log10([word, "ab", word])[0] == pytest.approx(math.log10(_sum("▁" + word, weights)))


def test_expected_uses_add_up():
    lattice, weights = _lattice()
    got = lattice.expected(["a", "ab"], np.array([2.0, 1.0]))
    one = sum(math.exp(weights[i]) for i, p in enumerate(PIECES) if p == "▁a") / _sum("▁a", weights)
    two = sum(math.exp(weights[i]) * _sum("b", weights) for i, p in enumerate(PIECES) if p == "▁a") / _sum("▁ab", weights)
    assert got[PIECES.index("▁a")] == pytest.approx(2 * one + two)


def test_document_scores(spark):
    """lm_score is the product over words and the end, by the vocabulary's own scores."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["The cat sat", "the CAT zqxj", None, "", "the cat sat"]
    docs = spark.createDataFrame([(i, t, i == 1) for i, t in enumerate(texts)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in lm_scoring.score(docs, model, "held").collect()}
    pieces, of_byte, scores, are_logs = lm_scoring.pieces_of(model)
    weights = lm_scoring.start_weights(scores, are_logs)
    assert np.exp(weights).sum() == pytest.approx(1)
    place = {p: i for i, p in reversed(list(enumerate(pieces))) if p}

    def marginal(text):
        alpha = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            alpha[j] = alpha[j - 1] * math.exp(sum(weights[of_byte[b]] for b in text[j - 1].encode()))
            alpha[j] += sum(alpha[i] * math.exp(weights[place[text[i:j]]]) for i in range(j) if text[i:j] in place)
        return alpha[-1]

    for i, t in enumerate(texts):
        want = math.log10(math.exp(weights[-1])) + sum(math.log10(marginal("▁" + w)) for w in (t or "").lower().split())
        assert got[i].lm_score == pytest.approx(want)
    assert got[0].lm_score == got[4].lm_score and got[0].lm_fitted_score > got[1].lm_fitted_score
