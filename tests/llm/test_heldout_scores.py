"""op1's score is the model that learns from the training rows, not the vocabulary's own weights."""

import math

from inkseam.llm.lm_scoring import op1_lm_scoring


def test_held_out_scores_are_near_the_base(spark):
    rows = op1_lm_scoring(spark, "/root/testdata/sf0.001").collect()
    assert all(r.score is not None and math.isfinite(r.score) for r in rows)
    held = [r for r in rows if r.held_out]
    base, score, vocabulary = (sum(r[c] for r in held) for c in ("base_score", "score", "vocabulary_score"))
    # the base gives every unseen word the same share, a model of all words has to spell it
    assert 1.5 * base < score and vocabulary < 1.5 * score
