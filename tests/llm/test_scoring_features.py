"""Scoring takes all features of a document; only rows that train are bounded."""

from inkseam.llm import weak_quality


def test_long_documents_are_scored_whole(spark, monkeypatch):
    bound = 5
    seen = []
    monkeypatch.setattr(weak_quality, "ROW_FEATURES", bound)
    real = weak_quality.train
    monkeypatch.setattr(weak_quality, "train", lambda rows, targets: seen.extend(len(at) for at, _ in rows) or real(rows, targets))
    text = b" ".join(f"w{i}".encode() for i in range(300))
    kept = spark.createDataFrame([(i, text.decode()) for i in range(3)], "doc_id long, text string")
    rows = weak_quality.score(kept).collect()
    stats = len(weak_quality._measures(text))
    assert seen and all(n == bound + stats for n in seen)
    assert len(weak_quality.features(text)[0]) > 300 > bound + stats
    # scores are those of the whole text, not of its first features
    import numpy as np

    found = [weak_quality.features(text, limit=bound)] * 3
    targets = np.array([rows[0].wq_posterior] * 3)
    weights = real([(at, x.astype(np.float32).astype(float)) for at, x in found], targets)
    at, x = weak_quality.features(text)
    want = 1 / (1 + np.exp(-(weights[at] @ x + weights[-1])))
    assert all(abs(r.wq_score - want) < 1e-6 for r in rows)
