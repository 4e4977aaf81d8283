"""One very long labelled text doesn't crowd its class out of the training sample."""

import zlib

from inkseam.llm import toxicity


def test_long_row_leaves_the_others_in(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 4_000)
    monkeypatch.setattr(toxicity, "ROW_CHARS", 300, raising=False)
    first = min(range(20), key=lambda i: (zlib.crc32(f"toxicity:{i}".encode()), i))
    docs = spark.createDataFrame([(i, "vile " * (5_000 if i == first else 3)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    rows, _ = toxicity.sample(docs, labels, "false")
    assert sorted(r.doc_id for r in rows) == list(range(20))
    assert sum(len(r.text) for r in rows) <= 2_000 and max(len(r.text) for r in rows) == 300
