r"""Toxicity scores from class-conditional Kneser-Ney models.

Two models of words, one of toxic and one of ordinary documents, discount their own counts; what the discount frees goes
to backoff counts shared by both classes, the contexts (preceding words) in which both use a word. Shared contexts, not
frequency, make a word likely in the class that doesn't hold it, and expressions too rare to tell the classes apart by
odds of FLOOR weigh nothing. A document's evidence is the difference of the two log-likelihoods, normalised by length (by
the number of words and by its root); a logistic curve fitted on labelled documents that the models have not seen makes it
a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkseam.llm.common import crc_mod, text_bytes, widened

#: The models are fitted on a sample of labelled rows: at most so many of each class, and so many characters in all.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 30_000_000
#: A longer text teaches with its first ROW_CHARS characters, so that it doesn't use up its class's half.
ROW_CHARS = 200_000
DISCOUNT = 0.75
#: Log odds of a word below this are taken as none.
FLOOR = 3.0
#: Every CALIBRATE-th sampled document is kept from the counts, for the curve.
CALIBRATE = 4
THRESHOLD = 0.3


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


class Model:
    """Evidence of each word that tells the classes apart, and the curve."""

    def __init__(self, texts: list[list[bytes]], toxic: list[int]):
        place: dict[bytes, int] = {}
        ids = [np.array([0, *[place.setdefault(w, len(place) + 1) for w in t]], np.int64) for t in texts]
        n = len(place) + 1
        own = []
        for label in (0, 1):
            mine = [x for x, t in zip(ids, toxic) if t == label]
            single = np.bincount(np.concatenate([x[1:] for x in mine] or [np.zeros(0, np.int64)]), minlength=n).astype(float)
            own.append((single, np.unique(np.concatenate([x[:-1] * n + x[1:] for x in mine] or [np.zeros(0, np.int64)]))))
        # shared backoff counts: the contexts in which both classes use a word, and one
        pairs = np.intersect1d(own[0][1], own[1][1], assume_unique=True)
        shared = np.bincount(pairs % n, minlength=n) + 1.0
        shared[0] = 1.0  # a word of no sampled document
        shared /= shared.sum()
        logs = []
        for single, _ in own:
            tokens, kinds = max(single.sum(), 1.0), max(np.count_nonzero(single), 1)
            logs.append(np.log((np.maximum(single - DISCOUNT, 0) + DISCOUNT * kinds * shared) / tokens))
        gain = logs[1] - logs[0]
        self.word = np.where(np.abs(gain) < FLOOR, 0.0, gain)
        self.place = {w: i for w, i in place.items() if self.word[i]}
        self.weights = np.zeros(3)

    def evidence(self, words: list[bytes]) -> tuple[float, float]:
        if not words:
            return 0.0, 0.0
        word, get = self.word, self.place.get
        total = float(sum([word[i] for w in words if (i := get(w))]))
        return total / len(words), total / len(words) ** 0.5

    def calibrate(self, x: np.ndarray, toxic: np.ndarray, share: float) -> None:
        """Logistic curve with the classes weighted to the share of toxic rows among all labelled ones."""
        x = np.column_stack([x, np.ones(len(x))])
        weight = np.where(toxic == 1, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
        ridge = np.diag([1e-2, 1e-2, 1e-4])
        b = np.array([0.0, 0.0, np.log(max(share, 1e-3) / max(1 - share, 1e-3))])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            gradient = x.T @ (weight * (toxic - p)) - ridge @ b
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
            b = b + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = b

    def score(self, words: list[bytes]) -> float:
        a, b = self.evidence(words)
        z = a * self.weights[0] + b * self.weights[1] + self.weights[2]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, held_out: str) -> tuple[list, float]:
    """The labelled training rows that the models may see, in a fixed order, and the share of toxic rows among all.

    Ids go in the order of a hash, ties by the id itself, so the sample doesn't depend on how rows are stored. Rows labelled
    twice count as toxic if one label says so; null labels and labels of no document are ignored.
    """
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~F.expr(held_out.format("doc_id")))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    order = F.crc32(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string")).cast("binary"))
    ids = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        ids = part if ids is None else ids.unionByName(part)
    # at most 2 * SAMPLE_ROWS ids; of rows that repeat an id the longest text teaches
    text = F.substring(F.coalesce("text", F.lit("")), 1, ROW_CHARS)
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.max(F.struct(F.char_length("text").alias("size"), F.col("text"))).alias("most"))
    one = one.select("doc_id", order.alias("o"), "toxic", "most.size", "most.text")
    running = Window.partitionBy("toxic").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = one.withColumn("sum", F.sum("size").over(running)).where(F.col("sum") <= SAMPLE_CHARS // 2).select("doc_id", "o", "toxic", "text").collect()
    return sorted(rows, key=lambda r: (r.o, r.doc_id)), share


def fit(rows: list, share: float) -> Model:
    """Models of the sampled rows (doc_id, o, toxic, text); without rows of both classes every score is their share."""
    texts = [_words((r.text or "").encode()) for r in rows]
    toxic = [int(r.toxic) for r in rows]
    seen = [i for i in range(len(rows)) if i % CALIBRATE]
    kept = [i for i in range(len(rows)) if not i % CALIBRATE]
    model = Model([texts[i] for i in seen], [toxic[i] for i in seen])
    marks = np.array([toxic[i] for i in kept], float)
    if 0 < marks.sum() < len(marks):
        model.calibrate(np.array([model.evidence(texts[i]) for i in kept]), marks, share)
    else:
        model.weights = np.array([0.0, 0.0, np.log(max(share, 1e-3) / max(1 - share, 1e-3))])
    return model


def score(docs: DataFrame, labels: DataFrame, held_out: str) -> DataFrame:
    """All columns of docs plus tox_score (0 to 1) and tox_predicted.

    held_out is SQL with a place for the id; rows that it marks teach nothing. Ids may be of any type that sorts. Only texts
    are scored: a null or empty text has no evidence and gets the curve's base rate. Repeated rows get equal scores. A very
    long text is scored whole, in memory in proportion to its length. Columns of docs with these two names are replaced, all
    others stay, whatever they are called; an empty table gives an empty result, and without labels all scores are equal.
    """
    docs = docs.drop("tox_score", "tox_predicted")
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, held_out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(_words(t)) for t in text_bytes(batch)]
            predicted = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], names=[*batch.schema.names, "tox_score", "tox_predicted"])

    return docs.mapInArrow(run, widened(docs.schema, {"tox_score": "double", "tox_predicted": "integer"}))


HELD_OUT = "crc32(CAST(coalesce(CAST({0} AS STRING), 'null') AS BINARY)) % 4 = 2"


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), HELD_OUT)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
