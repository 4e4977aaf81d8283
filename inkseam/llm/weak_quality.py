r"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on every document. All documents' vote patterns are counted,
and expectation-maximisation over the counts estimates how often each labeller is right on good and on bad documents and
the share of good ones; no given label is used. Labellers overlap: what one sees alone among votes of good is doubted. The
posteriors then are the targets of a linear scorer over hashed words, word shapes and text statistics, trained on a bounded
sample of documents taken in the order of a hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkseam.llm.common import text_bytes, unused, widened

#: Documents that train the linear scorer.
SAMPLE_ROWS = 4_000
#: Hash buckets of the scorer, and features of one document that a training row may hold (the most frequent ones).
BUCKETS, ROW_FEATURES = 1 << 15, 2_000
EPOCHS = 6
THRESHOLD = 0.5
#: Before anything is known: a labeller's accuracy on good documents and, one start each, on bad ones; the share of good ones.
START, STARTS, PRIOR = 0.95, (0.2, 0.5, 0.8), 0.8
#: What is assumed counts as so many documents, whatever the corpus has.
ASSUMED = 2.0
_SPACE = b" \t\n\r\v\f"
_LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_ENDS = frozenset(_LETTERS + b".,;:!?\"')")


def _measures(text: bytes) -> dict[str, float]:
    words = text.split()
    n = max(len(words), 1)
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], words[2:], words[3:]))
    again = sum(k for k in pairs.values() if k > 1)
    size = max(len(text), 1)
    solid = text.translate(None, _SPACE)
    return {
        "words": len(words),
        "symbols": sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / n,
        "shouts": text.count(b"!!") / n,
        "again": again / max(len(words) - 3, 1),
        "lines": 1 - len(set(lines)) / max(len(lines), 1),
        "kinds": len(set(words)) / n,
        "stops": sum(text.count(c) for c in (b". ", b".\n", b"! ", b"? ")) / n + (text.rstrip()[-1:] in (b".", b"!", b"?")) / n,
        "mean": sum(map(len, words)) / n,
        "upper": sum(w.isupper() and len(w) > 1 for w in words) / n,
        "letters": 1 - len(solid.translate(None, _LETTERS)) / max(len(solid), 1),
        "ends": sum(w[-1] in _ENDS for w in words) / n,
        "digits": sum(text.count(str(d).encode()) for d in range(10)) / size,
    }


#: name -> vote. Each abstains where it can't tell.
LABELLERS = {
    "length": lambda m: -1 if m["words"] < 10 else int(m["words"] >= 50),
    "symbols": lambda m: -1 if m["symbols"] > 0.25 else int(m["symbols"] < 0.05),
    "shouts": lambda m: -1 if m["shouts"] > 0.15 else int(m["shouts"] < 0.03),
    "repeats": lambda m: (-1 if m["again"] > 0.4 else int(m["again"] < 0.1)) if m["words"] >= 40 else 0,
    "lines": lambda m: (-1 if m["lines"] > 0.5 else int(m["lines"] < 0.1)) if m["words"] >= 40 else 0,
    "variety": lambda m: (-1 if m["kinds"] < 0.1 else int(m["kinds"] > 0.3)) if m["words"] >= 50 else 0,
    "sentences": lambda m: -1 if m["stops"] < 0.005 else int(0.02 <= m["stops"] <= 0.25),
    "case": lambda m: -1 if m["upper"] > 0.5 else int(m["upper"] < 0.1),
    "word_size": lambda m: -1 if m["mean"] < 2 or m["mean"] > 25 else int(3 <= m["mean"] <= 10),
    "letters": lambda m: -1 if m["letters"] < 0.7 else int(m["letters"] > 0.9),
    "ends": lambda m: -1 if m["ends"] < 0.6 else int(m["ends"] > 0.9),
}


def _votes(m: dict[str, float]) -> list[int]:
    return [f(m) for f in LABELLERS.values()]


def votes(text: bytes) -> list[int]:
    return _votes(_measures(text))


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 500) -> dict[tuple[int, ...], float]:
    """Posterior of good for each vote pattern: expectation-maximisation for conditionally independent labellers.

    A labeller that votes is right on good documents and on bad ones with a chance of its own; abstentions say nothing.
    Of several starts the likeliest end is taken.
    """
    if not patterns:
        return {}
    v = np.array(list(patterns), np.int64)
    times = np.array(list(patterns.values()), float)
    up, down = (v > 0).astype(float), (v < 0).astype(float)
    best = None
    for start in STARTS:
        passed, caught, good = np.full(v.shape[1], START), np.full(v.shape[1], start), PRIOR
        for _ in range(rounds):
            as_good = np.log(good) + up @ np.log(passed) + down @ np.log(1 - passed)
            as_bad = np.log(1 - good) + up @ np.log(1 - caught) + down @ np.log(caught)
            posterior = 1 / (1 + np.exp(np.clip(as_bad - as_good, -50, 50)))
            w, u = posterior * times, (1 - posterior) * times
            before = np.concatenate([passed, caught, [good]])
            passed = (w @ up + ASSUMED * START) / (w @ (up + down) + ASSUMED)
            caught = (u @ down + ASSUMED * start) / (u @ (up + down) + ASSUMED)
            good = (w.sum() + ASSUMED * PRIOR) / (times.sum() + ASSUMED)
            if np.abs(np.concatenate([passed, caught, [good]]) - before).max() < 1e-9:
                break
        likely = float(times @ np.logaddexp(as_good, as_bad))
        if best is None or likely > best[0]:
            best = likely, posterior
    return dict(zip(patterns, best[1].tolist()))


def features(text: bytes, m: dict[str, float] | None = None, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: word shapes, short words, punctuation runs and coarse text statistics; at most limit of the first three."""
    from xxhash import xxh3_64_intdigest

    m = _measures(text) if m is None else m
    n = max(m["words"], 1)
    counts: Counter = Counter()
    for w, k in Counter(text.split()).items():
        core = w.strip(b".,;:!?*#$%&|<>\"'")
        end = w[len(w.rstrip(b".,;:!?*#$%&|<>\"'")) :][:4]
        counts[b"s" + (b"U" if core.isupper() else b"T" if core[:1].isupper() else b"l") + end] += k
        if len(core) <= 4:
            counts[b"w" + core.lower()] += k
    sizes = {hash_: (k / n) ** 0.5 for hash_, k in counts.most_common(limit)}
    for name in sorted(m):
        level = int(np.clip(np.round(np.log2(m[name] + 1e-3) * 2), -20, 40))
        sizes[f"m{name}{level}".encode()] = 1.0
    at = np.array([xxh3_64_intdigest(x) % BUCKETS for x in sizes], np.int64)
    return at, np.array(list(sizes.values()))


def train(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray) -> np.ndarray:
    """Weights of the logistic scorer (the last one is the constant), by stochastic steps with decaying rates."""
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS if rows else 0):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            z = weights[at] @ x + weights[-1]
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets[i]
            np.add.at(seen, at, (slope * x) ** 2)
            seen[-1] += slope**2
            np.subtract.at(weights, at, 0.3 * slope * x / np.sqrt(seen[at]))
            weights[-1] -= 0.3 * slope / np.sqrt(seen[-1])
    return weights


def score(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """All columns of docs plus wq_votes, wq_posterior (of the label model), wq_score (of the scorer, 0 to 1) and wq_kept.

    A null or empty text gets the votes of an empty one. Repeated rows count as often as they stand there and get equal
    scores; rows without id take part, but not in the scorer's sample; ids that tie in the sample's order go by themselves.
    A very long text is scored by all its features, in memory in proportion to its length. An empty table gives an empty
    result; columns of docs with these four names are replaced, all others stay, whatever they are called.
    """
    spark = docs.sparkSession
    docs = docs.drop("wq_votes", "wq_posterior", "wq_score", "wq_kept")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # at most one entry for each pattern of votes
        for batch in batches:
            seen.update(tuple(votes(t)) for t in text_bytes(batch))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["votes", "times"])

    counted = docs.select("text").mapInArrow(vote, "votes array<int>, times long").groupBy("votes").agg(F.sum("times").alias("times")).collect()
    posterior = label_model({tuple(r.votes): r.times for r in sorted(counted, key=lambda r: tuple(r.votes))})
    order = F.crc32(F.concat(F.lit("quality:"), F.col(id_column).cast("string")).cast("binary"))
    few = unused(docs, "wq_id")
    ids = docs.where(F.col(id_column).isNotNull()).select(id_column).distinct().orderBy(order, id_column).limit(SAMPLE_ROWS).withColumnRenamed(id_column, few)
    chosen = docs.join(F.broadcast(ids), F.col(id_column) == F.col(few), "left_semi").select(order.alias("o"), F.col(id_column).cast("string").alias("i"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            found = [features(t, limit=ROW_FEATURES) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("i"), pa.array([votes(t) for t in texts], pa.list_(pa.int32())), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())], names=["o", "i", "votes", "at", "x"])

    rows = sorted(chosen.mapInArrow(extract, "o long, i string, votes array<int>, at binary, x binary").dropDuplicates(["i"]).collect(), key=lambda r: (r.o, r.i))
    targets = np.array([posterior.get(tuple(r.votes), 0.5) for r in rows])
    weights = train([(np.frombuffer(bytes(r.at), np.int32).astype(np.int64), np.frombuffer(bytes(r.x), np.float32).astype(float)) for r in rows], targets)
    sent = spark.sparkContext.broadcast((posterior, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value
        for batch in batches:
            out = []
            for text in text_bytes(batch):
                m = _measures(text)
                v = _votes(m)
                at, x = features(text, m)
                s = float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))))
                out.append((v, known.get(tuple(v), 0.5), s, s >= THRESHOLD))
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "wq_votes", "wq_posterior", "wq_score", "wq_kept"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, widened(docs.schema, {"wq_votes": T.ArrayType(T.IntegerType()), "wq_posterior": "double", "wq_score": "double", "wq_kept": "boolean"}))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.selectExpr("doc_id", "wq_posterior AS posterior", "wq_score AS score", "wq_kept AS kept")
