r"""Language-model scores of whole documents: a subword lattice over an existing vocabulary.

Every word is a lattice whose arcs are the vocabulary's pieces (single signs may also be spelled in bytes), weighted by
the vocabulary's own scores. Forward recursion in log space sums over all segmentations, which gives the word's marginal
probability under a unigram model of pieces; a document's is the product over its words, each with its begin mark, and the
end. Over all documents these add up to at most one, as piece sequences that spell no document keep their share.

A second score comes from the corpus: expectation-maximisation over the distinct training words fits the piece
weights, and a further arc spans each word that training text holds, with its relative frequency; the weight between that
arc and the lattice is the share that Good and Turing leave for unseen words.

Distinct words are counted, spelled and stored once. Frequent words (a bounded table) go to every task; only the other
words of a document are shuffled to their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkseam.llm.common import crc_mod, row_key, same_content, stored, text_bytes, unused

MARK = "▁"
#: Frequent words sent to every task: at most so many, each of at most so many bytes.
HOT_WORDS, HOT_BYTES = 100_000, 64
#: Counters of a task are handed on at this size.
HELD = 200_000
ROUNDS = 3
#: Pseudo-count of each piece in each round.
PSEUDO = 0.1
#: The end of a document; words are never empty.
END = b""
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_RINV = pow(_R, -1, 1 << 64)
_PAD = 0x110000


def pieces_of(model_path: str) -> tuple[list[str], dict[int, int], np.ndarray, bool]:
    """Pieces usable in a lattice, byte value -> place, start scores, and whether these are log probabilities."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(model_path, "rb") as f:
        spec.ParseFromString(f.read())
    pieces, of_byte, scores = [], {}, []
    for p in spec.pieces:
        if p.type == 6:
            of_byte[int(p.piece[1:-1], 16)] = len(pieces)
        elif p.type not in (1, 4):
            continue
        pieces.append(p.piece if p.type != 6 else "")
        scores.append(p.score)
    return pieces, of_byte, np.array(scores, np.float64), spec.trainer_spec.model_type == 1


def start_weights(scores: np.ndarray, are_logs: bool) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end: unigram scores as they are, merge ranks by Zipf's law."""
    weights = scores if are_logs else -np.log(np.minimum(-scores, 1e9) + 10.0)
    weights = np.append(weights, np.log(np.mean(np.exp(weights))))
    return weights - np.log(np.exp(weights).sum())


class Lattice:
    def __init__(self, pieces: list[str], of_byte: dict[int, int], logp: np.ndarray):
        self.logp, self.n = logp, len(pieces)
        self.longest = max(map(len, pieces))
        codes = [np.frombuffer(p.encode("utf-32-le"), "<u4") for p in pieces]
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, c in enumerate(codes):
            if len(c):
                h = 0
                for k, x in enumerate(c.tolist()):
                    h = (h + (x + 1) * pow(_R, k, 1 << 64)) & _MASK
                by_size.setdefault(len(c), []).append((h, i))
        self.tables = {}
        for size, found in by_size.items():
            found.sort()
            keys, at = zip(*found)
            self.tables[size] = np.array(keys, np.uint64), np.array(at, np.int64), np.stack([codes[i] for i in at]).astype(np.int64)
        # a sign in bytes: the places of its one to four byte pieces, -1 where it has fewer
        point = np.arange(0x110001)
        tail = lambda shift: 0x80 | point >> shift & 0x3F
        size = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        utf8 = np.full((0x110001, 4), -1)
        utf8[:, 0] = np.select([size == 1, size == 2, size == 3], [point, 0xC0 | point >> 6, 0xE0 | point >> 12], 0xF0 | point >> 18)
        for k in (1, 2, 3):
            utf8[:, k] = np.where(size > k, np.select([size == k + 1, size == k + 2], [tail(0), tail(6)], tail(12)), -1)
        place = np.array([of_byte.get(b, -1) for b in range(256)] + [-1])
        self.bytes = place[np.where(utf8 > 255, 256, utf8)].astype(np.int32)
        self.weigh(logp)

    def weighed(self, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the pieces, and of each sign spelled in bytes."""
        padded = np.append(logp, 0.0)  # place -1: no byte there
        spelled = padded[self.bytes].sum(axis=1)
        spelled[self.bytes[:, 0] < 0] = -np.inf
        spelled[_PAD] = -np.inf
        return logp, spelled

    def weigh(self, logp: np.ndarray) -> None:
        self.logp, self.spelled = self.weighed(logp)

    def _groups(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        since = 0
        while since < len(order):
            most = max(1, min(4000, 400_000 // (len(words[order[min(since + 4000, len(order)) - 1]]) + 1)))
            part = order[since : since + most]
            since += len(part)
            sizes = np.array([len(words[i]) + 1 for i in part])
            codes = np.full((len(part), int(sizes.max())), _PAD, np.int64)
            codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.frombuffer("".join([MARK + words[i] for i in part]).encode("utf-32-le"), "<u4")
            yield part, sizes, codes

    def _arcs(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each size the place of the piece that starts at each sign, or -1."""
        wide = codes.shape[1]
        powers = np.cumprod(np.append(np.uint64(1), np.full(wide, _R, np.uint64)), dtype=np.uint64)
        back = np.cumprod(np.append(np.uint64(1), np.full(wide, _RINV, np.uint64)), dtype=np.uint64)
        sums = np.zeros((len(codes), wide + 1), np.uint64)
        np.cumsum((codes + 1).astype(np.uint64) * powers[:wide], axis=1, dtype=np.uint64, out=sums[:, 1:])
        out = {}
        for size, (keys, at, signs) in self.tables.items():
            if size > wide:
                continue
            key = (sums[:, size:] - sums[:, :-size]) * back[: wide - size + 1]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            rows, columns = np.nonzero(keys[found] == key)
            if not len(rows):
                continue
            # the hash only proposes a piece: its signs decide
            piece = found[rows, columns]
            same = np.ones(len(rows), bool)
            for k in range(size):
                same &= codes[rows, columns + k] == signs[piece, k]
            arcs = np.full(key.shape, -1, np.int64)
            arcs[rows[same], columns[same]] = at[piece[same]]
            out[size] = arcs
        return out

    def _forward(self, codes: np.ndarray, arcs: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        wide = codes.shape[1]
        padded = np.append(self.logp, -np.inf)
        weight = {size: padded[a] for size, a in arcs.items()}
        use = {size: (a >= 0).any(axis=0) for size, a in arcs.items()}
        spelled = self.spelled[codes]
        alpha = np.full((wide + 1, len(codes)), -np.inf)
        alpha[0] = 0
        with np.errstate(invalid="ignore"):
            for j in range(1, wide + 1):
                terms = [alpha[j - 1] + spelled[:, j - 1]] + [alpha[j - s] + w[:, j - s] for s, w in weight.items() if s <= j and use[s][j - s]]
                top = terms[0]
                for t in terms[1:]:
                    top = np.maximum(top, t)
                safe = np.where(np.isfinite(top), top, 0)
                total = sum(np.exp(t - safe) for t in terms)
                alpha[j] = np.where(np.isfinite(top), safe + np.log(np.where(total > 0, total, 1)), -np.inf)
        return alpha, weight

    def log10(self, words: list[str]) -> np.ndarray:
        """log10 of each word's marginal probability."""
        out = np.empty(len(words))
        for part, sizes, codes in self._groups(words):
            alpha, _ = self._forward(codes, self._arcs(codes))
            out[part] = alpha[sizes, np.arange(len(part))] / np.log(10)
        return out

    def log10_each(self, words: list[str], weights: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """log10() under each of several weights from weighed(); pieces are looked up once."""
        out = [np.empty(len(words)) for _ in weights]
        for part, sizes, codes in self._groups(words):
            arcs = self._arcs(codes)
            for made, (self.logp, self.spelled) in zip(out, weights):
                alpha, _ = self._forward(codes, arcs)
                made[part] = alpha[sizes, np.arange(len(part))] / np.log(10)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each word counted so often."""
        out = np.zeros(self.n + 1)
        for part, sizes, codes in self._groups(words):
            arcs, times, wide = self._arcs(codes), counts[part], codes.shape[1]
            alpha, weight = self._forward(codes, arcs)
            rows = np.arange(len(part))
            total = alpha[sizes, rows]
            beta = np.full((wide + 1, len(part)), -np.inf)
            beta[sizes, rows] = 0
            spelled = self.spelled[codes]
            for i in range(wide - 1, -1, -1):
                steps = [(0, beta[i + 1] + spelled[:, i])] + [(s, beta[i + s] + w[:, i]) for s, w in weight.items() if i + s <= wide]
                for size, t in steps:
                    gain = np.exp(np.where(np.isfinite(t), alpha[i] + t - total, -np.inf)) * times
                    if size:
                        used = gain > 0
                        np.add.at(out, arcs[size][used, i], gain[used])
                    else:
                        for k in range(4):
                            at = self.bytes[codes[:, i], k]
                            used = (gain > 0) & (at >= 0)
                            np.add.at(out, at[used], gain[used])
                beta[i] = np.where(i < sizes, np.logaddexp.reduce([t for _, t in steps]), beta[i])
        return out


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, and ASCII white space only


def count_words(docs: DataFrame, held_out: str) -> DataFrame:
    """(word, c, total): uses in training documents and in all; each task adds up what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            both = list(train.keys() | rest.keys())
            out = pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([train[w] for w in both], pa.int64()), pa.array([train[w] + rest[w] for w in both], pa.int64())], names=["word", "c", "total"])
            train.clear()
            rest.clear()
            return out

        for batch in batches:
            for text, held in zip(text_bytes(batch), batch.column("held").to_pylist()):
                to = rest if held else train
                to.update(_tokens(text))
                to[END] += 1
                if len(train) + len(rest) > HELD:
                    yield flush()
        if train or rest:
            yield flush()

    parts = docs.select("text", F.col(held_out).alias("held")).mapInArrow(run, "word binary, c long, total long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def _dealt(lexicon: DataFrame) -> DataFrame:
    spark = lexicon.sparkSession
    return lexicon.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def fit_pieces(lexicon: DataFrame, model_path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end: expectation-maximisation over the distinct training words.

    Each counts once: the lattice spells words that training text lacks, and these are like its rare words.
    """
    pieces, of_byte, scores, are_logs = pieces_of(model_path)
    logp = start_weights(scores, are_logs)
    words = stored(_dealt(lexicon.where("c > 0").select("word")), "lm-words") if rounds else lexicon
    for _ in range(rounds):
        sent = lexicon.sparkSession.sparkContext.broadcast(logp)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, sums = None, None
            for batch in batches:
                lattice = lattice or Lattice(pieces_of(model_path)[0], of_byte, sent.value)
                sums = np.zeros(lattice.n + 1) if sums is None else sums
                found = [w.decode() for w in batch.column("word").to_pylist()]
                sums[-1] += found.count("")
                found = [w for w in found if w]
                if found:
                    sums += lattice.expected(found, np.ones(len(found)))
            if sums is not None:
                at = np.nonzero(sums)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["piece", "uses"])

        uses = np.full(len(logp), PSEUDO)
        # at most one row for each piece of the vocabulary
        for row in words.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[row.piece] += row.uses
        logp = np.log(uses / uses.sum())
    return logp


def score(docs: DataFrame, model_path: str, held_out: str, rounds: int = ROUNDS) -> DataFrame:
    """All columns of docs plus lm_n_tokens, lm_n_known, lm_train_tokens, lm_base_score, lm_score (log10 of the marginal
    probability under the vocabulary's own scores) and lm_fitted_score (under the weights fitted to the training rows).

    held_out names a boolean column; null counts as false. A null or empty text is the end alone. Repeated rows count and
    are scored as often as they stand there; equal texts get equal scores. Without training rows every count is 0 and the
    fitted weights are the vocabulary's own. Very long texts and words are scored whole; a word's lattice needs memory in
    proportion to its length. An empty table gives an empty result; columns of docs with these six names are replaced, all
    others stay, whatever they are called. Rows that come in another order when docs is read again raise.
    """
    spark = docs.sparkSession
    docs = docs.drop("lm_n_tokens", "lm_n_known", "lm_train_tokens", "lm_base_score", "lm_score", "lm_fitted_score")
    names = docs.columns
    row, held, known_hash = unused(docs, "lm_row"), F.coalesce(F.col(held_out), F.lit(False)), unused(docs, "lm_hash")
    docs = docs.withColumn(held_out, held)
    counts = stored(count_words(docs, held_out), "lm-counts")
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    sent = spark.sparkContext.broadcast((start_weights(*pieces_of(model_path)[2:]), fit_pieces(counts, model_path, rounds if n else 0)))
    unseen = (once + 0.5) / (n + 1)
    base = log10(n + v + 1)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            if lattice is None:
                pieces, of_byte, _, _ = pieces_of(model_path)
                lattice = Lattice(pieces, of_byte, sent.value[0])
                weights = [lattice.weighed(logp) for logp in sent.value]
            words = [w.decode() for w in batch.column("word").to_pylist()]
            at = [i for i, w in enumerate(words) if w]
            both = [np.full(len(words), logp[-1] / np.log(10)) for logp in sent.value]
            if at:
                for own, found in zip(both, lattice.log10_each([words[i] for i in at], weights)):
                    own[at] = found
            c = np.array(batch.column("c").to_pylist(), np.float64)
            whole = np.log10(np.maximum((1 - unseen) * c / max(n, 1), 1e-300))
            fitted = both[1] + log10(min(unseen, 1.0))
            fitted = np.where(c > 0, np.logaddexp(fitted * np.log(10), whole * np.log(10)) / np.log(10), fitted)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("total"), pa.array(both[0]), pa.array(fitted)], names=["word", "c", "total", "lp", "lf"])

    lexicon = stored(_dealt(counts).mapInArrow(spell, "word binary, c long, total long, lp double, lf double"), "lm-lexicon")
    hot = lexicon.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("total"), "word").limit(HOT_WORDS).collect()
    known = spark.sparkContext.broadcast({bytes(r.word): (r.c, log10(r.c + 1) - base, r.lp, r.lf) for r in hot})
    del hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rid, word, tf, sums = [], [], [], []
                for key, now, text in zip(batch.column("row").to_pylist(), batch.column("hash").to_pylist(), text_bytes(batch)):
                    words = _tokens(text)
                    words.append(END)
                    known_n, a, b, f = 0, 0.0, 0.0, 0.0
                    for w, k in Counter(words).items():
                        if (got := table.get(w)) is None:
                            rid.append(key)
                            word.append(w)
                            tf.append(k)
                            sums.append((None,) * 6)
                        else:
                            if got[0]:
                                known_n += k
                            a += k * got[1]
                            b += k * got[2]
                            f += k * got[3]
                    rid.append(key)
                    word.append(b" %d" % key)  # no word starts with a space: this key meets nothing, and each row has its own
                    tf.append(0)
                    sums.append((now, len(words), known_n, a, b, f))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(word, pa.binary()), pa.array(tf, pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*sums), kinds))], names=["row", "word", "tf", "hash", "n", "k", "a", "b", "f"])

    keyed = docs.withColumn(row, row_key()).withColumn(known_hash, F.xxhash64("text"))
    rows = keyed.select(F.col(row).alias("row"), F.col(known_hash).alias("hash"), "text").mapInArrow(run, "row long, word binary, tf long, hash long, n long, k long, a double, b double, f double")
    met = rows.join(lexicon.select("word", "c", "lp", "lf"), "word", "left")
    sums = met.groupBy("row").agg(
        F.max("hash").alias("hash"),
        F.sum("n").alias("lm_n_tokens"),
        F.sum(F.coalesce("k", F.when(F.col("c") > 0, F.col("tf")), F.lit(0))).alias("lm_n_known"),
        F.sum(F.coalesce("a", F.col("tf") * (F.log10(F.col("c") + 1.0) - base))).alias("lm_base_score"),
        F.sum(F.coalesce("b", F.col("tf") * F.col("lp"))).alias("lm_score"),
        F.sum(F.coalesce("f", F.col("tf") * F.col("lf"))).alias("lm_fitted_score"),
    )
    sums = sums.select(F.col("row").alias("lm_key"), F.struct("*").alias("lm_got"))
    out = keyed.select(*([c for c in names if c != "text"] if names == ["doc_id", "text", held_out] else names), F.struct(row, known_hash).alias(row))
    key, got = unused(out, "lm_key"), unused(out, "lm_got")
    out = out.join(sums.toDF(key, got), F.col(f"{row}.{row}") == F.col(key))
    checked = same_content(F.col(f"{got}.hash"), F.col(f"{row}.{known_hash}"), F.col(f"{got}.lm_n_tokens"))
    made = [F.col(f"{got}.{c}").alias(c) for c in ("lm_n_known", "lm_base_score", "lm_score", "lm_fitted_score")]
    kept = [c for c in out.columns if c not in (row, key, got)]
    return out.select(*kept, checked.alias("lm_n_tokens"), F.lit(int(n)).cast("long").alias("lm_train_tokens"), *made)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    out = score(docs, public_tokenizers.path("piece_bpe_32k.model"), "held_out")
    return out.select("doc_id", "held_out", F.col("lm_n_tokens").alias("n_tokens"), F.col("lm_n_known").alias("n_known"), F.col("lm_train_tokens").alias("train_tokens"), F.col("lm_base_score").alias("base_score"), F.col("lm_fitted_score").alias("score"), F.col("lm_score").alias("vocabulary_score"))
