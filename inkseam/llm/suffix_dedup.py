r"""Exact removal of repeated byte strings with sharded suffix arrays.

Every WIDTH-byte window of a text gets the least hash of the k-grams in it as its key, so equal windows have equal keys
wherever they stand. Neighbouring windows with one key, in which its gram first stands at one place, form a run; a run and
its bytes are one context. Contexts that occur twice are repeated as a whole and need no comparison. Of keys that hold
several different contexts, those contexts that share the bytes around the gram (bands) with another one go to the key's
shard, one copy each, where a suffix array (induced sorting) and permuted common prefixes tell which windows also start
elsewhere. A key that comes from a frequent phrase holds ever more contexts as the input grows, but few that share more
than the phrase. Shards are bounded; a key with more bytes than a shard may hold is dealt by bands, and a band with more
is settled by counting the digests of its single windows instead, which spreads it over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkseam.llm.common import MOVED, discard, row_key, stored, text_bytes, unused, widened
from inkseam.llm.suffix_array import common_prefixes, suffix_array

WIDTH = 200
#: Bytes of a k-gram; a window holds WIDTH - GRAM + 1 of them.
GRAM = 24
#: Ranges of the place of a window's least gram, which have a hash each.
BANDS = 4
#: A shard's suffix array is built at this many bytes; keys with more bytes in different contexts are dealt by bands, and
#: bands with more count single windows.
SHARD_BYTES = 1 << 20
#: Whole keys share one suffix array until it has so many bytes; larger arrays leave the processor's caches.
ARRAY_BYTES = 1 << 18
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _grams(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    h = x[:-16] * _A + (x[8:-8] ^ np.uint64(0x5BD1E995)) * _B + (x[16:] ^ np.uint64(0x27D4EB2F)) * _C
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ h >> np.uint64(32)


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours."""
    n = len(h)
    rows = -(-n // wide)
    padded = np.full(rows * wide, ~np.uint64(0))
    padded[:n] = h
    block = padded.reshape(rows, wide)
    forth = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - wide + 1], forth[wide - 1 : n])


def _anchored(b: np.ndarray, at: np.ndarray, lo: int, windows: int, width: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Windows lo .. lo + windows - 1, whose least gram stands at several places lo + at, by the first of these places that
    they hold: (first start, last start, place). Of a periodic stretch one period of windows stays; its bytes come second,
    as every window there has a twin one period away."""
    gap, stop = int(np.diff(at).min()), lo + windows - 1 + width
    keep, sure = np.ones(windows, bool), []
    same = (b[lo : stop - gap] == b[lo + gap : stop]).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
    for u, v in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if v - u >= width + gap:
            sure.append((lo + u, lo + v + gap))
            keep[u + gap : v - width + gap + 1] = False
    label = np.where(keep, np.searchsorted(at, np.arange(windows)), -1)
    cuts = np.flatnonzero(label[1:] != label[:-1]) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), windows]
    return [(lo + x, lo + y - 1, lo + int(at[label[x]])) for x, y in zip(starts, ends) if label[x] >= 0], sure


def _edges(width: int) -> list[tuple[int, int]]:
    """Half-open ranges of the place of the least gram in a window, one for each band."""
    cuts = [(width - GRAM + 1) * i // BANDS for i in range(BANDS + 1)]
    return list(zip(cuts, cuts[1:]))


def runs(text: bytes, width: int = WIDTH) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Contexts of a text, and byte ranges that are certainly repeated.

    A context is (key, digest high, digest low, first window, number of windows, 0, place of the key's gram counted from the
    first window, a hash for each band or None). Its windows hold the gram first at that one place, so no two of them are
    equal, and windows that are equal in two contexts hold it at the same distance from their start. A band is a range of
    such distances; its hash is that of the bytes which all windows of the band have in common.
    """
    n = len(text)
    if n < width:
        return [], []
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    b = np.frombuffer(text, np.uint8)
    wide = width - GRAM + 1
    h = _grams(b)
    key = _least(h, wide)
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(key)]
    keys = key[starts].view(np.int64).tolist()
    edges = _edges(width)
    out, sure = [], []
    for m, k, lo, end in zip(key[starts], keys, starts, ends):
        at = np.flatnonzero(h[lo : end - 1 + wide] == m)
        if len(at) == 1:
            parts = [(lo, end - 1, lo + int(at[0]))]
        else:
            parts, twins = _anchored(b, at, lo, end - lo, width)
            sure += twins
        for x, y, p in parts:
            digest = xxh3_128_digest(text[x : y + width])
            bands = [
                (xxh3_64_intdigest(text[p - near : p + width - far + 1]) & 0xFFFFFFFF) - (1 << 31) if max(x, p - far + 1) <= min(y, p - near) else None
                for near, far in edges
            ]
            out.append((k, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), x, y - x + 1, 0, p - x, *bands))
    return out, sure


def repeated_in(contexts: list[bytes], wanted: list[bool], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each wanted context the half-open ranges of window starts that also start elsewhere in the shard."""
    joined = b"\xff".join(contexts)  # no UTF-8 text has this byte, so no window spans two contexts
    t = np.frombuffer(joined, np.uint8).astype(np.int64)
    left, right = common_prefixes(t, suffix_array(t), width)
    twice = np.maximum(left, right) >= width
    out, at = [], 0
    for context, want in zip(contexts, wanted):
        found: list[tuple[int, int]] = []
        if want:
            marks = twice[at : at + len(context) - width + 1].astype(np.int8)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], marks, [0]])))
            found = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append(found)
        at += len(context) + 1
    return out


_BANDS = [f"b{i}" for i in range(BANDS)]
_RUN = "row long, key long, d1 long, d2 long, lo int, windows int, state int, off int, " + ", ".join(f"{c} int" for c in _BANDS)
_RUN_NAMES = ["row", "key", "d1", "d2", "lo", "windows", "state", "off", *_BANDS]
_RUN_TYPES = [pa.int64()] * 4 + [pa.int32()] * (4 + BANDS)
_NO_BANDS = (0, *[None] * BANDS)


def _fingerprint(text: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text) >> 1


def _contexts(rows: DataFrame, width: int) -> DataFrame:
    """Contexts of all rows (row, text); state 9 marks byte ranges, lo and lo + windows, that are certainly repeated, and
    state 8 the hash of a text that has any window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out = []
                for row, text in zip(batch.column("row").to_pylist(), text_bytes(batch)):
                    found, sure = runs(text, width)
                    out += [(row, *x) for x in found]
                    # a key of its own: it meets no context
                    out += [(row, row, a, b, a, b - a, 9, *_NO_BANDS) for a, b in sure]
                    if found:
                        out.append((row, row, _fingerprint(text), 0, 0, 0, 8, *_NO_BANDS))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RUN_TYPES)], names=_RUN_NAMES)

    return rows.mapInArrow(run, _RUN)


def shards(contexts: Iterator[tuple], least: int) -> Iterator[list[tuple]]:
    """Contexts (key, ..., bytes), sorted by key, in lists of whole keys; a list ends with the key that brings it to `least` bytes."""
    held: list[tuple] = []
    size = 0
    for x in contexts:
        if held and x[0] != held[-1][0] and size >= least:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x[-1]) + 1
    if held:
        yield held


_PIECE = ("key", "d1", "lo", "windows", "off", "low", "high", "single")


def _with_texts(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(row, text, pieces): each text once, with the list of its pieces, at most as many as it has windows and bands."""
    return texts.join(pieces.groupBy("row").agg(F.collect_list(F.struct(*_PIECE)).alias("pieces")), "row")


def _cut(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, bytes, dict, int, int]]:
    """(row, text, piece, first window, last window) of the bands asked for, all of whose contexts are checked."""
    from xxhash import xxh3_128_digest

    edges = _edges(width)
    for row, text, pieces in zip(batch.column("row").to_pylist(), text_bytes(batch), batch.column("pieces").to_pylist()):
        for x in pieces:
            lo, last, place = x["lo"], x["lo"] + x["windows"] - 1, x["lo"] + x["off"]
            if int.from_bytes(xxh3_128_digest(text[lo : last + width])[:8], "little", signed=True) != x["d1"]:
                raise ValueError(MOVED)
            yield row, text, x, max(lo, place - edges[x["high"]][1] + 1), min(last, place - edges[x["low"]][0])


def _sharded(asked: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """(row, start, end) repeated byte ranges of the pieces asked for: (row, text, pieces)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                out = [(row, x["key"], a, x["single"], text[a : b + width]) for row, text, x, a, b in _cut(whole.slice(start, 500), width)]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "lo", "single", "context"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(held: list[tuple]) -> pa.RecordBatch:
            found = repeated_in([x[4] for x in held], [x[3] for x in held], width)
            out = [(x[1], x[2] + a, x[2] + b - 1 + width) for x, ranges in zip(held, found) for a, b in ranges]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["row", "start", "end"])

        rows = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "lo", "single", "context"))))
        yield from map(settled, shards(rows, min(shard_bytes, ARRAY_BYTES)))

    cutouts = asked.mapInArrow(cut, "row long, key long, lo int, single boolean, context binary")
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cutouts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(settle, "row long, start long, end long")


def _counted(asked: DataFrame, width: int) -> DataFrame:
    """The same for bands too large for a shard: digests of single windows are counted, with partial counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for start in range(0, whole.num_rows, 20):
                rows, los, digests = [], [], []
                for row, text, _, a, b in _cut(whole.slice(start, 20), width):
                    for i in range(a, b + 1):
                        rows.append(row)
                        los.append(i)
                        digests.append(xxh3_128_digest(text[i : i + width]))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(los, pa.int64()), pa.array(digests, pa.binary())], names=["row", "start", "digest"])

    windows = stored(asked.mapInArrow(run, "row long, start long, digest binary"), "sd-windows")
    twice = windows.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
    return windows.join(twice, "digest").select("row", "start", (F.col("start") + width).alias("end"))


def mark(docs: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns of docs plus sd_n_bytes, sd_n_removed, sd_n_spans, sd_kept (the bytes left) and sd_kept_sha256.

    A byte goes if it is in a `width`-byte string that starts at another place too, in the same or another row; rows that
    repeat a text of that length lose all of it. Null texts count as empty, shorter texts than `width` lose nothing, and an
    empty table gives an empty result. A very long text is cut into contexts like any other and needs memory in proportion
    to its own length. Columns of docs with the five names are replaced, all others stay, whatever they are called. Rows
    that come in another order when docs is read again, as files never do, raise. Digests of 128 bits stand for equal
    contexts.
    """
    made = {"sd_n_bytes": "long", "sd_n_removed": "long", "sd_n_spans": "long", "sd_kept": "binary", "sd_kept_sha256": "string"}
    docs = docs.drop(*made)
    names = docs.columns
    row = unused(docs, "sd_row")
    keyed = docs.withColumn(row, row_key())
    texts = keyed.select(F.col(row).alias("row"), "text")
    every = stored(_contexts(texts, width), "sd-contexts")
    # most keys stand once: only rows of the others are looked at again
    contexts = every.where("state < 8").drop("state")
    met = contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    again = stored(contexts.join(met, "key", "left_semi"), "sd-met")
    sure = every.where("state = 9").select("row", F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("windows")).cast("long").alias("end"))
    sure = stored(sure, "sd-sure")
    hashes = stored(every.where("state = 8").select("row", F.col("d1").alias("hash")), "sd-hashes")
    discard(every)
    kinds = again.groupBy("key", "d1", "d2").agg(F.count("*").alias("times"), F.first(F.struct("row", "lo", "windows", "off", *_BANDS)).alias("one"))
    kinds = stored(kinds.select("key", "d1", "d2", "times", "one.*"), "sd-kinds")
    whole = again.join(kinds.where("times > 1").select("key", "d1", "d2"), ["key", "d1", "d2"], "left_semi")
    whole = stored(whole.select("row", F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("windows") - 1 + width).cast("long").alias("end")), "sd-whole")
    discard(again)
    # windows of two contexts can be equal only in a band whose hash both have
    hashed = kinds.select("key", "d1", "d2", "times", "row", "lo", "windows", "off", F.posexplode(F.array(*_BANDS)).alias("band", "hash")).where("hash IS NOT NULL")
    shared = hashed.groupBy("key", "band", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    asked = hashed.join(shared, ["key", "band", "hash"], "left_semi").groupBy("key", "d1", "d2").agg(
        F.first(F.struct("row", "lo", "windows", "off", (F.col("times") == 1).alias("single"))).alias("one"), F.collect_list(F.struct("band", "hash")).alias("bands")
    )
    low, high = F.array_min("bands.band").alias("low"), F.array_max("bands.band").alias("high")
    asked = stored(asked.select("key", "d1", "one.*", "bands", low, high), "sd-asked")
    discard(kinds)
    most = max(far - near for near, far in _edges(width))
    size = F.least(F.col("windows"), (F.col("high") - F.col("low") + 1) * most).cast("long") + width
    hot = stored(asked.groupBy("key").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > shard_bytes).select("key"), "sd-hot")
    pieces, large, used = asked.select("row", *_PIECE), None, [sure, whole, asked, hashes, hot]
    if hot.limit(1).count():
        # a key with more bytes than a shard holds is dealt by the hashes of its bands
        fine = asked.join(hot, "key", "left_semi").select("row", "key", "d1", "lo", "windows", "off", "single", F.explode("bands").alias("b"))
        fine = fine.select("row", F.xxhash64("key", "b.band", "b.hash").alias("key"), "d1", "lo", "windows", "off", "single", F.col("b.band").alias("low"), F.col("b.band").alias("high"))
        fine = stored(fine, "sd-fine")
        over = stored(fine.groupBy("key").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > shard_bytes).select("key"), "sd-over")
        pieces = pieces.join(hot, "key", "left_anti").unionByName(fine.join(over, "key", "left_anti").select("row", *_PIECE))
        used += [fine, over]
        if over.limit(1).count():
            large = fine.join(over, "key", "left_semi")
    small = stored(_sharded(_with_texts(texts, pieces), width, shard_bytes), "sd-small")
    spans = sure.unionByName(whole).unionByName(small)
    used.append(small)
    if large is not None:
        counted = stored(_counted(_with_texts(texts, large), width), "sd-large")
        spans = spans.unionByName(counted)
        used.append(counted)
    # neighbouring contexts overlap: one list of ranges for each row, at most as many as the row has windows
    listed = stored(spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(hashes, "row"), "sd-spans")
    discard(*used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found, known in zip(text_bytes(batch), batch.column(spans_at).to_pylist(), batch.column(hash_at).to_pylist()):
                if known is not None and known != _fingerprint(text):
                    raise ValueError(MOVED)
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, since = [], 0
                for a, b in merged:
                    kept.append(text[since:a])
                    since = b
                left = b"".join([*kept, text[since:]])
                out.append((len(text), sum(b - a for a, b in merged), len(merged), left, hashlib.sha256(left).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, *made])

    spans_at, hash_at = unused(docs, "sd_spans"), unused(docs, "sd_hash")
    found = keyed.join(listed.select(F.col("row").alias(row), F.col("spans").alias(spans_at), F.col("hash").alias(hash_at)), row, "left")
    return found.select(*names, spans_at, hash_at).mapInArrow(run, widened(docs.schema, made))


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without repeated bytes; what a cut leaves of a sign becomes U+FFFD, and rows that lose all their text go.

    Rows of null or empty texts stay; n_chars, where docs has it, follows the text. Other columns stay as they are.
    """
    own = mark(docs, width)
    text = F.when(F.col("sd_n_removed") > 0, F.expr("make_valid_utf8(CAST(sd_kept AS STRING))")).otherwise(F.col("text"))
    out = own.where("sd_n_removed < sd_n_bytes OR sd_n_bytes = 0").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("sd_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = mark(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.selectExpr("doc_id", "sd_n_bytes AS n_bytes", "sd_n_removed AS n_removed", "sd_n_spans AS n_spans", "sd_kept_sha256 AS kept_sha256")
