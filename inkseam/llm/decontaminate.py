"""Benchmark decontamination with a generalised suffix automaton over normalised item words.

Every word sequence of the benchmark is inserted into one automaton, which goes to all tasks if the benchmark's measured
size allows it. A larger benchmark is dealt into shards by the hash of its texts; their automata are built, sent and
dropped one after the other, and each leaves rows for the documents it hits. Documents are streamed through it word by word,
which gives at each word the length of the longest match that ends there. Stretches of at least `window` words (and
whole items that are shorter) are hits; `decontaminate` cuts hit spans and drops documents that are mostly hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkseam.llm.common import MOVED, row_key, stored, text_bytes, unused, widened

#: A-Z become a-z, every other ASCII sign that is no letter or digit becomes a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Benchmark text up to so many bytes goes into one automaton; more is dealt over shards, matched in turn.
BLOCK_BYTES = 16 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items behind each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = 10):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items_of: dict[tuple[int, ...], set] = {}
        seen: set[tuple[int, ...]] = set()
        for item, words in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
            if not ids:
                continue
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                self.items_of.setdefault(ids[i : i + size], set()).add(item)
            if ids not in seen:
                seen.add(ids)
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.short = sorted({len(w) for w in self.items_of if len(w) < window})
        self.least = self.short[0] if self.short else window

    def _split(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Half-open word ranges that windows cover (sorted, disjoint), and the items with such windows."""
        get, least = self.vocabulary.get, self.least
        if len(words) < least or not self.items_of:
            return [], set()
        ids = list(map(get, words))
        spans: list[tuple[int, int]] = []
        items: set = set()
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        state = matched = 0
        for i, c in enumerate(ids):
            if c is None:
                state = matched = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched < least:
                continue
            start = -1
            if matched >= window:
                start = i - matched + 1
                items |= self.items_of[tuple(ids[i - window + 1 : i + 1])]
            for m in short:
                if m > matched:
                    break
                if got := self.items_of.get(tuple(ids[i - m + 1 : i + 1])):
                    items |= got
                    start = i - m + 1 if start < 0 else min(start, i - m + 1)
            if start >= 0:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


def _automaton(items: DataFrame, window: int) -> Automaton:
    """The automaton of items (i, t), whose size was measured before; they stream to the driver, where it is built."""
    return Automaton(((row.i, words_of(row.t.encode())) for row in items.select("i", "t").toLocalIterator()), window)


def _joined(found: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for spans in found for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, since = [], 0
    for a, b in spans:
        out.append(text[since : at[a][0]])
        since = at[b - 1][1]
    return b"".join([*out, text[since:]])


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs plus bench_words, bench_hit, bench_items, bench_sha256 and bench_text (the text after cuts).

    Nulls: a null text has no words and stays null; a null item text matches nothing; windows of items without an id
    count as hits but are no item of the list. Repeated document rows are judged one by one; items that repeat an id
    count once. A very long text streams through the automaton whole, in memory in proportion to its length. Columns of
    docs with these five names are replaced, all others stay, whatever they are called. Empty tables give empty or hit-free
    results. With several shards, rows that come in another order when docs is read again raise.
    """
    spark = docs.sparkSession
    made = {"bench_words": "long", "bench_hit": "long", "bench_items": "long", "bench_sha256": "string", "bench_text": "string"}
    docs = docs.drop(*made)
    names = docs.columns
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("octet_length(t) > 0")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    def finished(batch: pa.RecordBatch, found: Iterable[tuple[int, list[tuple[int, int]], set]]) -> pa.RecordBatch:
        out = []
        for text, raw, (n, spans, hit) in zip(text_bytes(batch), batch.column("text").is_null().to_pylist(), found):
            listed = sorted(i for i in hit if i is not None)
            left = None if raw else cut(text, spans) if spans else text
            out.append((n, sum(b - a for a, b in spans), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), left))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns[:-1], columns[-1].cast(pa.string())], names=[*names, *made])

    if size <= block_bytes:
        sent = spark.sparkContext.broadcast(_automaton(items, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finished(batch, [(len(w), *sent.value.hits(w)) for w in map(words_of, text_bytes(batch))])

        return docs.mapInArrow(run, widened(docs.schema, made))

    shards = -(-2 * size // block_bytes)
    dealt = stored(items.withColumn("shard", F.expr(f"pmod(xxhash64(t), {shards}L)")).repartitionByRange("shard").sortWithinPartitions("shard"), "dc-items")
    row, found_at = unused(docs, "dc_row"), unused(docs, "dc_found")
    keyed = docs.withColumn(row, row_key())
    parts = None
    for k in range(shards):
        sent = spark.sparkContext.broadcast(_automaton(dealt.where(F.col("shard") == k), window))

        def hit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, text in zip(batch.column("row").to_pylist(), text_bytes(batch)):
                    spans, items_hit = sent.value.hits(words_of(text))
                    if spans:
                        out.append((key, hashlib.sha256(text).digest(), [x for span in spans for x in span], list(items_hit)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())))], names=["row", "sha", "ends", "hit"])

        part = stored(keyed.select(F.col(row).alias("row"), "text").mapInArrow(hit, "row long, sha binary, ends array<long>, hit array<string>"), "dc-hits")
        sent.destroy()
        parts = part if parts is None else parts.unionByName(part)
    gathered = parts.groupBy(F.col("row").alias(row)).agg(F.struct(F.max("sha").alias("sha"), F.collect_list("ends").alias("ends"), F.collect_list("hit").alias("hit")).alias(found_at))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, got in zip(text_bytes(batch), batch.column(found_at).to_pylist()):
                if got is None:
                    found.append((len(words_of(text)), [], set()))
                    continue
                if hashlib.sha256(text).digest() != got["sha"]:
                    raise ValueError(MOVED)
                found.append((len(words_of(text)), _joined([list(zip(x[::2], x[1::2])) for x in got["ends"]]), {i for x in got["hit"] for i in x}))
            yield finished(batch, found)

    return keyed.join(gathered, row, "left").select(*names, found_at).mapInArrow(joined, widened(docs.schema, made))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5) -> DataFrame:
    """docs with hit spans cut out of text; documents of which hits cover more than `coverage` of the words are dropped."""
    names = docs.columns
    out = match(docs, benchmark, window).where(F.col("bench_hit") <= F.lit(float(coverage)) * F.col("bench_words"))
    out = out.withColumn("text", F.col("bench_text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("bench_hit") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", F.col("bench_words").alias("n_words"), F.col("bench_hit").alias("n_hit"), F.col("bench_items").alias("n_items"), F.col("bench_sha256").alias("items_sha256"), (F.col("bench_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dwin AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
         FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT DISTINCT rid, i, dwin.m AS m, item_id FROM dwin JOIN bw ON dwin.win = bw.win AND dwin.m = bw.m),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
