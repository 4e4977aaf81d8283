"""Queries of the retrieval engine over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkseam.functions import analysis
from inkseam.functions.scoring import BM25
from inkseam.operators import evaluate, index
from inkseam.plans import retrieval
from inkseam.sources.corpus import run_lines

TERMS = ("thand", "ing", "of", "tion", "erth")
SINGLE = "The thing's tioning, erth and erth reading"

_kept: dict[tuple[str, str], index.Index] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("ext_id"), F.col("text").alias("body"))
    few = spark.sparkContext.defaultParallelism
    # one row group is one task: text analysis is worth dealing the rows out
    return docs.repartition(few) if docs.rdd.getNumPartitions() < few else docs


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of documents, kept for the session: many queries ask for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = index.build(_docs(spark, sf_dir), store_text=True)
    return _kept[key]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), "text")


def _joined(df: DataFrame, column: str) -> DataFrame:
    return df.select("doc_id", F.array_join(column, " ").alias("terms"))


def tokenize(spark, sf_dir):
    return _joined(_docs(spark, sf_dir).select("doc_id", analysis.tokenize(F.col("body")).alias("t")), "t")


def _tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(analysis.tokenize(F.col("body"))).alias("token")).distinct()


def possessive(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", analysis.possessive(F.col("token")).alias("out"))


def lowercase(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", analysis.lowercase(F.col("token")).alias("out"))


def stopword_filter(spark, sf_dir):
    tokens = _docs(spark, sf_dir).select("doc_id", F.transform(analysis.tokenize(F.col("body")), lambda t: analysis.lowercase(analysis.possessive(t))).alias("t"))
    return tokens.select("doc_id", F.size(F.filter("t", analysis.is_stopword)).cast("long").alias("n_stop"), F.size(F.filter("t", lambda t: (t != "") & ~analysis.is_stopword(t))).cast("long").alias("n_left"))


def analyze_no_stem(spark, sf_dir):
    return _joined(analysis.with_words(_docs(spark, sf_dir)), "words")


def analyze(spark, sf_dir):
    return _joined(analysis.with_terms(_docs(spark, sf_dir).select("doc_id", "body")).where(F.size("terms") > 0), "terms")


def porter_stem(spark, sf_dir):
    words = analysis.with_words(_docs(spark, sf_dir)).select(F.explode("words").alias("word")).distinct()
    return analysis.with_stems(words).select("word", "term")


def postings_tf(spark, sf_dir):
    return _index(spark, sf_dir).counts.select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


def doc_lengths(spark, sf_dir):
    return _index(spark, sf_dir).docs.select("doc_id", "ext_id", F.col("dl").cast("long").alias("dl"))


def corpus_stats(spark, sf_dir):
    found = _index(spark, sf_dir)
    docs = found.docs.agg(F.count("*").alias("n_docs"), F.sum("dl").cast("long").alias("total_terms"), F.round(F.sum("dl") / F.count("*"), 6).alias("avgdl"))
    return docs.crossJoin(F.broadcast(found.weights.agg(F.count("*").alias("n_terms"), F.sum("df").cast("long").alias("n_postings"))))


def term_df(spark, sf_dir):
    return _index(spark, sf_dir).weights.select("term", "df", F.round("idf", 6).alias("idf"))


def vocabulary(spark, sf_dir):
    return _index(spark, sf_dir).weights.select("term").orderBy("term")


def query_term_counts(spark, sf_dir):
    return retrieval.query_terms(_items(spark, sf_dir))


def _found(spark, sf_dir, algorithm="bmw", k=10, bm25=None, queries=None):
    return retrieval.search(_index(spark, sf_dir), retrieval.query_terms(_items(spark, sf_dir) if queries is None else queries), k, algorithm, bm25)


def _rounded(df):
    return df.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def bm25_topk_batch(spark, sf_dir):
    return _rounded(_found(spark, sf_dir, "exhaustive"))


def bm25_wand(spark, sf_dir):
    return _rounded(_found(spark, sf_dir, "wand"))


def bm25_bmw(spark, sf_dir):
    return _rounded(_found(spark, sf_dir, "bmw"))


def bm25_topk_1000(spark, sf_dir):
    return _rounded(_found(spark, sf_dir, "bmw", 1000))


def bm25_other_parameters(spark, sf_dir):
    return _rounded(_found(spark, sf_dir, "exhaustive", bm25=BM25(1.2, 0.75)))


def bm25_topk_single(spark, sf_dir):
    one = spark.createDataFrame([("q", SINGLE)], "qid string, text string")
    return _rounded(_found(spark, sf_dir, "bmw", queries=one))


def bm25_repeated_term(spark, sf_dir):
    both = spark.createDataFrame([("once", "erth"), ("twice", "erth ERTH")], "qid string, text string")
    return _rounded(_found(spark, sf_dir, "bmw", queries=both))


def term_max_score(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", F.round("max_score", 6).alias("max_score"))


def tile_max(spark, sf_dir):
    return _index(spark, sf_dir).tiles.select("term", "tile", F.round("tile_max", 6).alias("tile_max"))


def block_max(spark, sf_dir):
    return index.blocks(_index(spark, sf_dir).postings).select("term", "block_no", F.round("block_max", 6).alias("block_max"))


def skip_entries(spark, sf_dir):
    return index.blocks(_index(spark, sf_dir).postings).select("term", "block_no", "first_doc", "last_doc", "n")


def gap_encode(spark, sf_dir):
    return index.gaps(_index(spark, sf_dir).counts).select("term", "doc_id", "gap")


def gap_decode(spark, sf_dir):
    coded = index.gaps(_index(spark, sf_dir).counts).withColumn("pos", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).select("term", "pos", "gap")
    return index.from_gaps(coded).select("term", "pos", "doc_id")


def term_lookup(spark, sf_dir):
    return _index(spark, sf_dir).counts.where(F.col("term").isin(*TERMS)).select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


def doc_range_seek(spark, sf_dir):
    return _index(spark, sf_dir).counts.where(F.col("term").isin(*TERMS) & (F.col("doc_id") >= 100)).select("term", "doc_id")


def result_with_text(spark, sf_dir):
    found = _found(spark, sf_dir, "bmw", 3)
    return retrieval.with_ids(found, _index(spark, sf_dir), text=True).select("qid", "rank", "ext_id", "body")


def result_json(spark, sf_dir):
    rows = retrieval.with_ids(_found(spark, sf_dir, "bmw", 5), _index(spark, sf_dir))
    hits = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("ext_id").alias("id")))).alias("results"))
    return hits.select("qid", F.to_json(F.struct("results")).alias("response"))


def _qrels(spark, sf_dir):
    """(ext_id, grade), the same for every benchmark item."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("ext_id"), F.col("quality").cast("int").alias("grade"))


def _judged(spark, sf_dir):
    """All benchmark items with an id, if there are judgments."""
    some = _qrels(spark, sf_dir).limit(1)
    return _items(spark, sf_dir).where("qid IS NOT NULL").join(F.broadcast(some), F.lit(True), "left_semi")


def judged_only(spark, sf_dir):
    return _judged(spark, sf_dir).select("qid", "text")


def first_n_queries(spark, sf_dir):
    return _items(spark, sf_dir).orderBy("qid").limit(10)


def _run(spark, sf_dir, k=1000):
    found = retrieval.with_ids(_found(spark, sf_dir, "bmw", k, queries=_judged(spark, sf_dir)), _index(spark, sf_dir))
    return found.select("qid", "rank", "ext_id", F.round("score", 6).alias("score"))


def trec_run(spark, sf_dir):
    return run_lines(_run(spark, sf_dir, 10), "bm25").select("qid", "rank", "line")


def trec_eval_rank(spark, sf_dir):
    return evaluate.ranked(_run(spark, sf_dir, 100)).select("qid", "ext_id", "rank")


def _metric(spark, sf_dir, name):
    return evaluate.per_query(_run(spark, sf_dir), _qrels(spark, sf_dir), queries=_judged(spark, sf_dir)).select("qid", F.round(name, 6).alias(name))


def eval_summary(spark, sf_dir):
    rows = evaluate.summary(_run(spark, sf_dir), _qrels(spark, sf_dir), _judged(spark, sf_dir))
    return rows.select("queries", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


def latency_percentiles(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("value") * 1000).cast("long").alias("ns"))
    return evaluate.latency_summary(events).select("queries", F.round("mean_ms", 6).alias("mean_ms"), "p50_ms", "p95_ms", "p99_ms")


def pivot_terms(spark, sf_dir):
    """Terms of each query by falling bound, with the running sum of bounds that pruning compares with a threshold."""
    terms = retrieval.query_terms(_items(spark, sf_dir)).join(_index(spark, sf_dir).terms, "term").withColumn("bound", F.col("n") * F.col("max_score"))
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "term")
    return terms.select("qid", "term", F.round(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"))


def index_merge(spark, sf_dir):
    """Two halves indexed on their own and merged: the same postings as one index."""
    docs = _docs(spark, sf_dir)
    n = (docs.agg(F.max("doc_id")).first()[0] or 0) // 2
    halves = [docs.where(F.col("doc_id") <= n), docs.where(F.col("doc_id") > n).withColumn("doc_id", F.col("doc_id") - n - 1)]
    merged = index.merge([index.build(h) for h in halves])
    return merged.postings.select("term", "doc_id", F.round("impact", 6).alias("impact"))


def index_check(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in index.check(_index(spark, sf_dir))], "problem string")


_NAMES = [
    tokenize, possessive, lowercase, stopword_filter, analyze_no_stem, analyze, porter_stem, postings_tf, doc_lengths, corpus_stats, term_df, vocabulary, query_term_counts,
    bm25_topk_single, bm25_topk_batch, bm25_wand, bm25_bmw, bm25_topk_1000, bm25_repeated_term, bm25_other_parameters, term_max_score, tile_max, block_max, skip_entries,
    gap_encode, gap_decode, term_lookup, doc_range_seek, result_with_text, result_json, judged_only, first_n_queries, trec_run, trec_eval_rank, eval_summary,
    latency_percentiles, pivot_terms, index_merge, index_check,
]
METRICS = ("ndcg10", "recall100", "recall1000", "mrr10")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES} | {m: partial(_metric, name=m) for m in METRICS}


# -- SQL -------------------------------------------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_STOP = "(" + ", ".join(_q(w) for w in analysis.STOPWORDS) + ")"


def _words(source: str, key: str, name: str) -> str:
    """CTEs name_t (key, pos, token) and name (key, pos, word)."""
    return f"""{name}_t AS (SELECT {key}, pos, token FROM (SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS pos
    FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), {_q(analysis.TOKEN_RE2)}) AS t FROM {source})) WHERE regexp_matches(token, {_q(analysis.BASE_RE2)})),
{name} AS (SELECT {key}, pos, lower(regexp_replace(token, '[''’＇][sS]$', '')) AS word FROM {name}_t WHERE lower(regexp_replace(token, '[''’＇][sS]$', '')) NOT IN {_STOP} AND lower(regexp_replace(token, '[''’＇][sS]$', '')) <> '')"""


def _stems(source: str) -> str:
    out = [f"s0 AS MATERIALIZED (SELECT DISTINCT word, word AS w FROM {source})"]
    out += [f"s{i} AS MATERIALIZED (SELECT word, {sql} AS w FROM s{i - 1})" for i, sql in enumerate(analysis.porter_steps(False), 1)]
    return ",\n".join([*out, f"stem AS MATERIALIZED (SELECT word, w AS term FROM s{len(out) - 1})"])


_DOCS = "docs AS (SELECT doc_id, text FROM documents)"
_ITEMS = "items AS (SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark)"
_D = _words("docs", "doc_id", "dw")
_BOTH = f"WITH {_DOCS}, {_D}, {{items}}, {_words('items', 'qid', 'qw')}, {_stems('(SELECT word FROM dw UNION SELECT word FROM qw)')}"
_INDEX = """,
tf AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM dw JOIN stem USING (word) GROUP BY ALL),
dl AS MATERIALIZED (SELECT d.doc_id, count(w.doc_id) AS dl FROM docs d LEFT JOIN dw w ON d.doc_id = w.doc_id GROUP BY d.doc_id),
st AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl, CAST(sum(dl) AS BIGINT) AS t FROM dl),
df AS MATERIALIZED (SELECT term, count(*) AS df, ln(1e0 + (any_value(n) - count(*) + 5e-1) / (count(*) + 5e-1)) AS idf FROM tf, st GROUP BY term),
p AS MATERIALIZED (SELECT term, doc_id, tf, dl, idf, idf * tf / (tf + {k1} * ((1e0 - {b}) + {b} * dl / avgdl)) AS impact FROM tf JOIN dl USING (doc_id) JOIN df USING (term), st),
qt AS (SELECT qid, term, count(*) AS n FROM qw JOIN stem USING (word) GROUP BY ALL),
hits AS (SELECT qid, doc_id, list_reduce(list_prepend(0e0, list(n * impact ORDER BY term)), lambda a, x: a + x) AS score FROM qt JOIN p USING (term) GROUP BY qid, doc_id),
top AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM hits)
"""


def _sql(select: str, items: str = _ITEMS, k1: str = "9e-1", b: str = "4e-1") -> str:
    return _BOTH.replace("{items}", items) + _INDEX.replace("{k1}", k1).replace("{b}", b) + select


def _fixed(*rows: tuple[str, str]) -> str:
    return "items(qid, text) AS (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in rows) + ")"


_TOP = "SELECT qid, rank, doc_id, round(score, 6) AS score FROM top WHERE rank <= {}"
_ALL = "SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark WHERE item_id IS NOT NULL AND (SELECT count(*) FROM labels) > 0"
_JUDGED = f"items AS ({_ALL})"
_EVAL = """, qrels AS (SELECT q.qid, CAST(doc_id AS VARCHAR) AS ext_id, quality AS grade FROM labels, (SELECT DISTINCT qid FROM items) q),
run AS (SELECT qid, ext_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ext_id DESC) AS rank FROM (SELECT qid, CAST(doc_id AS VARCHAR) AS ext_id, round(score, 6) AS score FROM top WHERE rank <= {k})),
best AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS rank FROM qrels),
ideal AS (SELECT qid, sum(CASE WHEN grade >= 1 AND rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS ideal, count(*) FILTER (grade >= 1) AS relevant FROM best GROUP BY qid),
got AS (SELECT qid, sum(CASE WHEN grade >= 1 AND rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS g, count(*) FILTER (grade >= 1 AND rank <= 100) AS h100, count(*) FILTER (grade >= 1 AND rank <= 1000) AS h1000, min(rank) FILTER (grade >= 1 AND rank <= 10) AS f FROM run JOIN qrels USING (qid, ext_id) GROUP BY qid),
m AS (SELECT qid, coalesce(g / nullif(ideal, 0), 0) AS ndcg10, coalesce(h100 / nullif(relevant, 0), 0) AS recall100, coalesce(h1000 / nullif(relevant, 0), 0) AS recall1000, coalesce(1e0 / f, 0) AS mrr10 FROM ideal LEFT JOIN got USING (qid))
"""


def oracle_sql() -> dict[str, str]:
    docs = f"WITH {_DOCS}, {_D} "
    stemmed = f"WITH {_DOCS}, {_D}, {_stems('dw')} "
    order = "(PARTITION BY term ORDER BY doc_id)"
    blocks = f"SELECT term, CAST(floor((row_number() OVER {order} - 1) / 128) AS INTEGER) AS block_no, doc_id, impact FROM p"
    terms = ", ".join(_q(t) for t in TERMS)
    ev = lambda select, k=1000: _sql(_EVAL.replace("{k}", str(k)) + select, _JUDGED)
    out = {
        "tokenize": docs + "SELECT d.doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS terms FROM docs d LEFT JOIN dw_t t ON d.doc_id = t.doc_id GROUP BY d.doc_id",
        "possessive": docs + "SELECT DISTINCT token, regexp_replace(token, '[''’＇][sS]$', '') AS out FROM dw_t",
        "lowercase": docs + "SELECT DISTINCT token, lower(token) AS out FROM dw_t",
        "stopword_filter": docs + f"SELECT d.doc_id, count(*) FILTER (w IN {_STOP}) AS n_stop, count(*) FILTER (w NOT IN {_STOP} AND w <> '') AS n_left FROM docs d LEFT JOIN (SELECT doc_id, lower(regexp_replace(token, '[''’＇][sS]$', '')) AS w FROM dw_t) t ON d.doc_id = t.doc_id GROUP BY d.doc_id",
        "analyze_no_stem": docs + "SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS terms FROM docs d LEFT JOIN dw t ON d.doc_id = t.doc_id GROUP BY d.doc_id",
        "analyze": stemmed + "SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM dw JOIN stem USING (word) GROUP BY doc_id",
        "porter_stem": stemmed + "SELECT word, term FROM stem",
        "postings_tf": _sql("SELECT term, doc_id, tf FROM tf"),
        "doc_lengths": _sql("SELECT doc_id, CAST(doc_id AS VARCHAR) AS ext_id, dl FROM dl"),
        "corpus_stats": _sql("SELECT n AS n_docs, t AS total_terms, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms, (SELECT CAST(sum(df) AS BIGINT) FROM df) AS n_postings FROM st"),
        "term_df": _sql("SELECT term, df, round(idf, 6) AS idf FROM df"),
        "vocabulary": _sql("SELECT term FROM df"),
        "query_term_counts": _sql("SELECT qid, term, n FROM qt"),
        "bm25_topk_single": _sql(_TOP.format(10), _fixed(("q", SINGLE))),
        "bm25_repeated_term": _sql(_TOP.format(10), _fixed(("once", "erth"), ("twice", "erth ERTH"))),
        "bm25_topk_batch": _sql(_TOP.format(10)),
        "bm25_wand": _sql(_TOP.format(10)),
        "bm25_bmw": _sql(_TOP.format(10)),
        "bm25_topk_1000": _sql(_TOP.format(1000)),
        "bm25_other_parameters": _sql(_TOP.format(10), k1="12e-1", b="75e-2"),
        "term_max_score": _sql("SELECT term, round(max(impact), 6) AS max_score FROM p GROUP BY term"),
        "tile_max": _sql(f"SELECT term, doc_id // {index.TILE} AS tile, round(max(impact), 6) AS tile_max FROM p GROUP BY ALL"),
        "block_max": _sql(f"SELECT term, block_no, round(max(impact), 6) AS block_max FROM ({blocks}) GROUP BY ALL"),
        "skip_entries": _sql(f"SELECT term, block_no, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS n FROM ({blocks}) GROUP BY ALL"),
        "gap_encode": _sql(f"SELECT term, doc_id, doc_id - lag(doc_id, 1, -1) OVER {order} AS gap FROM p"),
        "gap_decode": _sql(f"SELECT term, CAST(row_number() OVER {order} AS INTEGER) AS pos, doc_id FROM p"),
        "term_lookup": _sql(f"SELECT term, doc_id, tf FROM p WHERE term IN ({terms})"),
        "doc_range_seek": _sql(f"SELECT term, doc_id FROM p WHERE term IN ({terms}) AND doc_id >= 100"),
        "result_with_text": _sql("SELECT qid, rank, CAST(doc_id AS VARCHAR) AS ext_id, text AS body FROM top JOIN docs USING (doc_id) WHERE rank <= 3"),
        "result_json": _sql("""SELECT qid, '{"results":[' || string_agg('{"rank":' || rank || ',"id":"' || doc_id || '"}', ',' ORDER BY rank) || ']}' AS response FROM top WHERE rank <= 5 GROUP BY qid"""),
        "judged_only": _ALL,
        "first_n_queries": "SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark ORDER BY 1 LIMIT 10",
        "trec_run": _sql("SELECT qid, rank, concat_ws(' ', qid, 'Q0', CAST(doc_id AS VARCHAR), CAST(rank AS VARCHAR), printf('%.6f', round(score, 6)), 'bm25') AS line FROM top WHERE rank <= 10", _JUDGED),
        "trec_eval_rank": ev("SELECT qid, ext_id, CAST(rank AS INTEGER) AS rank FROM run", 100),
        "eval_summary": ev("SELECT count(*) AS queries, round(avg(ndcg10), 6) AS ndcg10, round(avg(recall100), 6) AS recall100, round(avg(recall1000), 6) AS recall1000, round(avg(mrr10), 6) AS mrr10 FROM m"),
        "latency_percentiles": "SELECT count(*) AS queries, round(avg(ns) / 1e6, 6) AS mean_ms, quantile_disc(ns, 0.5) / 1e6 AS p50_ms, quantile_disc(ns, 0.95) / 1e6 AS p95_ms, quantile_disc(ns, 0.99) / 1e6 AS p99_ms FROM (SELECT CAST(floor(value * 1000) AS BIGINT) AS ns FROM events)",
        "pivot_terms": _sql("SELECT qid, term, round(sum(bound) OVER (PARTITION BY qid ORDER BY bound DESC, term ROWS UNBOUNDED PRECEDING), 6) AS running FROM (SELECT qid, term, n * m AS bound FROM qt JOIN (SELECT term, max(impact) AS m FROM p GROUP BY term) USING (term))"),
        "index_merge": _sql("SELECT term, doc_id, round(impact, 6) AS impact FROM p"),
        "index_check": "SELECT CAST(NULL AS VARCHAR) AS problem WHERE false",
    }
    return out | {m: ev(f"SELECT qid, round({m}, 6) AS {m} FROM m") for m in METRICS}
