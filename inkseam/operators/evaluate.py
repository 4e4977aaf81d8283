"""Retrieval metrics over (qid, ext_id, score) runs and (qid, ext_id, grade) judgments, with evaluation's own tie rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEVANT = 1


def ranked(run: DataFrame) -> DataFrame:
    """run with its evaluation rank: score falling, then document id falling as text."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("ext_id"))
    return run.withColumn("rank", F.row_number().over(order))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, rank, grade) of ranked documents with a judgment; judgments without qid hold for every query."""
    return ranked(run).join(qrels, [c for c in ("qid", "ext_id") if c in qrels.columns]).select("qid", "rank", "grade")


def per_query(run: DataFrame, qrels: DataFrame, ndcg_at: int = 10, recall_at: tuple[int, ...] = (100, 1000), mrr_at: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """One row for each judged query: ndcg, recalls and reciprocal rank; 0 where nothing is found or nothing is relevant.

    Judgments (ext_id, grade) without qid hold for each of queries (qid); their ideal is then counted once.
    """
    gain = F.when((F.col("grade") >= RELEVANT) & (F.col("rank") <= ndcg_at), F.col("grade") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    # added in rank order, so that sums don't depend on the plan
    gains = F.aggregate(F.array_sort(F.collect_list(F.when(F.col("rank") <= ndcg_at, F.struct("rank", gain.alias("x"))))), F.lit(0.0), lambda a, p: a + p.x)
    relevant = F.count_if(F.col("grade") >= RELEVANT).alias("relevant")
    if queries is None:
        best = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "ext_id")))
        ideal = best.groupBy("qid").agg(gains.alias("ideal"), relevant)
    else:
        # ndcg_at rows at most are ranked
        best = qrels.orderBy(F.desc("grade"), "ext_id").limit(ndcg_at).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("grade"), "ext_id")))
        once = best.agg(gains.alias("ideal")).crossJoin(qrels.agg(relevant, F.count("*").alias("n"))).where("n > 0").drop("n")
        ideal = queries.select("qid").distinct().crossJoin(F.broadcast(once))
    got = judged(run, qrels).groupBy("qid").agg(
        gains.alias("gained"),
        *[F.count_if((F.col("grade") >= RELEVANT) & (F.col("rank") <= k)).alias(f"hits{k}") for k in recall_at],
        F.min(F.when((F.col("grade") >= RELEVANT) & (F.col("rank") <= mrr_at), F.col("rank"))).alias("first"),
    )
    nothing = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "qid", "left").select(
        "qid",
        nothing(F.try_divide("gained", "ideal")).alias(f"ndcg{ndcg_at}"),
        *[nothing(F.try_divide(f"hits{k}", "relevant")).alias(f"recall{k}") for k in recall_at],
        nothing(F.lit(1.0) / F.col("first")).alias(f"mrr{mrr_at}"),
    )


def summary(run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row: number of judged queries and the mean of each metric over them."""
    rows = per_query(run, qrels, queries=queries)
    return rows.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in rows.columns[1:]])


def only_judged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The queries that have judgments; a judged id that isn't among them is an error."""
    ids = qrels.select("qid").distinct()
    missing = ids.join(queries, "qid", "left_anti").orderBy("qid").first()
    if missing:
        raise ValueError(f"judged query {missing.qid!r} is not among the queries")
    return queries.join(ids, "qid", "left_semi")


def latency_summary(latencies: DataFrame, ns: str = "ns", elapsed_ns: int = 0) -> DataFrame:
    """queries, qps, mean and nearest-rank percentiles in ms; zeros without rows."""
    at = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {ns})") / 1e6, F.lit(0.0))
    rate = F.count("*") / F.lit(elapsed_ns / 1e9) if elapsed_ns else F.lit(0.0)
    return latencies.agg(F.count("*").alias("queries"), rate.alias("qps"), F.coalesce(F.avg(ns) / 1e6, F.lit(0.0)).alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"))
