"""Queries over judgments take every benchmark item."""

import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import Row

from inkseam import queries
from inkseam.operators import evaluate

SF = "/root/testdata/sf0.001"


def test_every_item_is_evaluated(spark):
    sql = lambda x: duckdb.sql(x.replace("TABLES", SF)).fetchall()
    ids = {q for (q,) in sql("SELECT CAST(item_id AS VARCHAR) FROM 'TABLES/benchmark.parquet'")}
    grade = dict(sql("SELECT CAST(doc_id AS VARCHAR), quality FROM 'TABLES/labels.parquet'"))
    assert len(ids) > 10
    assert {r.qid for r in queries.judged_only(spark, SF).collect()} == ids
    run = defaultdict(list)
    for r in queries._run(spark, SF).collect():
        run[r.qid].append((r.score, r.ext_id))
    best = sorted((g for g in grade.values() if g >= 1), reverse=True)
    ideal = sum(g / math.log2(i + 2) for i, g in enumerate(best[:10]))
    want = {}
    for q in ids:
        got = [grade.get(d, 0) for _, d in sorted(run[q], reverse=True)]
        first = next((i for i, g in enumerate(got[:10], 1) if g >= 1), None)
        dcg = sum(g / math.log2(i + 2) for i, g in enumerate(got[:10]) if g >= 1)
        want[q] = (dcg / ideal, sum(g >= 1 for g in got[:100]) / len(best), sum(g >= 1 for g in got[:1000]) / len(best), 1 / first if first else 0)
    for i, name in enumerate(queries.METRICS):
        rows = {r.qid: r[name] for r in queries._metric(spark, SF, name).collect()}
        assert rows == pytest.approx({q: w[i] for q, w in want.items()}, abs=1e-6)
    total = queries.eval_summary(spark, SF).first()
    assert tuple(total) == pytest.approx((len(ids), *(sum(w[i] for w in want.values()) / len(ids) for i in range(4))), abs=1e-6)
    assert {r.qid for r in queries.trec_run(spark, SF).collect()} == {q for q in ids if run[q]}
    assert {r.qid for r in queries.trec_eval_rank(spark, SF).collect()} == {q for q in ids if run[q]}


def test_shared_judgments_equal_judgments_of_each_query(spark):
    run = spark.createDataFrame([Row(qid=q, ext_id=f"d{i}", score=float((i * k) % 7)) for k, q in enumerate(("a", "b"), 2) for i in range(9)])
    one = spark.createDataFrame([(f"d{i}", i % 3) for i in range(0, 30, 2)], "ext_id string, grade int")
    ids = spark.createDataFrame([("a",), ("b",), ("none",)], "qid string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(evaluate.per_query(run, one, queries=ids)) == rows(evaluate.per_query(run, ids.crossJoin(one)))
    assert rows(evaluate.per_query(run, one.limit(0), queries=ids)) == []
