"""Terms of whole texts come from one pass without a shuffle, by the same rules as the SQL expressions."""

import random

from pyspark.sql import functions as F

from inkseam import queries
from inkseam.functions import analysis


def test_stems_equal_sql(spark):
    pick, ends = random.Random(3), [*analysis.SECOND, *analysis.THIRD, *analysis.FOURTH, "s", "sses", "ies", "eed", "ed", "ing", "y", "ll", "ääed", "yying", "e", "bled", "ated", ""]
    words = {"".join(pick.choices("aeiouybdlstzwxéß1", k=pick.randint(0, 6))) + pick.choice(ends) + pick.choice(["", "", *ends]) for _ in range(20000)} - {""}
    rows = analysis.with_stems(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()
    stem = analysis.stemmer()
    assert {r.word: r.term for r in rows} == {w: stem(w) for w in words}


def test_terms_equal_words(spark):
    texts = ["Ponies' pony's The O'NEIL’S ___ İstanbul ΣΑΣ", "中文 running ひらがな cats", "א\"ב hopping ב'א'", "x" * 300 + " cats", "áb.c­d foo_bar 1,000.5 ©️ x​y", "", None, "e.g. a:b 10:30 don't 3.5 a.1 _a_ 1;2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    got = {r.doc_id: r.terms for r in analysis.with_terms(df).collect()}
    assert got == {r.doc_id: r.terms for r in analysis.stemmed(analysis.with_words(df).drop("body")).collect()}
    plain = df.select("doc_id", F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(analysis.TOKEN), F.lit(0)).alias("t"))
    tokens = lambda d: {r.doc_id: r.t for r in d.collect()}
    assert tokens(df.select("doc_id", analysis.tokenize("body").alias("t"))) == tokens(plain.select("doc_id", F.filter("t", lambda t: F.regexp_like(t, F.lit(analysis._BASE))).alias("t")))
    counts = {r.doc_id: (r.dl, dict(zip(r.terms, r.tfs))) for r in analysis.with_terms(df, counted=True).collect()}
    assert counts == {i: (len(t), {x: t.count(x) for x in t}) for i, t in got.items()}


def test_analyze_has_no_shuffle(spark):
    plan = queries.analyze(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
