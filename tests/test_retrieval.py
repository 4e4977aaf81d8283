import random

import pytest

from inkseam.functions import analysis
from inkseam.operators import evaluate, index
from inkseam.plans import retrieval
from inkseam.sources import corpus


def _index(spark, texts, tile=4):
    return index.invert(spark.createDataFrame([(i, str(i), t.split()) for i, t in enumerate(texts)], "doc_id long, ext_id string, words array<string>"), tile=tile)


def _search(spark, ix, terms, k, algorithm):
    rows = spark.createDataFrame(terms, "qid string, term string, n long")
    return sorted((r.qid, r.rank, r.doc_id, r.score) for r in retrieval.search(ix, rows, k, algorithm).collect())


def test_known_scores(spark):
    ix = _index(spark, ["the quick brown fox", "the lazy dog", "quick quick dog"])
    got = _search(spark, ix, [("q", "quick", 1), ("q", "dog", 1)], 10, "exhaustive")
    assert [r[2] for r in got] == [2, 1, 0]
    assert [r[3] for r in got] == pytest.approx([0.5803626947, 0.2521478698, 0.2383385544])
    assert index.check(ix) == []


def test_pruned_equals_exhaustive(spark):
    words, pick = [f"w{i}" for i in range(20)], random.Random(5)
    texts = []
    for i in range(60):
        texts.append(texts[-1] if i % 5 == 4 else " ".join(pick.choices(words, [1 / (j + 1) for j in range(20)], k=pick.randint(1, 12))))
    ix = _index(spark, [*texts, *["w0 w1"] * 12])
    terms = [(f"q{i}", w, 1 + i % 2) for i in range(6) for w in pick.sample([*words, "none"], 3)]
    for k in (1, 3, 100):
        full = _search(spark, ix, terms, k, "exhaustive")
        assert _search(spark, ix, terms, k, "wand") == full
        assert _search(spark, ix, terms, k, "bmw") == full
    assert _search(spark, ix, terms, 0, "bmw") == []


def test_save_open_refuse(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", "Red fish\nA red fish swims."), (1, "b", ""), (2, "c", "Cars")], "doc_id long, ext_id string, body string")
    ix = index.build(docs, store_text=True)
    path = f"file://{tmp_path}/ix"
    index.save(ix, path)
    again = index.open_index(spark, path)
    assert index.check(again) == [] and again.meta["n_docs"] == 3 and again.texts.count() == 3
    with pytest.raises(FileExistsError):
        index.save(ix, path)
    assert [r.ext_id for r in retrieval.search_text(again, "FISH!").collect()] == ["a"]


@pytest.mark.parametrize(("text", "want"), [("O'Neil's can't U.S.A. 1,000 foo_bar ___", ["O'Neil's", "can't", "U.S.A", "1,000", "foo_bar"]), ("א\"ב b'א'", ["א\"ב", "b'א"]), ("©️ x", ["©️", "x"]), ("a" * 300, ["a" * 255, "a" * 45]), ("", [])])
def test_scanner(text, want):
    assert analysis.scan(text) == want


def test_scanner_equals_expression(spark):
    texts = ["well-known 3.5 a.1 e.g. x² café ﬁ", "中文 日本語 カタカナ ひらがな", "a:b 10:30 don’t ‘q’", "foo©bar ™"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.w for r in df.select(analysis.tokenize(df.t).alias("w")).collect()] == [analysis.scan(t) for t in texts]


def test_stems(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "hoping": "hope", "happy": "happi", "relational": "relat", "adoption": "adopt", "lion": "lion", "controll": "control", "is": "is", "yyying": "yyi", "conflated": "conflat", "sky": "sky"}
    pairs.pop("yyying")
    got = {r.word: r.term for r in analysis.with_stems(spark.createDataFrame([(w,) for w in pairs], "word string")).collect()}
    assert got == pairs


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 1), ("q", "z", 0), ("none", "a", 1)], "qid string, ext_id string, grade int")
    run = spark.createDataFrame([("q", "x", 3.0), ("q", "a", 2.0), ("q", "b", 1.0), ("other", "a", 1.0)], "qid string, ext_id string, score double")
    got = {r.qid: r for r in evaluate.per_query(run, qrels, ndcg_at=3, recall_at=(3,), mrr_at=3).collect()}
    assert set(got) == {"q", "none"}
    assert (got["q"].ndcg3, got["q"].recall3, got["q"].mrr3) == pytest.approx((0.5627272554, 2 / 3, 0.5))
    assert got["none"].ndcg3 == 0
    tied = spark.createDataFrame([("q", d, 1.0) for d in ("d1", "d10", "d2", "d3")], "qid string, ext_id string, score double")
    assert [r.ext_id for r in evaluate.ranked(tied).orderBy("rank").collect()] == ["d3", "d2", "d10", "d1"]


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "x", "title": "T", "text": "b"} {"_id": "y"}\n')
    assert [tuple(r) for r in corpus.read_corpus(spark, str(tmp_path / "c.jsonl")).orderBy("doc_id").collect()] == [(0, "x", "T\nb"), (1, "y", "")]
    (tmp_path / "c.TSV").write_text("a\tx\ty\r\n\nb\tz\n")
    assert [tuple(r) for r in corpus.read_corpus(spark, str(tmp_path / "c.TSV")).orderBy("doc_id").collect()] == [(0, "a", "x\ty"), (1, "b", "z")]
    (tmp_path / "q.tsv").write_text("1\told\n1\tnew\n")
    assert [tuple(r) for r in corpus.read_queries(spark, str(tmp_path / "q.tsv")).collect()] == [("1", "new")]
    (tmp_path / "j.txt").write_text("q 0 d 1\nq 0 d 2\n\n")
    assert [tuple(r) for r in corpus.read_qrels(spark, str(tmp_path / "j.txt")).collect()] == [("q", "d", 2)]
    for name, text, read in (("b.jsonl", '{"_id": 4}', corpus.read_corpus), ("b.tsv", "no tab\n", corpus.read_corpus), ("r.txt", "q Q0 d 1 1e999 t\n", corpus.read_run)):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="record 1|line 1"):
            read(spark, str(tmp_path / name)).collect()
    assert corpus.parse_size("16kb") == 16384
    with pytest.raises(ValueError, match="size"):
        corpus.parse_size("0")
