"""An index is one row a document; its tables follow with one shuffle of postings, by term."""

from inkseam import queries
from inkseam.operators import index

SF = "/root/testdata/sf0.001"


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shuffles(spark):
    queries._index(spark, SF)
    assert _shuffles(queries.gap_decode(spark, SF)) == 1
    # postings, and the terms' numbers of documents, which are counted before they are shuffled
    assert _shuffles(queries.block_max(spark, SF)) == 2
    assert _shuffles(queries.index_merge(spark, SF)) <= 2


def test_check_finds_faults(spark):
    words = spark.createDataFrame([(i, str(i), t.split()) for i, t in enumerate(["red fish", "blue fish fish", ""])], "doc_id long, ext_id string, words array<string>")
    ix = index.invert(words)
    made = lambda postings=None, terms=None, tiles=None, docs=None: index.check(index.Index(postings or ix.postings, docs or ix.docs, terms or ix.terms, tiles or ix.tiles, ix.meta))
    assert made() == []
    assert made(tiles=ix.tiles.where("term <> 'fish'")) == ["tiles: maxima differ from the postings"]
    assert made(terms=ix.terms.where("term <> 'fish'")) == ["terms: df or max_score differ from the postings"]
    assert made(terms=ix.terms.union(ix.terms.where("term = 'red'"))) == ["terms: repeated, or df out of range"]
    assert made(docs=ix.docs.where("doc_id <> 1")) == ["docs: count, ids or lengths differ from meta", "postings: unknown document"]
    assert made(postings=ix.postings.selectExpr("term", "doc_id", "IF(term = 'red', 0, tf) AS tf", "dl", "impact")) == ["postings: counts don't add up to the total length", "postings: bad count or impact"]
    twice = made(postings=ix.postings.union(ix.postings.where("term = 'red'")))
    assert "postings: a pair stands twice" in twice and "terms: df or max_score differ from the postings" in twice
