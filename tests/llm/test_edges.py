"""Every operator with nulls, empty and very long texts, repeats and ties, an empty table, and columns named like its own helpers."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkseam.llm import decontaminate, lm_scoring, minhash, quality_rules, sentencepiece_merge, suffix_dedup, toxicity, url_filter, warc, weak_quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHES = [
    *("row", "key", "spans", "hash", "post", "set", "sig", "i", "o", "a", "b", "f", "k", "n", "lo", "label", "size", "toxic", "item_id", "word", "tf", "c", "held"),
    *("sd_row", "sd_spans", "sd_hash", "lm_row", "lm_key", "lm_got", "lm_hash", "mh_id", "qr_w", "qr_t", "qr_row", "qr_note", "uf_row", "uf_best", "uf_note", "dc_row", "dc_found", "bench_note", "wq_id", "wr_key", "wr_first"),
]
LONG = "".join(f"Sentence {i} of the long text goes on. " for i in range(28_000))
TEXTS = [None, "", " \n\t ", "a", LONG, LONG, "x" * 20_000, "same words here again", "same words here again", "É猫😀 ok. " * 30]


def _held(c):
    return F.crc32(F.col(c).cast("string").cast("binary")) % 7 == 2


def _benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"Sentence {i} of the long text goes on." for i in range(5, 7))), (None, "same words here again"), (3, None)], "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")


OPERATORS = {
    "lm_scoring": lambda s, d: lm_scoring.score(d.withColumn("out", _held("doc_id")), MODEL, "out").drop("out"),
    "suffix_dedup": lambda s, d: suffix_dedup.mark(d),
    "toxicity": lambda s, d: toxicity.score(d, _labels(s), "{0} = 3"),
    "sentencepiece_merge": lambda s, d: sentencepiece_merge.encode(d, MODEL),
    "weak_quality": lambda s, d: weak_quality.score(d),
    "quality_rules": lambda s, d: quality_rules.judge(d),
    "minhash": lambda s, d: minhash.deduplicate(d),
    "decontaminate": lambda s, d: decontaminate.match(d, _benchmark(s)),
    "decontaminate_shards": lambda s, d: decontaminate.match(d, _benchmark(s), block_bytes=40),
    "url_filter": lambda s, d: url_filter.judge(d.withColumn("url", F.concat(F.lit("http://"), F.repeat(F.lit("a."), 3000), F.lit("example.org/es/"), F.substring("text", 1, 5))), url_filter.RULES).drop("url"),
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('edges')}/documents"
    rows = [(i, t, *(["mine"] * len(CLASHES))) for i, t in enumerate(TEXTS)]
    rows += [(8, TEXTS[8], *(["mine"] * len(CLASHES))), (None, "same words here again", *(["mine"] * len(CLASHES)))]
    spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHES)])).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in CLASHES)
    if name == "minhash":
        # copies go, and rows without words stay
        assert sorted((r.doc_id for r in rows if r.doc_id is not None)) == [0, 1, 2, 3, 4, 6, 7, 9] and len(rows) == 8
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(["None", "8", *map(str, range(10))])
        made = [c for c in out.columns if c not in docs.columns]
        of = {}
        for r in rows:
            if name not in ("lm_scoring", "toxicity") or r.doc_id is not None:
                of.setdefault(zlib.crc32(repr(r.text).encode()), set()).add(repr([r[c] for c in made]))
        assert made and all(len(x) == 1 for x in of.values())  # equal texts, equal results
        assert OPERATORS[name](spark, docs.limit(0)).collect() == []


def test_string_ids_of_toxicity(spark):
    docs = spark.createDataFrame([(f"d{i}", "vile words" if i % 2 else "kind words") for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, toxic int")
    assert toxicity.score(docs, labels, "{0} = 'd1'").count() == 40


def test_warc_edges(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", LONG, "x"), (3, "u", LONG, "x")], "page_id long, url string, html string, wr_first string")
    folder = f"file://{tmp_path}/a"
    got = {r.page_id: r for r in warc.read(warc.write(pages, folder), folder).collect()}
    assert got[2].payload.decode() == LONG and (got[3].record_type, got[3].refers_to) == ("revisit", 2) and got[1].payload_bytes == 0
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0


def test_empty_pages_of_url_filter(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), []).first().uf_verdict == url_filter.DEFAULT


def test_many_near_copies(spark):
    """A large group of near copies, many of them too far apart to link, against all pairs."""
    import random

    pick, words = random.Random(11), [f"w{i}" for i in range(60)]
    base = pick.choices(words, k=120)
    texts = []
    for i in range(700):
        edited = base[: pick.choice((120, 120, 110, 95))]
        for _ in range(pick.choice((0, 1, 2, 3, 4, 5, 6))):
            edited[pick.randrange(len(edited))] = pick.choice(words) if i % 3 else f"own{i}x{pick.random()}"
        texts.append(" ".join(edited))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 180 * both >= 80 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.link(docs, 4, 80).collect()}
    want = [find(i) for i in range(len(texts))]
    assert len(set(want)) > 20 and [got[i] for i in range(len(texts))] == want
