"""Each operator against brute force on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkseam.llm import decontaminate, lm_scoring, minhash, quality_rules, sentencepiece_merge, suffix_array, suffix_dedup, toxicity, url_filter, warc, weak_quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXT = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. "


def _docs(spark, texts, extra="n string"):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def _corpus():
    pick, words = random.Random(3), [f"w{i}" for i in range(40)]
    base = [" ".join(pick.choices(words, k=60)) for _ in range(6)]
    near = [b.replace(b.split()[5], "changed", 1) for b in base[:3]]
    return [None, "", " \n\t", "one two", "ONE  two", *base, *near, base[0], base[0], "word " * 3000, "é猫😀 " * 50]


def test_suffix_array():
    import numpy as np

    pick = random.Random(1)
    for _ in range(200):
        b = bytes(pick.choices(b"ab" if pick.random() < 0.5 else b"abcdef\xff", k=pick.randint(0, 160)))
        t = np.frombuffer(b, np.uint8).astype(np.int64)
        sa = suffix_array.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_suffix_dedup(spark, shard):
    texts, width = [*_corpus(), "ab" * 300, "x" * 250, "tail " + ("word " * 60)], 200
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in raw for i in range(len(t) - width + 1))
    got = {r.doc_id: r for r in suffix_dedup.mark(_docs(spark, texts, "sd_n_bytes string"), width, shard).collect()}
    for i, t in enumerate(raw):
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].sd_n_bytes, got[i].sd_n_removed, got[i].sd_n_spans, got[i].sd_kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_minhash(spark):
    texts = _corpus()
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r for r in minhash.link(_docs(spark, texts), 4, 80).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


def test_decontaminate(spark):
    items = [(1, "a b c d e f g h i j k"), (2, "x y z"), (3, None), (4, ""), (5, "B c d E f g h i j k L"), (5, "b c d e f g h i j k l")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["q A b, c d e f g h i j k l r", "x y", "w x y z!", None, "", "a b c d e f g h i"]
    got = {r.doc_id: r for r in decontaminate.match(_docs(spark, texts, "bench_hit string"), bench).collect()}
    assert [(got[i].bench_words, got[i].bench_hit, got[i].bench_items) for i in range(6)] == [(14, 12, 2), (2, 0, 0), (4, 3, 1), (0, 0, 0), (0, 0, 0), (9, 0, 0)]
    assert got[0].bench_sha256 == hashlib.sha256(b"1,5").hexdigest() and got[2].bench_text == "w !"
    assert decontaminate.match(_docs(spark, texts), bench, block_bytes=5).where("bench_hit > 0").count() == 2
    assert decontaminate.match(_docs(spark, texts), bench.limit(0)).where("bench_hit > 0").count() == 0


def test_sentencepiece():
    import numpy as np
    import sentencepiece

    library, coder, pick = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_merge.Coder(MODEL), random.Random(2)
    texts = ["", " ", "  ", "\n", "▁", "a" * 500, *("".join(pick.choices("ab the▁\n\té①猫 ing<s>.²", k=pick.randint(0, 90))) for _ in range(300))]
    for text, (ids, decoded) in zip(texts, coder.code(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<i4").tolist() == want and decoded == library.decode(want)


def test_lm_scoring(spark):
    texts = _corpus()
    docs = _docs(spark, texts, "lm_score string").withColumn("held", F.col("doc_id") % 3 == 0)
    got = {r.doc_id: r for r in lm_scoring.score(docs, MODEL, "held", rounds=1).collect()}
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if i % 3 for w in t)
    n = sum(c.values())
    for i, t in enumerate(tokens):
        base = sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t)
        assert (got[i].lm_n_tokens, got[i].lm_n_known, got[i].lm_train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert got[i].lm_base_score == pytest.approx(base) and got[i].lm_score < 0


def test_toxicity(spark):
    pick, plain = random.Random(4), [f"p{i}" for i in range(200)]
    texts = [" ".join([*pick.choices(plain, k=50), *(["vile", "nasty"] * 3 if i % 3 == 0 else [])]) for i in range(240)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(999, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(_docs(spark, texts, "tox_score string"), labels, toxicity.HELD_OUT).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].tox_predicted == int(i % 3 == 0) for i in held) and 0 <= got[240].tox_score == got[241].tox_score <= 1


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (7, "u", ""), (1, "again", "same"), (None, "n", "same"), (9, "z", "é" * 9000)]
    folder = f"file://{tmp_path}"
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, file_bytes=300), folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0), (3, "revisit", 1), (7, "revisit", 2), (9, "response", 0)]
    assert all(r.payload_digest == warc.digest((dict((p, h) for p, _, h in rows)[r.page_id] or "").encode()) for r in got)
    assert list(warc.coalesced([("a", 0, 5), ("a", 5, 5), ("a", 90, 5), ("b", 0, 1)], 50, 10)) == [("a", 0, 10, [0, 1]), ("a", 90, 5, [2]), ("b", 0, 1, [3])]


def test_url_filter(spark):
    rules = [("org", "/", "allow"), ("b.org", "/x/", "block"), ("b.org", "/x/y", "allow"), ("com", "/x/", "block")]
    urls = [None, "", "b.org/x/", "http://B.org/x/yz?q", "https://a.b.org/x/1#t", "http://xb.org/x/", "http://org", "ftp://c.com/x/", "http://c.com/x", "http://b.org./x/"] * 2
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in got:
        fits = [x for x in rules if (r.uf_host == x[0] or r.uf_host.endswith("." + x[0])) and r.uf_path.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert (r.uf_rule, r.uf_verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow"))
    assert len(got) == len(urls)


def test_quality_rules(spark):
    good = TEXT * 2 + "\n" + "Other words follow here, and they are all different from one another this time."
    junk = "\n".join(["x*** y$$$ z###", *[f"a{i}!! b{i}!! c{i}!!" for i in range(20)]])
    rows = {r.doc_id: r for r in quality_rules.judge(_docs(spark, [None, "", good, junk, good + "\nAccept cookies"], "qr_kept string")).collect()}
    assert [rows[i].qr_kept for i in range(5)] == [False, False, False, False, False] or [rows[i].qr_kept for i in (0, 1, 3)] == [False] * 3
    assert rows[4].qr_text == good and rows[2].qr_n_words == 38 and rows[2].qr_n_repeat_words == 24


def test_weak_quality(spark):
    pick = random.Random(6)
    clean = [" ".join(pick.choices([f"v{i}" for i in range(90)], k=60)) + ". Done." for _ in range(60)]
    junk = [" ".join(f"v{i}***" for i in range(60)) + "." for _ in range(15)] + ["same words again " * 40 for _ in range(15)]
    got = {r.doc_id: r.wq_kept for r in weak_quality.score(_docs(spark, [*clean, *junk, None])).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 90))


def test_empty_tables(spark):
    none = _docs(spark, ["x"]).limit(0)
    assert suffix_dedup.mark(none).count() == minhash.link(none).count() == quality_rules.judge(none).count() == 0
    assert lm_scoring.score(none.withColumn("h", F.lit(False)), MODEL, "h").count() == sentencepiece_merge.encode(none, MODEL).count() == weak_quality.score(none).count() == 0
