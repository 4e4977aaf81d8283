"""The whole pipeline against plain Python, stage by stage."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def _quality(t):
    """The text without failing lines, or None if it is rejected."""
    from inkseam.llm import quality_rules as q

    words = _words(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = t.split("\n")

    def bad(line):
        n = len(line)
        if not _words(line):
            return False
        signs = sum(line.count(c) for c in q.SYMBOLS)
        fragment = len(_words(line)) <= 3 and line.rstrip(SPACE)[-1] not in ".!?:;,…。！？”»\"')]"
        return (
            10 * signs > n or 20 * line.count("!!") > n or sum(line.count(c) for c in q.SEPARATORS) >= 3 or fragment
            or any(x in line.lower() for x in q.BOILERPLATE) or n > 200 and not any(c in line for c in ".!?,;:…。、，")
        )

    total, lost = sum(len(x) for x in lines if _words(x)), sum(len(x) for x in lines if bad(x))
    if len(words) < 20 or 100 * len(again) > 30 * len(words) or 100 * lost > 50 * total:
        return None
    return "\n".join(x for x in lines if not bad(x))


def _near(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := t.encode().lower().split()) else set() for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if find(i) == i}


def _repeats(docs):
    raw = {i: t.encode() for i, t in docs.items()}
    seen = Counter(hash(b[k : k + 200]) for b in raw.values() for k in range(len(b) - 199))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = True
        if not len(b) or not gone.all():
            out[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "replace")
    return out


def _leaks(docs, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    windows = {tuple(w[k : k + min(10, len(w))]) for t in items if (w := cut.findall(fold(t))) for k in range(len(w) - min(10, len(w)) + 1)}
    sizes, out = {len(w) for w in windows}, {}
    for i, t in docs.items():
        at = [(m.group(), *m.span()) for m in cut.finditer(fold(t))]
        hit = sorted({p for n in sizes for k in range(len(at) - n + 1) if tuple(x[0] for x in at[k : k + n]) in windows for p in range(k, k + n)})
        if len(hit) > 0.5 * len(at):
            continue
        spans = [[p, p] for p in hit[:1]]
        for p in hit[1:]:
            if p == spans[-1][1] + 1:
                spans[-1][1] = p
            else:
                spans.append([p, p])
        for a, b in reversed(spans):
            t = t[: at[a][1]] + t[at[b][2] :]
        out[i] = t
    return out


def test_run(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    kept = {i: q for i, t in docs.items() if (q := _quality(t or "")) is not None}
    near = _near(kept)
    assert len(near) < len(kept) < len(docs)
    left = _leaks(_repeats(near), items)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t, add_bos=True, add_eos=True) for i, t in left.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(want[i], "<u4").tobytes()).hexdigest() for i, r in got.items())
    assert any(left[i] != kept[i] for i in left)


def test_stages_keep_rows_without_text(spark, tmp_path):
    """Nulls and empties: rejected by quality, kept by the later stages; an empty table goes through."""
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, None, "en", "s", 0, "m"), (2, "", "en", "s", 0, "m"), (2, "", "en", "s", 0, "m")], "doc_id long, text string, lang string, source string, n_chars long, row string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, docs, f"file://{tmp_path}").collect()
        assert len(rows) == (3 if k else 0)
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
