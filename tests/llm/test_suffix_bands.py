"""op2: contexts that share a phrase only are left alone, and rows stay exact where phrases, periods and copies meet."""

import hashlib
import random
from collections import Counter

import pytest

from inkseam.llm import suffix_dedup

WIDTH = 200
PHRASE = "this very frequent phrase stands in all of the documents, with other words before it and with other words after it"


def _texts(n, seed):
    pick = random.Random(seed)
    return [" ".join([pick.randbytes(90).hex(), PHRASE, pick.randbytes(90).hex()]) for _ in range(n)]


def _odd():
    pick, plain = random.Random(5), _texts(12, 7)
    edited = [t[:k] + "#" + t[k + 1 :] for t in plain[:4] for k in (100, 190, 225, 300)]
    lines = ["-" * 90 + f" cell {i} | " + "-" * 130 + pick.randbytes(60).hex() for i in range(6)]
    mixed = [pick.randbytes(40).hex() + "=" * pick.choice([30, 199, 200, 201, 700]) + pick.randbytes(90).hex() + "ab" * pick.choice([40, 110, 300]) for _ in range(8)]
    cut = [t[20:-15] + mixed[0][30:280] for t in plain[4:8]]
    few = ["".join(pick.choices("ab", k=60)) + "".join(pick.choices(["abaab" * 50, "ba" * 110, "b" * 210], k=3)) for _ in range(6)]
    return [None, "", *plain, *edited, *lines, *mixed, *cut, *few, lines[0], mixed[1], "é猫" * 70, "é猫" * 71]


def _expected(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + WIDTH] for t in raw for i in range(len(t) - WIDTH + 1))
    for t in raw:
        gone = [False] * len(t)
        for k in range(len(t) - WIDTH + 1):
            if seen[t[k : k + WIDTH]] > 1:
                gone[k : k + WIDTH] = [True] * WIDTH
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("shard", [1 << 20, 2000, 300])
def test_odd_texts(spark, shard):
    texts = _odd()
    got = {r.doc_id: r for r in suffix_dedup.mark(_docs(spark, texts), WIDTH, shard).collect()}
    assert [(r.sd_n_bytes, r.sd_n_removed, r.sd_n_spans, r.sd_kept_sha256) for r in (got[i] for i in range(len(texts)))] == list(_expected(texts))


def test_a_shared_phrase_needs_no_comparison(spark, monkeypatch):
    """The key of a frequent phrase holds contexts of all documents; none of them shares 200 bytes with another."""
    compared, counted = [], []
    sharded, by_window = suffix_dedup._sharded, suffix_dedup._counted
    monkeypatch.setattr(suffix_dedup, "_sharded", lambda asked, *rest: compared.append(asked.count()) or sharded(asked, *rest))
    monkeypatch.setattr(suffix_dedup, "_counted", lambda asked, *rest: counted.append(asked.count()) or by_window(asked, *rest))
    out = suffix_dedup.mark(_docs(spark, _texts(40, 1)), WIDTH, 2000).agg({"sd_n_removed": "sum"}).first()[0]
    assert (out, compared, counted) == (0, [0], [])


def test_shards_hold_whole_keys():
    pick = random.Random(2)
    given = [(k, i, b"x" * pick.randint(200, 376)) for k in range(400) for i in range(pick.randint(1, 30))]
    made = list(suffix_dedup.shards(iter(given), 20_000))
    assert [x for held in made for x in held] == given
    assert sum(len({x[0] for x in held}) for held in made) == 400
    for held in made[:-1]:
        last = [x for x in held if x[0] == held[-1][0]]
        size = sum(len(x[-1]) + 1 for x in held)
        assert size >= 20_000 > size - sum(len(x[-1]) + 1 for x in last)
    assert suffix_dedup.ARRAY_BYTES < suffix_dedup.SHARD_BYTES and list(suffix_dedup.shards(iter([]), 5)) == []
