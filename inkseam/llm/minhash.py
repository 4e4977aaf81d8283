r"""MinHash near-duplicates by an inverted join of signature coordinates.

Documents with equal shingle sets form one class; everything after works on classes. A class posts itself under each of
its K (coordinate, value) pairs. Postings held by one class alone are dropped, those left are ordered by how many classes
hold them, and only a prefix is joined: two classes that collide T times must meet in the prefix of both, whatever the
order, and the rarest-first order keeps out what many unrelated documents share. A class without T shared postings is
skipped altogether.

A posting list isn't expanded into pairs. Each list has a leader, the class with the most collisions in the corpus, and
every other member is compared with it, full set against full set; linked classes unite, and lists within one component
are done. What is left are pairs of members x, y in different components. With the leader's set C known, widened by what
most members share, |x & y| <= min(|x & C|, |y & C|) + |(x & y) - C|; so a pair either has its overlap mostly in C and sizes
close to each other, or shares rare shingles outside of C. Members are posted anew under those shingles (again a prefix,
by the overlap a link still needs) and under their sizes, and these narrower lists go to the next round. Once the pairs
left in all lists are no more than the postings of the first round, they are compared one by one. Every pair that
collides T times is thus linked, proven too far apart, or within one component. The one thing left to chance is the
collisions: of two texts with similarity 0.8, fewer than T of K collide with a probability of 7.8e-7, and less above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkseam.llm.common import discard, row_key, standing_for, stored, text_bytes

#: Coordinates, and collisions asked for.
K, T = 48, 24
#: Sizes within this factor share a list.
STEP = 1.03
#: Word hashes remembered by a worker.
REMEMBERED = 500_000
_MULTIPLIERS = (np.random.default_rng(20240229).integers(1, 1 << 63, K, np.uint64) << np.uint64(1)) | np.uint64(1)
_OFFSETS = np.random.default_rng(20240301).integers(0, 1 << 63, K, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            from xxhash import xxh3_64_intdigest

            for w in words:
                if w not in known:
                    known[w] = xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        h = np.array(ids, np.uint64)
        size = min(self.width, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """K postings: for each coordinate its number and least value as one hash."""
    least = np.full(K, ~np.uint64(0))
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        mixed = part[None, :] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(axis=1))
    return _mix(least + np.arange(K, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, n, key, sig): set size, a 128-bit digest of the set and the postings; key and sig null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                n, keys, sigs = [], [], []
                for text in text_bytes(batch):
                    s = shingle(text)
                    n.append(len(s))
                    keys.append(_digest(s) if len(s) else None)
                    sigs.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "row", "n", "key", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("row")).mapInArrow(run, f"doc_id {kind}, row long, n long, key binary, sig array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, set) of the wanted classes (key, least), from a document with the class's least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                keys, sets = [], []
                for key, text in zip(batch.column("key").to_pylist(), text_bytes(batch)):
                    s = shingle(text)
                    if _digest(s) == key:  # else another text with the same id
                        keys.append(key)
                        sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "set"])

    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least")))
    return rows.select("key", "text").mapInArrow(run, "key binary, set array<long>").dropDuplicates(["key"])


def components(links: DataFrame) -> DataFrame:
    """(key, label) of the classes in links (a, b): the least key that can be reached; distributed, label by label."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "mh-edges")
    held = stored(edges.groupBy(F.col("a").alias("key")).agg(F.min(F.least("a", "b")).alias("new")), "mh-labels")
    while True:
        labels = held.select("key", F.col("new").alias("label"))
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        least = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("key").alias("new"), F.col("label").alias("further"))
        step = stored(least.join(jump, "new", "left").select("key", F.least("new", "further").alias("new"), "label"), "mh-labels")
        changed = step.where("new <> label").limit(1).count()
        discard(held)
        held = step
        if not changed:
            discard(edges)
            return standing_for(held, held.select("key", F.col("new").alias("label")))


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, f, ...) with the sizes na and nf of both sets, of their intersection, what a has beyond f, and whether they link."""
    full = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("key").alias("f"), F.col("set").alias("xf")), "f")
    out = full.select(*pairs.columns, F.size("xa").cast("long").alias("na"), F.size("xf").cast("long").alias("nf"), F.array_except("xa", "xf").alias("rest"))
    out = out.withColumn("both", F.col("na") - F.size("rest"))
    return out.withColumn("linked", F.expr(f"100 * both >= {percent} * (na + nf - both)"))


def _labelled(df: DataFrame, labels: DataFrame | None, on: str, name: str) -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(on))
    return df.join(labels.select(F.col("key").alias(on), F.col("label").alias(name)), on, "left").withColumn(name, F.coalesce(name, on))


def _open(lists: DataFrame) -> DataFrame:
    """(post, cross): the lists (post, la, side, ...) with pairs of different components on different sides (side 2 meets itself)."""
    of = lists.groupBy("post", "la").agg(*[F.count_if(F.col("side") == i).alias(f"n{i}") for i in range(3)])
    cross = F.expr("sum(n0) * sum(n1) - sum(n0 * n1) + (sum(n2) * sum(n2) - sum(n2 * n2)) DIV 2")
    return of.groupBy("post").agg(cross.alias("cross")).where("cross > 0")


def _narrowed(star: DataFrame, labels: DataFrame | None, percent: int) -> tuple[DataFrame, int]:
    """The lists (post, key, cent, la, n, core, side) in which pairs may still link, after all members met the leaders, and
    the number of such pairs.

    star: (f, a, cent, na, both, rest) of each member a and each leader f that it met. With `core` the part of a within the
    widened set of the leader, a link of x and y needs an overlap of total(x, y), of which min(core) at most lies inside.
    """

    def total(x: str, y: str) -> str:
        return f"(({percent} * ({x} + {y}) + {99 + percent}) DIV {100 + percent})"

    member = _labelled(_labelled(star, labels, "a", "la"), labels, "f", "lf")
    member = stored(member.select("f", "a", "cent", "na", "both", "la", (F.col("la") != F.col("lf")).alias("out"), "rest"), "mh-members")
    family = member.groupBy("f").agg(F.max("out").alias("several"), F.min("na").alias("least"), F.count("*").alias("m")).where("several").drop("several")
    family = stored(family, "mh-families")
    open_ = member.join(family, "f")
    beyond = stored(open_.select("f", "a", "la", F.explode("rest").alias("s")), "mh-beyond")
    # shingles beyond the leader that most members have widen its set; of the others only those of several components matter
    often = beyond.groupBy("f", "s").agg(F.count("*").alias("k"), F.min("la").alias("lo"), F.max("la").alias("hi")).where("k > 1").join(family, "f")
    often = stored(often.where("2 * k > m OR lo <> hi").select("f", "s", "k", F.expr("2 * k > m").alias("core")), "mh-often")
    shared = beyond.join(often, ["f", "s"]).groupBy("f", "a").agg(F.count_if("core").alias("wide"), F.collect_list(F.when(~F.col("core"), F.struct("k", "s"))).alias("rare"))
    at = open_.select("f", "a", "cent", F.col("na").alias("n"), "both", "la", "out", "least").join(shared, ["f", "a"], "left")
    at = at.withColumn("core", F.expr("both + coalesce(wide, 0)")).withColumn("lo", F.expr(f"greatest(({percent} * n + 99) DIV 100, least)"))
    at = at.withColumn("need", F.expr(f"{total('lo', 'n')} - core"))
    # the overlap outside is at least `need`: of that many rare shingles less one the last can't be the first to meet
    prefix = "slice(array_sort(coalesce(rare, array())), 1, greatest(size(coalesce(rare, array())) - greatest(need, 1) + 1, 0))"
    bucket = "CAST(floor(ln(greatest({}, 1)) / " + str(float(np.log(STEP))) + "D) AS BIGINT)"
    most = f"least(100 * n DIV {percent}, {100 + percent} * core DIV {percent} - n)"
    # both sides of a pair post under both their sizes, as far as their cores let them
    visits = f"CASE WHEN need > 0 OR {most} < lo THEN array() ELSE sequence({bucket.format('lo')}, {bucket.format(most)}) END"
    posts = f"concat(transform({prefix}, p -> struct(xxhash64(f, 0, p.s) AS post, 2 AS side)), transform({visits}, q -> struct(xxhash64(f, 1, least(own, q), greatest(own, q)) AS post, CASE WHEN own < q THEN 0 WHEN own > q THEN 1 ELSE 2 END AS side)))"
    lists = at.withColumn("own", F.expr(bucket.format("n"))).select("a", "cent", "la", "n", "core", F.explode(F.expr(posts)).alias("p"))
    found = stored(lists.select("p.post", F.col("a").alias("key"), "cent", "la", "n", "core", "p.side"), "mh-posted")
    open_ = stored(_open(found), "mh-open")
    out = stored(found.join(open_.select("post"), "post", "left_semi"), "mh-lists")
    left = int(open_.agg(F.sum("cross")).first()[0] or 0)
    discard(member, family, beyond, often, found, open_)
    return out, left


def _last_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, f) of different components that are left in lists: members outside a list's largest component with all."""
    largest = lists.groupBy("post", "la").agg(F.count("*").alias("k")).groupBy("post").agg(F.max_by("la", F.struct("k", "la")).alias("major"))
    side = lists.join(stored(largest, "mh-major"), "post")
    few = side.where("la <> major").select("post", F.col("key").alias("a"), F.col("la").alias("l1"), F.col("n").alias("n1"), F.col("core").alias("c1"), F.col("side").alias("s1"))
    every = side.select("post", F.col("key").alias("f"), F.col("la").alias("l2"), "major", F.col("n").alias("n2"), F.col("core").alias("c2"), F.col("side").alias("s2"))
    fits = f"100 * least(n1, n2) >= {percent} * greatest(n1, n2) AND (s1 = 2 OR s1 <> s2 AND {100 + percent} * least(c1, c2) >= {percent} * (n1 + n2))"
    return few.join(every, "post").where(f"l1 <> l2 AND (l2 = major OR a < f) AND {fits}").select("a", "f").distinct()


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Texts of fewer words than `width` are one shingle; null, empty and blank texts have no shingle, link with nothing and
    are kept. Equal rows are in one component; rows that repeat an id share what the id gets. Rows without id never are a
    component's least id, and are kept only if their component has none. Very long texts are one row of as many shingles
    as they have words, whole. An empty table gives an empty result; extra columns, whatever their names, are ignored.
    """
    return _link(docs, width, percent)[0]


def _link(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """link(), and the stored tables that its result reads."""
    wide = stored(sketches(docs, width), "mh-sketches")
    classes = stored(wide.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig")), "mh-classes")
    rows = stored(wide.drop("sig"), "mh-rows")
    discard(wide)
    posts = classes.select("key", F.explode("sig").alias("post"))
    often = posts.groupBy("post").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(often, "post").groupBy("key").agg(F.collect_list(F.struct("df", "post")).alias("posts"), F.sum("df").alias("cent")).where(F.size("posts") >= T)
    # unshared postings come first in the order and meet nothing
    lists = shared.select("key", "cent", F.explode(F.expr(f"slice(array_sort(posts), 1, size(posts) - {T} + 1)")).alias("p")).select(F.col("p.post").alias("post"), "key", "cent")
    lists = stored(lists, "mh-lists")
    first, sets, links, labels = lists.count(), None, None, None
    while True:
        leaders = stored(lists.groupBy("post").agg(F.max(F.struct("cent", "key")).alias("top"), F.count("*").alias("k")).where("k > 1").select("post", F.col("top.key").alias("f")), "mh-leaders")
        pairs = stored(lists.join(leaders, "post").where("key <> f").select(F.col("key").alias("a"), "f", "cent").distinct(), "mh-pairs")
        if sets is None:
            wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("f")).distinct()
            sets = stored(shingle_sets(docs, classes.join(wanted, "key", "left_semi").select("key", "least"), width), "mh-sets")
        star = stored(_measured(pairs, sets, percent), "mh-star")
        found = star.where("linked").select("a", F.col("f").alias("b"))
        union = stored(found if links is None else links.unionByName(found), "mh-links")
        if labels is not None:
            discard(labels)
        labels = components(union)
        discard(union)
        links = labels.select(F.col("key").alias("a"), F.col("label").alias("b")).where("a <> b")
        narrow, left = _narrowed(star, labels, percent)
        discard(lists, leaders, pairs, star)
        lists = narrow
        if left <= first:
            break
    if left:
        pairs = stored(_last_pairs(lists, percent), "mh-pairs")
        late = stored(_measured(pairs, sets, percent).where("linked").select("a", F.col("f").alias("b")), "mh-late")
        if late.limit(1).count():
            before, labels = labels, components(links.unionByName(late))
            discard(before)
        discard(pairs, late)
    discard(lists, sets)
    label = _labelled(classes.select("key", "least"), labels, "key", "label")
    least = label.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = stored(label.join(least, "label").select("key", "component_id"), "mh-components")
    discard(classes, labels)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("key", F.concat(F.lit("row:"), F.col("row").cast("string")).cast("binary")).alias("key"))
    out = out.join(of_class, "key", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), [rows, of_class]


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component of link(): that with its least id; of rows that repeat this id, any one of them.

    Rows with a null, empty or blank text stay, as they link with nothing. All columns stay as they are.
    """
    linked, held = _link(docs.select("doc_id", "text"), width, percent)
    kept = stored(linked.where("kept").groupBy("doc_id").agg(F.count("*").alias("k"), F.min("n_shingles").alias("n")), "mh-kept")
    discard(*held)
    keep = kept.select(F.col("doc_id").alias("mh_id"))
    out = docs.join(keep, docs["doc_id"].eqNullSafe(keep["mh_id"]), "left_semi")
    twice = kept.where("k > 1 AND n > 0").select(F.col("doc_id").alias("mh_id"))
    if not twice.limit(1).count():
        return out
    same = out["doc_id"].eqNullSafe(twice["mh_id"])
    return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4, percent=80)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON a = doc_id
"""
