"""Inverted indexes as tables: build, save, open, check, look up.

postings(term, doc_id, tf, dl, impact), docs(doc_id, ext_id, dl), terms(term, df, idf, max_score),
tiles(term, tile, tile_max), meta(one row), and texts(doc_id, body) if asked for.

An index that is built is one stored row for each document, with its distinct terms and their counts; its tables follow
from that when they are asked for, each with one shuffle of postings, by term. A saved index has them as files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkseam.functions.analysis import stemmed, with_terms
from inkseam.functions.scoring import BM25, idf, term_score
from inkseam.scratch import keep

VERSION = 1
#: Documents of one tile, and postings of one block.
TILE, BLOCK = 4096, 128
TABLES = ("postings", "docs", "terms", "tiles")


@dataclass
class Index:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    tiles: DataFrame
    meta: dict
    texts: DataFrame | None = None
    #: (term, doc_id, tf, dl) and (term, df, idf), where they can be had with less work than postings and terms.
    counts: DataFrame | None = None
    weights: DataFrame | None = None

    def __post_init__(self) -> None:
        self.counts = self.counts or self.postings.select("term", "doc_id", "tf", "dl")
        self.weights = self.weights or self.terms.select("term", "df", "idf")

    @property
    def bm25(self) -> BM25:
        return BM25(self.meta["k1"], self.meta["b"])


def _of_counts(counts: DataFrame, docs: DataFrame, n: int, t: int, bm25: BM25, tile: int) -> Index:
    """Index of (term, doc_id, tf, dl) and (doc_id, ext_id, dl): n documents of t terms in all."""
    avgdl = t / n if n else 0.0
    weights = counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(float(n)), F.col("df")))
    # the length travels with the posting: scoring needs no join with docs
    postings = counts.join(weights, "term").select("term", "doc_id", "tf", "dl", term_score(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(avgdl), bm25).alias("impact"))
    tiles = postings.groupBy("term", F.expr(f"doc_id DIV {tile}").alias("tile")).agg(F.max("impact").alias("tile_max"))
    terms = weights.join(postings.groupBy("term").agg(F.max("impact").alias("max_score")), "term").select("term", "df", "idf", "max_score")
    meta = {"version": VERSION, "n_docs": n, "total_terms": t, "avgdl": avgdl, "k1": bm25.k1, "b": bm25.b, "tile": tile}
    return Index(postings, docs, terms, tiles, meta, None, counts, weights)


def _of_rows(rows: DataFrame, bm25: BM25, tile: int) -> Index:
    """Index of (doc_id, ext_id, dl, terms, tfs). Documents without terms keep a row in docs and count for the average length."""
    # text analysis is the costly part: it runs once
    rows = keep(rows, "rows")
    docs = rows.select("doc_id", "ext_id", "dl")
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    counts = rows.where("doc_id IS NOT NULL").select("doc_id", "dl", "tfs", F.posexplode("terms").alias("at", "term")).select("term", "doc_id", F.expr("tfs[at]").alias("tf"), "dl")
    return _of_counts(counts, docs, total.n, total.t, bm25, tile)


def invert(worded: DataFrame, bm25: BM25 = BM25(), tile: int = TILE) -> Index:
    """Index of (doc_id, ext_id, words), words before stemming."""
    return _of_rows(stemmed(worded.select("doc_id", "ext_id", "words"), counted=True), bm25, tile)


def build(docs: DataFrame, bm25: BM25 = BM25(), tile: int = TILE, store_text: bool = False) -> Index:
    """Index of (doc_id, ext_id, body)."""
    out = _of_rows(with_terms(docs.select("doc_id", "ext_id", "body"), counted=True), bm25, tile)
    out.texts = docs.select("doc_id", "body") if store_text else None
    return out


def save(index: Index, path: str) -> None:
    """Write all tables under a new folder, meta last; an existing folder is refused and a failed write leaves nothing."""
    spark = index.postings.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm):
        raise FileExistsError(path)
    try:
        index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
        stored = Index(spark.read.parquet(f"{path}/postings"), index.docs, index.terms, index.tiles, index.meta)
        # the other tables follow from the postings just written
        df = stored.postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("max_score"))
        df.withColumn("idf", idf(F.lit(float(index.meta["n_docs"])), F.col("df"))).select("term", "df", "idf", "max_score").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        stored.postings.groupBy("term", F.expr(f"doc_id DIV {index.meta['tile']}").alias("tile")).agg(F.max("impact").alias("tile_max")).repartitionByRange("term", "tile").sortWithinPartitions("term", "tile").write.parquet(f"{path}/tiles")
        index.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/docs")
        if index.texts is not None:
            index.texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/texts")
        spark.createDataFrame([tuple(index.meta.values())], "version int, n_docs long, total_terms long, avgdl double, k1 double, b double, tile int").coalesce(1).write.parquet(f"{path}/meta")
    except BaseException:
        fs.delete(jvm, True)
        raise


def open_index(spark: SparkSession, path: str) -> Index:
    """The saved index; other versions and unfinished folders are refused."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/texts")
    rows = spark.read.parquet(f"{path}/meta").collect()
    if len(rows) != 1 or rows[0].version != VERSION:
        raise ValueError(f"{path}: not an index of version {VERSION}")
    has_text = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    return Index(**tables, meta=rows[0].asDict(), texts=spark.read.parquet(f"{path}/texts") if has_text else None)


def check(index: Index) -> list[str]:
    """What is wrong with an index; empty if nothing is. Postings are read once by term, and once for their documents."""
    n, t = index.meta["n_docs"], index.meta["total_terms"]
    docs = index.docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t"), F.countDistinct("doc_id").alias("d")).first()
    wrong = []
    if (docs.n, docs.t, docs.d) != (n, t, n):
        wrong.append("docs: count, ids or lengths differ from meta")
    bad = F.coalesce((F.col("tf") < 1) | F.isnan("impact"), F.lit(True))
    pairs = index.postings.groupBy("term", "doc_id").agg(F.count("*").alias("c"), F.sum("tf").alias("t"), F.max("impact").alias("m"), F.max(bad).alias("bad"))
    own = pairs.groupBy("term", F.expr(f"doc_id DIV {index.meta['tile']}").alias("tile")).agg(F.sum("c").alias("d"), F.max("c").alias("c"), F.sum("t").alias("t"), F.max("m").alias("m"), F.max("bad").alias("bad"))
    tiles = own.join(index.tiles, ["term", "tile"], "full").withColumn("off", ~F.col("tile_max").eqNullSafe(F.col("m")))
    found = tiles.groupBy("term").agg(F.sum("d").alias("d"), F.max("c").alias("c"), F.sum("t").alias("t"), F.max("m").alias("m"), F.max("bad").alias("bad"), F.max("off").alias("off"))
    listed = index.terms.groupBy("term").agg(F.count("*").alias("n"), F.max("df").alias("df"), F.max("max_score").alias("max_score"), F.max(F.coalesce((F.col("df") < 1) | (F.col("df") > n), F.lit(True))).alias("out"))
    differs = ~(F.col("df").eqNullSafe(F.col("d")) & F.col("max_score").eqNullSafe(F.col("m")))
    none = lambda c: F.coalesce(c, F.lit(False))
    got = found.join(listed, "term", "full").agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("t"),
        none(F.max(F.col("c") > 1)).alias("twice"),
        none(F.max((F.col("n") > 1) | F.col("out"))).alias("terms"),
        none(F.max(differs)).alias("differs"),
        none(F.max("off")).alias("off"),
        none(F.max("bad")).alias("bad"),
    ).first()
    if got.t != t:
        wrong.append("postings: counts don't add up to the total length")
    if got.twice:
        wrong.append("postings: a pair stands twice")
    if got.terms:
        wrong.append("terms: repeated, or df out of range")
    if got.differs:
        wrong.append("terms: df or max_score differ from the postings")
    if got.off:
        wrong.append("tiles: maxima differ from the postings")
    if index.counts.select("doc_id").distinct().join(index.docs, "doc_id", "left_anti").limit(1).count():
        wrong.append("postings: unknown document")
    if got.bad:
        wrong.append("postings: bad count or impact")
    return wrong


def blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """(term, block_no, first_doc, last_doc, n, block_max): fixed blocks of a term's postings in document order."""
    at = F.floor((F.row_number().over(Window.partitionBy("term").orderBy("doc_id")) - 1) / size).cast("int")
    return postings.withColumn("block_no", at).groupBy("term", "block_no").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"), F.max("impact").alias("block_max"))


def gaps(postings: DataFrame) -> DataFrame:
    """postings with the gap to the document before (the first one counts from -1)."""
    return postings.withColumn("gap", F.col("doc_id") - F.lag("doc_id", 1, -1).over(Window.partitionBy("term").orderBy("doc_id")))


def from_gaps(coded: DataFrame) -> DataFrame:
    """Documents back from gaps: (term, pos, gap, ...) with the running sum."""
    order = Window.partitionBy("term").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return coded.withColumn("doc_id", F.sum("gap").over(order) - 1)


def merge(parts: list[Index], bm25: BM25 = BM25()) -> Index:
    """Indexes one after the other: document ids of each follow those of the parts before it."""
    base, total, counts, docs = 0, 0, None, None
    for p in parts:
        moved = p.counts.select("term", (F.col("doc_id") + base).alias("doc_id"), "tf", "dl")
        own = p.docs.select((F.col("doc_id") + base).alias("doc_id"), "ext_id", "dl")
        counts = moved if counts is None else counts.unionByName(moved)
        docs = own if docs is None else docs.unionByName(own)
        base, total = base + p.meta["n_docs"], total + p.meta["total_terms"]
    return _of_counts(counts, docs, base, total, bm25, parts[0].meta["tile"])
