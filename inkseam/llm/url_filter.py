r"""URL rules as a sort-merge range join over reversed-host keys, in DataFrame functions only.

A rule (host, path prefix) is an interval of canonical keys: the labels of the host reversed, each closed by a dot, a zero
byte, then the path. A url stands in that order once for each of its parent hosts. The intervals of rules nest or are
apart, so one sorted sweep over their ends keeps a stack of the active rules; the top of the stack at the last end before
a key is the longest rule that holds it. Urls and interval ends are range-partitioned together by key and page, so that
neither a hot host nor a hot url lands in one task; each partition starts from the last end of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkseam.llm.common import row_key, same_content, set_aside, stored, unused

#: (host, path prefix, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_key(host: str, path: str) -> bytes:
    return ("".join(f"{x}." for x in reversed(host.split("."))) + "\0" + path).encode()


def ends_of(rules: list[tuple[str, str, str]]) -> list[tuple[bytes, str | None, str | None]]:
    """The swept interval ends, ascending: (key, rule on top of the stack from there on, its verdict)."""
    best: dict[bytes, tuple[str, str]] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict}")
        best[_rule_key(host.translate(str.maketrans(UPPER, LOWER)), path)] = (host + path, verdict)  # the last of equal rules holds
    out: list[tuple[bytes, str | None, str | None]] = []
    stack: list[bytes] = []

    def close(until: bytes | None) -> None:
        while stack and (until is None or not until.startswith(stack[-1])):
            ended = stack.pop() + b"\xff"  # no UTF-8 text has this byte
            top = best[stack[-1]] if stack else (None, None)
            if out and out[-1][0] == ended:
                out.pop()
            out.append((ended, *top))

    for key in sorted(best):
        close(key)
        stack.append(key)
        out.append((key, *best[key]))
    close(None)
    return out


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with uf_host (A-Z lower-cased) and uf_path; both empty for null urls and urls without `://`."""
    at = f"instr({url}, '://')"
    rest = f"coalesce(CASE WHEN {at} > 0 THEN substring({url}, {at} + 3) END, '')"
    return df.withColumn("uf_host", F.expr(f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')")).withColumn("uf_path", F.expr(f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """All columns of pages plus uf_host, uf_path, uf_rule (null where none fits) and uf_verdict.

    Longest wins: the rule with the longest text, host and path together; of equally long ones that with the longer host.
    Null urls and urls without `://` fit no rule and get the default verdict. Repeated rows are judged one by one; an
    empty table gives an empty result. Of a very long host only the parents with as many labels as the deepest rule are
    looked up, no other can have one. Columns of pages with the four names are replaced, all others stay, whatever they are
    called. Rows that come in another order when pages is read again raise.
    """
    spark: SparkSession = pages.sparkSession
    pages = pages.drop("uf_host", "uf_path", "uf_rule", "uf_verdict")
    pages, own = set_aside(pages, {"uf_row", "uf_best"})
    names = list(own)
    rows = split_url(pages).withColumn("uf_row", row_key())
    content = F.xxhash64("uf_host", "uf_path")
    deepest = max((host.count(".") + 1 for host, _, _ in rules), default=1)
    ends = spark.createDataFrame([(bytearray(k), r, v) for k, r, v in ends_of(rules)], "k binary, rule string, verdict string")
    labels = "split(uf_host, '[.]')"
    keys = rows.where("uf_host != ''").select("uf_row", "uf_path", content.alias("hash"), F.explode(F.expr(
        f"transform(sequence(1, least({deepest}, size({labels}))), n -> array_join(reverse(slice({labels}, -n, n)), '.'))")).alias("h"))
    keys = keys.select("uf_row", "hash", F.expr("encode(concat(h, '.', char(0), uf_path), 'UTF-8')").alias("k"))
    both = ends.select("k", F.lit(-1).cast("long").alias("uf_row"), F.lit(None).cast("long").alias("hash"), "rule", "verdict", F.lit(True).alias("e")).unionByName(
        keys.select("k", "uf_row", "hash", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("e")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: the partition numbers must be the same for the sweep and for what each partition starts from
    swept = stored(both.repartitionByRange(n, "k", "uf_row").withColumn("p", F.spark_partition_id()), "url-sweep")
    order = Window.partitionBy("p").orderBy("k", "uf_row").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each partition: the last interval end in it, carried on to those after it
    last = swept.groupBy("p").agg(F.max_by(F.struct("rule", "verdict"), F.when(F.col("e"), F.col("k"))).alias("last"))
    start = last.select("p", F.last("last", ignorenulls=True).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    top = F.coalesce(F.last(F.when(F.col("e"), F.struct("rule", "verdict")), ignorenulls=True).over(order), F.col("start"))
    found = swept.join(F.broadcast(start), "p").withColumn("top", top).where("NOT e AND top.rule IS NOT NULL")
    best = found.groupBy("uf_row").agg(F.max("hash").alias("hash"), F.max(F.struct(F.char_length("top.rule").alias("size"), F.instr("top.rule", "/").alias("host"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    out = rows.join(best.select("uf_row", F.struct("best", "hash").alias("uf_best")), "uf_row", "left")
    sure = same_content("uf_best.hash", content, F.lit(1).cast("long")) == 1
    rule = F.when(sure, F.col("uf_best.best.rule"))
    return out.select(*[F.col(new).alias(old) for new, old in own.items()], "uf_host", "uf_path", rule.alias("uf_rule"), F.coalesce("uf_best.best.verdict", F.lit(default)).alias("uf_verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).selectExpr("page_id", "uf_host AS host", "uf_path AS path", "uf_rule AS rule", "uf_verdict AS verdict")


ORACLE = f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(repr(r) for r in RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT rid, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN m ON p.rid = m.rid AND k = 1
"""
