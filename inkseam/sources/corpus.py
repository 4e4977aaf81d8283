r"""Strict readers of document collections, queries, judgments and runs, and the run writer.

Readers fail on the first malformed record, naming its number: what Spark's own readers would mend or drop silently is an
error here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = "doc_id long, ext_id string, body string"
QRELS_HEADER = "query-id\tcorpus-id\tscore"
RUN_FIELDS = 6


class BadInput(ValueError):
    """A malformed record."""


def body_of(title: str, text: str) -> str:
    """Title and text are one field."""
    return f"{title}\n{text}" if title else text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of a file in order; only line feeds end a line."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return spark.createDataFrame(rows.rdd.zipWithIndex().map(lambda x: (x[1], x[0].value)), "pos long, value string")


def _objects(value: str, number: int, fields: tuple[str, ...]) -> Iterator[dict[str, str]]:
    decode, at, text = json.JSONDecoder(), 0, value
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at == len(text):
            return
        try:
            got, at = decode.raw_decode(text, at)
        except ValueError as e:
            raise BadInput(f"record {number}: {e}") from None
        if not isinstance(got, dict):
            raise BadInput(f"record {number}: not an object")
        out = {f: got.get(f) if got.get(f) is not None else "" for f in fields}
        for f, x in out.items():
            if not isinstance(x, str):
                raise BadInput(f"record {number}: {f} is not a string")
        if not out["_id"]:
            raise BadInput(f"record {number}: _id is missing or empty")
        yield out


def _jsonl(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """Objects of a JSON stream, several on a line allowed, as columns pos, sub and the fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(pos, sub, *(x[f] for f in fields)) for pos, value in zip(batch.pos, batch.value) for sub, x in enumerate(_objects(value, pos + 1, fields))]
            yield pd.DataFrame(rows, columns=["pos", "sub", *fields])

    return _lines(spark, path).mapInPandas(run, "pos long, sub int, " + ", ".join(f"`{f}` string" for f in fields))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """0-based ids in input order."""
    rows = df.orderBy(*order).rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    return df.sparkSession.createDataFrame(rows, "doc_id long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, text): split at the first tab; one closing carriage return goes; empty lines are passed over."""
    rows = _lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", "")).where("value <> ''")
    parts = F.split("value", "\t", 2)
    why = F.when(~F.is_valid_utf8("value"), "invalid UTF-8").when(F.size(parts) < 2, "no tab").when(parts[0] == "", "empty id")
    checked = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(": "), why))).otherwise(parts[0])
    return rows.select("pos", checked.cast("string").alias("id"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("text"))


def _is_tsv(path: str) -> bool:
    return PurePosixPath(path).suffix.lower() == ".tsv"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ext_id, body) of a .tsv or JSON-lines collection; ids that repeat stay separate documents."""
    if _is_tsv(path):
        return _numbered(_tsv(spark, path), "pos").select("doc_id", F.col("id").alias("ext_id"), F.col("text").alias("body"))
    rows = _numbered(_jsonl(spark, path, ("_id", "title", "text")), "pos", "sub")
    body = F.when(F.col("title") != "", F.concat_ws("\n", "title", "text")).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("_id").alias("ext_id"), body.alias("body"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text); of queries that repeat an id the last one holds."""
    if _is_tsv(path):
        rows = _tsv(spark, path).select(F.col("id").alias("qid"), "text", "pos", F.lit(0).alias("sub"))
    else:
        rows = _jsonl(spark, path, ("_id", "text")).select(F.col("_id").alias("qid"), "text", "pos", "sub")
    return rows.groupBy("qid").agg(F.max_by("text", F.struct("pos", "sub")).alias("text"))


def _fields(rows: DataFrame, wanted: int, by_tab: bool) -> DataFrame:
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t") if by_tab else F.split(trimmed, r"\s+")
    bad = F.raise_error(F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(f": not {wanted} fields")))
    return rows.where(trimmed != "").select("pos", F.when(F.size(parts) == wanted, parts).otherwise(bad.cast("array<string>")).alias("f"))


def _checked(value, kind: str, what: str):
    got = value.try_cast(kind)
    ok = got.isNotNull() if kind != "double" else got.isNotNull() & (F.abs(got) < float("inf")) & ~F.isnan(got)
    return F.when(ok, got).otherwise(F.raise_error(F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(f": bad {what}"))).cast(kind))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ext_id, grade) of a tab-separated file with header, or of a TREC file; the last of repeated pairs holds."""
    rows = _lines(spark, path)
    first = rows.where(F.trim("value") != "").orderBy("pos").first()
    if first is None:
        raise BadInput("no judgments")
    if first.value.rstrip("\r") == QRELS_HEADER:
        f = _fields(rows.where(F.col("pos") > first.pos), 3, True)
        at = (0, 1, 2)
    else:
        f = _fields(rows, 4, False)
        at = (0, 2, 3)
    out = f.select("pos", F.col("f")[at[0]].alias("qid"), F.col("f")[at[1]].alias("ext_id"), _checked(F.col("f")[at[2]], "int", "grade").alias("grade"))
    return out.groupBy("qid", "ext_id").agg(F.max_by("grade", "pos").alias("grade"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ext_id, score) of a TREC run; its rank column is not read."""
    f = _fields(_lines(spark, path), RUN_FIELDS, False)
    return f.select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("ext_id"), _checked(F.col("f")[4], "double", "score").alias("score"))


@F.pandas_udf(T.StringType())
def six_decimals(x: pd.Series) -> pd.Series:
    """%.6f of the exact binary value, halves to even; Spark's own formatting rounds the decimal text."""
    return x.map(lambda v: f"{v:.6f}")


def run_lines(ranked: DataFrame, tag: str) -> DataFrame:
    """(qid, rank, line) of a ranking (qid, rank, ext_id, score) in TREC form."""
    return ranked.select("qid", "rank", F.concat_ws(" ", "qid", F.lit("Q0"), "ext_id", F.col("rank").cast("string"), six_decimals("score"), F.lit(tag)).alias("line"))


def write_run(ranked: DataFrame, path: str, tag: str) -> None:
    """A TREC run in string order of query ids, as a folder of text files whose name order is the row order."""
    run_lines(ranked, tag).repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank").select("line").write.text(path)


def parse_size(text: str) -> int:
    """512, 16KB, 1gb: bytes by powers of 1024; must be positive and below 2**63."""
    units = {"KB": 10, "MB": 20, "GB": 30, "TB": 40}
    upper = text.strip().upper()
    shift = next((s for u, s in units.items() if upper.endswith(u)), 0)
    digits = upper[:-2] if shift else upper
    if not digits.isascii() or not digits.isdigit():
        raise ValueError(f"invalid size {text!r}")
    out = int(digits) << shift
    if not 0 < out < 1 << 63:
        raise ValueError(f"size {text!r} is out of range")
    return out
