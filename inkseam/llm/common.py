"""Helpers shared by the corpus operators: scratch tables, row keys, Arrow columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as every contract of this package writes it.
SPACE = r"\x20\x09-\x0D"
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where it is unset and Spark is local (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkseam-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system layer; missing folders are fine."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/inkseam-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def standing_for(table: DataFrame, df: DataFrame) -> DataFrame:
    """df, a projection of a stored table; discarding it discards the table."""
    _PATHS[df] = _PATHS.pop(table)
    return df


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote; nothing may read these tables any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            remove(df.sparkSession, path)
    if tables:
        # shuffle files go once the driver has collected what refers to them
        tables[0].sparkSession._jvm.System.gc()


def row_key() -> Column:
    """A key for input rows whose own id may be null or repeated.

    Files give it anew with each scan, other inputs may not; so whoever joins on it also compares a hash of the content.
    """
    return F.monotonically_increasing_id()


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, taken: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that have one of these names renamed, and the names of all its columns now -> before."""
    names = {}
    for c in df.columns:
        new = c
        while new.lower() in taken or (new != c and new in df.columns):
            new = f"own_{new}"
        names[new] = c
    return df.toDF(*names), names


MOVED = "rows came in another order when they were read again; write them to files first"


def same_content(known: Column | str, now: Column, value: Column) -> Column:
    """value, but an error where a hash taken earlier for the same row key differs from now."""
    known = F.col(known) if isinstance(known, str) else known
    return F.when(known.isNull() | (known == now), value).otherwise(F.raise_error(F.lit(MOVED)).cast("long"))


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id as text modulo m; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % m


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def widened(schema: T.StructType, made: dict[str, str]) -> T.StructType:
    """schema with further columns, as a new object."""
    out = T.StructType(list(schema.fields))
    for name, kind in made.items():
        out = out.add(name, kind)
    return out
