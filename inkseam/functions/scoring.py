"""BM25 as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BM25:
    k1: float = 0.9
    b: float = 0.4


def idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), always positive."""
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_score(weight: Column, tf: Column, dl: Column, avgdl: Column, bm25: BM25) -> Column:
    """weight * tf / (tf + k1 * (1 - b + b * dl / avgdl))."""
    return weight * tf / (tf + F.lit(bm25.k1) * (F.lit(1.0 - bm25.b) + F.lit(bm25.b) * dl / avgdl))
