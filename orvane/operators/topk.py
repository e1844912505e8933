"""Top-k of scored rows, by descending score and then visiting order.

For one query it is a sort with a limit; for many, a rank per query, of which
Spark keeps k rows per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("segment_no", "list_rank", "position")


def _keys(df: DataFrame, score: str) -> list:
    return [F.desc(score), *(F.asc(c) for c in ORDER if c in df.columns)]


def top_k(df: DataFrame, k: int, score: str = "score", strict: bool = False) -> DataFrame:
    """The k best rows of one query; ``strict`` refuses a k above the number of rows."""
    if k < 1:
        raise ValueError("k must be positive")
    if strict and df.limit(k).count() < k:
        raise ValueError("k exceeds the number of rows")
    return df.orderBy(*_keys(df, score)).limit(k)


def top_k_each(df: DataFrame, k: int, score: str = "score", by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each query, with their rank from 1."""
    if k < 1:
        raise ValueError("k must be positive")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*_keys(df, score)))).where(F.col(rank) <= k)


def merged_top_k(parts: list[DataFrame], k: int, score: str = "score", by: str = "query_id") -> DataFrame:
    """Merge ranked lists of several segments, older first; equal scores prefer the older."""
    whole = None
    for number, part in enumerate(parts):
        own = part.drop("rank").withColumn("segment_no", F.lit(number))
        whole = own if whole is None else whole.unionByName(own, allowMissingColumns=True)
    return top_k_each(whole, k, score, by)
