"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in key order.  A keyed Feistel network permutes the
smallest power of four that is at least N; numbers that leave 0..N-1 are fed
through again until they are back (cycle walking), so 0..N-1 is permuted.
``shard = p mod S`` and ``slot = p div S`` follow from the permuted number
``p`` alone, and :func:`locate` inverts them: no shuffle of the data decides.

Nulls and odd input: a null text counts as empty; null keys are numbered
first; equal rows are interchangeable; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sorted_by_range, table, written

ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    keys, x = [], np.uint64(seed)
    with np.errstate(over="ignore"):
        for _ in range(ROUNDS):
            x = x + np.uint64(0x9E3779B97F4A7C15)
            z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append(z ^ (z >> np.uint64(27)))
    return np.array(keys, np.uint64)


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)) & mask


def _pass(x: np.ndarray, keys, bits: int, back: bool) -> np.ndarray:
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ _mixed(left, key, mask), left
        else:
            left, right = right, left ^ _mixed(right, key, mask)
    return (left << shift) | right


def permute(numbers, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each row number in a permutation of 0..n-1, or with ``back`` the number at each place."""
    x, keys, bits = np.array(numbers, np.uint64), _round_keys(seed), _half_bits(n)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _pass(x[todo], keys, bits, back)
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def locate(shard, slot, shards: int, n: int, seed: int) -> np.ndarray:
    """The row number at a shard and slot."""
    return permute(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), n, seed, back=True)


def numbered(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """Add ``row_number`` (0..N-1 by ``keys``), without a task that sees all rows; gives N too.

    The range-partitioned rows are written once, so that the counts of the
    parts, of which there is one row each, and the rows agree whatever is lost.
    """
    rows = df.count()
    parts = sorted_by_range(df, 2_000_000, rows, *keys)
    held = written(parts.select("*", F.monotonically_increasing_id().alias("_at")), "numbered")
    at = held.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_in"))
    counts = sorted((r["_part"], r["n"]) for r in at.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    base, starts = 0, []
    for part, n in counts:
        starts.append((part, base))
        base += n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _base long")
    return at.join(F.broadcast(starts), "_part").withColumn("row_number", F.col("_base") + F.col("_in")).drop("_at", "_part", "_in", "_base"), base


def shuffled_shards(df: DataFrame, shards: int, seed: int, *keys: str) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``; shard sizes are at most one apart."""
    rows, n = numbered(df, *keys)

    @F.pandas_udf("long")
    def place(number):
        return pd.Series(permute(number.to_numpy(), n, seed))

    placed = rows.withColumn("_place", place("row_number"))
    return placed.withColumns({"shard": F.pmod("_place", F.lit(shards)).cast("int"), "slot": F.floor(F.col("_place") / shards).cast("long")}).drop("_place")


def op9_feistel_shards(spark, sf_dir, shards: int = 8, seed: int = 20250101) -> DataFrame:
    """All documents in 8 shards by the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffled_shards(docs, shards, seed, "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
