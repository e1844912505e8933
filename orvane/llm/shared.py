"""Which hashes occur more than once in a corpus, without a row for each hash.

Documents are dealt to blocks of bounded bytes by a hash of key, text and input
partition.  Each
block sends, for each bucket of hashes, one binary value of 32-bit remainders;
the bucket counts them and sends back one byte for each, compressed: 0 for a
hash seen once, else the number of bits of its count.  A second pass over the
blocks (their shuffle is used again) meets these answers.  Two hashes may share
a remainder: then both look shared, which costs time, not results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .scan import U

BLOCK_BYTES = 6 << 20
BUCKET_HASHES = 3_000_000


def in_blocks(docs: DataFrame, size: int) -> DataFrame:
    """Add ``_block`` to rows (doc_id, _text).  Repeats of one row are split too, by the partition that they come from."""
    return docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "_text", F.spark_partition_id()), F.lit(max(1, -(-size // BLOCK_BYTES)))).cast("int"))


def ordered(block: pa.Table) -> pa.Table:
    """The rows of a block in one order, whatever order they came in; equal rows are alike."""
    return block.sort_by([("doc_id", "ascending"), ("_text", "ascending")])


def buckets_for(hashes: int) -> int:
    return max(1, -(-hashes // BUCKET_HASHES))


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the hashes by bucket, and where each bucket begins."""
    bucket = ((hashes >> U(32)) % U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def shared_classes(blocks: DataFrame, hashes_of: Callable[[pa.Table], np.ndarray], buckets: int) -> DataFrame:
    """(block, bucket, classes) for the hashes that ``hashes_of`` gives for each block in ``ordered`` order."""

    def send(block: pa.Table) -> pa.Table:
        number = block["_block"][0].as_py()
        h = hashes_of(ordered(block))
        order, at = _dealt(h, buckets)
        rest = (h[order] & U(0xFFFFFFFF)).astype("<u4")
        used = np.flatnonzero(np.diff(at))
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), number), pa.int32()), "hashes": pa.array([rest[at[k] : at[k + 1]].tobytes() for k in used], pa.binary())})

    def count(bucket: pa.Table) -> pa.Table:
        number, parts = bucket["bucket"][0].as_py(), bucket["hashes"].to_pylist()
        v = np.frombuffer(b"".join(parts), "<u4")
        order = np.argsort(v)
        first = np.flatnonzero(np.r_[True, np.diff(v[order]) != 0])
        n = np.diff(np.r_[first, len(v)])
        kind = np.where(n > 1, np.ceil(np.log2(n + 1)), 0).astype(np.uint8)
        classes = np.empty(len(v), np.uint8)
        classes[order] = np.repeat(kind, n)
        ends = np.cumsum([len(p) // 4 for p in parts])
        back = [zlib.compress(c.tobytes(), 1) for c in np.split(classes, ends[:-1])]
        return pa.table({"block": bucket["block"], "bucket": pa.array([number] * len(parts), pa.int32()), "classes": pa.array(back, pa.binary())})

    sent = blocks.groupBy("_block").applyInArrow(lean(send), "bucket int, block int, hashes binary")
    return sent.groupBy("bucket").applyInArrow(lean(count), "block int, bucket int, classes binary")


def classes_for(hashes: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """The class of each hash of a block, from the answers to it."""
    order, at = _dealt(hashes, buckets)
    out = np.zeros(len(hashes), np.uint8)
    for bucket, data in zip(answers["bucket"].to_pylist(), answers["classes"].to_pylist(), strict=True):
        out[order[at[bucket] : at[bucket + 1]]] = np.frombuffer(zlib.decompress(data), np.uint8)
    return out
