"""Token files: Parquet with list columns, chosen encodings, bounded row groups and page indexes.

Documents are range-partitioned by key and each part is written as one file:
``ids`` is a list column with dictionary encoding (ids repeat), ``n_tokens``,
``start`` and the key are delta-encoded.  Row groups are bounded in ids, pages
are small and indexed, so a reader fetches the metadata columns, or the ids of
some documents, without the rest.  A manifest row for each file gives its
place in the global order.

Nulls and odd input: a null text is empty and yields the end id alone; null
keys come first; rows with equal keys are kept, ordered by a hash of the text; an empty table
gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, lean_batches, new_folder, small_batches, sorted_by_range, table, text_bytes, written
from .tokens import default_tokenizer, encoder

#: Ids in a row group.
GROUP_IDS = 1 << 20
MANIFEST = "part int, path string, n_docs long, n_ids long, groups int"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _writer(fs, path: str) -> pq.ParquetWriter:
    return pq.ParquetWriter(
        path, SCHEMA, filesystem=fs, compression="zstd", compression_level=1, use_dictionary=["ids.list.element"], write_page_index=True, data_page_size=256 << 10,
        column_encoding={"doc_id": "DELTA_BINARY_PACKED", "start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, version="2.6",
    )


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text_total: tuple[int, int], part_bytes: int = 24 << 20) -> DataFrame:
    """Write (doc_id, text) as token files in ``folder``; gives the manifest, already computed."""
    rows, size = text_total
    per_task = max(1, rows * part_bytes // max(size, 1))
    spark = docs.sparkSession
    small_batches(spark)
    parts = sorted_by_range(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("mix")), per_task, rows, "doc_id", "mix")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        place = f"{root}/tokens-{part:06d}.parquet"
        draft = f"{root}/_draft-{part:06d}-{uuid.uuid4().hex}"
        held, held_ids, start, n_docs, groups, out = [], 0, 0, 0, 0, None
        end = np.array([end_id], encode.dtype).tobytes()

        def flush():
            nonlocal held, held_ids, start, groups, out
            out = out or _writer(fs, draft)
            lengths = np.array([len(b) for _, b in held], np.int64) // encode.dtype.itemsize
            stops = np.cumsum(lengths)
            ids = np.frombuffer(b"".join(b for _, b in held), encode.dtype).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(ids))
            out.write_table(pa.table([pa.array([k for k, _ in held], pa.int64()), pa.array(start + stops - lengths), pa.array(lengths), lists], schema=SCHEMA), row_group_size=max(1, len(held)))
            start, groups, held, held_ids = start + int(lengths.sum()), groups + 1, [], 0

        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.append((key, encode.encode(text) + end))
                held_ids += len(held[-1][1]) // encode.dtype.itemsize
                n_docs += 1
                if held_ids >= GROUP_IDS:
                    flush()
        if held:
            flush()
        if out:
            out.close()
            fs.move(draft, place)  # complete files only; a repeated task writes the same again
            yield pa.RecordBatch.from_pylist([{"part": part, "path": place, "n_docs": n_docs, "n_ids": start, "groups": groups}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("groups", pa.int32())]))

    return written(parts.mapInArrow(lean_batches(write), MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "<u4") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back row group by row group.

    ``start`` counts the ids of all documents before: a file's offset is the
    sum over the files before it (one manifest row each).
    """
    spark = manifest.sparkSession
    files = sorted((r["part"], r["path"], r["n_ids"], r["groups"]) for r in manifest.collect())
    base, units = 0, []
    for _, path, n, groups in files:
        units += [(path, g, base) for g in range(groups)]
        base += n
    todo = spark.createDataFrame(units, "path string, row_group int, base long").repartition(max(1, min(len(units), 4 * len(files))), "path", "row_group")

    def read(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for u in batch.to_pylist():
                with pq.ParquetFile(u["path"], filesystem=fs, pre_buffer=True) as f:
                    t = f.read_row_group(u["row_group"])
                lists = t["ids"].combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                ids, at = lists.values.to_numpy().astype(id_type), lists.offsets.to_numpy()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    t["doc_id"].combine_chunks(), pa.array(t["start"].to_numpy() + u["base"]), t["n_tokens"].combine_chunks(), pa.array(sums, pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(lean_batches(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(folder: str, path: str, doc_ids: list[int]):
    """The rows of some documents of one file: the keys' page statistics skip the other row groups."""
    fs, _ = file_system(folder)
    return pq.read_table(path, filesystem=fs, filters=[("doc_id", "in", doc_ids)])


def op8_token_files(spark, sf_dir) -> DataFrame:
    """Write all documents as token files, end id 2, and read them back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(docs, folder, default_tokenizer(), 2, text_bytes(docs))
    return read_token_files(manifest, folder)
