"""Vector, ground-truth, attribute and report files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one task decodes at once.
PART = 16 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def vector_file_header(path: str) -> tuple[int, int]:
    """(dimension, records) of an ``.fvecs`` or ``.ivecs`` file of records of equal width."""
    fs, at = _open(path)
    size = fs.get_file_info(at).size
    if size == 0:
        return 0, 0
    with fs.open_input_file(at) as f:
        dim = struct.unpack("<i", f.read_at(4, 0))[0]
    if dim <= 0 or size % (4 + 4 * dim):
        raise ValueError(f"{path} is not made of records of one width")
    return dim, size // (4 + 4 * dim)


def _records(spark: SparkSession, path: str, kind: str, limit: int | None) -> DataFrame:
    dim, n = vector_file_header(path)
    n = min(n, limit) if limit is not None else n
    width = 4 + 4 * dim
    step = max(1, PART // width)
    ranges = spark.createDataFrame([(a, min(step, n - a)) for a in range(0, n, step)] or [(0, 0)], "start long, n long").repartition(max(1, -(-n // step)), "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            for batch in batches:
                for a, m in zip(batch["start"].to_pylist(), batch["n"].to_pylist(), strict=True):
                    raw = np.frombuffer(f.read_at(m * width, a * width), "<i4").reshape(m, dim + 1)
                    if (raw[:, 0] != dim).any():
                        raise ValueError("a record has another width")
                    body = np.ascontiguousarray(raw[:, 1:])
                    values = body.view("<f4").ravel() if kind == "float" else body.ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dim), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + m)), lists], names=["position", "vector"])

    return ranges.mapInArrow(read, f"position long, vector array<{kind}>")


def read_fvecs(spark: SparkSession, path: str, limit: int | None = None, normalize: bool = False, positions: list[int] | None = None) -> DataFrame:
    """(position, vector) of an ``.fvecs`` file, read in ranges by many tasks."""
    out = _records(spark, path, "float", limit)
    if positions is not None:
        out = out.where(F.col("position").isin(positions))
    if normalize:
        from ..functions.vectors import normalized

        out = out.withColumn("vector", normalized(F.col("vector")).cast("array<float>"))
    return out


def read_ivecs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(position, vector of zero-based ids) of an ``.ivecs`` file; records may differ in width.

    Widths stand in the records' headers only, so the driver walks these and
    keeps one row for each ``PART`` bytes, which tasks then decode.
    """
    fs, at = _open(path)
    size, parts, here, n = fs.get_file_info(at).size, [], 0, 0
    with fs.open_input_file(at) as f:
        begin, first = 0, 0
        while here < size and (limit is None or n < limit):
            if here + 4 > size:
                raise ValueError(f"{path} ends within a record")
            dim = struct.unpack("<i", f.read_at(4, here))[0]
            here, n = here + 4 + 4 * dim, n + 1
            if dim < 0 or here > size:
                raise ValueError(f"{path} ends within a record")
            if here - begin >= PART:
                parts.append((begin, here, first))
                begin, first = here, n
        if here > begin:
            parts.append((begin, here, first))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            for batch in batches:
                for a, b, first in zip(*(batch[c].to_pylist() for c in ("begin", "stop", "first")), strict=True):
                    raw, out, k = np.frombuffer(f.read_at(b - a, a), "<i4"), [], 0
                    while k < len(raw):
                        out.append(raw[k + 1 : k + 1 + raw[k]])
                        k += 1 + raw[k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(out))), pa.array(out, pa.list_(pa.int32()))], names=["position", "vector"])

    ranges = spark.createDataFrame(parts, "begin long, stop long, first long").repartition(max(1, len(parts)), "begin")
    return ranges.mapInArrow(read, "position long, vector array<int>")


def read_raw(spark: SparkSession, path: str, dim: int, limit: int | None = None) -> DataFrame:
    """(position, vector) of a raw matrix of 32-bit floats, row by row, read in ranges by many tasks."""
    fs, at = _open(path)
    size, width = fs.get_file_info(at).size, 4 * dim
    if size % width:
        raise ValueError(f"{path} is not made of rows of {dim} values")
    n = size // width if limit is None else min(limit, size // width)
    step = max(1, PART // width)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            for batch in batches:
                for a, m in zip(batch["start"].to_pylist(), batch["n"].to_pylist(), strict=True):
                    values = np.frombuffer(f.read_at(m * width, a * width), "<f4")
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dim), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + m)), lists], names=["position", "vector"])

    ranges = spark.createDataFrame([(a, min(step, n - a)) for a in range(0, n, step)], "start long, n long").repartition(max(1, -(-n // step)), "start")
    return ranges.mapInArrow(read, "position long, vector array<float>")


def append_raw(df: DataFrame, path: str, normalize: bool = True, column: str = "vector") -> int:
    """Append the vectors, in order of ``position``, to a raw matrix; gives its new number of bytes.  Through the driver, row by row."""
    from ..functions.vectors import normalized

    values = normalized(F.col(column)).cast("array<float>") if normalize else F.col(column)
    with open(path, "ab") as f:
        for r in df.orderBy("position").select(values).toLocalIterator():
            f.write(np.array(r[0], "<f4").tobytes())
        return f.tell()


def dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a data set, reckoned by the tasks that read them."""
    each = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return each.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def load_bundle(spark: SparkSession, folder: str, manifest: DataFrame, files: dict[str, str], limit: int | None = None) -> dict[str, DataFrame]:
    """The vectors, queries, truth and attributes of a data set whose files are what ``manifest`` says.

    ``files`` names the file of each part: ``base`` and ``queries`` are
    ``.fvecs``, ``truth`` is ``.ivecs`` and ``attributes`` JSON lines.
    """
    found = dataset_manifest(spark, folder)
    wrong = manifest.join(found.withColumnsRenamed({"bytes": "_b", "sha256": "_s"}), "file", "left").where("_b is null or _b <> bytes or _s <> sha256")
    if bad := wrong.select("file").first():
        raise ValueError(f"{bad[0]} is absent or damaged")
    readers = {"base": lambda p: read_fvecs(spark, p, limit), "queries": lambda p: read_fvecs(spark, p), "truth": lambda p: read_ivecs(spark, p), "attributes": lambda p: read_attributes(spark, p)}
    return {part: readers[part](f"{folder}/{name}") for part, name in files.items()}


def write_vecs(df: DataFrame, path: str, column: str = "vector", kind: str = "float") -> None:
    """Write one file in order of ``position``, row by row through the driver: for reports and small truths."""
    fs, at = _open(path)
    with fs.open_output_stream(at) as f:
        for r in df.orderBy("position").select(column).toLocalIterator():
            f.write(struct.pack("<i", len(r[0])) + np.array(r[0], "<f4" if kind == "float" else "<i4").tobytes())


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of paper attributes as metadata columns; a null licence is ``unspecified``, no category an error."""
    raw = spark.read.schema("main_categories array<string>, number_of_sub_categories int, has_comments boolean, number_of_versions int, number_of_authors int, license string").json(path)
    first = F.when(F.size("main_categories") > 0, F.element_at("main_categories", 1)).otherwise(F.raise_error(F.lit("a record has no category")).cast("string"))
    return raw.select(F.col("number_of_sub_categories").alias("label"), first.alias("main_category"), "has_comments", F.col("number_of_versions").alias("version_count"), F.col("number_of_authors").alias("author_count"), F.coalesce("license", F.lit("unspecified")).alias("license"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; tabs and line breaks in texts become spaces."""
    clean = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ").alias(c) for c in df.columns]
    df.select(*clean).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_tsv(df, f"{path}/{name}")


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(position, vector): unit vectors with normal coordinates, each drawn from a hash of seed, row and coordinate."""
    u = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed + k), F.col("id"), i), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * 3.141592653589793 * u(i, 1)))
    from ..functions.vectors import normalized

    return spark.range(n).select(F.col("id").alias("position"), normal.alias("_v")).select("position", normalized(F.col("_v")).cast("array<float>").alias("vector"))


def clustered(spark: SparkSession, n: int, dim: int, clusters: int, noise: float = 0.12, skew: float = 0.35, seed: int = 42) -> DataFrame:
    """(position, vector, cluster): noisy cluster centres; cluster i has a weight of 1 / (i + 1) ** skew."""
    weights = np.arange(1, clusters + 1, dtype=float) ** -skew
    edges = np.cumsum(weights / weights.sum()).tolist()
    centres = gaussian(spark, clusters, dim, seed + 7).select(F.col("position").cast("int").alias("cluster"), F.col("vector").alias("_c"))
    u = (F.pmod(F.xxhash64(F.lit(seed + 11), F.col("position")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cluster = F.size(F.filter(F.array(*(F.lit(e) for e in edges[:-1])), lambda e: e <= u))
    rows = gaussian(spark, n, dim, seed).withColumn("cluster", cluster).join(F.broadcast(centres), "cluster")
    from ..functions.vectors import normalized

    return rows.select("position", normalized(F.zip_with("_c", "vector", lambda c, v: c + noise * v)).cast("array<float>").alias("vector"), "cluster")
