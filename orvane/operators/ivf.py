"""Inverted-file index: training, assignment, list radii and statistics.

Rows carry ``position``, ``vector``, ``norm`` and ``list_id``; centroids are a
small table (list_id, centroid, size, radius).  Training runs Lloyd's rounds as
DataFrame jobs: the centroids, whose number is the index's and not the data's,
go to every task, and each round sums per list and coordinate before a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import routing_distance, score

#: Centroid values that may go to every task.
MAX_CENTROID_VALUES = 50_000_000


def _checked(centroids: np.ndarray) -> np.ndarray:
    if centroids.size > MAX_CENTROID_VALUES:
        raise ValueError(f"{centroids.shape[0]} centroids of {centroids.shape[1]} values are too many to send to every task")
    return centroids


def centroid_matrix(centroids: DataFrame) -> np.ndarray:
    """The centroids in list order, as a matrix; refused beyond a bound."""
    n, dim = centroids.count(), len(centroids.select("centroid").first()[0])
    if n * dim > MAX_CENTROID_VALUES:
        raise ValueError("too many centroids for one machine")
    return np.array([r[0] for r in centroids.orderBy("list_id").select("centroid").collect()], np.float64)


def seeded_centroids(rows: DataFrame, label: str, vector: str = "vector", key: str = "position") -> DataFrame:
    """One centroid for each value of ``label``: the vector of its smallest key.  Lists are numbered by label."""
    first = rows.groupBy(label).agg(F.min_by(vector, key).alias("centroid"))
    return first.select(F.col(label).cast("int").alias("list_id"), F.col("centroid").cast("array<double>").alias("centroid"))


def assigned(rows: DataFrame, centroids: DataFrame, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """Add ``list_id`` and ``list_score``: the list of the most similar centroid, ties to the lower list.

    Each row meets the array of all centroids, of which there are few, in
    place: no shuffle, and repeated rows stay.
    """
    held = centroids.agg(F.collect_list(F.struct("list_id", "centroid")).alias("_c"))
    keys = [c for c in rows.columns if c != vector]
    each = F.transform("_c", lambda c: F.struct(score(metric, F.col(vector), c["centroid"]).alias("s"), (-c["list_id"]).alias("n")))
    best = rows.join(F.broadcast(held)).withColumn("_b", F.array_max(each))
    return best.select(*keys, vector, (-F.col("_b.n")).alias("list_id"), F.col("_b.s").alias("list_score"))


def assigned_fast(rows: DataFrame, centroids: np.ndarray, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """The same by matrix products over Arrow batches; no shuffle."""
    c = _checked(centroids)
    unit = c / np.linalg.norm(c, axis=1, keepdims=True) if metric == "cosine" else c
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("list_id", T.IntegerType()), T.StructField("list_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch[vector], unit.shape[1])
            s = v @ unit.T
            if metric == "cosine":
                s /= np.linalg.norm(v, axis=1, keepdims=True)
            best = s.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(s[np.arange(len(s)), best])], names=[*batch.schema.names, "list_id", "list_score"])

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sums(rows: DataFrame, centroids: np.ndarray, metric: str, vector: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Per list the sum of its (for cosine, unit) vectors and their number, and the total loss.  Each task sends one row per list."""
    c = _checked(centroids)
    kind = "list_id int, n long, loss double, total array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, loss = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
        for batch in batches:
            v = _matrix(batch[vector], c.shape[1])
            if metric == "cosine":
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
            s = v @ c.T
            best = s.argmax(axis=1)
            np.add.at(total, best, v)
            n += np.bincount(best, minlength=len(c))
            loss += np.bincount(best, (1 - s[np.arange(len(s)), best]) if metric == "cosine" else -s[np.arange(len(s)), best], len(c))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)), pa.int32()), pa.array(n), pa.array(loss), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["list_id", "n", "loss", "total"])

    parts = rows.select(vector).mapInArrow(run, kind)
    each = parts.select("list_id", "n", "loss", F.posexplode("total").alias("i", "x")).groupBy("list_id", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    out, count, loss = np.zeros_like(c), np.zeros(len(c), np.int64), 0.0
    for r in each.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t"), F.first("n").alias("n"), F.first("loss").alias("loss")).toLocalIterator():
        out[r["list_id"]], count[r["list_id"]] = [t["x"] for t in r["t"]], r["n"]
        loss += r["loss"]
    return out, count, loss


def trained(rows: DataFrame, nlists: int, iterations: int = 20, seed: int = 42, metric: str = "cosine", restarts: int = 1, training_count: int | None = None, vector: str = "vector") -> np.ndarray:
    """Centroids by Lloyd's rounds; of several starts that of the least loss.

    Cosine: unit centroids, starts drawn with a weight of one less similarity
    to those drawn before, empty lists drawn anew.  Dot: means, distinct random
    starts.  A training sample of ``training_count`` rows is the smallest by a
    seeded hash.  Starts are drawn from at most ``64 * nlists`` such rows.
    """
    if training_count:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), vector)).limit(training_count)
    pool = np.array([r[0] for r in rows.select(vector).orderBy(F.xxhash64(F.lit(seed + 1), vector)).limit(64 * nlists).collect()], np.float64)
    if len(pool) < nlists:
        raise ValueError("more lists than vectors")
    if metric == "cosine":
        pool /= np.linalg.norm(pool, axis=1, keepdims=True)
    rng, best = np.random.default_rng(seed), (math.inf, None)
    for _ in range(restarts):
        if metric == "cosine":
            c = [pool[rng.integers(len(pool))]]
            far = np.maximum(0, 1 - pool @ c[0])
            while len(c) < nlists:
                p = far / far.sum() if far.sum() > 0 else None
                c.append(pool[rng.choice(len(pool), p=p)])
                far = np.minimum(far, np.maximum(0, 1 - pool @ c[-1]))
            c = np.array(c)
        else:
            c = pool[rng.permutation(len(pool))[:nlists]]
        loss = math.inf
        for _ in range(iterations):
            total, n, loss = _sums(rows, c, metric, vector)
            new = total.copy()
            size = np.linalg.norm(total, axis=1) if metric == "cosine" else n.astype(float)
            lost = (n == 0) | (size == 0)
            new[~lost] /= size[~lost, None]
            new[lost] = pool[rng.integers(len(pool), size=int(lost.sum()))]
            if np.array_equal(new, c):
                break
            c = new
        if loss < best[0] or best[1] is None:
            best = (loss, c)
    return best[1]


def centroid_table(spark, matrix: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(matrix)], "list_id int, centroid array<double>")


def list_statistics(rows: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """(list_id, centroid, size, radius): the widest angle of a list's rows to its centroid, plus 1e-6; pi for dot."""
    if metric == "cosine":
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("list_score"))))
        radius = F.least(F.lit(math.pi), F.max(angle) + 1e-6)
    else:
        radius = F.lit(math.pi)
    sizes = rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"), radius.alias("radius"))
    return centroids.join(sizes, "list_id", "left").select("list_id", "centroid", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("radius", F.lit(0.0)).alias("radius"))


def ranked_lists(queries: DataFrame, centroids: DataFrame, nprobe: int | None = None, routing: str = "cosine") -> DataFrame:
    """(query_id, list_id, distance, list_rank): the nearest lists of each query, ties to the lower list."""
    each = queries.select("query_id", "query").crossJoin(F.broadcast(centroids.select("list_id", "centroid")))
    each = each.select("query_id", "list_id", routing_distance(routing, F.col("query"), F.col("centroid")).alias("distance"))
    ranked = each.withColumn("list_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "list_id")))
    return ranked.where(F.col("list_rank") <= nprobe) if nprobe else ranked
