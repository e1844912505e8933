"""Measured sweeps over strategies and probes, and what is chosen from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import compiled
from ..plans.planner import Calibration, CalibrationEntry
from . import evaluation as E
from . import search
from .ivf import ranked_lists
from .topk import top_k_each

METHODS = ("exact", "ivf", "ivf_prefilter", "ivf_postfilter", "filter_aware", "filter_aware_bound")
POINT = "method string, nprobe int, recall double, min_recall double, p50_ms double, p95_ms double, candidates_scored double, queries long"


def answered(method: str, rows, statistics, queries, where, k: int, nprobe: int, metric: str = "cosine", oversample: int = 10) -> DataFrame:
    """The answers of one strategy at a number of probes."""
    if method == "exact":
        return search.exact(rows, queries, k, metric, where)
    if method == "ivf":
        return search.ivf(rows, statistics, queries, k, nprobe, metric)
    if method == "ivf_prefilter":
        return search.ivf_prefilter(rows, statistics, queries, where, k, nprobe, metric)
    if method == "ivf_postfilter":
        return search.ivf_postfilter(rows, statistics, queries, where, k, nprobe, metric, oversample)
    if method == "filter_aware":
        return search.filter_aware(rows, statistics, queries, where, k, nprobe, metric)
    if method == "filter_aware_bound":
        return search.bound_search(rows, statistics, queries, where, k, nprobe)
    raise ValueError(f"no method {method}")


def candidates(rows, statistics, queries, where, nprobe: int, metric: str = "cosine") -> DataFrame:
    """(query_id, candidates_visited, candidates_scored): rows of the nearest lists, and those that match."""
    matches = search.list_matches(rows, statistics, where)
    lists = ranked_lists(queries, statistics, nprobe, metric).join(F.broadcast(matches), "list_id")
    return lists.groupBy("query_id").agg(F.sum("size").alias("candidates_visited"), F.sum("matches").alias("candidates_scored"))


def sweep(rows, statistics, queries, where, truth, probes: list[int], methods=METHODS[2:], k: int = 10, metric: str = "cosine", repetitions: int = 2) -> DataFrame:
    """A point for each method and number of probes: recall, batch latency for each query, candidates.

    The batch is one job, so a query's latency is the job's share.
    """
    spark, points, n = rows.sparkSession, [], queries.count()
    for method in methods:
        for p in probes:
            run = lambda: answered(method, rows, statistics, queries, where, k, p, metric)  # noqa: B023, E731
            ms = sorted(t / n for t in E.timed(lambda: run().write.format("noop").mode("overwrite").save(), repetitions))  # noqa: B023
            r = E.recall(run(), truth, queries, k).agg(F.avg("recall"), F.min("recall")).first()
            c = candidates(rows, statistics, queries, where, p, metric).agg(F.avg("candidates_scored")).first()[0]
            rank = lambda q: ms[max(0, math.ceil(q * len(ms)) - 1)]  # noqa: B023, E731
            points.append((method, p, r[0], r[1], rank(0.5), rank(0.95), float(c or 0), n))
    return spark.createDataFrame(points, POINT)


def postfilter_replay(rows, statistics, queries, where, truth, nprobe: int, multipliers: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """(multiplier, recall) of post-filters that cut after ``k * multiplier`` rows: ranked once, replayed for each."""
    most = math.ceil(k * max(multipliers))
    ranked = top_k_each(search._probed(rows, ranked_lists(queries, statistics, nprobe, metric), queries, metric), most, rank="place").withColumn("hit", compiled(where, rows.schema)).cache()
    out = None
    for m in sorted(multipliers):
        kept = ranked.where((F.col("place") <= math.ceil(k * m)) & F.col("hit")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= k)
        part = E.recall(kept, truth, queries, k).agg(F.lit(float(m)).alias("multiplier"), F.avg("recall").alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out


def selected_nprobe(points: DataFrame, method: str, target: float, lists: int, factor: float = 2.0) -> int:
    """The first probes that reach the target in training, times a safety factor; all lists if none does."""
    first = points.where((F.col("method") == method) & (F.col("recall") >= target)).agg(F.min("nprobe")).first()[0]
    return lists if first is None else min(lists, math.ceil(first * factor))


def calibrated(points: DataFrame, workload: str, selectivity: float, vectors: int, lists: int, dim: int, metric: str = "cosine", targets=(0.9, 0.95), base: Calibration | None = None) -> Calibration:
    """Entries for every swept method and target: the fastest point that reaches it, else the one of best recall."""
    out = base or Calibration()
    for method in [r[0] for r in points.select("method").distinct().orderBy("method").collect()]:
        own = points.where(F.col("method") == method)
        for target in targets:
            best = E.best_at_recall(own, target).first()
            got = best or own.orderBy(F.desc("recall"), "nprobe").first()
            out = out.with_entry(CalibrationEntry(method, workload, selectivity, vectors, lists, dim, metric, 2, target, got["nprobe"], got["recall"], best is not None, got["p95_ms"]))
    return out


@dataclass(frozen=True)
class Contract:
    """A frozen gate: recall on held-out queries at the probes chosen in training."""

    method: str
    min_recall: float = 0.85
    max_p95_ms: float | None = None
    k: int = 10
    factor: float = 2.0


def checked_contract(contract: Contract, rows, statistics, train, held_out, where, lists: int, metric: str = "cosine") -> dict:
    """Choose probes on the training queries, judge on the others."""
    truth = E.ground_truth(rows, train, None if where is None else {r[0]: where for r in train.select("query_id").collect()}, contract.k, metric)
    points = sweep(rows, statistics, train, where, truth, E.probe_schedule(lists), (contract.method,), contract.k, metric, 1)
    nprobe = selected_nprobe(points, contract.method, contract.min_recall, lists, contract.factor)
    held = E.ground_truth(rows, held_out, None if where is None else {r[0]: where for r in held_out.select("query_id").collect()}, contract.k, metric)
    final = sweep(rows, statistics, held_out, where, held, [nprobe], (contract.method,), contract.k, metric).first()
    passed = final["recall"] >= contract.min_recall and (contract.max_p95_ms is None or final["p95_ms"] <= contract.max_p95_ms)
    return {"nprobe": nprobe, "recall": final["recall"], "p95_ms": final["p95_ms"], "passed": passed}


def hybrid_validation(exact_rows: DataFrame, ivf_rows: DataFrame, threshold: float = 0.01) -> DataFrame:
    """By bucket and over all: recall and p95 of the hybrid, and its speed-up over exact search."""
    h = E.hybrid_stitch(exact_rows, ivf_rows, threshold)
    return h.sparkSession.sql("""
        SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, avg(recall) AS recall, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms,
          percentile_disc(0.95) WITHIN GROUP (ORDER BY e_ms) / percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS speed_up
        FROM {h} GROUP BY GROUPING SETS ((bucket), ())""", h=h)
