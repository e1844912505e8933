"""Retrieval evaluation as relational jobs: truth, recall, latency, sweeps, index diagnostics, roll-ups."""

from __future__ import annotations

import hashlib
import json
import math
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import exact, exact_fast
from .ivf import ranked_lists

#: Share of lists in the probe schedule beside the powers of two.
SHARES = (0.125, 0.25, 0.375, 0.5, 0.75)


# -- truth, recall, latency ---------------------------------------------------


def ground_truth(rows: DataFrame, queries: DataFrame, filters: dict[int, object] | None = None, k: int = 10, metric: str = "cosine", fast: bool = False) -> DataFrame:
    """(query_id, rank, position, score) of the exact answers; queries with equal filters run together."""
    run = exact_fast if fast else exact
    if not filters:
        return run(rows, queries, k, metric).select("query_id", "rank", "position", "score")
    groups: dict[object, list[int]] = {}
    for q, f in filters.items():
        groups.setdefault(f, []).append(q)
    out = None
    for f, ids in groups.items():
        part = run(rows, queries.where(F.col("query_id").isin(ids)), k, metric, f).select("query_id", "rank", "position", "score")
        out = part if out is None else out.unionByName(part)
    return out


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of true positions among the first k; with no truth 1 if nothing was found."""
    f = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("position").alias("f"))
    t = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("position").alias("t"))
    both = queries.select("query_id").join(f, "query_id", "left").join(t, "query_id", "left")
    none = F.array().cast("array<bigint>")
    hit, n = F.size(F.array_intersect(F.coalesce("f", none), F.coalesce("t", none))), F.size(F.coalesce("t", none))
    return both.select("query_id", F.when(n > 0, hit / n).when(F.col("f").isNull(), 1.0).otherwise(0.0).alias("recall"))


def same_truth(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two truths agree, and on how many queries."""
    x = a.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "position"))).alias("x"))
    y = b.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "position"))).alias("y"))
    return x.join(y, "query_id", "full").agg(F.coalesce(F.bool_and(F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("same"), F.count(F.lit(1)).alias("queries"))


def latency_summary(rows: DataFrame, ms: str = "latency_ms", by: tuple[str, ...] = ()) -> DataFrame:
    """Least, mean, nearest-rank p50 and p95, greatest."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {ms})")
    return rows.groupBy(*by).agg(F.min(ms).alias("min_ms"), F.avg(ms).alias("mean_ms"), disc(0.5).alias("p50_ms"), disc(0.95).alias("p95_ms"), F.max(ms).alias("max_ms"))


def percentile(column: str, p: float) -> Column:
    """With linear interpolation."""
    return F.expr(f"percentile({column}, {p})")


def queries_per_second(rows: DataFrame, ms: str = "latency_ms", by: tuple[str, ...] = ()) -> DataFrame:
    total = F.sum(ms)
    return rows.groupBy(*by).agg(F.when(F.count(ms) == 0, 0.0).when(total == 0, F.lit(float("inf"))).otherwise(1000.0 * F.count(ms) / total).alias("qps"))


def timed(action, repetitions: int = 2) -> list[float]:
    """Milliseconds of each call after one to warm up."""
    action()
    out = []
    for _ in range(repetitions):
        began = time.perf_counter_ns()
        action()
        out.append((time.perf_counter_ns() - began) / 1e6)
    return out


def bootstrap_interval(rows: DataFrame, column: str = "recall", samples: int = 2000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by resampling: each draw is a hash of sample, place and seed."""
    numbered = rows.select(F.col(column).alias("v"), (F.row_number().over(Window.orderBy(column)) - 1).alias("i"))
    n = rows.count()
    draws = rows.sparkSession.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place")).withColumn("i", F.pmod(F.xxhash64("sample", "place", F.lit(seed)), F.lit(n)).cast("int"))
    means = draws.join(F.broadcast(numbered), "i").groupBy("sample").agg(F.avg("v").alias("m"))
    low = (1 - confidence) / 2
    return means.agg(percentile("m", low).alias("low"), percentile("m", 1 - low).alias("high"))


def selectivity_bucket(s: Column) -> Column:
    return F.when(s <= 0.01, "rare").when(s < 0.1, "medium").otherwise("broad")


# -- index diagnostics ----------------------------------------------------------


def gini(df: DataFrame, column: str) -> DataFrame:
    """Gini coefficient of a column of one value for each list; 0 if all are 0."""
    ranked = df.select(F.col(column).cast("double").alias("x"), F.row_number().over(Window.orderBy(column)).alias("i"))
    r = ranked.agg(F.sum(F.col("i") * F.col("x")).alias("ix"), F.sum("x").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    return r.select(F.when(F.col("x") == 0, 0.0).otherwise(2 * F.col("ix") / (F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def index_diagnostics(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row on list sizes, quantisation loss, centroid similarity and radii."""
    from ..functions.vectors import score

    size = F.col("size").cast("double")
    sizes = statistics.agg(
        F.count(F.lit(1)).alias("lists"), F.sum("size").alias("vectors"), F.count_if(F.col("size") == 0).alias("empty_lists"), F.min("size").alias("min_size"), percentile("size", 0.5).alias("median_size"),
        percentile("size", 0.95).alias("p95_size"), F.max("size").alias("max_size"), F.avg(size).alias("mean_size"), (F.stddev_pop(size) / F.avg(size)).alias("size_cv"), (F.max(size) / F.avg(size)).alias("max_to_mean"),
        percentile("radius", 0.5).alias("median_radius"), percentile("radius", 0.95).alias("p95_radius"), F.max("radius").alias("max_radius"),
    )
    loss = rows.select((1 - F.col("list_score")).alias("l")).agg(F.avg("l").alias("mean_loss"), percentile("l", 0.5).alias("median_loss"), percentile("l", 0.95).alias("p95_loss"), F.max("l").alias("max_loss"))
    a, b = statistics.select(F.col("list_id").alias("x"), F.col("centroid").alias("cx")), statistics.select(F.col("list_id").alias("y"), F.col("centroid").alias("cy"))
    pairs = a.join(F.broadcast(b), F.col("x") < F.col("y")).select(score("cosine", F.col("cx"), F.col("cy")).alias("s"))
    near = pairs.agg(F.max("s").alias("max_centroid_similarity"), F.count_if(F.col("s") >= 0.999).alias("near_equal_pairs"))
    return sizes.crossJoin(loss).crossJoin(near).crossJoin(gini(statistics, "size").withColumnRenamed("gini", "size_gini"))


def routing_diagnostics(rows: DataFrame, centroids: DataFrame, queries: DataFrame, truth: DataFrame, metric: str = "cosine") -> DataFrame:
    """Per query: margin of the nearest lists, lists of the truth, probes that cover 50, 90, 95 and 100 % of it."""
    lists = ranked_lists(queries, centroids, routing=metric)
    margin = lists.where("list_rank <= 2").groupBy("query_id").agg(F.when(F.count(F.lit(1)) == 1, F.lit(float("inf"))).otherwise(F.max("distance") - F.min("distance")).alias("centroid_margin"))
    ranks = truth.join(rows.select("position", "list_id"), "position").join(lists.select("query_id", "list_id", "list_rank"), ["query_id", "list_id"])
    need = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY list_rank)")
    found = ranks.groupBy("query_id").agg(F.count_distinct("list_id").alias("truth_list_count"), need(0.5).alias("nprobe_50"), need(0.9).alias("nprobe_90"), need(0.95).alias("nprobe_95"), F.max("list_rank").alias("nprobe_100"))
    out = queries.select("query_id").join(margin, "query_id").join(found, "query_id", "left")
    return out.select("query_id", "centroid_margin", *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("truth_list_count", "nprobe_50", "nprobe_90", "nprobe_95", "nprobe_100")))


def probe_curve(rows: DataFrame, centroids: DataFrame, queries: DataFrame, truth: DataFrame, probes: list[int], matches: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """Per query and number of probes: share of the truth in the probed lists, and candidates."""
    sizes = rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))
    if matches is not None:
        sizes = sizes.join(matches.select("list_id", "matches"), "list_id")
    else:
        sizes = sizes.withColumn("matches", F.col("size"))
    hits = truth.join(rows.select("position", "list_id"), "position").groupBy("query_id", "list_id").agg(F.count(F.lit(1)).alias("hits"))
    each = ranked_lists(queries, centroids, routing=metric).join(F.broadcast(sizes), "list_id", "left").join(hits, ["query_id", "list_id"], "left").na.fill(0, ["size", "matches", "hits"])
    w = Window.partitionBy("query_id").orderBy("list_rank").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("query_id")
    truths = F.sum("hits").over(all_)
    out = each.select("query_id", F.col("list_rank").alias("nprobe"), F.sum("hits").over(w).alias("c"), truths.alias("t"), F.sum("size").over(w).alias("candidates_visited"), F.sum("matches").over(w).alias("matching_candidates"), F.sum("size").over(all_).alias("n"))
    out = out.where(F.col("nprobe").isin(probes))
    return out.select("query_id", "nprobe", F.when(F.col("t") == 0, 1.0).otherwise(F.col("c") / F.col("t")).alias("truth_list_recall"), "candidates_visited", "matching_candidates", (F.col("candidates_visited") / F.col("n")).alias("database_fraction"))


def probe_rollup(curve: DataFrame) -> DataFrame:
    """By (nprobe, bucket) and by nprobe over all buckets."""
    return curve.sparkSession.sql("""
        SELECT nprobe, coalesce(bucket, 'all') AS bucket, count(*) AS queries, avg(truth_list_recall) AS mean_recall, min(truth_list_recall) AS min_recall,
          percentile_disc(0.5) WITHIN GROUP (ORDER BY candidates_visited) AS p50_candidates, percentile_disc(0.95) WITHIN GROUP (ORDER BY candidates_visited) AS p95_candidates, avg(candidates_visited) AS mean_candidates
        FROM {curve} GROUP BY GROUPING SETS ((nprobe, bucket), (nprobe))""", curve=curve)


def probe_schedule(lists: int) -> list[int]:
    powers = {1 << k for k in range(lists.bit_length()) if 1 << k <= lists}
    return sorted(powers | {max(1, math.ceil(s * lists)) for s in SHARES} | {lists})


# -- sweeps ------------------------------------------------------------------------


def pareto_frontier(points: DataFrame) -> DataFrame:
    """Points (method, nprobe, recall, p50_ms, candidates_scored) that no faster point equals in recall."""
    order = Window.partitionBy("method").orderBy("p50_ms", F.desc("recall"), "candidates_scored")
    best = F.max("recall").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_b", best).where(F.col("_b").isNull() | (F.col("recall") > F.col("_b"))).drop("_b")


def best_at_recall(points: DataFrame, target: float) -> DataFrame:
    """Per method the fastest point of at least the target recall."""
    w = Window.partitionBy("method").orderBy("p50_ms", "candidates_scored", "nprobe")
    return points.where(F.col("recall") >= target).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def conservative_at_recall(points: DataFrame, target: float, factor: float = 2.0) -> DataFrame:
    """Per method the first point with ``factor`` times the probes of the best one, else the one with most probes."""
    wanted = best_at_recall(points, target).select("method", F.ceil(F.col("nprobe") * factor).alias("_w"))
    near = points.join(wanted, "method").withColumn("_ok", F.col("nprobe") >= F.col("_w"))
    order = Window.partitionBy("method").orderBy(F.desc("_ok"), F.when(F.col("_ok"), F.col("nprobe")).otherwise(-F.col("nprobe")))
    return near.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_ok", "_w")


def speed_up(points: DataFrame, baseline: str, candidate: str) -> DataFrame:
    p = points.groupBy().pivot("method", [baseline, candidate]).agg(F.first("p95_ms"))
    return p.select((F.col(baseline) / F.col(candidate)).alias("speed_up"), (F.col(baseline) / F.col(candidate) >= 1.15).alias("claimed"))


# -- roll-ups -------------------------------------------------------------------------


def experiment_rollup(runs: DataFrame, key: list[str]) -> DataFrame:
    """By configuration: recall and latency over seeds, wins, whether all passed, and the seeds."""
    return runs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("runs"), F.min("recall").alias("min_recall"), F.avg("recall").alias("mean_recall"), F.max("recall").alias("max_recall"), F.min("p95_ms").alias("min_p95"), F.median("p95_ms").alias("median_p95"),
        F.max("p95_ms").alias("max_p95"), F.count_if("won").alias("wins"), F.bool_and("passed").alias("all_passed"), F.array_join(F.array_sort(F.collect_list(F.col("seed").cast("string"))), ",").alias("seeds"),
    )


def claim_rollup(runs: DataFrame, key: list[str]) -> DataFrame:
    """By configuration: speed-up over the comparable runs alone."""
    ok = F.when(F.col("comparable"), F.col("speed_up"))
    return runs.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"), F.count_if("comparable").alias("comparable_runs"), F.coalesce(F.min(ok), F.lit(0.0)).alias("min_speed_up"), F.coalesce(F.avg(ok), F.lit(0.0)).alias("mean_speed_up"), F.coalesce(F.median(ok), F.lit(0.0)).alias("median_speed_up"))


def hybrid_stitch(exact_rows: DataFrame, ivf_rows: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Per (query_index, repetition): the exact measurement where the filter is rare, else that of the index."""
    e = exact_rows.select("query_index", "repetition", "selectivity", F.col("latency_ms").alias("e_ms"), F.col("recall").alias("e_recall"))
    i = ivf_rows.select("query_index", "repetition", F.col("latency_ms").alias("i_ms"), F.col("recall").alias("i_recall"))
    rare = F.col("selectivity") <= threshold
    return e.join(i, ["query_index", "repetition"]).select("query_index", "repetition", "selectivity", selectivity_bucket(F.col("selectivity")).alias("bucket"), F.when(rare, "exact").otherwise("ivf_prefilter").alias("method"), F.when(rare, F.col("e_ms")).otherwise(F.col("i_ms")).alias("latency_ms"), F.when(rare, F.col("e_recall")).otherwise(F.col("i_recall")).alias("recall"), "e_ms")


def stratified_split(df: DataFrame, stratum: str, key: str, train: float = 0.5, seed: int = 42) -> DataFrame:
    """Add ``split``: in each stratum the first ``floor(n * train)`` by a seeded hash are for training."""
    w = Window.partitionBy(stratum)
    place = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key))
    return df.withColumn("split", F.when(place <= F.floor(F.count(F.lit(1)).over(w) * train), "train").otherwise("test"))


def proportional_allocation(counts: dict[str, int], total: int) -> dict[str, int]:
    """Largest remainders; ties to the name."""
    whole = sum(counts.values())
    shares = {k: total * v / whole for k, v in counts.items()}
    out = {k: int(s) for k, s in shares.items()}
    for k in sorted(shares, key=lambda k: (-(shares[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def query_partitions(df: DataFrame, stratum: str, key: str, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """(key, stratum, partition) for as many queries of each partition as ``counts`` says, proportional to the strata.

    A stratum's rows are dealt in a seeded order: the first to the first
    partition, and so on; what is left is in none.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(F.col(stratum).cast("string")).count().collect()}
    if min(counts.values()) < 1 or sum(counts.values()) > sum(sizes.values()):
        raise ValueError("every partition needs queries, and there must be enough of them")
    left, edges = dict(sizes), []
    for name, n in counts.items():
        share = proportional_allocation({k: v for k, v in left.items() if v}, n)
        edges += [(name, k, sizes[k] - left[k], sizes[k] - left[k] + m) for k, m in share.items()]
        left = {k: v - share.get(k, 0) for k, v in left.items()}
    bounds = df.sparkSession.createDataFrame(edges, "partition string, _s string, _lo long, _hi long")
    order = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key)) - 1
    placed = df.select(key, stratum, F.col(stratum).cast("string").alias("_s"), order.alias("_n"))
    return placed.join(F.broadcast(bounds), "_s").where("_n >= _lo and _n < _hi").select(key, stratum, "partition")


def sealed(partitions: DataFrame, key: str, name: str = "confirmation") -> tuple[int, str]:
    """Number and digest of a partition's keys in order, to be published in their place."""
    row = partitions.where(F.col("partition") == name).agg(F.count(F.lit(1)), F.sha2(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ","), 256)).first()
    return row[0], row[1]


def validated_partitions(partitions: DataFrame, key: str, seal: tuple[int, str] | None = None, name: str = "confirmation") -> DataFrame:
    """The partitions, if no query is in two of them and the sealed one is what it was."""
    if not partitions.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("partitions overlap")
    if seal is not None and sealed(partitions, key, name) != tuple(seal):
        raise ValueError(f"the queries of {name} have changed")
    return partitions


def filter_selectivities(rows: DataFrame, filters: DataFrame, label: str = "label") -> DataFrame:
    """``filters`` (..., label) with the share of rows that has the label; 0 where none has."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    return filters.join(counts, label, "left").join(F.broadcast(total)).withColumn("selectivity", F.coalesce(F.col("_n") / F.col("_t"), F.lit(0.0))).drop("_n", "_t")


def last_measurements(rows: DataFrame, key: list[str], order: str = "repetition") -> DataFrame:
    """One row for each key: that of the last ``order``."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def benchmark_summary(rows: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Means over queries, and the latencies, of each method."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)")
    means = [F.avg(c).alias(f"average_{n}") for c, n in (("recall", "recall"), ("result_count", "results"), ("candidates_visited", "candidates_visited"), ("candidates_scored", "candidates_scored"), ("lists_probed", "lists_probed"))]
    return rows.groupBy(*by).agg(*means, disc(0.5).alias("p50_ms"), disc(0.95).alias("p95_ms"))


def experiment_summary(rows: DataFrame, key: list[str], target_recall: float = 0.9, claim: tuple[str, str] = ("ivf_postfilter", "filter_aware"), gate: float = 1.15) -> DataFrame:
    """One row for each configuration and method, beside the configuration's oracle method, planner regret and claim.

    The oracle is the fastest method of at least the target recall (by p95;
    ``auto`` is the planner's own and no candidate); regret is the p95 of
    ``auto`` over the oracle's; the claim compares two methods' p95.
    """
    executed = rows.groupBy(*key, "method").agg(F.array_join(F.array_sort(F.collect_set("selected_method")), ",").alias("executed_methods"))
    found = benchmark_summary(rows, (*key, "method")).join(executed, [*key, "method"])
    able = F.when((F.col("method") != "auto") & (F.col("average_recall") >= target_recall), F.struct("p95_ms", "method"))
    p95 = lambda name: F.max(F.when(F.col("method") == name, F.col("p95_ms")))
    whole = found.groupBy(*key).agg(F.min(able).alias("_o"), p95("auto").alias("_a"), (p95(claim[0]) / p95(claim[1])).alias("claim_speed_up"))
    whole = whole.select(*key, F.col("_o.method").alias("oracle_method"), (F.col("_a") / F.col("_o.p95_ms")).alias("planner_regret"), "claim_speed_up", F.coalesce(F.col("claim_speed_up") >= gate, F.lit(False)).alias("claim_passed"))
    return found.join(whole, key)


def fingerprint(config: dict) -> str:
    """Signature under which truths and sweeps are kept."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark, folder: str, config: dict, make) -> DataFrame:
    """The table kept under the fingerprint of ``config``, made if absent."""
    path = f"{folder}/{fingerprint(config)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
