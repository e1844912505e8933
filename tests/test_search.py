import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orvane.functions import vectors as V
from orvane.functions.predicates import Eq, Range
from orvane.operators import evaluation as E
from orvane.operators import ivf, search
from orvane.operators.topk import top_k
from orvane.sources import files


def rows_of(spark, vectors, **meta):
    data = [(i, [float(x) for x in v], *(m[i] for m in meta.values())) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, ["position", "vector", *meta])
    return df.withColumn("norm", V.norm(F.col("vector")))


def answers(df):
    return [r["position"] for r in df.orderBy("query_id", "rank").collect()]


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], ["a", "b"])
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.squared_distance(F.col("a"), F.col("b")).alias("l"), V.norm(F.col("b")).alias("n")).first()
    assert (r["d"], r["l"], r["n"]) == (11.0, 8.0, 5.0)
    zero = spark.createDataFrame([([0.0, 0.0], [1.0])], ["a", "b"])
    for bad in (V.cosine(F.col("a"), F.col("a")), V.dot(F.col("a"), F.col("b")), V.normalized(F.col("a"))):
        with pytest.raises(PySparkException):
            zero.select(bad).collect()


def test_admission(spark):
    cases = [([1.0, 0.0], True), ([0.0, 0.0], False), ([1.0], False), ([1.0, math.nan], False), ([1.0, 1e39], False), ([math.inf, 1.0], False), (None, False)]
    df = spark.createDataFrame(cases, "v array<double>, ok boolean")
    assert all(r[0] == r[1] for r in df.select(V.admissible(F.col("v"), 2, "cosine"), "ok").collect())


def test_exact(spark):
    rows = rows_of(spark, [(1, 0), (0, 1), (-1, 0)], name=["right", "up", "left"])
    q = search.query_table(spark, [[1, 0]])
    assert answers(search.exact(rows, q, 2)) == [0, 1]
    assert answers(search.exact(rows, q, 2, where={"name": "up"})) == [1]
    assert answers(search.exact(rows, q, 2, where={"name": "missing"})) == []


def test_top_k_order(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([math.nan, 1.0, math.nan, 0.5])], ["position", "score"])
    assert [r["position"] for r in top_k(df, 4).collect()] == [0, 2, 1, 3]
    with pytest.raises(ValueError):
        top_k(df, 5, strict=True)
    with pytest.raises(ValueError):
        top_k(df, 0)


def test_post_and_prefilter(spark):
    rows = rows_of(spark, [(1, 0), (0.9, 0), (0.8, 0), (0.7, 0)], allowed=[False, False, True, True]).withColumn("list_id", F.lit(0))
    c = spark.createDataFrame([(0, [1.0, 0.0])], "list_id int, centroid array<double>")
    q = search.query_table(spark, [[1, 0]])
    assert answers(search.ivf_postfilter(rows, c, q, {"allowed": True}, 2, 1, "dot", 1)) == []
    assert answers(search.ivf_postfilter(rows, c, q, {"allowed": True}, 2, 1, "dot", 2)) == [2, 3]
    assert answers(search.ivf_prefilter(rows, c, q, {"allowed": True}, 2, 1, "dot")) == [2, 3]
    assert search.postfilter_oversample(10, 0.0) == 10 and search.postfilter_oversample(10, 0.1) == 40


def test_filter_aware_ranking(spark):
    rows = rows_of(spark, [(-1, 0), (-0.9, 0.1), (0.9, 0.1), (1, 0)], allowed=[False, False, True, True]).withColumn("list_id", (F.col("position") >= 2).cast("int"))
    c = spark.createDataFrame([(0, [-1.0, 0.0]), (1, [1.0, 0.0])], "list_id int, centroid array<double>")
    q = search.query_table(spark, [[-1, 0]])
    m = search.list_matches(rows, c, {"allowed": True})
    first = lambda v, f: search.ranked_filter_aware(q, c, m, 1, v, f).first()["list_id"]
    assert (first(1.0, 0.0), first(0.0, 1.0)) == (0, 1)
    found = search.filter_aware(rows, c, q, {"allowed": True}, 2, 1, vector_weight=1.0, filter_weight=0.0, adaptive=True, max_nprobe=2)
    assert sorted(answers(found)) == [2, 3]


@pytest.fixture(scope="module")
def clustered(spark):
    rows = files.clustered(spark, 400, 12, 6, noise=0.05).withColumn("norm", V.norm(F.col("vector"))).withColumn("number", (F.col("position") % 10).cast("int")).cache()
    matrix = ivf.trained(rows, 6, 8)
    placed = ivf.assigned_fast(rows, matrix).cache()
    stats = ivf.list_statistics(placed, ivf.centroid_table(spark, matrix)).cache()
    q = search.with_norm(rows.where("position % 40 = 0").select(F.col("position").alias("query_id"), F.col("vector").cast("array<double>").alias("query"))).cache()
    return placed, stats, q


def test_all_lists_and_bounds_are_exact(spark, clustered):
    placed, stats, q = clustered
    where = Range("number", 2, 6)
    want = answers(search.exact(placed, q, 5, where=where))
    assert answers(search.exact_fast(placed, q, 5, where=where)) == want
    assert sorted(answers(search.ivf(placed, stats, q, 5, 6, where=where))) == sorted(want)
    assert answers(search.bound_search(placed, stats, q, where, 5)) == want
    assert answers(search.bound_search_progressive(placed, stats, q, where, 5)) == want


def test_bounds_hold_and_stop(spark, clustered):
    placed, stats, q = clustered
    lists = search.ranked_bounds(q, stats, search.list_matches(placed, stats, None))
    scored = placed.crossJoin(q).withColumn("s", V.score("cosine", F.col("query"), F.col("vector")))
    assert scored.join(lists, ["query_id", "list_id"]).where("s > bound + 1e-9").isEmpty()
    where = Range("number", 0, 9)
    got = {r["query_id"]: r for r in search.bound_search_stats(placed, stats, q, where, 5).collect()}
    # the same stops, found list by list
    order = {}
    for r in search.ranked_bounds(q, stats, search.list_matches(placed, stats, where)).orderBy("query_id", "list_rank").collect():
        order.setdefault(r["query_id"], []).append((r["list_id"], r["bound"]))
    scores = {}
    for r in scored.select("query_id", "list_id", "s").collect():
        scores.setdefault((r["query_id"], r["list_id"]), []).append(r["s"])
    for query, ranked in order.items():
        seen, stopped, probed = [], False, 0
        for k, (number, _) in enumerate(ranked):
            probed += 1
            seen = sorted(seen + scores[query, number], reverse=True)
            rest = max((b for _, b in ranked[k + 1 :]), default=-math.inf)
            if len(seen) >= 5 and rest < seen[4]:
                stopped = True
                break
        assert (got[query]["probed_lists"], got[query]["stopped_by_bound"]) == (probed, stopped)
    assert min(r["probed_lists"] for r in got.values()) < 6


def test_dot_training_and_routing(spark, clustered):
    placed, _, q = clustered
    matrix = ivf.trained(placed.drop("list_id", "list_score"), 4, 4, metric="dot")
    assert matrix.shape == (4, 12) and np.isfinite(matrix).all()
    with pytest.raises(ValueError):
        ivf.trained(placed.limit(3), 4)


def test_recall_and_truth(spark, clustered):
    placed, stats, q = clustered
    truth = E.ground_truth(placed, q, None, 5)
    assert {r["recall"] for r in E.recall(truth, truth, q, 5).collect()} == {1.0}
    assert E.same_truth(truth, E.ground_truth(placed, q, None, 5, fast=True)).first()["same"]
    none = truth.limit(0)
    assert {r["recall"] for r in E.recall(none, none, q, 5).collect()} == {1.0}
    assert {r["recall"] for r in E.recall(truth, none, q, 5).collect()} == {0.0}
    ids = [r[0] for r in q.select("query_id").collect()]
    mixed = E.ground_truth(placed, q, {i: Eq("number", i % 3) for i in ids}, 5)
    assert mixed.join(placed.select("position", "number"), "position").where("number <> query_id % 3").isEmpty()
    low, high = E.bootstrap_interval(spark.createDataFrame([(x / 10,) for x in range(11)], ["recall"]), samples=200).first()
    assert 0.2 < low < 0.5 < high < 0.8


def test_small_evaluation_pieces(spark):
    assert E.probe_schedule(10) == [1, 2, 3, 4, 5, 8, 10]
    assert E.proportional_allocation({"a": 1, "b": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert E.gini(spark.createDataFrame([(0,), (0,)], ["x"]), "x").first()[0] == 0.0
    assert len(E.timed(lambda: None)) == 2
    split = E.stratified_split(spark.range(20).withColumn("s", F.col("id") % 2), "s", "id")
    assert {(r["s"], r["split"]): r["count"] for r in split.groupBy("s", "split").count().collect()} == {(0, "train"): 5, (0, "test"): 5, (1, "train"): 5, (1, "test"): 5}


def test_assignment_keeps_repeated_rows_and_agrees(spark):
    """Both assignments agree, with ties to the lower list, and rows that are all alike stay."""
    import numpy as np

    from orvane.operators import ivf

    r = np.random.default_rng(2)
    rows = [(i // 2, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(7, [1.0, 0.0, 0.0, 0.0])] * 3
    df = spark.createDataFrame(rows, "position long, vector array<float>")
    centroids = np.array([[1, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1], [-1, -1, 0, 0]], float)
    slow = ivf.assigned(df, ivf.centroid_table(spark, centroids))
    fast = ivf.assigned_fast(df, centroids)
    key = lambda x: sorted((r["position"], r["vector"], r["list_id"], round(r["list_score"], 9)) for r in x.collect())
    assert key(slow) == key(fast) and slow.count() == 63
    assert slow.where("position = 7 and list_score > 0.999").select("list_id").distinct().collect()[0][0] == 0


def test_queries_in_blocks_and_tiles(spark, monkeypatch):
    import numpy as np

    from orvane.functions.vectors import norm

    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in r.normal(size=6)]) for i in range(80)], "position long, vector array<float>").withColumn("norm", norm(F.col("vector")))
    q = search.query_table(spark, r.normal(size=(17, 6)).tolist())
    want = sorted(map(tuple, search.exact(rows, q, 5).select("query_id", "rank", "position").collect()))
    monkeypatch.setattr(search, "BLOCK_VALUES", 30)
    monkeypatch.setattr(search, "TILE_SCORES", 50)
    assert len(search.query_blocks(q)) == 4
    for f in (search.exact, search.exact_fast):
        assert sorted(map(tuple, f(rows, q, 5).select("query_id", "rank", "position").collect())) == want


def test_a_stored_index_reads_the_probed_lists_only(spark, tmp_path):
    """The scan of a list-partitioned index has a partition filter and pushed predicates."""
    df = spark.range(200).selectExpr("id as position", "array(cast(id as float), 1f) as vector", "1.0d as norm", "cast(id % 7 as int) as label", "cast(id % 10 as int) as list_id")
    df.write.partitionBy("list_id").parquet(str(tmp_path / "rows"))
    held = spark.read.parquet(str(tmp_path / "rows"))
    probes = spark.createDataFrame([(0, 3, 1), (0, 5, 2)], "query_id long, list_id int, list_rank int").where("list_rank <= 2")
    q = search.query_table(spark, [[1.0, 0.0]])
    from orvane.functions.predicates import Eq, compiled

    plan = search._probed(held.where(compiled(Eq("label", 3), held.schema, settle=False)), probes, q, "cosine")._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x and "list_id" in x)
    assert "dynamicpruning" in scan.split("PartitionFilters")[1] and "EqualTo(label,3)" in scan


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_list_search_by_matrix_products(spark, monkeypatch, metric):
    """The same rows and doubles as the plain forms, with copies, ties between lists, rows without a norm and small tiles."""
    r = np.random.default_rng(6)
    vectors = [r.integers(-2, 3, 6).tolist() for _ in range(40)] + r.normal(size=(40, 6)).tolist()
    vectors = [[float(x) for x in v] if any(v) else [1.0] * 6 for v in vectors] * 3
    data = [(i, v, i % 7, None if i % 11 == 0 else i % 4) for i, v in enumerate(vectors)] + [(500, None, 1, 1), (501, None, 2, 2)]
    rows = spark.createDataFrame(data, "position long, vector array<float>, label int, list_id int").withColumn("norm", V.norm(F.col("vector")))
    c = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in (0, 1, 2, 3, None)], "list_id int, centroid array<double>")
    q = search.with_norm(rows.where("position % 9 = 0").select(F.col("position").alias("query_id"), F.col("vector").cast("array<double>").alias("query")))
    got = lambda df: sorted(map(tuple, df.select("query_id", "rank", "position", "score").collect()))
    where = {"label": 1}
    known = rows.where("list_id is not null")
    for tile in (search.TILE_SCORES, 50):
        monkeypatch.setattr(search, "TILE_SCORES", tile)
        monkeypatch.setattr(search, "PAIRS", tile)
        monkeypatch.setattr(search, "BLOCK_VALUES", tile * 4)
        assert got(search.ivf_fast(rows, c, q, 5, None, metric)) == got(search.exact(rows, q, 5, metric))
    assert got(search.ivf_fast(rows, c, q, 60, None, metric, where)) == got(search.exact(rows, q, 60, metric, where))
    assert got(search.ivf_fast(known, c, q, 5, 2, metric)) == got(search.ivf(known, c, q, 5, 2, metric))
    bad = search.with_norm(spark.createDataFrame([(1, None)], "query_id long, query array<double>"))
    assert got(search.ivf_fast(rows, c, q.unionByName(bad), 5, None, metric)) == got(search.exact(rows, q.unionByName(bad), 5, metric))
    assert got(search.ivf_fast(rows.limit(0), c, q, 5)) == got(search.ivf_fast(rows, c, q.limit(0), 5)) == []


def test_all_lists_of_the_query_are_all_rows(spark, tmp_path):
    """More than ten lists, and equal scores in several of them, come out as in SQL; no row is scored one pair at a time."""
    import duckdb

    from orvane.plans import catalog

    r = np.random.default_rng(8)
    vectors = np.eye(8)[r.integers(0, 8, 400)] + np.eye(8)[r.integers(0, 8, 400)]
    data = [(i, [float(x) for x in v], int(r.integers(0, 14))) for i, v in enumerate(vectors)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalog.queries()["ivf_all_lists_equals_exact"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["ivf_all_lists_equals_exact"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
