from pyspark.sql import functions as F

from orvane.functions import vectors as V
from orvane.functions.predicates import Range
from orvane.operators import evaluation as E
from orvane.operators import ivf, search, sweeps
from orvane.sources import files


def test_sweep_to_contract(spark):
    rows = files.clustered(spark, 200, 8, 4, noise=0.2).withColumn("norm", V.norm(F.col("vector"))).withColumn("number", (F.col("position") % 10).cast("int"))
    matrix = ivf.trained(rows, 4, 4)
    rows = ivf.assigned_fast(rows, matrix).cache()
    stats = ivf.list_statistics(rows, ivf.centroid_table(spark, matrix)).cache()
    q = search.with_norm(rows.where("position % 40 = 0").select(F.col("position").alias("query_id"), F.col("vector").cast("array<double>").alias("query"))).cache()
    where = Range("number", 0, 4)
    truth = E.ground_truth(rows, q, {r[0]: where for r in q.select("query_id").collect()}, 5)
    points = sweeps.sweep(rows, stats, q, where, truth, [1, 4], ("ivf_prefilter",), 5, repetitions=1).cache()
    got = {r["nprobe"]: r for r in points.collect()}
    assert got[4]["recall"] == 1.0 and got[1]["candidates_scored"] < got[4]["candidates_scored"] == 100
    assert sweeps.selected_nprobe(points, "ivf_prefilter", 1.0, 4) == (4 if got[1]["recall"] < 1 else 2)
    assert sweeps.selected_nprobe(points, "exact", 1.0, 4) == 4
    c = sweeps.calibrated(points, "random", 0.5, 200, 4, 8)
    assert c.lookup("ivf_prefilter", "random", 0.5, 200, 4)[1].achieved
    replay = {r["multiplier"]: r["recall"] for r in sweeps.postfilter_replay(rows, stats, q, where, truth, 4, [1.0, 40.0], 5).collect()}
    assert replay[40.0] == 1.0 >= replay[1.0]
    out = sweeps.checked_contract(sweeps.Contract("ivf_prefilter", k=5), rows, stats, q.where("query_id < 100"), q.where("query_id >= 100"), where, 4)
    assert out["passed"] and 1 <= out["nprobe"] <= 4


def test_hybrid_validation(spark):
    e = spark.createDataFrame([(i, 1, 0.005 if i < 5 else 0.5, 10.0, 1.0) for i in range(10)], ["query_index", "repetition", "selectivity", "latency_ms", "recall"])
    i = e.withColumns({"latency_ms": F.lit(2.0), "recall": F.lit(0.9)})
    got = {r["bucket"]: r for r in sweeps.hybrid_validation(e, i).collect()}
    assert got["rare"]["speed_up"] == 1.0 and got["broad"]["speed_up"] == 5.0 and got["all"]["n"] == 10
