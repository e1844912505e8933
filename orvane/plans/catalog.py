"""Registered vector-search queries and their DuckDB counterparts.

The index of the checkable queries is seeded: the centroid of list j is the
vector of the smallest vec_id with label j.  Batch queries are the rows whose
vec_id is divisible by 20; latencies are made from ids, so that they repeat.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.predicates import And, Eq, In, Not, Or, Range, compiled, selectivity, value_postings
from ..operators import evaluation as E
from ..operators import ivf, search
from ..operators.topk import merged_top_k, top_k
from . import planner

K = 10
WHERE = In("label", [1, 3, 5])


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"), V.norm(F.col("embedding")).alias("norm"), "label")


def _queries(spark, d, every=20):
    q = _table(spark, d, "embeddings").where(F.col("vec_id") % every == 0)
    return search.with_norm(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query")))


def _one(spark, d):
    return search.with_norm(_table(spark, d, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query")))


def _placed(spark, d):
    rows = _rows(spark, d)
    centroids = ivf.seeded_centroids(rows, "label")
    return ivf.assigned(rows, centroids), centroids


#: Index folders by application and tables: an index is built once and read by list.
_BUILT: dict[tuple[str, str], str] = {}


def _index(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not shared:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="orvane-")
        path = f"{shared}/orvane-lists-{uuid.uuid4().hex}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
        placed, centroids = _placed(spark, d)
        # large lists are several files
        placed.repartition("list_id", F.pmod(F.xxhash64("position"), F.lit(4))).write.partitionBy("list_id").parquet(f"{path}/rows")
        schema = placed.schema
        ivf.list_statistics(spark.read.schema(schema).parquet(f"{path}/rows"), centroids).write.parquet(f"{path}/lists")
        _BUILT[key] = path
    path = _BUILT[key]
    kind = "position long, vector array<float>, norm double, label int, list_score double, list_id int"
    return spark.read.schema(kind).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists")


def _found(df):
    return df.select("query_id", "rank", "position", "score")


# -- exact search and predicates ---------------------------------------------------


def _exact_single(where=None, metric="cosine"):
    def run(spark, d):
        rows = _rows(spark, d)
        left = rows.where(compiled(where, rows.schema, settle=False)) if where is not None else rows
        scored = left.crossJoin(F.broadcast(_one(spark, d))).withColumn("score", V.score(metric, F.col("query"), F.col("vector"), F.col("query_norm"), F.col("norm")))
        return top_k(scored.select("position", "label", "score"), K)

    return run


DOT = "list_dot_product(q.v, e.v)"
COS = "list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))"
BASE = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0)"""


def _sql_single(where="true", score=COS):
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 0)
    SELECT e.vec_id AS position, label, {score} AS score FROM e, q WHERE {where} ORDER BY score DESC, position LIMIT {K}"""


def _sql_batch(where="true", score=COS):
    return f"""{BASE}, s AS (SELECT query_id, vec_id AS position, {score} AS score FROM e, q WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, position, score FROM r WHERE rank <= {K}"""


def batch(metric="cosine", where=None, fast=False):
    return lambda spark, d: _found((search.exact_fast if fast else search.exact)(_rows(spark, d), _queries(spark, d), K, metric, where))


def batch_per_query_filter(spark, d):
    q = _queries(spark, d)
    ids = [r[0] for r in q.select("query_id").collect()]  # the batch of queries, not the rows
    return E.ground_truth(_rows(spark, d), q, {i: (Eq("label", 3) if i % 40 == 0 else Range("label", 2, 6)) for i in ids}, K)


def filter_events(where, *cols):
    def run(spark, d):
        df = _table(spark, d, "events")
        return df.where(compiled(where, df.schema, settle=False)).select(*cols)

    return run


TREE = And(Or(Eq("event_type", "purchase"), Eq("event_type", "click")), Not(Range("value", 10.0, 50.0)), Not(Eq("absent", 1)))
DAYS = Range("ts", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 12, 6))


def range_lineitem(spark, d):
    df = _table(spark, d, "lineitem")
    return df.where(compiled(And(Range("l_quantity", 10, 20), Eq("l_returnflag", "R")), df.schema)).select("l_orderkey", "l_linenumber", "l_quantity")


# -- metrics -------------------------------------------------------------------------


def vector_norms(spark, d):
    return _rows(spark, d).select("position", "norm")


def normalized_dot(spark, d):
    rows = _rows(spark, d)
    n = V.normalized(F.col("vector"))
    return rows.select("position", F.round(V.score("dot", n, n), 9).alias("self_dot"), F.element_at(n, 1).alias("first_value"))


def pairwise_l2(spark, d):
    each = _rows(spark, d).crossJoin(F.broadcast(_queries(spark, d)))
    return each.groupBy("position").agg(F.min(V.squared_distance(F.col("query"), F.col("vector"))).alias("nearest_l2"))


# -- inverted file ----------------------------------------------------------------------

INDEX = f"""{BASE}, c AS (SELECT label AS list_id, first(v ORDER BY vec_id) AS v FROM e GROUP BY label),
a0 AS (SELECT e.vec_id, e.v, e.label, c.list_id, list_dot_product(e.v, c.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.v, c.v))) AS list_score FROM e, c),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY list_score DESC, list_id) AS n FROM a0) WHERE n = 1),
st AS (SELECT c.list_id, c.v, count(a.vec_id) AS size, coalesce(least(pi(), max(acos(greatest(-1, least(1, a.list_score)))) + 1e-6), 0) AS radius FROM c LEFT JOIN a USING (list_id) GROUP BY ALL),
l AS (SELECT query_id, list_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, list_id) AS list_rank FROM
  (SELECT query_id, list_id, 1 - list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS distance FROM q, c)),
m AS (SELECT c.list_id, count(a.vec_id) AS size, count(*) FILTER (a.label IN (1, 3, 5)) AS matches, CASE WHEN count(a.vec_id) > 0 THEN count(*) FILTER (a.label IN (1, 3, 5)) / count(a.vec_id) ELSE 0 END AS density FROM c LEFT JOIN a USING (list_id) GROUP BY c.list_id)"""


def _sql_probe(where="true", lists="SELECT query_id, list_id, list_rank FROM l WHERE list_rank <= 3", k=K, more=""):
    score = COS.replace("e.v", "a.v")
    return f"""{INDEX}{more}, p AS ({lists}), s AS (SELECT p.query_id, a.vec_id AS position, a.label, list_rank, {score} AS score FROM p JOIN a USING (list_id) JOIN q ON q.query_id = p.query_id WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_rank, position) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, position, score FROM r WHERE rank <= {k}"""


def ivf_assign(spark, d):
    return _placed(spark, d)[0].select("position", "list_id", "list_score")


def ivf_statistics(spark, d):
    return _index(spark, d)[1].select("list_id", F.col("size").cast("long").alias("size"), F.round("radius", 6).alias("radius"))


def ivf_rank_lists(spark, d):
    return ivf.ranked_lists(_queries(spark, d), _index(spark, d)[1]).select("query_id", "list_id", "distance", "list_rank")


def ivf_search(nprobe, where=None, post=False):
    def run(spark, d):
        rows, stats = _index(spark, d)
        q = _queries(spark, d)
        if post:
            return _found(search.ivf_postfilter(rows, stats, q, where, K, nprobe, oversample=2))
        return _found(search.ivf(rows, stats, q, K, nprobe, where=where))

    return run


def ivf_all_lists(spark, d):
    rows, stats = _index(spark, d)
    return _found(search.ivf_fast(rows, stats, _queries(spark, d), K))


SQL_POST = f"""{INDEX}, s AS (SELECT l.query_id, a.vec_id AS position, a.label, list_rank, {COS.replace("e.v", "a.v")} AS score FROM l JOIN a USING (list_id) JOIN q ON q.query_id = l.query_id WHERE list_rank <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_rank, position) AS n FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM r WHERE n <= {2 * K} AND label IN (1, 3, 5))
SELECT query_id, rank::INTEGER AS rank, position, score FROM f WHERE rank <= {K}"""


def list_density(spark, d):
    rows, stats = _index(spark, d)
    return search.list_matches(rows, stats, WHERE)


def filter_concentration(spark, d):
    return search.concentration(list_density(spark, d)).select(F.round("concentration", 9).alias("concentration"))


def _aware(adaptive):
    def run(spark, d):
        rows, stats = _index(spark, d)
        return _found(search.filter_aware(rows, stats, _queries(spark, d), WHERE, K, 2, adaptive=adaptive, max_nprobe=6 if adaptive else None))

    return run


def rank_filter_aware(spark, d):
    rows, stats = _index(spark, d)
    out = search.ranked_filter_aware(_queries(spark, d), stats, search.list_matches(rows, stats, WHERE), 2)
    return out.select("query_id", "list_id", F.round("mark", 9).alias("mark"), "list_rank")


def _sql_aware(pool, nprobe):
    return f""", pool AS (SELECT l.*, m.matches, m.density FROM l JOIN m USING (list_id) WHERE list_rank <= {pool}),
    sc AS (SELECT *, min(distance) OVER w AS d0, max(distance) OVER w AS d1, min(density) OVER w AS f0, max(density) OVER w AS f1 FROM pool WINDOW w AS (PARTITION BY query_id)),
    mk AS (SELECT query_id, list_id, matches, list_rank AS near_rank, 0.5::DOUBLE * (1 - CASE WHEN d1 > d0 THEN (distance - d0) / (d1 - d0) ELSE 0 END) + 0.5::DOUBLE * CASE WHEN f1 > f0 THEN (density - f0) / (f1 - f0) ELSE 0 END AS mark FROM sc),
    aw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mark DESC, near_rank) AS list_rank FROM mk) WHERE list_rank <= {nprobe})"""


ADAPTIVE = f"SELECT query_id, list_id, list_rank FROM (SELECT *, coalesce(sum(matches) OVER (PARTITION BY query_id ORDER BY list_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM aw) WHERE list_rank <= 2 OR b < {4 * K}"

STOPS = f"""bb AS (SELECT *, coalesce(max(bound) OVER (PARTITION BY query_id ORDER BY list_rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -10) AS rest FROM b),
sc AS (SELECT b.query_id, b.list_rank, {COS.replace("e.v", "a.v")} AS score FROM b JOIN a USING (list_id) JOIN q ON q.query_id = b.query_id WHERE a.label IN (1, 3, 5)),
tk AS (SELECT bb.query_id, bb.list_rank AS r, rest, score, row_number() OVER (PARTITION BY bb.query_id, bb.list_rank ORDER BY score DESC) AS n FROM bb JOIN sc ON sc.query_id = bb.query_id AND sc.list_rank <= bb.list_rank),
so AS (SELECT query_id, min(r) AS stop FROM tk WHERE n = {K} AND rest < score GROUP BY query_id), al AS (SELECT query_id, max(list_rank) AS lists FROM b GROUP BY query_id),
pb AS (SELECT q.query_id, coalesce(stop, lists, 0) AS probed, stop IS NOT NULL AS stopped, coalesce(lists, 0) AS lists FROM q LEFT JOIN al USING (query_id) LEFT JOIN so USING (query_id))
SELECT query_id, coalesce(sum(matches) FILTER (list_rank <= probed), 0)::BIGINT AS visited, coalesce(sum(matches) FILTER (list_rank <= probed), 0)::BIGINT AS scored, any_value(probed)::INTEGER AS probed_lists, any_value(stopped) AS stopped_by_bound, any_value(stopped OR probed = lists) AS exact
FROM pb LEFT JOIN b USING (query_id) GROUP BY query_id"""

#: The planner's constants, as its configuration has them by default.
_C = planner.Config()
PLAN = f""", k0 AS (SELECT sum(size)::DOUBLE AS n, sum(matches)::DOUBLE AS bm, count(*) AS lists, CASE WHEN sum(matches) = 0 THEN 0 ELSE least(1, greatest(0, (sum(matches * matches) / (sum(matches) * sum(matches)) - 1 / count(*) FILTER (size > 0)) / (1 - 1 / count(*) FILTER (size > 0)))) END AS uneven FROM m),
k1 AS (SELECT *, bm / n AS share, least({_C.max_nprobe}, lists) AS most FROM k0), k2 AS (SELECT *, CASE WHEN bm = 0 THEN most ELSE least(most, greatest(1, ceil(ceil({K} * {_C.candidate_multiplier} / {_C.target_recall}::DOUBLE) / (n * share / lists)))) END AS even FROM k1),
k3 AS (SELECT *, least(most, ceil(even / greatest(0.1, 1 - uneven))) AS needed, greatest(1, ceil(even * (1 - {_C.filter_aware_gain} * uneven))) AS aware, least(1, share * (1 + uneven * (lists - 1))) AS density, n / lists AS mean, lists * 64 * {_C.centroid_cost}::DOUBLE AS routing FROM k2),
k4 AS (SELECT *, least(n, ceil(needed * mean)) AS seen, least(n, ceil(least({_C.default_nprobe}, aware) * mean)) AS aware_seen FROM k3),
pc AS (SELECT 1 AS o, 'exact' AS strategy, ceil(n / 64) * {_C.check_cost}::DOUBLE + bm * 64 * {_C.score_cost} AS cost, 0 AS low, 0 AS high, share FROM k4
UNION ALL SELECT 2, 'ivf_prefilter', routing + seen * {_C.check_cost} + least(bm, ceil(seen * share)) * 64 * {_C.score_cost}, needed, needed, share FROM k4 UNION ALL SELECT 3, 'ivf_postfilter', routing + seen * 64 * {_C.score_cost}, needed, needed, share FROM k4
UNION ALL SELECT 4, 'filter_aware', routing + lists * {_C.check_cost} + aware_seen * {_C.check_cost} + least(bm, ceil(aware_seen * density)) * 64 * {_C.score_cost}, least({_C.default_nprobe}, aware), greatest(aware, needed), share FROM k4
UNION ALL SELECT 5, 'filter_aware_bound', routing + lists * {_C.check_cost} + least(bm, ceil(needed * mean * density)) * 64 * {_C.score_cost}, 1, needed, share FROM k4)"""

BOUNDS = """, b0 AS (SELECT query_id, st.list_id, m.matches, radius, greatest(-1, least(1, list_dot_product(q.v, st.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(st.v, st.v))))) AS cs FROM q, st JOIN m USING (list_id) WHERE m.matches > 0),
b1 AS (SELECT query_id, list_id, matches, CASE WHEN cs >= cos(radius) THEN 1 ELSE least(1, cs * cos(radius) + sqrt(1 - cs * cs) * sin(radius) + 2e-6) END AS bound FROM b0),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, matches DESC, list_id) AS list_rank FROM b1)"""


def list_bounds(spark, d):
    rows, stats = _index(spark, d)
    out = search.ranked_bounds(_queries(spark, d), stats, search.list_matches(rows, stats, WHERE))
    return out.select("query_id", "list_id", F.col("matches").cast("long").alias("matches"), F.round("bound", 6).alias("bound"))


def bound_search(spark, d):
    rows, stats = _index(spark, d)
    return _found(search.bound_search(rows, stats, _queries(spark, d), WHERE, K))


def bound_stats(spark, d):
    rows, stats = _index(spark, d)
    return search.bound_search_stats(rows, stats, _queries(spark, d), WHERE, K)


def bound_progressive(spark, d):
    rows, stats = _index(spark, d)
    return _found(search.bound_search_progressive(rows, stats, _queries(spark, d), WHERE, K))


# -- planner ------------------------------------------------------------------------------


def _statistics(spark, d):
    rows, stats = _index(spark, d)
    uneven = search.concentration(search.list_matches(rows, stats, WHERE)).first()[0]
    return planner.statistics(rows, compiled(WHERE, rows.schema), stats.count(), 64, "cosine", uneven)


def plan_costs(spark, d):
    found = planner.costs(_statistics(spark, d), K, planner.Config())
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in found.items() if k in planner.STRATEGIES], "strategy string, cost double")


def plan_choice(spark, d):
    return planner.explained(spark, planner.choose(_statistics(spark, d), True, K)).withColumns({"cost": F.round("cost", 6), "selectivity": F.round("selectivity", 9)})


def calibrated_nprobe(spark, d):
    entries = [planner.CalibrationEntry("ivf_prefilter", w, s, n, 16, 64, "cosine", 2, 0.9, p, 0.95, True) for w, s, n, p in (("random", 0.3, 500, 3), ("random", 0.01, 500, 12), ("skewed", 0.3, 2000, 5))]
    c = planner.Calibration(tuple(entries))
    n = _rows(spark, d).count()
    out = [(w, s, c.lookup("ivf_prefilter", w, s, n, 10, 64)[0]) for w in ("random", "skewed") for s in (0.25, 0.02)]
    return spark.createDataFrame(out, "workload string, selectivity double, nprobe int")


# -- versions and segments ---------------------------------------------------------------------


def _history(spark, d):
    """Revision 1 puts all rows, 2 replaces every third by its neighbour's vector, 3 deletes every seventh."""
    e = _table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    two = e.where("vec_id % 3 = 0").select("vec_id", "embedding", (F.col("label") + 10).alias("label"))
    three = e.where("vec_id % 7 = 0").select("vec_id", "embedding", "label")
    each = [df.withColumns({"revision": F.lit(n), "op": F.lit(op)}) for n, op, df in ((1, "PUT", e), (2, "PUT", two), (3, "DELETE", three))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def latest(spark, d):
    newest = _history(spark, d).groupBy("vec_id").agg(F.max_by(F.struct("op", "label", "revision"), "revision").alias("r"))
    return newest.where("r.op = 'PUT'").select("vec_id", "r.label", "r.revision")


def tombstone_anti_join(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", "label")
    gone = _history(spark, d).where("op = 'DELETE'").select("vec_id")
    return e.join(gone, "vec_id", "left_anti")


def segment_merge(spark, d):
    rows, q = _rows(spark, d), _queries(spark, d)
    parts = [search.exact(rows.where(f"position % 3 = {i}"), q, K) for i in range(3)]
    return _found(merged_top_k(parts, K))


def maintenance_counts(spark, d):
    h = _history(spark, d).groupBy("vec_id").agg(F.max("revision").alias("r"), F.max_by("op", "revision").alias("op"))
    return h.agg(F.count_if((F.col("op") == "PUT") & (F.col("r") == 1)).alias("base"), F.count_if((F.col("op") == "PUT") & (F.col("r") > 1)).alias("delta"), F.count_if(F.col("op") == "DELETE").alias("tombstones"))


HISTORY = """WITH h AS (SELECT vec_id, label, 1 AS revision, 'PUT' AS op FROM embeddings UNION ALL SELECT vec_id, label + 10, 2, 'PUT' FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label, 3, 'DELETE' FROM embeddings WHERE vec_id % 7 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY revision DESC) AS k FROM h) WHERE k = 1)"""


# -- evaluation ---------------------------------------------------------------------------------


def _truth(spark, d):
    return E.ground_truth(_rows(spark, d), _queries(spark, d), None, K)


def recall_at_k(spark, d):
    return E.recall(ivf_search(3)(spark, d), _truth(spark, d), _queries(spark, d), K)


def routing(spark, d):
    rows, stats = _index(spark, d)
    return E.routing_diagnostics(rows, stats, _queries(spark, d), _truth(spark, d))


def probe_curve(spark, d):
    rows, stats = _index(spark, d)
    return E.probe_curve(rows, stats, _queries(spark, d), _truth(spark, d), E.probe_schedule(10), search.list_matches(rows, stats, WHERE))


def probe_rollup(spark, d):
    out = E.probe_rollup(probe_curve(spark, d).withColumn("bucket", F.when(F.col("query_id") % 40 == 0, "rare").otherwise("broad")))
    return out.select("nprobe", "bucket", "queries", F.round("mean_recall", 9).alias("mean_recall"), "min_recall", F.col("p50_candidates").cast("long").alias("p50_candidates"), F.col("p95_candidates").cast("long").alias("p95_candidates"), F.round("mean_candidates", 6).alias("mean_candidates"))


def _measured(spark, d):
    """A latency, recall and selectivity for each vector, from its id."""
    i = F.col("vec_id")
    return _table(spark, d, "embeddings").select("vec_id", "label", ((i * 7919) % 1000 / 10.0).alias("latency_ms"), (1 - (i * 31) % 7 / 20.0).alias("recall"), ((i * 17) % 100 / 1000.0).alias("selectivity"))


MEASURED = "WITH x AS (SELECT vec_id, label, (vec_id * 7919) % 1000 / 10.0::DOUBLE AS latency_ms, 1 - (vec_id * 31) % 7 / 20.0::DOUBLE AS recall, (vec_id * 17) % 100 / 1000.0::DOUBLE AS selectivity FROM embeddings)"


def latency(spark, d):
    return E.latency_summary(_measured(spark, d), by=("label",)).withColumn("mean_ms", F.round("mean_ms", 6))


def qps(spark, d):
    return E.queries_per_second(_measured(spark, d), by=("label",)).withColumn("qps", F.round("qps", 6))


def _points(spark, d):
    i = F.col("vec_id")
    return _table(spark, d, "embeddings").select(F.concat(F.lit("m"), (i % 4).cast("string")).alias("method"), i.alias("nprobe"), (0.5 + (i * 37) % 101 / 202.0).alias("recall"), ((i * 53) % 211 / 10.0).alias("p50_ms"), ((i * 53) % 311 / 10.0).alias("p95_ms"), (i * 3 % 17).alias("candidates_scored"))


POINTS = "WITH p AS (SELECT 'm' || (vec_id % 4) AS method, vec_id AS nprobe, 0.5::DOUBLE + (vec_id * 37) % 101 / 202.0::DOUBLE AS recall, (vec_id * 53) % 211 / 10.0::DOUBLE AS p50_ms, (vec_id * 53) % 311 / 10.0::DOUBLE AS p95_ms, vec_id * 3 % 17 AS candidates_scored FROM embeddings)"


def _runs(spark, d):
    i = F.col("vec_id")
    return _measured(spark, d).select(F.col("label").alias("config"), i.alias("seed"), "recall", F.col("latency_ms").alias("p95_ms"), (i % 3 == 0).alias("won"), (F.col("recall") > 0.7).alias("passed"), (i % 2 == 0).alias("comparable"), (1 + F.col("selectivity")).alias("speed_up"))


def rollup(spark, d):
    return E.experiment_rollup(_runs(spark, d), ["config"]).withColumn("mean_recall", F.round("mean_recall", 9))


def claims(spark, d):
    return E.claim_rollup(_runs(spark, d), ["config"]).withColumn("mean_speed_up", F.round("mean_speed_up", 9))


def hybrid(spark, d):
    m = _measured(spark, d).select(F.col("vec_id").alias("query_index"), F.lit(1).alias("repetition"), "selectivity", "latency_ms", "recall")
    return E.hybrid_stitch(m, m.withColumns({"latency_ms": F.col("latency_ms") / 2, "recall": F.col("recall") - 0.1})).drop("e_ms")


def gini_sizes(spark, d):
    sizes = _table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return E.gini(sizes, "n").select(F.round("gini", 9).alias("gini"))


def index_report(spark, d):
    rows, stats = _index(spark, d)
    r = E.index_diagnostics(rows, stats)
    return r.select("lists", "vectors", "empty_lists", "min_size", "median_size", "p95_size", "max_size", *(F.round(c, 6).alias(c) for c in ("mean_size", "size_cv", "size_gini", "mean_loss", "max_loss", "max_radius", "max_centroid_similarity")), "near_equal_pairs")


TERMS = ("the", "and", "of", "ion", "que", "der", "ich", "ent", "la", "in")


def semantic_search(spark, d):
    """Texts embedded by counts of ten terms, searched for a text of their own kind; texts without a term have no direction."""
    text = F.lower(F.coalesce("text", F.lit("")))
    v = F.array(*(F.regexp_count(text, F.lit(t)).cast("double") for t in TERMS))
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("position"), v.alias("vector")).where(F.exists("vector", lambda x: x > 0)).withColumn("norm", V.norm(F.col("vector")))
    q = search.query_table(spark, [[2, 1, 1, 0, 0, 0, 0, 0, 0, 1]])
    return _found(search.exact(docs, q, K))


# -- rows only ---------------------------------------------------------------------------------------


def kmeans_train(spark, d):
    rows = _rows(spark, d)
    matrix = ivf.trained(rows, 8, 10)
    stats = ivf.list_statistics(ivf.assigned_fast(rows, matrix), ivf.centroid_table(spark, matrix))
    return stats.select("list_id", "size", "radius")


def bootstrap_ci(spark, d):
    return E.bootstrap_interval(_measured(spark, d), samples=500)


def stratified_split(spark, d):
    return E.stratified_split(_rows(spark, d), "label", "position").select("position", "label", "split")


def query_partitions(spark, d):
    """A tenth of all queries for development, a twentieth for validation and a tenth for confirmation, by label."""
    rows = _rows(spark, d)
    n = rows.count()
    found = E.query_partitions(rows, "label", "position", {"development": n // 10, "validation": n // 20, "confirmation": n // 10})
    return E.validated_partitions(found, "position").groupBy("partition").agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("label").alias("strata"))


def filter_selectivities(spark, d):
    filters = _queries(spark, d).select("query_id", (F.col("query_id") % 12).cast("int").alias("label"))
    return E.filter_selectivities(_rows(spark, d), filters)


def _experiment(spark, d):
    """Two measurements of each query and method, of which the last counts, from its id."""
    i, method = F.col("vec_id"), F.element_at(F.array(*map(F.lit, ("auto", "exact", "ivf_postfilter", "filter_aware"))), (F.col("vec_id") % 4 + 1).cast("int"))
    runs = _table(spark, d, "embeddings").crossJoin(spark.range(2).select((F.col("id") + 1).alias("repetition")))
    return runs.select(
        F.col("label").alias("config"), method.alias("method"), F.floor(i / 4).alias("query_index"), "repetition", F.when(method == "auto", F.when(i % 8 == 0, "exact").otherwise("filter_aware")).otherwise(method).alias("selected_method"),
        (((i * 7919) % 1000 + 1) / 10.0 * F.col("repetition")).alias("latency_ms"), (1 - (i * 31) % 7 / 40.0).alias("recall"), (i % 11).alias("result_count"), (i % 101).alias("candidates_visited"), (i % 53).alias("candidates_scored"), (i % 5).alias("lists_probed"),
    )


EXPERIMENT = """WITH x AS (SELECT label AS config, ['auto', 'exact', 'ivf_postfilter', 'filter_aware'][vec_id % 4 + 1] AS method, CASE WHEN vec_id % 4 <> 0 THEN ['auto', 'exact', 'ivf_postfilter', 'filter_aware'][vec_id % 4 + 1] WHEN vec_id % 8 = 0 THEN 'exact' ELSE 'filter_aware' END AS selected_method,
((vec_id * 7919) % 1000 + 1) / 10.0::DOUBLE * 2 AS latency_ms, 1 - (vec_id * 31) % 7 / 40.0::DOUBLE AS recall, vec_id % 11 AS r, vec_id % 101 AS v, vec_id % 53 AS s, vec_id % 5 AS l FROM embeddings)"""
MEANS = "round(avg(recall), 9) AS average_recall, round(avg(r), 9) AS average_results, round(avg(v), 9) AS average_candidates_visited, round(avg(s), 9) AS average_candidates_scored, round(avg(l), 9) AS average_lists_probed, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms"


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if c.startswith(("average_", "planner_", "claim_speed")) else c for c in df.columns))


def benchmark_summary(spark, d):
    return _rounded(E.benchmark_summary(E.last_measurements(_experiment(spark, d), ["config", "method", "query_index"])))


def experiment_summary(spark, d):
    return _rounded(E.experiment_summary(E.last_measurements(_experiment(spark, d), ["config", "method", "query_index"]), ["config"], 0.9))


def index_and_search(spark, d):
    """A trained index, searched with the fewest probes whose curve over the queries reaches a recall of 0.9."""
    rows, q = _rows(spark, d).cache(), _queries(spark, d)
    matrix = ivf.trained(rows, 8, 10)
    placed, centroids = ivf.assigned_fast(rows, matrix).cache(), ivf.centroid_table(spark, matrix)
    curve = E.probe_curve(placed, centroids, q, E.ground_truth(rows, q, None, K, fast=True), list(range(1, 9)))
    enough = [r["nprobe"] for r in curve.groupBy("nprobe").agg(F.avg("truth_list_recall").alias("r")).where("r >= 0.9").collect()]
    return _found(search.ivf(placed, centroids, q, K, min(enough, default=8)))


_WHERES = {
    "eq": (Eq("label", 3), "label = 3"), "in": (WHERE, "label IN (1, 3, 5)"), "range": (Range("label", 2, 5), "label BETWEEN 2 AND 5"),
    "and": (And(Range("label", 2, 8), Not(Eq("label", 5))), "label BETWEEN 2 AND 8 AND label <> 5"), "or": (Or(Eq("label", 1), Eq("label", 9)), "label IN (1, 9)"),
    "not": (Not(WHERE), "label NOT IN (1, 3, 5)"), "empty_and": (And(), "true"), "absent_field": (Not(Eq("colour", "red")), "true"), "string_on_number": (Or(Eq("label", "3"), Eq("label", 4)), "label = 4"),
}


def queries():
    out = {"exact_topk_cosine": _exact_single(), "exact_topk_dot": _exact_single(metric="dot")}
    out |= {f"exact_topk_{n}": _exact_single(w) for n, (w, _) in _WHERES.items()}
    return out | {
        "filter_eq_string": filter_events(Eq("event_type", "purchase"), "event_id", "user_id"), "filter_range_numeric": range_lineitem, "filter_range_datetime": filter_events(DAYS, "event_id", "value"), "filter_bool_tree": filter_events(TREE, "event_id", "event_type", "value"),
        "filter_selectivity": lambda s, d: selectivity(_table(s, d, "events"), TREE), "filter_value_postings": lambda s, d: value_postings(_table(s, d, "events"), "event_type"),
        "batch_topk_cosine": batch(), "batch_topk_dot": batch("dot"), "batch_topk_fast": batch(fast=True), "batch_topk_filtered": batch(where=WHERE), "batch_topk_per_query_filter": batch_per_query_filter,
        "vector_norms": vector_norms, "vector_normalize_check": normalized_dot, "pairwise_l2": pairwise_l2,
        "ivf_assign": ivf_assign, "ivf_list_statistics": ivf_statistics, "ivf_rank_lists": ivf_rank_lists, "ivf_search": ivf_search(3), "ivf_prefilter": ivf_search(3, WHERE), "ivf_postfilter": ivf_search(3, WHERE, True), "ivf_all_lists_equals_exact": ivf_all_lists,
        "list_filter_density": list_density, "filter_concentration": filter_concentration, "rank_filter_aware": rank_filter_aware, "filter_aware_search": _aware(False), "filter_aware_adaptive": _aware(True),
        "list_score_bounds": list_bounds, "bound_search": bound_search, "bound_search_stats": bound_stats, "bound_search_progressive": bound_progressive,
        "plan_costs": plan_costs, "plan_choice": plan_choice, "calibrated_nprobe": calibrated_nprobe,
        "latest_wins_view": latest, "visible_ids": lambda s, d: latest(s, d).select("vec_id"), "tombstone_anti_join": tombstone_anti_join, "segment_merge_topk": segment_merge, "maintenance_counts": maintenance_counts,
        "recall_at_k": recall_at_k, "routing_diagnostics": routing, "probe_curve": probe_curve, "probe_curve_rollup": probe_rollup, "latency_summary": latency, "queries_per_second": qps,
        "pareto_frontier": lambda s, d: E.pareto_frontier(_points(s, d)), "best_at_recall": lambda s, d: E.best_at_recall(_points(s, d), 0.9), "conservative_at_recall": lambda s, d: E.conservative_at_recall(_points(s, d), 0.9),
        "experiment_rollup": rollup, "claim_rollup": claims, "hybrid_stitch": hybrid, "gini_list_sizes": gini_sizes, "index_diagnostics": index_report, "semantic_search_stub": semantic_search,
        "kmeans_train": kmeans_train, "bootstrap_ci": bootstrap_ci, "stratified_split": stratified_split, "index_and_search": index_and_search,
        "query_partitions": query_partitions, "filter_selectivities": filter_selectivities, "benchmark_summary": benchmark_summary, "experiment_summary": experiment_summary,
    }


def oracle_sql():
    out = {"exact_topk_cosine": _sql_single(), "exact_topk_dot": _sql_single(score=DOT)}
    out |= {f"exact_topk_{n}": _sql_single(w) for n, (_, w) in _WHERES.items()}
    tree = "event_type IN ('purchase', 'click') AND NOT coalesce(value BETWEEN 10 AND 50, false)"
    curve = f"""{INDEX}, t AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, vec_id) AS n FROM e, q) WHERE n <= {K}),
    hits AS (SELECT query_id, list_id, count(*) AS hits FROM t JOIN a USING (vec_id) GROUP BY ALL),
    g AS (SELECT query_id, list_rank AS nprobe, sum(coalesce(hits, 0)) OVER w AS c, sum(coalesce(hits, 0)) OVER (PARTITION BY query_id) AS t, sum(size) OVER w AS v, sum(matches) OVER w AS mc, sum(size) OVER (PARTITION BY query_id) AS n
      FROM l JOIN m USING (list_id) LEFT JOIN hits USING (query_id, list_id) WINDOW w AS (PARTITION BY query_id ORDER BY list_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    cu AS (SELECT query_id, nprobe::INTEGER AS nprobe, CASE WHEN t = 0 THEN 1 ELSE c / t END AS truth_list_recall, v::BIGINT AS candidates_visited, mc::BIGINT AS matching_candidates, v / n AS database_fraction FROM g WHERE nprobe IN ({", ".join(map(str, E.probe_schedule(10)))}))"""
    return out | {
        "filter_eq_string": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'", "filter_range_numeric": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'",
        "filter_range_datetime": "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-12 06:00:00'", "filter_bool_tree": f"SELECT event_id, event_type, value FROM events WHERE {tree}",
        "filter_selectivity": f"SELECT count(*) FILTER ({tree}) AS matches, count(*) AS total, count(*) FILTER ({tree}) / count(*) AS selectivity FROM events",
        "filter_value_postings": "SELECT event_type AS value, count(*) AS n, ceil((SELECT count(*) FROM events) / 8) <= 8 * count(*) AS dense FROM events GROUP BY event_type",
        "batch_topk_cosine": _sql_batch(), "batch_topk_dot": _sql_batch(score=DOT), "batch_topk_fast": _sql_batch(), "batch_topk_filtered": _sql_batch("label IN (1, 3, 5)"), "batch_topk_per_query_filter": _sql_batch("CASE WHEN query_id % 40 = 0 THEN label = 3 ELSE label BETWEEN 2 AND 6 END"),
        "vector_norms": "SELECT vec_id AS position, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings",
        "vector_normalize_check": "SELECT vec_id AS position, round(1.0::DOUBLE, 9) AS self_dot, embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS first_value FROM embeddings",
        "pairwise_l2": f"{BASE} SELECT vec_id AS position, min(list_reduce([0::DOUBLE] || list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, x: a + x)) AS nearest_l2 FROM e, q GROUP BY vec_id",
        "ivf_assign": f"{INDEX} SELECT vec_id AS position, list_id, list_score FROM a", "ivf_list_statistics": f"{INDEX} SELECT list_id, size, round(radius, 6) AS radius FROM st", "ivf_rank_lists": f"{INDEX} SELECT query_id, list_id, distance, list_rank::INTEGER AS list_rank FROM l",
        "ivf_search": _sql_probe(), "ivf_prefilter": _sql_probe("a.label IN (1, 3, 5)"), "ivf_postfilter": SQL_POST, "ivf_all_lists_equals_exact": _sql_batch(),
        "list_filter_density": f"{INDEX} SELECT list_id, size, matches, density FROM m",
        "filter_concentration": f"{INDEX} SELECT round(CASE WHEN sum(matches) = 0 THEN 0 ELSE least(1, greatest(0, (sum(matches * matches) / (sum(matches) * sum(matches)) - 1 / count(*) FILTER (size > 0)) / (1 - 1 / count(*) FILTER (size > 0)))) END, 9) AS concentration FROM m",
        "rank_filter_aware": f"{INDEX}{_sql_aware(8, 2)} SELECT query_id, list_id, round(mark, 9) AS mark, list_rank::INTEGER AS list_rank FROM aw",
        "filter_aware_search": _sql_probe("a.label IN (1, 3, 5)", "SELECT query_id, list_id, list_rank FROM aw", more=_sql_aware(8, 2)), "filter_aware_adaptive": _sql_probe("a.label IN (1, 3, 5)", ADAPTIVE, more=_sql_aware(24, 6)),
        "list_score_bounds": f"{INDEX}{BOUNDS} SELECT query_id, list_id, matches, round(bound, 6) AS bound FROM b", "bound_search": _sql_batch("label IN (1, 3, 5)"), "bound_search_progressive": _sql_batch("label IN (1, 3, 5)"),
        "bound_search_stats": f"{INDEX}{BOUNDS}, {STOPS}", "plan_costs": f"{INDEX}{PLAN} SELECT strategy, round(cost, 6) AS cost FROM pc",
        "plan_choice": f"{INDEX}{PLAN} SELECT CASE WHEN strategy = 'exact' THEN 'prefilter_exact' ELSE strategy END AS strategy, 'least cost' AS reason, round(cost, 6) AS cost, round(share, 9) AS selectivity, low::INTEGER AS nprobe, high::INTEGER AS max_nprobe FROM pc WHERE o < 5 ORDER BY cost, o LIMIT 1",
        "stratified_split": "SELECT vec_id AS position, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.5) THEN 'train' ELSE 'test' END AS split FROM embeddings",
        "filter_selectivities": "SELECT f.vec_id AS query_id, (f.vec_id % 12)::INTEGER AS label, coalesce((SELECT count(*) FROM embeddings e WHERE e.label = f.vec_id % 12) / (SELECT count(*) FROM embeddings), 0) AS selectivity FROM embeddings f WHERE f.vec_id % 20 = 0",
        "benchmark_summary": f"{EXPERIMENT} SELECT method, {MEANS} FROM x GROUP BY method",
        "experiment_summary": f"""{EXPERIMENT}, g AS (SELECT config, method, {MEANS}, avg(recall) AS rc, string_agg(DISTINCT selected_method, ',' ORDER BY selected_method) AS executed_methods FROM x GROUP BY config, method),
        o AS (SELECT config, min_by(method, p95_ms) FILTER (method <> 'auto' AND rc >= 0.9) AS oracle_method, round(max(p95_ms) FILTER (method = 'auto') / min(p95_ms) FILTER (method <> 'auto' AND rc >= 0.9), 9) AS planner_regret, max(p95_ms) FILTER (method = 'ivf_postfilter') / max(p95_ms) FILTER (method = 'filter_aware') AS su FROM g GROUP BY config)
        SELECT g.* EXCLUDE (rc), oracle_method, planner_regret, round(su, 9) AS claim_speed_up, coalesce(su >= 1.15, false) AS claim_passed FROM g JOIN o USING (config)""",
        "latest_wins_view": f"{HISTORY} SELECT vec_id, label, revision FROM n WHERE op = 'PUT'", "visible_ids": f"{HISTORY} SELECT vec_id FROM n WHERE op = 'PUT'", "tombstone_anti_join": "SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0",
        "segment_merge_topk": _sql_batch().replace("ORDER BY score DESC, position", "ORDER BY score DESC, position % 3, position"),
        "maintenance_counts": f"{HISTORY} SELECT count(*) FILTER (op = 'PUT' AND revision = 1) AS base, count(*) FILTER (op = 'PUT' AND revision > 1) AS delta, count(*) FILTER (op = 'DELETE') AS tombstones FROM n",
        "recall_at_k": f"""{INDEX}, s AS (SELECT q.query_id, a.vec_id, list_rank, {COS.replace("e.v", "a.v")} AS score FROM q JOIN l ON l.query_id = q.query_id JOIN a USING (list_id)),
        t AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= {K}), f AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_rank, vec_id) AS n FROM s WHERE list_rank <= 3) WHERE n <= {K})
        SELECT t.query_id, count(f.vec_id) / count(*) AS recall FROM t LEFT JOIN f USING (query_id, vec_id) GROUP BY t.query_id""",
        "routing_diagnostics": f"""{INDEX}, t AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, vec_id) AS n FROM e, q) WHERE n <= {K}), k AS (SELECT t.query_id, list_id, list_rank FROM t JOIN a USING (vec_id) JOIN l USING (query_id, list_id)),
        g AS (SELECT query_id, max(distance) - min(distance) AS centroid_margin FROM l WHERE list_rank <= 2 GROUP BY query_id)
        SELECT query_id, any_value(centroid_margin) AS centroid_margin, count(DISTINCT list_id) AS truth_list_count, quantile_disc(list_rank, 0.5)::BIGINT AS nprobe_50, quantile_disc(list_rank, 0.9)::BIGINT AS nprobe_90, quantile_disc(list_rank, 0.95)::BIGINT AS nprobe_95, max(list_rank)::BIGINT AS nprobe_100 FROM k JOIN g USING (query_id) GROUP BY query_id""",
        "probe_curve": f"{curve} SELECT * FROM cu",
        "probe_curve_rollup": f"""{curve}, cb AS (SELECT *, CASE WHEN query_id % 40 = 0 THEN 'rare' ELSE 'broad' END AS bucket FROM cu)
        SELECT nprobe, coalesce(bucket, 'all') AS bucket, count(*) AS queries, round(avg(truth_list_recall), 9) AS mean_recall, min(truth_list_recall) AS min_recall, quantile_disc(candidates_visited, 0.5) AS p50_candidates, quantile_disc(candidates_visited, 0.95) AS p95_candidates, round(avg(candidates_visited), 6) AS mean_candidates FROM cb GROUP BY GROUPING SETS ((nprobe, bucket), (nprobe))""",
        "latency_summary": f"{MEASURED} SELECT label, min(latency_ms) AS min_ms, round(avg(latency_ms), 6) AS mean_ms, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, max(latency_ms) AS max_ms FROM x GROUP BY label",
        "queries_per_second": f"{MEASURED} SELECT label, round(1000.0 * count(*) / sum(latency_ms), 6) AS qps FROM x GROUP BY label",
        "pareto_frontier": f"{POINTS}, o AS (SELECT *, max(recall) OVER (PARTITION BY method ORDER BY p50_ms, recall DESC, candidates_scored ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p) SELECT * EXCLUDE (b) FROM o WHERE b IS NULL OR recall > b",
        "best_at_recall": f"{POINTS} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY p50_ms, candidates_scored, nprobe) AS r FROM p WHERE recall >= 0.9) WHERE r = 1",
        "conservative_at_recall": f"""{POINTS}, w AS (SELECT method, ceil(nprobe * 2.0) AS w FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY p50_ms, candidates_scored, nprobe) AS r FROM p WHERE recall >= 0.9) WHERE r = 1)
        SELECT * EXCLUDE (r, w) FROM (SELECT p.*, w, row_number() OVER (PARTITION BY p.method ORDER BY p.nprobe >= w DESC, CASE WHEN p.nprobe >= w THEN p.nprobe ELSE -p.nprobe END) AS r FROM p JOIN w USING (method)) WHERE r = 1""",
        "experiment_rollup": f"{MEASURED} SELECT label AS config, count(*) AS runs, min(recall) AS min_recall, round(avg(recall), 9) AS mean_recall, max(recall) AS max_recall, min(latency_ms) AS min_p95, median(latency_ms) AS median_p95, max(latency_ms) AS max_p95, count(*) FILTER (vec_id % 3 = 0) AS wins, bool_and(recall > 0.7) AS all_passed, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id::VARCHAR) AS seeds FROM x GROUP BY label",
        "claim_rollup": f"{MEASURED} SELECT label AS config, count(*) AS runs, count(*) FILTER (vec_id % 2 = 0) AS comparable_runs, coalesce(min(1 + selectivity) FILTER (vec_id % 2 = 0), 0) AS min_speed_up, round(coalesce(avg(1 + selectivity) FILTER (vec_id % 2 = 0), 0), 9) AS mean_speed_up, coalesce(median(1 + selectivity) FILTER (vec_id % 2 = 0), 0) AS median_speed_up FROM x GROUP BY label",
        "hybrid_stitch": f"{MEASURED} SELECT vec_id AS query_index, 1 AS repetition, selectivity, CASE WHEN selectivity <= 0.01 THEN 'rare' WHEN selectivity < 0.1 THEN 'medium' ELSE 'broad' END AS bucket, CASE WHEN selectivity <= 0.01 THEN 'exact' ELSE 'ivf_prefilter' END AS method, CASE WHEN selectivity <= 0.01 THEN latency_ms ELSE latency_ms / 2 END AS latency_ms, CASE WHEN selectivity <= 0.01 THEN recall ELSE recall - 0.1::DOUBLE END AS recall FROM x",
        "gini_list_sizes": "WITH s AS (SELECT count(*)::DOUBLE AS x FROM events GROUP BY user_id), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM s) SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 9) AS gini FROM r",
        "index_diagnostics": f"""{INDEX}, z AS (SELECT count(*) AS lists, sum(size)::BIGINT AS vectors, count(*) FILTER (size = 0) AS empty_lists, min(size) AS min_size, quantile_cont(size::DOUBLE, 0.5) AS median_size, quantile_cont(size::DOUBLE, 0.95) AS p95_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, round(stddev_pop(size) / avg(size), 6) AS size_cv, round(max(radius), 6) AS max_radius FROM st),
        gi AS (SELECT round(2 * sum(i * size) / (count(*) * sum(size)) - (count(*) + 1) / count(*), 6) AS size_gini FROM (SELECT size, row_number() OVER (ORDER BY size) AS i FROM st)), lo AS (SELECT round(avg(1 - list_score), 6) AS mean_loss, round(max(1 - list_score), 6) AS max_loss FROM a),
        pr AS (SELECT list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS s FROM st x JOIN st y ON x.list_id < y.list_id)
        SELECT z.*, size_gini, mean_loss, max_loss, (SELECT round(max(s), 6) FROM pr) AS max_centroid_similarity, (SELECT count(*) FILTER (s >= 0.999) FROM pr) AS near_equal_pairs FROM z, gi, lo""",
        "semantic_search_stub": f"""WITH e AS (SELECT doc_id, [{", ".join(f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})::DOUBLE" for t in TERMS)}] AS v FROM documents WHERE text IS NOT NULL), q AS (SELECT 0 AS query_id, [2, 1, 1, 0, 0, 0, 0, 0, 0, 1]::DOUBLE[] AS v),
        s AS (SELECT query_id, doc_id AS position, {COS} AS score FROM e, q WHERE list_sum(e.v) > 0), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, position) AS rank FROM s) SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, position, score FROM r WHERE rank <= {K}""",
    }
