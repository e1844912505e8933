"""A durable vector collection on plain Parquet: versioned mutations, segments, snapshots.

Every mutation batch is one revision: a folder of Parquet rows (op, id, vector,
metadata as JSON text, ordinal), made under a temporary name and renamed, which
commits it.  What is visible is a latest-wins view over revisions.  An index
generation and sealed segments are folders of their own; ``manifest-N.json``
names them, and ``CURRENT`` names the newest valid manifest.  One process writes.

An index generation holds the live rows of its revision whole, with typed
metadata columns and by list.  What is read of a built collection is the index
without the ids of later revisions, and the latest-wins view of these revisions
alone: no read shuffles the whole log, filters are pushed to Parquet, and a
search opens the lists it probes.  A result must be read before the index it is
of is two manifests old.

Paths are on a file system that the driver mounts; the data itself is read and
written by Spark.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import threading
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import compiled, normalized
from ..functions.vectors import admissible, norm
from ..operators import ivf, search
from ..operators.topk import merged_top_k
from ..plans import planner

#: Column names that metadata may not have.
RESERVED = frozenset(("position", "id", "revision", "vector", "norm", "indexed", "list_id", "list_score", "op", "metadata", "ordinal"))
MUTATION = "op string, id string, vector array<float>, metadata string, ordinal long"


class CommittedError(RuntimeError):
    """The revision is on disk, but a later step failed; open the collection again."""


@dataclass(frozen=True)
class Maintenance:
    max_segments: int = 8
    min_changes: int = 1000
    max_delta: int = 10_000
    max_delta_ratio: float = 0.1
    max_tombstones: int = 10_000
    max_tombstone_ratio: float = 0.1
    max_active: int | None = None
    checkpoint_operations: int = 10_000
    checkpoint_bytes: int = 64 << 20


@dataclass
class Manifest:
    dim: int
    metric: str
    schema: str = ""
    revision: int = 0
    index_revision: int | None = None
    index: str | None = None
    nlists: int = 0
    segments: list = field(default_factory=list)  # [first revision, last revision] of sealed segments
    generation: int = 0
    base: int = 1  # the first revision that counts: compaction writes a new one


class Collection:
    """Vectors with ids and metadata; ``schema`` is the DDL of the metadata columns."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, writable: bool, maintenance: Maintenance = Maintenance()):  # noqa: B008
        self.spark, self.path, self.manifest, self.maintenance = spark, path, manifest, maintenance
        self._lock, self._thread, self.plans, self.hooks = None, threading.RLock(), planner.PlanCache(), {}
        self._operations, self._bytes = 0, 0  # since the last manifest
        if writable:
            self._lock = open(f"{path}/writer.lock", "w")  # noqa: SIM115
            try:
                fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                self._lock.close()
                raise RuntimeError("another writer holds the collection") from None

    # -- life cycle ----------------------------------------------------------------

    @classmethod
    def create(cls, spark, path: str, dim: int, metric: str = "cosine", schema: str = "", maintenance: Maintenance = Maintenance()) -> Collection:  # noqa: B008
        if metric not in ("cosine", "dot") or dim < 1:
            raise ValueError("a metric is cosine or dot, and dim is positive")
        if clash := RESERVED & {f.name.lower() for f in spark.createDataFrame([], schema).schema} if schema else set():
            raise ValueError(f"metadata may not have a column {min(clash)}")
        if os.path.exists(f"{path}/CURRENT"):
            raise FileExistsError(path)
        os.makedirs(f"{path}/revisions", exist_ok=True)
        out = cls(spark, path, Manifest(dim, metric, schema), True, maintenance)
        out._publish()
        return out

    @classmethod
    def load(cls, spark, path: str, read_only: bool = False) -> Collection:
        """Open at the newest revision: revisions committed after the manifest are taken up."""
        manifest = cls._read(path, open(f"{path}/CURRENT").read().strip())
        return cls(spark, path, manifest, not read_only)._recovered()

    @classmethod
    def recover(cls, spark, path: str) -> Collection:
        """Open at the newest manifest that is whole, and repair ``CURRENT``."""
        names = sorted((x for x in os.listdir(path) if x.startswith("manifest-")), key=lambda x: -int(x[9:-5]))
        for name in names:
            with contextlib.suppress(ValueError, OSError, KeyError):
                out = cls(spark, path, cls._read(path, name), True)._recovered()
                out._point(name)
                return out
        raise ValueError("no valid manifest")

    @staticmethod
    def _read(path: str, name: str) -> Manifest:
        held = json.load(open(f"{path}/{name}"))
        body = json.dumps(held["body"], sort_keys=True)
        if hashlib.sha256(body.encode()).hexdigest() != held["sha256"]:
            raise ValueError(f"{name} is damaged")
        for folder, files in held["files"].items():
            for file, size in files.items():
                if os.path.getsize(f"{path}/{folder}/{file}") != size:
                    raise ValueError(f"{folder}/{file} is damaged")
        return Manifest(**held["body"])

    def _recovered(self) -> Collection:
        found = sorted(int(x) for x in os.listdir(f"{self.path}/revisions") if x.isdigit() and int(x) >= self.manifest.base)
        for x in os.listdir(f"{self.path}/revisions"):
            if not x.isdigit() and self._lock:
                shutil.rmtree(f"{self.path}/revisions/{x}")  # torn
        if found and found != list(range(self.manifest.base, found[-1] + 1)):
            raise ValueError("revisions have a gap")
        if (found[-1] if found else 0) < self.manifest.revision:
            raise ValueError("revisions lie behind the manifest")
        self.manifest.revision = max(self.manifest.revision, found[-1] if found else 0)
        return self

    def _point(self, name: str) -> None:
        with open(f"{self.path}/CURRENT.new", "w") as f:
            f.write(name)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}/CURRENT.new", f"{self.path}/CURRENT")

    def _manifests(self) -> list[str]:
        """The names of the kept manifests, newest first."""
        return sorted((x for x in os.listdir(self.path) if x.startswith("manifest-") and x.endswith(".json")), key=lambda x: -int(x[9:-5]))

    def _sweep(self) -> None:
        """Remove revisions and indexes that no kept manifest needs."""
        bodies = [json.load(open(f"{self.path}/{x}"))["body"] for x in self._manifests()]
        first, named = min([self.manifest.base, *(b.get("base", 1) for b in bodies)]), {self.manifest.index, *(b["index"] for b in bodies)}
        for x in os.listdir(f"{self.path}/revisions"):
            if x.isdigit() and int(x) < first:
                self._hook("before_remove")
                shutil.rmtree(f"{self.path}/revisions/{x}")
        for x in os.listdir(self.path):
            if x.startswith("index-") and x not in named:
                shutil.rmtree(f"{self.path}/{x}")

    def _hook(self, name: str) -> None:
        self.hooks.get(name, lambda: None)()

    def _digests(self, folders: list[str]) -> dict[str, str]:
        """SHA-256 of every data file, reckoned by the executors."""
        out = {}
        for d in folders:
            each = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/{d}")
            for r in each.select("path", F.sha2("content", 256).alias("sha")).toLocalIterator():
                out[r["path"].split(f"{self.path}/", 1)[1]] = r["sha"]
        return out

    def _publish(self, retain: int = 2, digests: bool = False) -> None:
        self._hook("before_manifest")
        self.manifest.generation += 1
        name, body = f"manifest-{self.manifest.generation}.json", dict(self.manifest.__dict__)
        folders = [f"revisions/{r}" for r in range(self.manifest.base, self.manifest.revision + 1) if os.path.isdir(f"{self.path}/revisions/{r}")] + ([self.manifest.index] if self.manifest.index else [])
        files = {d: {os.path.relpath(os.path.join(top, x), f"{self.path}/{d}"): os.path.getsize(os.path.join(top, x)) for top, _, names in os.walk(f"{self.path}/{d}") for x in names if not x.endswith(".crc")} for d in folders}
        with open(f"{self.path}/{name}.new", "w") as f:
            json.dump({"body": body, "sha256": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest(), "files": files, "digests": self._digests(folders) if digests else {}}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}/{name}.new", f"{self.path}/{name}")
        self._hook("before_current")
        self._point(name)
        self._operations = self._bytes = 0
        for x in self._manifests()[retain + 1 :]:
            os.remove(f"{self.path}/{x}")

    def save(self, retain: int = 2, digests: bool = True) -> None:
        """Publish a manifest of the present state, with the files' sizes and SHA-256."""
        with self._thread:
            self._writable()
            self._publish(retain, digests)
            self._sweep()

    def verify(self) -> None:
        """Raise if a file's SHA-256 is not what the newest manifest says."""
        held = json.load(open(f"{self.path}/{self._manifests()[0]}"))
        known = held["digests"]
        found = self._digests(list(held["files"])) if known else {}
        if bad := [x for x, digest in known.items() if found.get(x) != digest]:
            raise ValueError(f"{bad[0]} is damaged")

    def close(self) -> None:
        if self._lock:
            self._lock.close()
            self._lock = None

    def _writable(self) -> None:
        if not self._lock:
            raise RuntimeError("the collection is read-only or closed")

    # -- views ------------------------------------------------------------------------

    def _log(self, after: int = 0) -> DataFrame:
        """The mutations of revisions beyond ``after``."""
        paths = [f"{self.path}/revisions/{r}" for r in range(max(self.manifest.base, after + 1), self.manifest.revision + 1) if os.path.isdir(f"{self.path}/revisions/{r}")]
        if not paths:
            return self.spark.createDataFrame([], f"{MUTATION}, revision long")
        each = self.spark.read.schema(MUTATION).parquet(*paths)
        return each.withColumn("revision", F.regexp_extract(F.col("_metadata.file_path"), r"/revisions/([0-9]+)/", 1).cast("long"))

    def _live(self, after: int = 0) -> DataFrame:
        """The live rows among those mutations: the last one of each id, if it puts."""
        newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("revision"), F.desc("ordinal")))
        live = self._log(after).withColumn("_n", newest).where("_n = 1 and op = 'PUT'")
        body = F.from_json("metadata", self.manifest.schema) if self.manifest.schema else None
        seen = self.manifest.index_revision or 0
        out = live.select((F.col("revision") * F.lit(1 << 32) + F.col("ordinal")).alias("position"), "id", "revision", "vector", norm(F.col("vector")).alias("norm"), (F.col("revision") <= seen).alias("indexed"), *([body.alias("_m")] if body is not None else []))
        return out.select("*", "_m.*").drop("_m") if body is not None else out

    def _delta(self) -> DataFrame:
        """The live rows that are in no list."""
        return self._live(self.manifest.index_revision or 0)

    def _indexed_rows(self) -> tuple[DataFrame, DataFrame]:
        """The live rows in lists, with list_id and list_score, and the lists."""
        at, seen = f"{self.path}/{self.manifest.index}", self.manifest.index_revision
        rows = self.spark.read.parquet(f"{at}/rows").withColumn("indexed", F.lit(True))
        if seen < self.manifest.revision:
            rows = rows.join(self._log(seen).select("id"), "id", "left_anti")
        return rows, self.spark.read.parquet(f"{at}/centroids")

    def rows(self) -> DataFrame:
        """The live rows: position (1-based), id, revision, vector, norm, indexed, metadata columns."""
        delta = self._delta()
        return self._indexed_rows()[0].select(*delta.columns).union(delta) if self.is_built else delta

    def ids(self) -> DataFrame:
        return self.rows().select("id")

    def __len__(self) -> int:
        return self.rows().count()

    def get(self, id_: str) -> dict:
        found = self.rows().where(F.col("id") == id_).collect()
        if not found:
            raise KeyError(id_)
        return found[0].asDict(recursive=True)

    # -- mutations -------------------------------------------------------------------

    def _commit(self, batch: DataFrame) -> int:
        revision = self.manifest.revision + 1
        draft = f"{self.path}/revisions/draft-{uuid.uuid4().hex}"
        batch.select("op", "id", "vector", "metadata", "ordinal").write.parquet(draft)
        self._hook("before_rename")
        os.rename(draft, f"{self.path}/revisions/{revision}")
        self.manifest.revision = revision
        self.plans.clear()
        try:
            self._hook("after_rename")
            self._operations += batch.count()
            self._bytes += sum(os.path.getsize(os.path.join(top, x)) for top, _, names in os.walk(f"{self.path}/revisions/{revision}") for x in names)
            if self._operations >= self.maintenance.checkpoint_operations or self._bytes >= self.maintenance.checkpoint_bytes:
                self._publish()
            done = revision - max([self.manifest.index_revision or 0, *(s[1] for s in self.manifest.segments)])
            if self.maintenance.max_active and done and self.counts()["delta"] >= self.maintenance.max_active:
                self.seal()
        except Exception as e:
            raise CommittedError(str(e)) from e
        return revision

    def _batch(self, rows: DataFrame) -> DataFrame:
        extra = [c for c in rows.columns if c not in ("id", "vector")]
        body = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
        return rows.select(F.lit("PUT").alias("op"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), body.alias("metadata"), F.col("vector").alias("_raw"), F.monotonically_increasing_id().alias("_at"))

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        """Rows without ids get numbers: from one more than the live rows on, without those in use."""
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).cache()
        n, live, used = rows.count(), len(self), self.ids().where(F.col("id").rlike("^[1-9][0-9]{0,17}$"))
        taken = used.where(F.col("id").cast("long") > live)
        free = self.spark.range(live + 1, live + 1 + n + taken.count()).select(F.col("id").cast("string").alias("id")).join(taken, "id", "left_anti")
        free = free.withColumn("_k", F.row_number().over(Window.orderBy(F.col("id").cast("long"))))
        return rows.withColumn("_k", F.row_number().over(Window.orderBy("_at"))).join(free, "_k").orderBy("_k").drop("_k", "_at")

    def _checked(self, rows: DataFrame) -> DataFrame:
        batch = self._batch(rows if "id" in rows.columns else self._with_ids(rows))
        batch = batch.withColumn("ordinal", F.row_number().over(Window.orderBy("_at")).cast("long")).cache()
        bad = batch.agg(F.count_if(~admissible(F.col("_raw"), self.manifest.dim, self.manifest.metric)).alias("v"), F.count_if(F.col("id").isNull()).alias("i"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("d"), F.count(F.lit(1)).alias("n")).first()
        if bad["v"]:
            raise ValueError(f"{bad['v']} vectors are not admissible")
        if bad["i"] or bad["d"]:
            raise ValueError("ids must be present and distinct in a batch")
        if self.maintenance.max_active and bad["n"] > self.maintenance.max_active:
            raise ValueError("the batch is larger than an active segment may be")
        return batch

    def insert(self, rows: DataFrame) -> int:
        """Add new rows (vector, metadata... and id, else ids are made), all or none."""
        with self._thread:
            self._writable()
            batch = self._checked(rows)
            if not batch.select("id").join(self.ids(), "id", "left_semi").isEmpty():
                raise ValueError("an id exists already")
            return self._commit(batch)

    def upsert(self, rows: DataFrame) -> int:
        with self._thread:
            self._writable()
            return self._commit(self._checked(rows))

    def update(self, id_: str, vector=None, metadata: dict | None = None) -> int:
        """Replace the vector or the whole metadata of one row."""
        if vector is None and metadata is None:
            raise ValueError("nothing to update")
        with self._thread:
            self._writable()
            old = self.get(id_)
            body = metadata if metadata is not None else {k: v for k, v in old.items() if k not in ("position", "id", "revision", "vector", "norm", "indexed")}
            row = self.spark.createDataFrame([(id_, [float(x) for x in (vector if vector is not None else old["vector"])], json.dumps(body, default=str))], "id string, vector array<float>, _j string")
            rows = row.select("id", "vector", F.from_json("_j", self.manifest.schema).alias("_m")).select("id", "vector", "_m.*") if self.manifest.schema else row.drop("_j")
            return self._commit(self._checked(rows))

    def delete(self, ids: list[str]) -> int:
        """Remove rows; an unknown id fails the whole batch."""
        with self._thread:
            self._writable()
            if len(set(ids)) != len(ids):
                raise ValueError("ids must be distinct")
            gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
            if missing := gone.join(self.ids(), "id", "left_anti").limit(1).collect():
                raise KeyError(missing[0][0])
            batch = gone.select(F.lit("DELETE").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"), F.lit(0).cast("long").alias("ordinal"))
            return self._commit(batch)

    # -- index, segments, maintenance ------------------------------------------------------

    @property
    def is_built(self) -> bool:
        return self.manifest.index is not None

    @property
    def is_dirty(self) -> bool:
        return (self.manifest.index_revision or 0) != self.manifest.revision

    def build(self, nlists: int, iterations: int = 20, seed: int = 42, restarts: int = 1, training_count: int | None = None) -> None:
        """Index the rows of the present revision; later ones are the delta until the next build."""
        with self._thread:
            self._writable()
            seen = self.manifest.revision
            rows = self._live().drop("indexed").cache()
            matrix = ivf.trained(rows, nlists, iterations, seed, self.manifest.metric, restarts, training_count)
            placed = ivf.assigned_fast(rows, matrix, self.manifest.metric)
            name = f"index-{seen}-{uuid.uuid4().hex[:8]}"
            # small lists go to a file each, large ones to several tasks
            placed.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(f"{self.path}/{name}/rows")
            rows.unpersist()
            held = self.spark.read.parquet(f"{self.path}/{name}/rows")
            ivf.list_statistics(held, ivf.centroid_table(self.spark, matrix), self.manifest.metric).coalesce(1).write.parquet(f"{self.path}/{name}/centroids")
            self._hook("index_written")
            self.manifest.index, self.manifest.index_revision, self.manifest.nlists = name, seen, nlists
            self.plans.clear()
            self._publish()
            self._sweep()

    def seal(self) -> None:
        """Close the active segment: the revisions since the last one."""
        last = max([self.manifest.index_revision or 0, *(s[1] for s in self.manifest.segments)])
        if self.manifest.revision > last:
            self.manifest.segments.append([last + 1, self.manifest.revision])

    def compact(self) -> None:
        """Rewrite the live rows as one revision and index them anew with as many lists.

        The new revision holds every live row, so the collection is whole
        whether or not the manifest that begins with it is published; what came
        before is removed only when no kept manifest needs it.
        """
        with self._thread:
            self._writable()
            rows = self._live().drop("norm", "indexed").orderBy("position")
            extra = [c for c in rows.columns if c not in ("id", "vector", "position", "revision")]
            body = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
            whole = rows.select(F.lit("PUT").alias("op"), "id", "vector", body.alias("metadata"), F.row_number().over(Window.orderBy("position")).cast("long").alias("ordinal"))
            self._commit(whole)
            self._hook("compact_written")
            lists, self.manifest.index, self.manifest.index_revision, self.manifest.segments = self.manifest.nlists, None, None, []
            self.manifest.base = self.manifest.revision
            n = len(self)
            if lists and n:
                self.build(min(lists, n))
            else:
                self._publish()
                self._sweep()

    def counts(self) -> dict:
        seen = self.manifest.index_revision or 0
        log = self._log()
        newest = log.groupBy("id").agg(F.max("revision").alias("r"), F.max_by("op", "revision").alias("op"), F.min("revision").alias("f"))
        r = newest.agg(F.count_if((F.col("op") == "PUT") & (F.col("r") <= seen)).alias("base"), F.count_if((F.col("op") == "PUT") & (F.col("r") > seen)).alias("delta"), F.count_if((F.col("r") > seen) & (F.col("f") <= seen)).alias("tombstones")).first()
        base = r["base"] + r["tombstones"]
        return {"base": r["base"], "delta": r["delta"], "tombstones": r["tombstones"], "segments": len(self.manifest.segments), "delta_ratio": r["delta"] / max(1, base), "tombstone_ratio": r["tombstones"] / max(1, base)}

    def maintenance_due(self) -> bool:
        c, m = self.counts(), self.maintenance
        if c["segments"] >= m.max_segments:
            return True
        changes = c["delta"] + c["tombstones"]
        return changes >= m.min_changes and (c["delta"] >= m.max_delta or c["delta_ratio"] >= m.max_delta_ratio or c["tombstones"] >= m.max_tombstones or c["tombstone_ratio"] >= m.max_tombstone_ratio)

    def maintain(self) -> bool:
        """Compact if it is due."""
        if due := self.maintenance_due():
            self.compact()
        return due

    def configure_maintenance(self, **settings) -> None:
        self.maintenance = replace(self.maintenance, **settings)

    def maintain_in_background(self, retries: int = 2, save: bool = False) -> threading.Thread:
        """Compact if it is due, in a thread, trying again after a failure; errors are kept for :meth:`wait_for_maintenance`."""
        self._errors = []

        def work() -> None:
            for _ in range(retries + 1):
                try:
                    if self.maintain() and save:
                        self.save()
                    return
                except Exception as e:  # noqa: BLE001
                    self._errors.append(e)

        self._worker = threading.Thread(target=work, daemon=True)
        self._retries = retries
        self._worker.start()
        return self._worker

    def wait_for_maintenance(self, timeout: float | None = None) -> int:
        """Wait for the thread; gives the number of failed tries, and raises the last error if all failed."""
        worker = getattr(self, "_worker", None)
        if worker is None:
            return 0
        worker.join(timeout)
        if worker.is_alive():
            raise TimeoutError("maintenance has not ended")
        if len(self._errors) > self._retries:
            raise self._errors[-1]
        return len(self._errors)

    def info(self) -> DataFrame:
        c, m = self.counts(), self.manifest
        return self.spark.createDataFrame([(m.dim, m.metric, m.revision, m.index_revision, m.nlists, c["base"] + c["delta"], c["base"], c["delta"], c["tombstones"], c["segments"], self.is_built, self.is_dirty)], "dim int, metric string, revision long, index_revision long, nlists int, live long, base long, delta long, tombstones long, segments int, built boolean, dirty boolean")

    def check(self) -> None:
        """Raise if a live row is not admissible, or the lists do not hold each indexed row of the log once."""
        rows = self._live()
        if not rows.where(~admissible(F.col("vector"), self.manifest.dim, self.manifest.metric)).isEmpty():
            raise ValueError("a stored vector is not admissible")
        if self.is_built:
            lists = self._indexed_rows()[0].groupBy("position").count()
            bad = rows.where("indexed").select("position").join(lists, "position", "full").where("count is null or count <> 1")
            if not bad.isEmpty() or lists.count() != rows.where("indexed").count():
                raise ValueError("an indexed row is not in exactly one list")

    # -- search ----------------------------------------------------------------------

    def plan(self, where=None, k: int = 10, strategy: str = "auto", config: planner.Config = planner.Config()) -> planner.Plan:  # noqa: B008
        where = normalized(where)

        def make():
            rows, m = self.rows(), self.manifest
            uneven = 0.0
            if where is not None and self.is_built:
                base, centroids = self._indexed_rows()
                uneven = search.concentration(search.list_matches(base, centroids, where)).first()[0]
            s = planner.statistics(rows, None if where is None else compiled(where, rows.schema), m.nlists if self.is_built else 0, m.dim, m.metric, uneven)
            return planner.choose(s, where is not None, k, config, None if strategy == "auto" else strategy)

        return self.plans.get((self.manifest.revision, where, k, strategy, config), make)

    def search(self, queries: list, where=None, k: int = 10, strategy: str = "auto", nprobe: int | None = None, max_nprobe: int | None = None, oversample: int = 10, adaptive_oversample: bool = True, config: planner.Config = planner.Config(), **options) -> DataFrame:  # noqa: B008
        """One plan for the batch: the index for indexed rows, exact for the delta, merged by score."""
        q = search.query_table(self.spark, queries)
        bad = q.where(~admissible(F.col("query"), self.manifest.dim, self.manifest.metric))
        if not bad.isEmpty():
            raise ValueError("a query is not admissible")
        where, metric = normalized(where), self.manifest.metric
        if strategy != "auto":
            name = planner.strategy(strategy)
            if name not in ("exact", "prefilter_exact") and not self.is_built:
                raise ValueError(f"{name} needs an index; build one first")
            if name in ("ivf_prefilter", "ivf_postfilter", "filter_aware", "filter_aware_bound") and where is None:
                raise ValueError(f"{name} needs a filter")
            if name == "filter_aware_bound" and metric != "cosine":
                raise ValueError("bounds hold for cosine only")
        p = self.plan(where, k, strategy, config)
        if not self.is_built or p.strategy in ("exact", "prefilter_exact"):
            return search.exact(self.rows(), q, k, metric, where)
        base, centroids = self._indexed_rows()
        low = nprobe or p.nprobe or 1
        high = max_nprobe or (low if nprobe else max(low, p.max_nprobe))
        low, high = min(low, self.manifest.nlists), min(high, self.manifest.nlists)
        if p.strategy == "ivf" or where is None:
            found = search.ivf(base, centroids, q, k, low, metric, where)
        elif p.strategy == "ivf_prefilter":
            found = search.ivf_prefilter(base, centroids, q, where, k, low, metric)
        elif p.strategy == "ivf_postfilter":
            n = search.postfilter_oversample(oversample, p.selectivity) if adaptive_oversample else oversample
            found = search.ivf_postfilter(base, centroids, q, where, k, low, metric, n)
        elif p.strategy == "filter_aware":
            found = search.filter_aware(base, centroids, q, where, k, low, metric, adaptive=high > low, max_nprobe=high, **options)
        else:
            found = search.bound_search(base, centroids, q, where, k, high)
        delta = self._delta()
        keep = ["query_id", "rank", "position", "score", *(c for c in delta.columns if c not in ("position", "vector", "norm"))]
        if not self.is_dirty:
            return found.select(*keep)
        return merged_top_k([found.select(*keep), search.exact(delta, q, k, metric, where).select(*keep)], k).select(*keep)
