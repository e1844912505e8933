"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct shingles.  All sets are ordered by rarity
(shingles seen once first, see :mod:`.shared`), then by hash.  Two sets of a
similarity of 0.8 or more share a shingle in their prefixes of
``n - ceil(0.8 n) + 1``.  A document with so many shingles of its own has no
partner and is done.  The others collapse into groups of equal prefix and size;
groups that share a prefix shingle and have compatible sizes are linked, by way
of the least group of each shingle and size class, so that a shingle costs as
many links as it has groups, not their pairs.  Components of these links are
expanded to their members, whose sets are verified exactly.

A component of more than ``TILE`` distinct sets is dealt to tiles: all sets are
verified against the one of middle size first, and only those that fail it meet
the sets of all tiles.  Copies (equal sets) are one set throughout.

Nulls and odd input: a null or empty text, or one without words, has an empty
set and links with nothing; repeated rows are copies; null doc_ids take part
and get the smallest doc_id of their component, or null; an empty table gives
an empty result; further columns are carried through by :func:`deduplicated`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_batches, small_batches, table, text_bytes, written
from .components import connected
from .scan import U, chunks, grams, mixed, split_table, words
from .shared import buckets_for, classes_for, in_blocks, ordered, shared_classes

WORDS = 5
TILE = 1200
SETS = "node long, doc_id long, mix string, n_shingles long, set_id long, check long, group_id long, prefix array<long>, shingles binary"


def shingle_sets(column: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    spaced, out = split_table("spaced"), []
    for c in chunks(column):
        w = words(c, spaced)
        all_grams = grams(w.hashes, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(all_grams[a : b - n + 1]))
            elif b > a:
                out.append(mixed(grams(w.hashes[a:b], b - a) + U(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def row_key(key: str, text: str) -> Column:
    """128 bits that stand for a row's key and text."""
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(text)))


def _set_id(s: np.ndarray, salt: int = 0x9E3779B97F4A7C15) -> int:
    """A 63-bit number of a set: a sum and a product over its mixed hashes."""
    h = mixed(s + U(salt))
    whole = mixed(np.array([h.sum(dtype=np.uint64) ^ (U(len(s)) << U(40)), np.multiply.reduce(h | U(1))], np.uint64))
    return int(mixed(whole[:1] * U(3) + whole[1:])[0] >> U(1))


def candidate_sets(docs: DataFrame, size: int) -> DataFrame:
    """All rows of (doc_id, _text) with the size of their set; those that may have partners also with set, group and prefix."""
    blocks = in_blocks(docs.withColumn("_mix", row_key("doc_id", "_text")), size)
    buckets = buckets_for(size // 6)

    def hashes_of(block: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *shingle_sets(block["_text"].combine_chunks())])

    def choose(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(block):
            number, block = block["_block"][0].as_py(), ordered(block)
            sets = shingle_sets(block["_text"].combine_chunks())
            classes = classes_for(np.concatenate([np.zeros(0, np.uint64), *sets]), answers, buckets)
            at = 0
            for k, (key, mix, s) in enumerate(zip(block["doc_id"].to_pylist(), block["_mix"].to_pylist(), sets, strict=True)):
                own = classes[at : at + len(s)]
                at += len(s)
                row = {"node": number << 32 | k, "doc_id": key, "mix": mix, "n_shingles": len(s)}
                p = prefix_length(len(s))
                if len(s) and np.count_nonzero(own == 0) < p:
                    prefix = np.lexsort((s, own))[:p]
                    prefix = s[prefix[own[prefix] > 0]]
                    row |= {"set_id": _set_id(s), "check": _set_id(s, 0xD6E8FEB86659FD93), "group_id": _set_id(np.r_[prefix, U(len(s))]), "prefix": (prefix >> U(1)).astype(np.int64), "shingles": s.astype("<u8").tobytes()}
                rows.append(row)
        return pa.Table.from_pylist(rows, schema=pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("mix", pa.string()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("check", pa.int64()), ("group_id", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.binary())]))

    answers = shared_classes(blocks, hashes_of, buckets)
    sets = written(blocks.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(lean(choose), SETS), "sets")
    sets = told_apart(sets, "set_id", F.col("check"))
    return told_apart(sets, "group_id", F.xxhash64("n_shingles", "prefix"))


def told_apart(sets: DataFrame, name: str, check: Column) -> DataFrame:
    """Give other numbers to things that are not alike (by a second hash) and yet have one number: 126 bits tell them apart."""
    clashes = sets.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(check).alias("a"), F.max(check).alias("b")).where("a <> b").select(name)
    if clashes.isEmpty():
        return sets
    clashes = written(clashes.withColumn("_clash", F.lit(True)), "clashes")
    other = F.when(F.col("_clash"), F.shiftrightunsigned(F.xxhash64(F.col(name), check), 1)).otherwise(F.col(name))
    return written(sets.join(clashes, name, "left").withColumn(name, other).select(*sets.columns), "sets")


def group_links(sets: DataFrame) -> DataFrame:
    """(a, b): links between groups that share a prefix shingle and may have compatible sizes."""
    groups = sets.where("set_id is not null").groupBy("group_id", "n_shingles").agg(F.min("prefix").alias("prefix"))
    size = F.floor(F.log(F.col("n_shingles") + F.lit(1e-9)) / math.log(1.25)).cast("int")
    held = groups.select("group_id", size.alias("size"), F.explode("prefix").alias("s"))
    least = held.groupBy("s", "size").agg(F.min("group_id").alias("least"), F.max("group_id").alias("most"))
    several = least.where("least <> most").select("s", "size", "least")
    inside = held.join(several, ["s", "size"]).where("group_id <> least").select(F.col("group_id").alias("a"), F.col("least").alias("b"))
    next_size = least.select("s", (F.col("size") - 1).alias("size"), F.col("least").alias("next"))
    across = least.join(next_size, ["s", "size"]).select(F.col("least").alias("a"), F.col("next").alias("b"))
    return inside.union(across).distinct()


def _linked(a: int, b: int, both: np.ndarray) -> np.ndarray:
    return 100 * both >= 80 * (a + b - both)


class _Tile:
    """Sets with an inverted index; finds the links of one set with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        whole = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(whole, kind="stable")
        self.owner, whole = owner[order], whole[order]
        first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(whole) else np.zeros(0, np.int64)
        self.terms, self.at = whole[first], np.r_[first, len(whole)]

    def links(self, s: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.terms, s), len(self.terms) - 1)
        k = k[self.terms[k] == s]
        a, n = self.at[k], self.at[k + 1] - self.at[k]
        rows = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(k) else np.zeros(0, np.int64)
        both = np.bincount(self.owner[rows], minlength=len(self.n))
        return np.flatnonzero(_linked(len(s), self.n, both) & (both > 0))


def _joined(part: np.ndarray, own: int, linked: np.ndarray) -> list[int]:
    """Join the parts of ``linked`` to that of ``own``; gives one linked set for each part that was another."""
    other, first = np.unique(part[linked], return_index=True)
    new = other != part[own]
    if new.any():
        part[np.isin(part, other[new])] = part[own]
    return linked[first[new]].tolist()


def united(sets: list[np.ndarray]) -> np.ndarray:
    """The component of each set, as the position of one of it; stops when all are one."""
    tile, part, parts = _Tile(sets), np.arange(len(sets)), len(sets)
    for i in np.argsort(-tile.n, kind="stable").tolist():
        if parts == 1:
            break
        parts -= len(_joined(part, i, tile.links(sets[i])))
    return part


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())}, schema=_EDGE)


def _decoded(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def verified_links(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): star edges between set_ids, exact up to connectivity.

    ``blocks`` is (group_id, block).  A block of up to ``TILE`` sets is one
    task's work; of a larger one each task has a tile of sets, and beside it
    the sets that did not link with the middle one.
    """
    one = sets.where("set_id is not null").groupBy("set_id", "group_id", "n_shingles").agg(F.min("node").alias("node"))
    placed = one.join(blocks, "group_id").select("set_id", "node", "n_shingles", "block")
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.avg("n_shingles").alias("mean")).where("m > 1")
    placed = written(placed.join(sizes, "block"), "placed")
    full = placed.join(sets.select("node", "shingles"), "node").select("block", "set_id", "n_shingles", "m", "mean", "shingles")

    def solve(block: pa.Table) -> pa.Table:
        block = block.sort_by("set_id")
        ids = block["set_id"].to_pylist()
        return _edges([(ids[i], ids[r]) for i, r in enumerate(united(_decoded(block["shingles"])).tolist()) if i != r])

    small = full.where(F.col("m") <= TILE).select("block", "set_id", "shingles").groupBy("block").applyInArrow(lean(solve), "a long, b long")
    if placed.where(F.col("m") > TILE).isEmpty():
        return small
    large = written(full.where(F.col("m") > TILE).withColumn("tile", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("m") / TILE)).cast("int")), "large")
    # what a block's tiles share is copied to each of them, so that no join key has more rows than a tile
    tiles = placed.where(F.col("m") > TILE).select("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / TILE).cast("int") - 1)).alias("tile")).distinct()
    near = F.struct(F.abs(F.col("n_shingles") - F.col("mean")).alias("d"), "set_id")
    middle = placed.where(F.col("m") > TILE).groupBy("block").agg(F.min_by(F.struct("set_id", "node"), near).alias("x")).select("block", F.col("x.set_id").alias("mid"), F.col("x.node").alias("node"))
    middle = middle.join(sets.select("node", F.col("shingles").alias("mid_shingles")), "node").drop("node").join(tiles, "block")
    beside = large.select("block", "tile", "set_id", "shingles").join(middle, ["block", "tile"])

    def with_middle(batches):
        for batch in batches:
            pairs, left = [], batch.num_rows
            ids, mids = batch["set_id"].to_pylist(), batch["mid"].to_pylist()
            for k, (x, y) in enumerate(zip(_decoded(batch["shingles"]), _decoded(batch["mid_shingles"]), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                pairs.append((ids[k], mids[k] if _linked(len(x), len(y), both) else None))
            assert len(pairs) == left
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

    first = written(beside.select("set_id", "shingles", "mid", "mid_shingles").mapInArrow(lean_batches(with_middle), "a long, b long"), "first")
    apart = first.where("b is null").select(F.col("a").alias("set_id"))
    lone = large.join(apart, "set_id").select("block", "set_id", "shingles")
    lone = lone.join(lone.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block").withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(1)), F.ceil(F.col("n") / TILE)).cast("int")).drop("n")
    cells = lone.select("block", "part").distinct().join(tiles, "block")
    grid_x = large.select("block", "tile", "set_id", "shingles").join(cells, ["block", "tile"]).select("block", "tile", "part", "set_id", "shingles", F.lit(False).alias("lone"))
    grid_y = lone.join(cells, ["block", "part"]).select("block", "tile", "part", "set_id", "shingles", F.lit(True).alias("lone"))

    def meet(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("lone", "ascending"), ("set_id", "ascending")])
        ids, sets_, lone_ = cell["set_id"].to_pylist(), _decoded(cell["shingles"]), cell["lone"].to_pylist()
        rest = np.array([k for k, x in enumerate(lone_) if not x], np.int64)
        tile, part, pairs = _Tile([sets_[k] for k in rest.tolist()]), np.arange(len(ids)), []
        for k, x in enumerate(lone_):
            if x:  # of a set's links, those that join two parts
                pairs += [(ids[k], ids[j]) for j in _joined(part, k, rest[tile.links(sets_[k])])]
        return _edges(pairs)

    second = grid_x.union(grid_y).groupBy("block", "tile", "part").applyInArrow(lean(meet), "a long, b long")
    return small.union(first.where("b is not null")).union(second)


def joined(docs: DataFrame, size: int) -> DataFrame:
    """(node, doc_id, mix, n_shingles, component_id, stays) of rows (doc_id, _text).

    One row of each component stays: that of the smallest doc_id.  ``mix`` is
    :func:`row_key`.
    """
    small_batches(docs.sparkSession)
    sets = candidate_sets(docs, size)
    links = connected(group_links(sets))
    groups = sets.where("set_id is not null").select("group_id").distinct()
    blocks = groups.join(links, groups["group_id"] == links["node"], "left").select("group_id", F.coalesce("label", "group_id").alias("block"))
    parts = connected(verified_links(sets, blocks))
    own = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("node").alias("first"))
    labelled = written(own.join(parts, own["set_id"] == parts["node"], "left").select("set_id", "least", "first", F.coalesce("label", "set_id").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.min_by("first", F.struct("least", "first")).alias("keeper"))
    known = labelled.join(least, "label").select("set_id", "component_id", "keeper")
    rows = sets.select("node", "doc_id", "mix", "n_shingles", "set_id").join(known, "set_id", "left")
    alone = F.col("set_id").isNull()
    return rows.select("node", "doc_id", "mix", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("node") == F.col("keeper"))).alias("stays"))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component of ``docs``; of rows equal in doc_id and text, any one."""
    keyed = docs.select(F.struct("*").alias("_row"), docs["doc_id"].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    size = text_bytes(keyed.select(F.col("_text").alias("text")))[1]
    found = joined(keyed.select(F.col("_id").alias("doc_id"), "_text"), size)
    kinds = written(found.groupBy("mix").agg(F.max(F.col("stays").cast("int")).alias("some"), F.min(F.col("stays").cast("int")).alias("every"), F.count(F.lit(1)).alias("n")), "stays")
    keyed = keyed.withColumn("_mix", row_key("_id", "_text"))
    gone = kinds.where("some = 0").select(F.col("mix").alias("_mix"))
    once = kinds.where("some = 1 and n > 1 and every = 0").select(F.col("mix").alias("_mix"))
    left = keyed.join(gone, "_mix", "left_anti")
    if not once.isEmpty():
        left = left.join(once, "_mix", "left_anti").select("_row").union(left.join(once, "_mix", "left_semi").dropDuplicates(["_mix"]).select("_row"))
    return left.select("_row.*")


def op3_jaccard_join(spark, sf_dir) -> DataFrame:
    """Components of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return joined(docs, text_bytes(docs.withColumnRenamed("_text", "text"))[1]).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 5) - 1) AS g FROM d, range(1, greatest(len(d.w) - 4, 1) + 1) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id
"""
