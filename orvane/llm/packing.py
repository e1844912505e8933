"""Lexical retrieval packing: windows are filled with a seed's nearest documents.

Documents are tokenized once; full windows of a long document are sequences of
their own.  What remains of each document (less than a window) is placed by its
content: by the nearest of some centres of weighted ids, and in that by its two
most telling ids (a min-hash that favours rare ones), so that copies and near
copies lie side by side whatever their language, source or key.  That order is
cut to ranges and these to shards of :data:`SHARD` remainders.

Each shard has an inverted index of its remainders, scored by BM25 with document
frequencies of ids over all documents.  A seed gets its nearest unused
remainders of the shard until its window is full.  One that does not fit is cut,
and what is left of it is the next seed.  A window that is not full when all of a
shard are used goes on in the next shard, so that only one window of a range is
padded, and not if its length is a power of two.

Work and memory grow in proportion to the remainders, and the driver holds none
of them.  The price: a neighbour in another shard is not found.  The centres are
fitted on about :data:`SAMPLE` remainders, chosen by hash; all else (frequencies,
placing, search, packing) covers every document.  The vocabulary is the
tokenizer's, so the table of document frequencies that every task gets has a
fixed size (one number for each id).

Nulls and odd input: a null or empty text has the end id alone; repeated rows
are packed each; rows with equal keys are ordered by a hash of key and text; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, shuffle_tasks, small_batches, table, written
from .tokens import default_tokenizer, encoder

WINDOW = 1024
#: Remainders of a shard, and shards of a range at least (where there are more ranges than tasks).
SHARD, SHARDS = 2048, 8
#: The most frequent ids of a shard, whose share of a score is a matrix product.
HEAD = 1024
#: Seeds that are scored at once, and neighbours that are sorted of each (all others only where these are used).
SEEDS, NEAR = 128, 32
#: Centres, their dimensions, and remainders on which they are fitted.
CENTRES, DIMENSIONS, SAMPLE = 64, 256, 4096
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KINDS = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, crcs of the full windows, ids of the remainder, mix) written to the shared folder.

    Each task adds a row without ``n`` that counts in how many of its
    documents each id occurs.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("mix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        total = np.zeros(encode.library.get_vocab_size(), np.int64)
        last, count = np.zeros(len(total), np.int32), np.arange(1 << 16, dtype=np.int32)
        end, names = np.array([end_id], encode.dtype).tobytes(), ["doc_id", "n", "crcs", "tail", "mix", "df"]
        for batch in batches:
            sizes, crcs, tails = [], [], []
            for text in batch["text"].to_pylist():
                ids = np.frombuffer(encode.encode(text) + end, encode.dtype)
                if len(ids) > len(count):
                    count = np.arange(2 * len(ids), dtype=np.int32)
                at = count[: len(ids)]
                last[ids] = at
                total[ids[last[ids] == at]] += 1  # each id once, where it stands last
                whole = len(ids) // WINDOW * WINDOW
                crcs.append([zlib.crc32(ids[a : a + WINDOW].astype("<u4")) for a in range(0, whole, WINDOW)])
                sizes.append(len(ids))
                tails.append(ids[whole:].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), batch["mix"], pa.nulls(len(sizes), pa.binary())], names=names)
        seen = np.flatnonzero(total)
        df = np.stack([seen, total[seen]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((None, pa.int64()), (None, pa.int64()), (None, pa.list_(pa.int64())), (None, pa.binary()), (None, pa.int64()), (df, pa.binary()))], names=names)

    return written(rows.mapInArrow(lean_batches(run), "doc_id long, n long, crcs array<long>, tail binary, mix long, df binary"), "ids")


def document_frequencies(ids: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """In how many documents each id occurs, and the numbers of documents and ids, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch["df"].to_pylist():
                seen, n = np.frombuffer(data, "<i8").reshape(2, -1)
                total[seen] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "df"])

    out = np.zeros(vocabulary, np.int64)
    for r in ids.where("df is not null").select("df").mapInArrow(count, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["id"]] = r["df"]
    sums = ids.agg(F.count("n").alias("n"), F.sum("n").alias("ids")).first()
    return out, sums["n"], sums["ids"] or 0


class Weights:
    """BM25 weights of ids, from frequencies over all documents; also what places a remainder."""

    def __init__(self, df: np.ndarray, n_docs: int, n_ids: int):
        self.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1e-9, min(WINDOW, n_ids / max(n_docs, 1)))
        r = np.random.default_rng(20250101)
        self.dimension = r.integers(0, DIMENSIONS, len(df))
        self.sign = r.choice(np.array([-1, 1], np.float32), len(df))
        # the least of these picks an id, in proportion to its squared weight
        self.order = r.exponential(size=len(df)) / np.maximum(self.idf.astype(np.float64), 1e-6) ** 2

    def entries(self, tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(remainder, id, weight) for each distinct id of each remainder, by remainder and id."""
        lengths = np.array([len(t) for t in tails], np.int64)
        key = np.repeat(np.arange(len(tails)) * len(self.idf), lengths)
        key += np.concatenate([np.zeros(0, np.int64), *tails]).astype(np.int64)
        key.sort()
        first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
        tf = np.diff(np.r_[first, len(key)]).astype(np.float32)
        owner, term = np.divmod(key[first], len(self.idf))
        norm = (K1 * (1 - B + B * lengths / self.mean)).astype(np.float32)
        return owner, term, self.idf[term] * tf * np.float32(K1 + 1) / (tf + norm[owner])

    def vectors(self, n: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Unit vectors of remainders: their weights, folded at random."""
        out = np.bincount(owner * DIMENSIONS + self.dimension[term], weight * self.sign[term], n * DIMENSIONS).reshape(n, DIMENSIONS)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def places(self, tails: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
        """A number for each remainder: nearest centre, then its two most telling ids."""
        owner, term, weight = self.entries(tails)
        centre = np.argmax(self.vectors(len(tails), owner, term, weight) @ centres.T, axis=1)
        by = np.lexsort((self.order[term], owner))
        at = np.searchsorted(owner, np.arange(len(tails)))
        last = np.searchsorted(owner, np.arange(len(tails)), "right") - 1
        return centre << 42 | term[by[at]] << 21 | term[by[np.minimum(at + 1, last)]]


def centres_of(tails: list[np.ndarray], weights: Weights, rounds: int = 8) -> np.ndarray:
    """Centres of a sample by spherical k-means."""
    x = weights.vectors(len(tails), *weights.entries(tails))
    centres = x[np.linspace(0, len(x) - 1, min(CENTRES, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return centres


class Shard:
    """Inverted index of some remainders, and their packing in one chain."""

    def __init__(self, tails: list[np.ndarray], weights: Weights):
        self.lengths, n = [len(t) for t in tails], len(tails)
        owner, term, weight = weights.entries(tails)
        names, term, df = np.unique(term, return_inverse=True, return_counts=True)
        slot = np.full(len(names), -1, np.int32)  # the column of an id that is frequent here
        slot[np.argsort(-df, kind="stable")[:HEAD]] = np.arange(min(HEAD, len(names)))
        slot = slot[term]
        often = slot >= 0
        self.dense = np.zeros((n, min(HEAD, len(names))), np.float32)
        self.dense[owner[often], slot[often]] = weight[often]
        # posting lists of the other ids
        owner, term, weight = owner[~often], term[~often], weight[~often]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight, term_order = owner[order], weight[order], term[order]
        self.at = np.searchsorted(owner, np.arange(n + 1))  # a remainder's ids
        self.a = np.searchsorted(term_order, term)
        self.n = np.searchsorted(term_order, term, "right") - self.a
        # of equal scores (copies) each seed prefers those that follow it
        ring = 1 - np.float32(1e-5) * np.arange(n, dtype=np.float32) / max(n, 1)
        self.ring = np.lib.stride_tricks.sliding_window_view(np.r_[ring, ring], n)[n:0:-1] if n else np.zeros((0, 0), np.float32)

    def scores(self, lo: int, hi: int) -> np.ndarray:
        """BM25 of every remainder for the distinct ids of the seeds from ``lo`` to ``hi``."""
        n, m = len(self.lengths), hi - lo
        out = (self.dense[lo:hi] > 0).astype(np.float32) @ self.dense.T
        x, y = self.at[lo], self.at[hi]
        a, size = self.a[x:y], self.n[x:y]
        if y > x:
            hits = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            seed = np.repeat(np.repeat(np.arange(m), np.diff(self.at[lo : hi + 1])), size)
            out += np.bincount(seed * n + self.owner[hits], self.weight[hits], m * n).reshape(m, n).astype(np.float32)
        out *= self.ring[lo:hi]
        out[np.arange(m), np.arange(lo, hi)] = -1
        return out

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The nearest remainders of each, best first, and all scores."""
        n = len(self.lengths)
        k, scores = min(NEAR, n - 1), np.empty((n, n), np.float32)
        found = np.zeros((n, max(k, 0)), np.int64)
        for lo in range(0, n, SEEDS):
            hi = min(lo + SEEDS, n)
            own = scores[lo:hi] = self.scores(lo, hi)
            if k > 0:
                top = np.argpartition(own, n - k, axis=1)[:, n - k :]
                found[lo:hi] = np.take_along_axis(top, np.argsort(-np.take_along_axis(own, top, 1), axis=1, kind="stable"), 1)
        return found, scores

    def packed(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (remainder, its first id, length); only the last one may be short."""
        near, scores = self.nearest()
        near, used = near.tolist(), np.zeros(len(self.lengths), bool)
        left: tuple[int, int] | None = None  # a cut remainder and what is used of it
        unused, seed = len(used), 0
        while True:
            if left is None:
                while seed < len(used) and used[seed]:
                    seed += 1
                if seed == len(used):
                    return
                left, used[seed], unused = (seed, 0), True, unused - 1
            row, at = left
            window, room, left = [(row, at, self.lengths[row] - at)], WINDOW - (self.lengths[row] - at), None
            known = near[row]
            for again in (False, True):
                if again and room and unused:  # all that are known are used: the others in order
                    free = np.flatnonzero(~used)
                    known = free[np.argsort(-scores[row][free], kind="stable")].tolist()
                for k in known:
                    if not room:
                        break
                    if not used[k] and k != row:
                        used[k], unused = True, unused - 1
                        n = min(self.lengths[k], room)
                        window.append((k, 0, n))
                        if n < self.lengths[k]:
                            left = (k, n)
                        room -= n
            yield window


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document of (doc_id, text)."""
    spark = docs.sparkSession
    ids = tokenized(docs, tokenizer, end_id)
    from tokenizers import Tokenizer

    df, n_docs, n_ids = document_frequencies(ids, Tokenizer.from_file(tokenizer).get_vocab_size())
    weights = Weights(df, n_docs, n_ids)
    tails = ids.where(F.col("n") % WINDOW > 0).select("doc_id", "n", "tail", "mix")
    # a full window is a sequence with an even number, the others have odd ones
    whole = ids.where(F.col("n") >= WINDOW).select("doc_id", "n", F.posexplode("crcs").alias("at", "crc"))
    whole = whole.select("doc_id", (F.col("at") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    sample = tails.where(F.pmod("mix", F.lit(max(1, n_docs // SAMPLE))) == 0).limit(2 * SAMPLE).select("n", "tail").collect()
    sample = sample or tails.limit(1).select("n", "tail").collect()
    if not sample:
        return whole
    centres = centres_of([_ids(bytes(r["tail"]), r["n"] % WINDOW) for r in sample], weights)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_ids(data, n % WINDOW) for data, n in zip(batch["tail"].to_pylist(), batch["n"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights.places(own, centres) if own else [], pa.int64())], names=[*batch.schema.names, "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []  # held: (doc_id, tokens of the document, first id, ids)

        def pieces(last: bool) -> pa.RecordBatch:
            nonlocal made, held
            shard, rest, out = held, [], []
            for window in Shard([r[3] for r in shard], weights).packed():
                if not last and sum(n for _, _, n in window) < WINDOW:  # it goes on in the next shard
                    rest = [(*shard[k][:2], shard[k][2] + at, shard[k][3][at : at + n]) for k, at, n in window]
                    continue
                offset = 0
                for k, at, n in window:
                    key, tokens, start, own = shard[k]
                    out.append((key, start + at, n, zlib.crc32(own[at : at + n].astype("<u4")), tokens, (part << 32 | made) << 1 | 1, offset))
                    offset += n
                made += 1
            held = rest
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], schema=_KINDS)

        for batch in batches:
            for key, n, data in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "tail")), strict=True):
                held.append((key, n, n - n % WINDOW, _ids(data, n % WINDOW)))
                if len(held) >= SHARD:
                    yield pieces(False)
        if held:
            yield pieces(True)

    # equal contents are split by their hash, so that no range has them all
    tasks = max(1, min(shuffle_tasks(spark), n_docs // SHARD), n_docs // (SHARDS * SHARD))
    # written, since a range partition reads its input twice
    placed_rows = written(tails.mapInArrow(lean_batches(placed), "doc_id long, n long, tail binary, mix long, place long"), "placed")
    dealt = placed_rows.repartitionByRange(tasks, "place", "mix").sortWithinPartitions("place", "mix", "doc_id")
    return whole.unionByName(dealt.select("doc_id", "n", "tail").mapInArrow(lean_batches(pack), PIECES))


def op6_retrieval_packing(spark, sf_dir) -> DataFrame:
    """Pack all documents into windows of 1024."""
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
