"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items make one suffix automaton; a document's
words are streamed through it and at each word the longest match with any item
that ends there is known.  Where it reaches the window (13 words, or a whole
shorter item), the window's words are hit.  Runs of words none of whose short
grams occurs in an item cannot reach a window and are skipped.

The items come to the driver, in blocks of bounded size, each with an automaton
of its own; a Python worker builds them once and streams every batch of documents
through all, without a shuffle.  More than ``MAX_BLOCKS`` blocks are refused: test
sets are small.

Nulls and odd input: a null or empty text has no words and is not contaminated;
an item without words has no window; equal items are each reported; items without
an id hit as others do, count as one item and have no name in a digest; repeated
documents are judged each; an empty table of documents or of items gives an
empty or a clean result; further columns, of any name, are carried through by
:func:`cleaned`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MODELS, as_nullable, lean_batches, packed_row, small_batches, table
from .scan import U, chunks, grams, split_table, words

WINDOW = 13
BLOCK_BYTES = 4 << 20
MAX_BLOCKS = 64
#: Stands for the id of items that have none.
NO_ID = "\x00"
FOUND = "_spans array<struct<start:int,length:int,from:long,to:long>>, _items array<string>, _n_words long"


class Automaton:
    """Suffix automaton of several word sequences; matches never run from one item into another."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.table = window, split_table("alnum")
        texts = pa.array([t for _, t in items], pa.string())
        per_item: list[np.ndarray] = []
        for c in chunks(texts):
            w = words(c, self.table)
            per_item += [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        kept = [(k, h) for (k, _), h in zip(items, per_item, strict=True) if len(h)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in kept])) if kept else np.zeros(0, np.uint64)
        self.shortest = min((min(window, len(h)) for _, h in kept), default=window)
        self.gram = min(self.shortest, 4)
        self.flags = np.zeros(1 << 22, bool)
        for _, h in kept:
            self.flags[grams(h, self.gram) & U(self.flags.size - 1)] = True
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for key, h in kept:
            state = 0
            for word in np.searchsorted(self.vocabulary, h).tolist():
                state = self._extend(state, word)
                ends.setdefault(state, set()).add(key)
        # items that hold a state's strings: those that end there or in a state that links to it
        order = sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True)
        holds: list[set[str]] = [set() for _ in self.length]
        for state, keys in ends.items():
            holds[state] |= keys
        for state in order:
            if self.link[state] >= 0:
                holds[self.link[state]] |= holds[state]
        self.holds = {s: sorted(k) for s, k in enumerate(holds) if k and self.length[s] >= window and (self.link[s] < 0 or self.length[self.link[s]] < window)}
        # short items by their own state
        for key, h in kept:
            if len(h) < window:
                state = 0
                for word in np.searchsorted(self.vocabulary, h).tolist():
                    state = self.next[state][word]
                whole.setdefault(state, []).append((len(h), key))
        self.whole = whole

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit (start, stop) word ranges and the items whose windows occur, for a run of word ids (-1: in no item)."""
        state, matched, spans, items = 0, 0, [], set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for at, word in enumerate(ids):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state, matched = nxt[state][word], matched + 1
            else:
                state, matched = 0, 0
                continue
            up = state
            if matched >= window:
                while length[link[up]] >= window:
                    up = link[up]
                spans.append((at + 1 - window, at + 1))
                items.update(self.holds[up])
            if self.whole:
                while up > 0:
                    for n, key in self.whole.get(up, ()):
                        if n <= matched:
                            spans.append((at + 1 - n, at + 1))
                            items.add(key)
                    up = link[up]
        return spans, items

    def scan(self, column: pa.Array) -> Iterator[tuple[list, list, int]]:
        """Per text: merged hit ranges (first word, words, first byte, stop byte), items, number of words."""
        for c in chunks(column):
            w = words(c, self.table)
            n, g = len(w.hashes), self.gram
            flagged = np.zeros(n, bool)
            if n >= g and len(self.vocabulary):
                flagged[: n - g + 1] = self.flags[grams(w.hashes, g) & U(self.flags.size - 1)]
            for k in range(len(c.bounds) - 1):
                a, b = int(w.first[k]), int(w.first[k + 1])
                at = np.flatnonzero(flagged[a : max(a, b - g + 1)])
                spans, items = [], set()
                if len(at):
                    cuts = np.flatnonzero(np.diff(at) > 1)
                    for lo, hi in zip(at[np.r_[0, cuts + 1]].tolist(), (at[np.r_[cuts, len(at) - 1]] + g).tolist(), strict=True):
                        if hi - lo >= self.shortest:
                            h = w.hashes[a + lo : a + hi]
                            ids = np.searchsorted(self.vocabulary, h)
                            ids[self.vocabulary[np.minimum(ids, len(self.vocabulary) - 1)] != h] = -1
                            own, keys = self.stream(ids.tolist())
                            spans += [(lo + x, lo + y) for x, y in own]
                            items |= keys
                yield [(x, y - x, int(w.starts[a + x] - c.bounds[k]), int(w.stops[a + y - 1] - c.bounds[k])) for x, y in _merged(spans)], sorted(items), b - a


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame) -> list[list[tuple[str, str]]]:
    """The items (item_id, text) in blocks of bounded size."""
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = (size["b"] or 0) + 16 * size["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    if blocks > MAX_BLOCKS:
        raise ValueError(f"{total} bytes of test items; at most {MAX_BLOCKS * BLOCK_BYTES} are taken")
    rows = items.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit(NO_ID)).alias("k"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("b"))
    found: list[list[tuple[str, str]]] = [[] for _ in range(blocks)]
    for r in rows.collect():
        found[r["b"]].append((r["k"], r["text"]))
    return found


#: The automata that this Python worker has built last.
_BUILT: dict[str, list[Automaton]] = {}
MODELS.append(_BUILT)


def _automata(key: str, blocks: list[list[tuple[str, str]]], window: int) -> list[Automaton]:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [Automaton(b, window) for b in blocks]
    return _BUILT[key]


def _joint(found: list[tuple[list, list, int]]) -> tuple[list, list, int]:
    """What several automata found in one text."""
    hits = [f for f in found if f[0]]
    if len(hits) <= 1:
        return hits[0] if hits else found[0]
    first = {a: x for spans, _, _ in hits for a, _, x, _ in spans}
    last = {a + n: x for spans, _, _ in hits for a, n, _, x in spans}
    spans = _merged([(a, a + n) for s, _, _ in hits for a, n, _, _ in s])
    return [(a, b - a, first[a], last[b]) for a, b in spans], sorted({k for _, keys, _ in hits for k in keys}), found[0][2]


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``_spans``, ``_items`` and ``_n_words`` to rows with a column ``_text``."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*as_nullable(docs.schema).fields, *T._parse_datatype_string(FOUND).fields])
    span = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("from", pa.int64()), ("to", pa.int64())])
    blocks, key = item_blocks(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(key, blocks, window)
        for batch in batches:
            found = [_joint(list(x)) for x in zip(*(a.scan(batch["_text"]) for a in automata), strict=True)]
            spans = [[dict(zip(("start", "length", "from", "to"), x, strict=True)) for x in s] for s, _, _ in found]
            keys = [[None if k == NO_ID else k for k in keys] for _, keys, _ in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(span)), pa.array(keys, pa.list_(pa.string())), pa.array([n for _, _, n in found], pa.int64())], names=[*batch.schema.names, "_spans", "_items", "_n_words"])

    return docs.mapInArrow(lean_batches(run), schema)


def n_hit():
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])


def contaminated():
    return (n_hit() > 0) & (20 * n_hit() >= F.col("_n_words"))


def cleaned(docs: DataFrame, items: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Drop contaminated documents; from the others cut the hit spans.  ``length`` names a column that holds the text's length."""
    rows = matched(docs.select(packed_row(docs, *docs.columns).alias("_row"), docs[text].alias("_text")), items).where(~contaminated())
    data = F.encode("_text", "utf-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["to"]))
    stops = F.concat(F.transform("_spans", lambda s: s["from"]), F.array(F.octet_length("_text").cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.decode(F.substring(data, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "utf-8")), "")
    new = F.when(F.size("_spans") > 0, kept).otherwise(F.col("_text"))
    rows = rows.select("_row", new.alias("_new"))
    columns = [F.col("_new").alias(text) if c == text else F.length("_new").cast(docs.schema[c].dataType).alias(c) if c == length else F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)]
    return rows.select(*columns)


def op1_decontaminate(spark, sf_dir) -> DataFrame:
    """Match all documents with all test items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"))
    found = matched(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS g FROM b, range(1, greatest(len(b.w) - 12, 1) + 1) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM d, sizes, range(1, len(d.w) + 1) r(i) WHERE i + n - 1 <= len(w)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, range(i, i + n) q(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
