"""Suffix-array deduplication of 50-byte strings across documents.

Finding strings.  Every 50-byte window has an anchor: the least of its 27
hashes of 24 bytes.  Equal windows have equal anchors, so windows are sharded by
content.  Anchors seen once in the corpus (see :mod:`.shared`) hold no repeated
window and are dropped; consecutive windows of one anchor make a context, their
joint bytes (76 at most).  Equal texts of a block of documents are one text, and
equal contexts one context, with the smallest doc_id; contexts are compared
byte by byte, so nothing rests on a hash.

Shards.  A bucket of anchors gathers the contexts of all blocks.  All of them
are cut to shards of bounded bytes, between anchors if they can; each shard has
a suffix array made by Larsson-Sadakane refinement (groups of equal rank are
split by the rank ``h`` further on, ``h`` doubling) and common prefixes by
Kasai's rule (only the irreducible ones are compared; the others follow from
their left neighbour).  Runs with common prefixes of 50 or more are the classes
of equal windows, with their smallest doc_id, the owner.  Where an anchor's
contexts fill several shards, these are merged by binary search in their sorted
windows.

Anchors that are very frequent would fill one bucket.  Their distinct contexts
are cut into single windows, which are dealt by their own hash and go through
the same shards: each block sends one of a kind.

Owners go back to the blocks, run-length encoded, where windows owned by a
smaller doc_id mark their bytes.  All of a block's work is on arrays, and what is
made for each window is made for a bounded number of windows at a time.

Nulls and odd input: a null text is empty; texts of under 50 bytes lose
nothing; rows with equal doc_id count as one document, so none of them loses
bytes to another; a null doc_id comes before all others; an empty table gives an
empty result; further columns are carried through by :func:`deduplicated`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, packed_row, small_batches, table, text_bytes
from .scan import U, mixed, text_buffers
from .shared import buckets_for, classes_for, in_blocks, ordered, shared_classes

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Windows that are scanned at once, so that the arrays stay in a core's cache.
PART = 96 << 10
#: Bytes of contexts in a shard.
SHARD_BYTES = 192 << 10
#: Bytes of text for each bucket of contexts.
BUCKET_TEXT = 8 << 20
#: Class (bits of the count) from which an anchor's contexts are cut to windows.
FREQUENT = 13
#: A context in a row of its own: its bytes, zeros, and its number of windows in the last place.
ROW = 80
#: Rows that are gathered at once.
AT_ONCE = 1 << 14
NONE = np.int64(np.iinfo(np.int64).min)
MOST = np.iinfo(np.int64).max


def runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of runs that begin at ``starts`` and are ``n`` long."""
    return np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


# -- anchors ---------------------------------------------------------------


def _joined(h: np.ndarray, width: int, key: int) -> np.ndarray:
    """Hashes of ``2 * width`` bytes from those of ``width`` bytes."""
    return (h[:-width] ^ (h[:-width] >> U(29))) * U(key) + h[width:]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h1 = (data.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
    h2 = _joined(h1, 1, 0xBF58476D1CE4E5B9)
    h4 = _joined(h2, 2, 0x94D049BB133111EB)
    h8 = _joined(h4, 4, 0xD6E8FEB86659FD93)
    h16 = _joined(h8, 8, 0xA0761D6478BD642F)
    return mixed((h16[:-8] ^ (h16[:-8] >> U(31))) * U(0xE7037ED1A0B428DB) + h8[16:])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each run of up to 27 windows of one anchor; windows do not cross texts.

    An anchor is a hash alone, whatever stands around the window, so equal
    windows have equal anchors even where hashes tie.
    """
    starts, stops = bounds[:-1], bounds[1:] - LENGTH + 1
    whole = starts < stops
    starts, stops = starts[whole], stops[whole]
    found, end = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], len(data) - LENGTH + 1
    for lo in range(0, end if len(starts) else 0, PART):
        hi = min(lo + PART, end)
        key = _gram_hashes(data[lo : hi + LENGTH - 1])
        for step in (1, 2, 4, 8, SPAN - 16):
            key = np.minimum(key[:-step], key[step:])
        new = np.ones(hi - lo, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        for edges in (starts, stops):
            a, b = np.searchsorted(edges, (lo, hi))
            new[edges[a:b] - lo] = True
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, hi - lo])
        if n.max() > SPAN:  # one hash again and again
            times = -(-n // SPAN)
            at = runs(np.zeros(len(n), np.int64), times) * SPAN
            first, n = np.repeat(first, times) + at, np.minimum(np.repeat(n, times) - at, SPAN)
        text = np.searchsorted(starts, first + lo, "right") - 1
        ok = (text >= 0) & (first + lo < stops[np.maximum(text, 0)])
        found.append((key[first[ok]], first[ok] + lo, n[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# -- contexts as rows ---------------------------------------------------------


_MASKS = (np.arange(ROW) < (np.arange(SPAN + 1) + LENGTH - 1)[:, None]).astype(np.uint8) * np.uint8(255)


def _rows(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The contexts of ``n`` windows from ``first``; ``data`` has ``ROW`` bytes to spare at its end."""
    out = np.lib.stride_tricks.sliding_window_view(data, ROW)[first]
    out &= _MASKS[n]
    out[:, ROW - 1] = n
    return out


def _hashed(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), np.uint64)
    for lo in range(0, len(first), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        w = _rows(data, first[part], n[part]).view(np.uint64)
        h = w[:, ROW // 8 - 1] * U(0x9E3779B97F4A7C15)
        for k in range(ROW // 8 - 1):
            h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93) + w[:, k]
        out[part] = mixed(h)
    return out


def folded(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct number of each context, one of each distinct, and all hashes.

    Equal numbers mean equal bytes.  Should hashes tie, equal contexts may get
    several numbers, which costs time only.
    """
    h = _hashed(data, first, n)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    tied = np.flatnonzero(~new)
    for lo in range(0, len(tied), AT_ONCE):
        k = tied[lo : lo + AT_ONCE]
        a, b = order[k], order[k - 1]
        new[k] = (_rows(data, first[a], n[a]).view(np.uint64) != _rows(data, first[b], n[b]).view(np.uint64)).any(axis=1)
    to = np.empty(len(h), np.int64)
    to[order] = np.cumsum(new) - 1
    return to, order[new], h


def _least(values: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, MOST)
    np.minimum.at(out, to, values)
    return out


# -- suffix array and common prefixes -----------------------------------------


#: Up to so many symbols a rank and a place fit in one number together with another rank.
SMALL = 1 << 21


def _by(key: np.ndarray, places: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys in the order of the keys; where they fit in one number, both are sorted as one."""
    if small:
        both = np.sort(key << 21 | places)
        return both & (SMALL - 1), both >> 21
    order = np.argsort(key)
    return places[order], key[order]


def suffix_array(symbols: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``symbols`` (values 0..256) by their first ``reach`` or more symbols, and packed leading symbols.

    The first order is by 4 symbols.  Then, in rounds, the members of each
    group of equal rank are sorted by the rank ``h`` symbols further on, where
    ``h`` doubles; groups of one are done.
    """
    n, small = len(symbols), len(symbols) < SMALL
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = symbols + 1  # 0 is the end
    packed = np.zeros(n, np.int64)
    for k in range(7):
        packed = packed << 9 | wide[k : k + n]
    order, key = _by(packed >> 27, np.arange(n), small)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(first + 1, size)  # the end has rank 0
    h = 4
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while h < reach and len(slots):
        members = order[slots]
        # groups lie side by side, so their numbers among the open ones are sorted
        group = rank[members]
        group = np.cumsum(np.r_[0, group[1:] != group[:-1]])
        far = rank[np.minimum(members + h, n)]
        if small:
            members, key = _by(group << 21 | far, members, True)
        else:
            members, key = _by(group * (n + 2) + far, members, False)
        order[slots] = members
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(slots)])
        rank[members] = np.repeat(slots[first] + 1, size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order, packed


#: Least values of numbers with over 1 to 6 packed symbols.
_NINE = 1 << (9 * np.arange(1, 7, dtype=np.int64))


def common_prefixes(symbols: np.ndarray, order: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, as far as ``order`` is right.

    In text order a common prefix is at least its left neighbour's less one
    (Kasai), and exactly that where the symbols before both suffixes agree.
    The others, the irreducible ones, are compared, seven symbols at a time.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    has = before > 0
    reducible = np.zeros(n, bool)
    reducible[1:] = has[1:] & (symbols[place[1:] - 1] == symbols[np.maximum(before[1:], 1) - 1]) & (before[place[1:] - 1] == before[1:] - 1)
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(~reducible & (before >= 0))
    a, b, same = todo, before[todo], np.zeros(len(todo), np.int64)
    active = np.arange(len(todo))
    while len(active):
        x, y = a[active] + same[active], b[active] + same[active]
        fine = (x < n) & (y < n)
        active, x, y = active[fine], x[fine], y[fine]
        equal = packed[x] == packed[y]
        rest = active[~equal]
        differ = packed[x[~equal]] ^ packed[y[~equal]]
        same[rest] += 6 - np.searchsorted(_NINE, differ, "right")
        active = active[equal]
        same[active] += 7
    out[todo] = np.minimum(same, n - np.maximum(a, b))
    known = np.maximum.accumulate(np.where(reducible, -1, place))
    lag = place - np.maximum(known, 0)
    out = np.where(reducible, np.maximum(out[np.maximum(known, 0)] - lag, 0), out)
    return out[order]


class _Shard:
    """Contexts, the classes of their equal windows in suffix order, and each class's smallest owner."""

    def __init__(self, data: np.ndarray, first: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        lengths = counts + LENGTH - 1
        starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        source, to = runs(first, lengths), runs(starts, lengths)
        self.whole = np.zeros(int(lengths.sum()) + len(lengths) + LENGTH, np.uint8)
        self.whole[to] = data[source]
        symbols = np.zeros(int(lengths.sum()) + len(lengths), np.int64)  # 0 ends a context
        symbols[to] = data[source] + np.int64(1)
        order, packed = suffix_array(symbols, LENGTH)
        prefix = common_prefixes(symbols, order, packed)
        window = np.full(len(symbols), -1, np.int64)  # the window that begins at a place
        flat = runs(starts, counts)
        window[flat] = np.arange(len(flat))
        new = np.cumsum(prefix < LENGTH)
        taken = window[order] >= 0
        in_order, run = window[order][taken], new[taken]
        edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        self.owner = np.minimum.reduceat(np.repeat(owners, counts)[in_order], edge)
        self.cls = np.empty(len(flat), np.int64)
        self.cls[in_order] = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(in_order)]))
        self.at = flat[in_order[edge]]

    def keys(self) -> np.ndarray:
        """The classes' windows in order, as fixed bytes (a last byte keeps nulls at the end)."""
        raw = np.lib.stride_tricks.sliding_window_view(self.whole, LENGTH)[self.at]
        return np.ascontiguousarray(np.concatenate([raw, np.ones((len(raw), 1), np.uint8)], axis=1)).view(f"S{LENGTH + 1}").ravel()


def owners_of(data: np.ndarray, first: np.ndarray, counts: np.ndarray, owners: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The smallest owner of every window of the contexts at ``first`` (``counts`` windows each, in order of ``tags``).

    Equal windows have equal tags.  Shards are cut between tags; the shards of
    a tag that is too large for one are merged by binary search.
    """
    ends = np.cumsum(counts + LENGTH)
    edges = np.r_[np.flatnonzero(tags[1:] != tags[:-1]) + 1, len(counts)]
    shards, chains, a, inside = [], [], 0, False
    while a < len(counts):
        most = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SHARD_BYTES, "right")))
        edge = edges[np.searchsorted(edges, most, "right") - 1] if edges[0] <= most else a
        b = int(edge) if edge > a else most
        shards.append(_Shard(data, first[a:b], counts[a:b], owners[a:b]))
        lasting = inside or b < len(counts) and tags[b] == tags[b - 1]
        if not lasting:  # no other shard has its windows
            shards[-1] = shards[-1].owner[shards[-1].cls]
        elif inside:
            chains[-1].append(shards[-1])
        else:
            chains.append([shards[-1]])
        inside = b < len(counts) and tags[b] == tags[b - 1]
        a = b
    for chain in chains:
        keys = [s.keys() for s in chain]
        for i, s in enumerate(chain):  # each shard's classes are looked up in every other's of its chain
            for j in range(i + 1, len(chain)):
                t = chain[j]
                at = np.minimum(np.searchsorted(keys[j], keys[i]), len(keys[j]) - 1)
                hit = np.flatnonzero(keys[j][at] == keys[i])
                least = np.minimum(s.owner[hit], t.owner[at[hit]])
                s.owner[hit], t.owner[at[hit]] = least, least
    return np.concatenate([np.zeros(0, np.int64), *(s.owner[s.cls] if isinstance(s, _Shard) else s for s in shards)])


# -- blocks ---------------------------------------------------------------------


class _Block:
    """The distinct texts of a block in order, and their anchors."""

    def __init__(self, block: pa.Table):
        texts = block["_text"].combine_chunks().dictionary_encode()
        self.code = texts.indices.to_numpy()
        self.rank = pc.fill_null(block["doc_id"], int(NONE)).to_numpy()
        self.least = _least(self.rank, self.code, len(texts.dictionary))
        data, bounds = text_buffers(texts.dictionary)
        self.data = np.concatenate([data[bounds[0] : bounds[-1]], np.zeros(ROW, np.uint8)])
        self.bounds = bounds - bounds[0]
        self.hashes, self.first, self.n = anchors(self.data[:-ROW], self.bounds)


class _Contexts:
    """The shared contexts of a block: each occurrence's distinct one, and what is sent of those."""

    def __init__(self, block: _Block, classes: np.ndarray, buckets: int):
        shared = np.flatnonzero(classes > 0)
        self.first, self.n = block.first[shared], block.n[shared]
        # empty texts share their bound with the next one: the last of equals is meant
        self.text = np.searchsorted(block.bounds, self.first, "right") - 1
        self.to, pick, _ = folded(block.data, self.first, self.n)
        first, n, least = self.first[pick], self.n[pick], _least(block.least[self.text], self.to, len(pick))
        often = classes[shared][pick] >= FREQUENT
        single = runs(first[often], n[often])
        one = np.ones(len(single), np.int64)
        window, some, h = folded(block.data, single, one)
        self.sent_first = np.r_[first[~often], single[some]]
        self.sent_n = np.r_[n[~often], one[some]]
        self.sent_least = np.r_[least[~often], _least(np.repeat(least[often], n[often]), window, len(some))]
        self.tags = np.r_[block.hashes[shared][pick][~often], h[some]]
        self.bucket = ((self.tags >> U(13)) % U(buckets)).astype(np.int64)
        # where a distinct context's windows are among all that is sent, window by window
        sent_at = np.cumsum(self.sent_n) - self.sent_n
        self.at = np.cumsum(n) - n
        self.window = np.empty(int(n.sum()), np.int64)
        self.window[runs(self.at[~often], n[~often])] = runs(sent_at[: int((~often).sum())], n[~often])
        self.window[runs(self.at[often], n[often])] = int(n[~often].sum()) + window

    def dealt(self) -> list[tuple[int, np.ndarray]]:
        """Each bucket with what is sent to it."""
        order = np.argsort(self.bucket, kind="stable")
        used, edge = np.unique(self.bucket[order], return_index=True)
        return list(zip(used.tolist(), np.split(order, edge[1:]), strict=True))


def _bytes_of(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    """The contexts one after the other."""
    return data[runs(first, n + LENGTH - 1)].tobytes()


_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *((x, pa.binary()) for x in ("texts", "counts", "least", "tags"))])


def _owned(shard: pa.Table) -> pa.Table:
    """The owners of all windows of a bucket, for each block that sent some."""
    shard = shard.sort_by("block")
    data, bounds = text_buffers(shard["texts"].combine_chunks())
    data = np.concatenate([data[bounds[0] : bounds[-1]], np.zeros(ROW, np.uint8)])
    values = {c: np.frombuffer(b"".join(shard[c].to_pylist()), k) for c, k in (("counts", "u1"), ("least", "<i8"), ("tags", "<u4"))}
    counts = values["counts"].astype(np.int64)
    first = np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)
    to, pick, _ = folded(data, first, counts)  # equal contexts of several blocks are one
    pick_order = np.argsort(values["tags"][pick], kind="stable")  # contexts of one anchor side by side
    pick = pick[pick_order]
    place = np.empty(len(pick), np.int64)
    place[pick_order] = np.arange(len(pick))
    to = place[to]
    answer = owners_of(data, first[pick], counts[pick], _least(values["least"], to, len(pick)), values["tags"][pick])
    at = np.cumsum(counts[pick]) - counts[pick]
    cuts, back = np.r_[0, np.cumsum([len(x) for x in shard["counts"].to_pylist()])], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = answer[runs(at[to[a:b]], counts[a:b])]
        change = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        back.append((np.diff(np.r_[change, len(own)]).astype("<u4").tobytes(), own[change].astype("<i8").tobytes()))
    return pa.table({"block": shard["block"], "shard": shard["shard"], "runs": pa.array([x for x, _ in back], pa.binary()), "owners": pa.array([x for _, x in back], pa.binary())})


def _gone(block: _Block, held: _Contexts, owner: np.ndarray) -> list[np.ndarray]:
    """For each distinct text its maximal removed runs, as rows (start, stop)."""
    found = [(np.zeros(0, np.int64),) * 3]
    for lo in range(0, len(held.first), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        n, text = held.n[part], held.text[part]
        mine = owner[held.window[runs(held.at[held.to[part]], n)]] < np.repeat(block.least[text], n)
        at, of = runs(held.first[part], n)[mine], np.repeat(text, n)[mine]
        if len(at):
            edge = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + LENGTH) | (of[1:] != of[:-1])])
            found.append((at[edge], at[np.r_[edge[1:], len(at)] - 1] + LENGTH, of[edge]))
    start, stop, of = (np.concatenate(x) for x in zip(*found, strict=True))
    edge = np.flatnonzero(np.r_[len(start) > 0, (start[1:] > stop[:-1]) | (of[1:] != of[:-1])])
    spans = np.stack([start[edge], stop[np.r_[edge[1:], len(stop)] - 1] if len(edge) else stop], axis=1) - block.bounds[of[edge]][:, None]
    return np.split(spans, np.searchsorted(of[edge], np.arange(1, len(block.least))))


def removed_bytes(docs: DataFrame, size: int, outputs: str | T.StructType, output) -> DataFrame:
    """Apply ``output(block table in order, [rows (start, stop) of removed runs for each row])`` to every block of (doc_id, _text, ...)."""
    small_batches(docs.sparkSession)
    blocks = in_blocks(docs, size)
    buckets, shards = buckets_for(size // 14), max(1, size // BUCKET_TEXT)

    def hashes_of(block: pa.Table) -> np.ndarray:
        return _Block(block).hashes  # the exchange of the blocks serves all three passes

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):
            return _SENT.empty_table()
        number, own = block["_block"][0].as_py(), _Block(ordered(block))
        held, rows = _Contexts(own, classes_for(own.hashes, answers, buckets), shards), []
        for s, k in held.dealt():
            rows.append((s, number, _bytes_of(own.data, held.sent_first[k], held.sent_n[k]), held.sent_n[k].astype("u1").tobytes(), held.sent_least[k].astype("<i8").tobytes(), (held.tags[k] >> U(32)).astype("<u4").tobytes()))
        return pa.table(list(zip(*rows, strict=True)), schema=_SENT) if rows else _SENT.empty_table()

    def mark(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = ordered(block)
        own = _Block(block)
        known = answers["classes"].is_valid()
        held = _Contexts(own, classes_for(own.hashes, answers.filter(known), buckets), shards)
        answers = answers.filter(pc.invert(known))
        found = {s - OWNERS: (r, o) for s, r, o in zip(*(answers[x].to_pylist() for x in ("bucket", "runs", "owners")), strict=True)}
        owner = np.empty(int(held.sent_n.sum()), np.int64)
        at = np.cumsum(held.sent_n) - held.sent_n
        for s, k in held.dealt():
            times, values = found[s]
            owner[runs(at[k], held.sent_n[k])] = np.repeat(np.frombuffer(values, "<i8"), np.frombuffer(times, "<u4"))
        spans, sizes = _gone(own, held, owner), np.diff(own.bounds)
        # a copy of a smaller doc_id's text goes whole
        whole = [np.array([[0, n]]) if n >= LENGTH else np.zeros((0, 2), np.int64) for n in sizes.tolist()]
        copies = own.rank > own.least[own.code]
        return output(block, [whole[c] if copy else spans[c] for c, copy in zip(own.code.tolist(), copies.tolist(), strict=True)])

    answers = shared_classes(blocks, hashes_of, buckets)
    sent = blocks.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(lean(send), "shard int, block int, texts binary, counts binary, least binary, tags binary")
    owned = sent.groupBy("shard").applyInArrow(lean(_owned), "block int, shard int, runs binary, owners binary")
    nothing = F.lit(None).cast("binary")
    both = answers.select("block", "bucket", "classes", nothing.alias("runs"), nothing.alias("owners")).union(owned.select("block", (F.col("shard") + OWNERS).alias("bucket"), nothing.alias("classes"), "runs", "owners"))
    return blocks.groupBy("_block").cogroup(both.groupBy("block")).applyInArrow(lean(mark), outputs)


#: Owners' rows are told from those of the counting buckets by this much.
OWNERS = 1 << 30


def _kept(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    """Remove repeated 50-byte strings from all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(block: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        rows = []
        for key, text, gone in zip(block["doc_id"].to_pylist(), block["_text"].cast(pa.binary()).to_pylist(), spans, strict=True):
            rows.append((key, len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(_kept(text, gone)).hexdigest()))
        return pa.table(list(zip(*rows, strict=True)), schema=kind)

    return removed_bytes(docs, text_bytes(docs.withColumnRenamed("_text", "text"))[1], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)


def deduplicated(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeated strings; a document of which nothing is left goes.

    Cut characters, of which some bytes are removed, go whole.  ``length``
    names a column that holds the text's length.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("_text"), packed_row(docs, *rest, none=docs[text].isNull()).alias("_rest"))
    kind = T.StructType([T.StructField("_new", T.StringType()), T.StructField("_left", T.BooleanType()), rows.schema["_rest"]])

    def cut(block: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        new, left = [], []
        for old, gone in zip(block["_text"].cast(pa.binary()).to_pylist(), spans, strict=True):
            new.append(_kept(old, gone).decode(errors="ignore"))
            left.append(not len(gone) or bool(new[-1]))
        return pa.table({"_new": pa.array(new, pa.string()), "_left": pa.array(left), "_rest": block["_rest"]})

    size = text_bytes(rows.select(F.col("_text").alias("text")))[1]
    done = removed_bytes(rows, size, kind, cut).where("_left")
    new = F.when(~F.col("_rest.none"), F.col("_new"))
    columns = {text: new} | {c: F.length(new).cast(docs.schema[c].dataType) if c == length else F.col(f"_rest.c{k}") for k, c in enumerate(rest)}
    return done.select(*(columns[c].alias(c) for c in docs.columns))
