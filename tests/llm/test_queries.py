"""The registered queries against brute force, and tables that are hard on memory."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from orvane.llm import registry, sharding, suffix_dedup
from orvane.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LEAST = -(1 << 63)


@pytest.fixture(scope="session")
def sf_dir(docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rank(key):
    return LEAST if key is None else key


def brute_removed(rows, length=50):
    """(doc_id, bytes, removed, spans, digest) of each row."""
    first = {}
    for key, text in rows:
        b = (text or "").encode()
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            first[w] = min(first.get(w, rank(key)), rank(key))
    out = []
    for key, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < rank(key):
                gone[a : a + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((key, len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_op2(spark, sf_dir, rows, monkeypatch):
    monkeypatch.setattr("orvane.llm.shared.BLOCK_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", 4000)
    got = registry.queries()["op2_suffix_dedup"](spark, sf_dir).collect()
    assert Counter(map(tuple, got)) == Counter(brute_removed([r[:2] for r in rows]))


def test_op2_when_hashes_tie(spark, sf_dir, rows, monkeypatch):
    """Anchors of 3 bits and contexts of 2: everything ties, the result is the same."""
    grams, mixed = suffix_dedup._gram_hashes, suffix_dedup.mixed
    monkeypatch.setattr(suffix_dedup, "_gram_hashes", lambda data: grams(data) & np.uint64(7))
    monkeypatch.setattr(suffix_dedup, "mixed", lambda h: mixed(h) & np.uint64(3))
    texts = [r[:2] for r in rows if len(r[1] or "") < 2000][:25]
    block = pa.table({"doc_id": pa.array([k for k, _ in texts], pa.int64()), "_text": pa.array([t or "" for _, t in texts]), "_block": pa.array([0] * len(texts))})
    own = suffix_dedup._Block(suffix_dedup.ordered(block))
    held = suffix_dedup._Contexts(own, np.ones(len(own.hashes), np.uint8), 1)
    shard = pa.table({"shard": [0], "block": [0], "texts": [suffix_dedup._bytes_of(own.data, held.sent_first, held.sent_n)], "counts": [held.sent_n.astype("u1").tobytes()], "least": [held.sent_least.tobytes()], "tags": [(held.tags >> np.uint64(32)).astype("<u4").tobytes()]})
    back = suffix_dedup._owned(shard)
    owner = np.repeat(np.frombuffer(back["owners"][0].as_py(), "<i8"), np.frombuffer(back["runs"][0].as_py(), "<u4"))
    spans = suffix_dedup._gone(own, held, owner)
    want = {(k, t or ""): n for (k, t), (_, _, n, _, _) in zip(texts, brute_removed(texts), strict=True)}
    for k, t, c in zip(suffix_dedup.ordered(block)["doc_id"].to_pylist(), suffix_dedup.ordered(block)["_text"].to_pylist(), own.code.tolist(), strict=True):
        if rank(k) == own.least[c]:
            assert int((spans[c][:, 1] - spans[c][:, 0]).sum()) == want[k, t]


def test_op2_very_long_texts_and_repeats(spark, tmp_path):
    """A text of 50 MB, a second one that repeats its last megabyte, and 100,000 rows that are all the same."""
    words = [f"w{k:05d}" for k in range(60_000)]
    long = " ".join(random.Random(1).choices(words, k=50_000_000 // 7))
    rows = [(1, long), (2, "another beginning " + long[-1_000_000:])]
    docs = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in rows], SCHEMA)
    same = spark.range(100_000).selectExpr("cast(7 as long) doc_id", f"'{long[:300]}' text", "cast(null as string) lang", "cast(null as string) source", "300L n_chars")
    docs.union(same).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op2_suffix_dedup(spark, str(tmp_path)).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["count"]) for r in got} == {1: (len(long), 0, 0, 1), 2: (1_000_018, 1_000_001, 1, 1) if long[-1_000_001] == " " else (1_000_018, 1_000_000, 1, 1), 7: (300, 300, 1, 100_000)}


def test_op8(spark, sf_dir, rows):
    got = sorted(registry.queries()["op8_token_files"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=lambda r: r["start"])
    library = encoder(default_tokenizer()).library
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((k, len(ids(t)), zlib.crc32(ids(t).tobytes())) for k, t, *_ in rows)
    assert [rank(r["doc_id"]) for r in got] == sorted(rank(r[0]) for r in rows)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_op9(spark, sf_dir, rows):
    got = registry.queries()["op9_feistel_shards"](spark, sf_dir).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == len(rows)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    again = registry.queries()["op9_feistel_shards"](spark, sf_dir).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got)), "reproducible"
    assert sharding.locate(np.array([0]), np.array([0]), 8, 100, 1).tolist() == [int(np.flatnonzero(sharding.permute(np.arange(100), 100, 1) == 0)[0])]


def brute_quality(rows):
    """(row, measures with the base verdict, posterior by an own EM) of each row."""
    seen = []
    for row in rows:
        t = row[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, c, dup = max(1, len(w)), max(1, sum(map(len, w))), len(lines) - len(set(lines))
        symbols, upper, shout, digits = (len(re.findall(x, t)) for x in (r"[#*$%&|<>]", "[A-Z]", "!", "[0-9]"))
        marked = sum(bool(regex.search(r"[#*$%&|<>=^_{}\[\]\\~]|^[^\p{L}\p{N}]+$", x)) for x in w)
        rule = [
            (n < 12, n >= 60), (c / n < 3 or c / n > 10, 3.5 <= c / n <= 9), (symbols / n > 0.1, symbols / n <= 0.02), (marked / n > 0.2, marked / n <= 0.05),
            (len(lines) >= 3 and dup / max(1, len(lines)) > 0.3, len(lines) >= 3 and dup == 0), (len(covered) / n > 0.1, n >= 20 and not covered), (upper / c > 0.3, upper / c < 0.1), (shout / n > 0.2, shout / n < 0.02), (digits / c > 0.3, digits / c < 0.1),
        ]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        seen.append((row, (len(w), sum(map(len, w)), symbols, dup, len(covered), failed), np.array([2 if bad else int(good) for bad, good in rule])))
    v = np.array([x[-1] for x in seen])
    good, bad = v == 1, v == 2
    post = np.where(bad.any(1), (1 + good.sum(1)) / (2 + good.sum(1) + 2 * bad.sum(1)), 0.95)
    for _ in range(200):
        share = (post.sum() + 8) / (len(post) + 10)
        g = ((post[:, None] * good).sum(0) + 18) / ((post[:, None] * (good | bad)).sum(0) + 20)
        b = (((1 - post)[:, None] * bad).sum(0) + 10) / (((1 - post)[:, None] * (good | bad)).sum(0) + 20)
        post = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + good @ np.log(g / (1 - b)) + bad @ np.log((1 - g) / b))))
    return [(row, found, p) for (row, found, _), p in zip(seen, post.tolist(), strict=True)]


def test_op7(spark, sf_dir, rows):
    """Measures, base verdict, posterior and kept."""
    got = registry.queries()["op7_weak_supervision"](spark, sf_dir).collect()
    want = brute_quality(rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == Counter((row[0], *found, p >= 0.5 and not found[-1]) for row, found, p in want)
    assert np.allclose(sorted(r["posterior"] for r in got), sorted(p for _, _, p in want), atol=1e-4)
