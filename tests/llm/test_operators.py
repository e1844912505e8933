"""Each operator against a brute-force version on a small table of awkward rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orvane.llm import chat, decontaminate, jaccard, packing, quality, sharding, suffix_dedup, token_files, url_filter, warc
from orvane.llm.common import as_nullable, new_folder, text_bytes
from orvane.llm.tokens import default_tokenizer, encoder

SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def as_text(df):
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))


def size(df):
    return text_bytes(df)[1]


def counted(rows):
    return Counter(tuple(r) for r in rows)


# -- 1 --------------------------------------------------------------------------------


def brute_contamination(text, items, n=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, keys = find(text), set(), set()
    for key, t in items:
        i = find(t)
        if t is None or not i:
            continue
        m = min(n, len(i))
        windows = {tuple(i[a : a + m]) for a in range(len(i) - m + 1)}
        for a in range(len(w) - m + 1):
            if tuple(w[a : a + m]) in windows:
                hit.update(range(a, a + m))
                keys.add("" if key is None else str(key))
    return len(w), len(hit), sorted(keys)


def items_of(rows):
    texts = [t for _, t, *_ in rows if t]
    long = max(texts, key=len).split()
    return [(1, " ".join(long[40:75])), (2, " ".join(long[50:63]).upper()), (3, " ".join(long[7:10])), (10, "a"), (11, ""), (12, None), (13, " ".join(long[50:63])), (None, " ".join(long[200:230])), (14, "never seen words " * 6), (15, " ".join(long[100:112]) + " " + " ".join(long[300:320]))]


@pytest.mark.parametrize("block_bytes", [1 << 22, 120])
def test_decontamination(spark, docs, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matched(docs.select("doc_id", F.col("text").alias("_text")), table).select("doc_id", "_text", "_n_words", decontaminate.n_hit().alias("h"), "_items").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["_n_words"], r["h"], sorted(k or "" for k in r["_items"])) == brute_contamination(r["_text"], items)


def test_decontamination_cuts_spans(spark, docs, rows, none, odd):
    items = spark.createDataFrame(items_of(rows), "item_id long, text string")
    left = decontaminate.cleaned(odd, items)
    assert left.columns == odd.columns
    got = {r["doc_id"]: r for r in left.collect() if r["doc_id"] is not None}
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        n, h, _ = brute_contamination(text, items_of(rows))
        assert (doc_id in got) == (not (h and 20 * h >= n))
        if doc_id in got and not h:
            assert got[doc_id]["text"] == text
        elif doc_id in got:
            assert brute_contamination(got[doc_id]["text"], [i for i in items_of(rows) if i[0] in (1, 2, 13, None)])[1] == 0
    assert decontaminate.cleaned(none, items).count() == 0
    assert decontaminate.cleaned(docs, items.limit(0)).count() == len(rows)


# -- 2 --------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for _ in range(60):
        s = r.integers(0, 3, int(r.integers(1, 120)))
        order, packed = suffix_dedup.suffix_array(s, 10**6)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        got = suffix_dedup.common_prefixes(s, order, packed)
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            assert got[k] == (differ[0] if len(differ) else m)


@pytest.mark.parametrize("frequent, shard", [(13, 192 << 10), (2, 192 << 10), (13, 150)])
def test_suffix_dedup(spark, docs, rows, monkeypatch, frequent, shard):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", 4000)
    monkeypatch.setattr("orvane.llm.shared.BLOCK_BYTES", 9000)

    def digest(block, spans):
        import pyarrow as pa

        return pa.table({"doc_id": block["doc_id"], "text": block["_text"], "gone": pa.array([[x for a, b in s.tolist() for x in range(a, b)] for s in spans], pa.list_(pa.int64()))})

    got = suffix_dedup.removed_bytes(as_text(docs), size(docs), "doc_id long, text string, gone array<long>", digest).collect()
    order = lambda i: -(10**9) if i is None else i
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            first[b[a : a + 50]] = min(first.get(b[a : a + 50], 10**9), order(i))
    assert len(got) == len(rows)
    for r in got:
        b, want = r["text"].encode(), set()
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < order(r["doc_id"]):
                want.update(range(a, a + 50))
        assert set(r["gone"]) == want, r["doc_id"]


def test_suffix_dedup_keeps_columns(odd, none, rows):
    left = suffix_dedup.deduplicated(odd)
    assert left.columns == odd.columns and as_nullable(left.schema) == as_nullable(odd.schema)
    got = left.collect()
    assert all(r["a b"] == 6 and r["deep"]["x y"] == 1 for r in got)
    assert {r["doc_id"] for r in got if r["text"] is None} == {i for i, t, *_ in rows if t is None}
    assert suffix_dedup.deduplicated(none).count() == 0


# -- 3 --------------------------------------------------------------------------------


def shingles(t):
    w = re.findall(SPACE, lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets, up = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i, (k, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((k for k in v if k is not None), default=None) for g, v in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))], len(groups)


@pytest.mark.parametrize("tile", [1200, 3])
def test_jaccard(docs, rows, none, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    want, groups = components(rows)
    # a row without words is alone, whatever its doc_id
    got = jaccard.joined(as_text(docs), size(docs)).select("doc_id", "n_shingles", "component_id", "stays").collect()
    assert counted((r[0], r[1], r[2]) for r in got) == counted(want)
    assert sum(r["stays"] for r in got) == groups
    assert jaccard.joined(as_text(none), 0).count() == 0


def test_components_of_edges_that_change_when_reckoned_again(spark):
    """A star about another node each time is one component."""
    from orvane.llm.components import connected

    def star(batches):
        import random

        import pyarrow as pa

        for batch in batches:
            n = batch["id"].to_pylist()
            centre = random.SystemRandom().choice(n)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array([centre] * len(n))], names=["a", "b"])

    found = connected(spark.range(0, 40, 1, 2).mapInArrow(star, "a long, b long")).collect()
    assert sorted((r["node"], r["label"]) for r in found) == [(k, 0 if k < 20 else 20) for k in range(40)]


def test_jaccard_when_numbers_clash(docs, rows, monkeypatch):
    """Sets and groups are numbered by 5 bits first; a second number tells them apart."""
    whole = jaccard._set_id
    monkeypatch.setattr(jaccard, "_set_id", lambda s, salt=None: whole(s) % 32 if salt is None else whole(s, salt))
    got = jaccard.joined(as_text(docs), size(docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert counted((r[0], r[1], r[2]) for r in got) == counted(components(rows)[0])


def test_jaccard_keeps_one_of_each(odd, rows, none):
    left = jaccard.deduplicated(odd)
    assert left.columns == odd.columns
    got, (want, groups) = left.collect(), components(rows)
    wordless = [r[:2] for r in rows if not shingles(r[1])]
    assert len(got) == groups - (len(wordless) - len(set(wordless)))
    assert {r["doc_id"] for r in got} == {k for k, _, c in want if k == c} | {None}
    assert jaccard.deduplicated(none).count() == 0


# -- 4 --------------------------------------------------------------------------------


def test_warc(spark):
    rows = [(1, "http://www.A.org/x", "same"), (2, "http://b.org/y", "same"), (2, "http://b.org/y", "same"), (None, "http://b.org/z", "same"), (5, None, None), (6, "http://b.org/y\n", ""), (7, "no scheme", "ünï" * 9000), (1, "http://www.A.org/x", "same")]
    rows += [(100 + i, f"https://h{i % 3}.c.net/p?q={i}", f"page {i % 50}") for i in range(1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    folder = new_folder(spark, "t")
    directory = warc.write_archives(pages, folder, per_part=700)
    got = warc.read_archives(directory, folder).collect()
    least = {}
    for p, _, h in rows:
        least[h or ""] = min(x for x in (p, least.get(h or "")) if x is not None) if (p, least.get(h or "")) != (None, None) else None
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        again = p != least[h or ""]
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    index = warc.CaptureIndex(directory, folder)
    assert sorted(x["page_id"] for x in index.find("http://b.org/y")) == [2, 2]
    assert index.find("https://h1.c.net/p?q=7")[0]["payload"] == b"page 7"
    assert index.find("http://nowhere.org/") == []
    keys = [e["first_key"].encode() for e in index.entries]
    assert keys == sorted(keys) and len(keys) > 2
    assert [warc.url_key_of(u) for _, u, _ in rows[:7]] == [r[0] for r in spark.createDataFrame(rows[:7], "p long, url string, h string").select(warc.url_key(F.col("url"))).collect()]
    nothing = new_folder(spark, "t")
    assert warc.read_archives(warc.write_archives(pages.limit(0), nothing), nothing).count() == 0


# -- 5 --------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = "</s>[INST] \\ \\\\ <|turn|><|says|><|over|> <\\|over|> \\<|over|> <<|over|>> é\n"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "system", None), (2, 1, "user", "u"), (2, 2, "assistant", ""), (3, 0, None, "x"), (3, 1, "assistant", "y" + odd), (3, 2, "assistant", odd), (3, 1, "<|says|>\n", "tie"), (None, None, "user", "n"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.records(table)
    turns = chat.canonical(records, "conv_id")
    assert turns.where("_unmapped").isEmpty()
    got = {r["conv_id"]: r for r in chat.parsed(chat.formatted(turns, "conv_id"), "conv_id").collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        assert r["loss_text"] == "".join(t for role, t in want[c] if role == "assistant")
        assert r["formatted"].count("<|over|>") == len(want[c])
    assert chat.formatted(chat.canonical(chat.records(table.limit(0)), "conv_id"), "conv_id").count() == 0


def test_chat_fingerprints(spark):
    wide = spark.read.schema("k long, prompt string, completion string, instruction string, output string, conversations array<struct<from: string, value: string>>").json(
        spark.sparkContext.parallelize(['{"k":1,"prompt":"p","completion":"c"}', '{"k":2,"instruction":"i","output":"o"}', '{"k":3,"conversations":[{"from":"user","value":"v"}]}', '{"k":4,"prompt":"alone"}'])
    )
    got = {r["k"]: r for r in chat.canonical(wide, "k").collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "p"), ("assistant", "c")]
    assert [tuple(t) for t in got[2]["turns"]] == [("user", "i"), ("assistant", "o")]
    assert [tuple(t) for t in got[3]["turns"]] == [("user", "v")]
    assert got[4]["_unmapped"] and got[4]["turns"] == []


# -- 6 and 8 ----------------------------------------------------------------------------


def ids_of(text, end):
    return np.array(encoder(default_tokenizer()).library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("memo", [250_000, 5])
def test_tokens_are_the_library_s(rows, monkeypatch, memo):
    monkeypatch.setattr("orvane.llm.tokens.MEMO", memo)
    e = encoder(default_tokenizer())
    odd = [" ", "\n", "a\n\nb", " a b", "a  b", "a b ", "a\tb", "a \n b", "a b c", "don't 's 12 3.5!? ok.", "\n a", "a\n", "<|endoftext|> hi", "日本 語\r\nfoo", "a \u0085b", "ab. cd, ²x ½ ٣", "é. é. ", "x" * 300 + " y"]
    for text in odd + [t or "" for _, t, *_ in rows]:
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.library.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("shard", [2048, 5])
def test_packing(docs, rows, none, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    got = packing.packed(docs, default_tokenizer()).collect()
    want = Counter()
    for i, t, *_ in rows:
        want[i, zlib.crc32(ids_of(t, 0).tobytes()), len(ids_of(t, 0))] += 1
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(n * k for (_, _, n), k in want.items())
    single = {i: t for i, t, *_ in rows if sum(1 for r in rows if r[0] == i) == 1}
    for (i, n), pieces in by_doc.items():
        if i in single:
            ids, at = ids_of(single[i], 0), 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == n == len(ids)
    assert packing.packed(none, default_tokenizer()).count() == 0


def test_packing_scores_and_takes_the_nearest(monkeypatch):
    """Scores are BM25 by its formula, with and without a dense part; windows take the best unused in order."""
    monkeypatch.setattr(packing, "SEEDS", 7)
    r = np.random.default_rng(3)
    tails = [r.zipf(1.4, int(r.integers(1, 500))).clip(0, 299).astype("<u2") for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=300)
    n_ids = sum(map(len, tails))
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), n_ids / 60
    want = np.zeros((60, 60))
    for i, x in enumerate(tails):
        for j, y in enumerate(tails):
            tf = np.bincount(y, minlength=300)[np.unique(x)]
            want[i, j] = (idf[np.unique(x)] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(y) / mean))).sum()
    for head in (4, 1024):
        monkeypatch.setattr(packing, "HEAD", head)
        shard = packing.Shard(tails, packing.Weights(df, 60, n_ids))
        got = shard.scores(0, 60)
        off = ~np.eye(60, dtype=bool)
        assert np.allclose(got[off], want[off], rtol=1e-4)
        used, left = set(), None
        windows = list(shard.packed())
        for window in windows:
            seed = window[0][0]
            assert left is None or (window[0][0], window[0][1]) == left
            used.add(seed)
            for k, at, n in window[1:]:
                best = max(got[seed, j] for j in range(60) if j not in used)
                assert at == 0 and got[seed, k] == best
                used.add(k)
            last = window[-1]
            left = (last[0], last[1] + last[2]) if last[1] + last[2] < len(tails[last[0]]) else None
            assert sum(n for *_, n in window) == 1024 or window is windows[-1]
        assert used == set(range(60))


def test_packing_places_copies_together(spark):
    """Copies in other languages, sources and far keys share a window; a hot text fills windows of its own."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefgh"), 4))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(k, texts[k % 40], f"l{k % 7}", f"s{k // 40}") for k in range(80)] + [(1000 + k, texts[0], "en", "hot") for k in range(100)], "doc_id long, text string, lang string, source string")
    of_doc = {}
    for p in packing.packed(docs.repartition(3), default_tokenizer()).collect():
        of_doc.setdefault(p["doc_id"], set()).add(p["sequence_id"])
    assert sum(bool(of_doc[k] & of_doc[k + 40]) for k in range(1, 40)) >= 30
    hot = Counter(s for k in range(100) for s in of_doc[1000 + k])
    assert sum(n for s, n in hot.items() if n > 1) >= 90


def test_token_files(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_IDS", 500)
    folder = new_folder(spark, "t")
    manifest = token_files.write_token_files(docs, folder, default_tokenizer(), 2, text_bytes(docs), part_bytes=8000)
    got = token_files.read_token_files(manifest, folder).collect()
    assert counted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == counted((i, len(ids_of(t, 2)), zlib.crc32(ids_of(t, 2).tobytes())) for i, t, *_ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    import pyarrow.parquet as pq

    part = manifest.collect()[0]
    fs, _ = token_files.file_system(folder)
    meta = pq.ParquetFile(part["path"], filesystem=fs).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(4)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["start"].encodings
    assert columns["doc_id"].has_offset_index and meta.num_row_groups == part["groups"]
    nothing = new_folder(spark, "t")
    assert token_files.read_token_files(token_files.write_token_files(none, nothing, default_tokenizer(), 2, (0, 0)), nothing).count() == 0


# -- 7 --------------------------------------------------------------------------------


def test_quality_measures(docs, rows, none, odd):
    got = quality.judged(docs.select("doc_id", F.col("text").alias("_text"), F.col("text").alias("copy"))).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["copy"] or ""
        w = re.findall(SPACE, t)
        grams, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (r["_q_n_words"], r["_q_word_chars"], r["_q_n_symbols"], r["_q_n_dup_lines"], r["_q_n_repeat_words"], r["_q_base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r["_q_kept"])
    left = quality.filtered(odd)
    assert left.columns == odd.columns and left.count() == sum(r["_q_kept"] for r in got)
    assert quality.filtered(none).count() == 0


def simulated(n, share, good, bad, silent=0.2, seed=1):
    """Counts of vote patterns of ``n`` documents, and the documents' classes and patterns."""
    r = np.random.default_rng(seed)
    is_good = r.random(n) < share
    right = r.random((n, len(good))) < np.where(is_good[:, None], good, bad)
    vote = np.where(right == is_good[:, None], 1, 2) * (r.random((n, len(good))) >= silent)
    patterns = (vote * 3 ** np.arange(len(good))).sum(axis=1)
    return dict(Counter(patterns.tolist())), is_good, patterns


def test_weak_supervision_finds_accuracies():
    good, bad = [0.99, 0.97, 0.95, 0.9, 0.99, 0.85], [0.8, 0.6, 0.7, 0.5, 0.9, 0.6]
    counts, is_good, patterns = simulated(30_000, 0.85, good, bad)
    post, got_good, got_bad, share = quality.fitted(counts, len(good))
    assert abs(share - 0.85) < 0.03 and np.abs(np.array(got_good) - good).max() < 0.03 and np.abs(np.array(got_bad) - bad).max() < 0.08
    verdict = np.array([post[p] >= 0.5 for p in patterns.tolist()])
    assert (verdict == is_good).mean() > 0.95


def test_weak_supervision_ignores_a_rule_that_fires_at_random():
    """It votes bad on half of all documents: its vote decides nothing, two agreeing rules outvote it."""
    good, bad = [0.99, 0.98, 0.99, 0.98, 0.5], [0.8, 0.8, 0.7, 0.7, 0.5]
    counts, *_ = simulated(20_000, 0.85, good, bad, silent=0.0)
    post, got_good, got_bad, _ = quality.fitted(counts, 5)
    assert abs(got_good[4] - 0.5) < 0.03 and abs(got_bad[4] - 0.5) < 0.08
    pattern = lambda *v: sum(x * 3**k for k, x in enumerate(v))
    assert post[pattern(1, 1, 1, 1, 2)] > 0.9, "all-must-pass would reject it"
    assert post[pattern(2, 2, 1, 1, 1)] < 0.5
    assert post[pattern(1, 2, 1, 1, 1)] > 0.5, "one bad vote of a good rule is outvoted"


# -- 9 --------------------------------------------------------------------------------


def test_feistel():
    for n in (1, 2, 3, 17, 1000):
        p = sharding.permute(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permute(p, n, 5, back=True).tolist() == list(range(n))
        assert sharding.locate(p % 8, p // 8, 8, n, 5).tolist() == list(range(n))
    assert sharding.permute(np.arange(1000), 1000, 5).tolist() != sharding.permute(np.arange(1000), 1000, 6).tolist()


def test_shards(docs, rows, none):
    table = docs.withColumn("row_number", F.lit("clash")).select("doc_id", "n_chars")
    got = sharding.shuffled_shards(table, 8, 3, "doc_id", "n_chars").collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sharding.shuffled_shards(none.select("doc_id"), 8, 3, "doc_id").count() == 0


# -- 10 -------------------------------------------------------------------------------

URLS = ["http://A.Example.org/es/x", "http://example.org/en/12?q", "http://example.org/en/2", "https://shop.com/fr/", "https://com/de/1#x", "http://x.org", "http://notexample.org/es/", "ftp://u@h.co.uk:80/a", "no", None, "", "http://bad.net/1", "http://bad.net/2", "http://bad.net/3", "http://good.net/1", "http://new.bad.net/"]


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://bad.net/9"), (3, URLS[3])], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(p, True) for p in (11, 12, 13)] * 9 + [(14, False)] * 30 + [(3, False), (7, None)], "page_id long, bad boolean")
    got = url_filter.judge(pages, labels, url_filter.RULES).collect()
    assert len(got) == len(URLS) + 2
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert [by[k]["rule"] for k in range(7)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, "org/"]
    assert [by[k]["verdict"] for k in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert (by[0]["host"], by[1]["path"], by[7]["host"]) == ("a.example.org", "/en/12", "u@h.co.uk:80")
    assert all((by[k]["host"], by[k]["path"]) == ("", "") for k in (8, 9, 10))
    assert by[11]["verdict"] == "block" and by[14]["verdict"] == "allow"
    assert by[14]["rate"] < by[15]["rate"] < by[11]["rate"]  # an unseen host takes after its domain
    assert url_filter.judge(pages.limit(0), labels, url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, labels.limit(0), []).collect()} == {"allow"}
    many = [url_filter.Rule("block", f"h{k}.org", "/") for k in range(100)] + list(url_filter.RULES)
    again = {r["page_id"]: r for r in url_filter.judge(pages, labels, many).collect()}
    assert all(again[k]["rule"] == by[k]["rule"] for k in by)


def test_packing_places_once(spark):
    """The range partition, which reads its input twice, finds the places written; frequencies count each id once a document."""
    texts = ["un été naïf, it's 12 ok", "the and the and the", "", None, "a b " * 40_000, "ſ ǅ ß 日本 🙂 a\tb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = packing.packed(docs, default_tokenizer())._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression") :]
    assert "MapInArrow" not in dealt and "place#" in dealt

    library = encoder(default_tokenizer()).library
    want = {}
    for text in texts:
        for i in {*library.encode(text or "", add_special_tokens=False).ids, 0}:
            want[i] = want.get(i, 0) + 1
    df, n, _ = packing.document_frequencies(packing.tokenized(docs, default_tokenizer(), 0), library.get_vocab_size())
    assert n == len(texts) and {int(i): int(df[i]) for i in df.nonzero()[0]} == want
