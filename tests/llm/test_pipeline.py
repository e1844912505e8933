"""Every stage of the pipeline on awkward rows and against brute force, and the whole of it on the driver's smallest tables."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_contamination, components, items_of, lower
from test_queries import brute_quality

import corpus_pipeline
from orvane.llm.common import written
from orvane.llm.tokens import default_tokenizer, encoder

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, odd, none, name, stage):
    out = stage(spark, odd, DATA)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
        assert 0 < out.count() <= odd.count()
    assert stage(spark, none, DATA).count() == 0


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = docs.where("doc_id >= 0").count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
    assert 0.6 * clean < docs.count() < clean
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard", "suffix_array", "decontamination", "packed_windows"]


def without_repeats(rows, length=50):
    """Stage 3: characters with a byte in a string of a smaller document go, and documents of which nothing is left."""
    first, out = {}, []
    for key, text in rows:
        b = text.encode()
        for a in range(len(b) - length + 1):
            first[b[a : a + length]] = min(first.get(b[a : a + length], key), key)
    for key, text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < key:
                gone[a : a + length] = True
        at, kept = 0, []
        for c in text:
            n = len(c.encode())
            if not gone[at : at + n].any():
                kept.append(c)
            at += n
        if kept or not gone.any():
            out.append((key, "".join(kept)))
    return out


def without_items(rows, items, window=13):
    """Stage 4: contaminated documents go, of the others the hit runs of words."""
    find = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))
    known = defaultdict(set)
    for _, t in items:
        w = [m[0] for m in find(t)]
        for a in range(max(1, len(w) - window + 1) if w else 0):
            known[min(window, len(w))].add(tuple(w[a : a + window]))
    out = []
    for key, text in rows:
        n, h, _ = brute_contamination(text, items)
        if h and 20 * h >= n:
            continue
        w, hit = find(text), set()
        for m, grams in known.items():
            for a in range(len(w) - m + 1):
                if tuple(x[0] for x in w[a : a + m]) in grams:
                    hit.update(range(a, a + m))
        kept, at = [], 0
        for a in sorted(hit):
            if a - 1 not in hit:
                kept.append(text[at : w[a].start()])
            at = w[a].end()
        out.append((key, "".join(kept) + text[at:]))
    return out


def test_stages_against_brute_force(spark, rows, tmp_path):
    """The rows of each stage, and of run() that every id lies in one piece of a gapless sequence."""
    r = random.Random(3)
    rows = [x for k, x in enumerate(rows) if x[0] is not None and x[0] not in {y[0] for y in rows[:k]}]
    # cut on both sides within characters that share a first byte, and a document that is a benchmark item
    run = "é" * 40
    rows += [(200, " ".join(r.choices(rows[0][1].split() if rows[0][1] else ["word"], k=3)) + " the first one " + run + " ends here and goes on for a while more", "en", "s0", 90), (201, "another beginning of a text with words è" + run + "ê ends otherwise than the first of the two", "en", "s0", 90)]
    exam = "what is the tallest of all mountains that a traveller may see from the harbour at noon on a day without clouds"
    rows += [(202, f"{exam} and a short answer", "en", "s0", 130)]
    items = [*items_of(rows), (20, exam)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    judged = [(row[0], row[1]) for row, found, p in brute_quality(rows) if p >= 0.5 and not found[-1]]
    single = [x for x, (key, _, least) in zip(judged, components(judged)[0], strict=True) if key == least]
    unique = without_repeats(single)
    clean = without_items(unique, items)
    assert len(judged) < len(rows) and len(single) < len(judged) and dict(unique) != dict(single) and len(clean) < len(unique)
    assert any(dict(unique)[key] != text for key, text in clean), "a hit run is cut"

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (judged, single, unique, clean), strict=True):
        docs = written(stage(spark, docs, str(tmp_path)), f"brute-{name}")
        got = docs.select("doc_id", "text").collect()
        assert len(got) == len(want) and dict(map(tuple, got)) == dict(want), name

    pieces, sequences, library = defaultdict(list), defaultdict(list), encoder(default_tokenizer()).library
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(pieces) == {key for key, _ in clean}
    for key, text in clean:
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(pieces[key], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        ends = np.cumsum([p["length"] for p in sorted(own, key=lambda p: p["offset"])]).tolist()
        assert sorted(p["offset"] for p in own) == [0, *ends[:-1]] and ends[-1] <= 1024
    assert sum(sum(p["length"] for p in own) < 1024 for own in sequences.values()) <= 1
