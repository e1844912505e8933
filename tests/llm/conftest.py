import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows and odd signs."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(300)] + ["naïve", "日本", "don't", "x-y", "12"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(words(r.randint(1, 120))) for _ in range(30)]
    base, passage = words(90), " ".join(words(60))
    for _ in range(12):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [f"{' '.join(words(20))} {passage} {' '.join(words(20))}" for _ in range(6)]
    texts += [None, "", "   ", "\n\n", "a", "A b\tc\r\nd  e", "x\x00y \\ </s>", " ".join(words(3000)), "one two three four five " * 12, "\n".join(["same line here"] * 9)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += rows[3:6] + [(100 + k, texts[k], "en", "s0", len(texts[k])) for k in (1, 2, 33)] + [(None, texts[2], None, None, 5), (None, "only here and nowhere else", None, None, 3)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """Further columns with names that the operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("_row", "_text", "_id", "_mix", "_block", "words", "a b", "kept", "n", "ids", "_spans", "_rest", "place")
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(names)}).withColumn("deep", F.struct(F.lit(1).alias("x y"), F.array(F.lit("z")).alias("doc_id")))
