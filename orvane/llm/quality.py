"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document.  Expectation-maximisation
over the counts of vote patterns (at most 3 to the power of the number of
rules, whatever the corpus) estimates each rule's accuracy on good and on bad
documents and the share of good ones; a document stays if its posterior
probability of being good is at least one half and no base rule fails.

The estimates begin with the majority of each document's votes, which also says
which class is the good one, and have weak Beta priors, no bounds: a rule that
fires at random ends with even odds and decides nothing.  A kind of junk that one
rule alone sees cannot be told from that rule's mistakes; so each kind should be
seen by two rules at least, and one weak bad vote may be outvoted.

Nulls and odd input: a null or empty text has no words and fails the base
rule; repeated rows are judged each; an empty table gives an empty result;
further columns, of any name, are carried through by :func:`filtered`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: A word with a sign of markup or tables, or without a letter or digit.
MARKED = r"[#*$%&|<>=^_{}\[\]\\~]|^[^\p{L}\p{N}]+$"
#: What the Beta priors are worth, in votes, and the accuracies that they favour on good and on bad documents.
PRIOR, PRIOR_GOOD, PRIOR_BAD = 20.0, 0.9, 0.5


def measured(df: DataFrame, text: str = "_text") -> DataFrame:
    """Add the base measures of the column ``text`` under names that begin with ``_q_``."""
    clean = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(clean, SPACE), lambda w: w != "")
    out = df.withColumn("_q_words", words)
    n = F.size("_q_words")
    get = lambda i, k: F.get(F.col("_q_words"), i + k)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(get(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(clean, r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "_q_n_words": n.cast("long"), "_q_marked": F.size(F.filter("_q_words", lambda w: w.rlike(MARKED))), "_q_word_chars": F.length(F.array_join("_q_words", "")).cast("long"), "_q_windows": windows, "_q_lines": lines,
        "_q_n_symbols": F.regexp_count(clean, F.lit("[#*$%&|<>]")).cast("long"), "_q_upper": F.regexp_count(clean, F.lit("[A-Z]")), "_q_shout": F.regexp_count(clean, F.lit("!")), "_q_digits": F.regexp_count(clean, F.lit("[0-9]")),
    })
    twice = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    out = out.withColumns({
        "_q_n_lines": F.size("_q_lines"), "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_pairs": F.when(twice, F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    pair = lambda i: F.get(F.col("_q_pairs"), i)["h"]
    starts = F.filter("_q_pairs", lambda x, i: (x["h"] == F.coalesce(pair(i - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(pair(i + 1), F.bitwise_not(x["h"]))))
    out = out.withColumn("_q_starts", F.sort_array(F.transform(starts, lambda x: x["i"])))
    covered = F.transform("_q_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_q_starts"), j + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("_q_n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    out = out.withColumn("_q_base_failed", (F.col("_q_n_words") < 10) | (100 * F.col("_q_n_repeat_words") > 20 * F.col("_q_n_words")))
    return out.drop("_q_words", "_q_windows", "_q_lines", "_q_pairs", "_q_starts")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 2).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes of each rule on the measures: 1 good, 2 bad, 0 abstains."""
    c = F.col
    n, chars = F.greatest(c("_q_n_words"), F.lit(1)), F.greatest(c("_q_word_chars"), F.lit(1))
    return {
        "length": _vote(n < 12, n >= 60),
        "word_length": _vote((chars / n < 3) | (chars / n > 10), (chars / n >= 3.5) & (chars / n <= 9)),
        "symbols": _vote(c("_q_n_symbols") / n > 0.1, c("_q_n_symbols") / n <= 0.02),
        "marked_words": _vote(c("_q_marked") / n > 0.2, c("_q_marked") / n <= 0.05),
        "dup_lines": _vote((c("_q_n_lines") >= 3) & (c("_q_n_dup_lines") / c("_q_n_lines") > 0.3), (c("_q_n_lines") >= 3) & (c("_q_n_dup_lines") == 0)),
        "repeats": _vote(c("_q_n_repeat_words") / n > 0.1, (n >= 20) & (c("_q_n_repeat_words") == 0)),
        "upper": _vote(c("_q_upper") / chars > 0.3, c("_q_upper") / chars < 0.1),
        "shout": _vote(c("_q_shout") / n > 0.2, c("_q_shout") / n < 0.02),
        "digits": _vote(c("_q_digits") / chars > 0.3, c("_q_digits") / chars < 0.1),
    }


def pattern() -> Column:
    """All votes as one number, a base-3 digit for each rule."""
    total = F.lit(0)
    for k, v in enumerate(rules().values()):
        total = total + v * 3**k
    return total


def _digits(p: int, n: int) -> list[int]:
    return [p // 3**k % 3 for k in range(n)]


def fitted(counts: dict[int, int], n_rules: int, rounds: int = 200) -> tuple[dict[int, float], list[float], list[float], float]:
    """Expectation-maximisation over the counts of vote patterns.

    Gives the posterior probability of good for each pattern, each rule's
    accuracy (share of right votes among its votes) on good and on bad
    documents, and the share of good documents.
    """
    votes = {p: [(k, d == 2) for k, d in enumerate(_digits(p, n_rules)) if d] for p in counts}
    post = {}
    for p, v in votes.items():  # the majority, where a bad vote, which is the rarer one, counts twice; without one nearly sure
        bad = sum(against for _, against in v)
        post[p] = (1 + len(v) - bad) / (2 + len(v) + bad) if bad else 0.95
    total, good, bad, share = sum(counts.values()), [PRIOR_GOOD] * n_rules, [PRIOR_BAD] * n_rules, 0.8
    for _ in range(rounds):
        right, cast = [[PRIOR * PRIOR_BAD] * n_rules, [PRIOR * PRIOR_GOOD] * n_rules], [[PRIOR] * n_rules, [PRIOR] * n_rules]
        mass = 0.0
        for p, v in votes.items():
            of_good = counts[p] * post[p]
            of_bad = counts[p] - of_good
            mass += of_good
            for k, against in v:
                cast[1][k] += of_good
                cast[0][k] += of_bad
                if against:
                    right[0][k] += of_bad
                else:
                    right[1][k] += of_good
        good, bad = ([r / c for r, c in zip(right[x], cast[x], strict=True)] for x in (1, 0))
        share, change = (mass + 8) / (total + 10), 0.0
        base = math.log(share / (1 - share))
        against_ = [math.log((1 - g) / b) for g, b in zip(good, bad, strict=True)]
        for_ = [math.log(g / (1 - b)) for g, b in zip(good, bad, strict=True)]
        for p, v in votes.items():
            x = base + sum(against_[k] if against else for_[k] for k, against in v)
            new = 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
            change, post[p] = max(change, abs(new - post[p])), new
        if change < 1e-7:
            break
    return post, good, bad, share


def posteriors(votes: DataFrame) -> DataFrame:
    """(pattern, posterior) for the column ``_q_pattern``; at most 3 to the number of rules rows."""
    n = len(rules())
    counts = {r["_q_pattern"]: r["n"] for r in votes.groupBy("_q_pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    post = fitted(counts, n)[0]
    return votes.sparkSession.createDataFrame(sorted(post.items()), "_q_pattern int, _q_posterior double")


def judged(df: DataFrame) -> DataFrame:
    """Measure and judge rows with a column ``_text``: adds measures, ``_q_posterior`` and ``_q_kept``, drops the text."""
    held = written(measured(df).withColumn("_q_pattern", pattern()).drop("_text"), "quality")
    known = F.broadcast(posteriors(held))
    return held.join(known, "_q_pattern", "left").withColumn("_q_kept", ~F.col("_q_base_failed") & (F.coalesce("_q_posterior", F.lit(0.0)) >= 0.5))


def filtered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    rows = docs.select(F.struct("*").alias("_row"), docs[text].alias("_text"))
    return judged(rows).where("_q_kept").select("_row.*")


def op7_weak_supervision(spark, sf_dir) -> DataFrame:
    """Judge all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs).select("doc_id", *(F.col(f"_q_{x}").alias(x) for x in names), F.col("_q_posterior").alias("posterior"))
