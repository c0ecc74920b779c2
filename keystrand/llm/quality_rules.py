"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good (+1), bad (-1) or abstains (0).  The votes of all rows are
counted by vote pattern (at most 3^rules patterns, however many rows), and
expectation-maximisation on that count table estimates the class balance and each
rule's accuracy on good and on bad texts.  The posterior probability of "good"
replaces the usual demand that every rule passes.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept; texts are taken whole; repeated rows vote alike; columns of the input that bear the name
of a measure or result are replaced, others come back as they were; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm.common import materialize, table, text_of

SPACE = r"[\x20\x09-\x0D]+"
#: Iterations of expectation-maximisation at most; it ends sooner when no parameter moves by more than TOLERANCE.
ITERATIONS = 40
TOLERANCE = 1e-4
#: Bounds of a rule's accuracy on good and on bad texts.  A rule is right on most good texts,
#: so the two classes can't change places; on bad texts it may be blind, as each rule sees one kind of fault.
GOOD_BOUNDS, BAD_BOUNDS = (0.55, 0.995), (0.02, 0.995)
START = (0.9, 0.5)
MEASURES = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_distinct_words n_upper n_punctuation n_plain_words n_ended_lines".split()


def with_repeat_words(rows: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words that lie in three-word windows found at least twice in the text.

    Each step is a column of its own, so that no array is computed twice.
    """
    n = F.size(words)
    triples = F.slice(
        F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, n + 1).alias("b"), F.slice(words, 3, n + 1).alias("c")),
        1,
        F.greatest(n - 2, F.lit(0)),
    )
    # the hash makes most comparisons short; the words decide
    rows = rows.withColumn("_g", F.sort_array(F.transform(triples, lambda t, i: F.struct(F.xxhash64(t["a"], t["b"], t["c"]).alias("h"), t["a"].alias("a"), t["b"].alias("b"), t["c"].alias("c"), i.alias("p")))))
    # equal windows are neighbours now
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    pairs = F.filter(F.arrays_zip(F.col("_g").alias("x"), F.slice("_g", 2, n + 1).alias("y")), lambda t: same(t["x"], t["y"]))
    rows = rows.withColumn("_g", pairs)
    starts = F.concat(F.col("_g.x.p"), F.col("_g.y.p"))
    # the number of words covered so far, and the window start before
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
    return rows.withColumn(out, F.aggregate(F.sort_array(starts), zero, step, lambda acc: acc["n"])).drop("_g")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus the counts that the rules read."""
    rows = docs.withColumn("_t", text_of(text_col))
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = with_repeat_words(rows, "_w", "n_repeat_words")
    return rows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"),
            "n_upper": F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long"),
            "n_punctuation": F.regexp_count("_t", F.lit(r"[^\p{L}\s]")).cast("long"),
            "n_plain_words": F.size(F.filter("_w", lambda x: x.rlike(r"^\p{L}+[.,;:?!]?$"))).cast("long"),
            "n_ended_lines": F.size(F.filter("_l", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long"),
        }
    ).drop("_t", "_w", "_l")


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """The rules, by name, as votes over the columns of ``measures``."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    return {
        "symbols": vote(c("n_symbols") * 10 > words, c("n_symbols") * 50 <= words),
        "dup_lines": vote(c("n_dup_lines") * 10 > c("n_lines") * 3, (c("n_lines") > 1) & (c("n_dup_lines") * 10 <= c("n_lines"))),
        "repeats": vote(c("n_repeat_words") * 10 > words * 3, c("n_repeat_words") * 10 < words),
        "distinct": vote(c("n_distinct_words") * 7 < words, c("n_distinct_words") * 10 > words * 3),
        "upper": vote(c("n_upper") * 10 > chars * 3, c("n_upper") * 10 < chars),
        "plain_words": vote(c("n_plain_words") * 10 < words * 6, c("n_plain_words") * 10 >= words * 8),
        "punctuation": vote(c("n_punctuation") * 100 > chars * 12, c("n_punctuation") * 100 <= chars * 8),
        "line_ends": vote(c("n_ended_lines") * 10 < c("n_lines") * 3, c("n_ended_lines") * 10 >= c("n_lines") * 6),
    }


def posterior(votes: Column, names: list[str], model: dict[str, object]) -> Column:
    """P(good | votes) under the model's class balance and accuracies."""
    total = F.lit(math.log(model["balance"] / (1 - model["balance"])))
    for j, name in enumerate(names):
        on_good, on_bad = model["accuracy"][name]
        total = total + F.when(votes[j] == 1, math.log(on_good / (1 - on_bad))).when(votes[j] == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def estimate(patterns: list[tuple[list[int], int]], names: list[str]) -> dict[str, object]:
    """Class balance and accuracies from vote patterns and their numbers of rows, at most 3^rules of them, by expectation-maximisation."""
    model: dict[str, object] = {"balance": 0.8, "accuracy": {k: START for k in names}}
    if not patterns:
        return model
    votes, n = np.array([v for v, _ in patterns]).reshape(-1, len(names)), np.array([c for _, c in patterns], np.float64)
    right, wrong = (votes == 1).astype(np.float64), (votes == -1).astype(np.float64)
    on_good, on_bad = (np.full(len(names), x) for x in START)
    balance = 0.8
    for _ in range(ITERATIONS):
        # E: rows of each pattern that are good
        z = np.log(balance / (1 - balance)) + right @ np.log(on_good / (1 - on_bad)) + wrong @ np.log((1 - on_good) / on_bad)
        good = n / (1 + np.exp(-z))
        bad = n - good
        # M: Beta(8, 2) before any vote
        clip = lambda yes, no, low, high: np.clip((yes + 8) / (yes + no + 10), low, high)
        new_good, new_bad = clip(good @ right, good @ wrong, *GOOD_BOUNDS), clip(bad @ wrong, bad @ right, *BAD_BOUNDS)
        new_balance = min(0.98, max(0.02, good.sum() / n.sum()))
        moved = max(abs(new_balance - balance), np.abs(new_good - on_good).max(), np.abs(new_bad - on_bad).max())
        balance, on_good, on_bad = new_balance, new_good, new_bad
        if moved < TOLERANCE:
            break
    return {"balance": float(balance), "accuracy": {k: (float(g), float(b)) for k, g, b in zip(names, on_good, on_bad, strict=True)}}


def weakly_supervised_quality(docs: DataFrame, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """``docs`` without its text, plus measures, votes, quality_probability, base_failed and kept.

    The measures are written to the shared folder once; the vote patterns and the
    result are both read from there.
    """
    votes = rules()
    names = list(votes)
    # the name of a measure belongs to the measure
    docs = docs.drop(*[c for c in docs.columns if c != text_col and c.lower() in {*MEASURES, "votes", "quality_probability", "base_failed", "kept", "_t", "_w", "_l", "_g"}])
    rows = measures(docs, text_col).drop(text_col)
    rows = materialize(rows.withColumn("votes", F.array(*votes.values())), "quality-rules")
    # at most 3^rules rows, however many texts
    patterns = sorted((r["votes"], r["n"]) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect())
    model = estimate(patterns, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.withColumn("quality_probability", posterior(F.col("votes"), names, model))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality_probability") >= keep_at))
    )


def op10_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weakly_supervised_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")
