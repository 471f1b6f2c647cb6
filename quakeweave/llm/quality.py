"""Quality rules as weak supervision.

Each rule looks at one measure of the whole text and votes for clean (+1), against
(-1) or abstains (0).  The votes of all documents are counted by pattern (at most
3 to the number of rules), and expectation-maximisation over those counts estimates
each rule's accuracy and the share of clean documents; a document's posterior
probability of being clean replaces all-must-pass filtering.  Rows see DataFrame
functions only; the estimation works on the counts, on the driver.

A null or empty text has no words, and fails the base rule of 50 words.  Equal rows
get equal results.  An empty table gives no rows (and keeps the starting accuracies).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.llm._common import let, table, words, written

ROUNDS, PRIOR, KEEP = 25, 0.8, 0.5
#: Words among which distinct ones are counted at a time, so that a text's variety does not depend on its length.
STRETCH = 1000
#: Where the estimation starts: a vote's probability among clean and among other documents.
START = {1: (0.9, 0.4), 0: (0.09, 0.1), -1: (0.01, 0.5)}
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_lines", "n_distinct")


def _covered(window: Column) -> Column:
    """Words in 3-word windows whose hash stands twice or more in window, the hashes by position."""

    def spread(s: Column) -> Column:
        at = F.sort_array(F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    again = let(F.sort_array(window), lambda s: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda k: F.get(s, k) == F.get(s, k - 1)))
    placed = F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(again, let(placed, spread)).otherwise(F.lit(0))


def _of_words(w: Column) -> Column:
    h = F.transform(w, lambda x: F.xxhash64(x))
    starts = F.sequence(F.lit(0), F.floor(F.size(w) / STRETCH).cast("int"))
    stretches = let(h, lambda a: F.transform(starts, lambda k: F.size(F.array_distinct(F.slice(a, k * STRETCH + 1, F.lit(STRETCH)))).cast("long")))
    window = let(h, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2))))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(window, _covered).cast("long").alias("n_repeat_words"),
        F.aggregate(stretches, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_distinct"),
    )


def measures(text: Column) -> Column:
    """Struct of MEASURES of a whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        let(words(text), _of_words),
        lambda w: F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), w["n_repeat_words"].alias("n_repeat_words"), w["n_distinct"].alias("n_distinct"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).cast("long").alias("n_letters"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            of_lines.alias("lines"),
        ),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes over the columns of MEASURES."""
    c = F.col
    chars, n = F.greatest(c("word_chars"), F.lit(1)), F.greatest(c("n_words"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    return {
        "length": _vote(c("n_words") >= 100, c("n_words") < 20),
        "word_length": _vote(((chars / n) >= 3) & ((chars / n) <= 9), ((chars / n) < 2) | ((chars / n) > 14)),
        "symbols": _vote(c("n_symbols") * 100 <= n, c("n_symbols") * 10 > n),
        "dup_lines": _vote(c("n_dup_lines") == 0, c("n_dup_lines") * 10 > lines * 3),
        "repeats": _vote(c("n_repeat_words") * 20 <= n, c("n_repeat_words") * 5 > n),
        "letters": _vote(c("n_letters") * 100 >= chars * 90, c("n_letters") * 100 < chars * 75),
        "capitals": _vote(c("n_capitals") * 100 <= c("n_letters") * 10, c("n_capitals") * 100 > c("n_letters") * 30),
        "variety": _vote(c("n_distinct") * 100 >= n * 35, c("n_distinct") * 100 < n * 15),
    }


def _posterior(names: list[str], model: dict[str, dict[int, tuple[float, float]]], prior: float) -> Column:
    """Probability of being clean, given how often either kind of document draws each vote."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name in names:
        weight = {v: math.log(clean / junk) for v, (clean, junk) in model[name].items()}
        odds = odds + F.when(F.col(name) > 0, weight[1]).when(F.col(name) < 0, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, dict[int, tuple[float, float]]], float]:
    """For each rule and vote, its probability among clean and among other documents, and the share of clean ones.

    votes has a row per pattern with its count n.  A rule that votes alike for both kinds so
    gets no weight, whatever it votes; its accuracies are model[rule][1][0] and model[rule][-1][1].
    The patterns, 3 to the number of rules at most, are read once: rounds as queries would each
    leave the driver a plan and classes of its own.
    """
    model, prior = {name: dict(START) for name in names}, PRIOR
    rows = sorted(votes.select(*names, "n").collect())
    n, total = np.array([r["n"] for r in rows], float), sum(r["n"] for r in rows)
    here = {name: {v: np.array([r[name] == v for r in rows], bool) for v in (1, 0, -1)} for name in names}
    for _ in range(rounds if total else 0):
        odds = np.full(len(rows), math.log(prior / (1 - prior)))
        for name in names:
            for v, (of_clean, of_junk) in model[name].items():
                odds[here[name][v]] += math.log(of_clean / of_junk)
        of_pattern = n / (1 + np.exp(-odds))
        clean = float(of_pattern.sum())
        junk = total - clean
        for name in names:
            sums = {v: (float(of_pattern[at].sum()), float(n[at].sum())) for v, at in here[name].items()}
            model[name] = {v: ((c + 1) / (clean + 3), (every - c + 1) / (junk + 3)) for v, (c, every) in sums.items()}
        prior = min(0.99, max(0.01, clean / total))
    return model, prior


def scored(docs: DataFrame, rounds: int = ROUNDS, whole: bool = False) -> DataFrame:
    """Per row: doc_id, uid, MEASURES, base_failed, a vote_ column per rule, p_clean, kept; with whole also _row, the row's own columns."""
    text = F.col("text").cast("string")
    carried = [F.struct(*docs.columns).alias("_row")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), measures(text).alias("m"), *carried)
    rows = rows.select("doc_id", "uid", *[(F.col("m.lines") if k in ("n_lines", "n_dup_lines") else F.col("m"))[k].alias(k) for k in MEASURES], *[c for c in rows.columns if c == "_row"])
    votes = rules()
    names = [f"vote_{k}" for k in votes]
    rows = written(rows.withColumns({f"vote_{k}": v for k, v in votes.items()}), "measures")
    counts = written(rows.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "votes")
    p = _posterior(names, *estimate(counts, names, rounds))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumns({"base_failed": failed, "p_clean": p}).withColumn("kept", ~F.col("base_failed") & (F.col("p_clean") >= KEEP))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep, all their columns."""
    return scored(docs, whole=True).filter("kept").select("_row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_clean", *[c for c in out.columns if c.startswith("vote_")])


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
