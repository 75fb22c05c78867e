"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Every text is measured once.  Besides the fixed base rules, four rates have cutoffs learned from labelled rows: for a
rate, a stratum (language) and a cutoff from a grid, ``n`` good labelled texts of which ``k`` lie above the cutoff, the
cutoff is admissible if a binomial variable with n trials and the rate's share of the allowed risk has at most k
successes with probability at most ``delta`` over the number of tests made (Bonferroni over strata, rates and cutoffs;
this is the exact Clopper-Pearson upper bound).  The least admissible cutoff is used, so that with probability
1 - delta no stratum loses more than ``risk`` of its good texts to learned cutoffs; without one the rate rejects nothing.
Equal texts count once, as copies are not independent draws.

Defined cases: null text has no words and fails the base rules; null strata form a stratum of their own; labels of
unknown ids are ignored, several labels of a text count as good if one is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

_SPACE = r"[\x20\x09-\x0D]+"
RATES = {
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "capital_rate": "n_capitals / greatest(word_chars, 1)",
    "line_rate": "n_dup_lines / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class RuleSettings:
    risk: float = 0.04
    delta: float = 0.05
    cutoffs: tuple[float, ...] = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)
    folds: int = 5  # rows whose id is divisible by it are kept from selection, for a check
    few_strata: int = 10_000


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice: union of the windows' places."""
    n = F.size(words)

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc.total + F.least(F.lit(3), x - acc.last)).alias("total"), x.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc.total)

    def from_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(ordered: Column) -> Column:
            same = lambda s, k: F.coalesce(F.get(ordered, k).h == s.h, F.lit(False))
            repeated = F.filter(ordered, lambda s, k: same(s, k - 1) | same(s, k + 1))
            return F.sort_array(F.transform(repeated, lambda s: s.i))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(_let(pairs, twice)))

    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    windows = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(_let(windows, from_hashes))


def measure_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            F.regexp_count(joined, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(joined, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    results = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_repeat_words", "n_lines", "n_dup_lines")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    return docs.select(*kept, _let(words, of_words).alias("_w"), _let(lines, of_lines).alias("_l")).select(*kept, "_w.*", "_l.*")


def binomial_tail_log(n: Column, k: Column, p: float) -> Column:
    """Log of P(Bin(n, p) <= k), summed in logs term by term."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc.term + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(acc.total, term), F.least(acc.total, term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    counted = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, step, lambda acc: acc.total)
    return F.when(k >= n, F.lit(0.0)).when(k < 1, n * math.log1p(-p)).otherwise(counted)


def learn_cutoffs(measured: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """(stratum, one cutoff per rate or null) from ``measured`` rows with doc_id, stratum, text_key and the rates."""
    marks = labels.filter(F.col("quality").isNotNull() & (F.col("doc_id") % settings.folds != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = (
        measured.join(marks, "doc_id").groupBy("stratum", "text_key")
        .agg(F.max("quality").alias("quality"), *(F.first(r).alias(r) for r in RATES)).filter("quality > 0")
    )
    counts = good.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *(F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r in RATES for i, c in enumerate(settings.cutoffs)),
    )
    # One row per stratum.
    tests = F.count("*").over(Window.partitionBy(F.lit(1))) * (len(RATES) * len(settings.cutoffs))
    level = F.log(F.lit(settings.delta)) - F.log(tests)
    share = settings.risk / len(RATES)
    chosen = counts.withColumn("level", level)
    for r in RATES:
        admitted = [F.when(binomial_tail_log(F.col("n"), F.col(f"{r}_{i}"), share) <= F.col("level"), F.lit(c)) for i, c in enumerate(settings.cutoffs)]
        chosen = chosen.withColumn(f"{r}_cutoff", F.coalesce(*admitted))
    return chosen.select("stratum", *(f"{r}_cutoff" for r in RATES))


def apply_rules(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings(), stratum: str = "lang") -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs`` (doc_id, text and the stratum column)."""
    named = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.xxhash64("text").alias("text_key"))
    measured = measure_texts(named).drop("text").withColumns({r: F.expr(e) for r, e in RATES.items()})
    measured = staged(measured)  # narrow: read for the counts and for the verdict
    cutoffs = staged(learn_cutoffs(measured, labels, settings))
    if cutoffs.count() <= settings.few_strata:
        cutoffs = F.broadcast(cutoffs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = [F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False)) for r in RATES]
    rejected = over[0] | over[1] | over[2] | over[3]
    return (
        measured.join(cutoffs, "stratum", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )
