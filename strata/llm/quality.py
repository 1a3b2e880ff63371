"""Quality rules (operator 1): base rules on every text, then cutoffs on text statistics that are
chosen on labelled documents so that few good documents of each stratum are rejected.

For a stratum (by default a language) and a statistic, every cutoff of a fixed grid is a
hypothesis "more than ``risk`` of the good documents lie above it". A cutoff may be used only if
the exact binomial tail P(Bin(n, risk) <= k) is at most ``delta`` divided by the number of all
tests (strata x statistics x cutoffs, Bonferroni), where n good labelled documents of the stratum
passed the base rules and k of them lie above the cutoff. ``risk`` is the allowed false-rejection
rate of the whole stratum divided by the number of statistics, so that the union of all rules
keeps it with confidence 1 - delta. The lowest proven cutoff is used; a stratum without enough
labels gets none and keeps everything that passes the base rules.

DataFrame functions only. Cases: null text has no words and fails the base rules. A null stratum
is a stratum of its own. Repeated documents are judged row by row. Several labels of one document
count as bad if any is 0; null labels and labels of unknown documents take no part. Without
labels, or on empty tables, only the base rules decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE, every, let, names, small, words

SYMBOLS = "[#*$%&|<>]+"
#: The statistics (higher is worse) and their cutoff grids.
GRIDS = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95],
    "repeat_share": [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.48, 0.49],
    "word_length": [8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0, 30.0, 50.0, 100.0],
}


def _repeated(ws: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice. Windows are hashed; only where some
    hash repeats they are sorted with their positions and compared with their neighbours."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(hs: Column) -> Column:
        marks = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(marks, lambda m: F.filter(m, lambda e, i: (e["h"] == F.get(m, i - 1)["h"]) | (e["h"] == F.get(m, i + 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(hashes, lambda hs: F.when(
        F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0)))).cast("long")


def text_stats(text: Column) -> Column:
    """A struct of whole-text counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    n_lines (with a word)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    return let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        _repeated(ws).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines")))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def measures(s: Column) -> dict[str, Column]:
    """The rule statistics as ratios (0 where undefined)."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {"symbols_per_word": ratio(s["n_symbols"], s["n_words"]), "dup_line_share": ratio(s["n_dup_lines"], s["n_lines"]),
            "repeat_share": ratio(s["n_repeat_words"], s["n_words"]), "word_length": ratio(s["word_chars"], s["n_words"])}


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, shifted back."""
    z = x + 8.0
    shift = reduce(lambda a, b: a + b, [F.log(x + float(i)) for i in range(8)])
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). The terms fall quickly below the mean, so the sum runs downwards from k
    over at least 12 standard deviations; k at or above the mean gives 1 (no test passes there)."""
    kd, nd = k.cast("double"), n.cast("double")
    log_top = (_log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1)
               + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(40 + 12 * F.sqrt(nd * p * (1 - p)))).cast("int")
    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
                        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
                        lambda a, i: let(a["term"] * (kd - i) * (1 - p) / ((nd - kd + i + 1) * p),
                                         lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum"))),
                        lambda a: a["sum"])
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def fit_cutoffs(scored: DataFrame, labels: DataFrame, key: str, stratum: str, risk: float = 0.05, delta: float = 0.05,
                grids: dict[str, list[float]] = GRIDS) -> DataFrame:
    """Cutoffs per stratum: a row (stratum, one nullable column per statistic). ``scored`` has the
    key, the stratum, ``base_failed`` and the statistics; ``labels`` has (key, quality)."""
    good = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key) \
        .agg(F.min("quality").alias("quality")).filter(F.col("quality") == 1).select(key)
    counts = [F.count_if(F.col(m) > c).alias(f"k_{m}_{i}") for m, grid in grids.items() for i, c in enumerate(grid)]
    seen = scored.filter(~F.col("base_failed")).join(good, key).groupBy(stratum).agg(F.count("*").alias("n"), *counts)
    seen = materialize(seen)
    n_tests = max(1, seen.count()) * sum(len(g) for g in grids.values())
    each = risk / len(grids)
    long = seen.select(stratum, "n", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit(c).alias("cutoff"), F.col(f"k_{m}_{i}").alias("k"))
        for m, grid in grids.items() for i, c in enumerate(grid)])).alias("t")).select(stratum, "n", "t.*")
    proven = long.filter(binomial_tail(F.col("k"), F.col("n"), each) <= delta / n_tests)
    return proven.groupBy(stratum).agg(*[F.min(F.when(F.col("measure") == m, F.col("cutoff"))).alias(m) for m in grids])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          **fit) -> DataFrame:
    """(key, stratum, the counts, base_failed, kept, failed_rules) for every document row. The texts are
    read once: counts and statistics are narrow and staged before the cutoffs are fitted."""
    s = F.col("_s")
    stats = docs.select(F.col(key), F.col(stratum), text_stats(F.col(text)).alias("_s")) \
        .select(key, stratum, "_s.*", base_failed(s).alias("base_failed"), *[c.alias(m) for m, c in measures(s).items()])
    stats = materialize(stats)
    return apply_cutoffs(stats, small(fit_cutoffs(stats, labels, key, stratum, **fit)), stratum)


def apply_cutoffs(scored: DataFrame, cutoffs: DataFrame, stratum: str, grids: dict[str, list[float]] = GRIDS) -> DataFrame:
    cut = cutoffs.select(F.col(stratum).alias("_stratum"), *[F.col(m).alias(f"_cut_{m}") for m in grids])
    failed = F.filter(F.array(*[F.when(F.col(m) > F.col(f"_cut_{m}"), F.lit(m)) for m in grids]), lambda x: x.isNotNull())
    return scored.join(cut, scored[stratum].eqNullSafe(F.col("_stratum")), "left") \
        .withColumn("failed_rules", failed) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)) \
        .drop("_stratum", *[f"_cut_{m}" for m in grids])


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
              **fit) -> DataFrame:
    """The documents, in their own columns, that the rules keep. The cutoffs come from one pass; a
    second pass over the texts judges the rows in place, so that no text is shuffled."""
    k, st = names("_q_", docs.columns, "key", "stratum")
    narrow = docs.select(F.col(key).alias(k), F.col(stratum).alias(st), F.col(text).alias("_t"))
    s = F.col("_s")
    shaped = [base_failed(s).alias("base_failed"), *[c.alias(m) for m, c in measures(s).items()]]
    scored = materialize(narrow.select(k, st, text_stats(F.col("_t")).alias("_s")).select(k, st, *shaped))
    cutoffs = small(fit_cutoffs(scored, labels.select(F.col("doc_id").alias(k), "quality"), k, st, **fit))
    row = docs.select(F.struct(*every(docs)).alias("_row"), F.col(stratum).alias(st), text_stats(F.col(text)).alias("_s"))
    return apply_cutoffs(row.select("_row", st, *shaped), cutoffs, st).filter("kept").select("_row.*")
