"""Quality rules with risk-controlled cutoffs.  DataFrame functions only.

Each rule compares one statistic of a text with a cutoff.  Cutoffs come from a fixed ladder, lenient to strict, which
does not depend on the data.  On the labelled documents of each stratum, a rung is certified when the exact binomial
test rejects "more than ``risk / rules`` of the good documents are lost": P(Bin(n, risk / rules) <= k) <= alpha, which
is the same as a Clopper-Pearson upper bound at or under that risk.  Rungs are tested from the lenient end and testing
stops at the first failure (fixed-sequence testing needs no further correction); alpha is ``delta`` divided by the
number of ladders, rules times strata (Bonferroni).  Strata are all values of a column among the labelled documents.  Those
with so few good ones that no rung could pass, were it the only stratum and none of them lost, are not counted among the
ladders: that depends on n alone, and nothing is certified there.  With probability 1 - delta no stratum loses more than
``risk`` of its good documents by cutoffs.  Among certified rungs the one with the largest gain (bad documents rejected less
``cost`` times good ones) is taken, the more lenient on ties; where nothing is certified or gained, the rule rejects nothing.

Nulls: a null text has no words; a null stratum is the stratum ""; rows without a label, and null ids, only receive verdicts.
A doc_id labelled more than once counts once, with its lowest label; each row that repeats a doc_id counts and gets its own
verdict.  An empty table has no rows, without labels only the base rules hold.  ``measure`` and ``judge`` replace columns whose
names start with ``rule_``; ``query`` and ``stage`` keep any columns apart from their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import among, materialize, table

RISK, DELTA, COST = 0.02, 0.05, 5.0

#: Rule -> (statistic, ladder from lenient to strict).  The statistics are columns of ``statistics``.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / word_chars", (0.9, 0.7, 0.5, 0.35, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "capitals": ("n_capitals / word_chars", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "dup_lines": ("n_dup_lines / n_lines", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "repeats": ("n_repeat_words / n_words", (0.95, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "marks": ("n_marks / word_chars", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
}

_SPACES = " \t\n\x0b\x0c\r"
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``rule_<statistic>``, counted over the whole text."""
    c = "rule_"
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, _SPACES, "")
    lines = F.filter(F.split(t, "\n"), lambda line: F.translate(line, _SPACES, "") != "")
    df = docs.withColumns({
        c + "words": F.array_remove(F.split(t, "[ \\x09-\\x0D]+"), ""),
        c + "lines": lines,
        c + "word_chars": F.length(bare).cast("long"),
        c + "n_symbols": _count(t, "#*$%&|<>"),
        c + "n_capitals": _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        c + "n_marks": _count(t, "!?.,;:'\"-_=+/\\()[]{}~^`@"),
    })
    df = df.withColumns({
        c + "n_words": F.size(c + "words").cast("long"),
        c + "n_lines": F.size(c + "lines").cast("long"),
        c + "n_dup_lines": (F.size(c + "lines") - F.size(F.array_distinct(c + "lines"))).cast("long"),
        c + "windows": F.expr(
            f"if(size({c}words) >= 5, transform(sequence(0, size({c}words) - 5), i -> xxhash64({c}words[i],"
            f" {c}words[i + 1], {c}words[i + 2], {c}words[i + 3], {c}words[i + 4])), cast(array() as array<bigint>))"
        ),
    }).drop(c + "words", c + "lines")
    # Windows that occur again: sort (hash, place), keep what has an equal neighbour, and measure the union of the
    # windows at the places left.  Most texts repeat no window and skip the sort.
    df = df.withColumn(c + "sorted", F.expr(
        f"if(size(array_distinct({c}windows)) < size({c}windows),"
        f" array_sort(transform({c}windows, (h, i) -> struct(h as h, i as i))), null)"
    )).drop(c + "windows")
    df = df.withColumn(c + "again", F.expr(
        f"array_sort(transform(filter({c}sorted, (x, i) -> (i > 0 and {c}sorted[greatest(i - 1, 0)].h = x.h)"
        f" or (i + 1 < size({c}sorted) and {c}sorted[least(i + 1, size({c}sorted) - 1)].h = x.h)), x -> x.i))"
    )).drop(c + "sorted")
    return df.withColumn(c + "n_repeat_words", F.expr(
        f"coalesce(aggregate(transform({c}again, (p, i) -> if(i + 1 < size({c}again),"
        f" least(5, {c}again[least(i + 1, size({c}again) - 1)] - p), 5)), 0L, (a, x) -> a + x), 0L)"
    )).drop(c + "again")


def _statistic(rule: str) -> Column:
    import re

    return F.expr(re.sub(r"(\w+) / (\w+)", r"coalesce(rule_\1 / nullif(rule_\2, 0), 0)", RULES[rule][0]))


def _stratum(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def log_binomial_cdf(k: str, n: str, p: float) -> Column:
    """Natural logarithm of P(Bin(n, p) <= k) for k <= n * p: the terms are summed in logarithms, so that it does not
    underflow; above n * p, where the tail is over a third, 0 is returned as an upper bound."""
    import math

    odds, first = math.log(p / (1 - p)), math.log1p(-p)
    return F.expr(f"""if({k} > {n} * {p!r}D, 0D, if({k} = 0, {n} * {first!r}D,
        aggregate(sequence(1L, greatest({k}, 1L)), struct({n} * {first!r}D as term, {n} * {first!r}D as total),
            (a, i) -> struct(a.term + ln(({n} - i + 1D) / i) + {odds!r}D as term,
                greatest(a.total, a.term + ln(({n} - i + 1D) / i) + {odds!r}D)
                + ln(1D + exp(-abs(a.total - (a.term + ln(({n} - i + 1D) / i) + {odds!r}D)))) as total),
            a -> a.total)))""")


def certify(counts: DataFrame, risk: float = RISK, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, rule, cutoff) from counts (stratum, rule, level, cutoff, n, k, bad): n good documents of the stratum,
    k of them and ``bad`` bad ones over the cutoff."""
    import math

    each = risk / len(RULES)
    testable = F.col("n") * math.log1p(-each) <= math.log(delta / len(RULES))
    ladders = len(RULES) * max(1, counts.where(testable).select("stratum").distinct().count())
    passed = log_binomial_cdf("k", "n", each) <= math.log(delta / ladders)
    gain = F.col("bad") - cost * F.col("k")
    return (
        counts.groupBy("stratum", "rule")
        .agg(F.array_sort(F.collect_list(F.struct("level", passed.alias("passed"), gain.alias("gain"), "cutoff"))).alias("rungs"))
        .withColumn("failed", F.expr("array_min(transform(filter(rungs, x -> not x.passed), x -> x.level))"))
        .withColumn("rungs", F.expr("filter(rungs, x -> x.gain > 0 and (failed is null or x.level < failed))"))
        .select("stratum", "rule", F.expr("array_max(transform(rungs, x -> struct(x.gain, -x.level, x.cutoff))).cutoff").alias("cutoff"))
    )


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``docs`` with the rule statistics and ``rule_stratum``."""
    return statistics(docs.withColumn("rule_stratum", _stratum(F.col(stratum))))


def fit(measured: DataFrame, labels: DataFrame, **control: float) -> DataFrame:
    """One row for each stratum with labels, with a column ``cut_<rule>`` for each rule; null where nothing was certified.
    Only the statistics meet the labels: texts are not shuffled."""
    own = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("rule_good"))
    known = measured.select("doc_id", "rule_stratum", *(f"rule_{s}" for s in _STATS)).join(own, "doc_id")
    known = known.withColumns({f"stat_{r}": _statistic(r) for r in RULES})
    sums = [F.count_if(F.col("rule_good") == 1).alias("n")]
    for r, (_, ladder) in RULES.items():
        for i, cut in enumerate(ladder):
            over = F.col(f"stat_{r}") > cut
            sums += [F.count_if(over & (F.col("rule_good") == 1)).alias(f"k_{r}_{i}"), F.count_if(over & (F.col("rule_good") == 0)).alias(f"b_{r}_{i}")]
    rungs = F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("level"), F.lit(cut).alias("cutoff"), F.col(f"k_{r}_{i}").alias("k"), F.col(f"b_{r}_{i}").alias("bad"))
        for r, (_, ladder) in RULES.items() for i, cut in enumerate(ladder)
    ))
    counts = known.groupBy(F.col("rule_stratum").alias("stratum")).agg(*sums)
    cuts = certify(materialize(counts, "rungs").select("stratum", "n", F.inline(rungs)), **control)
    return cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``rule_base_failed`` and ``rule_kept``."""
    # Any number of strata may have labels; a row is broadcast only for those with a certified cutoff, each of which takes
    # ln(delta / rules) / ln(1 - risk / rules) good documents: one row of some 60 bytes for 1149 of them by default.
    cuts = cutoffs.where(F.coalesce(*(f"cut_{r}" for r in RULES)).isNotNull()).withColumnRenamed("stratum", "rule_stratum")
    df = measured.join(F.broadcast(cuts), "rule_stratum", "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(_statistic(r) > F.col(f"cut_{r}"), F.lit(False))
    base = (F.col("rule_n_words") < 10) | (100 * F.col("rule_n_repeat_words") > 20 * F.col("rule_n_words"))
    return df.withColumns({"rule_base_failed": base, "rule_kept": ~base & ~over}).drop("rule_stratum", *(f"cut_{r}" for r in RULES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = materialize(measure(docs).drop("text", "lang"), "rules")
    out = judge(measured, fit(measured, table(spark, sf_dir, "labels")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *(F.col(f"rule_{n}").alias(n) for n in names))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns they had.  Statistics are computed for the labelled texts, to find the
    cutoffs, and again for all, which costs less than shuffling the texts or writing them once more."""
    known = table(spark, sf_dir, "labels")
    cutoffs = fit(measure(among(docs.select("doc_id", "text", "lang"), "doc_id", known.where("quality is not null"), "doc_id")), known)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text", "lang")
    # A filter would be pushed below the statistics and take their expressions along, one inside the other; it does not
    # pass a projection with a running number that it needs.
    held = measure(rows).withColumn("rule_row", F.monotonically_increasing_id())
    return judge(held, cutoffs).where(F.col("rule_kept") & (F.col("rule_row") >= 0)).select("row.*")
