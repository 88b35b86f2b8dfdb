"""Cleaning of puzzle entries: strings that contradict an entry's pattern are removed, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def explode_strings(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expr, label, pos, s): a row for each string of each list."""
    both = F.array(F.struct(F.lit("yes").alias("label"), F.col("yes").alias("list")), F.struct(F.lit("no").alias("label"), F.col("no").alias("list")))
    lists = entries.select(*keys, "expr", F.inline(both))
    return lists.select(*keys, "expr", "label", F.posexplode("list").alias("pos", "s"))


def validate(entries: DataFrame, seconds: float | None = None) -> DataFrame:
    """``entries`` with ``yes`` that match and ``no`` that don't, in their order and with repeats, ``validation_error``, and
    the counts original_/kept_/removed_ of both lists.  A bad pattern empties both lists; strings that are null go.  An entry
    that takes longer than ``seconds`` fails, likewise."""
    rest = [c for c in entries.columns if c not in ("yes", "no")]
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    done = matching.match_lists(entries, seconds=seconds)
    out = done.select(*rest, F.col("rx_yes").alias("yes"), F.col("rx_no").alias("no"), F.col("rx_error").alias("validation_error"), *(size(x).alias(f"original_{x}") for x in ("yes", "no")), *(size(f"rx_{x}").alias(f"kept_{x}") for x in ("yes", "no")))
    return with_ratios(out.withColumns({f"removed_{x}": F.col(f"original_{x}") - F.col(f"kept_{x}") for x in ("yes", "no")}))


def with_ratios(df: DataFrame) -> DataFrame:
    """Adds yes_, no_ and total_accuracy; 1 for empty lists."""
    c = F.col
    return df.withColumns({
        "yes_accuracy": ratio(c("kept_yes"), c("original_yes")),
        "no_accuracy": ratio(c("kept_no"), c("original_no")),
        "total_accuracy": ratio(c("kept_yes") + c("kept_no"), c("original_yes") + c("original_no")),
    })


def _sums() -> list[Column]:
    return [F.count("*").alias("entries"), *(F.sum(f"{a}_{x}").alias(f"{a}_{x}") for a in ("original", "kept", "removed") for x in ("yes", "no"))]


def by_file(valid: DataFrame, key: str = "path") -> DataFrame:
    """Sums of each file, and ratios of the sums."""
    return with_ratios(valid.groupBy(key).agg(*_sums()))


def overall(valid: DataFrame, key: str = "path") -> DataFrame:
    """As ``by_file`` with a row for all files, whose key is null."""
    return with_ratios(valid.rollup(key).agg(*_sums()).where(~(F.grouping_id() == 0) | F.col(key).isNotNull()))


def problem_entries(valid: DataFrame) -> DataFrame:
    """Entries with removals: place, start of the pattern, counts."""
    keys = [c for c in ("path", "file", "entry_idx") if c in valid.columns]
    return valid.where(F.col("removed_yes") + F.col("removed_no") > 0).select(*keys, F.substring("expr", 1, 50).alias("expr_start"), "removed_yes", "removed_no")


def timed_out(valid: DataFrame) -> DataFrame:
    return valid.where(F.col("validation_error").startswith("Timeout"))


def worst_files(stats: DataFrame, n: int = 10, key: str = "path") -> DataFrame:
    """The files with the least mean of both accuracies."""
    return stats.withColumn("mean_accuracy", (F.col("yes_accuracy") + F.col("no_accuracy")) / 2).orderBy("mean_accuracy", key).limit(n)


def accepted(entries: DataFrame, sample: int = 5, native: bool = False) -> DataFrame:
    """Entries whose pattern is found in each of the first ``sample`` yes strings and missing from one of the first no
    strings at least; bad patterns and empty no lists are rejected.  ``native``: the pattern column is known to mean
    the same in the JVM."""
    if native:
        keep = F.expr(f"forall(slice(yes, 1, {sample}), x -> x rlike expr) and exists(slice(no, 1, {sample}), x -> not x rlike expr)")
        return entries.where(keep)
    numbered = entries.withColumn("rx_entry", F.xxhash64("expr", F.to_json(F.struct("yes", "no"))))  # equal entries fare alike
    lists = numbered.select("rx_entry", "expr", F.slice("yes", 1, sample).alias("yes"), F.slice("no", 1, sample).alias("no"))
    hits = explode_strings(lists, ["rx_entry"]).withColumn("hit", matching.python_match(F.col("expr"), F.col("s"), whole=False)["matched"])
    yes, no = (F.col("label") == x for x in ("yes", "no"))
    good = hits.groupBy("rx_entry").agg(F.coalesce(F.every(F.when(yes, F.coalesce("hit", F.lit(False)))), F.lit(True)).alias("y"), F.coalesce(F.some(F.when(no, F.coalesce(~F.col("hit"), F.lit(False)))), F.lit(False)).alias("n"))
    return numbered.join(good.where("y and n"), "rx_entry", "left_semi").drop("rx_entry")
