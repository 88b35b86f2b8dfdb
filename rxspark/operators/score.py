"""Candidates scored against the strings of their problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching, register
from .validate import ratio

WEIGHT, INVALID = 0.01, -10.0


def compile_outputs(outputs: DataFrame, output: str = "output", strict: bool = False) -> DataFrame:
    """``outputs`` with solution, parse_error, pattern, flags and validation_error; each distinct text is compiled once."""
    parse = register.rx_parse_output_strict if strict else register.rx_parse_output
    done = outputs.select(F.col(output).alias("rx_text")).distinct().withColumn("p", parse("rx_text")).withColumn("c", register.rx_compile(F.col("p.solution")))
    done = done.select("rx_text", F.col("p.solution").alias("solution"), F.col("p.error").alias("parse_error"), F.col("c.pattern").alias("pattern"), F.col("c.flags").alias("flags"), F.when(F.col("p.error").isNull(), F.col("c.error")).alias("validation_error"))
    return outputs.join(done, F.col(output).eqNullSafe(F.col("rx_text")), "left").drop("rx_text")


def confusion(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by candidate of rows (keys, label, matched); a null ``matched`` counts for neither side."""
    yes, no = F.col("label") == "yes", F.col("label") == "no"
    return matched.groupBy(*keys).agg(F.count_if(yes & F.col("matched")).alias("yes_matches"), F.count_if(yes).alias("yes_total"), F.count_if(no & ~F.col("matched")).alias("no_rejects"), F.count_if(no).alias("no_total"))


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds accuracy (0 without strings), yes_recall, no_precision (1 without strings) and is_perfect."""
    c = F.col
    total = c("yes_total") + c("no_total")
    return df.withColumns({
        "accuracy": ratio(c("yes_matches") + c("no_rejects"), total, 0.0),
        "yes_recall": ratio(c("yes_matches"), c("yes_total")),
        "no_precision": ratio(c("no_rejects"), c("no_total")),
        "is_perfect": (c("yes_matches") == c("yes_total")) & (c("no_rejects") == c("no_total")),
    })


def reward(valid: Column, perfect: Column, accuracy: Column, length: Column, mode: str = "binary", weight: float = WEIGHT, invalid: float = INVALID) -> Column:
    """Correctness less a price on length where it is positive; ``mode`` other than binary is fractional."""
    right = F.when(perfect, 1.0).otherwise(-1.0) if mode == "binary" else 2.0 * accuracy - 1.0
    return F.when(~valid, F.lit(invalid)).when(right > 0, right - F.lit(weight) * length).otherwise(right)


def evaluate(candidates: DataFrame, strings: DataFrame, problem: str = "problem_id", candidate: str = "candidate_idx", mode: str = "binary", weight: float = WEIGHT, invalid: float = INVALID, seconds: float | None = None) -> DataFrame:
    """``candidates`` (problem, candidate, pattern, flags, ...) with counts, metrics and reward over ``strings`` (problem, label,
    s).  A candidate without a pattern is invalid: its counts are 0 and its reward is ``invalid``."""
    keys = [problem, candidate]
    good = candidates.where("pattern is not null").select(*keys, "pattern", F.coalesce("flags", F.lit(0)).alias("flags"))
    pairs = good.join(strings.select(problem, "label", "s"), problem)
    plain = matching.full_match(pairs.where("flags = 0"), "pattern", "s", seconds).select(*keys, "label", "matched")
    other = pairs.where("flags <> 0").select(*keys, "label", matching.python_match(F.col("pattern"), F.col("s"), F.col("flags"), seconds)["matched"].alias("matched"))
    counts = confusion(plain.unionByName(other), keys)
    totals = strings.groupBy(problem).agg(F.count_if(F.col("label") == "yes").alias("all_yes"), F.count_if(F.col("label") == "no").alias("all_no"))
    df = candidates.join(counts.select(*keys, "yes_matches", "no_rejects"), keys, "left").join(totals, problem, "left")
    df = df.withColumns({"is_valid": F.col("pattern").isNotNull(), "yes_matches": F.coalesce("yes_matches", F.lit(0)), "no_rejects": F.coalesce("no_rejects", F.lit(0)), "yes_total": F.coalesce("all_yes", F.lit(0)), "no_total": F.coalesce("all_no", F.lit(0)), "pattern_length": F.coalesce(F.length("pattern"), F.lit(0))}).drop("all_yes", "all_no")
    df = with_metrics(df)
    df = df.withColumns({c: F.when(F.col("is_valid"), F.col(c)).otherwise(0.0) for c in ("accuracy", "yes_recall", "no_precision")})
    return df.withColumn("reward", reward(F.col("is_valid"), F.col("is_perfect"), F.col("accuracy"), F.col("pattern_length"), mode, weight, invalid))


def evaluate_outputs(outputs: DataFrame, problems: DataFrame, strict: bool = False, **options) -> DataFrame:
    """Texts of models (problem_id, candidate_idx, output) scored against problems (problem_id, yes, no), joined on the
    problem's key."""
    both = F.array(F.struct(F.lit("yes").alias("label"), F.col("yes").alias("list")), F.struct(F.lit("no").alias("label"), F.col("no").alias("list")))
    strings = problems.select("problem_id", F.inline(both)).select("problem_id", "label", F.explode("list").alias("s"))
    return evaluate(compile_outputs(outputs, strict=strict), strings, **options)


def normalised(scored: DataFrame, batch: list[str], value: str = "reward", name: str = "advantage") -> DataFrame:
    """Adds the z-score within a batch (population deviation); batches of one or without spread stay as they are."""
    w = Window.partitionBy(*batch)
    spread, x = F.stddev_pop(value).over(w), F.col(value)
    return scored.withColumn(name, F.when((F.count(value).over(w) > 1) & (spread > 0), (x - F.avg(value).over(w)) / spread).otherwise(x))


def problem_stats(scored: DataFrame, problem: str = "problem_id", candidate: str = "candidate_idx") -> DataFrame:
    """By problem: counts, rewards in order, the best reward, and the best solution: the shortest perfect one, else the
    valid one with the most reward, the first on ties, else null."""
    row = F.struct(candidate, "pattern", "pattern_length", "reward", F.when(~F.col("is_perfect"), F.col("accuracy")).alias("accuracy"))
    good = F.col("is_valid") & F.col("is_perfect")
    best = F.coalesce(
        F.min_by(F.when(good, row), F.when(good, F.struct("pattern_length", candidate))),
        F.min_by(F.when(F.col("is_valid"), row), F.when(F.col("is_valid"), F.struct(-F.col("reward"), F.col(candidate)))),
    )
    rewards = F.transform(F.array_sort(F.collect_list(F.struct(candidate, "reward"))), lambda x: x["reward"])
    return scored.groupBy(problem).agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"), F.count_if(good).alias("n_perfect"), rewards.alias("rewards"), F.max("reward").alias("best_reward"), best.alias("best_solution"))


def outcome_rates(scored: DataFrame) -> DataFrame:
    """Shares of valid outputs, parse errors and validation errors; null over no rows."""
    share = lambda c: F.avg(c.cast("double"))
    return scored.agg(share(F.col("is_valid")).alias("valid_rate"), share(F.col("parse_error").isNotNull()).alias("parse_error_rate"), share(F.col("validation_error").isNotNull()).alias("validation_error_rate"))


def reward_stats(scored: DataFrame, value: str = "advantage") -> DataFrame:
    return scored.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.min(value).alias("min"))
