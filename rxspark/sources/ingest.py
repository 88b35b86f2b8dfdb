"""Puzzle datasets, seeds and prompts as DataFrames."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import exists

DEFAULT_DESCRIPTION = "No description provided"
MISSING_PROMPT = "fnfe"
BLANKS = " \t\r\n\x0b\x0c"


def scan(spark: SparkSession, path: str, include_temp: bool = False, pattern: str = "*.json") -> DataFrame:
    """(path, file, value): every JSON file below ``path`` with its whole text; checkpoint folders are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")
    return files if include_temp else files.where(~F.col("path").contains("temp_results"))


@F.pandas_udf(StringType())
def _plain_json(texts: pd.Series) -> pd.Series:
    """JSON as Python reads it (the last of repeated keys; NaN, here any number), written again plainly; null if it can't be
    read."""

    def one(text: str) -> str | None:
        try:
            return json.dumps(json.loads(text, parse_constant=lambda _: 0))
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore")


def _strings(field: str) -> Column:
    """The elements of a list field: strings, and null for anything else, so that original counts hold."""
    return F.expr(f"transform(try_variant_get(v, '$.{field}', 'array<variant>'), x -> if(schema_of_variant(x) = 'STRING', cast(x as string), null))")


def entries(files: DataFrame) -> DataFrame:
    """(path, file, entry_idx, expr, yes, no, has_lists) for each object of each file: an array's elements, or the object
    itself; other elements are skipped.  Missing fields are '' and empty.  ``has_lists``: all three fields are there and the
    two are lists."""
    direct = files.withColumn("parsed", F.try_parse_json("value"))
    slow = direct.where("parsed is null").withColumn("parsed", F.try_parse_json(_plain_json("value")))
    read = direct.where("parsed is not null").unionByName(slow.where("parsed is not null"))
    root = F.expr("if(schema_of_variant(parsed) like 'ARRAY%', cast(parsed as array<variant>), array(parsed))")
    each = read.select("path", "file", F.posexplode(root).alias("entry_idx", "v")).where("schema_of_variant(v) like 'OBJECT%'")
    given = F.expr("try_variant_get(v, '$.expr', 'string') is not null and try_variant_get(v, '$.yes', 'array<variant>') is not null and try_variant_get(v, '$.no', 'array<variant>') is not null")
    return each.select("path", "file", "entry_idx", F.coalesce(F.expr("try_variant_get(v, '$.expr', 'string')"), F.lit("")).alias("expr"), F.coalesce(_strings("yes"), F.array()).alias("yes"), F.coalesce(_strings("no"), F.array()).alias("no"), given.alias("has_lists"))


def unreadable(files: DataFrame) -> DataFrame:
    """(path, file) of files that are no JSON."""
    return files.where(F.try_parse_json("value").isNull()).where(_plain_json("value").isNull()).select("path", "file")


def count_entries(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, entries) for every file, 0 for unreadable ones."""
    return files.select("path").join(found.groupBy("path").agg(F.count("*").alias("entries")), "path", "left").select("path", F.coalesce("entries", F.lit(0)).alias("entries"))


def split_examples(text: Column) -> Column:
    """Lines, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")


def hub_seeds(table: DataFrame) -> DataFrame:
    """(regex, description, examples) of rows with a regex (columns regex, text, description)."""
    return table.where(F.coalesce("regex", F.lit("")) != "").select("regex", F.coalesce("description", F.lit(DEFAULT_DESCRIPTION)).alias("description"), F.coalesce(split_examples(F.col("text")), F.array()).alias("examples"))


def puzzle_line(line: Column) -> tuple[Column, Column]:
    """(pattern, flags) of '/pattern/flags', up to the last slash; any other line is a pattern itself."""
    shape = "^/(.*)/([^/]*)$"
    slashed = line.rlike(shape)
    return F.when(slashed, F.regexp_extract(line, shape, 1)).otherwise(line), F.when(slashed, F.regexp_extract(line, shape, 2)).otherwise("")


def puzzle_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(line, regex, flags, description, examples) of a file of puzzle lines; blank lines and comments are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "raw"))
    lines = lines.select((F.col("at") + 1).alias("line"), F.trim("raw", F.lit(BLANKS)).alias("text")).where("text <> '' and not startswith(text, '#')")
    regex, flags = puzzle_line(F.col("text"))
    about = F.concat(F.lit("Regex puzzle from line "), "line", F.when(F.col("flags") != "", F.concat(F.lit(" with flags: "), "flags")).otherwise(""))
    return lines.select("line", regex.alias("regex"), flags.alias("flags")).withColumns({"description": about, "examples": F.array().cast("array<string>")})


def first(df: DataFrame, n: int, by: str) -> DataFrame:
    return df.orderBy(by).limit(n)


def prompt_template(path: str, spark: SparkSession | None = None) -> str:
    """A template file's text, read by Spark if a session is given; the literal ``MISSING_PROMPT`` if there is none."""
    if spark is not None:
        if not exists(spark, path):
            return MISSING_PROMPT
        return spark.read.text(path, wholetext=True).first()["value"]
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return MISSING_PROMPT
