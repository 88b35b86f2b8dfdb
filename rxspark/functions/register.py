"""SQL functions: rx_fullmatch, rx_compile, rx_parse_output and the table function rx_ast_nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from . import outputs, regex_ast
from .matching import compiled


_COMPILED = StructType().add("pattern", StringType()).add("flags", IntegerType()).add("error", StringType())
_PARSED = StructType().add("solution", StringType()).add("error", StringType())
_NODES = StructType().add("node_id", IntegerType()).add("parent_id", IntegerType()).add("position", IntegerType()).add("depth", IntegerType()).add("kind", StringType()).add("pattern", StringType()).add("min_width", IntegerType()).add("max_width", IntegerType())


@F.pandas_udf(BooleanType())
def rx_fullmatch(patterns: pd.Series, texts: pd.Series) -> pd.Series:
    found = [compiled(p)[0] if p is not None else None for p in patterns]
    return pd.Series([None if f is None or t is None else bool(f.fullmatch(t)) for f, t in zip(found, texts, strict=True)], dtype="boolean")


@F.pandas_udf(_COMPILED)
def rx_compile(solutions: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([regex_ast.compile_json(s) for s in solutions], columns=["pattern", "flags", "error"])
    return out.astype({"flags": "Int32"})


@F.pandas_udf(_PARSED)
def rx_parse_output(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outputs.parse(t) for t in texts], columns=["solution", "error"])


@F.pandas_udf(_PARSED)
def rx_parse_output_strict(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outputs.parse(t, strict=True) for t in texts], columns=["solution", "error"])


@F.udtf(returnType=_NODES)
class RxAstNodes:
    def eval(self, solution: str):
        yield from regex_ast.flatten(solution)


def flag_bits(letters: Column) -> Column:
    """Flag letters as bits; null if a letter is unknown."""
    bits = F.aggregate(F.array_distinct(F.split(letters, "")), F.lit(0), lambda a, x: a.bitwiseOR(F.when(x == "i", 2).when(x == "m", 8).when(x == "s", 16).when(x == "a", 256).otherwise(0)))
    return F.when(letters.rlike("^[imsa]*$"), bits)


def escape_literal(text: Column) -> Column:
    out = F.regexp_replace(text, r"([.^$*+?{}\[\]()|\\])", r"\\$1")
    for raw, name in (("\t", "t"), ("\n", "n"), ("\r", "r")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + name))
    return out


def quantifier(low: Column, high: Column) -> Column:
    """The suffix of a repeat; a null upper bound is none."""
    some = F.when((low == 0) & (high == 1), "?").when((low == 1) & high.isNull(), "+").when((low == 0) & high.isNull(), "*")
    return some.when(high.isNull(), F.concat(F.lit("{"), low, F.lit(",}"))).when(low == high, F.concat(F.lit("{"), low, F.lit("}"))).otherwise(F.concat(F.lit("{"), low, F.lit(","), high, F.lit("}")))


def register(spark: SparkSession) -> None:
    for name, f in (("rx_fullmatch", rx_fullmatch), ("rx_compile", rx_compile), ("rx_parse_output", rx_parse_output), ("rx_parse_output_strict", rx_parse_output_strict)):
        spark.udf.register(name, f)
    spark.udtf.register("rx_ast_nodes", RxAstNodes)
