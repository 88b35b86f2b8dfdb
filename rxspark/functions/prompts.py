"""Prompts for generating examples and for solving puzzles, built by concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = "You write test strings for regular expressions. Answer with one JSON object with the keys expr, yes and no."
EXAMPLES = 10


def generation(template: str, pattern: Column, examples: Column, mark: str = "{pattern}") -> Column:
    """The template with the pattern in it, and up to EXAMPLES numbered examples after it."""
    numbered = F.transform(F.slice(examples, 1, EXAMPLES), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". `"), x, F.lit("`")))
    tail = F.when(F.size(examples) > 0, F.concat(F.lit("\n\nExamples:\n"), F.array_join(numbered, "\n"))).otherwise("")
    return F.concat(F.replace(F.lit(template), F.lit(mark), pattern), tail)


def solver(system: str, developer: str, yes: Column, no: Column) -> Column:
    """The messages of a puzzle, its lists as JSON."""
    return F.concat(F.lit(f"{system}\n\n{developer}\n\n"), F.lit('{"yes": '), F.to_json(yes), F.lit(', "no": '), F.to_json(no), F.lit("}"))


def json_slice(text: Column) -> Column:
    """From the first opening to the last closing brace, null if there is no such part."""
    start = F.locate("{", text)
    end = F.length(text) - F.locate("}", F.reverse(text)) + 1
    return F.when((start > 0) & F.contains(text, F.lit("}")) & (end >= start), F.substring(text, start, end - start + 1))
