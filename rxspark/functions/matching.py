"""Full matches of patterns against strings with Python's semantics, in the JVM where both engines agree.

A pattern is *native* if it compiles in Python and a scan finds only constructs that mean the same in both engines; it
then gets a Java form.  Rows of other patterns, and rows whose string could be read differently or nest too deeply for
the JVM's stack, go to Python in Arrow batches, with an optional time limit.  Java's engine can't be stopped, so under a limit
it gets only patterns with one quantifier at most that can match in more than one way: their time is bounded by the
string's length times the pattern's.
"""

from __future__ import annotations

import re
import signal
from contextlib import contextmanager
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Over this length a string isn't matched in the JVM by a pattern with a repeated group.
LONGEST = 500
_ESCAPES = frozenset("dDwWsSbBAZntrfv") | frozenset(r"\.^$*+?{}[]()|/-&~#'\"!%,:;<=>@_` ")
_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}|[*+?]")
_OPEN = re.compile(r"\((?:\?(?::|=|!|<=|<!|>))?(?!\?)")


@lru_cache(4096)
def compiled(pattern: str, flags: int = 0):
    """(compiled pattern, None) or (None, error)."""
    try:
        return re.compile(pattern, flags), None
    except (re.error, OverflowError, RecursionError) as e:
        return None, str(e)


def to_java(pattern: str) -> tuple[str, bool, bool, int] | None:
    """(Java pattern of a full match, reads only ASCII alike, repeats a group, quantifiers with a choice), None if the pattern isn't
    native."""
    if compiled(pattern)[0] is None:
        return None
    out, at, groups, ascii_only, repeats, choices = [], 0, [], False, False, 0
    closed: tuple[bool, bool] | None = None  # (has a quantifier, has an alternation) of the group that just ended
    while at < len(pattern):
        c, ended, closed = pattern[at], closed, None
        if c == "\\":
            e = pattern[at + 1 : at + 2]
            if e not in _ESCAPES:
                return None
            ascii_only |= e in "dDwWsSbB"
            out.append(r"\z" if e == "Z" else "\\" + e)
            at += 2
        elif c == "[":
            found = re.compile(r"\[\^?((?:[^\[\]\\&~|]|\\[dDwWsSntr\\.^$*+?{}\[\]()|/-])+)\]").match(pattern, at)
            if not found or "--" in found[1]:
                return None
            ascii_only |= bool(re.search(r"\\[dDwWsS]", found[1]))
            out.append(found[0])
            at = found.end()
        elif c == "(":
            found = _OPEN.match(pattern, at)
            if not found:
                return None
            groups.append([False, False])
            out.append(found[0])
            at = found.end()
        elif c == ")":
            closed = tuple(groups.pop())
            if groups:
                groups[-1][0] |= closed[0]
            out.append(c)
            at += 1
        elif found := _QUANTIFIER.match(pattern, at):
            if ended is not None:
                if any(ended):
                    return None
                repeats = True
            if groups:
                groups[-1][0] = True
            follow = pattern[found.end() : found.end() + 1]
            fixed = found[0].startswith("{") and ("," not in found[0] or len(set(found[0][1:-1].split(","))) == 1)
            choices += not fixed and follow != "+"
            out.append(found[0] + (follow if follow and follow in "+?" else ""))
            at = found.end() + (1 if follow and follow in "+?" else 0)
        elif c in "{}]" or ord(c) > 126:
            return None
        else:
            if c == "|" and groups:
                groups[-1][1] = True
            out.append(c)
            at += 1
    return rf"(?Ud)\A(?:{''.join(out)})\z", ascii_only, repeats, choices


class _Late(Exception):
    pass


@contextmanager
def _limit(seconds: float | None):
    """Raises _Late in the block once the time is up; no limit without one."""
    if not seconds:
        yield
        return

    def stop(*_):
        raise _Late

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def python_match(pattern: Column, text: Column, flags: Column | None = None, seconds: float | None = None, whole: bool = True) -> Column:
    """struct(matched, error): null and false for a null or bad pattern; error 'Timeout after ...' when out of time."""

    @F.pandas_udf("matched boolean, error string")
    def match(patterns: pd.Series, texts: pd.Series, bits: pd.Series) -> pd.DataFrame:
        matched, errors = [], []
        for p, t, f in zip(patterns, texts, bits, strict=True):
            found, error = compiled(p, int(f)) if p is not None else (None, "no pattern")
            ok = None
            if found is not None and t is not None:
                try:
                    with _limit(seconds):
                        ok = bool((found.fullmatch if whole else found.search)(t))
                except _Late:
                    error = f"Timeout after {seconds}s"
            matched.append(ok)
            errors.append(error)
        return pd.DataFrame({"matched": pd.Series(matched, dtype="boolean"), "error": pd.Series(errors, dtype="object")})

    return match(pattern, text, F.lit(0) if flags is None else flags)


def python_lists(pattern: Column, yes: Column, no: Column, seconds: float | None = None) -> Column:
    """struct(yes, no, error): the strings of ``yes`` that match and those of ``no`` that don't, in order; null strings go.  A bad
    pattern, or lists that take longer than ``seconds`` together, leave nothing and an error."""

    @F.pandas_udf("yes array<string>, no array<string>, error string")
    def match(patterns: pd.Series, goods: pd.Series, bads: pd.Series) -> pd.DataFrame:
        rows = []
        for p, good, bad in zip(patterns, goods, bads, strict=True):
            found, error = compiled(p) if p is not None else (None, "no pattern")
            kept = [], []
            if found is not None:
                try:
                    with _limit(seconds):
                        for want, strings, out in ((True, good, kept[0]), (False, bad, kept[1])):
                            out += [t for t in (() if strings is None else strings) if t is not None and bool(found.fullmatch(t)) == want]
                except _Late:
                    kept, error = ([], []), f"Timeout after {seconds}s"
            rows.append((*kept, error))
        return pd.DataFrame(rows, columns=["yes", "no", "error"])

    return match(pattern, yes, no)


def classify(pattern: Column) -> Column:
    """struct(error, java, ascii_only, repeats, choices) of a pattern: ``error`` if it doesn't compile, ``java`` if it is native."""

    @F.pandas_udf("error string, java string, ascii_only boolean, repeats boolean, choices int")
    def find(patterns: pd.Series) -> pd.DataFrame:
        rows = []
        for p in patterns:
            error = "no pattern" if p is None else compiled(p)[1]
            java = None if error else to_java(p)
            rows.append((error, *(java or (None, None, None, None))))
        return pd.DataFrame(rows, columns=["error", "java", "ascii_only", "repeats", "choices"]).astype({"choices": "Int32"})

    return find(pattern)


def _classified(rows: DataFrame, pattern: str) -> DataFrame:
    """``rows`` with ``rx``, from ``classify``; each pattern is looked at once."""
    kinds = rows.select(F.col(pattern).alias("rx_key")).where("rx_key is not null").distinct().withColumn("rx", classify(F.col("rx_key")))
    return rows.join(kinds, F.col(pattern) == F.col("rx_key"), "left").drop("rx_key")


def _quick(seconds: float | None) -> Column:
    return F.col("rx.java").isNotNull() & (F.lit(not seconds) | (F.col("rx.choices") <= 1))


def _alike(text: Column) -> Column:
    """Whether both engines read a string alike by the pattern in ``rx``; null for a null string."""
    plain = text.rlike(r"\A[\x20-\x7E\t\r\n]*\z") | ~F.col("rx.ascii_only")
    return plain & (~F.col("rx.repeats") | (F.length(text) <= LONGEST))


def full_match(rows: DataFrame, pattern: str = "expr", text: str = "s", seconds: float | None = None) -> DataFrame:
    """``rows`` with ``matched`` and ``match_error``.  Patterns are classified once each; the two engines get their rows by
    separate branches, because a pattern that the JVM can't compile fails a task even under a condition.  ``seconds`` limits
    each match."""
    both = _classified(rows, pattern)
    native = F.coalesce(_quick(seconds) & _alike(F.col(text)), F.lit(False))
    kept = [F.col(c) for c in rows.columns]
    fast = both.where(native).select(*kept, F.expr(f"`{text}` rlike rx.java").alias("matched"), F.lit(None).cast("string").alias("match_error"))
    slow = both.where(~native).withColumn("rx_found", python_match(F.col(pattern), F.col(text), seconds=seconds))
    return fast.unionByName(slow.select(*kept, F.col("rx_found.matched").alias("matched"), F.col("rx_found.error").alias("match_error")))


def match_lists(rows: DataFrame, pattern: str = "expr", seconds: float | None = None) -> DataFrame:
    """``rows`` with ``rx_yes``, ``rx_no`` and ``rx_error`` as from ``python_lists`` of the columns yes and no.  Lists stay in
    their rows, so nothing is shuffled but the patterns; an entry goes to the JVM if all its strings may.  ``seconds``
    limits an entry."""
    both = _classified(rows, pattern)
    fits = lambda name: F.forall(F.coalesce(name, F.array().cast("array<string>")), lambda s: F.coalesce(_alike(s), F.lit(True)))
    native = F.coalesce(_quick(seconds) & fits("yes") & fits("no"), F.lit(False))
    kept = [F.col(c) for c in rows.columns]
    lists = [F.expr(f"coalesce(filter({name}, s -> {negated} s rlike rx.java), cast(array() as array<string>))").alias(f"rx_{name}") for name, negated in (("yes", ""), ("no", "not"))]
    fast = both.where(native).select(*kept, *lists, F.lit(None).cast("string").alias("rx_error"))
    slow = both.where(~native).withColumn("rx_found", python_lists(F.col(pattern), F.col("yes"), F.col("no"), seconds))
    return fast.unionByName(slow.select(*kept, *(F.col(f"rx_found.{x}").alias(f"rx_{x}") for x in ("yes", "no", "error"))))
