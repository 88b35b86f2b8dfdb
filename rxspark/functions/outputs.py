"""Solutions found in free text written by a model."""

from __future__ import annotations

import json
import re
from typing import Any

# Fixed patterns of the format: groups of braces nested at most twice; the text after a final marker; the keys that
# make a text worth searching.
BRACES = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")
FINAL = re.compile(r"final[^{]*(\{.*?\}(?:\s*\})*)", re.S | re.I)
KEYS = [re.compile(p) for p in (r'"ast"\s*:\s*\{[^}]*(?:\{[^}]*\}[^}]*)*\}', r'"flags"\s*:\s*"[^"]*"', r'"unsat"\s*:\s*(?:true|false)')]
TRAILING_COMMA = re.compile(r",\s*([}\]])")


class NoSolution(Exception):
    pass


def primary(text: str) -> dict[str, Any]:
    """The last group of braces, or what follows a final marker, as a solution with defaults filled in."""
    groups = BRACES.findall(text)
    if groups:
        found = groups[-1]
    elif marked := FINAL.search(text):
        found = marked[1]
    else:
        raise NoSolution("there are no braces in the output")
    for attempt in (found, TRAILING_COMMA.sub(r"\1", found)):
        try:
            solution = json.loads(attempt)
            break
        except ValueError as e:
            error = e
    else:
        raise NoSolution(f"what stands in braces is no JSON: {error}")
    if not isinstance(solution, dict):
        raise NoSolution("a solution is an object")
    solution = {"flags": "", "unsat": False} | solution
    if not solution["unsat"] and "ast" not in solution:
        raise NoSolution("a solution that can be met needs a tree under 'ast'")
    return solution


def fallback(text: str) -> Any:
    """The value from the first brace to the one that balances it (braces in strings count), None if there is none."""
    if not any(k.search(text) for k in KEYS) or (start := text.find("{")) < 0:
        return None
    depth = 0
    for brace in re.finditer(r"[{}]", text[start:]):
        depth += 1 if brace[0] == "{" else -1
        if not depth:
            try:
                return json.loads(text[start : start + brace.end()])
            except (ValueError, RecursionError):
                return None
    return None


def parse(text: str | None, strict: bool = False) -> dict[str, Any]:
    """(solution as JSON, error) of an output; never raises."""
    try:
        try:
            solution = primary(text or "")
        except NoSolution:
            if strict:
                raise
            solution = fallback(text or "")
            if solution is None:
                raise NoSolution("no solution was found in the output") from None
        return {"solution": json.dumps(solution), "error": None}
    except (NoSolution, RecursionError) as e:
        return {"solution": None, "error": str(e)}
