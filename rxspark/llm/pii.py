"""Personal data and secrets by candidate gradient boosting.  DataFrame functions only.

1.  *Base* spans of four kinds come from fixed patterns with format checks; they are always reported.
2.  High-recall generators propose further spans, which may overlap base ones and each other: loosely written digit
    groups, mail addresses (also "name [at] host [dot] tld"), network addresses ("1[.]2[.]3[.]4"), and long tokens that
    mix letters and digits, as keys and passwords do.
3.  Boosted trees score each candidate by its format and its surroundings.  No span is labelled by hand, so labels come
    from evidence that the trees don't see with the example that it labels:

    *  a candidate that coincides with a base span is positive; one that partly overlaps is left out;
    *  two in three of these, by a hash of text and place, count with the format that they would have if written less
       strictly (an address with its "[at]" and "[dot]", a network address with "[.]", a phone number without "+" and its country,
       or without its parentheses too; half of them without the word before it), so that such forms are learnt although no
       base pattern finds them;
    *  a digit group that fails the base formats is positive behind a word such as "phone" or "card", with that word hidden,
       and negative elsewhere; what has one of the less strict forms above is neither, nobody labelled it;
    *  a token is positive where a name such as "token", "password" or "key" is assigned to it, negative elsewhere; the
       name is no feature, so that equal formats are found without it.

    All features are small integers, so the corpus is reduced to counts for each distinct feature vector (at most
    ``CELLS`` rows, however large the corpus); the trees are fitted to those counts and compiled into CASE expressions.
4.  For each kind the threshold is the lowest score at which, on the held-out half of the documents, the Wilson lower
    bound of the precision by that evidence is ``PRECISION`` or more.  Candidates over it that touch no base span are added.

Positions are code points, ends exclusive.  The patterns below are written with possessive quantifiers and run starts, which
keeps them linear on long runs and gives the same matches as the plain patterns: no character that ends a run can continue
it.  Places are running sums in two levels, and base spans meet candidates in order of their starts, so that a text
with n spans takes about n * sqrt(n) steps.

A null or empty text has no spans.  Spans that begin together are ordered by kind; none comes twice.  Repeated rows
give repeated results; an empty table gives an empty one.  A null doc_id belongs to the first half.  ``spans`` replaces columns
whose names start with ``pii_``; ``query`` and ``stage`` keep any columns apart from their own.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, remainder, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
PRECISION, ROUNDS, RATE = 0.9, 24, 0.3
#: Code points of a text that are cut at once when it is redacted.
CUT = 4096

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HOST = "[A-Za-z0-9-]++"
_DOT = r"(?:\x20?(?:\[dot\]|\(dot\))\x20?|\x20\.\x20|\.)"
_TOKEN = "[A-Za-z0-9_+/=-]"
#: email: an address as in PATTERNS; or loosely written with any number of dots, up to the last part that ends in two letters; or
#: with one dot that has a space on one side, as after a sentence.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:@{_HOST}(?:\.{_HOST})++|\x20?(?:\[at\]|\(at\)|@)\x20?{_HOST}"
    rf"(?:(?:(?:{_DOT}{_HOST}(?<![A-Za-z]{{2}}))*+{_DOT}{_HOST}(?<=[A-Za-z]{{2}}))++|\x20?\.\x20?[A-Za-z]{{2,}}+))",
    "digits": r"(?<![0-9A-Za-z])[+(]?[0-9][0-9\x20().-]{5,}[0-9]",
    "ip": r"(?<![0-9A-Za-z])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9])",
    "token": rf"(?:\G|(?<!{_TOKEN})){_TOKEN}{{16,}}+",
}
#: Digits in groups as in phone numbers, without "+".
GROUPED = r"^\(?[0-9]{2,4}(?:\)\x20?|[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}$"
#: A name to which a value is assigned, right before the value.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|credential|bearer|(?:api|access|private|auth)[ _-]?key)[A-Za-z_]{0,12}[\x22\x27]?\x20{0,2}(?:[:=]{1,2}>?\x20{0,2}|\x20)[\x22\x27]?$"
CUES = "(mail|tel|phone|call|fax|mobile|card|visa|server|host|contact|address)"

#: Feature -> number of values.  CELLS bounds the rows that are collected for fitting.
FEATURES = {"kind": 5, "digits": 11, "marks": 5, "paren": 2, "left": 5, "right": 5, "word": 2, "shape": 4}
CELLS = math.prod(FEATURES.values())


# -- SQL over arrays ------------------------------------------------------------------------------------------------


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(array: str, zero: str, join: str, item: str) -> str:
    """For each element v of a non-empty array, ``join`` (of a and b) over ``item`` (of v) of all before it: sums of blocks of
    about sqrt(n), and those of a block."""
    one = join.replace("§", item)
    return _let("q", array, _let("k", "cast(ceil(sqrt(size(q))) as int)", _let(
        "bs", f"transform(sequence(0, cast((size(q) - 1) div k as int)), j -> aggregate(slice(q, j * k + 1, k), {zero}, (a, v) -> {one}))",
        _let("cs", f"transform(bs, (u, j) -> aggregate(slice(bs, 1, j), {zero}, (a, v) -> {join.replace('§', 'v')}))",
             f"transform(q, (u, i) -> aggregate(slice(q, cast(i div k as int) * k + 1, i % k), cs[cast(i div k as int)], (a, v) -> {one}))"))))


_FOUND = "array<struct<s:int,e:int,x:string,l:string,r:string>>"


def _located(text: str, pattern: str) -> str:
    """SQL for the matches (s, e, x, l, r): start, end, text, what is before (24 code points at most) and the one after."""
    p = _quoted(pattern)
    before = _running("transform(z.hit, (x, i) -> length(z.gap[i]) + length(x))", "0", "a + §", "v")
    each = f"""transform({before}, (n, i) -> struct(n + length(z.gap[i]) as s, n + length(z.gap[i]) + length(z.hit[i]) as e, z.hit[i] as x,
        right(if(i > 0 and length(z.gap[i]) < 24, concat(right(z.hit[greatest(i - 1, 0)], 24), z.gap[i]), z.gap[i]), 24) as l,
        if(z.gap[i + 1] = '' and i + 1 < size(z.hit), left(z.hit[least(i + 1, size(z.hit) - 1)], 1), left(z.gap[i + 1], 1)) as r))"""
    return _let("z", f"struct(regexp_extract_all({text}, {p}, 0) as hit, split({text}, {p}) as gap)", f"if(size(z.hit) = 0, {_NONE}, {each})")


_NONE = f"cast(array() as {_FOUND})"
_DIGITS = "regexp_replace({}, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length({0})), 0, (a, i) -> a + if(i % 2 = 1, cast(substring({0}, -i, 1) as int),
    2 * cast(substring({0}, -i, 1) as int) - if(cast(substring({0}, -i, 1) as int) > 4, 9, 0))) % 10 = 0"""
_SMALL = r"m.x rlike '^0*[0-9]{1,3}(\\.0*[0-9]{1,3}){3}$' and forall(split(m.x, '\\.'), q -> cast(right(q, 3) as int) <= 255)"
_ROW = "array<struct<s:int,kind:int,e:int,digits:int,marks:int,paren:int,left:int,right:int,word:int,shape:int,form:int,rdigits:int,rmarks:int,rparen:int,cue:boolean,open:boolean>>"


def _bin(n: str) -> str:
    return f"case when {n} = 0 then 0 when {n} < 7 then 1 when {n} < 9 then 2 when {n} = 9 then 3 when {n} = 10 then 4 when {n} = 11 then 5 when {n} < 14 then 6 when {n} < 16 then 7 when {n} = 16 then 8 when {n} < 20 then 9 else 10 end"


def _row(which: str) -> str:
    """Features of the candidates of a generator, and (rdigits, rmarks, rparen): those of the less strict form of a base span."""
    n = f"length({_DIGITS.format('m.x')})"
    side = "case when {0} = '' or {0} rlike '[ \\\\x09-\\\\x0D]' then 0 when {0} rlike '[A-Za-z]' then 1 when {0} rlike '[0-9]' then 2 when {0} rlike '[\"=:/_]' then 3 else 4 end"
    marks = "least(4, length({0}) - length(translate({0}, ' .-', '')))"
    digits, paren, own = _bin(n), "cast({0} rlike '[(\\\\[]' as int)", marks.format("m.x")
    word, shape, cue, open_ = f"cast(lower(m.l) rlike '{CUES}' as int)", "0", "false", paren.format("m.x") + " = 1"
    # what is left of an address's marks when its dots after the @ are written out
    tight = "cast(least(4, length(m.x) - length(translate(m.x, ' .-', '')) - regexp_count(substring_index(m.x, '@', -1), '[.]')) as int)"
    form = "cast(pmod(xxhash64(m.x, m.s), 3) as int)"
    relaxed = digits, own, paren.format("m.x")
    if which == "email":
        kind, relaxed = "0", (digits, f"if({form} = 1, 4, {tight})", "1")
    elif which == "ip":
        kind = "1"
    elif which == "digits":
        kind = f"case when m.x rlike '^[0-9]+([.][0-9]+){{3}}$' then 1 when {n} >= 12 and not m.x rlike '[+(]' then 2 else 3 end"
        open_ = f"{n} between 9 and 11 and m.x rlike {_quoted(GROUPED)}"
        short = "regexp_replace(m.x, '^[+][0-9]{1,3}[ .-]?', '')"
        m = f"length({_DIGITS.format(short)})"
        ip, phone = "m.x rlike '^[0-9]+([.][0-9]+){3}$'", "m.x rlike '^[+][0-9]{1,3}[ .(-]'"
        relaxed = f"if({phone}, {_bin(m)}, {digits})", f"case when {ip} then 2 + {form} when {phone} then {marks.format(short)} else {own} end", f"case when {ip} then 1 when {phone} and {form} = 2 then 0 else {paren.format('m.x')} end"
    else:
        kind, word, open_, cue = "4", "0", "false", f"m.l rlike {_quoted(ASSIGNED)}"
        own = "case when length(m.x) < 20 then 0 when length(m.x) < 32 then 1 when length(m.x) <= 40 then 2 when length(m.x) <= 64 then 3 else 4 end"
        shape = "case when m.x rlike '^[0-9a-f]+$' then 0 when m.x rlike '^[0-9A-Fa-f-]+$' then 1 when m.x rlike '^[0-9A-Za-z]+$' then 2 else 3 end"
        relaxed = digits, own, "0"
    fields = {
        "s": "m.s", "kind": kind, "e": "m.e", "digits": digits, "marks": own, "paren": paren.format("m.x"), "left": side.format("right(m.l, 1)"), "right": side.format("m.r"), "word": word, "shape": shape,
        "form": form, "rdigits": relaxed[0], "rmarks": relaxed[1], "rparen": relaxed[2], "cue": cue, "open": open_,
    }
    return f"transform(pii_more_{which}, m -> struct({', '.join(f'cast({v} as {"boolean" if k in ("cue", "open") else "int"}) as {k}' for k, v in fields.items())}))"


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_text``, ``pii_base`` and ``pii_loose``; the first has no null, the others are arrays in order of s.
    pii_base: (s, k, e): start, place in KINDS, end; pii_loose: (s, kind, e, features, ..., known, touches)."""
    df = docs.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    digits = "pii_text rlike '[0-9]'"
    d = _DIGITS.format("m.x")
    checks = {
        "email": "true",
        "ip": _SMALL,
        "card": f"length({d}) between 12 and 19 and {_LUHN.format(d)}",
        "phone": f"length({d}) between 9 and 15",
    }
    has = {"email": "contains(pii_text, '@')", "ip": digits, "card": digits, "phone": "contains(pii_text, '+')"}
    df = df.withColumns({f"pii_{k}": F.expr(f"if({has[k]}, {_located('pii_text', PATTERNS[k])}, {_NONE})") for k in BASE})
    df = df.withColumn("pii_base", F.expr("array_sort(concat(" + ", ".join(
        f"transform(filter(pii_{k}, m -> {checks[k]}), m -> struct(m.s as s, {i} as k, m.e as e))" for i, k in enumerate(BASE)
    ) + "))")).drop(*(f"pii_{k}" for k in BASE))
    when = {"email": "pii_text rlike '@|[\\\\[(]at[\\\\])]'", "digits": digits, "ip": f"{digits} and pii_text rlike '[\\\\[(](dot|[.])[\\\\])]'", "token": digits}
    more = {f"pii_more_{k}": F.expr(f"if({when[k]}, {_located('pii_text', LOOSE[k])}, {_NONE})") for k in LOOSE}
    df = df.withColumns(more).withColumn("pii_more_token", F.expr("filter(pii_more_token, m -> m.x rlike '[0-9]' and m.x rlike '[A-Za-z]')"))
    df = df.withColumn("pii_loose", F.expr(f"concat({', '.join(map(_row, LOOSE))})")).drop(*more)
    return df.withColumn("pii_loose", F.expr(f"if(size(pii_loose) = 0, cast(null as {_ROW[:-2]},known:boolean,touches:boolean>>), {_met()})"))


def _met() -> str:
    """Candidates with ``known`` (a base span has its place) and ``touches`` (one overlaps), by one order of both."""
    names = [f.split(":")[0] for f in _ROW[len("array<struct<") : -2].split(",")]
    rest = ", ".join(f"m.{n} as {n}" for n in names if n not in ("s", "e"))
    none = ", ".join(f"cast(null as {'boolean' if n in ('cue', 'open') else 'int'}) as {n}" for n in names if n not in ("s", "e"))
    both = f"array_sort(concat(transform(pii_base, m -> struct(m.s as s, 0 as own, m.e as e, {none})), transform(pii_loose, m -> struct(m.s as s, 1 as own, m.e as e, {rest}))))"
    ends = _running("o", "-1", "greatest(a, §)", "if(v.own = 0, v.e, -1)")
    starts = _running("reverse(o)", "2147483647", "least(a, §)", "if(v.own = 0, v.s, 2147483647)")
    flags = "exists(slice(o, greatest(i - 7, 1), least(i, 8)), b -> b.own = 0 and b.s = m.s and b.e = m.e) as known, ends[i] > m.s or starts[size(o) - 1 - i] < m.e as touches"
    each = f"transform(o, (m, i) -> struct({', '.join(f'm.{n} as {n}' for n in names)}, m.own as own, {flags}))"
    out = f"transform(filter({each}, m -> m.own = 1), m -> struct({', '.join(f'm.{n} as {n}' for n in [*names, 'known', 'touches'])}))"
    return _let("o", both, _let("ends", ends, _let("starts", starts, out)))


# -- learning -------------------------------------------------------------------------------------------------------


def count_cells(located: DataFrame, fold: Column) -> DataFrame:
    """Counts for each distinct feature vector and fold (0 or 1): n candidates, p of them positive by evidence."""
    each = located.select(fold.alias("fold"), F.inline("pii_loose")).where("known or not touches and not open")
    relaxed = F.col("known") & (F.col("form") > 0)
    hidden = ~F.col("known") & (F.col("kind") >= 2) & (F.col("word") == 1) & (F.col("digits") >= 3)
    each = each.withColumn("good", F.col("known") | F.col("cue") | hidden)
    each = each.withColumns({x: F.when(relaxed, F.col(f"r{x}")).otherwise(F.col(x)) for x in ("digits", "marks", "paren")})
    each = each.withColumn("word", F.when(hidden | relaxed & (F.col("form") == 2), 0).otherwise(F.col("word")))
    return each.groupBy("fold", *FEATURES).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("p"))


def _grow(cells: list[tuple], g: list[float], h: list[float], rows: list[int], depth: int):
    """A regression tree by exact search over the cells: ("leaf", value) or (feature, cut, low branch, high branch)."""
    total_g, total_h = sum(g[r] for r in rows), sum(h[r] for r in rows)
    best, leaf = (1e-6, None), ("leaf", RATE * total_g / (total_h + 1.0))
    if not depth:
        return leaf
    for f, size in enumerate(FEATURES.values()):
        by = defaultdict(lambda: [0.0, 0.0])
        for r in rows:
            x = by[cells[r][f]]
            x[0] += g[r]
            x[1] += h[r]
        a = b = 0.0
        for cut in range(size - 1):
            a, b = a + by[cut][0], b + by[cut][1]
            gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
            if gain > best[0]:
                best = gain, (f, cut)
    if best[1] is None:
        return leaf
    f, cut = best[1]
    low, high = [r for r in rows if cells[r][f] <= cut], [r for r in rows if cells[r][f] > cut]
    return f, cut, _grow(cells, g, h, low, depth - 1), _grow(cells, g, h, high, depth - 1)


def _value(tree, cell) -> float:
    while tree[0] != "leaf":
        tree = tree[2] if cell[tree[0]] <= tree[1] else tree[3]
    return tree[1]


def boost(cells: list[tuple], n: list[float], p: list[float]) -> list:
    """Trees for the log-odds of a candidate being personal data; Newton steps on the logistic loss."""
    trees, score = [], [0.0] * len(cells)
    for _ in range(ROUNDS if cells else 0):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        g = [p[i] - n[i] * q for i, q in enumerate(prob)]
        h = [n[i] * q * (1 - q) for i, q in enumerate(prob)]
        trees.append(_grow(cells, g, h, list(range(len(cells))), 4))
        score = [s + _value(trees[-1], c) for s, c in zip(score, cells, strict=True)]
    return trees


def _wilson(p: float, n: float, z: float = 1.96) -> float:
    if not n:
        return 0.0
    q = p / n
    return (q + z * z / (2 * n) - z * math.sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(located: DataFrame, fold: Column) -> tuple[list, dict[int, float]]:
    """(trees, threshold by kind): trees from fold 0, thresholds from fold 1."""
    rows = count_cells(located, fold).collect()  # at most 2 * CELLS rows
    rows = sorted((r["fold"], *(r[f] for f in FEATURES), r["n"], r["p"]) for r in rows)
    train, held = ([r for r in rows if r[0] == side] for side in (0, 1))
    trees = boost([r[1:-2] for r in train], [r[-2] for r in train], [r[-1] for r in train])
    thresholds = {}
    for k in range(len(KINDS)):
        at: dict[float, list[int]] = defaultdict(lambda: [0, 0])
        for r in held:
            if r[1] == k:
                x = at[round(sum(_value(t, r[1:-2]) for t in trees), 9)]
                x[0], x[1] = x[0] + r[-2], x[1] + r[-1]
        n = p = 0
        for s in sorted(at, reverse=True):
            n, p = n + at[s][0], p + at[s][1]
            if s > 0 and _wilson(p, n) >= PRECISION:
                thresholds[k] = s - 1e-9
    return trees, thresholds


def _case(tree) -> str:
    if tree[0] == "leaf":
        return f"{tree[1]!r}D"
    return f"if(m.{list(FEATURES)[tree[0]]} <= {tree[1]}, {_case(tree[2])}, {_case(tree[3])})"


def detect(located: DataFrame, trees: list, thresholds: dict[int, float]) -> DataFrame:
    """``located`` with ``pii_spans``: base spans and accepted candidates (s, k, e), by start and kind."""
    score = " + ".join(map(_case, trees)) or "0D"
    over = " ".join(f"when {k} then {t!r}D" for k, t in thresholds.items())
    plain = "transform({}, m -> struct(m.s as s, m.{} as k, m.e as e))"
    more = f"coalesce(filter(pii_loose, m -> not m.touches and ({score}) >= case m.kind {over} end), slice(array(pii_loose[0]), 1, 0))"
    own = f"concat({plain.format('pii_base', 'k')}, {plain.format(more, 'kind')})" if thresholds else plain.format("pii_base", "k")
    return located.withColumn("pii_spans", F.expr(f"array_sort({own})"))


# -- results --------------------------------------------------------------------------------------------------------


def _written(column: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, m -> concat(element_at(array({names}), m.k + 1), ':', m.s, ':', m.e)), ',')"


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    ends = _running("pii_spans", "0", "greatest(a, §)", "v.e")
    # spans that begin a run, each with the end of the run before it
    runs = _let("ends", ends, "filter(transform(pii_spans, (m, i) -> struct(m.s as s, m.k as k, ends[i] as e)), m -> m.s >= m.e)")
    last = "aggregate(pii_spans, 0, (a, m) -> greatest(a, m.e))"
    # the text from a to b, out of blocks: finding a place in one takes as long as it is far from its start
    piece = f"if(a.b <= a.a, '', array_join(transform(sequence(cast(a.a div {CUT} as int), cast((a.b - 1) div {CUT} as int)), c -> substring(bs[c], greatest(a.a - c * {CUT}, 0) + 1, least(a.b - c * {CUT}, {CUT}) - greatest(a.a - c * {CUT}, 0))), ''))"
    parts = f"concat(transform(rs, m -> struct(m.e as a, m.s as b, element_at(array({names}), m.k + 1) as name)), array(struct({last} as a, length(pii_text) as b, '' as name)))"
    clean = _let("bs", f"regexp_extract_all(pii_text, '(?s).{{1,{CUT}}}', 0)", _let("rs", runs, f"array_join(transform({parts}, a -> concat({piece}, a.name)), '')"))
    return found.withColumn(text, F.when(F.size("pii_spans") > 0, F.expr(clean)).otherwise(F.col(text)))


def _fold(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(F.col(doc_id), 2), F.lit(0)).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    located = materialize(located.select("doc_id", "pii_base", "pii_loose"), "spans")  # texts are searched once
    found = detect(located, *fit(located, _fold()))
    counts = [F.expr(f"cast(size(filter(pii_base, m -> m.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    more = [F.size("pii_spans").cast("long").alias("n_spans"), (F.size("pii_spans") - F.size("pii_base")).cast("long").alias("n_added")]
    return found.select("doc_id", *counts, F.expr(f"sha2({_written('pii_base')}, 256)").alias("base_sha256"), F.expr(_written("pii_spans")).alias("spans"), *more)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in ``text`` and ``n_chars`` measured again."""
    located = spans(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text"))
    clean = redact(detect(located, *fit(located, _fold("row.doc_id"))))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(row.alias("row")).select("row.*")
