"""Queries that run syntax trees and model outputs through the library: trees are built from the rows of ``part``, and SQL writes
down what has to come out of each."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex_ast, register
from ..operators import score
from .registry import query, read


def lit(x: str) -> dict:
    return {"type": "lit", "value": x}


def seq(*x: dict) -> dict:
    return {"type": "seq", "items": list(x)}


def alt(*x: dict) -> dict:
    return {"type": "alt", "options": list(x)}


def rep(child: dict, low: Any = 1, high: Any = None, possessive: bool = False) -> dict:
    return {"type": "repeat", "child": child, "min": low, "max": high, "possessive": possessive}


def node(kind: str, name: str, child: dict | None = None) -> dict:
    return {"type": kind, "kind": name} | ({"child": child} if child else {})


def chars(*items: tuple, negated: bool = False) -> dict:
    made = [{"type": "range", "from": i[1], "to": i[2]} if i[0] == "range" else {"type": i[0], "value": i[1]} for i in items]
    return {"type": "charclass", "negated": negated, "items": made}


def _filled(solution: Any, **values: Column) -> Column:
    """A solution as JSON with columns in place of "@name"; numbers lose their quotes."""
    text = solution if isinstance(solution, str) else json.dumps(solution)
    out = F.lit(text.replace('"@n"', "@n").replace('"@m"', "@m"))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"@{name}"), value.cast("string"))
    return out


def _pick(key: Column, cases: list[Column]) -> Column:
    out = F.when(key == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(key == i, c)
    return out


def _case(key: str, cases: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def _compiled(df: DataFrame, solution: Column) -> DataFrame:
    return df.withColumn("done", register.rx_compile(solution))


def _problem(number: int) -> str:
    return "'!" + regex_ast.PROBLEMS[number] + "'"


#: (solution, SQL for its pattern, or for its error with "!" before it).  b and t are a brand and a type, n a size from 1 to 50.
B, T, N = "@b", "@t", "@n"
TREES: list[tuple[Any, str]] = [
    ({"ast": seq(node("anchor", "start"), lit(B), node("anchor", "end"))}, "'^' || b || '$'"),
    ({"ast": alt(lit(B), lit(T), lit(B))}, "least(b, t) || '|' || greatest(b, t)"),
    ({"ast": rep(alt(lit(B), lit(T)), N)}, _problem(regex_ast.NESTED)),
    ({"ast": rep(alt(lit(T), lit(B)), N, None, True)}, "'(?:' || least(b, t) || '|' || greatest(b, t) || ')' || CASE n WHEN 1 THEN '+' ELSE '{' || n || ',}' END || '+'"),
    ({"ast": node("group", "atomic", rep(alt(lit(B), lit(T)), 0))}, "'(?>(?:' || least(b, t) || '|' || greatest(b, t) || ')*)'"),
    ({"ast": node("look", "behind", rep(lit("a"), 1, N))}, f"CASE n WHEN 1 THEN '(?<=a{{1}})' ELSE {_problem(regex_ast.BEHIND)} END"),
    ({"ast": seq(node("look", "behind_not", lit(B)), node("look", "ahead", lit(T)), node("look", "ahead_not", lit("x.")))}, "'(?<!' || b || ')(?=' || t || ')(?!x\\.)'"),
    ({"ast": rep(lit("a"), 1, "@m")}, f"CASE WHEN n > 24 THEN {_problem(regex_ast.CAP)} ELSE 'a{{1,' || (n + 40) || '}}' END"),
    ({"ast": rep(node("anchor", "word_boundary"))}, _problem(regex_ast.EMPTY)),
    ({"ast": rep(rep(lit("a"), 0, N))}, _problem(regex_ast.EMPTY)),
    ({"ast": rep(rep(rep(lit(B))))}, _problem(regex_ast.NESTED)),
    ({"ast": rep(rep(lit("a")))}, "'a++'"),
    ({"unsat": True, "flags": "i"}, "''"),
    ({"ast": seq(node("group", "noncap", lit(B)), node("group", "noncap", alt(lit(T), lit(B))), lit("-"))}, "b || '(?:' || least(b, t) || '|' || greatest(b, t) || ')-'"),
    ({"ast": {"type": "tree", "value": B}}, "'!not a tree of the format: no node is called tree'"),
    ({"ast": {"type": "lit", "value": 3}}, "'!not a tree of the format: ''value'' holds int, not str'"),
    ({"ast": seq()}, "'!not a tree of the format: seq takes 1 or more ''items'''"),
    ({"ast": alt(lit(B))}, "'!not a tree of the format: alt takes 2 or more ''options'''"),
    ({"ast": rep(lit("a"), 60, N)}, f"CASE WHEN n < 60 THEN '!not a tree of the format: the bounds of a repeat are out of order' ELSE 'a{{60}}' END"),
    ({"ast": seq({"type": "dot"}, {"type": "bclass", "value": "D"}, chars(("char", "]"), ("range", "f", "a"), ("predef", "s"), ("range", "c", "k"), ("char", "^"), negated=True))}, "'.\\D[^a-k\\]\\^\\s]'"),
    ({"ast": rep(lit("ab"), N, N)}, "'ab{' || n || '}'"),
    ({"flags": T, "ast": lit("a")}, "'!no such flags: ' || array_to_string(list_sort(list_distinct([x for x in string_split(t, '') if NOT contains('imsa', x)])), '')"),
    ({"ast": "@b"}, "'!a solution that can be met needs a tree under ''ast'''"),
    ({"ast": rep(rep(lit("a")), 0)}, "'!Python can''t compile the pattern: multiple repeat at position 2'"),
    ({"ast": alt(lit("q"), lit("a"), lit("*"), lit("q"))}, "'[*aq]'"),
    ({"ast": rep(seq(lit(B), rep(lit("x"), 2, 5)), 0, 1, True)}, "'(?:' || b || 'x{2,5})?+'"),
]
_ROWS = "SELECT p_partkey, p_partkey % {} AS k, p_brand AS b, p_type AS t, p_size AS n FROM part"


def _parts(spark, sf_dir, n: int) -> DataFrame:
    cols = F.col
    return read(spark, sf_dir, "part").select("p_partkey", (cols("p_partkey") % n).alias("k"), cols("p_brand").alias("b"), cols("p_type").alias("t"), cols("p_size").alias("n"), (cols("p_size") + 40).alias("m"))


@query(f"SELECT p_partkey, CASE WHEN e LIKE '!%' THEN NULL ELSE e END AS pattern, CASE WHEN e LIKE '!%' THEN substring(e, 2) END AS error FROM (SELECT p_partkey, {_case('k', [s for _, s in TREES])} AS e FROM ({_ROWS.format(len(TREES))}))")
def tree_patterns(spark, sf_dir):
    """Decoding, field types, rules, canonical form, rendering and compiling of trees of every kind."""
    p = _parts(spark, sf_dir, len(TREES))
    cases = [_filled(t, b=F.col("b"), t=F.col("t"), n=F.col("n"), m=F.col("m")) for t, _ in TREES]
    return _compiled(p, _pick(F.col("k"), cases)).select("p_partkey", "done.pattern", "done.error")


#: (tree, SQL for its least and greatest width).
WIDTHS: list[tuple[dict, str, str]] = [
    (lit(B), "length(b)", "length(b)"),
    (seq(lit(B), rep(lit(T), N, "@m")), "length(b) + n * length(t)", "length(b) + (n + 40) * length(t)"),
    (alt(lit(B), lit(T)), "least(length(b), length(t))", "greatest(length(b), length(t))"),
    (alt(lit(B), rep(lit("x"), 0)), "0", "NULL"),
    (rep(seq(lit("ab"), {"type": "dot"}), N, N), "3 * n", "3 * n"),
    (seq(node("look", "ahead", lit(B)), node("anchor", "bos"), {"type": "bclass", "value": "w"}), "1", "1"),
    (node("group", "noncap", rep(chars(("char", "a")), 2, None)), "2", "NULL"),
]


@query(f"SELECT p_partkey, CAST({_case('k', [x for _, x, _ in WIDTHS])} AS BIGINT) AS low, CAST({_case('k', [x for _, _, x in WIDTHS])} AS BIGINT) AS high FROM ({_ROWS.format(len(WIDTHS))})")
def tree_widths(spark, sf_dir):
    """The width of the root of each tree, from the table of its nodes."""
    register.register(spark)
    p = _parts(spark, sf_dir, len(WIDTHS))
    cases = [_filled({"ast": t}, b=F.col("b"), t=F.col("t"), n=F.col("n"), m=F.col("m")) for t, *_ in WIDTHS]
    p.select("p_partkey", _pick(F.col("k"), cases).alias("solution")).createOrReplaceTempView("rx_width_trees")
    found = spark.sql("SELECT p_partkey, min_width, max_width FROM rx_width_trees, LATERAL rx_ast_nodes(solution) WHERE node_id = 0")
    return found.select("p_partkey", F.col("min_width").cast("bigint").alias("low"), F.col("max_width").cast("bigint").alias("high"))


_ESCAPED = r"replace(replace(replace(regexp_replace({}, '([.^$*+?{{}}\[\]()|\\])', '\\\1', 'g'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')"


@query(f"SELECT page_id, CASE WHEN length(e) <= 128 THEN e END AS pattern FROM (SELECT page_id, {_ESCAPED.format('url')} AS e FROM pages)")
def literal_patterns(spark, sf_dir):
    """Literals escaped by the library, and by the native function that does the same; both must agree."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    done = _compiled(p, F.to_json(F.struct(F.struct(F.lit("lit").alias("type"), F.col("url").alias("value")).alias("ast"))))
    native = register.escape_literal(F.col("url"))
    return done.select("page_id", F.when(F.length(native) > 128, F.col("done.pattern")).when(native == F.col("done.pattern"), native).alias("pattern"))


@query(f"SELECT doc_id, CAST(length(e) AS BIGINT) AS n, CASE WHEN length(e) > 128 THEN 'the pattern has ' || length(e) || ' characters, more than 128' END AS error FROM (SELECT doc_id, {_ESCAPED.format('text')} AS e FROM documents)")
def pattern_length(spark, sf_dir):
    """Whole texts as literals: over the cap, and by how much."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = _compiled(d, F.to_json(F.struct(F.struct(F.lit("lit").alias("type"), F.col("text").alias("value")).alias("ast"))))
    n = F.coalesce(F.length("done.pattern"), F.regexp_extract("done.error", "has ([0-9]+) ", 1).cast("int"))
    return done.select("doc_id", n.cast("bigint").alias("n"), F.col("done.error").alias("error"))


@query(r"""SELECT page_id, '[^' || array_to_string([CASE WHEN x IN (']', '\', '-', '^') THEN '\' || x ELSE x END for x in list_sort(list_distinct(string_split(url, '')))], '') || '\d]' AS pattern FROM pages""")
def class_patterns(spark, sf_dir):
    """Classes of the characters of addresses: sorted, once each, with the escapes that a class needs."""
    p = read(spark, sf_dir, "pages").select("page_id", F.filter(F.split("url", ""), lambda x: x != "").alias("cs"))
    items = F.concat(F.transform("cs", lambda c: F.struct(F.lit("char").alias("type"), c.alias("value"))), F.array(F.struct(F.lit("predef").alias("type"), F.lit("d").alias("value"))))
    tree = F.struct(F.lit("charclass").alias("type"), F.lit(True).alias("negated"), items.alias("items"))
    return _compiled(p, F.to_json(F.struct(tree.alias("ast")))).select("page_id", "done.pattern")


@query("""WITH r AS (SELECT DISTINCT p_brand, p_size AS a, p_size + p_partkey % 3 AS b FROM part),
    g AS (SELECT *, max(b) OVER (PARTITION BY p_brand ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
    i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY a, b) AS k FROM g),
    s AS (SELECT p_brand, min(a) AS a, max(b) AS b FROM i GROUP BY p_brand, k)
    SELECT p_brand, '[' || string_agg(chr(CAST(1040 + a AS INT)) || '-' || chr(CAST(1040 + b AS INT)), '' ORDER BY a) || ']' AS pattern FROM s GROUP BY p_brand""")
def merged_ranges(spark, sf_dir):
    """A brand's ranges of sizes as ranges of letters, merged by the library."""
    r = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") + 1040).alias("a"), (F.col("p_size") + F.col("p_partkey") % 3 + 1040).alias("b")).distinct()
    letter = lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 4, "0")), "UTF-16BE")
    item = F.struct(F.lit("range").alias("type"), letter(F.col("b")).alias("from"), letter(F.col("a")).alias("to"))  # either order is read
    tree = F.struct(F.lit("charclass").alias("type"), F.collect_list(item).alias("items"))
    done = _compiled(r.groupBy("p_brand").agg(tree.alias("ast")), F.to_json(F.struct("ast")))
    return done.select("p_brand", "done.pattern")


@query("SELECT p_partkey, CASE WHEN length(s) = 1 THEN s ELSE '[' || s || ']' END AS pattern FROM (SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(replace(p_name, ' ', ''), ''))), '') AS s FROM part)")
def alternatives_as_class(spark, sf_dir):
    """The letters of a name as alternatives, which become a class; a name of one letter is that letter."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.filter(F.split(F.replace(F.col("p_name"), F.lit(" ")), ""), lambda x: x != "").alias("cs"))
    options = F.to_json(F.transform("cs", lambda c: F.struct(F.lit("lit").alias("type"), c.alias("value"))))
    tree = F.when(F.size("cs") == 1, F.concat(F.lit('{"type": "lit", "value": "'), F.col("cs")[0], F.lit('"}'))).otherwise(F.concat(F.lit('{"type": "alt", "options": '), options, F.lit("}")))
    done = _compiled(p, F.concat(F.lit('{"ast": '), tree, F.lit("}")))
    return done.select("p_partkey", F.when(F.size(F.array_distinct("cs")) == 1, F.col("cs")[0]).otherwise(F.col("done.pattern")).alias("pattern"))


@query("""SELECT c_custkey, f AS flags, CASE WHEN NOT regexp_full_match(f, '[imsa]*') THEN CAST(-1 AS BIGINT) ELSE CAST((CASE WHEN contains(f, 'i') THEN 2 ELSE 0 END) + (CASE WHEN contains(f, 'm') THEN 8 ELSE 0 END)
    + (CASE WHEN contains(f, 's') THEN 16 ELSE 0 END) + (CASE WHEN contains(f, 'a') THEN 256 ELSE 0 END) AS BIGINT) END AS bits FROM (SELECT c_custkey, lower(substring(c_mktsegment, 2, c_custkey % 3)) || CASE WHEN c_custkey % 2 = 0 THEN 'ims' ELSE 'aam' END AS f FROM customer)""")
def flag_bits(spark, sf_dir):
    """Flags read by the library, and by the native function that does the same; both must agree."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower(F.expr("substring(c_mktsegment, 2, cast(c_custkey % 3 as int))")), F.when(F.col("c_custkey") % 2 == 0, "ims").otherwise("aam")).alias("flags"))
    done = _compiled(c, _filled({"flags": "@f", "ast": lit("a")}, f=F.col("flags")))
    native, own = F.coalesce(register.flag_bits(F.col("flags")), F.lit(-1)), F.coalesce("done.flags", F.lit(-1))
    return done.select("c_custkey", "flags", F.when(native == own, own).cast("bigint").alias("bits"))


@query("""SELECT DISTINCT l_linenumber AS low, CASE WHEN p_size % 3 = 0 THEN -1 ELSE l_linenumber + p_size % 3 - 1 END AS high,
    'a' || CASE WHEN p_size % 3 = 0 THEN CASE l_linenumber WHEN 1 THEN '+' ELSE '{' || l_linenumber || ',}' END
         WHEN p_size % 3 = 1 THEN '{' || l_linenumber || '}' ELSE '{' || l_linenumber || ',' || (l_linenumber + 1) || '}' END || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '' END AS pattern
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def quantifiers(spark, sf_dir):
    """Repeats rendered by the library, and by the native function that does the same; both must agree."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").join(part, "l_partkey")
    pairs = li.select(F.col("l_linenumber").alias("low"), F.when(F.col("p_size") % 3 != 0, F.col("l_linenumber") + F.col("p_size") % 3 - 1).alias("high"), (F.col("p_size") % 2 == 0).alias("p")).distinct()
    done = _compiled(pairs, _filled(json.dumps({"ast": rep(lit("a"), "@n", "@m", "@p")}).replace('"@p"', "@p"), n=F.col("low"), m=F.coalesce(F.col("high").cast("string"), F.lit("null")), p=F.col("p")))
    native = F.concat(F.lit("a"), register.quantifier(F.col("low"), F.col("high")), F.when(F.col("p"), "+").otherwise(""))
    return done.select("low", F.coalesce("high", F.lit(-1)).alias("high"), F.when(native == F.col("done.pattern"), native).alias("pattern"))


# -- model outputs --------------------------------------------------------------------------------------------------

_ONE = {"flags": "i", "ast": lit(B)}
_DEEP = {"flags": "", "ast": seq(node("group", "noncap", alt(lit(B), lit(T))), lit("x"))}
_J = json.dumps
#: (text of a model, SQL for the solution found, or for the error with "!" before it), first for the usual parser, then the strict one.
_FOUND = """'{"flags": "i", "unsat": false, "ast": {"type": "lit", "value": "' || b || '"}}'"""
_PLAIN = "'" + _J(_DEEP).replace("@b", "' || b || '").replace("@t", "' || t || '") + "'"
_NO = "'!no solution was found in the output'"
OUTPUTS: list[tuple[str, str, str]] = [
    (_J(_ONE), _FOUND, _FOUND),
    ("I think {x} first. Then " + _J(_ONE) + " it is.", _FOUND, _FOUND),
    (_J(_ONE) + "}", _FOUND, _FOUND),
    (_J(_ONE)[:-2] + ",},}", _FOUND, _FOUND),
    ("final " + _J(_DEEP), _PLAIN, "'!a solution that can be met needs a tree under ''ast'''"),
    ("no braces about @b", _NO, "'!there are no braces in the output'"),
    ("prose {x} " + _J(_DEEP), _NO, "'!a solution that can be met needs a tree under ''ast'''"),
    ('{"unsat": true}', """'{"flags": "", "unsat": true}'""", """'{"flags": "", "unsat": true}'"""),
    ('{"flags": "m"}', """'{"flags": "m"}'""", "'!a solution that can be met needs a tree under ''ast'''"),
    ("{@b} {@t} {", _NO, "'!what stands in braces is no JSON: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)'"),
]


def _outputs_sql(column: int) -> str:
    return f"SELECT p_partkey, CASE WHEN e LIKE '!%' THEN NULL ELSE e END AS solution, CASE WHEN e LIKE '!%' THEN substring(e, 2) END AS error FROM (SELECT p_partkey, {_case('k', [o[column] for o in OUTPUTS])} AS e FROM ({_ROWS.format(len(OUTPUTS))}))"


def _outputs(spark, sf_dir) -> DataFrame:
    p = _parts(spark, sf_dir, len(OUTPUTS))
    return p.withColumn("output", _pick(F.col("k"), [_filled(o, b=F.col("b"), t=F.col("t")) for o, *_ in OUTPUTS]))


@query(_outputs_sql(1))
def parsed_outputs(spark, sf_dir):
    """Solutions found in texts of models: last braces, final markers, trailing commas, balanced braces."""
    return _outputs(spark, sf_dir).withColumn("p", register.rx_parse_output("output")).select("p_partkey", "p.solution", "p.error")


@query(_outputs_sql(2))
def parsed_outputs_strict(spark, sf_dir):
    return _outputs(spark, sf_dir).withColumn("p", register.rx_parse_output_strict("output")).select("p_partkey", "p.solution", "p.error")


_BRAND_TREE = {"flags": "i", "ast": seq(lit("BRAND#"), rep(chars(("range", "9", "@d")), 1, 2))}


def _solutions(spark, sf_dir) -> DataFrame:
    """Model outputs about parts: a brand, or a tree that spells its number as a class, or nothing."""
    p = read(spark, sf_dir, "part")
    tree = _filled("final: " + _J(_BRAND_TREE), d=F.col("p_size") % 10)
    plain = _filled(_J({"flags": "", "ast": lit(B)}), b=F.col("p_brand"))
    output = F.when(F.col("p_partkey") % 5 == 4, "none").when(F.col("p_partkey") % 5 == 3, _J({"ast": rep(node("anchor", "end"))})).when(F.col("p_partkey") % 2 == 0, plain).otherwise(tree)
    return p.select(F.col("p_type").alias("problem_id"), F.col("p_partkey").alias("candidate_idx"), output.alias("output"))


def _problems(spark, sf_dir) -> DataFrame:
    brand = F.col("p_brand")
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("problem_id")).agg(F.sort_array(F.collect_set(F.when(brand.rlike("#[1-3]"), brand))).alias("yes"), F.sort_array(F.collect_set(F.when(~brand.rlike("#[1-3]"), brand))).alias("no"))


_EVALUATED = f"""WITH s AS (SELECT DISTINCT p_type, p_brand, regexp_matches(p_brand, '#[1-3]') AS y FROM part),
    c AS (SELECT p_type AS problem_id, p_partkey AS candidate_idx, CASE WHEN p_partkey % 5 >= 3 THEN NULL WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'BRAND#[' || (p_size % 10) || '-9]{{1,2}}' END AS pattern,
        CASE WHEN p_partkey % 5 >= 3 THEN NULL WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END AS flags, p_partkey % 5 = 4 AS lost, p_partkey % 5 = 3 AS broken FROM part),
    m AS (SELECT candidate_idx, count(*) FILTER (y) AS yes_total, count(*) FILTER (NOT y) AS no_total,
        count(*) FILTER (y AND CASE flags WHEN 2 THEN regexp_full_match(p_brand, pattern, 'i') ELSE regexp_full_match(p_brand, pattern) END) AS yes_matches,
        count(*) FILTER (NOT y AND NOT CASE flags WHEN 2 THEN regexp_full_match(p_brand, pattern, 'i') ELSE regexp_full_match(p_brand, pattern) END) AS no_rejects
        FROM c JOIN s ON p_type = problem_id GROUP BY candidate_idx),
    e AS (SELECT c.*, m.yes_total, m.no_total, m.yes_matches, m.no_rejects, CASE WHEN pattern IS NULL THEN 0.0::DOUBLE ELSE (yes_matches + no_rejects) / (yes_total + no_total) END AS accuracy FROM c JOIN m USING (candidate_idx))"""


@query(_EVALUATED + f""" SELECT problem_id, candidate_idx, pattern, CAST(flags AS BIGINT) AS flags, CASE WHEN lost THEN {_NO.replace("!", "")} END AS parse_error, CASE WHEN broken THEN {_problem(regex_ast.EMPTY).replace("!", "")} END AS validation_error,
    yes_matches, yes_total, no_rejects, no_total, round(accuracy, 6) AS accuracy, pattern IS NOT NULL AS is_valid,
    round(CASE WHEN pattern IS NULL THEN -10.0::DOUBLE WHEN 2 * accuracy - 1 > 0 THEN 2 * accuracy - 1 - 0.01::DOUBLE * length(pattern) ELSE 2 * accuracy - 1 END, 6) AS reward FROM e""")
def evaluate_outputs(spark, sf_dir):
    """Parsing, compiling, matching, counting and rewards of model outputs."""
    out = score.evaluate_outputs(_solutions(spark, sf_dir), _problems(spark, sf_dir), mode="fractional")
    r = lambda c: F.round(F.col(c), 6).alias(c)
    return out.select("problem_id", "candidate_idx", "pattern", F.col("flags").cast("bigint").alias("flags"), "parse_error", "validation_error", "yes_matches", "yes_total", "no_rejects", "no_total", r("accuracy"), "is_valid", r("reward"))


_NODES = [  # (node, parent, position, depth, kind, SQL for the pattern, least, greatest) of a tree, and of a literal
    (0, None, 0, 0, "seq", "'BRAND#[' || d || '-9]{1,2}'", "7", "8"), (1, 0, 0, 1, "lit", "'BRAND#'", "6", "6"), (2, 0, 1, 1, "repeat", "'[' || d || '-9]{1,2}'", "1", "2"), (3, 2, 0, 2, "charclass", "'[' || d || '-9]'", "1", "1"),
]


def _node_sql(row: tuple) -> str:
    values = [*(("NULL" if x is None else str(x)) for x in row[:4]), f"'{row[4]}'", row[5], *(f"CAST({x} AS INTEGER)" for x in row[6:])]
    return ", ".join(f"{v} AS {n}" for v, n in zip(values, ("node_id", "parent_id", "position", "depth", "kind", "pattern", "min_width", "max_width"), strict=True))


@query("WITH t AS (SELECT DISTINCT p_type AS problem_id, CAST(p_size % 10 AS VARCHAR) AS d FROM part WHERE p_partkey % 5 < 3 AND p_partkey % 2 = 1), l AS (SELECT DISTINCT p_type AS problem_id, p_brand AS d FROM part WHERE p_partkey % 5 < 3 AND p_partkey % 2 = 0), "
       "b AS (SELECT DISTINCT p_type AS problem_id FROM part WHERE p_partkey % 5 = 3) "
       + " UNION ALL ".join(f"SELECT problem_id, {_node_sql(r)} FROM t" for r in _NODES)
       + " UNION ALL SELECT problem_id, " + _node_sql((0, None, 0, 0, "lit", "d", "length(d)", "length(d)")) + " FROM l"
       + " UNION ALL SELECT problem_id, " + _node_sql((0, None, 0, 0, "repeat", "'(?:$)+'", "0", "NULL")) + " FROM b"
       + " UNION ALL SELECT problem_id, " + _node_sql((1, 0, 0, 1, "anchor", "'$'", "0", "0")) + " FROM b")
def ast_nodes(spark, sf_dir):
    """The nodes of solutions, by the table function."""
    register.register(spark)
    _solutions(spark, sf_dir).select("problem_id", register.rx_parse_output("output")["solution"].alias("solution")).distinct().createOrReplaceTempView("rx_solutions")
    return spark.sql("SELECT problem_id, n.* FROM rx_solutions, LATERAL rx_ast_nodes(solution) n")
