import json
import os
import re

import pytest
from pyspark.sql import functions as F

from rxspark.functions import matching, prompts, register
from rxspark.operators import score, validate
from rxspark.sources import ingest, sinks
from rxspark.streaming import incremental


def test_matching_agrees_with_python(spark):
    patterns = [r"a+b", r"\d+", r"[a-z]+\s?x", r"(?P<n>a)b", r"[[a]", r"a{2", r"(a|b)*", r"(?:a|b)*+", r"a\Z", "a$", r"\w+", r"(?=a)a.", r"(a)\1", "[", r"[\w-]+", "(?i)AB", r"x{2,}?y", ".", r"[a&&b]", r"\bfoo\b", "é+"]
    strings = ["", "ab", "aab", "12", "٣", "é", "abc x", "aa", "a\n", "a", "[", "xxy", "foo", "\r", "a&", "AB", "a{2", " ", "b" * 3000, None]
    rows = [(p, s) for p in patterns for s in strings] + [(None, "a")]
    found = matching.full_match(spark.createDataFrame(rows, "expr string, s string")).collect()
    assert len(found) == len(rows)
    for r in found:
        good, _ = matching.compiled(r.expr) if r.expr is not None else (None, 1)
        expected = None if good is None or r.s is None else bool(good.fullmatch(r.s))
        assert r.matched == expected, (r.expr, r.s)
        assert (r.match_error is not None) == (good is None)


def test_native_patterns_are_found():
    native = [p for p in (r"a+b", r"[a-z]+\d", r"(?:ab)+", r"\.x?", "a{2,3}") if matching.to_java(p)]
    assert len(native) == 5
    assert not any(map(matching.to_java, (r"(a|b)*", r"(a+)+", r"[[a]", r"(?P<n>a)", "a{2", r"(a)\1", "(?i)a", "[a&&b]", "[")))


def test_time_limit(spark):
    rows = spark.createDataFrame([("(a+)+$", "a" * 40 + "b"), ("a", "a"), ("a*a*a*a*a*a*a*b", "a" * 400)], "expr string, s string")
    found = {r.expr: r for r in matching.full_match(rows, seconds=0.2).collect()}
    assert found["(a+)+$"].match_error == "Timeout after 0.2s" and found["a"].matched and found["a*a*a*a*a*a*a*b"].match_error == "Timeout after 0.2s"


def test_time_limit_of_an_entry(spark):
    """One limit for all strings of an entry, also where the JVM could take the pattern; each string alone is quick."""
    hard, slow = "(a+)+$", "a*a*a*a*a*a*a*b"
    rows = [(0, hard, ["a" * 19 + "b"] * 60, []), (1, slow, ["a" * 500], []), (2, "a+b", ["aab", "b"], ["a"]), (3, hard, ["aa"], ["b"]), (4, "x" * 3, None, None)]
    found = {r.i: r for r in validate.validate(spark.createDataFrame(rows, "i int, expr string, yes array<string>, no array<string>"), seconds=0.25).collect()}
    assert [found[i].validation_error for i in range(5)] == ["Timeout after 0.25s", "Timeout after 0.25s", None, None, None]
    assert found[0].yes == [] and found[0].removed_yes == 60 and found[2].yes == ["aab"] and found[3].no == ["b"] and found[4].original_yes == 0
    assert [matching.to_java(p)[3] for p in ("a{3}b{2,2}c", "a+b", "a++b*", "a*a*", "a{2,3}?b?")] == [0, 1, 1, 2, 2]


ENTRIES = [
    {"expr": r"^lot-\d+$", "yes": ["lot-4", "lot-", "lot-70", "q", "lot-31415", "lot-k"], "no": ["bin", "lot-", "lot-8", "88", "tray", "lot-90"]},
    {"expr": "[a-z]+", "yes": ["abc", "ABC", "xyz", "1", "a1"], "no": ["123", "abc", "ABC", "!@#", "zz"]},
    {"expr": "[invalid(regex", "yes": ["a"], "no": ["b", "c"]},
    {"expr": "test", "yes": [], "no": []},
    7,
    {"expr": "a", "yes": ["a", 5, None, {"k": 1}, "a"], "no": ["b", None]},
    {"yes": ["", "x"]},
]


@pytest.fixture
def folder(tmp_path):
    for name, content in (("one.json", json.dumps(ENTRIES)), ("sub/one.json", json.dumps(ENTRIES[1])), ("bad.json", "{"), ("temp_results/x.json", "[]"), ("twice.json", '[{"expr": "b", "expr": "a", "yes": ["a"], "no": [NaN]}]')):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content.replace("}, {", "},\n {"))
    return str(tmp_path)


def test_ingest_and_validate(spark, folder, tmp_path):
    files = ingest.scan(spark, folder)
    assert files.count() == 4 and ingest.scan(spark, folder, include_temp=True).count() == 5
    found = ingest.entries(files)
    assert {os.path.basename(r.path): r.entries for r in ingest.count_entries(files.where("path not like '%/sub/%'"), found).collect()} == {"one.json": 6, "bad.json": 0, "twice.json": 1}
    assert [r.file for r in ingest.unreadable(files).collect()] == ["bad.json"]
    valid = validate.validate(found).cache()
    rows = {(r.path.split("/")[-2] == "sub", r.file, r.entry_idx): r for r in valid.collect()}
    a, b, bad, empty, odd, missing = (rows[False, "one.json", i] for i in (0, 1, 2, 3, 5, 6))
    assert a.yes == ["lot-4", "lot-70", "lot-31415"] and a.no == ["bin", "lot-", "88", "tray"]
    assert b.yes == ["abc", "xyz"] and b.no == ["123", "ABC", "!@#"]
    assert bad.yes == [] and bad.no == [] and bad.validation_error and bad.removed_no == 2
    assert empty.total_accuracy == 1.0 and empty.validation_error is None
    assert odd.yes == ["a", "a"] and odd.original_yes == 5 and odd.no == ["b"] and odd.original_no == 2
    assert missing.expr == "" and missing.yes == [""] and missing.kept_no == 0
    assert rows[False, "twice.json", 0].expr == "a"
    stats = {r.path: r for r in validate.by_file(valid).collect()}
    assert len(stats) == 3 and sum(r.entries for r in stats.values()) == 8
    total = validate.overall(valid).where("path is null").first()
    assert total.removed_yes == sum(r.removed_yes for r in stats.values())
    assert validate.problem_entries(valid).count() == 7
    assert len(validate.worst_files(validate.by_file(valid), 2).collect()) == 2
    again = validate.validate(valid.where("validation_error is null").select("path", "file", "entry_idx", "expr", "yes", "no"))
    assert again.where("removed_yes + removed_no > 0").count() == 0
    sinks.write_entries(valid, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 8
    sinks.write_stats(validate.by_file(valid), str(tmp_path / "stats"), single=True)
    assert len(json.loads(spark.read.text(str(tmp_path / "stats")).first()[0])) == 3
    assert len(json.loads(sinks.as_array(valid).where("path like '%/sub/%'").first().json)) == 1
    assert ingest.entries(files).where("has_lists").count() == 7


def test_ratios(spark):
    row = validate.with_ratios(spark.createDataFrame([(8, 4, 2, 3), (0, 0, 0, 0)], "original_yes int, original_no int, kept_yes int, kept_no int")).collect()
    assert (row[0].yes_accuracy, row[0].no_accuracy, row[0].total_accuracy) == (0.25, 0.75, 5 / 12)
    assert (row[1].yes_accuracy, row[1].no_accuracy, row[1].total_accuracy) == (1.0, 1.0, 1.0)


def test_acceptance(spark):
    rows = [("a", ["xa"] * 5 + ["b"], ["b"]), ("a", ["b"], ["b"]), ("a", ["a"], []), ("[", ["a"], ["b"]), ("a", [], ["b"]), ("a", ["a"], ["a"] * 5 + ["b"])]
    e = spark.createDataFrame(rows, "expr string, yes array<string>, no array<string>")
    assert sorted(map(tuple, ((r.expr, tuple(r.yes)) for r in validate.accepted(e).collect()))) == [("a", ()), ("a", tuple(rows[0][1]))]
    assert validate.accepted(e.where("expr <> '['"), native=True).count() == 2


def _out(ast, flags=""):
    return json.dumps({"flags": flags, "unsat": False, "ast": ast})


def test_scoring(spark):
    lit = lambda x: {"type": "lit", "value": x}
    digits = {"type": "repeat", "min": 3, "max": 3, "child": {"type": "bclass", "value": "d"}}
    yep = {"type": "seq", "items": [{"type": "anchor", "kind": "start"}, {"type": "alt", "options": [lit("yes"), lit("yep")]}, {"type": "anchor", "kind": "end"}]}
    outputs = [(1, 0, _out({"type": "alt", "options": [lit("cat"), lit("dog")]}, "i")), (2, 0, _out({"type": "zzz"})), (3, 0, _out(digits)), (4, 0, _out(yep)), (4, 1, _out(lit("ye")) + "}"), (4, 2, "none"), (5, 0, '{"unsat": true}')]
    problems = [(1, ["cat", "DOG"], ["cow", "pig"]), (2, ["a"], ["b"]), (3, ["123", "456"], ["12", "abc"]), (4, ["yes", "yep"], ["no", "nope", "ye", "y", ""]), (5, ["a"], ["b"])]
    o, p = spark.createDataFrame(outputs, "problem_id int, candidate_idx int, output string"), spark.createDataFrame(problems, "problem_id int, yes array<string>, no array<string>")
    binary = {(r.problem_id, r.candidate_idx): r for r in score.evaluate_outputs(o, p).collect()}
    assert binary[1, 0].pattern == "cat|dog" and binary[1, 0].reward == pytest.approx(0.93)
    assert binary[2, 0].reward == -10 and binary[2, 0].validation_error.startswith("not a tree")
    assert binary[3, 0].pattern == r"\d{3}" and binary[3, 0].reward == pytest.approx(0.95)
    assert binary[5, 0].pattern == "" and binary[5, 0].accuracy == 0.5 and binary[5, 0].reward == -1
    scored = score.evaluate_outputs(o, p, mode="fractional").cache()
    four = {r.candidate_idx: r for r in scored.where("problem_id = 4").collect()}
    assert four[0].pattern == "^(?:yep|yes)$" and four[0].reward == pytest.approx(0.87)
    assert (four[1].yes_matches, four[1].no_rejects) == (0, 4) and four[1].reward == pytest.approx(2 * 4 / 7 - 1 - 0.02)
    assert four[2].parse_error and four[2].reward == -10
    stats = score.problem_stats(scored).where("problem_id = 4").first()
    assert (stats.n, stats.n_valid, stats.n_perfect) == (3, 2, 1) and stats.best_solution.candidate_idx == 0 and stats.best_reward == pytest.approx(0.87)
    assert score.problem_stats(scored).where("problem_id = 2").first().best_solution is None
    rates = score.outcome_rates(scored).first()
    assert rates.valid_rate == pytest.approx(5 / 7) and rates.parse_error_rate == pytest.approx(1 / 7) and rates.validation_error_rate == pytest.approx(1 / 7)
    z = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 2.0), (2, 2.0), (3, 5.0)], "b int, reward double")
    assert sorted(round(r.advantage, 6) for r in score.normalised(z, ["b"]).collect()) == [-1.224745, 0.0, 1.224745, 2.0, 2.0, 5.0]


def test_seeds_and_prompts(spark, tmp_path):
    (tmp_path / "puzzles").write_text("# comment\n/a\\/b+/i\n\nplain\n/x/\n")
    rows = ingest.puzzle_seeds(spark, str(tmp_path / "puzzles")).orderBy("line").collect()
    assert [(r.line, r.regex, r.flags) for r in rows] == [(2, "a\\/b+", "i"), (4, "plain", ""), (5, "x", "")]
    hub = spark.createDataFrame([("a", " x \n\ny", None), ("", "q", "d"), (None, "q", "d")], "regex string, text string, description string")
    got = ingest.hub_seeds(hub).collect()
    assert [(r.regex, r.description, r.examples) for r in got] == [("a", ingest.DEFAULT_DESCRIPTION, ["x", "y"])]
    assert ingest.prompt_template(str(tmp_path / "none")) == "fnfe"
    row = hub.limit(1).select(prompts.generation("P {pattern}", F.lit("z"), F.array(F.lit("u"), F.lit("v"))).alias("p"), prompts.solver("s", "d", F.array(F.lit('q"')), F.array().cast("array<string>")).alias("m"), prompts.json_slice(F.lit("a {b} c} d")).alias("j"), prompts.json_slice(F.lit("} {")).alias("none")).first()
    assert row.p == "P z\n\nExamples:\n1. `u`\n2. `v`" and row.m.endswith('{"yes": ["q\\""], "no": []}') and row.j == "{b} c}" and row.none is None


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("""SELECT rx_fullmatch('a+', 'aa') AS m, rx_fullmatch('[', 'a') AS n, rx_compile('{"ast": {"type": "lit", "value": "a."}}') AS c, rx_parse_output('x') AS p""").first()
    assert row.m and row.n is None and row.c.pattern == r"a\." and row.p.error
    assert spark.sql("""SELECT * FROM rx_ast_nodes('{"ast": {"type": "lit", "value": "a"}}')""").count() == 1
    out = spark.createDataFrame([("im",), ("",), ("x",), ("ii",)], "f string").select(register.flag_bits(F.col("f")).alias("b")).collect()
    assert [r.b for r in out] == [10, 0, None, 2]
    text = "a.b*c[\\]\t{x}"
    assert spark.range(1).select(register.escape_literal(F.lit(text)).alias("e")).first().e == "".join(re.escape(c) if c in ".^$*+?{}[]()|\\" else {"\t": "\\t"}.get(c, c) for c in text)


def test_incremental(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    run = lambda: incremental.validate_new_files(spark, folder, str(out / "target"), str(out / "checkpoint")).awaitTermination()
    run()
    assert spark.read.parquet(str(out / "target")).count() == 8
    with open(f"{folder}/new.json", "w") as f:
        json.dump(ENTRIES[0], f)
    run()
    assert spark.read.parquet(str(out / "target")).count() == 9


def test_keyed_results(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i, f"r{i}") for i in x], "index int, result string")
    path = str(tmp_path / "keyed")
    sinks.upsert(rows(1, 2, 2), path)
    sinks.upsert(rows(2, 3), path)
    assert [r["index"] for r in sinks.upsert(rows(1, 3), path).collect()] == [] and [r["index"] for r in sinks.upsert(rows(3, 9), path).collect()] == [9]
    merged = sinks.merge(sinks.stored(spark, path).where("index < 9"), str(tmp_path / "merged"))
    assert merged.columns == ["index", "result"]
    sinks.write_snapshots(rows(0, 1, 49, 50, 51, 120), str(tmp_path / "snapshots"))
    assert [sorted(r["index"] for r in sinks.read_snapshot(spark, str(tmp_path / "snapshots"), n).collect()) for n in (0, 1, 2, 9)] == [[0], [0, 1, 49, 50], [0, 1, 49, 50, 51], [0, 1, 49, 50, 51, 120]]
    assert sorted(r["index"] for r in merged.collect()) == [1, 2, 3]
    work = spark.createDataFrame([(1,), (4,)], "index int")
    assert [r["index"] for r in incremental.extract_responses(work, rows(1, 4), spark.read.parquet(path)).collect()] == [4]
