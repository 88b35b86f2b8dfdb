"""Queries that write files into the shared folder and read them back through the library's sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matching, prompts
from ..operators import validate
from ..sources import ingest, shared, sinks
from .registry import query, read


def _json_files(spark, sf_dir) -> str:
    """A folder with a file for each region: a list of entries of its nations between things that are no entries; a lone entry; broken
    JSON; JSON that only Python reads; and one below temp_results."""
    name = F.col("n_name")
    one = F.concat(F.lit('{"expr": "NATION_[0-9]*'), F.col("n_nationkey") % 3, F.lit('", "yes": ["'), name, F.lit('", 5, "x"], "no": ["'), name, F.lit('", null]}'))
    nations = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", one.alias("entry"))
    lists = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "entry")))["entry"].alias("entries"), F.min("n_nationkey").alias("first"))
    r = F.col("n_regionkey")
    value = (
        F.when(r == 1, F.col("entries")[0]).when(r == 2, "{").when(r == 3, F.concat(F.lit('[{"expr": "q", "expr": "NATION_.*", "yes": ["x", "NATION_"], "no": [NaN]}]')))
        .otherwise(F.concat(F.lit("[7, "), F.array_join("entries", ", "), F.lit(', "s", [1]]')))
    )
    path = shared.fresh(spark, "json")
    files = lists.select(F.concat_ws("", F.lit("region"), r.cast("string")).alias("dir"), value.alias("value"))
    files.union(lists.where("n_regionkey = 0").select(F.lit("temp_results"), F.lit("[]"))).repartition(1).write.partitionBy("dir").text(path)
    return path


def _region(df: DataFrame) -> DataFrame:
    return df.withColumn("region", F.regexp_extract("path", "dir=region([0-9]+)", 1).cast("int")).drop("path", "file")


_ENTRIES = """WITH n AS (SELECT n_regionkey AS region, n_nationkey AS k, n_name AS s, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
    e AS (SELECT region, CAST(CASE region WHEN 1 THEN 0 ELSE i END AS BIGINT) AS entry_idx, 'NATION_[0-9]*' || (k % 3) AS expr, s, k FROM n WHERE region NOT IN (2, 3) AND (region <> 1 OR i = 1))"""


@query(_ENTRIES + """ SELECT region, entry_idx, expr, s || ',?,x' AS yes, s || ',?' AS no, true AS has_lists FROM e
    UNION ALL SELECT 3, 0, 'NATION_.*', 'x,NATION_', '?', true""")
def scanned_entries(spark, sf_dir):
    """Entries of scanned files: roots that are lists or objects, other elements skipped, non-strings null, repeated keys, no
    checkpoint folders."""
    found = _region(ingest.entries(ingest.scan(spark, _json_files(spark, sf_dir), pattern="*.txt")))
    shown = lambda c: F.array_join(c, ",", "?").alias(c)
    return found.select("region", F.col("entry_idx").cast("bigint").alias("entry_idx"), "expr", shown("yes"), shown("no"), "has_lists")


@query("SELECT r_regionkey AS region, CASE r_regionkey WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS entries, r_regionkey = 2 AS unreadable FROM region")
def scanned_files(spark, sf_dir):
    """Entries of each file, and the files that are no JSON."""
    files = ingest.scan(spark, _json_files(spark, sf_dir), pattern="*.txt")
    counts = _region(ingest.count_entries(files, ingest.entries(files)))
    bad = _region(ingest.unreadable(files)).withColumn("bad", F.lit(True))
    return counts.join(bad, "region", "left").select("region", "entries", F.coalesce("bad", F.lit(False)).alias("unreadable"))


@query(_ENTRIES + """ SELECT region, entry_idx, CASE WHEN regexp_full_match(s, expr) THEN s ELSE '' END AS yes, CASE WHEN regexp_full_match(s, expr) THEN '' ELSE s END AS no,
    CAST(3 AS BIGINT) AS original_yes, CAST(CASE WHEN regexp_full_match(s, expr) THEN 2 ELSE 3 END AS BIGINT) AS removed_yes, CAST(CASE WHEN regexp_full_match(s, expr) THEN 2 ELSE 1 END AS BIGINT) AS removed_no FROM e
    UNION ALL SELECT 3, 0, 'NATION_', '', 2, 1, 1""")
def cleaned_files(spark, sf_dir):
    """Scanned entries, validated, written as a cleaned dataset and read again."""
    valid = validate.validate(ingest.entries(ingest.scan(spark, _json_files(spark, sf_dir), pattern="*.txt")), seconds=5.0)
    path = shared.fresh(spark, "cleaned")
    sinks.write_entries(valid, path)
    kind = "entry_idx int, path string, file string, yes array<string>, no array<string>, original_yes long, removed_yes long, removed_no long"
    back = _region(spark.read.schema(kind).json(path).drop("source"))
    return back.select("region", F.col("entry_idx").cast("bigint").alias("entry_idx"), F.array_join("yes", ",").alias("yes"), F.array_join("no", ",").alias("no"), "original_yes", "removed_yes", "removed_no")


@query("""SELECT source AS path, count(*) AS entries, round(count(*) FILTER (regexp_full_match(lang, '[de][a-z]')) / count(*), 6) AS yes_accuracy FROM documents GROUP BY source""")
def written_stats(spark, sf_dir):
    """Statistics by file as one JSON object keyed by file, read again."""
    one = F.lit(1).cast("bigint")
    e = read(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.lit("[de][a-z]").alias("expr"), F.array("lang").alias("yes"), F.array().cast("array<string>").alias("no"))
    path = shared.fresh(spark, "stats")
    sinks.write_stats(validate.by_file(validate.validate(e)), path, single=True)
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<entries: bigint, original_yes: bigint, yes_accuracy: double>>")))
    return back.where(F.col("value.original_yes") >= one).select(F.col("key").alias("path"), "value.entries", F.round("value.yes_accuracy", 6).alias("yes_accuracy"))


@query("SELECT source AS path, '[' || string_agg('{\"expr\":\"' || lang || '\",\"yes\":[],\"no\":[\"' || doc_id || '\"]}', ',' ORDER BY doc_id) || ']' AS json FROM documents GROUP BY source")
def entries_as_array(spark, sf_dir):
    """A file's entries as one JSON array, in order: each document's language and number."""
    d = read(spark, sf_dir, "documents")
    e = d.select(F.col("source").alias("path"), F.col("doc_id").alias("entry_idx"), F.col("lang").alias("expr"), F.array(F.lit("0")).alias("yes"), F.array(F.col("doc_id").cast("string")).alias("no"))
    return sinks.as_array(validate.validate(e))


@query("SELECT o_orderkey AS \"index\", o_orderpriority AS result, o_orderkey % 3 = 0 AS early FROM orders")
def keyed_results(spark, sf_dir):
    """Results stored by key in two runs, of which the second brings keys that are stored already; then merged in order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("result"))
    path, merged = shared.fresh(spark, "keyed"), shared.fresh(spark, "merged")
    sinks.upsert(o.where("index % 3 = 0").withColumn("early", F.lit(True)), path)
    sinks.upsert(o.unionAll(o.where("index % 7 = 0")).withColumn("early", F.lit(False)), path)
    return sinks.merge(sinks.stored(spark, path), merged).select("index", "result", "early")


@query("SELECT o_orderkey AS \"index\" FROM orders WHERE o_orderkey <= 100")
def second_snapshot(spark, sf_dir):
    """The results up to the second snapshot after the first: those of indices up to 100, of 50 each."""
    path = shared.fresh(spark, "snapshots")
    sinks.write_snapshots(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index")), path)
    return sinks.read_snapshot(spark, path, 2)


@query("SELECT doc_id, lang, CAST(NOT contains(source, '1') AS BOOLEAN) AS done FROM documents")
def resume_merge(spark, sf_dir):
    """What one run stored, and the pending rest that the next one adds, merged."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    path, merged = shared.fresh(spark, "resumed"), shared.fresh(spark, "merged")
    sinks.upsert(d.where("not contains(source, '1')").select("doc_id", "lang", F.lit(True).alias("done")), path, "doc_id")
    rest = sinks.pending(d, sinks.stored(spark, path), "doc_id")
    sinks.upsert(rest.select("doc_id", "lang", F.lit(False).alias("done")), path, "doc_id")
    return sinks.merge(sinks.stored(spark, path), merged, "doc_id").select("doc_id", "lang", "done")


@query("""SELECT CAST(2 * (row_number() OVER (ORDER BY n_nationkey)) + 1 AS BIGINT) AS line, CASE n_nationkey % 2 WHEN 0 THEN n_name || '/+' ELSE 'a' || n_name END AS regex, CASE n_nationkey % 2 WHEN 0 THEN 'im' ELSE '' END AS flags,
    'Regex puzzle from line ' || (2 * (row_number() OVER (ORDER BY n_nationkey)) + 1) || CASE n_nationkey % 2 WHEN 0 THEN ' with flags: im' ELSE '' END AS description FROM nation""")
def puzzle_seeds(spark, sf_dir):
    """Seeds from a file of puzzle lines: comments and blank lines skipped, lines numbered, patterns up to the last slash."""
    path = shared.fresh(spark, "puzzles")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  /"), "n_name", F.lit("/+/im"))).otherwise(F.concat(F.lit("a"), "n_name", F.lit("\t")))
    lines = read(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n# again\n").alias("rest"))
    lines.select(F.concat(F.lit("# puzzles\n\n"), "rest").alias("value")).coalesce(1).write.text(path)
    found = ingest.puzzle_seeds(spark, path)
    return found.select(F.col("line").cast("bigint").alias("line"), "regex", "flags", "description")


@query("""SELECT lang AS regex, CASE WHEN doc_id % 4 = 1 THEN source ELSE 'No description provided' END AS description, count(*) AS seeds, CAST(sum(len([x for x in string_split(text, chr(10)) if trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''])) AS BIGINT) AS examples
    FROM documents WHERE doc_id % 3 > 0 GROUP BY ALL""")
def hub_seeds(spark, sf_dir):
    """Seeds from a table: rows without a pattern skipped, default descriptions, trimmed examples."""
    d = read(spark, sf_dir, "documents")
    table = d.select(F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise(F.when(F.col("doc_id") % 2 == 0, "")).alias("regex"), "text", F.when(F.col("doc_id") % 4 == 1, F.col("source")).alias("description"))
    return ingest.hub_seeds(table).groupBy("regex", "description").agg(F.count("*").alias("seeds"), F.sum(F.size("examples")).cast("bigint").alias("examples"))


@query("""SELECT n_nationkey, 'Find strings for ' || n_name || '.' || chr(10) || chr(10) || 'Examples:' || chr(10) || '1. `' || n_regionkey || '`' AS prompt, 'fnfe' AS missing FROM nation""")
def prompt_from_template(spark, sf_dir):
    """Prompts from a template file; a template that isn't there has a fixed text."""
    path = shared.fresh(spark, "prompt")
    spark.range(1).select(F.lit("Find strings for {pattern}.").alias("value")).coalesce(1).write.option("lineSep", "~").text(path)
    template = ingest.prompt_template(path, spark).rstrip("~")
    missing = ingest.prompt_template(f"{path}-none", spark)
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", prompts.generation(template, F.col("n_name"), F.array(F.col("n_regionkey").cast("string"))).alias("prompt"), F.lit(missing).alias("missing"))


# -- patterns and entries -------------------------------------------------------------------------------------------

_PATTERNS = ["(", "a{2,1}", "[z-a]", "(?P<n>x", "a+b", "(a|b)*c", "[0-9]{2}", "(?<=a+)b"]


@query("SELECT p_partkey, ['(', 'a{2,1}', '[z-a]', '(?P<n>x', 'a+b', '(a|b)*c', '[0-9]{2}', '(?<=a+)b'][1 + p_partkey % 8] || p_brand AS expr, p_partkey % 8 IN (4, 5, 6) AS compiles FROM part")
def compile_check(spark, sf_dir):
    """Whether Python compiles a pattern."""
    pattern = F.concat(F.array(*map(F.lit, _PATTERNS))[(F.col("p_partkey") % 8).cast("int")], F.col("p_brand"))
    p = read(spark, sf_dir, "part").select("p_partkey", pattern.alias("expr"))
    return p.select("p_partkey", "expr", matching.classify(F.col("expr"))["error"].isNull().alias("compiles"))


_WORDS = r"[^\x20\x09-\x0D]+"


@query(f"""WITH w AS (SELECT source AS path, doc_id AS entry_idx, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS l FROM documents),
    s AS (SELECT path, entry_idx, [x for x in l if regexp_matches(x, '^[A-Z]')] AS yes, [x for x in l if NOT regexp_matches(x, '^[A-Z]')] AS no FROM w),
    k AS (SELECT *, [x for x in yes if regexp_full_match(x, '[A-Z][a-z]*')] AS good, [x for x in no if NOT regexp_full_match(x, '[A-Z][a-z]*')] AS bad FROM s)
    SELECT path, entry_idx, len(yes) AS original_yes, len(good) AS kept_yes, len(no) AS original_no, len(bad) AS kept_no, len(yes) - len(good) AS removed_yes, md5(array_to_string(good, ' ')) AS yes_md5,
    round(CASE WHEN len(yes) + len(no) = 0 THEN 1.0::DOUBLE ELSE (len(good) + len(bad)) / (len(yes) + len(no)) END, 6) AS total_accuracy FROM k""")
def validate_entries(spark, sf_dir):
    """Each document as an entry of the file of its source: its words with a capital should match, the others should not.  Half of
    the patterns are of the kind that only Python reads."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({_WORDS})"))
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("entry_idx"), words.alias("l"))
    pattern = F.when(F.col("entry_idx") % 2 == 0, r"(?P<first>[A-Z])[a-z]*").otherwise(r"[A-Z][a-z]*")
    e = d.select("path", "entry_idx", pattern.alias("expr"), F.filter("l", lambda x: x.rlike("^[A-Z]")).alias("yes"), F.filter("l", lambda x: ~x.rlike("^[A-Z]")).alias("no"))
    v = validate.validate(e, seconds=10.0)
    return v.select("path", "entry_idx", "original_yes", "kept_yes", "original_no", "kept_no", "removed_yes", F.md5(F.array_join("yes", " ").cast("binary")).alias("yes_md5"), F.round("total_accuracy", 6).alias("total_accuracy"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 < 2 THEN 'Timeout after 0.5s' WHEN n_nationkey % 5 = 2 THEN 'bad' END AS error, CAST(CASE WHEN n_nationkey % 5 > 2 THEN 2 ELSE 0 END AS BIGINT) AS kept_yes,
    CAST(CASE WHEN n_nationkey % 5 > 2 THEN 1 ELSE 0 END AS BIGINT) AS kept_no, CAST(CASE WHEN n_nationkey % 5 > 2 THEN 1 ELSE 3 END AS BIGINT) AS removed_yes FROM nation""")
def time_limits(spark, sf_dir):
    """Patterns that would run for ages fail their entry after one limit for all its strings, in either engine; bad ones fail at
    once."""
    k = F.col("n_nationkey") % 5
    pattern = F.when(k == 0, "(a+)+$").when(k == 1, "a*a*a*a*a*a*a*a*b").when(k == 2, "[").when(k == 3, "(?P<n>NATION)_[0-9]+|a").otherwise("NATION_[0-9]+|a")
    long = F.lit("a" * 700 + "c")
    e = read(spark, sf_dir, "nation").select("n_nationkey", pattern.alias("expr"), F.array(F.col("n_name"), F.lit("a"), long).alias("yes"), F.array(F.lit("a"), long).alias("no"))
    v = validate.validate(e, seconds=0.5)
    error = F.when(F.col("validation_error").startswith("Timeout"), F.col("validation_error")).when(F.col("validation_error").isNotNull(), "bad")
    return v.select("n_nationkey", error.alias("error"), "kept_yes", "kept_no", "removed_yes")


@query("""WITH s AS (SELECT *, ['[a-z ]+', '[a-z ]*o[a-z ]*', 'cold.*'][1 + p_partkey % 3] AS p FROM part)
    SELECT p_partkey, regexp_full_match(p_name, p) AS matched FROM s""")
def matches_by_pattern(spark, sf_dir):
    """A pattern for each row; those of every third row are of the kind that only Python reads."""
    pattern = F.array(F.lit("[a-z ]+"), F.lit("(?P<n>[a-z ]*)o[a-z ]*"), F.lit("cold.*"))[(F.col("p_partkey") % 3).cast("int")]
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", pattern.alias("expr"))
    return matching.full_match(p, text="p_name").select("p_partkey", "matched")
