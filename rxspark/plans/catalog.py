"""Queries over the driver's tables, each with the SQL that gives the same rows.

Integers are cast to BIGINT and constants to DOUBLE on both sides; doubles are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching, prompts
from ..operators import score, validate
from ..sources import ingest
from . import files, trees  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES  # noqa: F401
from .registry import query as _query
from .registry import read as _read


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


#: Candidate patterns (index, pattern): ASCII only, and alike in all engines.
EVENT_PATTERNS = [(0, "p[a-z]+"), (1, "(purchase|signup)"), (2, "[a-z]*u[a-z]*"), (3, "purchase"), (4, "signup|purchase|click")]
PART_PATTERNS = [(0, "Brand#[1-3][0-9]*"), (1, "Brand#1[0-9]"), (2, "Brand#.*"), (3, "B.*1.*")]
_VALUES = lambda rows: ", ".join(f"({i}, '{p}')" for i, p in rows)


def _matched(strings: DataFrame, candidates: list[tuple[int, str]]) -> DataFrame:
    """Candidates against labelled, counted strings (label, s, n): distinct strings are few, so they are counted first, and
    each brings the handful of candidates along."""
    each = F.array(*(F.struct(F.lit(i).alias("candidate_idx"), F.lit(p).alias("pattern")) for i, p in candidates))
    return strings.select("*", F.inline(each)).withColumn("matched", F.expr(r"s rlike concat('\\A(?:', pattern, ')\\z')"))


def _counts(matched: DataFrame, *keys: str) -> DataFrame:
    yes, no, m = F.col("label") == "yes", F.col("label") == "no", F.col("matched")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return matched.groupBy(*keys, "candidate_idx", "pattern").agg(total(yes & m).alias("yes_matches"), total(yes).alias("yes_total"), total(no & ~m).alias("no_rejects"), total(no).alias("no_total"))


def _event_counts(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").withColumn("label", F.when(F.col("event_type").isin("purchase", "signup"), "yes").otherwise("no"))
    strings = events.groupBy(*keys, "label", F.col("event_type").alias("s")).agg(F.count("*").alias("n"))
    return score.with_metrics(_counts(_matched(strings, EVENT_PATTERNS), *keys))


def _event_sql(keys: str = "") -> str:
    return f"""WITH c(candidate_idx, pattern) AS (VALUES {_VALUES(EVENT_PATTERNS)}),
        m AS (SELECT {keys} candidate_idx, pattern, event_type IN ('purchase', 'signup') AS y, regexp_full_match(event_type, pattern) AS m FROM events, c),
        k AS (SELECT {keys} candidate_idx, pattern, count(*) FILTER (y AND m) AS yes_matches, count(*) FILTER (y) AS yes_total,
            count(*) FILTER (NOT y AND NOT m) AS no_rejects, count(*) FILTER (NOT y) AS no_total FROM m GROUP BY ALL),
        e AS (SELECT *, CASE WHEN yes_total + no_total > 0 THEN (yes_matches + no_rejects) / (yes_total + no_total) ELSE 0.0::DOUBLE END AS accuracy,
            CASE WHEN yes_total > 0 THEN yes_matches / yes_total ELSE 1.0::DOUBLE END AS yes_recall,
            CASE WHEN no_total > 0 THEN no_rejects / no_total ELSE 1.0::DOUBLE END AS no_precision,
            yes_matches = yes_total AND no_rejects = no_total AS is_perfect FROM k)"""


@_query(r"SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_full_match(o_orderpriority, '[1-2]-[A-Z]+')")
def fullmatch_filter(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lit("[1-2]-[A-Z]+").alias("expr"))
    return matching.full_match(o, text="o_orderpriority").where("matched").select("o_orderkey", "o_orderpriority")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT regexp_full_match(c_mktsegment, '[A-H][A-Z]*')")
def antimatch_filter(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit("[A-H][A-Z]*").alias("expr"))
    return matching.full_match(c, text="c_mktsegment").where("not matched").select("c_custkey", "c_mktsegment")


@_query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '[0-9]+[.][0-9]+')")
def search_filter(spark, sf_dir):
    return _read(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]+[.][0-9]+")).select("doc_id", F.length("text").cast("bigint").alias("n"))


@_query(_event_sql() + " SELECT candidate_idx, pattern, yes_matches, yes_total, no_rejects, no_total, round(accuracy, 6) AS accuracy, round(yes_recall, 6) AS yes_recall, round(no_precision, 6) AS no_precision, is_perfect FROM e")
def candidate_confusion(spark, sf_dir):
    return _event_counts(spark, sf_dir).withColumns({c: _r(F.col(c)) for c in ("accuracy", "yes_recall", "no_precision")})


def _rewards(spark, sf_dir, mode):
    e = _event_counts(spark, sf_dir)
    value = score.reward(F.lit(True), F.col("is_perfect"), F.col("accuracy"), F.length("pattern"), mode)
    return e.select("candidate_idx", "is_perfect", _r(value).alias("reward"))


@_query(_event_sql() + " SELECT candidate_idx, is_perfect, round(CASE WHEN is_perfect THEN 1.0::DOUBLE - 0.01::DOUBLE * length(pattern) ELSE -1.0::DOUBLE END, 6) AS reward FROM e")
def reward_binary(spark, sf_dir):
    return _rewards(spark, sf_dir, "binary")


@_query(_event_sql() + " SELECT candidate_idx, is_perfect, round(CASE WHEN 2.0::DOUBLE * accuracy - 1.0::DOUBLE > 0 THEN 2.0::DOUBLE * accuracy - 1.0::DOUBLE - 0.01::DOUBLE * length(pattern) ELSE 2.0::DOUBLE * accuracy - 1.0::DOUBLE END, 6) AS reward FROM e")
def reward_fractional(spark, sf_dir):
    return _rewards(spark, sf_dir, "fractional")


@_query("""SELECT event_id, user_id, round(CASE WHEN count(value) OVER w > 1 AND stddev_pop(value) OVER w > 0
    THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE value END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)""")
def reward_zscore(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return score.normalised(e, ["user_id"], "value").select("event_id", "user_id", _r(F.col("advantage")).alias("advantage"))


def _part_scores(spark, sf_dir):
    """Every type's brands, those of the first three series labelled yes, against the part patterns."""
    parts = _read(spark, sf_dir, "part").groupBy("p_type", F.col("p_brand").alias("s")).agg(F.count("*").alias("n"))
    parts = parts.withColumn("label", F.when(F.col("s").rlike("^Brand#[1-3]"), "yes").otherwise("no"))
    e = score.with_metrics(_counts(_matched(parts, PART_PATTERNS), "p_type"))
    value = score.reward(F.lit(True), F.col("is_perfect"), F.col("accuracy"), F.length("pattern"), "fractional")
    return e.withColumns({"is_valid": F.lit(True), "reward": value, "pattern_length": F.length("pattern")})


_PART_SQL = f"""WITH c(candidate_idx, pattern) AS (VALUES {_VALUES(PART_PATTERNS)}),
    m AS (SELECT p_type, candidate_idx, pattern, regexp_matches(p_brand, '^Brand#[1-3]') AS y, regexp_full_match(p_brand, pattern) AS m FROM part, c),
    k AS (SELECT p_type, candidate_idx, pattern, bool_and(y = m) AS is_perfect, count(*) FILTER (y = m) / count(*) AS accuracy FROM m GROUP BY ALL),
    e AS (SELECT *, CASE WHEN 2 * accuracy - 1 > 0 THEN 2 * accuracy - 1 - 0.01::DOUBLE * length(pattern) ELSE 2 * accuracy - 1 END AS reward FROM k)"""


@_query(_PART_SQL + """ SELECT p_type, arg_min(candidate_idx, length(pattern) * 1000 + candidate_idx) AS candidate_idx, arg_min(pattern, length(pattern) * 1000 + candidate_idx) AS pattern
    FROM e WHERE is_perfect GROUP BY p_type""")
def best_perfect(spark, sf_dir):
    best = score.problem_stats(_part_scores(spark, sf_dir).where("is_perfect"), "p_type")
    return best.select("p_type", "best_solution.candidate_idx", "best_solution.pattern")


@_query(_PART_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY reward DESC, candidate_idx) AS k FROM e WHERE NOT is_perfect)
    SELECT p_type, candidate_idx, round(reward, 6) AS reward FROM r WHERE k = 1""")
def best_fallback(spark, sf_dir):
    best = score.problem_stats(_part_scores(spark, sf_dir).where("not is_perfect"), "p_type")
    return best.select("p_type", "best_solution.candidate_idx", _r(F.col("best_solution.reward")).alias("reward"))


@_query(_PART_SQL + """ SELECT p_type, count(*) AS n, count(*) AS n_valid, count(*) FILTER (is_perfect) AS n_perfect, round(max(reward), 6) AS best_reward,
    string_agg(CAST(CAST(round(reward * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY candidate_idx) AS rewards FROM e GROUP BY p_type""")
def problem_stats(spark, sf_dir):
    s = score.problem_stats(_part_scores(spark, sf_dir), "p_type")
    milli = F.array_join(F.transform("rewards", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",")
    return s.select("p_type", "n", "n_valid", "n_perfect", _r(F.col("best_reward")).alias("best_reward"), milli.alias("rewards"))


@_query("""SELECT round(avg((event_type <> 'error')::INT), 6) AS valid_rate, round(avg((event_type = 'error' AND value < 50)::INT), 6) AS parse_error_rate,
    round(avg((event_type = 'error' AND value >= 50)::INT), 6) AS validation_error_rate FROM events""")
def outcome_rates(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("is_valid"), F.when((F.col("event_type") == "error") & (F.col("value") < 50), "p").alias("parse_error"), F.when((F.col("event_type") == "error") & (F.col("value") >= 50), "v").alias("validation_error"))
    out = score.outcome_rates(e)
    return out.select(*(_r(F.col(c)).alias(c) for c in out.columns))


@_query("SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value), 6) AS max, round(min(value), 6) AS min FROM events")
def reward_stats(spark, sf_dir):
    out = score.reward_stats(_read(spark, sf_dir, "events"), "value")
    return out.select(*(_r(F.col(c)).alias(c) for c in out.columns))


@_query("""SELECT p_brand, string_agg(p_name, ';' ORDER BY p_partkey) FILTER (regexp_full_match(p_name, '.*a.*')) AS yes_kept,
    count(*) FILTER (NOT regexp_full_match(p_name, '.*a.*')) AS removed FROM part GROUP BY p_brand""")
def entry_filter_lists(spark, sf_dir):
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    p = _read(spark, sf_dir, "part").groupBy("p_brand").agg(names.alias("yes")).select("p_brand", F.lit(".*a.*").alias("expr"), "yes", F.array().cast("array<string>").alias("no"))
    v = validate.validate(p)
    return v.select("p_brand", F.when(F.size("yes") > 0, F.array_join("yes", ";")).alias("yes_kept"), F.col("removed_yes").alias("removed"))


_DOC_RULE = "[A-Za-z ,.]*"


def _doc_entries(spark, sf_dir):
    """Each document as a validated entry of one file per source: its text should match a pattern of plain characters."""
    d = _read(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    return validate.validate(d.select(F.col("source").alias("path"), F.col("doc_id").alias("entry_idx"), F.lit(_DOC_RULE).alias("expr"), F.array("text").alias("yes"), none.alias("no")))


@_query(f"""SELECT source AS path, count(*) AS entries, count(*) AS original_yes, count(*) FILTER (regexp_full_match(text, '{_DOC_RULE}')) AS kept_yes,
    round(count(*) FILTER (regexp_full_match(text, '{_DOC_RULE}')) / count(*), 6) AS yes_accuracy FROM documents GROUP BY ROLLUP (source)""")
def source_rollup(spark, sf_dir):
    return validate.overall(_doc_entries(spark, sf_dir)).select("path", "entries", "original_yes", "kept_yes", _r(F.col("yes_accuracy")).alias("yes_accuracy"))


@_query("""SELECT source AS path, round(count(*) FILTER (quality = 1) / count(*), 6) AS yes_accuracy, round(((count(*) FILTER (quality = 1) / count(*)) + 1) / 2, 6) AS mean_accuracy
    FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY (count(*) FILTER (quality = 1) / count(*) + 1) / 2, source LIMIT 10""")
def worst_sources(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "source").join(_read(spark, sf_dir, "labels"), "doc_id")
    s = validate.with_ratios(d.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("original_yes"), F.count_if(F.col("quality") == 1).alias("kept_yes"), F.lit(0).alias("original_no"), F.lit(0).alias("kept_no")))
    return validate.worst_files(s).select("path", _r(F.col("yes_accuracy")).alias("yes_accuracy"), _r(F.col("mean_accuracy")).alias("mean_accuracy"))


@_query(f"""SELECT source AS path, doc_id AS entry_idx, '{_DOC_RULE}' AS expr_start, CAST(1 AS BIGINT) AS removed_yes, CAST(0 AS BIGINT) AS removed_no
    FROM documents WHERE NOT regexp_full_match(text, '{_DOC_RULE}')""")
def problem_entries(spark, sf_dir):
    return validate.problem_entries(_doc_entries(spark, sf_dir))


@_query(r"""WITH n AS (SELECT conv_id, text, role = 'user' AS y, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn, text) AS k FROM conversations)
    SELECT conv_id FROM n WHERE k <= 5 GROUP BY conv_id
    HAVING coalesce(bool_and(regexp_matches(text, '[Tt]h')) FILTER (y), true) AND coalesce(bool_or(NOT regexp_matches(text, '[Tt]h')) FILTER (NOT y), false)""")
def accept_first5(spark, sf_dir):
    t = _read(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    lists = t.groupBy("conv_id").agg(*(F.array_sort(F.collect_list(F.when(c, F.struct("turn", "text")))).alias(n) for n, c in (("y", user), ("n", ~user))))
    entries = lists.select("conv_id", F.lit("[Tt]h").alias("expr"), F.col("y.text").alias("yes"), F.col("n.text").alias("no"))
    return validate.accepted(entries).select("conv_id")


@_query(r"""SELECT doc_id, count(*) AS n_lines, CAST(max(length(x)) AS BIGINT) AS longest FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS x FROM documents) WHERE x <> '' GROUP BY doc_id""")
def split_trim_lines(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.explode(ingest.split_examples(F.col("text"))).alias("x"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("x")).cast("bigint").alias("longest"))


@_query("""SELECT page_id, CASE WHEN regexp_full_match(p, '/.*/[^/]*') THEN regexp_extract(p, '^/(.*)/([^/]*)$', 1) ELSE p END AS regex,
    CASE WHEN regexp_full_match(p, '/.*/[^/]*') THEN regexp_extract(p, '^/(.*)/([^/]*)$', 2) ELSE '' END AS flags FROM (SELECT page_id, regexp_replace(url, '^[a-z]+:/', '') AS p FROM pages)""")
def puzzle_line_parse(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+:/", "").alias("p"))
    regex, flags = ingest.puzzle_line(F.col("p"))
    return p.select("page_id", regex.alias("regex"), flags.alias("flags"))


@_query("""SELECT event_id, substring(s, strpos(s, '{'), length(s) - strpos(reverse(s), '}') + 2 - strpos(s, '{')) AS part, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM (SELECT event_id, props, 'answer: ' || props || ' end' AS s FROM events)""")
def json_slice(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", prompts.json_slice(F.concat(F.lit("answer: "), "props", F.lit(" end"))).alias("part"))
    return e.select("event_id", "part", F.expr("try_variant_get(try_parse_json(part), '$.k', 'bigint')").alias("k"))


@_query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation)
    SELECT n_regionkey, 'Pattern: [A-Z]+' || chr(10) || chr(10) || 'Examples:' || chr(10) || string_agg(k || '. `' || n_name || '`', chr(10) ORDER BY k) AS prompt FROM n WHERE k <= 10 GROUP BY n_regionkey""")
def prompt_numbered_examples(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return n.select("n_regionkey", prompts.generation("Pattern: {pattern}", F.lit("[A-Z]+"), F.col("names")).alias("prompt"))


@_query("""SELECT count(*) AS patterns, CAST(sum(u) AS BIGINT) AS yes_total, CAST(sum(a) AS BIGINT) AS no_total, round(avg(u), 1) AS yes_avg, round(avg(a), 1) AS no_avg
    FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role <> 'user') AS a FROM conversations GROUP BY conv_id)""")
def dataset_averages(spark, sf_dir):
    from ..sources.sinks import dataset_statistics

    user = F.col("role") == "user"
    return dataset_statistics(_read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(user, F.col("text"))).alias("yes"), F.collect_list(F.when(~user, F.col("text"))).alias("no")))


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(spark, sf_dir):
    from ..sources.sinks import pending

    return pending(_read(spark, sf_dir, "documents").select("doc_id", "source"), _read(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT r_name AS file, count(n_nationkey) AS entries FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def count_entries(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ingest.count_entries(_read(spark, sf_dir, "region").select(F.col("r_name").alias("path")), n.select(F.col("r_name").alias("path"))).withColumnRenamed("path", "file")


@_query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def first_patterns(spark, sf_dir):
    return ingest.first(_read(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


@_query("""SELECT p_partkey, 'sys' || chr(10) || chr(10) || 'dev' || chr(10) || chr(10) || '{"yes": ["' || p_name || '"], "no": ["' || p_brand || '"]}' AS prompt FROM part""")
def prompt_solver(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", prompts.solver("sys", "dev", F.array("p_name"), F.array("p_brand")).alias("prompt"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates for the order priorities of every status, scored, normalised and ranked."""
    o = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("problem_id"), F.col("o_orderpriority").alias("s")).agg(F.count("*").alias("n"))
    o = o.withColumn("label", F.when(F.col("s").rlike("^[12]"), "yes").otherwise("no"))
    e = score.with_metrics(_counts(_matched(o, [(0, "[1-2]-.*"), (1, "1-URGENT"), (2, ".*[A-Z]+")]), "problem_id"))
    value = score.reward(F.lit(True), F.col("is_perfect"), F.col("accuracy"), F.length("pattern"))
    scored = score.normalised(e.withColumns({"is_valid": F.lit(True), "reward": value, "pattern_length": F.length("pattern")}), ["problem_id"])
    best = score.problem_stats(scored).select("problem_id", F.col("best_solution.candidate_idx").alias("best_idx"))
    return scored.join(best, "problem_id").orderBy("problem_id", "candidate_idx")
