"""The text functions and reports as SQL functions of a session.

Scalar functions are SQL expressions that the optimizer inlines; they equal the Column functions of the same name. Table
functions take named arguments and read temporary views. All names begin with `pg_`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pressgrain.functions import text


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_PAIRS = f"str_to_map({quoted(text.FOLD_LONG_PAIRS)}, ';', '=')"
_LONG = f"array_join(transform(split(low, ''), c -> coalesce(try_element_at({_PAIRS}, c), c)), '')"
_SHARED = "size(array_intersect(pg_headline_tokens(a), pg_headline_tokens(b)))"

#: Name, arguments, result and expression of each scalar function, in the order in which they need each other.
SCALARS = [
    ("pg_fold_low", "low STRING", "STRING", f"CASE WHEN octet_length(low) = length(low) THEN low ELSE translate(replace(CASE WHEN low RLIKE {quoted(text.FOLD_LONG_CLASS)} THEN {_LONG} ELSE low END, 'ß', 'ss'), {quoted(text.FOLD_FROM)}, {quoted(text.FOLD_TO)}) END"),
    ("pg_fold", "s STRING", "STRING", "pg_fold_low(lower(s))"),
    ("pg_norm_text", "s STRING", "STRING", "trim(regexp_replace(pg_fold(coalesce(s, '')), '[^a-z0-9]+', ' '))"),
    ("pg_evidence_skeleton", "s STRING", "STRING", "regexp_replace(pg_fold(translate(replace(lower(s), 'ß', 'ss'), 'äöü�', '')), '[^a-z0-9]+', '')"),
    ("pg_content_hash", "s STRING", "STRING", "sha2(s, 256)"),
    ("pg_canonical_headline", "s STRING", "STRING", "trim(regexp_replace(regexp_replace(pg_norm_text(s), " + quoted(r"\b(" + "|".join(text.HEADLINE_NOISE) + r")\b") + ", ' '), " + quoted(r"\s+") + ", ' '))"),
    ("pg_headline_tokens", "s STRING", "ARRAY<STRING>", "array_distinct(filter(split(pg_canonical_headline(s), ' '), t -> length(t) >= 4 AND NOT t RLIKE " + quoted(r"^20\d{2}$") + "))"),
    ("pg_token_similarity", "a STRING, b STRING", "DOUBLE", f"CASE WHEN size(pg_headline_tokens(a)) = 0 OR size(pg_headline_tokens(b)) = 0 THEN 0D ELSE {_SHARED} / size(array_union(pg_headline_tokens(a), pg_headline_tokens(b))) END"),
    ("pg_contains_term", "norm STRING, term STRING", "BOOLEAN", "pg_norm_text(term) <> '' AND contains(concat(' ', norm, ' '), concat(' ', pg_norm_text(term), ' '))"),
    ("pg_host_of", "url STRING", "STRING", "coalesce(regexp_replace(lower(try_parse_url(trim(url), 'HOST')), " + quoted(r"^www\.") + ", ''), '')"),
    ("pg_clamp01", "x DOUBLE", "DOUBLE", "CASE WHEN x IS NULL OR isnan(x) OR abs(x) = double('infinity') THEN 0D ELSE greatest(0D, least(1D, x)) END"),
]

_TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens", "thinking_tokens", "total_tokens")
_SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in _TOKENS)
_SUM_TYPES = ", ".join(f"{c} BIGINT" for c in _TOKENS)


def register_text_functions(spark: SparkSession) -> list[str]:
    """Make the scalar functions known to the session; their names."""
    for name, args, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in SCALARS]


def register_reports(spark: SparkSession, usage: str, articles: str) -> list[str]:
    """Table functions over the views `usage` (priced events) and `articles` (routing, version, classified_at):

    `pg_usage_report(since, run_id => NULL, unassigned => FALSE, operations => ARRAY())`, `pg_local_ledger(tz, pattern)`
    and `pg_version_list(tracks)`.
    """
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION pg_usage_report(since TIMESTAMP, run_id BIGINT DEFAULT NULL, unassigned BOOLEAN DEFAULT FALSE, operations ARRAY<STRING> DEFAULT array())
 RETURNS TABLE (model STRING, operation STRING, status STRING, request_count BIGINT, article_count BIGINT, {_SUM_TYPES}, cost_usd DECIMAL(38, 9))
 RETURN SELECT coalesce(u.model, 'unknown'), coalesce(u.operation, 'unknown'), coalesce(u.status, 'unknown'), count(*), count(DISTINCT u.article_id), {_SUMS}, coalesce(sum(u.cost_usd), 0)
 FROM {usage} u WHERE u.created_at >= pg_usage_report.since
 AND CASE WHEN pg_usage_report.run_id IS NOT NULL THEN u.crawl_run_id = pg_usage_report.run_id WHEN pg_usage_report.unassigned THEN u.crawl_run_id IS NULL AND array_contains(pg_usage_report.operations, u.operation) ELSE TRUE END
 GROUP BY 1, 2, 3""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION pg_local_ledger(tz STRING, pattern STRING)
 RETURNS TABLE (usage_date DATE, model STRING, operation STRING, status STRING, request_count BIGINT, {_SUM_TYPES}, cost_usd DECIMAL(38, 9))
 RETURN SELECT to_date(from_utc_timestamp(u.created_at, pg_local_ledger.tz)), coalesce(u.model, 'unknown'), u.operation, u.status, count(*), {_SUMS}, coalesce(sum(u.cost_usd), 0)
 FROM {usage} u WHERE u.prompt_version RLIKE pg_local_ledger.pattern GROUP BY 1, 2, 3, 4""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION pg_version_list(tracks ARRAY<STRING>)
 RETURNS TABLE (version STRING, n_articles BIGINT, first_at TIMESTAMP, last_at TIMESTAMP)
 RETURN SELECT a.version, count(*), min(a.classified_at), max(a.classified_at) FROM {articles} a
 WHERE a.version IS NOT NULL AND arrays_overlap(a.routing, pg_version_list.tracks) GROUP BY a.version""")
    return ["pg_usage_report", "pg_local_ledger", "pg_version_list"]
