"""Queries through SQL functions of the session, and configurations of any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.operators import config as cf
from pressgrain.plans import fixtures as fx
from pressgrain.plans.registry import query
from pressgrain.plans.reports import BERLIN, REPORT_SQL, TS, _stamped
from pressgrain.plans.sqltext import norm, skeleton
from pressgrain.scale import spread
from pressgrain.sqlfunctions import register_reports, register_text_functions


@query("j04_text_functions", f"""select doc_id, md5({norm('text')}) as norm_md5, md5({skeleton("coalesce(text,'')")}) as skeleton_md5, contains(' '||{norm('text')}||' ', ' und ') as has_und, sha256(coalesce(text,'')) as text_hash from documents""")
def _(t):
    register_text_functions(t.spark)
    return t.spark.sql(
        """SELECT doc_id, md5(pg_norm_text(text)) AS norm_md5, md5(pg_evidence_skeleton(coalesce(text, ''))) AS skeleton_md5,
        pg_contains_term(pg_norm_text(text), 'Und') AS has_und, pg_content_hash(coalesce(text, '')) AS text_hash FROM {documents}""", documents=t.documents)


def _reports(t):
    fx.costed(t).createOrReplaceTempView("pg_costed")
    tracks = "CASE event_id % 4 WHEN 0 THEN array('marketing') WHEN 1 THEN array('sales', 'buying_center') WHEN 2 THEN cast(array() AS array<string>) ELSE array('marketing', 'sales') END"
    t.events.selectExpr(f"{tracks} AS routing", "CASE WHEN event_id % 6 <> 0 THEN concat('v', event_id % 6) END AS version", "ts AS classified_at").createOrReplaceTempView("pg_articles")
    register_reports(t.spark, "pg_costed", "pg_articles")


@query("j01_usage_report", f"with {fx.COSTED_SQL} " + REPORT_SQL.format("and crawl_run_id=3"))
def _(t):
    _reports(t)
    return _stamped(t.spark.sql("SELECT * FROM pg_usage_report(run_id => 3, since => TIMESTAMP'2024-01-10')"))


@query("j01_local_ledger", f"""with {fx.COSTED_SQL} select {BERLIN} as usage_date, coalesce(model,'unknown') as model, operation, status, count(*) as request_count, sum(total_tokens)::bigint as total_tokens
 from costed where regexp_matches(prompt_version,'^simple-v[1-9][0-9]*(\\.|$)') group by 1,2,3,4""")
def _(t):
    _reports(t)
    return t.spark.sql(r"""SELECT cast(usage_date AS string) AS usage_date, model, operation, status, request_count, total_tokens
        FROM pg_local_ledger(pattern => '^simple-v[1-9][0-9]*(\\.|$)', tz => 'Europe/Berlin')""")


@query("j01_version_list", f"""with a as (select *, case event_id%4 when 0 then ['marketing'] when 1 then ['sales','buying_center'] when 2 then [] else ['marketing','sales'] end as routing, case when event_id%6=0 then null else 'v'||(event_id%6) end as version from events)
select track, version, count(*) as n_articles, {TS.format('min(ts)')} as first_at, {TS.format('max(ts)')} as last_at from a, (values ('sales'),('marketing')) w(track) where version is not null and list_contains(routing, track) group by 1,2""")
def _(t):
    _reports(t)
    return _stamped(t.spark.sql("SELECT w.track, v.* FROM VALUES ('sales'), ('marketing') AS w(track), LATERAL pg_version_list(tracks => array(w.track)) v"))


@query("b45_config_any_depth", """with k as (select event_id, event_type, json_extract(props,'$.k')::bigint as k from events)
select event_id as key, 'crawl.limits.days.most' as path, '183' as before, k::varchar as after from k where k<>183 union all
select event_id, 'quality.profile.name', '"strict"', '"'||event_type||'"' from k union all
select event_id, 'extra.deep.er.list', null, '['||k||',{"on":true}]' from k where event_id%2=0""")
def _(t):
    rows = spread(t.events, "event_id").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    base = F.lit('{"crawl":{"limits":{"days":{"most":183,"least":1}}},"quality":{"profile":{"name":"strict"}},"filters":{"dedupe":{"on":true}}}')
    extra = F.when(F.col("event_id") % 2 == 0, F.format_string(',"extra":{"deep":{"er":{"list":[%d,{"on":true}]}}}', "k")).otherwise("")
    over = F.format_string('{"crawl":{"limits":{"days":{"most":%d}}},"quality":{"profile":{"name":"%s"}},"filters":{"dedupe":{"on":false}}%s}', "k", "event_type", extra)
    defaults = cf.flatten(rows, "event_id", base)
    return cf.changes(defaults, cf.overlay(defaults, cf.flatten(rows, "event_id", over), {"filters.dedupe.on": "true"}))
