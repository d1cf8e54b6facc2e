"""Queries that run the streaming operators over the given files and return their final state.

A stream writes below the shared checkpoint folder of the session and stops once everything available is processed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions.cost import rate_lookup, rate_table, usage_cost
from pressgrain.operators import runs as rn, windows as wn
from pressgrain.plans import fixtures as fx
from pressgrain.plans.registry import query
from pressgrain.plans.reports import INCIDENT_SQL, LEDGER_SQL, TS, _stamped
from pressgrain.plans.rules import _families_sql, m
from pressgrain.plans.sqltext import norm
from pressgrain.rules.packs import FIXTURE
from pressgrain.session import work_folder
from pressgrain.streaming import streams as st


def _usage_stream(t):
    rows = st.file_stream(t.spark, t.folder, "events").selectExpr(*fx._split(fx.USAGE_COLUMNS.format(k=fx.K_SPARK)))
    priced = rate_lookup(rows, rate_table(t.spark))
    cols = ("input_tokens", "cached_input_tokens", "output_tokens", "thinking_tokens", "r_in", "r_cached", "r_out")
    return priced.withColumn("cost_usd", usage_cost(*[F.col(c) for c in cols]))


@query("i01_stream_daily_ledger", f"with {fx.COSTED_SQL} {LEDGER_SQL}")
def _(t):
    base = work_folder(t.spark, "ledger")
    return _stamped(st.stream_daily_ledger(_usage_stream(t), f"{base}/out", f"{base}/progress"))


@query("i02_late_correction", f"with {fx.COSTED_SQL} {LEDGER_SQL}")
def _(t):
    base = work_folder(t.spark, "late")
    return _stamped(st.late_correction(_usage_stream(t), f"{base}/facts", f"{base}/ledger", f"{base}/progress"))


@query("i03_stream_dedup", "select count(*) as n, count(distinct user_id) as users, sum(event_id)::bigint as id_sum from events")
def _(t):
    base = work_folder(t.spark, "dedup")
    ev = st.file_stream(t.spark, t.folder, "events").select("event_id", "ts", "user_id")
    twice = ev.unionByName(ev)
    st.run_available(st.stream_dedup(twice, ["event_id"], "ts", "1 day"), st.append_batches(f"{base}/out"), f"{base}/progress")
    return t.spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.sum("event_id").alias("id_sum"))


@query("i04_silent_runs", f"""with g as (select user_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as next_at from events)
select user_id, event_id, {TS.format('ts')} as ts, {TS.format('next_at')} as next_at, epoch_us(next_at)-epoch_us(ts) as gap_us, next_at is null as is_open from g where next_at is null or epoch_us(next_at)-epoch_us(ts) > 7200000000""")
def _(t):
    beats = t.events.select("user_id", "event_id", "ts")
    out = rn.silent_gaps(beats, "user_id", "ts", ["ts", "event_id"], 7_200)
    return _stamped(out.withColumn("is_open", F.col("next_at").isNull()))


@query("i04_retry_due", "select event_id, event_type='error' and user_id%2=0 and event_id%4<2 as due from events")
def _(t):
    due = rn.retry_due(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, "modell").otherwise("lesen"), F.col("event_id") % 4)
    return t.events.select("event_id", due.alias("due"))


@query("i04_silent_stream", """with g as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as next_at from (select distinct user_id, ts from events))
select user_id, epoch_us(ts) as last_us, epoch_us(next_at) as next_us from g where next_at is null or epoch_us(next_at)-epoch_us(ts) > 7200000000""")
def _(t):
    base = work_folder(t.spark, "silent")
    out = st.silent_runs(st.file_stream(t.spark, t.folder, "events"), "user_id", "ts", 7_200)
    st.run_available(out.changes, st.append_batches(f"{base}/out"), f"{base}/progress")
    rows = out.results(t.spark, f"{base}/out", f"{base}/progress")
    return rows.select(F.col("key").alias("user_id"), "last_us", "next_us")


@query("i05_stream_pulses", """with e as (select user_id, event_id, ts, event_type as phase, json_extract(props,'$.k')::bigint as k from events),
c as (select *, case when lag(phase) over w is distinct from phase then 1 else 0 end as c from e window w as (partition by user_id order by ts, event_id)), i as (select *, sum(c) over (partition by user_id order by ts, event_id) as g from c),
p as (select user_id, g, any_value(phase) as phase, min(epoch_us(ts)) as since_us, max(epoch_us(ts)) as last_us, arg_max(k,(ts,event_id)) as value, count(*) as pulses from i group by 1,2)
select user_id, phase, since_us, last_us, value, pulses, g = max(g) over (partition by user_id) as is_open from p""")
def _(t):
    base = work_folder(t.spark, "pulses")
    ev = st.file_stream(t.spark, t.folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    out = st.stream_pulses(ev, "user_id", "ts", "event_type", "k", "event_id")
    st.run_available(out.changes, st.append_batches(f"{base}/out"), f"{base}/progress")
    rows = out.results(t.spark, f"{base}/out", f"{base}/progress")
    return rows.select(F.col("key").alias("user_id"), "phase", "since_us", "last_us", "value", "pulses", "is_open")


@query("i06_stream_incidents", f"with {INCIDENT_SQL} select user_id, epoch_us(ts) as started_us, epoch_us(resolved_at) as resolved_us from n where down")
def _(t):
    base = work_folder(t.spark, "incidents")
    ev = st.file_stream(t.spark, t.folder, "events").withColumn("down", F.col("event_type") == "error")
    out = st.stream_incidents(ev, "user_id", "ts", "down", "event_id")
    st.run_available(out.changes, st.append_batches(f"{base}/out"), f"{base}/progress")
    return out.results(t.spark, f"{base}/out", f"{base}/progress").select(F.col("key").alias("user_id"), "started_us", "resolved_us")


@query("i07_retention", "select event_id from events where ts >= timestamp '2024-02-05' - interval 30 day")
def _(t):
    return wn.retention(t.events, "ts", F.lit("2024-02-05").cast("timestamp"), 30).select("event_id")


@query("i08_resume_analysis", "select doc_id from documents where not (doc_id%3=0) or doc_id%6=0")
def _(t):
    arts = t.documents.select("doc_id", F.sha2("text", 256).alias("stage_hash"))
    changed = F.when(F.col("doc_id") % 6 == 0, F.sha2(F.concat("text", F.lit("old")), 256)).otherwise(F.sha2("text", 256))
    done = t.documents.where("doc_id % 3 = 0").select("doc_id", changed.alias("stage_hash"))
    return st.resume_analysis(arts, done, "doc_id", "stage_hash").select("doc_id")


H1 = "regexp_extract(html,'(?s)<h1>(.*?)</h1>',1)"
# Block elements end a line, other tags leave nothing, blanks and empty lines are folded, as extraction does it.
BODY = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html,'(?s)<article>(.*?)</article>',1),"
    r"'</?(p|br|div|li|ul|ol|h[1-6]|tr|section|article|main|blockquote)\b[^>]*>',chr(10),'g'),'<[^>]+>','','g'),'[ \t]+',' ','g'),'\n{3,}',chr(10)||chr(10),'g')"
)


def _decoded(text: str) -> str:
    """The entities of the test pages, as extraction decodes them."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text},'{entity}','{char}')"
    return text


@query("i09_stream_signals", f"""with {fx.COMPANIES_SQL}, pa0 as (select page_id, {_decoded(H1)} as title, trim(regexp_replace({_decoded(BODY)},'^\\s+|\\s+$','','g')) as content, regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/?#:]+)',1)),'^www\\.','') as host from pages),
pa as (select page_id, length(trim(trim(title)||chr(10)||trim(content))) as len, {norm('title')} as t, {norm("title||chr(10)||content")} as n, host from pa0),
pb as (select *, {m('n', FIXTURE.patterns['sensitive'])} as sens, case when len<220 then 'too_short' when {m('t', FIXTURE.patterns['sensitive'])} then 'sensitive' end as r0 from pa),
pc as (select *, case when r0 is null then {_families_sql('n', 't', 'host', 'sens')} else []::varchar[] end as families from pb),
named as (select page_id, string_agg(distinct company, ',' order by company) as companies from pa join aliases on length(alias)>=3 and contains(' '||n||' ', ' '||alias||' ') group by 1)
select page_id, array_to_string(families,',') as families, case when r0 is not null then r0 when len(families)=0 then 'no_signal_pattern' end as reject, coalesce(companies,'') as companies from pc left join named using (page_id)""")
def _(t):
    base = work_folder(t.spark, "signals")
    out = st.stream_signals(st.file_stream(t.spark, t.folder, "pages"), FIXTURE, fx.aliases(t), f"{base}/out", f"{base}/progress")
    return out.select(F.col("doc_id").alias("page_id"), F.array_join("families", ",").alias("families"), "reject", F.array_join("companies", ",").alias("companies"))


@query("i10_stream_backlog", """select case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status, (o_custkey%5)::int as attempts, count(*) as n,
 count(*) filter (where o_orderstatus='P' and o_orderdate + interval 1 hour < timestamp '1996-01-01' - interval 2 hour) as stale from orders group by 1,2""")
def _(t):
    base = work_folder(t.spark, "backlog")
    from pressgrain.plans.reports import BACKLOG_JOBS

    jobs = st.file_stream(t.spark, t.folder, "orders").selectExpr(*fx._split(BACKLOG_JOBS))
    return st.stream_backlog(jobs, F.lit("1996-01-01").cast("timestamp"), f"{base}/out", f"{base}/progress")
