"""Queries for ledgers, reports, joins, ordered operators and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import cost
from pressgrain.functions.text import norm_text
from pressgrain.operators import aggregates as ag, joins as jn, runs as rn, windows as wn
from pressgrain.operators.dedup import written
from pressgrain.operators.ranking import newest_per_key, top_k
from pressgrain.plans import fixtures as fx
from pressgrain.plans.registry import query
from pressgrain.plans.sqltext import norm
from pressgrain.scale import running_sum

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def ts_text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def money(col, digits=9):
    return F.round(F.col(col).cast("double"), digits).alias(col)


def _stamped(df):
    out = df
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            out = out.withColumn(name, ts_text(F.col(name)))
        elif kind == "date":
            out = out.withColumn(name, F.col(name).cast("string"))
        elif kind.startswith("decimal"):
            out = out.withColumn(name, money(name))
    return out


SUMS = ", ".join(f"coalesce(sum({c}),0)::bigint as {c}" for c in ag.TOKENS) + ", round(coalesce(sum(cost_usd),0),9) as cost_usd"


@query("d01_jobs_with_text", "select l.l_orderkey, l.l_linenumber, o.o_orderpriority from lineitem l join orders o on l.l_orderkey=o.o_orderkey where length(o.o_orderpriority)>=7")
def _(t):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return jn.jobs_with_text(t.lineitem.select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "o_orderpriority", 7)


@query("d02_join_json_items", """
with j as (select event_id, unnest([event_id%1500, event_id%1000]) as job, unnest([0,1]) as ordinality, unnest(['F','O']) as status from events)
select event_id, ordinality, job, status, o_totalprice from j join orders on o_orderkey=job and o_orderstatus=status""")
def _(t):
    items = t.events.select("event_id", F.format_string('[{"job":%d,"status":"F"},{"job":%d,"status":"O"}]', F.col("event_id") % 1500, F.col("event_id") % 1000).alias("items"))
    jobs = t.orders.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return jn.join_json_items(items, "items", jobs, ["job", "status"])


@query("d03_left_lookup", "select c_custkey, n_name, r_name from customer left join (select * from nation where n_regionkey<>2) on c_nationkey=n_nationkey left join region on n_regionkey=r_regionkey")
def _(t):
    nation = t.nation.where("n_regionkey <> 2").withColumnRenamed("n_nationkey", "c_nationkey")
    rows = jn.left_lookup(t.customer.select("c_custkey", "c_nationkey"), nation, "c_nationkey")
    rows = jn.left_lookup(rows, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return rows.select("c_custkey", "n_name", "r_name")


@query("d04_missing_by_key", """select c_custkey from (select c_custkey, 'SUPPLIER#'||lpad((c_custkey//3)::varchar,9,'0')||' ' as nm from customer)
where lower(trim(nm)) not in (select lower(trim(s_name)) from supplier)""")
def _(t):
    left = t.customer.selectExpr("c_custkey", "concat('SUPPLIER#', lpad(cast(c_custkey div 3 as string),9,'0'), ' ') as nm")
    return jn.missing_by_key(left, t.supplier, "nm", "s_name", lambda c: F.lower(F.trim(c))).select("c_custkey")


@query("d05_anti_exists", "select p_partkey from part where not exists (select 1 from lineitem where l_partkey=p_partkey and l_quantity>=49)")
def _(t):
    big = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return jn.anti_exists(t.part.select("p_partkey"), big, "p_partkey")


@query("d06_semi_exists", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R')")
def _(t):
    back = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jn.semi_exists(t.orders.select("o_orderkey"), back, "o_orderkey")


@query("d07_rows_on_days", """select event_id, strftime(ts,'%Y-%m-%d') as usage_date from events where ts::date in (select distinct ts::date from events where value>300)""")
def _(t):
    days = t.events.where("value > 300").select(F.to_date("ts").alias("usage_date"))
    rows = jn.rows_on_days(t.events.select("event_id", "ts"), days, F.to_date("ts"))
    return rows.select("event_id", F.col("usage_date").cast("string").alias("usage_date"))


# Sessions: every signup opens a run of its user's version for six hours; every seventh stays open.
@query("d08_asof_run", f"""with {fx.USAGE_SQL},
r as (select event_id as run_id, 'simple-v'||(event_id%3)||'.'||(event_id%2) as prompt_version, ts as started_at,
  case when event_id%7=0 then null else ts + interval 6 hour end as finished_at from events where event_type='signup'),
h as (select u.event_id, arg_max(r.run_id, (r.started_at, r.run_id)) as run_id from usage u join r on r.prompt_version=u.prompt_version
  and u.created_at>=r.started_at and u.created_at<=coalesce(r.finished_at, timestamp '2024-01-31') group by 1)
select u.event_id, h.run_id from usage u left join h using (event_id)""")
def _(t):
    ev = fx.usage(t).select("event_id", "created_at", "prompt_version")
    r = t.events.where("event_type = 'signup'").selectExpr(
        "event_id as run_id", "'simple-v'||(event_id%3)||'.'||(event_id%2) as prompt_version", "ts as started_at",
        "case when event_id%7=0 then null else ts + interval 6 hours end as finished_at")
    return jn.asof_run(ev, r, "prompt_version", F.lit("2024-01-31").cast("timestamp")).select("event_id", "run_id")


@query("d09_explode_nested", "select event_id, unnest([k, k+1, k*2]) as part from (select event_id, json_extract(props,'$.k')::bigint as k from events)")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return jn.explode_nested(t.events.select("event_id", F.array(k, k + 1, k * 2).alias("a")), "a", "part").select("event_id", "part")


@query("d13_exact_duplicates", "select doc_id, min(doc_id) over (partition by sha256(text)) as duplicate_of, count(*) over (partition by sha256(text)) as copies from documents qualify doc_id<>duplicate_of")
def _(t):
    from pressgrain.operators.dedup import exact_duplicates

    return exact_duplicates(t.documents.select("doc_id", F.sha2("text", 256).alias("hash")), "hash")


@query("d14_embed_dim", "select n_nationkey, r_regionkey as region_id, r_name as region_name from nation join region on n_regionkey=r_regionkey")
def _(t):
    dim = t.region.withColumn("n_regionkey", F.col("r_regionkey"))
    rows = jn.embed_dim(t.nation, dim, "n_regionkey", ["r_regionkey", "r_name"], "region")
    return rows.select("n_nationkey", F.col("region.r_regionkey").alias("region_id"), F.col("region.r_name").alias("region_name"))


@query("d15_cross_scalar", "select event_type, count(*) as n, round(count(*)/any_value(t.total),6) as share from events, (select count(*) as total from events) t group by 1")
def _(t):
    totals = t.events.agg(F.count(F.lit(1)).alias("total"))
    rows = jn.cross_scalar(totals, t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    return rows.select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("d16_entity_groups", """
with m as (select p_partkey, [p_brand, upper(p_brand)] as main, [lower(p_brand), 'Brand#'||(p_size%25), p_name, upper(p_name), 'Other '||p_type] as ment, ['other small'] as inc from part),
f as (select p_partkey, main, list_filter(ment, lambda x: not list_contains(list_transform(list_concat(main,inc), lambda y: lower(y)), lower(x))) as r from m)
select p_partkey, array_to_string(main,'|') as main, array_to_string(list_filter(r, lambda x, i: list_position(list_transform(r, lambda y: lower(y)), lower(x))=i),'|') as others from f""")
def _(t):
    rows = t.part.selectExpr("p_partkey", "array(p_brand, upper(p_brand)) as main",
                             "array(lower(p_brand), concat('Brand#', p_size%25), p_name, upper(p_name), concat('Other ', p_type)) as ment")
    g = jn.entity_groups(F.col("main"), F.col("ment"), F.array(F.lit("other small")))
    return rows.select("p_partkey", g.alias("g")).select("p_partkey", F.array_join("g.main", "|").alias("main"), F.array_join("g.others", "|").alias("others"))


@query("e01_usage_by_article", f"with {fx.COSTED_SQL} select article_id, count(*) as requests, {SUMS}, {TS.format('max(created_at)')} as updated_at from costed where article_id is not null and total_tokens>0 group by 1")
def _(t):
    return _stamped(ag.usage_by_article(fx.costed(t)))


LEDGER_SELECT = f"count(*) as request_count, count(*) filter (where status='error') as error_count, {SUMS}, {TS.format('min(created_at)')} as first_event_at, {TS.format('max(created_at)')} as last_event_at"
LEDGER_SQL = f"select strftime(created_at,'%Y-%m-%d') as usage_date, coalesce(model,'unknown') as model, operation, status, {LEDGER_SELECT} from costed group by 1,2,3,4"


@query("e02_daily_ledger", f"with {fx.COSTED_SQL} {LEDGER_SQL}")
def _(t):
    return _stamped(ag.daily_ledger(fx.costed(t)))


@query("e03_error_counts", "select user_id, count(*) as n, count(*) filter (where event_type='error') as errors from events group by 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


REPORT_SQL = "select coalesce(model,'unknown') as model, operation, status, count(*) as request_count, count(distinct article_id) as article_count, " + SUMS + " from costed where created_at>=timestamp '2024-01-10' {} group by 1,2,3"


@query("e04_usage_report", f"with {fx.COSTED_SQL} " + REPORT_SQL.format(""))
def _(t):
    return _stamped(ag.usage_report(fx.costed(t), "2024-01-10"))


@query("e04_usage_report_run", f"with {fx.COSTED_SQL} " + REPORT_SQL.format("and crawl_run_id=3"))
def _(t):
    return _stamped(ag.usage_report(fx.costed(t), "2024-01-10", run_id=3))


@query("e04_usage_report_unassigned", f"with {fx.COSTED_SQL} " + REPORT_SQL.format("and crawl_run_id is null and operation in ('click','view')"))
def _(t):
    return _stamped(ag.usage_report(fx.costed(t), "2024-01-10", unassigned_only=True, unassigned_operations=["click", "view"]))


@query("e05_percentiles", """select event_type, p as prob, round(case when p=0.5 then quantile_cont(value,0.5) when p=0.75 then quantile_cont(value,0.75) else quantile_cont(value,0.9) end, 6) as value
 from events, (values (0.5),(0.75),(0.9)) v(p) group by event_type, p""")
def _(t):
    rows = ag.percentiles(t.events, ["event_type"], "value", [0.5, 0.75, 0.9], 5.0)
    return rows.select("event_type", "prob", F.round("value", 6).alias("value"))


SEGS_SQL = f"""{fx.RUN_LOG_SQL},
segs as (select l.run_id, l.event_id, l.stage, l.t, greatest(200, coalesce(lead(l.t) over (partition by l.run_id order by l.t, l.event_id), r.duration_ms)-l.t) as dur
 from log_rows l join runs r using (run_id) where l.stage is not null), kept as (select * from segs where dur >= 200)"""


@query("f01_stage_durations", f"with {SEGS_SQL} select run_id, event_id, stage, t, dur from kept")
def _(t):
    runs, logs = fx.run_tables(t)
    return wn.stage_durations(logs, runs)


@query("e06_stage_totals", f"with {SEGS_SQL} select run_id, stage, case when stage='modell' then sum(dur) else max(dur) end::bigint as dur from kept group by 1,2")
def _(t):
    runs, logs = fx.run_tables(t)
    return ag.stage_totals(wn.stage_durations(logs, runs), ["run_id"], "modell")


@query("e07_to_object", "select user_id, string_agg(event_type||'='||n, ',' order by event_type) as object from (select user_id, event_type, count(*) as n from events group by 1,2) group by 1")
def _(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    obj = ag.to_object(n, ["user_id"], "event_type", "n")
    return obj.select("user_id", F.array_join(F.transform(F.map_entries("object"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("object"))


@query("e08_groups_with_min", "select o_custkey, count(*) as n from orders group by 1 having count(*)>=15")
def _(t):
    return ag.groups_with_min(t.orders, ["o_custkey"], 15)


@query("e09_version_list", f"""with a as (select *, case event_id%4 when 0 then ['marketing'] when 1 then ['sales','buying_center'] when 2 then [] else ['marketing','sales'] end as routing,
 case when event_id%6=0 then null else 'v'||(event_id%6) end as version from events)
select version, count(*) as n_articles, {TS.format('min(ts)')} as first_at, {TS.format('max(ts)')} as last_at from a where version is not null and list_has_any(routing,['sales','buying_center']) group by 1""")
def _(t):
    arr = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    m = F.col("event_id") % 4
    a = t.events.select(F.when(m == 0, arr("marketing")).when(m == 1, arr("sales", "buying_center")).when(m == 2, arr()).otherwise(arr("marketing", "sales")).alias("routing"),
                        F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("v"), F.col("event_id") % 6)).alias("version"), F.col("ts").alias("classified_at"))
    return _stamped(ag.version_list(a, ["sales", "buying_center"]))


BERLIN = "strftime(timezone('Europe/Berlin', timezone('UTC', created_at)),'%Y-%m-%d')"


@query("e10_local_ledger", f"with {fx.COSTED_SQL} select {BERLIN} as usage_date, coalesce(model,'unknown') as model, operation, status, {LEDGER_SELECT} from costed where regexp_matches(prompt_version,'^simple-v[1-9][0-9]*(\\.|$)') group by 1,2,3,4")
def _(t):
    return _stamped(ag.local_ledger(fx.costed(t), "Europe/Berlin", r"^simple-v[1-9][0-9]*(\.|$)"))


@query("e11_status_counts", """select count(*) as total, count(*) filter (where o_orderstatus='F') as finished, count(*) filter (where o_orderstatus<>'F') as pending,
 count(*) filter (where o_orderstatus='O' and o_orderpriority='1-URGENT') as urgent_open from orders""")
def _(t):
    st = F.col("o_orderstatus")
    return ag.status_counts(t.orders, {"total": F.lit(True), "finished": st == "F", "pending": st != "F",
                                       "urgent_open": (st == "O") & (F.col("o_orderpriority") == "1-URGENT")})


@query("e12_error_breakdown", """with e as (select event_id, user_id, ts, 'code'||(event_id%4) as code from events where event_type='error'),
f as (select user_id, arg_min(code, (ts, event_id)) as code, count(*) as n from e group by 1) select code, count(*) as n_items, sum(n)::bigint as n_errors from f group by 1""")
def _(t):
    e = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts", F.concat(F.lit("code"), F.col("event_id") % 4).alias("code"))
    return ag.error_breakdown(e, "user_id", "code", "ts")


@query("e13_facet_values", "select 'p_brand' as facet, p_brand as value, count(*) as n from part group by 2 union all select 'p_type', p_type, count(*) from part group by 2 union all select 'p_size', p_size::varchar, count(*) from part group by 2")
def _(t):
    return ag.facet_values(t.part, ["p_brand", "p_type", "p_size"])


@query("e14_empty_sources", "select s_suppkey from supplier where s_suppkey%5<>0 and s_acctbal>0 and s_suppkey not in (select l_suppkey from lineitem where l_quantity>=50 and l_discount>=0.09) and s_suppkey not in (select n_nationkey from nation)")
def _(t):
    src = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 5 != 0).alias("active"), (F.col("s_acctbal") > 0).alias("crawled"))
    items = t.lineitem.where("l_quantity >= 50 and l_discount >= 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return ag.empty_sources(src, items, "s_suppkey", t.nation.select(F.col("n_nationkey").cast("long").alias("s_suppkey"))).select("s_suppkey")


@query("e15_cost_breakdown", f"""with {fx.COSTED_SQL}, o as (select coalesce(model,'unknown') as model, operation, count(*) as n, sum(coalesce(case when event_id%2=0 then round(cost_usd*0.9,9) end, cost_usd*0.86812)) as eur, sum(total_tokens) as tokens from costed group by 1,2)
select model, sum(n)::bigint as n, round(sum(eur),4) as eur, sum(tokens)::bigint as tokens, string_agg(operation||':'||n||':'||tokens, ',' order by operation) as operations from o group by 1""")
def _(t):
    ev = fx.costed(t).withColumn("model", F.coalesce("model", F.lit("unknown")))
    ev = ev.withColumn("cost_eur", F.when(F.col("event_id") % 2 == 0, (F.col("cost_usd") * F.lit("0.9").cast("decimal(3,1)")).cast("decimal(18,9)")))
    rows = ag.cost_breakdown(ev, "0.86812")
    ops = F.array_join(F.transform("operations", lambda o: F.concat_ws(":", o["operation"], o["n"], o["tokens"])), ",")
    return rows.select("model", "n", F.round(F.col("eur").cast("double"), 4).alias("eur"), "tokens", ops.alias("operations"))


FORECAST_SQL = """
pool_{s} as (select * from runs where status='done' and duration_ms between 8000 and 1200000 and kind='memo' {p} order by created_at desc, run_id desc limit 15),
tot_{s} as (select count(*) as sample_count, round_even(quantile_cont(duration_ms,0.5),0)::bigint as median_ms, round_even(quantile_cont(duration_ms,0.75),0)::bigint as p75_ms, round_even(quantile_cont(total_tokens,0.5),0)::bigint as median_tokens from pool_{s}),
per_{s} as (select run_id, stage, case when stage='modell' then sum(dur) else max(dur) end as dur from (
  select l.run_id, l.stage, greatest(200, coalesce(lead(l.t) over (partition by l.run_id order by l.t, l.event_id), r.duration_ms)-l.t) as dur from log_rows l join pool_{s} r using (run_id) where l.stage is not null)
  where dur >= 200 group by 1,2),
img_{s} as (select max(t) filter (where event='images_done')-min(t) filter (where event='image_start') as dur from log_rows join pool_{s} using (run_id) group by run_id),
med_{s} as (select stage, round_even(quantile_cont(dur,0.75),0)::bigint as ms from (select stage, dur from per_{s} where stage<>'bilder' union all select 'bilder', dur from img_{s} where dur between 2000 and 900000) group by 1),
f_{s} as (select *, (select string_agg(stage||'='||ms, ',' order by stage) from med_{s}) as stages from tot_{s})"""


def forecast_sql(params: str) -> str:
    return f"""with {fx.RUN_LOG_SQL}, {FORECAST_SQL.format(s='x', p=params)}, {FORECAST_SQL.format(s='k', p='')}
select case when x.sample_count>=3 then x.sample_count else k.sample_count end as sample_count, case when x.sample_count>=3 then x.median_ms else k.median_ms end as median_ms,
 case when x.sample_count>=3 then x.p75_ms else k.p75_ms end as p75_ms, case when x.sample_count>=3 then x.median_tokens else k.median_tokens end as median_tokens,
 case when x.sample_count>=3 then x.stages else k.stages end as stages, case when x.sample_count>=3 then 'exact' when x.sample_count>0 then 'mixed' else 'kind' end as scope from f_x x, f_k k"""


def _forecast(t, params):
    runs, logs = fx.run_tables(t)
    f = rn.duration_forecast(runs, logs, "memo", params)
    return f.withColumn("stages", F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("e16_duration_forecast", forecast_sql("and images='auto'"))
def _(t):
    return _forecast(t, {"images": "auto", "n_events": None})


@query("e16_duration_forecast_kind", forecast_sql("and images='none' and n_events=99999"))
def _(t):
    return _forecast(t, {"images": "none", "n_events": 99999})


@query("e16_forecast_kept_pool", forecast_sql("and images='auto'"))
def _(t):
    # The pool is kept in three batches by run id, so that newer and older runs arrive in any order.
    runs, logs = fx.run_tables(t)
    pool = None
    for batch in range(3):
        pool = written(rn.merge_pool(pool, runs.where(F.pmod(F.xxhash64("run_id"), F.lit(3)) == batch), logs, ["images"]), "pool")
    f = rn.forecast_of_pool(pool, "memo", {"images": "auto"})
    return f.withColumn("stages", F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


PULSE_SQL = f"""{fx.RUN_LOG_SQL}, chg as (select *, case when lag(phase) over w is distinct from phase then 1 else 0 end as c from log_rows window w as (partition by run_id order by t, event_id)),
isl as (select *, sum(c) over (partition by run_id order by t, event_id) as island from chg),
pulses as (select run_id, island, any_value(phase) as phase, min(t) as since, max(t) as t, arg_max(chars,(t,event_id)) as chars, count(*) as pulses from isl group by 1,2)"""


@query("f08_coalesce_pulses", f"with {PULSE_SQL} select run_id, island::bigint as island, phase, since, t, chars, pulses from pulses")
def _(t):
    return wn.coalesce_pulses(fx.run_tables(t)[1])


PACE_SQL = f"""{PULSE_SQL}, pace as (select run_id, coalesce(max(chars*10) filter (where phase='think'),0) as think_chars, coalesce(arg_max(t-since, t) filter (where phase='think'),0) as think_ms,
 coalesce(max(chars*10) filter (where phase='write'),0) as write_chars, coalesce(max(t) filter (where phase='write')-arg_min(since,t) filter (where phase='write'),0) as w from pulses group by 1)"""


@query("e17_pace_summary", f"""with {PACE_SQL} select kind, count(*) as runs, """ + ", ".join(
    f"round(quantile_cont(case when {e}>={low} then {e} end, {q}))::bigint as {c}_{n}" for c, e, low in
    (("think_ms", "think_ms", 5000), ("think_chars", "think_chars", 200), ("write_ms", "(case when w>=1500 then w else 0 end)", 2000), ("write_chars", "write_chars", 200))
    for n, q in (("median", 0.5), ("p75", 0.75))) + " from pace join runs using (run_id) group by 1")
def _(t):
    runs, logs = fx.run_tables(t)
    pace = rn.pace_rows(wn.coalesce_pulses(logs).withColumn("chars", F.col("chars") * 10))
    return rn.pace_summary(pace.join(runs.select("run_id", "kind"), "run_id"))


@query("e18_attempt_rollup", """with a as (select l_suppkey, l_linenumber*10 as discovered, l_linenumber*5 as candidates, l_linenumber as rejected, l_quantity::bigint as inserted, l_returnflag as r1, l_linestatus as r2, l_linenumber as n from lineitem),
b as (select l_suppkey, r1 as reason, n from a union all select l_suppkey, r2, n*2 from a), s as (select l_suppkey, reason, sum(n) as n from b group by 1,2)
select a.l_suppkey, sum(discovered)::bigint as discovered, sum(candidates)::bigint as candidates, sum(rejected)::bigint as rejected, sum(inserted)::bigint as inserted,
 (select string_agg(reason||'='||n, ',' order by reason) from s where s.l_suppkey=a.l_suppkey) as breakdown from a group by 1""")
def _(t):
    n = F.col("l_linenumber").cast("long")
    a = t.lineitem.select("l_suppkey", (n * 10).alias("discovered"), (n * 5).alias("candidates"), n.alias("rejected"), F.col("l_quantity").cast("long").alias("inserted"),
                          F.create_map(F.col("l_returnflag"), n, F.col("l_linestatus"), n * 2).alias("breakdown"))
    out = ag.attempt_rollup(a, ["l_suppkey"])
    return out.withColumn("breakdown", F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("e19_run_progress", """select user_id, count(*) as total, count(*) filter (where event_type in ('purchase','signup','error')) as processed,
 round(count(*) filter (where event_type in ('purchase','signup','error'))*100.0/count(*))::int as percent from events group by 1""")
def _(t):
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "missing").when(F.col("event_type") == "error", "error").otherwise("open")
    return ag.run_progress(t.events.withColumn("state", state), ["user_id"])


@query("e20_capped_tf", f"""with w as (select doc_id, unnest(string_split({norm('text')},' ')) as w from documents), c as (select doc_id, w, count(*) as n from w where w in ('the','and','der','und','les') group by 1,2)
select d.doc_id, coalesce(sum(least(n,8)) filter (where n is not null),0)::bigint as score from documents d left join c using (doc_id) group by 1""")
def _(t):
    from pressgrain.functions.text import capped_hits, tokens

    rows = t.documents.select("doc_id", tokens(norm_text(F.col("text"))).alias("tk"))
    return rows.select("doc_id", capped_hits(F.col("tk"), ["the", "and", "der", "und", "les"], 8).cast("long").alias("score"))


@query("f02_newest_per_key", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)=1")
def _(t):
    return newest_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("f03_newest_n", f"select event_id, {TS.format('ts')} as ts from events order by events.ts desc, event_id desc limit 40")
def _(t):
    return _stamped(wn.newest_n(t.events.select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 40))


@query("f03_newest_n_per_key", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc)<=15")
def _(t):
    return wn.newest_n(t.events, [F.desc("ts"), F.desc("event_id")], 15, ["user_id"]).select("user_id", "event_id")


LINES_SQL = f"""ln as (select doc_id, unnest(string_split(text,chr(10))) as line, unnest(range(0,len(string_split(text,chr(10))))) as pos from documents)"""


def _lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("f04_first_seen", f"""with {LINES_SQL}, k as (select *, {norm('line')} as key from ln) select doc_id, key, pos from k where key<>'' qualify row_number() over (partition by doc_id, key order by pos)=1""")
def _(t):
    rows = _lines(t).select("doc_id", norm_text(F.col("line")).alias("key"), F.col("pos").cast("long").alias("pos")).where("key <> ''")
    return wn.first_seen(rows, ["doc_id"], "key", "pos")


@query("f05_consecutive_runs", f"""with {LINES_SQL}, f as (select *, length(line)>=30 as flag, row_number() over (partition by doc_id order by pos)-row_number() over (partition by doc_id, length(line)>=30 order by pos) as g from ln)
select doc_id, min(pos) as start_pos, max(pos) as end_pos, count(*) as length from f where flag group by doc_id, g having count(*)>=3""")
def _(t):
    rows = _lines(t).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.length("line") >= 30).alias("flag"))
    return wn.consecutive_runs(rows, ["doc_id"], "pos", "flag", 3, slice_rows=8)


BACKLOG_JOBS = ("o_orderkey as job_id, case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status, cast(o_custkey%5 as int) as attempts, "
                "o_orderdate as available_at, o_orderdate + interval 1 hour as updated_at")


@query("f06_backlog", f"""with j as (select {BACKLOG_JOBS} from orders) select job_id, status, attempts from j where (status='queued' and attempts<3) or (status='running' and updated_at < timestamp '1996-01-01' - interval 2 hour)
order by available_at, job_id limit 100""")
def _(t):
    return wn.backlog(t.orders.selectExpr(*fx._split(BACKLOG_JOBS)), F.lit("1996-01-01").cast("timestamp"), 100).select("job_id", "status", "attempts")


@query("f07_last_event", f"with {fx.RUN_LOG_SQL} select run_id, event, max(t) as last_t, arg_max(event_id,(t,event_id)) as last_id from log_rows where event in ('image_start','images_done') group by 1,2")
def _(t):
    return wn.last_event(fx.run_tables(t)[1], ["image_start", "images_done"])


INCIDENT_SQL = f"""p as (select user_id, event_id, ts, event_type='error' as down, coalesce(lag(event_type='error') over (partition by user_id order by ts, event_id), false) as was from events),
c as (select * from p where down<>was), n as (select *, lead(ts) over (partition by user_id order by ts, event_id) as resolved_at from c)"""


@query("f09_incident_intervals", f"with {INCIDENT_SQL} select user_id, {TS.format('ts')} as started_at, {TS.format('resolved_at')} as resolved_at from n where down")
def _(t):
    probes = t.events.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("down"))
    return _stamped(wn.incident_intervals(probes, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "down"))


@query("f10_repeated_keys", "select l_orderkey, l_linenumber, l_returnflag, first_pos from (select *, min(l_linenumber) over (partition by l_orderkey, l_returnflag) as first_pos from lineitem) where l_linenumber>first_pos")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return wn.repeated_keys(rows, ["l_orderkey"], "l_linenumber", "l_returnflag")


ORDERED = "(select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, l_quantity, l_linenumber, l_partkey, l_discount, l_linestatus from lineitem)"


def _ordered(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = t.lineitem.withColumn("one", F.lit(1).cast("long"))
    return running_sum(rows, ["l_orderkey"], order, F.col("l_linenumber"), "one", "pos")


@query("f11_order_violations", f"select l_orderkey, pos, l_quantity, previous from (select *, lag(l_quantity) over (partition by l_orderkey order by pos) as previous from {ORDERED}) where l_quantity<=previous")
def _(t):
    return wn.order_violations(_ordered(t).select("l_orderkey", "pos", "l_quantity"), ["l_orderkey"], "pos", "l_quantity", 3)


@query("f12_top_k", "select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank<=5")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_k(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5)


@query("f13_new_today", "select o_orderkey, o_orderdate::date = date '1998-08-02' as is_new from orders")
def _(t):
    return t.orders.select("o_orderkey", wn.new_today(F.col("o_orderdate"), F.lit("1998-08-02").cast("timestamp")).alias("is_new"))


@query("b32_series_quality", f"""with s as (select *, lag(l_linenumber) over w as pl, lag(l_quantity) over w as pv from {ORDERED} window w as (partition by l_orderkey order by pos)),
g as (select l_orderkey, count(*) as n, count(distinct l_linenumber) as labels, count(distinct l_linestatus) as units, sum(l_quantity) as total, bool_or(coalesce(pl>=l_linenumber,false)) as back, bool_or(coalesce(l_quantity>pv,false)) as up from s group by 1)
select l_orderkey, n, array_to_string(list_filter([case when labels<n then 'labels_repeat' end, case when units>1 then 'units_differ' end, case when back then 'not_ascending' end, case when not total between 99 and 101 then 'shares_not_100' end, case when up then 'funnel_rises' end], lambda x: x is not null),',') as issues from g""")
def _(t):
    rows = _ordered(t).select("l_orderkey", "pos", "l_linenumber", "l_quantity", "l_linestatus")
    q = wn.series_quality(rows, ["l_orderkey"], "pos", "l_linenumber", "l_quantity", "l_linestatus")
    return q.select("l_orderkey", "n", F.array_join("issues", ",").alias("issues"))


@query("b32_waterfall", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_linenumber%2=0 then abs(a+d-e) else least(abs(a+d-e), abs(a-abs(d)-e)) end <= greatest(0.01, abs(a)*0.01) as adds_up
 from (select *, l_quantity as a, l_tax*100 as d, l_quantity - l_tax*100 + l_discount*5 as e from lineitem)""")
def _(t):
    a, d = F.col("l_quantity"), F.col("l_tax") * 100
    e = F.col("l_quantity") - F.col("l_tax") * 100 + F.col("l_discount") * 5
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", wn.waterfall_ok(a, d, e, F.col("l_linenumber") % 2 == 0).alias("adds_up"))


@query("h01_peak_flag", "select event_id, (hour(ts) between 1 and 3 or hour(ts) between 6 and 9) as peak from events")
def _(t):
    return t.events.select("event_id", cost.peak_flag(F.col("ts")).alias("peak"))


@query("h02_rate_lookup", f"with {fx.COSTED_SQL} select event_id, rate_model, peak, r_in::double as r_in, r_cached::double as r_cached, r_out::double as r_out from costed")
def _(t):
    rows = cost.rate_lookup(fx.usage(t), cost.rate_table(t.spark))
    return rows.select("event_id", "rate_model", "peak", *[F.col(c).cast("double").alias(c) for c in ("r_in", "r_cached", "r_out")])


@query("h03_usage_cost", f"with {fx.COSTED_SQL} select event_id, round(cost_usd,9) as cost_usd from costed")
def _(t):
    return fx.costed(t).select("event_id", money("cost_usd", 9))


@query("h04_fx_snapshot", """with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_extendedprice::decimal(12,2)*0.001::decimal(4,3))::decimal(18,9) as usd, case when l_returnflag='R' then 'CNY' else 'USD' end as currency from lineitem),
n as (select *, case when currency='CNY' then (usd*6.896551724::decimal(10,9))::decimal(18,9) else usd end as native, case when currency='CNY' then 0.12861::decimal(9,5) else 0.86812::decimal(9,5) end as rate from x)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, native::double as native_cost, rate::double as native_to_eur, (native*rate)::decimal(18,9)::double as cost_eur from n""")
def _(t):
    usd = (F.col("l_extendedprice").cast("decimal(12,2)") / F.lit(1000)).cast("decimal(18,9)")
    rows = t.lineitem.withColumn("s", cost.fx_snapshot(usd, F.when(F.col("l_returnflag") == "R", "CNY").otherwise("USD"), "6.896551724", "0.12861", "0.86812"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("s.native_cost").cast("double").alias("native_cost"),
                       F.col("s.native_to_eur").cast("double").alias("native_to_eur"), F.col("s.cost_eur").cast("double").alias("cost_eur"))


@query("h06_weighted_score", """with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_returnflag='A' then 0 else least(100,l_quantity*2) end as a, case when l_returnflag='A' then 0 else l_discount*1000 end as b,
 case when l_returnflag='A' then 0 else l_tax*1000 end as c, l_linenumber*10.0 as fb from lineitem),
s as (select *, floor((least(100,a)*25+least(100,b)*30+least(100,c)*25+0)/100+0.5)::int as sc from x) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when sc>0 then sc else fb::int end as score from s""")
def _(t):
    live = F.col("l_returnflag") != "A"
    parts = [F.when(live, F.col("l_quantity") * 2).otherwise(0.0), F.when(live, F.col("l_discount") * 1000).otherwise(0.0),
             F.when(live, F.col("l_tax") * 1000).otherwise(0.0), F.lit(None).cast("double")]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                             cost.weighted_score(parts, [25, 30, 25, 20], F.col("l_linenumber") * 10.0).alias("score"))


@query("h07_remap_category", "select p_partkey, case p_type when 'SMALL' then 'compact' when 'ECONOMY' then 'value' else p_type end as category, p_type in ('SMALL','ECONOMY') as changed from part")
def _(t):
    from pressgrain.operators.tables import remap_category

    return remap_category(t.part.select("p_partkey", F.col("p_type").alias("category")), "category", {"SMALL": "compact", "ECONOMY": "value", "LARGE": "LARGE"})


@query("h08_local_day", f"select event_id, strftime(ts,'%Y-%m-%d') as utc_day, {BERLIN.replace('created_at', 'ts')} as berlin_day from events")
def _(t):
    return t.events.select("event_id", ag.local_day(F.col("ts")).cast("string").alias("utc_day"), ag.local_day(F.col("ts"), "Europe/Berlin").cast("string").alias("berlin_day"))


@query("h09_valid_date", """with x as (select event_id, lpad((event_id%35)::varchar,2,'0')||'.'||lpad((event_id%14)::varchar,2,'0')||'.2024' as s from events)
select event_id, strftime(try_strptime(s,'%d.%m.%Y'),'%d.%m.%Y') = s and try_strptime(s,'%d.%m.%Y') is not null as valid from x""")
def _(t):
    from pressgrain.operators.tables import valid_date

    s = F.concat(F.lpad((F.col("event_id") % 35).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("event_id") % 14).cast("string"), 2, "0"), F.lit(".2024"))
    return t.events.select("event_id", valid_date(s, "dd.MM.yyyy").alias("valid"))


@query("h10_json_ops", """select event_id, json_extract(props,'$.k')::bigint as k, json_exists(props,'$.k') as has_k, json_extract_string(json_merge_patch(props, '{"src":"'||event_type||'"}'),'$.src') as src,
 2 as n_keys, json_extract(props,'$.k')::bigint%2=0 as even from events""")
def _(t):
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("src"), F.col("event_type")))
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_variant_get(F.try_parse_json("props"), "$.k", "int").isNotNull().alias("has_k"), merged.alias("m"))
    return rows.select("event_id", "k", "has_k", F.col("m")["src"].alias("src"), F.size("m").alias("n_keys"), (F.col("m")["k"].cast("int") % 2 == 0).alias("even"))


@query("h11_string_ops", """select p_partkey, regexp_extract(p_brand,'#(\\d+)',1) as brand_no, regexp_replace(p_name,'[aeiou]','','g') as consonants, p_name ilike '%RING%' as ring, p_name like 'small%' as small,
 array_to_string([p_type,p_brand],' / ') as label, left(p_name,5) as head, length(p_name) as chars, lower(trim(' '||p_type||' ')) as low from part""")
def _(t):
    return t.part.select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).alias("brand_no"), F.regexp_replace("p_name", "[aeiou]", "").alias("consonants"), F.col("p_name").ilike("%RING%").alias("ring"),
                         F.col("p_name").like("small%").alias("small"), F.array_join(F.array("p_type", "p_brand"), " / ").alias("label"), F.left("p_name", F.lit(5)).alias("head"), F.length("p_name").alias("chars"),
                         F.lower(F.trim(F.concat(F.lit(" "), "p_type", F.lit(" ")))).alias("low"))


def eta_state(t):
    runs, logs = fx.run_tables(t)
    last = logs.groupBy("run_id").agg(F.max_by(F.struct("t", "stage", "phase", "chars"), F.struct("t", "event_id")).alias("l"),
                                      F.max(F.when(F.col("stage").isNotNull(), F.col("t"))).alias("stage_start"))
    phase = F.when(F.col("l.phase") == "think", "thinking").otherwise("writing")
    pulse = F.struct(phase.alias("phase"), F.col("l.t").alias("t"), F.greatest(F.lit(0), F.col("l.t") - 5000).alias("since"), (F.col("l.chars") * 40).alias("chars"), (F.col("l.chars") * 400).alias("thinking_chars"))
    return runs.join(last, "run_id").select(
        "run_id", "kind", "images", F.coalesce("l.stage", F.lit("bilder")).alias("stage"), (F.col("l.t") + 1000).cast("double").alias("elapsed"),
        F.coalesce("stage_start", F.lit(0)).cast("double").alias("stage_start"), F.when(F.col("run_id") % 3 != 0, pulse).alias("pulse"), F.lit(0.0).alias("forecast_ms"))


def eta(t):
    runs, logs = fx.run_tables(t)
    segs = ag.stage_totals(wn.stage_durations(logs, runs), ["run_id"], "modell").join(runs.select("run_id", "kind"), "run_id")
    segs = written(segs.select("kind", "stage", "dur"), "segments")
    med = ag.to_object(ag.percentiles(segs, ["kind", "stage"], "dur", [0.75], 10_000.0), ["kind"], "stage", "value").withColumnRenamed("object", "stages")
    return rn.eta_remaining(eta_state(t), med)


@query("h12_eta_remaining")
def _(t):
    return eta(t)


@query("h13_progress_pct", f"with {fx.RUN_LOG_SQL} select run_id, greatest(4, least(99, round(n_events*100.0/(n_events+duration_ms//100000))))::int as pct from runs")
def _(t):
    runs, _logs = fx.run_tables(t)
    return runs.select("run_id", rn.progress_pct(F.col("n_events"), F.expr("duration_ms div 100000")).alias("pct"))
