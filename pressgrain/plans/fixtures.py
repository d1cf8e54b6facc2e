"""Tables derived from the shared ones: usage events, runs and their logs, articles, stored answers, companies.

Each has a Spark form and an SQL form with the same rows, so that operators and oracles read the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K_SPARK = "cast(get_json_object(props,'$.k') as bigint)"
K_DUCK = "json_extract(props,'$.k')::bigint"

USAGE_COLUMNS = """event_id, ts as created_at, user_id as article_id,
  case when event_id%5=0 then null else event_id%7 end as crawl_run_id,
  case event_id%5 when 0 then 'deepseek-v4-pro' when 1 then 'deepseek-v4-flash' when 2 then 'gemini-2.5-flash-lite' when 3 then 'gemini-2.5-flash' end as model,
  event_type as operation, case when event_type='error' then 'error' else 'success' end as status,
  {k}*100 as input_tokens, {k}*10 as cached_input_tokens, cast(floor(value*10) as bigint) as output_tokens,
  event_id%50 as thinking_tokens, {k}*110 + cast(floor(value*10) as bigint) + event_id%50 as total_tokens,
  'simple-v'||(event_id%3)||'.'||(event_id%2) as prompt_version"""
USAGE_SQL = f"usage as (select {USAGE_COLUMNS.format(k=K_DUCK)} from events)"

RATE_SQL = """rates(model, peak, r_in, r_cached, r_out) as (values ('deepseek-v4-pro',false,0.66,0.022,1.98),('deepseek-v4-pro',true,1.32,0.044,3.96),
 ('deepseek-v4-flash',false,0.22,0.007,0.66),('deepseek-v4-flash',true,0.44,0.014,1.32),('gemini-2.5-flash-lite',false,0.1,0.1,0.4),
 ('gemini-2.5-flash-lite',true,0.1,0.1,0.4),('gemini-2.5-flash',false,0.3,0.3,2.5),('gemini-2.5-flash',true,0.3,0.3,2.5))"""
COSTED_SQL = f"""{USAGE_SQL}, {RATE_SQL},
peaked as (select *, (hour(created_at) between 1 and 3 or hour(created_at) between 6 and 9) as peak, coalesce(model,'deepseek-v4-pro') as rate_model from usage),
costed as (select p.*, r.r_in, r.r_cached, r.r_out, round((input_tokens*r_in::double+cached_input_tokens*r_cached::double+(output_tokens+thinking_tokens)*r_out::double)/1e6,9) as cost_usd
 from peaked p join rates r on r.model=p.rate_model and r.peak=p.peak)"""


def usage(t) -> DataFrame:
    return t.events.selectExpr(*_split(USAGE_COLUMNS.format(k=K_SPARK)))


def costed(t) -> DataFrame:
    from pressgrain.functions.cost import rate_lookup, rate_table, usage_cost

    rows = rate_lookup(usage(t), rate_table(t.spark))
    cost = usage_cost(*[F.col(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "thinking_tokens", "r_in", "r_cached", "r_out")])
    return rows.withColumn("cost_usd", cost)


def _split(columns: str) -> list[str]:
    """Split a select list at top-level commas."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(columns[start:i].strip())
            start = i + 1
    return [*parts, columns[start:].strip()]


# One run per user and day; its log has one row per event with the time since the run's start.
RUN_LOG_SQL = """ev as (select *, user_id*100+day(ts) as run_id, epoch_us(ts)//100000 as t_abs from events),
starts as (select run_id, min(t_abs) as t0, min(ts) as created_at, min(user_id) as user_id, max(t_abs) as t9, sum(floor(value*100)::bigint)*10 as duration_ms,
  sum(json_extract(props,'$.k')::bigint)*100 as total_tokens, count(*) as n_events from ev group by 1),
runs as (select run_id, case user_id%3 when 0 then 'memo' when 1 then 'carousel' else 'post' end as kind, case when run_id%11=0 then 'error' else 'done' end as status,
  case when user_id%2=0 then 'auto' else 'none' end as images, created_at, duration_ms::bigint as duration_ms, total_tokens::bigint as total_tokens, user_id, n_events from starts),
log_rows as (select e.run_id, e.event_id, e.t_abs-s.t0 as t, e.value,
  case when event_type='error' then (case when event_id%2=0 then 'image_start' else 'images_done' end) else 'stage' end as event,
  case event_type when 'view' then 'lesen' when 'click' then 'recherchieren' when 'purchase' then 'modell' when 'signup' then 'pruefen' end as stage,
  case when event_id%3=0 then 'think' else 'write' end as phase, json_extract(props,'$.k')::bigint as chars
  from ev e join starts s using (run_id))"""


def run_events(t) -> DataFrame:
    return t.events.selectExpr("*", "user_id*100+day(ts) as run_id", "unix_micros(ts) div 100000 as t_abs")


def run_tables(t) -> tuple[DataFrame, DataFrame]:
    ev = run_events(t)
    starts = ev.groupBy("run_id").agg(
        F.min("t_abs").alias("t0"), F.min("ts").alias("created_at"), F.min("user_id").alias("user_id"),
        (F.sum(F.floor(F.col("value") * 100)) * 10).alias("duration_ms"),
        (F.sum(F.expr(K_SPARK)) * 100).alias("total_tokens"), F.count(F.lit(1)).alias("n_events"))
    runs = starts.selectExpr(
        "run_id", "case user_id%3 when 0 then 'memo' when 1 then 'carousel' else 'post' end as kind",
        "case when run_id%11=0 then 'error' else 'done' end as status",
        "case when user_id%2=0 then 'auto' else 'none' end as images", "created_at",
        "cast(duration_ms as bigint) as duration_ms", "cast(total_tokens as bigint) as total_tokens", "user_id", "n_events")
    logs = ev.join(starts.select("run_id", "t0"), "run_id").selectExpr(
        "run_id", "event_id", "t_abs-t0 as t", "value",
        "case when event_type='error' then (case when event_id%2=0 then 'image_start' else 'images_done' end) else 'stage' end as event",
        "case event_type when 'view' then 'lesen' when 'click' then 'recherchieren' when 'purchase' then 'modell' when 'signup' then 'pruefen' end as stage",
        "case when event_id%3=0 then 'think' else 'write' end as phase", f"{K_SPARK} as chars")
    return runs, logs


# Articles: the first line is the title, host and date follow from source and id.
ARTICLES_SQL = """articles as (select doc_id, split_part(text, chr(10), 1) as title, text as content, lang, source,
  'https://www.'||source||'.example.com/a/'||doc_id as url, date '2024-01-01' + (doc_id%400)::int as published from documents)"""


def articles(t) -> DataFrame:
    return t.documents.selectExpr(
        "doc_id", "split(text, '\n')[0] as title", "text as content", "lang", "source",
        "concat('https://www.', source, '.example.com/a/', doc_id) as url", "date_add(date'2024-01-01', cast(doc_id%400 as int)) as published")


# Companies: per source, the longest first word of its smallest document names a company; the second word is an alias.
COMPANIES_SQL = """comp_base as (select source, arg_min(text, doc_id) as tx from documents where length(text)>=20 group by source),
companies as (select source as company, unnest([regexp_extract(tx,'([A-Za-z]{3,})',1), regexp_extract(tx,'[a-z]\\s+([A-Za-z]{4,})\\s',1)]) as alias from comp_base),
aliases as (select distinct company, trim(regexp_replace(strip_accents(lower(alias)),'[^a-z0-9]+',' ','g')) as alias from companies where length(alias)>=3)"""


def aliases(t) -> DataFrame:
    base = t.documents.where("length(text) >= 20").groupBy("source").agg(F.min_by("text", "doc_id").alias("tx"))
    both = F.array(F.regexp_extract("tx", "([A-Za-z]{3,})", 1), F.regexp_extract("tx", r"[a-z]\s+([A-Za-z]{4,})\s", 1))
    from pressgrain.functions.text import norm_text

    rows = base.select(F.col("source").alias("company"), F.explode(both).alias("alias")).where("length(alias) >= 3")
    return rows.select("company", norm_text(F.col("alias")).alias("alias")).distinct()


# Stored answers: quotes are first sentences, a fixed share lengthened or cut short so that they cannot be proven.
SENTS_DUCK = ("list_filter(list_transform(string_split(regexp_replace(text,'([.!?])\\s+|\\n+','\\1'||chr(1),'g'),chr(1)),"
              "lambda s: regexp_replace(regexp_replace(regexp_replace(s,'^#{1,6}\\s*',''),'^\\s+',''),'\\s+$','')), lambda s: length(s)>=20)")
ANSWER_COLUMNS = """doc_id, case doc_id%5 when 0 then 'keine' when 1 then 'sales' when 2 then 'sales' else 'marketing' end as lane,
  case doc_id%3 when 0 then 'fam_a' when 1 then 'fam_b' else 'fam_d' end as signal_id, round(0.5+(doc_id%50)/100.0D,2) as confidence,
  cast(doc_id*7%101 as int) as score, coalesce(s1,'')||(case doc_id%6 when 5 then ' zusatz' else '' end) as evidence,
  regexp_extract(coalesce(s1,''),'([A-Za-z]{4,})',1) as company, coalesce(s1,'') as company_evidence,
  cast(doc_id*13%101 as int) as a, cast(doc_id*29%101 as int) as b, cast(doc_id*31%101 as int) as c, cast(doc_id*37%101 as int) as d,
  coalesce(length(s2) between 70 and 700, false) as link_ok, s1, s2, s3"""
ANSWERS_SQL = (f"sent as (select doc_id, source, text, s, s[1] as s1, s[2] as s2, s[3] as s3 from (select *, {SENTS_DUCK} as s from documents)),\n"
               f"answers as (select {ANSWER_COLUMNS.replace('100.0D', '100.0::double')} from sent)")


def answers(t) -> DataFrame:
    from pressgrain.functions.text import sentences

    s = t.documents.select("doc_id", sentences(F.col("text")).alias("s"))
    s = s.select("doc_id", *[F.get("s", F.lit(i)).alias(f"s{i + 1}") for i in range(3)])
    return s.selectExpr(*_split(ANSWER_COLUMNS))


def classified(t) -> DataFrame:
    """Nested answers as an advanced classification: arrays of proposals with quotes, uses, routes and values."""
    a = answers(t)
    conf = lambda m, base=0.7: (F.lit(base) + (F.col("doc_id") % m) / 100.0)
    tag = lambda i, c, e: F.struct(F.lit(i).alias("id"), c.alias("confidence"), F.col(e).alias("evidence"))
    drop = lambda *x: F.filter(F.array(*x), lambda v: v["evidence"].isNotNull())
    route = lambda m: F.struct((F.col("doc_id") % m != 0).alias("eligible"), conf(30).alias("confidence"), F.coalesce("s1", F.lit("")).alias("evidence"))
    who = F.struct(F.col("company").alias("name"), F.when(F.col("doc_id") % 7 == 0, "incidental_mention").otherwise("primary_subject").alias("role"),
                   conf(30).alias("confidence"), F.col("s1").alias("evidence"))
    person = F.struct(F.lit("P. Example").alias("name"), F.lit("Director").alias("role"), conf(25, 0.75).alias("confidence"), F.col("s2").alias("evidence"))
    return a.select(
        "doc_id", drop(tag("customer_insights", conf(30), "s1"), tag("marketing_insights", F.lit(0.9), "s2"), tag("unknown_topic", F.lit(0.95), "s1")).alias("topics"),
        drop(who).alias("companies"), drop(person).alias("people"),
        drop(tag("investment", conf(20, 0.8), "s1"), tag("marketing_problem", F.lit(0.91), "s2")).alias("triggers"),
        F.struct((F.col("doc_id") % 4 != 0).alias("publishable"), F.coalesce("s3", F.lit("")).alias("transferable_value"),
                 (F.col("doc_id") % 9 != 0).alias("sufficient_substance"), F.coalesce("evidence", F.lit("")).alias("evidence")).alias("marketing_use"),
        F.struct(F.lit(False).alias("actionable"), F.coalesce("s1", F.lit("")).alias("company_challenge"), F.coalesce("s2", F.lit("")).alias("relevance"),
                 (F.col("doc_id") % 5 != 0).alias("sufficient_substance"), F.array(F.lit("fact")).alias("facts"), F.coalesce("evidence", F.lit("")).alias("evidence")).alias("sales_use"),
        F.struct(route(3).alias("marketing"), route(4).alias("sales")).alias("routes"), (F.col("doc_id") % 2 == 0).alias("transferable"),
        conf(35, 0.65).alias("overall_confidence"), F.when(F.col("doc_id") % 11 == 0, "rejected").when(F.col("doc_id") % 3 == 0, "uncertain").otherwise("reliable").alias("relevance_status"),
        F.when(F.col("doc_id") % 8 == 0, "company_update").when(F.col("doc_id") % 8 == 1, "study").otherwise("news").alias("article_type"),
        F.coalesce("s1", F.lit("")).alias("title_de"), F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("thin"))).otherwise(F.array().cast("array<string>")).alias("rejection_reasons"),
        F.struct(F.col("a").alias("novelty"), F.col("b").alias("strategic_value"), F.col("c").alias("transferability"), F.col("d").alias("evidence_strength")).alias("marketing_value"),
        F.struct(F.col("d").alias("problem_strength"), F.col("c").alias("fit"), F.col("b").alias("buying_intent"), F.col("a").alias("timing")).alias("sales_value"))
