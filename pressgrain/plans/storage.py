"""Queries for sources and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.operators import aggregates as ag, tables as tb
from pressgrain.operators.keyed_table import KeyedTable
from pressgrain.plans import fixtures as fx
from pressgrain.plans.registry import query
from pressgrain.plans.reports import LEDGER_SELECT, LEDGER_SQL, _stamped
from pressgrain.session import work_folder
from pressgrain.sources import pages as pg
from pressgrain.sources.registry import source_policy


@query("a01_scan_pages", "select page_id, url, length(html) as html_chars from pages")
def _(t):
    return pg.scan_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url", F.length("html").alias("html_chars"))


@query("a02_source_policy", """with s as (select s_suppkey, case when s_suppkey%7=0 then 'social' when s_suppkey%3=0 then 'event' when s_suppkey%3=1 then 'corporate_newsroom' else 'editorial' end as source_type from supplier)
select s_suppkey, source_type, case when source_type='event' then '1' else '2' end as max_depth, case when s_suppkey%2=0 then s_suppkey::varchar when source_type='event' then '24' else '40' end as max_pages,
 case source_type when 'event' then 'true' when 'corporate_newsroom' then 'false' end as require_tier1 from s""")
def _(t):
    cat = F.when(F.col("s_suppkey") % 3 == 0, "Events & Messen").when(F.col("s_suppkey") % 3 == 1, "Unternehmen").otherwise("Presse")
    s = t.supplier.select("s_suppkey", cat.alias("category"), F.when(F.col("s_suppkey") % 7 == 0, "social").otherwise("").alias("source_type"),
                          F.when(F.col("s_suppkey") % 2 == 0, F.format_string('{"max_pages":"%d"}', "s_suppkey")).alias("crawl_config"))
    p = source_policy(s)
    return p.select("s_suppkey", "source_type", *[F.try_element_at("policy", F.lit(k)).alias(k) for k in ("max_depth", "max_pages", "require_tier1")])


BROKEN = "regexp_replace(html, '[^\\x00-\\xff]', '?', 'g')"


@query("a03_decode_bytes", f"select page_id, md5({BROKEN}) as decoded_md5 from pages")
def _(t):
    # Latin-1 bytes: with the header's charset, with a declared one, or with none at all (windows-1252 is assumed).
    html = F.regexp_replace("html", r"[^\x00-\xff]", "?")
    raw = F.when(F.col("page_id") % 4 == 0, F.encode(html, "UTF-8")).otherwise(F.encode(html, "ISO-8859-1"))
    header = F.when(F.col("page_id") % 4 == 1, "ISO-8859-1")
    return t.pages.select("page_id", F.md5(pg.decode_bytes(raw, header)).alias("decoded_md5"))


@query("a04_extract_articles")
def _(t):
    a = pg.extract_articles(t.pages)
    return a.select("page_id", "title", "excerpt", "published_at", F.length("content").alias("content_chars"), F.md5("content").alias("content_md5"), "paywall")


@query("a04_titles", """select page_id, trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html,'(?s)<h1[^>]*>(.*?)</h1>',1),'<[^>]+>','','g'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&amp;','&')) as title from pages""")
def _(t):
    return pg.extract_articles(t.pages).select("page_id", "title")


# Pages whose navigation links carry titles and paths long enough to be articles.
LINK_HTML = "regexp_replace(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', '<a href=\"/news/{r}1\">Artikel über {r}2</a><a class=x href=\"/jobs/{r}1/a\">Stellenangebot {r}2</a><a href=\"https://else.example.org/x/{r}1\">Fremder Artikel</a>'{g})"


@query("a05_discover_links", f"""with h as (select page_id, url, regexp_extract(url,'^([a-z]+://[^/?#]+)',1) as origin, {LINK_HTML.format(r=chr(92), g=", 'g'")} as html from pages),
a as (select page_id, origin, unnest(regexp_extract_all(html,'(?s)<a href="(/news/[^">]+)">[^<]*</a>',1)) as href, unnest(regexp_extract_all(html,'(?s)<a href="/news/[^">]+">([^<]*)</a>',1)) as raw,
 unnest(range(0,len(regexp_extract_all(html,'(?s)<a href="(/news/[^">]+)">[^<]*</a>',1)))) as i from h),
d as (select page_id, origin||replace(replace(replace(replace(href,'&lt;','<'),'&gt;','>'),'&quot;','"'),'&amp;','&') as link, trim(regexp_replace(replace(replace(replace(replace(raw,'&lt;','<'),'&gt;','>'),'&quot;','"'),'&amp;','&'),'\\s+',' ','g')) as title, i from a),
u as (select *, row_number() over (partition by page_id, link order by i) as rn from d)
select page_id, row_number() over (partition by page_id order by i)-1 as pos, link, title from u where rn=1 and length(title)>=10 and not regexp_matches(regexp_extract(link,'/news/([^?#]*)',1),'^(news|press)?/?$')""")
def _(t):
    html = F.regexp_replace("html", '<a href="/([^"]*)">([^<]*)</a>',
                            '<a href="/news/$1">Artikel über $2</a><a class=x href="/jobs/$1/a">Stellenangebot $2</a><a href="https://else.example.org/x/$1">Fremder Artikel</a>')
    out = pg.discover_links(t.pages.withColumn("html", html))
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), "link", "title")


@query("a06_scope_urls", """with s as (select page_id, url, page_id%3 as src from pages) select page_id, url from s where (src=0 and regexp_matches(url,'/(en|de)/')) or src=1 or (src=2 and regexp_matches(url,'example\\.(com|org)'))""")
def _(t):
    links = t.pages.select("page_id", "url", (F.col("page_id") % 3).cast("int").alias("src"))
    sources = tb.literal_table(t.spark, [(0, "/(en|de)/"), (1, None), (2, r"example\.(com|org)")], "src int, include_url_pattern string")
    return pg.scope_urls(links, sources, "src", "url").select("page_id", "url")


@query("a07_extract_publication_date", """select page_id, case page_id%6 when 0 then '2024-03-0'||(page_id%9+1) when 1 then '2024-08-03' when 2 then '2024-01-15' when 4 then '2023-12-24' end as published from pages""")
def _(t):
    k = F.col("page_id") % 6
    late = F.lit('<time class="date">01.01.2031</time>')
    box = (
        F.when(k == 0, F.concat(F.lit('<span class="article-date">0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit(".03.2024</span>")))
        .when(k == 1, '<div id="datum">3. August 2024</div>').when(k == 2, F.concat(late, F.lit('<p class="pubdate x">2024-01-15 Uhr</p>')))
        .when(k == 3, '<div class="teaser date">02.02.2024</div>').when(k == 4, '<i class="date">32.13.2024</i><b class="publish-day">24.12.2023</b>')
        .otherwise('<span class="datum">31.02.2024</span>'))
    html = F.concat(F.substring_index("html", "</h1>", 1), F.lit("</h1>"), box, F.expr("substr(html, instr(html, '</h1>') + 5)"))
    return t.pages.select("page_id", pg.extract_publication_date(html, F.lit("2026-01-01").cast("timestamp")).cast("string").alias("published"))


NEW_CUST = "select c_custkey*2 as c_custkey, 'New '||c_name as c_name, c_acctbal+1 as c_acctbal from customer"


def _new(t):
    return t.customer.selectExpr("c_custkey*2 as c_custkey", "concat('New ', c_name) as c_name", "c_acctbal+1 as c_acctbal")


def _cust(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


@query("a08_upsert", f"with n as ({NEW_CUST}) select * from n union all select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from n)")
def _(t):
    return tb.upsert(_cust(t), _new(t), ["c_custkey"])


@query("a09_insert_ignore", f"with n as ({NEW_CUST}) select c_custkey, c_name, c_acctbal from customer union all select * from n where c_custkey not in (select c_custkey from customer)")
def _(t):
    return tb.insert_ignore(_cust(t), _new(t), ["c_custkey"])


@query("a10_update_from", "with s as (select l_orderkey, max(l_extendedprice) as m, case when count(*)>3 then 'X' end as st from lineitem group by 1) select o_orderkey, coalesce(m, o_totalprice) as o_totalprice, coalesce(st, o_orderstatus) as o_orderstatus from orders left join s on l_orderkey=o_orderkey")
def _(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"), F.when(F.count(F.lit(1)) > 3, "X").alias("o_orderstatus"))
    return tb.update_from(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), s, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("a11_delete_using", "select event_id from events where event_id not in (select event_id from events where event_type='error' and value>100)")
def _(t):
    return tb.delete_using(t.events.select("event_id"), t.events.where("event_type = 'error' and value > 100"), ["event_id"])


def _stored(t, rows, keys):
    return KeyedTable(t.spark, work_folder(t.spark, "keyed")).create(rows, keys)


@query("a08_upsert_stored", f"with n as ({NEW_CUST}) select * from n union all select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from n)")
def _(t):
    table = _stored(t, _cust(t), ["c_custkey"])
    table.upsert(_new(t))
    return table.read()


@query("a09_insert_ignore_stored", f"with n as ({NEW_CUST}) select c_custkey, c_name, c_acctbal from customer union all select * from n where c_custkey not in (select c_custkey from customer)")
def _(t):
    table = _stored(t, _cust(t), ["c_custkey"])
    table.insert_ignore(_new(t))
    return table.read()


@query("a10_update_from_stored", "with s as (select l_orderkey, max(l_extendedprice) as m, case when count(*)>3 then 'X' end as st from lineitem group by 1) select o_orderkey, coalesce(m, o_totalprice) as o_totalprice, coalesce(st, o_orderstatus) as o_orderstatus from orders left join s on l_orderkey=o_orderkey")
def _(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"), F.when(F.count(F.lit(1)) > 3, "X").alias("o_orderstatus"))
    table = _stored(t, t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_orderkey"])
    table.update_from(s, ["o_totalprice", "o_orderstatus"])
    return table.read()


@query("a11_delete_using_stored", "select event_id, value from events where event_id not in (select event_id from events where event_type='error' and value>100)")
def _(t):
    table = _stored(t, t.events.select("event_id", "value"), ["event_id"])
    table.delete_using(t.events.where("event_type = 'error' and value > 100"))
    return table.read()


CHANGED = "ts::date in (select distinct ts::date from events where value>300)"


@query("a12_refresh_affected", f"""with {fx.COSTED_SQL}, aff as (select distinct created_at::date as d from usage join events using (event_id) where value>300)
select strftime(created_at,'%Y-%m-%d') as usage_date, coalesce(model,'unknown') as model, operation, status, {LEDGER_SELECT} from costed where created_at::date in (select d from aff) or event_id%2=0 group by 1,2,3,4""")
def _(t):
    facts = ag.ledger_keys(fx.costed(t))
    rebuild = lambda df: df.groupBy(*ag.LEDGER_KEYS).agg(*ag.ledger_measures())
    stale = rebuild(facts.where("event_id % 2 = 0"))
    changed = t.events.where("value > 300").select(F.to_date("ts").alias("usage_date"))
    return _stamped(tb.refresh_affected(stale, facts, changed, "usage_date", rebuild))


@query("a12_rebuild_derived", f"with {fx.COSTED_SQL} {LEDGER_SQL}")
def _(t):
    facts = ag.ledger_keys(fx.costed(t))
    return _stamped(facts.groupBy(*ag.LEDGER_KEYS).agg(*ag.ledger_measures()))


@query("a13_append_snapshot", """select c_custkey, case when v=0 then '2025-01-01' else '2025-02-01' end as as_of, c_name as name from customer, (values (0),(1)) x(v) where v=1 or c_custkey%2=0""")
def _(t):
    cur = t.customer.select("c_custkey", "c_name", "c_acctbal")
    empty = t.spark.createDataFrame([], "c_custkey bigint, as_of string, snapshot string")
    day = lambda d: F.lit(d)
    h = tb.append_snapshot(empty, cur.where("c_custkey % 2 = 0"), ["c_custkey"], day("2025-01-01"))
    h = tb.append_snapshot(h, cur, ["c_custkey"], day("2025-02-01"))
    h = tb.append_snapshot(h, cur, ["c_custkey"], day("2025-02-01"))
    return h.select("c_custkey", "as_of", F.get_json_object("snapshot", "$.c_name").alias("name"))


@query("a14_append_usage", f"""with k as (select event_id, event_type, value, {fx.K_DUCK} as k from events)
select event_id, event_type as operation, case when event_id%3=0 then 'error' when event_id%3=1 then 'success' else 'error' end as status, k*9+k as input_tokens, k as cached_input_tokens, greatest(event_id%7-3,0) as output_tokens, 0 as thinking_tokens,
 case when event_id%2=0 then k*20+1 else k*10+greatest(event_id%7-3,0) end as total_tokens from k""")
def _(t):
    k = F.expr(fx.K_SPARK)
    status = F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 3 == 1, "success").otherwise("odd")
    e = t.events.select("event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("operation"), F.lit("m").alias("model"), status.alias("status"), (k * 9).alias("fresh_input"),
                        k.alias("cached_input"), (F.col("event_id") % 7 - 3).alias("output"), F.lit(None).cast("long").alias("thinking"), F.when(F.col("event_id") % 2 == 0, k * 20 + 1).alias("total"))
    return tb.append_usage(e).drop("created_at", "model")


@query("a15_validate_constraints", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, array_to_string(list_filter([case when not l_quantity between 1 and 45 then 'quantity' end, case when l_returnflag not in ('A','N') then 'flag' end,
 case when l_tax=0 and l_discount=0 then 'cost' end], lambda x: x is not null),',') as violations from lineitem where not l_quantity between 1 and 45 or l_returnflag not in ('A','N') or (l_tax=0 and l_discount=0)""")
def _(t):
    rules = {"quantity": F.col("l_quantity").between(1, 45), "flag": F.col("l_returnflag").isin("A", "N"), "cost": ~((F.col("l_tax") == 0) & (F.col("l_discount") == 0))}
    _good, bad = tb.validate_constraints(t.lineitem, rules)
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array_join("violations", ",").alias("violations"))


@query("a16_literal_table", "select event_type, weight, count(*) as n from events join (values ('click',2),('error',5),('view',1)) v(event_type, weight) using (event_type) group by 1,2")
def _(t):
    seed = tb.literal_table(t.spark, [("click", 2), ("error", 5), ("view", 1)], "event_type string, weight int")
    return t.events.join(seed, "event_type").groupBy("event_type", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("h05_add_counters", """with i as (select l_suppkey, sum(greatest(l_linenumber-2,0)) as n, sum(greatest(l_quantity::bigint,0)) as q from lineitem group by 1)
select s_suppkey, s_nationkey + coalesce(n,0) as requests, coalesce(q,0)::bigint as tokens from supplier left join i on l_suppkey=s_suppkey""")
def _(t):
    target = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("requests"), F.lit(None).cast("long").alias("tokens"))
    inc = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_linenumber") - 2).cast("long").alias("requests"), F.col("l_quantity").cast("long").alias("tokens"))
    return tb.add_counters(target, inc, "s_suppkey", ["requests", "tokens"])
