"""Queries for figures, links, names, dates, records and field checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import dates, names, numbers as nb, records as rc, text as tx, urls
from pressgrain.operators import evidence, lint
from pressgrain.plans.registry import query
from pressgrain.plans.sqltext import array, norm
from pressgrain.plans.text import FIRST_LINE, first_line

STOP = ["the", "and", "der", "die", "und", "les", "une", "con"]


@query("b14_evidence_spans")
def b14(t):
    docs = t.documents.select("doc_id", "text")
    sent = tx.sentences(F.col("text"))
    own = docs.select("doc_id", F.posexplode(sent).alias("quote_id", "quote")).select("doc_id", F.col("quote_id").cast("long").alias("quote_id"), "quote")
    return evidence.evidence_spans(docs, own)


@query("b14_segments")
def _(t):
    docs = t.documents.select("doc_id", "text")
    seg = evidence.segments(docs, b14(t))
    return seg.select("doc_id", "segment", "start", "end", F.array_join("quote_ids", ",").alias("quote_ids"))


HOST_SQL = "regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/?#:]+)',1)),'^www\\.','')"
DOMAINS = ["example.com", "ththth.example.net"]


@query("b16_host_domain", f"""
with h as (select page_id, {HOST_SQL} as host from pages)
select page_id, host, list_bool_or(list_transform({array(DOMAINS)}, lambda d: host=d or ends_with(host,'.'||d))) as in_domains,
 (host='example.com' or ends_with(host,'.example.com') or ends_with('example.com','.'||host)) as same_as_example from h""")
def _(t):
    h = t.pages.select("page_id", urls.host_of(F.col("url")).alias("host"))
    return h.select("page_id", "host", urls.domain_match(F.col("host"), DOMAINS).alias("in_domains"),
                    urls.same_domain(F.col("host"), F.lit("example.com")).alias("same_as_example"))


VARIANTS = ("case page_id%6 when 0 then url when 1 then ' '||regexp_replace(url,'^[a-z]+:','')||' ' "
            "when 2 then regexp_replace(url,'^[a-z]+://','') when 3 then 'manual://'||page_id when 4 then '#' else 'mailto:a@b.de' end")


@query("b17_openable_url", f"""
with v as (select page_id, {VARIANTS} as raw from pages)
select page_id, case when trim(raw)='#' or raw like 'manual:%' then null when regexp_matches(trim(raw),'^(https?://|mailto:)') then trim(raw)
 when starts_with(trim(raw),'//') then 'https:'||trim(raw) when regexp_matches(lower(trim(raw)),'^[a-z0-9-]+(\\.[a-z0-9-]+)+(/|$)') then 'https://'||trim(raw) end as link from v""")
def _(t):
    rows = t.pages.selectExpr("page_id", f"{VARIANTS} as raw")
    return rows.select("page_id", urls.openable_url(F.col("raw")).alias("link"))


POLICY_VARIANTS = ("case page_id%5 when 0 then url when 1 then replace(url,'http://','https://') when 2 then 'https://u:p@h.example.com/logo.png' "
                   "when 3 then 'https://192.168.0.'||page_id||'/portrait.jpg' else 'https://cdn.example.org/img/'||page_id||'.webp' end")


@query("b18_url_policy", f"""
with v as (select page_id, {POLICY_VARIANTS} as u from pages), p as (select page_id, u, lower(regexp_extract(u,'^[a-z]+://(?:[^/@]*@)?([^/?#:]+)',1)) as host,
  lower(regexp_extract(u,'^[a-z]+://[^/?#]+([^?#]*)',1)) as path from v)
select page_id, case when not starts_with(u,'https:') then 'not_https' when contains(u,'@') then 'credentials' when starts_with(host,'192.168.') then 'private'
  when host='example.net' or ends_with(host,'.example.net') then 'blocked' else 'ok' end as verdict,
 case when contains(path,'portrait') then 'portrait' when contains(path,'logo') then 'logo' when regexp_matches(path,'\\.(jpe?g|png|webp)$') then 'photo' else 'other' end as path_class,
 regexp_extract(path,'\\.([a-z0-9]{{2,5}})$',1) as file_type from p""")
def _(t):
    rows = t.pages.selectExpr("page_id", f"{POLICY_VARIANTS} as u")
    return rows.select("page_id", urls.url_policy(F.col("u"), blocked=["example.net"]).alias("p")).select("page_id", "p.*")


COMPANY_FORMS = "case s_suppkey%4 when 0 then s_name||' GmbH' when 1 then 'Die '||s_name||' & Co. KG' when 2 then upper(s_name) else s_name||' Holding AG' end"


@query("b19_company_key", f"""
with c as (select s_suppkey, {COMPANY_FORMS} as name from supplier), f as (select *, replace({norm("replace(name,'&',' und ')")},'  ',' ') as n from c)
select s_suppkey, replace(n,' ','') as key_full, array_to_string(list_filter(string_split(n,' '), lambda w: not list_contains({array(names.LEGAL_WORDS)}, w)),'') as key_short,
 replace({norm('name')},' ','-') as slug from f""")
def _(t):
    rows = t.supplier.selectExpr("s_suppkey", f"{COMPANY_FORMS} as name")
    return rows.select("s_suppkey", names.company_key(F.col("name")).alias("key_full"),
                       names.company_key(F.col("name"), names.LEGAL_WORDS).alias("key_short"), names.slug(F.col("name")).alias("slug"))


@query("b20_company_key_match", f"""
with c as (select s_suppkey, lower(regexp_replace(s_name,'[^A-Za-z0-9]','','g')) as k from supplier),
p as (select p_partkey, 'supplier'||lpad((p_partkey//(case when p_partkey%2=0 then 1 else 10 end))::varchar,(case when p_partkey%2=0 then 9 else 8 end),'0') as k from part)
select c.s_suppkey, p.p_partkey, c.k=p.k as exact from c join p on c.k=p.k or starts_with(c.k,p.k) or starts_with(p.k,c.k)""")
def _(t):
    from pressgrain.operators.entities import company_key_match

    left = t.supplier.select("s_suppkey", names.company_key(F.col("s_name")).alias("k"))
    right = t.part.selectExpr(
        "p_partkey", "concat('supplier', lpad(cast(p_partkey div (case when p_partkey%2=0 then 1 else 10 end) as string), case when p_partkey%2=0 then 9 else 8 end, '0')) as k")
    return company_key_match(left, right, "k").select("s_suppkey", "p_partkey", "exact")


FOLD = "replace(replace(replace(replace(lower({x}),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss')"
STEMS = "list_filter(list_transform(string_split_regex(" + FOLD + ",'[^a-z0-9]+'), lambda w: regexp_replace(w,'(en|er|es|te|ten|t|e)$','')), lambda w: length(w)>=4 and not list_contains(" + array(STOP) + ",w))"


PARA_SQL = f"""
with t as (select c.conv_id, c.turn, c.text, p.text as source from conversations c join conversations p on p.conv_id=c.conv_id and p.turn+1=c.turn),
x as (select conv_id, turn, source, trim(regexp_replace({FOLD.format(x='text')},'[^a-z0-9]+',' ','g')) as nt, regexp_replace({FOLD.format(x='source')},'[^a-z0-9]+',' ','g') as ns, {STEMS.format(x='text')} as a, list_distinct({STEMS.format(x='source')}) as b from t),
y as (select *, len(list_filter(a, lambda u: len(list_filter(b, lambda v: starts_with(v,u) or starts_with(u,v)))>0)) as hits, len(a) as n from x)
select conv_id, turn, trim(source)<>'' and ((length(nt)>=18 and contains(ns,nt)) or (n>=2 and len(b)>=2 and (case when n<=3 then hits>=2 else hits/n>=0.55 end))) as paraphrase from y"""


@query("b21_paraphrase_ratio", PARA_SQL)
def _(t):
    turns = t.conversations.select("conv_id", "turn", "text")
    prev = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    rows = turns.join(prev, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", nb.paraphrases(F.col("text"), F.col("source"), STOP).alias("paraphrase"))


@query("b21_content_stems", f"""select conv_id, turn, len(s) as n_stems, array_to_string(list_sort(list_distinct(s)),' ') as stems
from (select conv_id, turn, {STEMS.format(x='text')} as s from conversations)""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", nb.content_stems(F.col("text"), STOP).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("n_stems"),
                       F.array_join(F.array_sort(F.array_distinct("s")), " ").alias("stems"))


def _semantic(x: str) -> str:
    base = f"list_filter(string_split({norm(x)},' '), lambda w: length(w)>=5 and not regexp_matches(w,'^\\d+$') and not list_contains({array(STOP)},w))"
    stems = f"list_filter(list_transform(list_filter({base}, lambda w: length(w)>=7), lambda w: regexp_replace(w,'(ern|en|er|es|em|e|s)$','')), lambda w: length(w)>=5)"
    return f"list_distinct(list_concat({base},{stems}))"


OVERLAP_SQL = f"""with j as (select doc_id, item_id, b.text as claim, d.text as context from documents d join benchmark b on d.doc_id%40=b.item_id),
x as (select doc_id, item_id, {norm('claim')} as c, {norm('context')} as s, list_intersect({_semantic('claim')}, {_semantic('context')}) as shared from j)
select doc_id, item_id, (length(c)>=4 and contains(s,c)) or len(shared)>=2 or len(list_filter(shared, lambda w: length(w)>=8))>0 as overlaps from x"""


@query("b22_semantic_overlap", OVERLAP_SQL)
def _(t):
    b = t.benchmark.select("item_id", F.col("text").alias("claim"))
    rows = t.documents.join(b, F.col("doc_id") % 40 == F.col("item_id"))
    return rows.select("doc_id", "item_id", nb.semantic_overlap(F.col("claim"), F.col("text"), STOP).alias("overlaps"))


@query("b22_semantic_overlap_pairs", f"""with d as (select doc_id, {norm('text')} as s, {_semantic('text')} as ts from documents),
b as (select item_id, {norm('text')} as c, {_semantic('text')} as tc from benchmark),
x as (select doc_id, item_id, c, s, list_intersect(tc, ts) as shared from d, b)
select doc_id, item_id from x where (length(c)>=4 and contains(s,c)) or len(shared)>=2 or len(list_filter(shared, lambda w: length(w)>=8))>0""")
def _(t):
    claims = t.benchmark.select("item_id", F.col("text").alias("claim"))
    return evidence.overlapping_pairs(t.documents.select("doc_id", "text"), claims, STOP)


# Texts with figures, written from the part and order tables.
PRICE = "replace(cast(cast(p_retailprice as decimal(12,2)) as varchar(20)),'.',',')"
CLAIM = f"p_size||' % der Kunden zahlten '||{PRICE}||' Euro, vorher '||(p_partkey+1000)||'; '||(p_partkey%7)||' Filialen, Stand 05.08. 2024, '||(case when p_partkey%3=0 then 'siebzig Prozent' when p_partkey%3=1 then 'ein Viertel' else 'zwanzig  Mio.' end)||' mehr'"


@query("b23_claimed_numbers", f"""
with c as (select p_partkey, {CLAIM} as tx from part),
n as (select p_partkey, list_distinct(regexp_extract_all(tx,'\\d{{1,3}}(?:\\.\\d{{3}})+|\\d+\\.\\d+|\\d+(?:,\\d+)?')) as raw from c),
k as (select p_partkey, list_filter(raw, lambda x: length(regexp_replace(x,'\\D','','g'))>=2 and not regexp_matches(regexp_replace(x,'\\D','','g'),'^(19|20)\\d{{2}}$')
  and not regexp_matches(x,'^(0?[1-9]|[12]\\d|3[01])\\.(0?[1-9]|1[0-2])$')) as ns from n)
select p_partkey, len(ns) as n_claims, array_to_string(list_sort(ns),' ') as claims from k""")
def _(t):
    rows = t.part.selectExpr("p_partkey", f"{CLAIM.replace('varchar(20)', 'string')} as tx")
    rows = rows.select("p_partkey", nb.claimed_numbers(F.col("tx")).alias("ns"))
    return rows.select("p_partkey", F.size("ns").cast("long").alias("n_claims"), F.array_join(F.array_sort("ns"), " ").alias("claims"))


@query("b23_claimed_numbers_documents")
def _(t):
    rows = t.documents.select("doc_id", nb.claimed_numbers(F.col("text")).alias("ns"))
    return rows.select("doc_id", F.size("ns").alias("n_claims"), F.array_join("ns", " ").alias("claims"))


SPOKEN = {"the": "10", "der": "20", "une": "30"}


@query("b24_verbal_numbers", f"""
with m as (select doc_id, regexp_extract_all(text,'(?i)\\b((?:the|der|une)\\s*(?:an|in|de))([^A-Za-z0-9_]|$)',1) as a,
  regexp_extract_all(text,'(?i)\\b((?:un|la)\\s+(?:les|de))\\b',1) as b from documents)
select doc_id, len(list_distinct(list_transform(list_concat(a,b), lambda x: trim(regexp_replace(x,'\\s+',' ','g'))))) as n_verbal from m""")
def _(t):
    v = nb.verbal_numbers(F.col("text"), SPOKEN, "an|in|de", ["les", "de"], ["un", "la"])
    return t.documents.select("doc_id", F.size(v).cast("long").alias("n_verbal"))


KEYED = f"case p_partkey%4 when 0 then {PRICE}||' Prozent' when 1 then '1.'||lpad((p_partkey%1000)::varchar,3,'0')||' Stück' when 2 then (p_partkey%90+10)||'.5%' else 'rund '||p_partkey end"


@query("b25_number_key", f"""
with v as (select p_partkey, {KEYED} as v from part)
select p_partkey, case p_partkey%4 when 0 then replace(regexp_extract(v,'[\\d,]+'),',','.') when 1 then replace(regexp_extract(v,'[\\d.]+'),'.','')
 when 2 then regexp_extract(v,'[\\d.]+') else case when length(regexp_extract(v,'\\d+'))<2 then '' else regexp_extract(v,'\\d+') end end as number_key from v""")
def _(t):
    sql = KEYED.replace("varchar(20)", "string").replace("(p_partkey%1000)::varchar", "cast(p_partkey%1000 as string)")
    return t.part.selectExpr("p_partkey", f"{sql} as v").select("p_partkey", nb.number_key(F.col("v")).alias("number_key"))


@query("b26_unattested_claims")
def _(t):
    ask = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    rows = t.conversations.where("role = 'assistant'").join(ask, ["conv_id", "turn"])
    n = F.col("conv_id") % 90 + 10
    q = F.concat_ws(" ", "q", n.cast("string"), F.lit("% und siebzig Filialen"))
    a = F.concat_ws(" ", "text", (n + F.col("conv_id") % 2).cast("string"), F.lit("Prozent, 70 Filialen, ein Viertel"))
    return rows.select("conv_id", "turn", F.array_join(nb.unattested_claims(a, q), "|").alias("unattested"))


@query("b27_keyword_in_context")
def _(t):
    rows = t.documents.select("doc_id", F.explode(nb.figures_in_context(F.col("text"))).alias("f"))
    return rows.select("doc_id", "f.figure", "f.snippet")


STAT = ("case p_partkey%5 when 0 then p_size||',5 Mio. Euro' when 1 then p_size||' Mrd' when 2 then '-'||p_size||' Prozent' when 3 then '1.'||lpad(cast(p_partkey%1000 as {s}),3,'0')||' Tsd. $' else p_size||' Filialen' end")


@query("b28_magnitude_unit", f"""
with v as (select *, {STAT.format(s='varchar')} as v from part)
select p_partkey, round(case p_partkey%5 when 0 then (p_size+0.5)*1e6 when 1 then p_size*1e9 when 2 then -p_size when 3 then (1000+p_partkey%1000)*1e3 else p_size end::double,3) as magnitude,
 case when p_partkey%5=2 then -p_size::double end as percent, case p_partkey%5 when 0 then 'eur' when 1 then 'mrd' when 2 then '%' when 3 then 'usd' else 'filialen' end as unit from v""")
def _(t):
    rows = t.part.selectExpr("p_partkey", f"{STAT.format(s='string')} as v")
    v = F.col("v")
    return rows.select("p_partkey", F.round(nb.magnitude(v), 3).alias("magnitude"), nb.percent_value(v).alias("percent"), nb.unit_of(v).alias("unit"))


def _profile(t):
    return t.documents.select("doc_id", "source", nb.evidence_profile(F.col("text"), words={
        **nb.PROFILE_WORDS, "sequence": r"\b(the|der|les)\b", "funnel": r"\b(with|mit|avec)\b", "roadmap": r"\b(of|von|de)\b"}).alias("p"))


@query("b29_evidence_profile")
def _(t):
    return _profile(t).select("doc_id", "p.*")


@query("b30_eligible_templates")
def _(t):
    labels = nb.eligible_templates(F.col("p"), F.col("doc_id") % 2 == 0, F.col("source") == "src1")
    return _profile(t).select("doc_id", F.array_join(labels, ",").alias("templates"))


@query("b31_lead_numbers", f"""
with v as (select p_partkey, p_partkey%3 as r, p_size, {PRICE} as price from part)
select p_partkey, array_to_string(list_sort(list_distinct(list_filter([case when p_size>=10 then p_size::varchar end, regexp_replace(price,'\\D','','g'),
  case r when 0 then '70' when 2 then '20' end], lambda x: x is not null))),' ') as leads from v""")
def _(t):
    # Short rows and much work: a file of few row groups would keep most cores idle.
    rows = t.part.repartition(4 * t.spark.sparkContext.defaultParallelism, "p_partkey").selectExpr("p_partkey", f"{CLAIM.replace('varchar(20)', 'string')} as tx")
    return rows.select("p_partkey", F.array_join(F.array_sort(nb.lead_numbers(F.col("tx"))), " ").alias("leads"))


LINT_SQL = f"""
with d as (select doc_id, text, regexp_replace(regexp_replace(text,'^\\s+',''),'\\s+$','') as tr, trim({FIRST_LINE}) as hook from documents),
s as (select *, length(tr) as n, length(hook) as h, len(list_filter(string_split_regex(tr,'[.!?]+(\\s|$)'), lambda x: trim(x)<>'')) as sents,
  len(list_filter(string_split_regex(hook,'[.!?]+(\\s|$)'), lambda x: trim(x)<>'')) as hsents from d),
r as (
select doc_id,'caption' as field,'hook_length' as "check", case when h=0 then 'info' when h<=140 then 'ok' else 'warn' end as severity from s union all
select doc_id,'caption','line_break', case when h>0 and not contains(tr,chr(10)) then 'warn' end from s union all
select doc_id,'caption','length', case when doc_id%2=0 then (case when n<=900 then 'ok' else 'warn' end) when n>3000 then 'warn' when n between 1300 and 2500 then 'ok' else 'info' end from s union all
select doc_id,'caption','question', case when n>200 and not regexp_matches(right(text,220),'(?i)\\?|\\bwie\\b|\\bwas\\b|\\bwelche') then 'info' end from s union all
select doc_id,'headline','length', case when length(hook)<=56 then case when length(hook)=0 then 'info' else 'ok' end else 'info' end from s union all
select doc_id,'headline','one_sentence', case when length(hook)>0 then case when hsents=1 then 'ok' else 'warn' end end from s union all
select doc_id,'core','sentences', case when n=0 then 'info' when sents between 2 and 4 then 'ok' else 'info' end from s)
select * from r where severity is not null"""


@query("b33_text_lint", LINT_SQL)
def _(t):
    docs = t.documents.withColumn("head", first_line())
    return lint.text_lint(docs, "doc_id", {"caption": "text", "headline": "head", "core": "text"}, F.col("doc_id") % 2 == 0, F.lit("marketing"))


@query("b33_text_lint_fields")
def _(t):
    docs = t.conversations.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return lint.text_lint(docs, "id", {"cta": "text", "storyline": "text", "evidence": "text", "source": "text"},
                          F.col("turn") == 0, F.when(F.col("role") == "user", "sales").otherwise("marketing"))


@query("b33_slide_advice", "select o_orderkey, case when n=0 then null when n<6 then 'info' when n>6 then 'warn' else 'ok' end as advice from (select l_orderkey as o_orderkey, count(*) as n from lineitem group by 1)")
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_orderkey", lint.slide_advice(F.col("n"), 6, 6).alias("advice"))


DATE_TEXT = ("case event_id%5 when 0 then 'Stand '||strftime(ts,'%d.%m.%Y') when 1 then strftime(ts,'%Y-%m-%d')||' Uhr' when 2 then 'am '||day(ts)||'. Januar '||year(ts) "
             "when 3 then '31.02.'||year(ts) else 'ohne Datum' end")


@query("b34_parse_date_text", "select event_id, case when event_id%5<3 then strftime(ts,'%Y-%m-%d') end as day from events")
def _(t):
    sql = DATE_TEXT.replace("strftime(ts,'%d.%m.%Y')", "date_format(ts,'dd.MM.yyyy')").replace("strftime(ts,'%Y-%m-%d')", "date_format(ts,'yyyy-MM-dd')")
    rows = t.events.selectExpr("event_id", f"{sql} as x")
    return rows.select("event_id", dates.parse_date_text(F.col("x")).cast("string").alias("day"))


@query("b35_repair_dates", """
with a as (select event_id, event_type, ts, strftime(ts - interval 1 day * ((event_id%300)::int), '%d.%m.%Y') as vis, event_id%4=3 as broken from events)
select event_id, case when broken then strftime(ts,'%Y-%m-%d') else strftime(ts - interval 1 day * ((event_id%300)::int),'%Y-%m-%d') end as published,
 case when not broken and (ts - interval 1 day * ((event_id%300)::int))::date < date '2024-02-01' - interval 6 month then 'legacy' else event_type end as status from a""")
def _(t):
    from pressgrain.operators.tables import repair_dates

    ev = t.events.withColumn("shown", F.expr("ts - make_interval(0,0,0,cast(event_id%300 as int))"))
    content = F.when(F.col("event_id") % 4 == 3, "Ort, 31.02.2024 Text").otherwise(
        F.concat(F.lit("Ort, "), F.date_format("shown", "dd.MM.yyyy"), F.lit(" Text")))
    art = ev.select("event_id", F.to_date("ts").alias("published"), F.col("event_type").alias("status"), content.alias("content"))
    out = repair_dates(art, F.lit("2024-02-01").cast("date"))
    return out.select("event_id", F.col("published").cast("string").alias("published"), "status")


TITLE_SQL = "case p_partkey%4 when 0 then 'Neue Leitung bei '||p_name||' AG' when 1 then p_name||' ernennt neue Leitung | Magazin' when 2 then '„'||p_name||'“ holt Chefin' else 'Nur '||p_name end"


@query("b40_title_company", f"select p_partkey, case p_partkey%4 when 0 then p_name||' AG' when 3 then '' else p_name end as company from part")
def _(t):
    rows = t.part.selectExpr("p_partkey", f"{TITLE_SQL} as title")
    return rows.select("p_partkey", rc.title_company(F.col("title"), "bei|von|fuer|für|at", "ernennt|holt|beruft|appoints").alias("company"))


@query("b41_rule_terms", """
with terms(rule_id, term) as (values ('fam_a','the'),('fam_a','der'),('fam_b','les'),('fam_b','une'),('fam_c','with'),('fam_c','mit'),('fam_d','los'),('fam_d','por')),
w as (select distinct doc_id, unnest(string_split(trim(regexp_replace(strip_accents(replace(lower(text),'ß','ss')),'[^a-z0-9]+',' ','g')),' ')) as term from documents)
select rule_id, term, count(w.doc_id) as n_docs from terms left join w using (term) group by 1,2""")
def _(t):
    from pressgrain.rules.packs import FIXTURE

    spark = t.documents.sparkSession
    terms = spark.createDataFrame([(f.rule_id, w) for f in FIXTURE.families for w in rc.rule_terms(f.trigger)], "rule_id string, term string")
    wanted = [w for f in FIXTURE.families for w in rc.rule_terms(f.trigger)]
    used = t.documents.select("doc_id", F.explode(F.array_distinct(tx.tokens(tx.norm_text(F.col("text"))))).alias("term")).where(F.col("term").isin(wanted))
    counts = used.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "term", "left").select("rule_id", "term", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("b42_parse_loose_json", """select event_id, case when event_id%4=3 then null else json_extract(props,'$.k')::bigint end as k,
 case when event_id%4=3 then null when event_id%4=1 then 'a'||chr(10)||'b' else event_type end as note from events""")
def _(t):
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "note": "'),
                    F.when(F.col("event_id") % 4 == 1, F.lit("a\nb")).otherwise(F.col("event_type")), F.lit('"}'))
    framed = F.when(F.col("event_id") % 4 == 0, body).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Hier:\n```json\n"), body, F.lit("\n```")))
    framed = framed.when(F.col("event_id") % 4 == 2, F.concat(F.lit("Antwort "), body, F.lit(" Ende"))).otherwise("kein Objekt")
    return t.events.select("event_id", rc.parse_loose_json(framed, "k bigint, note string").alias("j")).select("event_id", "j.k", "j.note")


@query("b43_parse_completion", """with k as (select event_id, event_type, json_extract(props,'$.k')::bigint as k from events)
select event_id, event_type as text, case when event_id%3=0 then 'length' else 'stop' end as finish_reason, k*10-k as input, k as cached_input,
 greatest(k*3-(event_id%5)*k,0) as output, (event_id%5)*k as thinking, case when event_id%2=0 then k*20 else k*13 end as total from k""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    usage = F.struct(
        (k * 10).alias("prompt_tokens"), k.alias("prompt_cache_hit_tokens"), (k * 3).alias("completion_tokens"),
        F.when(F.col("event_id") % 2 == 0, k * 20).alias("total_tokens"),
        F.struct(((F.col("event_id") % 5) * k).alias("reasoning_tokens")).alias("completion_tokens_details"))
    choice = F.struct(F.struct(F.concat(F.lit(" "), "event_type").alias("content")).alias("message"),
                      F.when(F.col("event_id") % 3 == 0, "length").otherwise("stop").alias("finish_reason"))
    payload = F.to_json(F.struct(F.array(choice).alias("choices"), usage.alias("usage")))
    return t.events.select("event_id", rc.parse_completion(payload).alias("c")).select("event_id", "c.*")


PROFILE_SQL = """with g as (select l_suppkey, l_returnflag as f, l_linestatus as s from lineitem group by 1,2,3),
p as (select l_suppkey, count(*)::int as n_kpis, array_to_string(list_filter(list_transform(['R','A','N'], lambda x: case when list_contains(list(f),x) then 'Section '||x end), lambda x: x is not null),'|') as sections, count(distinct f)::int as n_sources from g group by 1)
select *, n_kpis>=3 and len(string_split(sections,'|'))>=3 and n_sources>=1 as usable from p"""


@query("b44_normalise_profile", PROFILE_SQL)
def _(t):
    li = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    label = F.concat_ws(" ", "l_returnflag", "l_linestatus")
    per = li.groupBy("l_suppkey").agg(
        F.sort_array(F.collect_list(F.struct(label.alias("label"), F.col("n").cast("string").alias("value"),
                                             F.lit(None).cast("string").alias("hint"), F.lit(None).cast("boolean").alias("estimated")))).alias("kpis"),
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("Section "), "l_returnflag", F.lit(" extra")).alias("title"), F.array(label).alias("items")))).alias("sections"),
        F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), F.lit("https://x.example").alias("uri")))).alias("sources"))
    rows = per.select("l_suppkey", rc.normalise_profile(F.struct("kpis", "sections", "sources"), ["Section R", "Section A", "Section N", "Missing"]).alias("p"))
    return rows.select("l_suppkey", F.size("p.kpis").alias("n_kpis"), F.array_join(F.transform("p.sections", lambda s: s["title"]), "|").alias("sections"),
                       F.size("p.sources").alias("n_sources"), "p.usable")


@query("b45_config_merge_diff", """with k as (select event_id, event_type, json_extract(props,'$.k')::bigint as k from events)
select event_id, 'crawl.days' as path, '183' as before, k::varchar as after from k where k<>183 union all
select event_id, 'quality.profile', 'strict', event_type from k where event_type<>'strict' union all
select event_id, 'extra.flag', null, 'on' from k where event_id%2=0""")
def _(t):
    base = F.lit('{"crawl":{"days":"183","depth":"2"},"quality":{"profile":"strict"},"filters":{"dedupe":"true"}}')
    k = F.get_json_object("props", "$.k")
    over = F.to_json(F.create_map(
        F.lit("crawl"), F.create_map(F.lit("days"), k), F.lit("quality"), F.create_map(F.lit("profile"), F.col("event_type")),
        F.lit("filters"), F.create_map(F.lit("dedupe"), F.lit("false")),
        F.lit("extra"), F.create_map(F.lit("flag"), F.when(F.col("event_id") % 2 == 0, "on"))))
    a, b = rc.flatten_config(base), rc.flatten_config(over)
    merged = rc.config_merge(a, b, {"filters.dedupe": "true"})
    rows = t.events.select("event_id", F.explode(rc.config_diff(a, merged)).alias("d"))
    return rows.where("not (d.path = 'extra.flag' and d.after is null)").select("event_id", "d.*")


@query("b46_candidate_score", f"""with h as (select doc_id, source, lower({FIRST_LINE}) as t, case doc_id%4 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/svg' else null end as mime from documents),
s as (select doc_id, source, case when regexp_matches(t,'\\b(stupid|worthless)\\b') then -20 when mime='image/jpeg' then 5 when mime='image/png' then 3 else -5 end as b, t, mime from h),
z as (select doc_id, source, b + case when b>0 then (case when regexp_matches(t,'\\b(the|der|les)\\b') then 6 else 0 end)+(case when contains(t,'tion') or contains(t,'keit') then 3 else 0 end) else 0 end as score from s),
r as (select *, row_number() over (partition by source order by score desc, doc_id) as rank from z where score>0) select doc_id, source, score, rank from r where rank<=5""")
def _(t):
    from pressgrain.operators.ranking import top_k

    mime = F.element_at(F.array(F.lit("image/jpeg"), F.lit("image/png"), F.lit("image/svg"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    score = rc.candidate_score(first_line(), mime, ["tion", "keit"], r"\b(the|der|les)\b", r"\b(stupid|worthless)\b")
    rows = t.documents.select("doc_id", "source", score.alias("score")).where("score > 0")
    return top_k(rows, ["source"], [F.desc("score"), F.asc("doc_id")], 5)


SENTS = "len(list_filter(string_split_regex(text,'[.!?](\\s|$)'), lambda x: trim(x)<>''))"


@query("b48_link_strength", f"""with x as (select conv_id, turn, text, {SENTS} as s, {norm('text')} as n from conversations)
select conv_id, turn, length(text) between 90 and 900 and s between 2 and 3 and not contains(text,'stupid') and contains(n,'ente') as strong_trigger,
 length(text) between 70 and 700 and not contains(text,'stupid') and regexp_matches(text,'(?:ung|tion|ent)') and (role<>'user' or (s>=2 and contains(n,'ente'))) as concrete_link
from x join conversations using (conv_id, turn, text)""")
def _(t):
    x, company = F.col("text"), F.lit("Ente AG")
    return t.conversations.select("conv_id", "turn", rc.strong_trigger(x, company, "stupid").alias("strong_trigger"),
                                  rc.concrete_link(x, F.when(F.col("role") == "user", "sales").otherwise("marketing"), company, "(?:ung|tion|ent)", "stupid").alias("concrete_link"))
