"""Queries for text normalisation, extraction scalars and evidence tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrain.functions import text as tx
from pressgrain.plans import flagship  # noqa: F401  registers the flagship query
from pressgrain.plans.registry import query
from pressgrain.plans.sqltext import array, norm, skeleton, strip

FIRST_LINE = "split_part(text, chr(10), 1)"


def first_line(col="text"):
    return F.split(F.col(col), "\n")[0]


@query("b01_norm_text", f"select doc_id, md5({norm('text')}) as norm_md5, length({norm('text')}) as norm_len from documents")
def _(t):
    n = tx.norm_text(F.col("text"))
    return t.documents.select("doc_id", n.alias("n")).select(
        "doc_id", F.md5("n").alias("norm_md5"), F.length("n").alias("norm_len"))


@query("b02_evidence_skeleton", f"select doc_id, md5({skeleton('text')}) as skel_md5, length({skeleton('text')}) as skel_len from documents")
def _(t):
    n = tx.evidence_skeleton(F.col("text"))
    return t.documents.select("doc_id", n.alias("n")).select(
        "doc_id", F.md5("n").alias("skel_md5"), F.length("n").alias("skel_len"))


def decode_sql(x: str) -> str:
    for name, char in {**tx.ENTITIES_EXACT, **tx.ENTITIES_ANY_CASE}.items():
        flag = "'g'" if name in tx.ENTITIES_EXACT else "'gi'"
        x = f"regexp_replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}', {flag})"
    return f"regexp_replace({x}, '&amp;', '&', 'gi')"


@query("b03_decode_entities", f"select page_id, md5({decode_sql('html')}) as decoded_md5, length({decode_sql('html')}) as decoded_len from pages")
def _(t):
    return t.pages.select("page_id", tx.decode_entities(F.col("html")).alias("d")).select(
        "page_id", F.md5("d").alias("decoded_md5"), F.length("d").alias("decoded_len"))


@query("b03_numeric_entities", "select doc_id, ascii(text)::bigint as code_point, substr(text,1,1) as decimal_form, substr(text,1,1) as hex_form from documents")
def _(t):
    code = F.ascii(F.col("text"))
    dec = tx.decode_entities(F.concat(F.lit("&#"), code.cast("string"), F.lit(";")))
    hexa = tx.decode_entities(F.concat(F.lit("&#x"), F.hex(code), F.lit(";")))
    return t.documents.select("doc_id", code.cast("long").alias("code_point"), dec.alias("decimal_form"), hexa.alias("hex_form"))


def clean_ctes(source: str, key: str, text: str) -> str:
    """SQL for the line cleaner as window queries over exploded lines; ends in `cleaned(key, text)`."""
    boiler = array(tx.BOILERPLATE_LINES)
    t = f"regexp_replace({decode_sql(text)}, '(?s)<script.*?</script>', ' ', 'gi')"
    t = f"regexp_replace({t}, '(?s)<style.*?</style>', ' ', 'gi')"
    t = f"regexp_replace({t}, '<[^>]+>', chr(10), 'g')"
    squeeze = f"""trim(regexp_replace(regexp_replace(regexp_replace({strip("regexp_replace(raw,'[ \\t]+',' ','g')")},
      '\\*\\*\\s*\\*\\*','','g'), '(^|\\s)\\*{{1,2}}(\\s|$)','\\1\\2','g'),'\\s+',' ','g'))"""
    return f"""
split_rows as (select {key}, string_split({t}, chr(10)) as ls from {source}),
raw_lines as (select {key}, unnest(ls) as raw, unnest(range(1, len(ls)+1)) as pos from split_rows),
lines1 as (select {key}, pos, {strip("raw")} = '' as blank, {squeeze} as line,
  regexp_matches({strip("raw")}, '^\\s*(\\$\\{{[^}}]*\\}}|\\{{\\{{[^}}]*\\}}\\}})\\s*$') as leak from raw_lines),
lines2 as (select *, regexp_replace(regexp_replace(line,'^#{{2,3}}\\s+',''),'^-\\s+','') as body,
  regexp_matches(line,'^#{{2,3}}\\s+') or regexp_matches(line,'^-\\s+') as marked from lines1),
lines3 as (select *, {norm('body')} as key_text, (leak or regexp_matches(line,'^#{{1,6}}\\s*$') or line='-'
   or length(regexp_replace(line,'[*#\\-•·➟>\\s]','','g'))<2 or (regexp_matches(line,'[»›]') and length(line)<160)
   or regexp_matches(lower(line),'\\b(browser is out of date|enable javascript|javascript aktivieren|bitte aktivieren sie javascript|to get the best experience|activez javascript)\\b')
   or list_contains({boiler}, lower(body))
   or (not marked and not regexp_matches(body,'[.!?:”»")]$') and (len(list_filter(string_split_regex(body,'\\s+'), lambda w: w<>''))<=4 or length(body)<30))) as dropped from lines2),
lines4 as (select *, not blank and not dropped and key_text<>'' as keep from lines3),
lines5 as (select *, row_number() over (partition by {key}, keep, case when keep then key_text end order by pos) as nth from lines4),
lines6 as (select {key}, pos, case when blank then '' else line end as line from lines5 where blank or (keep and nth=1)),
cleaned as (select d.{key} as {key}, {strip("regexp_replace(coalesce(string_agg(l.line, chr(10) order by l.pos),''),'\\n{3,}',chr(10)||chr(10),'g')")} as text
  from {source} d left join lines6 l on l.{key}=d.{key} group by d.{key})"""


CLEAN_OUT = "md5(text) as clean_md5, length(text) as clean_len"


@query("b04_clean_article_text", f"with {clean_ctes('documents', 'doc_id', 'text')} select doc_id, {CLEAN_OUT} from cleaned")
def _(t):
    return t.documents.select("doc_id", tx.clean_article_text(F.col("text")).alias("c")).select(
        "doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_len"))


@query("b04_clean_pages", f"with {clean_ctes('pages', 'page_id', 'html')} select page_id, {CLEAN_OUT} from cleaned")
def _(t):
    return t.pages.select("page_id", tx.clean_article_text(F.col("html")).alias("c")).select(
        "page_id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_len"))


@query("b05_detect_language", f"with {flagship.LANGUAGE_CTE} select doc_id, lang, language from lang_rows")
def _(t):
    return t.documents.select("doc_id", "lang", tx.detect_language(F.col("text")).alias("language"))


@query("b06_content_hash", "select doc_id, sha256(text) as content_hash from documents")
def _(t):
    return t.documents.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


NOISE = ["the", "der", "les"]
HEAD_SQL = f"trim(regexp_replace(regexp_replace({norm(FIRST_LINE)}, '\\b(the|der|les)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("b07_canonical_headline", f"select doc_id, {HEAD_SQL} as headline from documents")
def _(t):
    return t.documents.select("doc_id", tx.canonical_headline(first_line(), NOISE).alias("headline"))


TERMS = ["of the", "in", "Für", "que les", ""]


@query("b08_contains_term", "select doc_id, " + ", ".join(
    f"({norm(repr(x))}<>'' and contains(' '||{norm('text')}||' ', ' '||{norm(repr(x))}||' ')) as has_{i}" for i, x in enumerate(TERMS))
    + f", list_bool_or(list_transform({array(TERMS[:3])}, lambda x: contains(' '||{norm('text')}||' ', ' '||{norm('x')}||' '))) as has_any from documents")
def _(t):
    rows = t.documents.select("doc_id", tx.norm_text(F.col("text")).alias("n"))
    return rows.select("doc_id", *[tx.contains_term(F.col("n"), x).alias(f"has_{i}") for i, x in enumerate(TERMS)],
                       tx.contains_any(F.col("n"), TERMS[:3]).alias("has_any"))


@query("b09_keyword_variants", f"""
with fam(family, variant) as (values ('the','the'),('the','that'),('der','der'),('der','die'),('der','das'),('les','les'),('les','la'),('in','en')),
kw as (select distinct unnest(string_split({norm("text")},' ')) as keyword from documents)
select keyword, count(*) as n_variants, string_agg(variant, '|' order by variant) as variants from (
  select keyword, keyword as variant from kw where keyword<>'' union
  select kw.keyword, f2.variant from kw join fam f1 on f1.variant=kw.keyword join fam f2 on f2.family=f1.family)
group by keyword""")
def _(t):
    families = {"the": ["the", "that"], "der": ["der", "die", "das"], "les": ["les", "la"], "in": ["en"]}
    from pressgrain.operators.entities import keyword_variants

    kw = t.documents.select(F.explode(F.split(tx.norm_text(F.col("text")), " ")).alias("keyword")).where("keyword <> ''").distinct()
    out = keyword_variants(kw, families)
    return out.select("keyword", F.size("variants").cast("long").alias("n_variants"),
                      F.array_join(F.array_sort("variants"), "|").alias("variants"))


HEAD_TOKENS = "list_distinct(list_filter(string_split({h},' '), lambda x: length(x)>=4 and not regexp_matches(x,'^20\\d{{2}}$')))"


@query("b10_token_similarity", f"""
with h as (select d.doc_id, {HEAD_TOKENS.format(h=HEAD_SQL)} as a, b.tk as b from documents d
  join (select item_id, {HEAD_TOKENS.format(h=HEAD_SQL)} as tk from (select item_id, text from benchmark)) b on b.item_id = d.doc_id % 40)
select doc_id, len(list_intersect(a,b)) as shared,
  round(case when len(a)=0 or len(b)=0 then 0 else len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))) end, 6) as score from h""")
def _(t):
    head = lambda c: tx.headline_tokens(tx.canonical_headline(F.split(F.col(c), "\n")[0], NOISE))
    b = t.benchmark.select("item_id", F.col("text").alias("btext"))
    rows = t.documents.join(b, F.col("doc_id") % 40 == F.col("item_id"))
    rows = rows.select("doc_id", head("text").alias("a"), head("btext").alias("b"))
    return rows.select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"),
                       F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@query("b10_token_similarity_pairs", f"""
with d as (select doc_id, {HEAD_TOKENS.format(h=HEAD_SQL)} as a from documents), b as (select item_id, {HEAD_TOKENS.format(h=HEAD_SQL)} as b from benchmark)
select doc_id, item_id, len(list_intersect(a,b)) as shared, round(len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))), 6) as score from d, b where len(list_intersect(a,b))>0""")
def _(t):
    from pressgrain.operators.evidence import similar_pairs

    head = tx.headline_tokens(tx.canonical_headline(F.split(F.col("text"), "\n")[0], NOISE)).alias("tokens")
    pairs = similar_pairs(t.documents.select("doc_id", head), t.benchmark.select("item_id", head))
    return pairs.select("doc_id", "item_id", "shared", F.round("score", 6).alias("score"))


@query("b11_select_passages")
def _(t):
    picked = tx.select_passages(F.col("text"), 1500)
    return t.documents.select("doc_id", "n_chars", picked.alias("p")).select(
        "doc_id", F.length("p").alias("picked_len"), F.md5("p").alias("picked_md5"), (F.length("p") < F.col("n_chars")).alias("cut"))


PAY = ("of the .*sh|de la .*on", r"\b(and|und|et)\b", r"\b(with|mit|avec)\b", 600)


@query("b12_paywall_flag", f"""
select page_id, (regexp_matches(n,'{PAY[0]}') or (length(trim(h1))<600 and regexp_matches(n,'{PAY[1]}') and regexp_matches(n,'{PAY[2]}'))) as paywall
from (select page_id, h1, {norm('h1')} as n from (select page_id, regexp_extract(html,'(?s)<article>(.*)</article>',1) as h1 from pages))""")
def _(t):
    part = t.pages.select("page_id", F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("h1"))
    return part.select("page_id", tx.paywall_flag(F.col("h1"), *PAY).alias("paywall"))


BENCH_QUOTE = "split_part(b.text, '.', 1)"


@query("b13_evidence_exists", f"""
with d as (select doc_id, {skeleton('text')} as s from documents),
q0 as (select item_id, unnest(string_split(text,'.')) as quote from benchmark), q as (select item_id, {skeleton('quote')} as k from q0)
select distinct d.doc_id, q.item_id from d join q on length(q.k)>=12 and contains(d.s, q.k)""")
def _(t):
    from pressgrain.operators.evidence import quotes_in_documents

    quotes = t.benchmark.select("item_id", F.explode(F.split("text", "[.]")).alias("quote"))
    return quotes_in_documents(t.documents.select("doc_id", "text"), quotes).select("doc_id", "item_id").distinct()


@query("b15_clamp01", """select vec_id, label, round(greatest(0, least(1, embedding[1]*4))::double, 6) as c0,
  round(greatest(0, least(1, label::double - 3)), 6) as c1, 0.0::double as c2 from embeddings""")
def _(t):
    return t.embeddings.select(
        "vec_id", "label", F.round(tx.clamp01(F.col("embedding")[0] * F.lit(4).cast("float")), 6).alias("c0"),
        F.round(tx.clamp01(F.col("label") - 3), 6).alias("c1"), tx.clamp01(F.concat(F.lit("x"), F.col("label"))).alias("c2"))


MARKERS = [r"\n\s*#{0,3}\s*[Tt]h", r"\n\s*E[nr]", r"(?i)stupid"]
CORE_CTE = """
pos as (select doc_id, src, list_min(list_filter([""" + ",".join(
    f"case when regexp_matches(src,'(?s){m}') then length(regexp_extract(src,'(?s)^(.*?){m}',1)) end" for m in MARKERS) + """],
   lambda p: p is not null)) as ignored, """ + ",".join(
    f"case when regexp_matches(src,'{m}') then length(regexp_extract(src,'(?s)^(.*?){m.replace('(?i)', '(?i:')}{')' if '(?i)' in m else ''}',1)) end as p{i}"
    for i, m in enumerate(MARKERS)) + f""" from (select doc_id, {strip('text')} as src from documents)),
firstp as (select *, (select min(x) from (values (p0),(p1),(p2)) v(x) where x>=80) as fp from pos),
cut as (select *, regexp_replace(substr(src,1,fp),'\\s+$','') as txt from firstp),
core as (select doc_id, src, coalesce(fp is not null and length(txt)>=80 and length(src)-length(txt)>=80, false) as trimmed, txt from cut)"""


@query("b36_editorial_core", f"""with {CORE_CTE}
select doc_id, trimmed, case when trimmed then length(src)-length(txt) else 0 end as removed,
 md5(case when trimmed then txt else src end) as core_md5 from core""")
def _(t):
    core = tx.editorial_core(F.col("text"), MARKERS)
    return t.documents.select("doc_id", core.alias("c")).select(
        "doc_id", "c.trimmed", F.col("c.removed").cast("long").alias("removed"), F.md5("c.text").alias("core_md5"))


QUOTE_CORE_SQL = f"""with s as (select doc_id, {strip('text')} as src, list_filter(list_transform(string_split(regexp_replace(text,'([.!?])\\s+|\\n+','\\1'||chr(1),'g'),chr(1)), lambda x: {strip("regexp_replace(x,'^#{{1,6}}\\s*','')")}), lambda x: length(x)>=20) as st from documents),
q as (select doc_id, src, case when len(st)>=2 then st[len(st)-1] end as q from s),
e as (select *, case when contains(src,q) then instr(src,q)-1+length(q) end as e from q), t as (select *, regexp_replace(substr(src,1,e),'\\s+$','') as txt from e),
o as (select *, coalesce(length(regexp_replace(q,'\\s+',' ','g'))>=30 and length(src)>=220 and e is not null and length(txt)>=220 and length(txt)>=length(src)*0.2 and length(src)-length(txt)>=120, false) as ok from t)
select doc_id, ok as trimmed, ok as valid, md5(case when ok then txt else src end) as core_md5 from o"""


@query("b37_core_at_quote", QUOTE_CORE_SQL)
def _(t):
    sent = tx.sentences(F.col("text"))
    rows = t.documents.select("doc_id", "text", F.get(sent, F.size(sent) - 2).alias("quote"))
    loose = F.regexp_replace("quote", " ", "\n ")
    rows = rows.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("quote")).otherwise(loose).alias("quote"))
    return rows.select("doc_id", tx.core_at_quote(F.col("text"), F.col("quote")).alias("c")).select(
        "doc_id", "c.trimmed", "c.valid", F.md5("c.text").alias("core_md5"))


@query("b38_sentences", """
with s as (select doc_id, string_split(regexp_replace(text,'([.!?])\\s+|\\n+','\\1'||chr(1),'g'), chr(1)) as ls from documents),
x as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(unnest(ls),'^#{1,6}\\s*',''),'^\\s+',''),'\\s+$','')) as st from s)
select doc_id, count(*) as n_sentences, sum(length(st))::bigint as n_chars, min(st) as first_in_order from x where length(st)>=20 group by doc_id""")
def _(t):
    rows = t.documents.select("doc_id", tx.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"),
                       F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"),
                       F.array_min("s").alias("first_in_order"))


@query("b39_truncate_clean", f"""
with x as (select doc_id, trim(regexp_replace(text,'\\s+',' ','g')) as tx from documents),
h as (select *, substr(tx,1,160) as hd, regexp_extract(substr(tx,1,160),'^(.*[.!?])[^.!?]*$',1) as st from x),
b as (select *, case when length(st)>=96 then st when regexp_matches(hd,'\\s') and regexp_replace(hd,'\\s*\\S*$','')<>'' then regexp_replace(hd,'\\s*\\S*$','') else hd end as best from h)
select doc_id, case when length(tx)<=160 then tx else regexp_replace(regexp_replace(best,'[*~]+$',''),'[\\s,;:–-]+$','') end as short from b""")
def _(t):
    return t.documents.select("doc_id", tx.truncate_clean(F.col("text"), 160).alias("short"))


UUID_SQL = "substr(h,1,8)||'-'||substr(h,9,4)||'-'||(case when id%3=0 then '9' else '4' end)||substr(h,14,3)||'-a'||substr(h,18,3)||'-'||substr(h,21,12)"


@query("b47_valid_ids", f"""
with x as (select p_partkey//2 as id, md5((p_partkey//2)::varchar) as h from part), u as (select {UUID_SQL} as raw from x)
select distinct raw as id from u where regexp_matches(raw,'^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$')""")
def _(t):
    ids = t.part.select(F.expr("p_partkey div 2").alias("id")).withColumn("h", F.md5(F.col("id").cast("string")))
    raw = F.concat(F.lit(" "), F.upper(F.concat(
        F.substring("h", 1, 8), F.lit("-"), F.substring("h", 9, 4), F.lit("-"),
        F.when(F.col("id") % 3 == 0, "9").otherwise("4"), F.substring("h", 14, 3), F.lit("-a"),
        F.substring("h", 18, 3), F.lit("-"), F.substring("h", 21, 12))))
    return ids.select(tx.valid_id(raw).alias("id")).where("id is not null").distinct()
