"""Flagship query: why articles drop out, per language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgrain.functions.text import detect_language, norm_text, tokens
from pressgrain.operators.quality import text_quality
from pressgrain.plans.registry import Tables, query
from pressgrain.plans.sqltext import array, norm
from pressgrain.functions.text import ENGLISH_WORDS, GERMAN_WORDS


def reject_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(Tables(spark, folder))


def _profile(t: Tables) -> DataFrame:
    rows = t.documents.select("text")
    quality = text_quality(F.col("text"))
    rows = rows.select(detect_language(F.col("text")).alias("language"), quality.alias("q"),
                       F.size(tokens(norm_text(F.col("text")))).alias("n_tokens"))
    reason = (
        F.when(F.col("q.paywall"), "paywall").when(F.col("q.chars") < 220, "too_short")
        .when(~F.col("q.sufficient"), "thin_text").when(F.col("language") == "other", "language").otherwise("accepted")
    )
    return rows.groupBy("language", reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )


def language_sql(col: str) -> str:
    toks = f"list_filter(string_split({norm(col)},' '), lambda x: x <> '')"
    score = "list_sum(list_transform({w}, lambda w: least(len(list_filter(tk, lambda x: x = w)), 8)))"
    return toks, score.format(w=array(GERMAN_WORDS)), score.format(w=array(ENGLISH_WORDS))


_TOKS, _DE, _EN = language_sql("text")
LANGUAGE_CTE = f"""
toks as (select *, {_TOKS} as tk from documents),
scored as (select *, {_DE} as de, {_EN} as en from toks),
lang_rows as (select *, case when de>=6 and de>=en*1.35 then 'de' when en>=6 and en>=de*1.35 then 'en' else 'other' end as language from scored)
"""
QUALITY_CTE = f"""
qual as (select *, {norm('text')} as n, length(text) as chars,
  len(list_filter(string_split_regex(text,'\\s+'), lambda x: regexp_matches(x,'[A-Za-zÄÖÜäöüß]'))) as words,
  len(regexp_extract_all(text,'[.!?]([”»"'')\\]]|\\s|$)')) as sents from lang_rows),
judged as (select *, (regexp_matches(n,'jetzt angebot wahlen und weiterlesen|noch kein .*abonnement|nur fur abonnenten|artikel ist kostenpflichtig|weiterlesen mit .*abo|subscribe to (continue|read)|sign in to continue|already a subscriber|remaining article')
   or (length(trim(text))<1200 and regexp_matches(n,'\\b(abonnent|abonnement|subscription|subscribe|premium)\\b') and regexp_matches(n,'\\b(weiterlesen|vollstandigen artikel|continue reading|read more|sign in|login|anmelden)\\b'))) as paywall from qual),
quality as (select *, (not paywall and ((chars>=500 and words>=70 and sents>=3) or (chars>=430 and words>=75 and sents>=5))) as sufficient from judged)
"""

query("flagship_reject_profile", f"""
with {LANGUAGE_CTE}, {QUALITY_CTE}
select language, case when paywall then 'paywall' when chars<220 then 'too_short' when not sufficient then 'thin_text'
  when language='other' then 'language' else 'accepted' end as reason, count(*) as n_docs,
  sum(len(list_filter(string_split(n,' '), lambda x: x<>'')))::bigint as n_tokens
from quality group by 1,2
""")(_profile)
