"""Default settings see whole texts: what decides lies behind the limits that callers may set."""

import unicodedata

from pyspark.sql import functions as F

from pressgrain.functions import dates, records as rc, text as tx
from pressgrain.operators import quality as ql
from pressgrain.operators.views import manual_signal
from pressgrain.rules.packs import FIXTURE
from pressgrain.sources import pages as pg
from tests.helpers import evaluate
from tests.test_text import reference_norm


def test_folding_of_all_code_points(spark):
    codes = [c for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    samples = [" ".join("x" + chr(c) + "y" for c in codes[k : k + 500]) for k in range(0, len(codes), 500)]
    bad = []
    for sample, got in zip(samples, evaluate(spark, samples, tx.norm_text)):
        if got != reference_norm(sample):
            bad += [hex(ord(w[1])) for w in sample.split(" ") if len(w) == 3 and reference_norm(w) not in got]
    # Letters whose lower case differs between the Unicode versions of the two languages are not foldings.
    assert len(bad) <= 2, bad[:20]


def test_language_of_the_whole_text(spark):
    late = "wort " * 3000 + "der die das und mit von ist ein " * 2
    assert evaluate(spark, [late], tx.detect_language) == ["de"]
    assert evaluate(spark, [late], lambda c: tx.detect_language(c, first_tokens=2400)) == ["other"]


def test_long_article_is_not_cut(spark):
    long = "\n".join(f"Der Umsatz der Firma Nummer {k} stieg im letzten Jahr deutlich an." for k in range(1500))
    [got] = evaluate(spark, [long], tx.clean_article_text)
    assert got == long and len(long) > 45_000
    assert len(evaluate(spark, [long], lambda c: tx.clean_article_text(c, 100))[0]) == 100


def test_article_type_sees_the_end(spark):
    p = FIXTURE.patterns
    body = "Ein Satz mit mehr als sechzig Zeichen, der nichts weiter sagt als das. " * 400
    assert len(body) > 20_000 and set(p) >= {"study", "method", "finding"}
    short, whole = evaluate(spark, ["a", body], lambda c: ql.article_type(F.lit("x"), c, FIXTURE))
    assert (short, whole) == ("other", "news")


def test_visible_date_behind_a_long_lead(spark):
    text = "x" * 5000 + " 12.03.2024"
    assert str(evaluate(spark, [text], dates.visible_date)[0]) == "2024-03-12"
    assert evaluate(spark, [text], lambda c: dates.visible_date(c, head=1200)) == [None]


def test_charset_and_date_far_into_a_page(spark):
    head = "<!-- " + "x" * 9000 + " --><meta charset=\"iso-8859-15\">"
    raw = spark.createDataFrame([((head + "€").encode("iso-8859-15"),)], "b binary")
    assert raw.select(pg.decode_bytes(F.col("b"), F.lit(None).cast("string"))).first()[0].endswith("€")
    html = "<h1>T</h1>" + "<p>x</p>" * 3000 + '<span class="date">' + " " * 400 + "2024-01-15</span>"
    as_of = F.lit("2024-02-01").cast("timestamp")
    assert str(evaluate(spark, [html], lambda c: pg.extract_publication_date(c, as_of))[0]) == "2024-01-15"
    assert evaluate(spark, [html], lambda c: pg.extract_publication_date(c, as_of, 3000, 6000)) == [None]


def test_all_links_and_the_whole_content(spark):
    links = "".join(f'<a href="/news/artikel-{k}">Ein langer Titel {k}</a>' for k in range(200))
    body = "<article>" + "<p>Ein ganzer Satz steht hier.</p>" * 1500 + "</article>"
    page = spark.createDataFrame([(1, "https://a.example/x", f"<html><body>{links}{body}</body></html>")], "page_id long, url string, html string")
    assert pg.discover_links(page).count() == 200 and pg.discover_links(page, max_per_page=60).count() == 60
    assert len(pg.extract_articles(page).first()["content"]) > 20_000
    assert len(pg.extract_articles(page, content_chars=50).first()["content"]) == 50


def test_profile_keeps_all_and_uses_a_section_once(spark):
    kpi = "struct<label:string,value:string,hint:string,estimated:boolean>"
    schema = f"p struct<kpis:array<{kpi}>,sections:array<struct<title:string,items:array<string>>>,sources:array<struct<title:string,uri:string>>>"
    kpis = [("", "blank first", None, None)] + [(f"Kennzahl {k}", "1" * 50, None, None) for k in range(9)]
    sections = [("Strategie und Ziele", ["a"]), ("Strategie und Ziele neu", [str(k) * 400 for k in range(10)]), ("Markt", ["m"])]
    row = spark.createDataFrame([((kpis, sections, [(f"Quelle {k}", "u") for k in range(20)]),)], schema)
    got = row.select(rc.normalise_profile(F.col("p"), ["Strategie und Ziele", "Strategie und Wege", "Markt"]).alias("r")).first()["r"]
    assert len(got["kpis"]) == 9 and len(got["kpis"][0]["value"]) == 50 and len(got["sources"]) == 20
    assert [(s["title"], len(s["items"])) for s in got["sections"]] == [("Strategie und Ziele", 10), ("Markt", 1)]
    assert len(got["sections"][0]["items"][0]) == 400


def test_labels_and_manual_fields_are_not_cut(spark):
    assert evaluate(spark, ["a_" * 40], lambda c: rc.kicker(c, {"none": "x"})) == [("A " * 40)]
    assert evaluate(spark, ["y" * 500], rc.first_usable) == ["y" * 500]
    entry = spark.createDataFrame([("1", "h" * 300, "c" * 3000)], "entry_id string, headline string, core string")
    entry = entry.select("*", *[F.lit("").alias(c) for c in ("lane", "mode", "relevance", "evidence")])
    assert len(manual_signal(entry).first()["core"]) == 3000
    assert len(manual_signal(entry, {"core": 1200}).first()["core"]) == 1200
