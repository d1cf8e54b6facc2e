import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressgrain.functions import dates, text as tx, urls
from tests.helpers import evaluate


def reference_norm(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not 0x300 <= ord(c) <= 0x36F).replace("ß", "ss")
    return re.sub("[^a-z0-9]+", " ", s).strip()


def test_norm_text_folds_like_nfkd(spark):
    samples = ["Käse & Öl", "STRASSE ß", "ﬁne ½ liter", "Ångström naïve", "x²+y³", "ｆｕｌｌ", "été", "a b", "  "]
    assert evaluate(spark, samples, tx.norm_text) == [reference_norm(s) for s in samples]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=40), min_size=1, max_size=30))
def test_norm_text_property(spark, samples):
    assert evaluate(spark, samples, tx.norm_text) == [reference_norm(s) for s in samples]


def test_skeleton_ignores_umlauts_and_broken_characters(spark):
    a, b = evaluate(spark, ["Größere Märkte wachsen", "Gr�ßere M�rkte wachsen"], tx.evidence_skeleton)
    assert a == b == "grsseremrktewachsen"


def test_evidence_needs_twelve_characters_and_containment(spark):
    rows = [("kurz", "kurz und gut"), ("Umsatz stieg um acht Prozent", "Der UMSATZ stieg – um acht Prozent!"), ("nicht im Text enthalten", "anderer Text")]
    assert evaluate(spark, rows, tx.evidence_exists, ("q", "t")) == [False, True, False]


def test_decode_entities_order(spark):
    got = evaluate(spark, ["&auml;&Ouml;&szlig;", "&NBSP;x", "&amp;lt;", "&#65;&#x42;&#1114112;", "&#38;amp;", "a & b &unknown;", "&amp;amp;", "&quot;&apos;&#39;"], tx.decode_entities)
    assert got == ["äÖß", " x", "&lt;", "AB&#1114112;", "&", "a & b &unknown;", "&amp;", "\"''"]


def test_clean_article_text_drops_noise_and_keeps_structure(spark):
    raw = "\n".join([
        "Menü", "", "## Zwischentitel", "Der Umsatz stieg im letzten Jahr deutlich an.", "Copy url", "{{title}}", "Home » News » Artikel",
        "- Punkt eins", "-", "Der Umsatz stieg im letzten Jahr deutlich an!", "", "", "Bitte aktivieren Sie JavaScript, um fortzufahren mit dem Lesen.",
        "<p>Ein zweiter ganzer Satz steht in einem Absatz.</p>", "<script>var x = 1;</script>",
    ])
    [got] = evaluate(spark, [raw], tx.clean_article_text)
    assert got.split("\n") == ["## Zwischentitel", "Der Umsatz stieg im letzten Jahr deutlich an.", "- Punkt eins", "", "Ein zweiter ganzer Satz steht in einem Absatz."]


def test_language_caps_each_word(spark):
    german = "der die das und mit von ist ein " * 2
    english = "the and with for from is are a " * 2
    only_one_word = "the " * 50
    assert evaluate(spark, [german, english, only_one_word, german + english, "kein bezug"], tx.detect_language) == ["de", "en", "en", "other", "other"]


def test_token_similarity(spark):
    rows = [("Neue Kampagne startet 2026 heute", "Kampagne startet heute groß"), ("", "etwas anderes"), ("abc", "abc")]
    got = evaluate(spark, rows, tx.token_similarity, ("l", "r"))
    # Words under four characters and years do not count; "groß" folds to five characters.
    assert (got[0]["shared"], round(got[0]["score"], 3)) == (3, 0.6)
    assert got[1]["score"] == 0 and got[2]["score"] == 0


def test_select_passages_is_a_fold(spark):
    big = "A" * 300 + "."
    blocks = [f"B{i} " + "x" * 50 + "." for i in range(4)] + [big] + ["Die Studie zeigt Ergebnisse zum Markt und zur Marke." * 2] + [f"E{i} " + "y" * 50 + "." for i in range(4)]
    [got] = evaluate(spark, ["\n\n".join(blocks)], lambda c: tx.select_passages(c, 650))
    parts = got.split("\n\n")
    assert big not in parts and any("Studie" in p for p in parts) and parts[0].startswith("B0") and parts[-1].startswith("E3")
    assert [blocks.index(p) for p in parts] == sorted(blocks.index(p) for p in parts)


def test_editorial_core_and_quote(spark):
    lead = "Ein belegter Satz über den Markt. " * 10
    tail = "\nDu willst weiterlesen? " + "Abo " * 40
    [core] = evaluate(spark, [lead + tail], lambda c: tx.editorial_core(c, [r"\n\s*Du willst weiterlesen"]))
    assert core["trimmed"] and core["text"] == lead.strip()
    [short] = evaluate(spark, ["Kurz.\nDu willst weiterlesen? " + "Abo " * 40], lambda c: tx.editorial_core(c, [r"\n\s*Du willst weiterlesen"]))
    assert not short["trimmed"]
    body = lead + "Das ist der letzte\n Satz des Artikels. " + "Fremder Teaser " * 20
    rows = [(body, "Das ist der letzte Satz des Artikels."), (body, "Dieses Zitat steht nirgends im Artikel."), (body, "zu kurz")]
    got = evaluate(spark, rows, tx.core_at_quote, ("b", "q"))
    assert [g["valid"] for g in got] == [True, False, False]
    assert got[0]["text"].endswith("Satz des Artikels.")


def test_truncate_clean(spark):
    got = evaluate(spark, ["Ein Satz ist hier. Danach kommt noch mehr Text", "Markenkommunikation ist lang", "kurz"], lambda c: tx.truncate_clean(c, 24))
    assert got == ["Ein Satz ist hier.", "Markenkommunikation ist", "kurz"]


def test_paywall_flag(spark):
    got = evaluate(spark, ["Bitte Abonnement wählen und weiterlesen", "Abonnement " + "x " * 700 + "weiterlesen", "Sign in to continue", "Freier Text"], tx.paywall_flag)
    assert got == [True, False, True, False]


def test_clamp_and_ids(spark):
    assert evaluate(spark, ["0.4", "7", "-1", "x", "NaN", "Infinity", None], tx.clamp01) == [0.4, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    got = evaluate(spark, [" 0F8FAD5B-D9CB-469F-A165-70867728950E ", "0f8fad5b-d9cb-969f-a165-70867728950e", "x"], tx.valid_id)
    assert got == ["0f8fad5b-d9cb-469f-a165-70867728950e", None, None]


def test_dates(spark):
    got = evaluate(spark, ["Stand 3. August 2026", "05.08.2026", "2026-08-03", "31.02.2026", "32.13.2026", "im März"], dates.parse_date_text)
    assert [str(d) if d else None for d in got] == ["2026-08-03", "2026-08-05", "2026-08-03", None, None, None]


def test_openable_urls(spark):
    given_values = ["https://a.de/x", "//a.de/x", "a.de", "sub.a.de/x", "#", "manual://signal/1", "mailto:x@a.de", "/relativ", " http://a.de "]
    want = ["https://a.de/x", "https://a.de/x".replace("https://", "https://"), "https://a.de", "https://sub.a.de/x", None, None, "mailto:x@a.de", None, "http://a.de"]
    assert evaluate(spark, given_values, urls.openable_url) == want


def test_url_policy(spark):
    got = evaluate(spark, ["http://a.de/x", "https://u:p@a.de/", "https://10.0.0.1/x", "https://172.20.1.1/", "https://cdn.bad.com/logo.svg", "https://ok.com/portrait.jpg", "kein link"],
                   lambda c: urls.url_policy(c, blocked=["bad.com"]))
    assert [g["verdict"] for g in got] == ["not_https", "credentials", "private", "private", "blocked", "ok", "invalid"]
    assert got[4]["path_class"] == "logo" and got[5]["path_class"] == "portrait" and got[5]["file_type"] == "jpg"


def test_url_policy_reads_hosts_that_no_name_rule_admits(spark):
    urls_given = ["https://192.168.0.1003/portrait.jpg", "https://u:p@192.168.0.1003/x", "https://a_b.bad.com:8443/x", "https://192.168.0.1003:443/x", "https://[::1]:443/x"]
    got = evaluate(spark, urls_given, lambda c: urls.url_policy(c, blocked=["bad.com"]))
    assert [g["verdict"] for g in got] == ["private", "credentials", "blocked", "private", "private"]


def test_contains_term_is_whole_phrase(spark):
    got = evaluate(spark, ["der Neue CMO spricht", "cmos", ""], lambda c: tx.contains_term(tx.norm_text(c), F.lit("neue cmo")) | tx.contains_term(tx.norm_text(c), F.lit("")))
    assert got == [True, False, False]
