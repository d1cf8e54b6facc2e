from pyspark.sql import functions as F

from pressgrain.functions import cost, numbers as nb, records as rc
from tests.helpers import evaluate


def test_claimed_numbers(spark):
    got = evaluate(spark, ["25 % in 2025, 1.234 Euro, 13,3 Prozent, am 31.07., 5 Filialen", "Nummer 12345.5"], nb.claimed_numbers)
    assert got == [["25", "1.234", "13,3"], ["12345.5"]]


def test_number_keys(spark):
    got = evaluate(spark, ["1.234 Stück", "13,3 %", "rund 70", "1,234,567", "13.3%", "keine", "7"], nb.number_key)
    assert got == ["1234", "13.3", "70", "1234", "13.3", "", ""]


def test_attestation(spark):
    rows = [("25 %", "im Jahr 2025 wuchs der Markt"), ("25 %", "ein Plus von 25 Prozent"), ("70 Prozent", "siebzig Prozent der Kunden"), ("ein Viertel", "25 Prozent"),
            ("ein Viertel", "fast ein Viertel"), ("zwanzig Prozent", "20 % mehr"), ("1.500 Euro", "1500 Euro"), ("33 %", "")]
    got = evaluate(spark, rows, nb.unattested_claims, ("c", "s"))
    # A bare figure also counts as a literal part of the text; a figure with its unit does not.
    assert got == [[], [], [], ["ein Viertel"], [], [], [], []]


def test_attested_claim_with_unit(spark):
    rows = [("25 %", "im Jahr 2025 wuchs der Markt"), ("25 %", "ein Plus von 25 Prozent"), ("13,3 %", "genau 13,3 Prozent")]
    assert evaluate(spark, rows, lambda c, s: nb.attested(c, nb.corpus_facts(s)), ("c", "s")) == [False, True, True]


def test_snippets_and_leads(spark):
    text = "x" * 60 + " Plus 25 Prozent bei Generation 60+ und 40 Euro " + "y" * 90
    [snips] = evaluate(spark, [text], nb.figures_in_context)
    first = snips[0]["snippet"]
    assert first.startswith("…") and first.endswith("…") and "25 Prozent" in first
    assert evaluate(spark, [text], nb.lead_numbers) == [["25", "40"]]


def test_profile_features(spark):
    rows = ["Anteile: 20 % A, 30 % B, 50 % C und", "Umsatz 2021: 10 Mio, 2022: 20 Mio, 2023: 30 Mio", "Zuerst planen, danach bauen.", "- eins\n- zwei\n- drei"]
    got = evaluate(spark, rows, nb.evidence_profile)
    assert got[1]["has_time_series"] and not got[0]["has_time_series"]
    assert got[2]["has_sequence"] and got[3]["has_list"]
    [triple] = evaluate(spark, ["x"], lambda c: nb._hundred_triple(F.array(F.lit(20.0), F.lit(30.0), F.lit(50.0), F.lit(7.0))))
    assert triple is True


def test_magnitude_and_units(spark):
    got = evaluate(spark, ["1.234,5 Mio. Euro", "-3 %", "2 Mrd", "12 Filialen", "keine"], nb.magnitude)
    assert got == [1234.5e6, -3.0, 2e9, 12.0, None]
    assert evaluate(spark, ["5 €", "7 USD", "3 Prozent", "12 Filialen"], nb.unit_of) == ["eur", "usd", "%", "filialen"]


def test_paraphrase(spark):
    rows = [("Marken gewinnen Vertrauen", "Viele Marken gewannen das Vertrauen"), ("Ganz andere Aussage hier", "Ein Text über Preise"), ("kurz", "")]
    assert evaluate(spark, rows, lambda a, b: nb.paraphrases(a, b, []), ("a", "b")) == [True, False, False]


def test_peak_hours_and_cost(spark):
    times = ["2026-08-20 01:00:00", "2026-08-20 03:59:59", "2026-08-20 04:00:00", "2026-08-20 06:30:00", "2026-08-20 10:00:00", "2026-08-20 23:00:00"]
    assert evaluate(spark, times, lambda c: cost.peak_flag(c.cast("timestamp"))) == [True, True, False, True, False, False]
    ev = spark.createDataFrame([(1, "deepseek-v4-pro", "2026-08-20 12:00:00"), (2, "deepseek-v4-pro", "2026-08-20 02:00:00"), (3, "unheard-of", "2026-08-20 12:00:00"), (4, None, "2026-08-20 12:00:00")],
                               "id int, model string, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    rows = cost.rate_lookup(ev, cost.rate_table(spark))
    million, zero = F.lit(1_000_000).cast("long"), F.lit(0).cast("long")
    rows = rows.select("id", cost.usage_cost(million, zero, million, zero, F.col("r_in"), F.col("r_cached"), F.col("r_out")).alias("usd")).orderBy("id").collect()
    assert [float(r["usd"]) for r in rows] == [2.64, 5.28, 2.64, 2.64]


def test_weighted_score_falls_back(spark):
    weigh = lambda a, b: cost.weighted_score([a, b, F.lit(None).cast("string")], [50, 30, 20], F.lit("37.5"))
    assert evaluate(spark, [("80", "50"), ("0", "x"), ("500", "100")], weigh, ("a", "b")) == [55, 38, 80]


def test_loose_json_and_completion(spark):
    rows = ["```json\n{\"k\": 1}\n```", "Text {\"k\": 2} Ende", "{\"k\": 3, \"n\": \"a\nb\"}", "nichts", "} {"]
    got = evaluate(spark, rows, lambda c: rc.parse_loose_json(c, "k int, n string"))
    assert [g["k"] if g else None for g in got] == [1, 2, 3, None, None] and got[2]["n"] == "a\nb"
    payload = '{"choices":[{"message":{"content":" ok "},"finish_reason":"stop"}],"usage":{"prompt_tokens":100,"prompt_cache_hit_tokens":30,"completion_tokens":50,"completion_tokens_details":{"reasoning_tokens":60}}}'
    [c] = evaluate(spark, [payload], rc.parse_completion)
    assert (c["text"], c["input"], c["cached_input"], c["output"], c["thinking"], c["total"]) == ("ok", 70, 30, 0, 60, 150)


def test_canonical_labels(spark):
    offers = [{"id": "audit", "pillar": "Plan", "label": "Marketing-Audit"}, {"id": "cx", "pillar": "Presence", "label": "Customer Experience"}]
    rows = ["Marketing-Audit", "[Plan] Marketing-Audit + cx", "Leistung: Customer Experience", "Unbekannt", "Marketing-Audit + Unbekannt", "cx; cx", "a + b + c + d", ""]
    got = evaluate(spark, rows, lambda c: rc.canonical_labels(c, offers))
    assert got == ["Marketing-Audit", "Marketing-Audit + Customer Experience", "Customer Experience", "", "", "Customer Experience", "", ""]


def test_title_company(spark):
    rows = ["Neue Chefin bei Muster AG", "Muster AG ernennt neuen Chef | Fachblatt", "Ohne Hinweis"]
    assert evaluate(spark, rows, lambda c: rc.title_company(c, "bei|von|für|at", "ernennt|holt")) == ["Muster AG", "Muster AG", ""]
