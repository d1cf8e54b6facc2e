from pyspark.sql import functions as F

from pressgrain.operators import catalogue, decisions as dc, quality as ql, rules as rl, runs as rn, views as vw
from pressgrain.rules.packs import MARKETING, Family, Pack
from tests.helpers import evaluate


def test_event_rules(spark):
    rows = ["Auf der Messe zeigt die Studie Daten zum Marketing", "Die Teilnahme am Panel der Konferenz ist möglich", "Ein Bericht über Preise"]
    assert evaluate(spark, rows, lambda c: ql.event_substance(c, MARKETING)) == [True, False, False]
    assert evaluate(spark, rows, lambda c: ql.bare_event(c, MARKETING)) == [False, True, False]


def test_hard_rejections(spark):
    prose = "Die Marke plant eine neue Kampagne mit dem Handel und will damit ihre Kunden besser erreichen. " * 8
    rows = [("FAQ zum Angebot", prose), ("Kampagne startet", prose), ("Kontakt", "kurz"), ("Agenda 2026", prose)]
    got = evaluate(spark, rows, lambda t, x: ql.hard_rejections(t, x, MARKETING, 2026), ("t", "x"))
    assert got[0] == ["faq"] and got[1] == [] and got[2] == ["directory", "no_content"] and got[3] == ["event_program"]


def test_all_caps_and_collections(spark):
    caps = "DIES IST EINE GANZE ZEILE NUR IN GROSSEN BUCHSTABEN GESCHRIEBEN"
    assert evaluate(spark, ["\n".join([caps] * 3), "\n".join([caps, "normal", caps, caps]), "\n\n".join([caps] * 3)], ql.all_caps_run) == [True, False, True]
    kit = "Factsheet\nDownload Logo\nEine kurze Zeile mit vier Worten"
    assert evaluate(spark, [("Pressemappe 2026", kit), ("Artikel", kit)], lambda t, x: ql.is_collection(t, x, MARKETING), ("t", "x")) == [True, False]


def test_capitals_keep_the_number_of_letters(spark):
    from pressgrain.plans.rules import capitals

    line = "ßßßßß ßßßßß ßßßßß abcde abcde abcde abcd"  # 19 letters besides ß, whose capital is none of A to Z
    assert evaluate(spark, ["\n".join([line] * 3), None], lambda c: ql.all_caps_run(capitals(c))) == [False, False]
    assert evaluate(spark, ["Straße ŉ Ä"], capitals) == ["STRAẞE ẞ Ä"]


def test_freshness_bounds(spark):
    as_of = F.lit("2026-08-10 12:00:00").cast("timestamp")
    rows = ["2026-08-11 12:00:00", "2026-08-11 12:00:01", "2026-02-08 12:00:00", "2026-02-08 11:59:59", None]
    assert evaluate(spark, rows, lambda c: ql.freshness(c.cast("timestamp"), as_of)) == [None, "future", None, "too_old", None]


def test_event_participation(spark):
    good = "Frau Anna Beispiel, CMO der Muster AG, spricht auf der Konferenz über Marketing und Kunden."
    far = "Muster AG. " + "x " * 500 + "Frau Anna Beispiel, CMO, spricht auf der Konferenz über Marketing."
    nobody = "Muster AG: der CMO spricht auf der Konferenz über marketing."
    arts = spark.createDataFrame([(1, "t", good), (2, "t", far), (3, "t", nobody)], "doc_id long, title string, content string")
    hits = spark.createDataFrame([(i, "m", "muster ag") for i in (1, 2, 3)], "doc_id long, company string, alias string")
    assert {r["doc_id"] for r in rl.event_participation(arts, hits, MARKETING).collect()} == {1}


def test_prefilter_reasons(spark):
    pack = Pack(families=(Family("f1", "sales", r"\brelaunch\b", r"\bmarke\b"), Family("f2", "marketing", r"\bstudie\b", None, r"\bjobs\b", ("a.de",))), patterns={"sensitive": r"\bkrieg\b"})
    fill = " Text zum Auffüllen der Mindestlänge." * 8
    rows = [(1, "Relaunch", "Die Marke plant den Relaunch." + fill, "https://x.de/1"), (2, "Krieg", "Relaunch der Marke" + fill, "https://x.de/1"), (3, "Kurz", "Relaunch Marke", "https://x.de/1"),
            (4, "Studie", "Neue Studie" + fill, "https://www.news.a.de/1"), (5, "Studie", "Neue Studie" + fill, "https://b.de/1"), (6, "Studie", "Neue Studie zum Krieg" + fill, "https://a.de/1"),
            (7, "Jobs", "Neue Studie" + fill, "https://a.de/1")]
    out = rl.prefilter(spark.createDataFrame(rows, "doc_id long, title string, content string, url string"), pack).orderBy("doc_id").collect()
    assert [(r["families"], r["reject"]) for r in out] == [(["f1"], None), ([], "sensitive"), ([], "too_short"), (["f2"], None), ([], "no_signal_pattern"), ([], "no_signal_pattern"), ([], "no_signal_pattern")]


def test_every_article_is_signal_or_rejected_and_quotes_hold(spark):
    import __spark_entry__ as entry
    from pressgrain.plans import fixtures as fx
    from pressgrain.plans.registry import Tables
    from pressgrain.functions.text import evidence_exists

    t = Tables(spark, "/root/testdata/sf0.001")
    out = entry.queries()["c27_decide_signal"](spark, t.folder)
    assert out.count() == t.documents.count() and out.where("(status = 'signal') = (reject_reason is not null)").count() == 0
    signals = out.where("status = 'signal'").select("doc_id").join(fx.answers(t), "doc_id").join(fx.articles(t), "doc_id")
    assert signals.where(~evidence_exists(F.col("evidence"), F.concat_ws("\n", "title", "content"))).count() == 0


def test_validate_classification(spark):
    text = "Die Muster AG verliert Kunden der Marke und plant deshalb eine neue Ausrichtung. Weitere Sätze folgen hier ohne Belang."
    quote = "Die Muster AG verliert Kunden der Marke"
    tag = "struct<id:string,confidence:double,evidence:string>"
    who = "struct<name:string,role:string,confidence:double,evidence:string>"
    schema = (f"doc_id long, topics array<{tag}>, companies array<{who}>, people array<{who}>, triggers array<{tag}>,"
              "marketing_use struct<publishable:boolean,transferable_value:string,sufficient_substance:boolean,evidence:string>,"
              "sales_use struct<actionable:boolean,company_challenge:string,relevance:string,sufficient_substance:boolean,facts:array<string>,evidence:string>,"
              "routes struct<marketing:struct<eligible:boolean,confidence:double,evidence:string>,sales:struct<eligible:boolean,confidence:double,evidence:string>>,"
              "transferable boolean, overall_confidence double, relevance_status string, article_type string, title_de string, rejection_reasons array<string>")

    def row(i, q, company):
        return (i, [("customer_insights", 0.95, q), ("customer_insights", 0.5, q)], [(company, "primary_subject", 0.95, q)], [], [("marketing_problem", 0.95, q)],
                (False, "", False, ""), (False, "Herausforderung", "passt", True, ["Fakt"], q), ((False, 0.1, ""), (False, 0.1, "")), False, 0.95, "uncertain", "news", "Titel", [])

    answers = spark.createDataFrame([row(1, quote, "Muster AG"), row(2, "Dieses Zitat wurde erfunden und steht nicht da", "Muster AG"), row(3, quote, "Fremde GmbH")], schema)
    arts = spark.createDataFrame([(i, text) for i in (1, 2, 3)], "doc_id long, text string")
    names = spark.createDataFrame([("Muster AG", "Muster AG")], "company string, alias string")
    patterns = {k: "zzz" for k in ("context", "depth", "industrial", "sponsor", "activation", "discount", "campaign")}
    out = dc.validate_classification(answers, arts, names, MARKETING, patterns, {"customer_insights": [r"\bkunden\b"]}, ["customer_insights"], ["marketing_problem"]).orderBy("doc_id").collect()
    assert [(r["status"], len(r["topics"]), len(r["companies"]), len(r["triggers"]), r["sales"]["eligible"]) for r in out] == [
        ("reliable", 1, 1, 1, True), ("uncertain", 0, 0, 0, False), ("uncertain", 1, 0, 1, True)]


def test_classification_policy_recovers_and_restricts(spark):
    rest = "Kunden der Marke erwarten laut der Messung ein Ergebnis von zehn Prozent mehr Umsatz im Handel. "
    text = "Der Pilot mit KI laeuft bei der Muster AG und zeigt bisher kein Resultat fuer die Marke. " + rest + "Die Muster AG spricht auf der Messe ueber die Marke."
    pilot, fair = "Der Pilot mit KI laeuft bei der Muster AG und zeigt bisher kein Resultat", "Die Muster AG spricht auf der Messe ueber die Marke"
    tag = "struct<id:string,confidence:double,evidence:string>"
    who = "struct<name:string,role:string,confidence:double,evidence:string>"
    schema = (f"doc_id long, topics array<{tag}>, companies array<{who}>, people array<{who}>, triggers array<{tag}>, territory {tag},"
              "marketing_use struct<publishable:boolean,transferable_value:string,sufficient_substance:boolean,evidence:string>,"
              "sales_use struct<actionable:boolean,company_challenge:string,relevance:string,sufficient_substance:boolean,facts:array<string>,evidence:string>,"
              "routes struct<marketing:struct<eligible:boolean,confidence:double,evidence:string>,sales:struct<eligible:boolean,confidence:double,evidence:string>>,"
              "transferable boolean, overall_confidence double, relevance_status string, article_type string, title_de string, rejection_reasons array<string>")
    row = lambda i, land: (i, [("ki_performance", 0.95, pilot)], [], [], [("event_participation", 0.95, fair)], (land, 0.95, fair), (False, "Wert", True, "erfundenes Zitat, das fehlt"),
                           (False, "", "", False, [], ""), ((False, 0.1, ""), (False, 0.1, "")), True, 0.95, "uncertain", "news", "Titel", [])
    answers = spark.createDataFrame([row(1, "dach"), row(2, "mars")], schema)
    arts = spark.createDataFrame([(i, text) for i in (1, 2)], "doc_id long, text string")
    names = spark.createDataFrame([("Muster AG", "Muster AG")], "company string, alias string")
    patterns = {k: "zzz" for k in ("context", "depth", "industrial", "sponsor", "activation", "discount", "campaign")}
    policy = dc.Policy(must_not={"ki_performance": r"\bpilot\b"}, any_topic=r"\b(kunden|handel)\b", value=r"\bergebnis\b", infer=(("customer_insights", r"\bkunden\b"),),
                       recover={"fmcg_retail_signale": r"\bhandel\b"}, territories=("dach",))
    fixed = (MARKETING, patterns, {"customer_insights": [r"\bkunden\b"]}, ["ki_performance", "customer_insights"], ["event_participation"])
    plain = dc.validate_classification(answers, arts, names, *fixed).orderBy("doc_id").collect()
    assert [([t["id"] for t in r["topics"]], len(r["triggers"]), r["territory"]) for r in plain] == [(["ki_performance"], 0, None)] * 2
    part = spark.createDataFrame([(1,)], "doc_id long")
    out = dc.validate_classification(answers, arts, names, *fixed, policy=policy, participation=part).orderBy("doc_id").collect()
    assert [[t["id"] for t in r["topics"]] for r in out] == [["customer_insights", "fmcg_retail_signale"]] * 2
    assert [len(r["triggers"]) for r in out] == [1, 0] and [r["territory"] and r["territory"]["id"] for r in out] == ["dach", None]
    assert all(r["marketing_use"]["publishable"] and r["marketing_use"]["evidence"] == rest.strip() for r in out)


def test_directory_pages_and_switches(spark):
    body = "Der Umsatz der Marke stieg im letzten Jahr deutlich an. " * 30
    rows = [("Agenda 2026", body), ("Media", body + " latest news "), ("Titel", body + " tel 030 adresse "), ("Media downloads", body + " read more" * 6), ("Titel", body)]
    got = evaluate(spark, rows, lambda t, x: ql.hard_rejections(t, x, MARKETING, 2026, switched_off=["no_professional_signal"]), ("t", "x"))
    assert [("event_program" in r, "directory" in r) for r in got] == [(True, False), (False, True), (False, True), (False, True), (False, False)]
    assert all("no_professional_signal" not in r for r in got)


def test_offering_rules_stop_at_the_first_match(spark):
    rules = [catalogue.OfferingRule("a", (r"\bmarke\b",)), catalogue.OfferingRule("b", (r"\bmarke\b|\bpreis\b",), ("t",))]
    pick = lambda active: evaluate(spark, ["Marke", "Preis", "Nichts"], lambda c: catalogue.match_offering(c, F.array(F.lit("t")), rules, active))
    assert pick(["a", "b"]) == ["a", "b", None] and pick(["b"]) == [None, "b", None]


def test_run_status(spark):
    rows = [("g1", 1, "error", 10), ("g1", 2, "done", 20), ("g2", 1, "running", 10), ("g2", 2, "error", 20), ("g3", 1, "done", 10), ("g3", 2, "error", 20)]
    df = spark.createDataFrame(rows, "g string, run_id int, status string, ts int")
    got = {r["g"]: (r["run_id"], r["label"], r["tone"]) for r in vw.run_status(df, ["g"]).collect()}
    assert got == {"g1": (2, "none active", "idle"), "g2": (1, "running", "working"), "g3": (2, "failed", "error")}


def test_eta(spark):
    pulse = "struct<phase:string,t:double,since:double,chars:double,thinking_chars:double>"
    rows = [
        (1, "memo", "auto", "modell", 100_000.0, 10_000.0, ("writing", 90_000.0, 80_000.0, 2_700.0, 0.0), 0.0),  # 0.27 chars/ms, 2700 left, 10 s waited
        (2, "memo", "auto", "bilder", 200_000.0, 100_000.0, ("writing", 90_000.0, 80_000.0, 10.0, 0.0), 0.0),  # 55 s over the usual 45 s
        (3, "post", "none", "lesen", 500.0, 0.0, None, 0.0),
        (4, "memo", "auto", "modell", 400_000.0, 10_000.0, ("thinking", 399_000.0, 20_000.0, 0.0, 80_000.0), 0.0),  # thinks too long: stretched
    ]
    state = spark.createDataFrame(rows, f"run_id int, kind string, images string, stage string, elapsed double, stage_start double, pulse {pulse}, forecast_ms double")
    med = spark.createDataFrame([("none", {"x": 1.0})], "kind string, stages map<string,double>")
    got = {r["run_id"]: r["rest_ms"] for r in rn.eta_remaining(state, med).collect()}
    assert got[1] == 0 + 2_500 + 45_000 + 2_500
    assert got[2] == 40_000 + 13_750 + 2_500
    assert got[3] == 77_000 - 500
    assert got[4] == 180_000 + round(110_000 * 0.4)


def test_progress(spark):
    got = evaluate(spark, [("0", "0"), ("10", "90"), ("999", "1"), ("50", "50")], lambda e, r: rn.progress_pct(e.cast("int"), r.cast("int")), ("e", "r"))
    assert got == [4, 10, 99, 50]
