"""Stored model answers checked against their articles: routes, companies, scores, review and final signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.functions.cost import weighted_score
from pressgrain.functions.records import title_company
from pressgrain.functions.text import EVIDENCE_MIN, clamp01, contains_term, evidence_exists, evidence_skeleton, norm_text, sentences
from pressgrain.operators.rules import infer_topic, recover_evidence, topic_context, unresolved_problem
from pressgrain.rules.packs import Pack
from pressgrain.scale import broadcast_if_small

# Thresholds, weights and caps of routes and scores.
ROUTE_THRESHOLD, MIN_CONFIDENCE, MIN_SCORE = 0.88, 0.7, 45
MARKETING_WEIGHTS, SALES_WEIGHTS = (25, 30, 25, 20), (32, 30, 23, 15)
BROAD_TRIGGERS = ["acquisition", "merger", "market_entry", "market_expansion", "investment"]
CONTEXT_TRIGGERS = [*BROAD_TRIGGERS, "restructuring", "portfolio_change", "rebranding", "campaign_launch",
                    "event_participation", "marketing_problem"]
EVIDENCED_TYPES = ["study", "whitepaper", "report", "analysis", "case_study"]
QUALITY = {"topic": 0.82, "company": 0.86, "person": 0.86, "trigger": 0.86, "route": 0.88, "reliable": 0.9, "review_below": 0.9}


def in_text(skeleton: Column, quote: Column) -> Column:
    """Quote in a text whose skeleton is already known."""
    needle = evidence_skeleton(F.coalesce(quote, F.lit("")))
    return (F.length(needle) >= EVIDENCE_MIN) & F.contains(skeleton, needle)


def validate_route(eligible: Column, confidence: Column, evidence: Column, text: Column, threshold: float = ROUTE_THRESHOLD) -> Column:
    """Struct of eligible, confidence and evidence; without a proven quote the route and its quote are cleared."""
    conf = clamp01(confidence)
    ok = eligible & (conf >= threshold) & evidence_exists(evidence, text)
    return F.struct(ok.alias("eligible"), conf.alias("confidence"), F.when(ok, F.trim(evidence)).otherwise("").alias("evidence"))


def sales_opportunity(use: Column, route: Column, triggers: Column, context: str, operational: str) -> Column:
    """Complete and actionable sales case that is no mere campaign; broad triggers need an advisory context."""
    ids = F.transform(triggers, lambda t: t["id"])
    quotes = F.concat_ws(" ", route["evidence"], use["evidence"], F.array_join(F.transform(triggers, lambda t: t["evidence"]), " "))

    def verdict(n: Column) -> Column:
        has_context = n.rlike(context)
        all_of = lambda test: F.forall(ids, test)
        broad = all_of(lambda i: i.isin(*BROAD_TRIGGERS))
        independent = F.exists(ids, lambda i: ~i.isin(*CONTEXT_TRIGGERS))
        operational_only = all_of(lambda i: i == "investment") & n.rlike(operational) & ~has_context
        return ~operational_only & F.when(broad, has_context).otherwise(independent | has_context)

    filled = (
        route["eligible"] & (route["evidence"] != "") & use["actionable"] & (use["evidence"] != "") & (use["company_challenge"] != "")
        & (use["relevance"] != "") & use["sufficient_substance"] & (F.size(use["facts"]) > 0)
        & (F.size(triggers) > 0) & ~F.forall(ids, lambda i: i == "campaign_launch")
    )
    return filled & F.transform(F.array(norm_text(quotes)), verdict)[0]


def needs_review(status: Column, confidence: Column, marketing: Column, sales: Column, sales_conflict: Column,
                 marketing_conflict: Column, sales_value: Column, quality: Mapping[str, float] = QUALITY, high_value: int = 65) -> Column:
    """Second look for evidenced answers just below the threshold, conflicts there, and valuable sales cases."""
    limit = min(quality["review_below"], quality["reliable"])
    near = (confidence >= max(0.0, limit - 0.08)) & (confidence < limit)
    proven = lambda r: r["eligible"] & (F.trim(r["evidence"]) != "")
    missing = lambda r: r["eligible"] & (F.trim(r["evidence"]) == "")
    any_proof = proven(marketing) | proven(sales)
    borderline = (status == "uncertain") & near & any_proof
    conflict = near & any_proof & (missing(marketing) | missing(sales) | sales_conflict | marketing_conflict)
    valuable = sales["eligible"] & (sales_value >= high_value) & near
    return (status != "rejected") & (borderline | conflict | valuable)


def calibrate_scores(m: Column, s: Column, text: Column, article_type: Column, marketing: Column, sales: Column,
                     offering: Column, triggers: Column, patterns: Mapping[str, str]) -> Column:
    """Struct of marketing and sales scores: weighted parts, then caps in order; components may get floors first."""
    def rounded(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(100), F.round(x).cast("int")))

    def mix(struct: Column, names: Sequence[str], weights: Sequence[int]) -> Column:
        return rounded(sum((struct[n] * (w / 100) for n, w in zip(names, weights)), F.lit(0.0)))

    def score(n: Column) -> Column:
        a = mix(m, ["novelty", "strategic_value", "transferability", "evidence_strength"], MARKETING_WEIGHTS)
        a = F.when(marketing, a).otherwise(0)
        a = F.when(n.rlike(patterns["tracker"]) & (m["novelty"] < 70), F.least(a, F.lit(69))).otherwise(a)
        a = F.when(article_type.isin(*EVIDENCED_TYPES), a).otherwise(F.least(a, F.lit(84)))
        top = (m["novelty"] >= 95) & (m["strategic_value"] >= 95) & (m["evidence_strength"] >= 90)
        a = F.when((a == 100) & ~top, 99).otherwise(a)
        has = offering.isNotNull()
        price = F.coalesce(offering == "purpose_value_proposition", F.lit(False)) & n.rlike(patterns["price"]) & n.rlike(patterns["because"])
        parts = F.struct(
            F.when(price, F.greatest(s["problem_strength"], F.lit(60))).otherwise(s["problem_strength"]).alias("problem_strength"),
            F.when(price, F.greatest(s["fit"], F.lit(85))).otherwise(s["fit"]).alias("fit"),
            F.when(price, F.least(s["buying_intent"], F.lit(10))).otherwise(s["buying_intent"]).alias("buying_intent"),
            F.when(price, F.greatest(s["timing"], F.lit(55))).otherwise(s["timing"]).alias("timing"))
        b = F.when(sales & has, mix(parts, ["problem_strength", "fit", "buying_intent", "timing"], SALES_WEIGHTS)).otherwise(0)
        help_wanted = n.rlike(patterns["help"])
        problem = n.rlike(patterns["problem"]) & n.rlike(patterns["problem_context"]) & ~n.rlike(patterns["resolved"])
        broad = (F.size(triggers) > 0) & F.forall(triggers, lambda t: t.isin(*BROAD_TRIGGERS))
        creative = n.rlike(patterns["creative"]) & ~n.rlike(patterns["strategic"])
        b = F.when(creative, F.least(b, F.lit(25))).otherwise(b)
        b = F.when(broad & ~problem, F.least(b, F.lit(59))).otherwise(b)
        b = F.when(help_wanted, b).otherwise(F.least(b, F.when(problem & has, 89).otherwise(79)))
        b = F.when((b == 100) & ~(help_wanted & problem & has), 99).otherwise(b)
        return F.struct(a.alias("marketing"), b.alias("sales"))

    return F.transform(F.array(norm_text(text)), score)[0]


def transferable_substance(article_type: Column, text: Column, topics: Column, use: Column, pack: Pack, patterns: Mapping[str, str],
                           topic_rules: Mapping[str, Sequence[str]]) -> Column:
    """Whether an article carries an insight that others can use: topic context, depth, research and promotion rules."""
    inputs = F.struct(
        norm_text(F.concat_ws(" ", use["evidence"], use["transferable_value"])).alias("c"), norm_text(text).alias("a"),
        F.filter(topics, lambda t: topic_context(t["id"], t["evidence"], topic_rules)).alias("direct"),
        F.exists(topics, lambda t: t["id"] == "sub_branchen_insight").alias("sub"))

    def verdict(x: Column) -> Column:
        c, a = x["c"], x["a"]
        direct = F.size(x["direct"]) > 0
        customer = F.exists(x["direct"], lambda t: t["id"] == "customer_insights")
        context, depth = c.rlike(patterns["context"]), c.rlike(patterns["depth"])
        research = a.rlike(pack.patterns["study"])
        substantive = research & (a.rlike(pack.patterns["method"]) | c.rlike(pack.patterns["method"]))
        sub_depth = x["sub"] & c.rlike(pack.patterns["trend"])
        company_news = article_type == "company_update"
        bad = (
            (c.rlike(patterns["industrial"]) & ~context)
            | (~direct & (~sub_depth | (company_news & ~substantive & ~sub_depth)))
            | (a.rlike(patterns["sponsor"]) & ~customer & ~c.rlike(patterns["activation"]))
            | (a.rlike(patterns["discount"]) & ~customer & ~depth)
            | (company_news & a.rlike(patterns["campaign"]) & ~customer & ~depth)
            | (research & ~substantive)
        )
        return (direct | x["sub"]) & ~bad

    complete = use["publishable"] & use["sufficient_substance"] & (use["evidence"] != "") & (use["transferable_value"] != "")
    return complete & F.transform(F.array(inputs), verdict)[0]


COMPANY_ROLES = ["primary_actor", "decision_maker", "directly_affected", "central_subject"]


def validate_companies(decisions: DataFrame, articles: DataFrame, detected: DataFrame, aliases: DataFrame,
                       roles: Sequence[str] = COMPANY_ROLES, cap: int | None = None) -> DataFrame:
    """First proven decision per article and company.

    `decisions` has doc_id, pos, name, role, evidence. The reported name must equal a detected company's name or alias,
    the quote must stand in the article and name the company.
    """
    terms = aliases.select("company", norm_text(F.col("alias")).alias("key")).unionByName(
        aliases.select("company", norm_text(F.col("company")).alias("key"))).distinct()
    rows = decisions.where(F.col("role").isin(*roles) & (F.length(F.trim("evidence")) >= 20))
    rows = rows.withColumn("key", norm_text(F.col("name"))).join(broadcast_if_small(terms), "key")
    rows = rows.join(detected.select("doc_id", "company").distinct(), ["doc_id", "company"], "left_semi")
    rows = rows.join(articles.select("doc_id", evidence_skeleton(F.col("text")).alias("__s")), "doc_id")
    rows = rows.where(in_text(F.col("__s"), F.col("evidence"))).drop("__s", "key")
    all_terms = terms.groupBy("company").agg(F.collect_set("key").alias("__terms"))
    rows = rows.join(broadcast_if_small(all_terms), "company")
    rows = rows.where(F.exists("__terms", lambda t: contains_term(norm_text(F.col("evidence")), t))).drop("__terms")
    first = rows.groupBy("doc_id", "company").agg(F.min_by(F.struct("evidence", "role"), "pos").alias("d"))
    return first.select("doc_id", "company", (F.trim("d.evidence") if cap is None else F.substring(F.trim("d.evidence"), 1, cap)).alias("evidence"), "d.role")


def leadership_change(articles: DataFrame, lead: str, verbs: str, role: str, second_role: str, change: str, mandate: str) -> DataFrame:
    """Articles with a proven change of a leading role: company from the title, first sentence with role, change and
    company; a second kind of role also needs a sentence with a mandate."""
    rows = articles.select("doc_id", F.trim("title").alias("title"), F.concat_ws("\n", "title", "content").alias("full"))
    rows = rows.withColumn("company", title_company(F.col("title"), lead, verbs)).where(F.length("company") >= 2)
    rows = rows.withColumn("__key", norm_text(F.col("company"))).where(F.contains(norm_text(F.col("full")), F.col("__key")))
    rows = rows.withColumn("sents", F.concat(F.array("title"), sentences(F.col("full"))))

    def proves(s: Column) -> Column:
        return (F.length(s) >= 20) & (s.rlike(role) | s.rlike(second_role)) & s.rlike(change) & F.contains(norm_text(s), F.col("__key"))

    rows = rows.withColumn("company_evidence", F.get(F.filter("sents", proves), F.lit(0))).where("company_evidence is not null")
    first = F.col("company_evidence").rlike(role)
    mandate_hit = F.get(F.filter(F.slice("sents", 2, 1_000_000), lambda s: s.rlike(mandate)), F.lit(0))
    rows = rows.withColumn("kind", F.when(first, "first_role").otherwise("second_role"))
    rows = rows.withColumn("signal_evidence", F.when(first, F.col("company_evidence")).otherwise(mandate_hit))
    return rows.where("signal_evidence is not null").select("doc_id", "kind", "company", "company_evidence", "signal_evidence")


def decide_signal(prefiltered: DataFrame, answers: DataFrame, articles: DataFrame, pack: Pack, min_confidence: float = MIN_CONFIDENCE,
                  min_score: int = MIN_SCORE, link_families: Sequence[str] = ()) -> DataFrame:
    """One result per article: the first reason that rejects the stored answer, or the signal with its score.

    Everything is joined on doc_id; the cascade is one `when` chain in order of the checks. Families in
    `link_families` also need a concrete service link, given as `link_ok` with the answer.
    """
    lanes = F.create_map(*[F.lit(x) for f in pack.families for x in (f.rule_id, f.lane)])
    rows = prefiltered.join(answers, "doc_id").join(articles.select("doc_id", F.concat_ws("\n", "title", "content").alias("__text")), "doc_id")
    rows = rows.withColumn("__s", evidence_skeleton(F.col("__text")))
    parts = ["a", "b", "c", "d"]
    cols = [F.col(p) for p in parts]
    score = F.when(F.col("lane") == "sales", weighted_score(cols, SALES_WEIGHTS, F.col("score"))).otherwise(
        weighted_score(cols, MARKETING_WEIGHTS, F.col("score")))
    rows = rows.withColumn("final_score", score).withColumn("__conf", clamp01(F.col("confidence")))
    named = contains_term(norm_text(F.col("company_evidence")), F.col("company"))
    proven = (F.length(F.trim("company_evidence")) >= 20) & in_text(F.col("__s"), F.col("company_evidence")) & named
    rows = rows.withColumn("proven_company", F.when(proven, F.col("company")))
    allowed = F.array_contains("families", F.col("signal_id")) & (F.try_element_at(lanes, F.col("signal_id")) == F.col("lane"))
    reason = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(~F.col("lane").isin("sales", "marketing"), "no_lane")
        .when(~F.coalesce(allowed, F.lit(False)), "family_not_allowed")
        .when(~in_text(F.col("__s"), F.col("evidence")), "quote_missing")
        .when(norm_text(F.col("evidence")).rlike(pack.patterns["sensitive"]), "quote_sensitive")
        .when(F.col("signal_id").isin(*link_families) & ~F.coalesce(F.col("link_ok"), F.lit(False)) if link_families else F.lit(False), "no_service_link")
        .when((F.col("__conf") < min_confidence) | (F.col("final_score") < min_score), "too_uncertain")
        .when((F.col("lane") == "sales") & F.col("proven_company").isNull(), "company_not_proven")
    )
    rows = rows.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    keep = lambda c: F.when(ok, F.col(c))
    return rows.select(
        "doc_id", F.when(ok, "signal").otherwise("rejected").alias("status"), keep("lane").alias("lane"), keep("signal_id").alias("signal_id"),
        F.when(ok, F.col("final_score")).otherwise(0).alias("score"), keep("proven_company").alias("company"), "reject_reason")


@dataclass(frozen=True)
class Policy:
    """What an organisation accepts as evidence; the defaults accept all. Patterns match folded quotes.

    `needs_impact` topics count only with a quote that matches `impact`; `must` and `must_not` bind a topic's quote to a
    pattern, and `unless_impact` lets a forbidden pattern pass if the quote matches `impact` too. `implemented` binds the
    quotes of triggers. `recover` and `value` find sentences for topics that an answer left out, `infer` names the topic of
    a recovered sentence, and `any_topic` is what such a sentence must hold.
    """

    not_relevant: tuple[str, ...] = ()
    needs_impact: tuple[str, ...] = ()
    impact: str = ""
    must: Mapping[str, str] = field(default_factory=dict)
    must_not: Mapping[str, str] = field(default_factory=dict)
    unless_impact: Mapping[str, str] = field(default_factory=dict)
    implemented: str = ""
    recover: Mapping[str, str] = field(default_factory=dict)
    value: str = ""
    any_topic: str = ""
    infer: tuple[tuple[str, str], ...] = ()
    otherwise: str = "marketing_insights"
    territories: tuple[str, ...] = ()

    def accepts(self, topic: Column) -> Column:
        n, name = norm_text(topic["evidence"]), topic["id"]
        ok = ~name.isin(*self.not_relevant) & (~name.isin(*self.needs_impact) | n.rlike(self.impact))
        for known, pattern in self.must.items():
            ok = ok & ((name != known) | n.rlike(pattern))
        for known, pattern in self.must_not.items():
            ok = ok & ((name != known) | ~n.rlike(pattern))
        for known, pattern in self.unless_impact.items():
            ok = ok & ((name != known) | ~n.rlike(pattern) | n.rlike(self.impact))
        return ok


def _recovered(rows: DataFrame, policy: Policy, topic_rules: Mapping[str, Sequence[str]], least: float) -> DataFrame:
    """Marketing use with a sentence of the article where the answer gave no proven one, and the topics left out.

    Only answers that claim a transferable value of sufficient substance are completed. The sentence must stand in a
    topic's context, or the answer must hold a proven subsector insight.
    """
    use, topics = F.col("marketing_use"), F.col("topics")
    direct = lambda t: topic_context(t["id"], t["evidence"], topic_rules)
    claims = F.col("transferable") & use["sufficient_substance"] & (F.coalesce(use["transferable_value"], F.lit("")) != "")
    sentence = F.when(use["evidence"] != "", use["evidence"]).otherwise(recover_evidence(F.col("text"), policy.any_topic, policy.value))
    rows = rows.withColumn("__found", F.when(claims, sentence).otherwise(""))
    name = infer_topic(F.col("__found"), policy.infer, policy.otherwise)
    confidence = F.greatest(F.lit(least), clamp01(F.col("routes.marketing.confidence")))
    tag = F.struct(name.alias("id"), confidence.alias("confidence"), F.col("__found").alias("evidence"))
    rows = rows.withColumn("__tag", tag).withColumn("__direct", topic_context(F.col("__tag.id"), F.col("__found"), topic_rules))
    subsector = F.exists(topics, lambda t: t["id"] == "sub_branchen_insight")
    fits = (F.col("__found") != "") & (F.col("__direct") | subsector)
    grown = F.when(fits & F.col("__direct") & ~F.exists(topics, direct), F.concat(topics, F.array("__tag"))).otherwise(topics)
    publishable = F.when(F.col("__found") != "", fits).otherwise(use["publishable"] & (use["evidence"] != ""))
    evidence = F.when(fits, F.col("__found")).otherwise(use["evidence"])
    full = (F.coalesce(use["transferable_value"], F.lit("")) != "") & use["sufficient_substance"] & (evidence != "")
    rows = rows.withColumn("topics", grown).withColumn("marketing_use", F.struct(
        (publishable & full).alias("publishable"), use["transferable_value"].alias("transferable_value"), use["sufficient_substance"].alias("sufficient_substance"), evidence.alias("evidence")))
    for topic, pattern in policy.recover.items():
        hit = recover_evidence(F.col("text"), pattern, policy.value, low=45)
        missing = _lacks(topic)
        extra = F.struct(F.lit(topic).alias("id"), F.lit(max(least, 0.9)).alias("confidence"), hit.alias("evidence"))
        rows = rows.withColumn("topics", F.when(missing & (hit != ""), F.concat("topics", F.array(extra))).otherwise(F.col("topics")))
    return rows.drop("__found", "__tag", "__direct")


def _lacks(topic: str) -> Column:
    return F.col("marketing_use.publishable") & ~F.exists("topics", lambda t: t["id"] == F.lit(topic))


def validate_classification(answers: DataFrame, articles: DataFrame, aliases: DataFrame, pack: Pack, patterns: Mapping[str, str],
                            topic_rules: Mapping[str, Sequence[str]], topic_ids: Sequence[str], trigger_ids: Sequence[str],
                            quality: Mapping[str, float] = QUALITY, policy: Policy = Policy(), participation: DataFrame | None = None) -> DataFrame:
    """Validated answer per article: proven topics, companies, people and triggers, derived uses, routes and status.

    `participation` has the doc_ids with a qualified event participation; without it no trigger of that kind counts. If
    the answers have a `territory`, the result holds it where it is known and proven, else null.

    Quotes are checked against one skeleton per article. Companies leave the row once to meet the canonical names by
    equality and come back as an array bounded by the answer.
    """
    text = articles.select("doc_id", "text", evidence_skeleton(F.col("text")).alias("skel"))
    rows = answers.withColumn("n_topics", F.size("topics")).join(text, "doc_id")
    skel = F.col("skel")

    def proven(col: str, vocabulary: Sequence[str] | None, least: float):
        def keep(x: Column) -> Column:
            known = x["id"].isin(*vocabulary) if vocabulary else F.lit(True)
            return known & (clamp01(x["confidence"]) >= least) & in_text(skel, x["evidence"])

        return F.filter(F.col(col), keep)

    rows = rows.withColumn("topics", F.filter(proven("topics", topic_ids, quality["topic"]), lambda t: (
        ~t["id"].isin(*topic_rules) | topic_context(t["id"], t["evidence"], topic_rules)) & (
        (t["id"] != "sub_branchen_insight") | F.col("transferable")) & policy.accepts(t)))
    if participation is not None:
        rows = rows.join(participation.select("doc_id", F.lit(True).alias("__takes_part")).distinct(), "doc_id", "left")
    takes_part = F.lit(False) if participation is None else F.coalesce("__takes_part", F.lit(False))
    rows = rows.withColumn("triggers", F.filter(proven("triggers", trigger_ids, quality["trigger"]), lambda t: (
        (t["id"] != "marketing_problem") | unresolved_problem(t["evidence"], pack)) & ((t["id"] != "event_participation") | takes_part) & (
        norm_text(t["evidence"]).rlike(policy.implemented))))
    if "territory" in answers.columns:
        land = F.col("territory")
        known = land["id"].isin(*policy.territories) & (clamp01(land["confidence"]) >= quality.get("territory", quality["topic"])) & in_text(skel, land["evidence"])
        rows = rows.withColumn("territory", F.when(known, land))
    rows = rows.withColumn("people", F.filter("people", lambda p: (F.trim(p["name"]) != "") & (F.trim(p["role"]) != "") & (
        clamp01(p["confidence"]) >= quality["person"]) & in_text(skel, p["evidence"])))

    names = aliases.select("company", norm_text(F.col("alias")).alias("key")).distinct()
    own = rows.select("doc_id", "skel", F.posexplode("companies").alias("pos", "c")).where(
        (clamp01(F.col("c.confidence")) >= quality["company"]) & in_text(skel, F.col("c.evidence")))
    own = own.withColumn("key", norm_text(F.col("c.name"))).join(broadcast_if_small(names), "key")
    own = own.where(contains_term(norm_text(F.col("c.evidence")), F.col("key")))
    own = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("company").alias("name"), F.col("c.role").alias("role")))).alias("__own"))
    rows = rows.join(own, "doc_id", "left").withColumn("n_companies", F.size("companies"))
    rows = rows.withColumn("companies", F.coalesce("__own", F.array().cast("array<struct<pos:int,name:string,role:string>>")))
    lead = F.exists("companies", lambda c: c["role"] != "incidental_mention")

    use = F.col("marketing_use")
    quote = F.when(in_text(skel, use["evidence"]), F.trim(use["evidence"])).otherwise("")
    full = (F.coalesce(use["transferable_value"], F.lit("")) != "") & use["sufficient_substance"] & (quote != "")
    rows = rows.withColumn("marketing_use", F.struct((use["publishable"] & full).alias("publishable"), use["transferable_value"].alias("transferable_value"),
                                                    use["sufficient_substance"].alias("sufficient_substance"), quote.alias("evidence")))
    if policy.any_topic:
        rows = _recovered(rows, policy, topic_rules, quality["topic"])
    sale = F.col("sales_use")
    sale_quote = F.when(in_text(skel, sale["evidence"]), F.trim(sale["evidence"])).otherwise(F.coalesce(F.get("triggers", F.lit(0))["evidence"], F.lit("")))
    action = (sale["company_challenge"] != "") & (sale["relevance"] != "") & sale["sufficient_substance"] & (F.size(sale["facts"]) > 0) & (sale_quote != "")
    rows = rows.withColumn("sales_use", F.struct(action.alias("actionable"), sale["company_challenge"].alias("company_challenge"), sale["relevance"].alias("relevance"),
                                                 sale["sufficient_substance"].alias("sufficient_substance"), sale["facts"].alias("facts"), sale_quote.alias("evidence")))

    def route(name: str) -> Column:
        r = F.col(f"routes.{name}")
        conf = clamp01(r["confidence"])
        ok = r["eligible"] & (conf >= quality["route"]) & in_text(skel, r["evidence"])
        return F.struct(ok.alias("eligible"), conf.alias("confidence"), F.when(ok, r["evidence"]).otherwise("").alias("evidence"))

    rows = rows.withColumn("marketing", route("marketing")).withColumn("sales", route("sales"))
    strongest = lambda arr: F.coalesce(F.array_max(F.transform(arr, lambda t: clamp01(t["confidence"]))), F.lit(0.0))
    promoted = F.struct(F.lit(True).alias("eligible"), F.greatest(F.lit(quality["route"]), strongest(F.col("triggers"))).alias("confidence"),
                        F.col("sales_use.evidence").alias("evidence"))
    rows = rows.withColumn("sales", F.when(F.col("sales_use.actionable") & ~F.col("sales.eligible") & (F.size("triggers") > 0), promoted).otherwise(F.col("sales")))
    rows = rows.withColumn("substance", transferable_substance(F.col("article_type"), F.col("text"), F.col("topics"), F.col("marketing_use"), pack, patterns, topic_rules))
    gained = F.struct(F.lit(True).alias("eligible"), F.greatest(F.lit(quality["route"]), strongest(F.col("topics"))).alias("confidence"), F.col("marketing_use.evidence").alias("evidence"))
    lost = F.struct(F.lit(False).alias("eligible"), F.col("marketing.confidence").alias("confidence"), F.lit("").alias("evidence"))
    rows = rows.withColumn("marketing", F.when(F.col("substance") & ~F.col("marketing.eligible"), gained).when(
        ~F.col("substance") & F.col("marketing.eligible"), lost).otherwise(F.col("marketing")))

    sure = clamp01(F.col("overall_confidence")) >= quality["reliable"]
    no_objection = (F.trim("title_de") != "") & (F.size("rejection_reasons") == 0)
    sales_case = lead & (F.size("triggers") > 0) & F.col("sales.eligible") & F.col("sales_use.actionable")
    any_signal = (F.size("topics") > 0) | (lead & (F.size("triggers") > 0))
    complete = (F.size("topics") == F.col("n_topics")) & (F.size("companies") == F.col("n_companies"))
    strong = F.col("substance") & F.col("marketing.eligible") & sure & (strongest(F.col("topics")) >= quality["reliable"])
    raw = F.col("relevance_status")
    reliable = no_objection & (((raw == "reliable") & sure & any_signal & complete) | ((raw != "rejected") & (strong | sales_case)))
    status = F.when(reliable & (F.col("substance") | sales_case), "reliable").when(reliable, "uncertain").when((raw == "rejected") & sure, "rejected").otherwise("uncertain")
    return rows.select("doc_id", status.alias("status"), "topics", "companies", "people", "triggers", "marketing_use", "sales_use", "marketing", "sales", "substance",
                       *["territory"] * ("territory" in answers.columns))
