"""Rule packs: vocabularies as parameters of the rule operators.

`MARKETING` is a compact bilingual vocabulary for real trade-press text. `FIXTURE` holds function words that occur in
the invented prose of the shared test tables, so the same operators return rows there. Patterns match folded text.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Family:
    """A signal family: `trigger` and optional `context` must match, `exclude_title` must not, hosts may be limited."""

    rule_id: str
    lane: str
    trigger: str
    context: str | None = None
    exclude_title: str | None = None
    domains: tuple[str, ...] = ()
    priority: int = 0


@dataclass(frozen=True)
class Pack:
    families: tuple[Family, ...] = ()
    patterns: dict[str, str] = field(default_factory=dict)
    terms: dict[str, tuple[str, ...]] = field(default_factory=dict)


def words(*items: str) -> str:
    """Alternation of whole folded words; a trailing * allows an inflected ending."""
    return r"\b(" + "|".join(i.replace("*", r"\w*").replace(" ", " ") for i in items) + r")\b"


MARKETING = Pack(
    families=(
        Family("leadership_change", "sales", words("cmo", "marketing director", "marketingleiter*"),
               words("joins", "appointed", "wechselt", "folgt auf"), priority=1),
        Family("brand_relaunch", "sales", words("relaunch", "rebranding", "markenauftritt"), words("brand*", "marke*"),
               priority=2),
        Family("private_label", "sales", words("private label*", "eigenmarke*"), None, words("jobs", "karriere"),
               priority=3),
        Family("customer_study", "marketing", words("study", "survey", "studie*", "umfrage*"),
               words("customer*", "consumer*", "kund*"), priority=4),
    ),
    patterns={
        "sensitive": words("election*", "war", "krieg*", "terror*", "wahlkampf*", "religion*"),
        "offer": words("software", "platform*", "tool*", "service*", "consulting", "agentur*", "beratung*"),
        "self_promo": words("our software", "our platform", "we offer", "we help", "wir bieten", "unsere losung"),
        "profile_page": words("company profile", "unternehmensprofil", "product announcement"),
        "study": words("study", "survey", "studie*", "umfrage*", "benchmark*"),
        "paper": words("white ?paper", "playbook", "market report", "marktbericht"),
        "method": words("sample size", "respondent*", "interview*", "stichprobe", "methodik", "befrag*"),
        "finding": words("result*", "finding*", "ergebnis*", "zeigt", "reveals?"),
        "quantity": r"\b\d+(?:[.,]\d+)? (?:prozent|percent)\b",
        "trend": words("trend*", "consumer behavio*", "customer insight*", "konsumverhalten"),
        "faq": words("faq", "frequently asked questions", "fragen und antworten"),
        "program": words("agenda", "schedule", "speakers", "tickets", "programm", "teilnehmer"),
        "program_ok": words("report", "results", "ergebnisse", "launch", "strategy", "strategie"),
        "directory": words("media contact*", "kontakt", "company profile", "supplier"),
        "program_title": r"^(?:event )?(?:agenda|schedule|speakers|tickets|programm|teilnehmer)(?: \d{4})?$",
        "media_title": r"^media(?: |$)",
        "media_text": words("latest news", "reports?", "download"),
        "contact": words("tel", "fax", "mitarbeiter", "employees"),
        "address": words("adresse", "strasse", "address", "www"),
        "listing_title": words("media", "downloads?", "publications?"),
        "listing_link": words("read more", "download file", "mehr lesen"),
        "professional": words("brand strateg*", "campaign*", "kampagn*", "customer experience", "private label*",
                              "pricing strateg*", "rebrand*", "market entr*", "acquisition"),
        "appointment": words("appoint*", "named", "ernenn*", "beruf*"),
        "product_launch": words("product launch", "produkteinfuhr*"),
        "strategic": words("strateg*", "transform*", "campaign*", "kampagn*", "position*"),
        "event": words("event", "messe", "konferenz", "conference", "summit", "forum", "congress"),
        "event_action": words("speaks?", "spricht", "presents?", "diskutiert", "joins a panel", "takes part"),
        "event_topic": words("marketing", "brand*", "marke*", "retail*", "handel*", "customer*", "kund*"),
        "role": words("cmo", "ceo", "head of [a-z ]+", "director", "vorstand*", "geschaftsfuhrer*"),
        "substance": words("result*", "ergebnis*", "study", "studie*", "data", "daten", "benchmark*"),
        "bare_event": words("attend*", "teilnahme", "speaker*", "agenda", "panel", "keynote", "anmeldung"),
        "collection_title": words("pressemappe", "press kit", "media kit", "download center"),
        "asset_marker": words("factsheet", "download", "logo", "bildmaterial", "press photo"),
        "white_paper": words("white ?paper", "report", "playbook"),
        "problem": words("loses?", "decline*", "verliert", "ruckgang*", "problem*"),
        "problem_context": words("brand*", "marke*", "customer*", "kund*", "campaign*"),
        "resolved": words("solved", "gelost", "recovered", "behoben"),
    },
    terms={"career": ("apply now", "career", "vacancy", "bewerbung", "karriere", "ausbildung", "stellenangebot")},
)

FIXTURE = Pack(
    families=(
        Family("fam_a", "sales", words("the", "der"), words("and", "und"), priority=1),
        Family("fam_b", "marketing", words("les", "une"), None, words("de"), priority=2),
        Family("fam_c", "marketing", words("with", "mit"), None, None, ("src1.example.com", "src2.example.com"), 3),
        Family("fam_d", "sales", words("los", "por"), words("que"), None, (), 4),
    ),
    patterns={
        "sensitive": words("hate", "stupid", "worthless"),
        "offer": words("with", "mit", "avec", "con"),
        "self_promo": words("of the", "in der", "de la"),
        "profile_page": words("was", "ist", "est"),
        "study": words("this", "nicht"),
        "paper": words("that", "auf", "pour"),
        "method": words("by", "von"),
        "finding": words("be", "sich", "sur"),
        "quantity": r"\b\d+ (?:the|de)\b",
        "trend": words("have", "werden", "dans"),
        "faq": words("it"),
        "program": words("be", "un", "zu"),
        "program_ok": words("for", "pour"),
        "directory": words("are", "auch"),
        "program_title": r"^(?:the )?(?:is|der|la|en)(?: \d{4})?$",
        "media_title": r"^(?:the|en)(?: |$)",
        "media_text": words("haenonn", "have"),
        "contact": words("scum", "moron"),
        "address": words("clown", "idiot"),
        "listing_title": words("of", "de", "und"),
        "listing_link": words("that the", "las ie", "die der"),
        "professional": words("the", "die", "les", "los"),
        "appointment": words("at", "ein"),
        "product_launch": words("not", "nicht"),
        "strategic": words("by", "des"),
        "event": words("in", "en", "im"),
        "event_action": words("to", "zu", "que"),
        "event_topic": words("and", "und", "et", "y"),
        "role": words("of", "von", "de"),
        "substance": words("that", "das", "qui"),
        "bare_event": words("is", "ist", "est"),
        "collection_title": words("a", "an", "une"),
        "asset_marker": words("of", "de"),
        "white_paper": words("from", "aux"),
        "problem": words("the", "der", "la"),
        "problem_context": words("and", "und", "et"),
        "resolved": words("this", "auf", "sur"),
    },
    terms={"career": ("the", "and", "is", "der", "die", "und", "le", "la")},
)
