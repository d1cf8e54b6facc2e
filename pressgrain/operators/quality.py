"""Article gates: text volume, collections, capital runs, vendor pitches and the ordered list of hard rejections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgrain.functions.text import bound, clean_article_text, contains_term, norm_text, paywall_flag, select_passages
from pressgrain.rules.packs import Pack

# Minimum volume of an article, and of a dense short one (characters, words, sentences).
ENOUGH = (500, 70, 3)
DENSE = (430, 75, 5)


def text_quality(col: Column, enough=ENOUGH, dense=DENSE, clean: bool = False, norm: Column | None = None) -> Column:
    """Struct of chars, words, sentences, paywall and sufficient; `clean` runs the line cleaner first. `norm`, where given, is
    the normalised text."""
    source = clean_article_text(col) if clean else col

    def measure(t: Column) -> Column:
        # From a word's first letter to its end, so every word with a letter counts once.
        words = F.regexp_count(t, F.lit(r"[A-Za-zÄÖÜäöüß]\S*+"))
        sents = F.regexp_count(t, F.lit("[.!?](?:[”»\"')\\]]|\\s|$)"))
        return F.struct(F.length(t).alias("chars"), words.alias("words"), sents.alias("sentences"),
                        paywall_flag(t, norm=norm).alias("paywall"))

    def verdict(m: Column) -> Column:
        def reaches(limit):
            return (m["chars"] >= limit[0]) & (m["words"] >= limit[1]) & (m["sentences"] >= limit[2])

        ok = ~m["paywall"] & (reaches(enough) | reaches(dense))
        return F.struct(m["chars"], m["words"], m["sentences"], m["paywall"], ok.alias("sufficient"))

    return F.transform(F.transform(F.array(source), measure), verdict)[0]


def _lines(text: Column, strip: str) -> Column:
    cleaned = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, strip, "")))
    return F.filter(cleaned, lambda x: x != "")


UPPER, LETTER = "[A-ZÄÖÜ]", "[A-Za-zÄÖÜäöüß]"


def is_collection(title: Column, text: Column, pack: Pack, norms: tuple[Column, Column] | None = None) -> Column:
    """Asset index instead of an article: a press-kit title plus weak prose, or many asset markers and headlines. `norms`,
    where given, are the normalised title and text."""
    t, n = norms or (norm_text(title), norm_text(text))

    def classify(x: Column) -> Column:
        ends = x.rlike("[.!?][”»\"]?$")
        letters, upper = F.regexp_count(x, F.lit(LETTER)), F.regexp_count(x, F.lit(UPPER))
        # Words are counted by the gaps before them, and only as far as it takes: four to 24, and nine or more.
        few, many = x.rlike(r"^(?:\S*+\s++){3,23}+\S*+\z"), x.rlike(r"^(?:\S*+\s++){8}")
        return bound(ends, lambda e: F.struct((many & e).alias("prose"), (few & (~e | bound(letters, lambda k: (k >= 12) & (upper / k >= 0.72)))).alias("headline")))

    def verdict(arr: Column) -> Column:
        counts = F.struct(F.size(F.filter(arr, lambda x: x["prose"])).alias("prose"), F.size(F.filter(arr, lambda x: x["headline"])).alias("heads"),
                          t.rlike(pack.patterns["collection_title"]).alias("kit"), F.regexp_count(n, F.lit(pack.patterns["asset_marker"])).alias("markers"))
        return bound(counts, lambda c: (c["kit"] & ((c["markers"] >= 2) | (c["heads"] >= 3) | (c["prose"] < 2)))
                     | ((c["markers"] >= 4) & (c["heads"] >= 4) & (c["heads"] > c["prose"] * 2)))

    return bound(F.transform(_lines(text, r"^#{1,6}\s+|^-\s+"), classify), verdict)


def all_caps_run(text: Column, k: int = 3, share: float = 0.78) -> Column:
    """True where `k` or more consecutive sentence-like lines are written in capitals."""

    def capital(x: Column) -> Column:
        letters, upper = F.regexp_count(x, F.lit(LETTER)), F.regexp_count(x, F.lit(UPPER))
        return (F.length(x) >= 35) & x.rlike(r"^\s*+(?:\S++\s++){5}\S") & bound(letters, lambda n: (n >= 20) & (upper / n >= share))

    flags = F.array_join(F.transform(_lines(text, r"^#{1,6}\s+|^-\s+|\*+"), lambda x: F.when(capital(x), "1").otherwise("0")), "")
    run = F.coalesce(F.contains(flags, F.lit("1" * k)), F.lit(False))
    if share <= 0.75 or k < 1:
        return run
    # Three of four letters and more cannot be capitals without three of them in a row.
    other = "[^A-Za-zÄÖÜäöüß]*+"
    return F.when(text.rlike(UPPER + other + UPPER + other + UPPER), run).otherwise(False)


def vendor_pitch(title: Column, text: Column, pack: Pack, norm: Column | None = None) -> Column:
    """An offer that promotes itself and carries no study, paper or playbook with method and finding. `norm`, where given, is
    the normalised title and text."""
    p = pack.patterns

    def verdict(x: Column) -> Column:
        signals = reduce(lambda a, b: a + b, [x.rlike(p[k]).cast("int") for k in ("method", "finding", "quantity", "trend")])
        studied = x.rlike(p["study"])
        substantive = F.when(
            studied, x.rlike(p["method"]) & (x.rlike(p["finding"]) | (signals >= 2))
        ).otherwise(x.rlike(p["paper"]) & x.rlike(p["finding"]) & (signals >= 2))
        promo = x.rlike(p["self_promo"])
        return x.rlike(p["offer"]) & (promo | x.rlike(p["profile_page"])) & ~substantive

    return bound(norm_text(F.concat_ws(" ", title, text)), verdict) if norm is None else verdict(norm)


def _substance(n: Column, pack: Pack) -> Column:
    p = pack.patterns
    return n.rlike(p["event"]) & n.rlike(p["event_topic"]) & n.rlike(p["substance"])


def event_substance(text: Column, pack: Pack) -> Column:
    """An event report with a topic and findings of its own."""
    return F.transform(F.array(norm_text(text)), lambda n: _substance(n, pack))[0]


def _bare(n: Column, pack: Pack) -> Column:
    return n.rlike(pack.patterns["event"]) & n.rlike(pack.patterns["bare_event"]) & ~_substance(n, pack)


def bare_event(text: Column, pack: Pack) -> Column:
    """An event that is only announced or attended."""
    return bound(norm_text(text), lambda n: _bare(n, pack))


REASONS = [
    "career", "faq", "event_program", "directory", "collection", "all_caps", "vendor_pitch", "no_content",
    "event_source_unqualified", "bare_event", "stale_event_year", "no_professional_signal", "pure_appointment",
    "bare_product_launch",
]


def hard_rejections(
    title: Column,
    text: Column,
    pack: Pack,
    as_of_year: int,
    event_source: Column | None = None,
    participation: Column | None = None,
    classifier_chars: int | None = None,
    career_hits: int = 3,
    listing_links: int = 6,
    switched_off: Sequence[str] = (),
) -> Column:
    """Ordered array of the reasons that reject an article; one boolean per rule, computed inside the row.

    A page is a directory by its title, as the media section of a site, by contact data with an address, or by its number
    of links to more. A title that only names a list of an event is a programme whatever its text holds. Reasons in
    `switched_off` are not given. The rules see the whole text; `classifier_chars` makes them see its best passages of so many characters instead.
    """
    p = pack.patterns
    event_source = F.lit(False) if event_source is None else event_source
    qualified = F.lit(False) if participation is None else participation

    def with_norms(x: Column) -> Column:
        # The normalised title and text are those of both together, since whatever stands between them is one blank.
        both = F.trim(F.concat_ws(" ", x["t"], x["b"]))
        n = both if classifier_chars is None else norm_text(F.concat_ws(" ", title, select_passages(text, classifier_chars)))
        return F.struct(n.alias("n"), both.alias("full"), x["t"].alias("t"), x["b"].alias("b"), (~text_quality(text, norm=x["b"])["sufficient"]).alias("empty"))

    inputs = bound(F.struct(norm_text(title).alias("t"), norm_text(text).alias("b")), with_norms)

    def rules(x: Column) -> Column:
        n, t, b, full, empty = x["n"], x["t"], x["b"], x["full"], x["empty"]
        hits = reduce(lambda a, b: a + b, [contains_term(n, w).cast("int") for w in pack.terms["career"]])
        year = F.regexp_extract(t, r"\b(20\d{2})\b", 1).try_cast("int")
        flags = [
            hits >= career_hits,
            t.rlike(p["faq"]),
            t.rlike(p["program_title"]) | (t.rlike(p["program"]) & ~qualified & ~t.rlike(p["program_ok"]) & ~_substance(full, pack)),
            t.rlike(p["directory"]) | (t.rlike(p["media_title"]) & b.rlike(p["media_text"])) | (b.rlike(p["contact"]) & b.rlike(p["address"]))
            | (t.rlike(p["listing_title"]) & (F.regexp_count(b, F.lit(p["listing_link"])) >= listing_links)),
            is_collection(title, text, pack, (t, b)),
            all_caps_run(text),
            vendor_pitch(title, text, pack, full),
            empty,
            ~empty & event_source & ~qualified,
            ~empty & ~event_source & ~qualified & _bare(full, pack),
            F.coalesce((year <= as_of_year - 2) & t.rlike(p["event"]), F.lit(False)),
            ~empty & ~n.rlike(p["professional"]),
            n.rlike(p["appointment"]) & ~n.rlike(p["strategic"]),
            n.rlike(p["product_launch"]) & ~n.rlike(p["strategic"]),
        ]
        return F.array_compact(F.array(*[F.when(flag, name) for name, flag in zip(REASONS, flags) if name not in switched_off]))

    return bound(inputs, rules)


def freshness(ts: Column, as_of: Column, days: int = 183, tolerance_hours: int = 24) -> Column:
    """`too_old`, `future` or null; an unknown date passes."""
    oldest = as_of - F.expr(f"interval {days} days")
    newest = as_of + F.expr(f"interval {tolerance_hours} hours")
    return F.when(ts < oldest, "too_old").when(ts > newest, "future")


# The article types an answer may name.
ARTICLE_TYPES = ["news", "study", "whitepaper", "interview", "case_study", "opinion", "event", "press_release"]


def article_type(raw: Column, text: Column, pack: Pack, allowed=ARTICLE_TYPES) -> Column:
    """Study and white paper by content, then an allowed raw type, then news for three or more prose sentences."""
    p = pack.patterns

    def verdict(n: Column) -> Column:
        parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
        prose = F.size(F.filter(parts, lambda s: (F.length(s) >= 60) & s.rlike("[.!?][”»\"]?$")))
        return (
            F.when(n.rlike(p["study"]) & n.rlike(p["method"]) & n.rlike(p["finding"]), "study")
            .when(n.rlike(p["white_paper"]) & n.rlike(p["substance"]), "whitepaper")
            .when(raw.isin(*allowed), raw)
            .when(prose >= 3, "news")
            .otherwise("other")
        )

    return F.transform(F.array(norm_text(text)), verdict)[0]
