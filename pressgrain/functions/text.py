"""Text folding, language, phrases, passages and evidence tests as `Column -> Column` functions.

Everything here stays JVM-side. Patterns run on folded ASCII text wherever possible, because word boundaries and
whitespace classes differ between regex engines on accented text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "


def _folding_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Derive the compatibility folding of lower-cased text from all of the standard library's Unicode data.

    One-to-one foldings and deletions go into one `translate`; characters that expand to several are looked up one by
    one in the texts that have any.
    """
    source, target, long_forms = [], [], []
    for code in [*range(0xA0, 0x300), *range(0x370, 0xD800), *range(0xE000, 0x20000)]:
        char = chr(code)
        if char == "ß":
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F)
        plain = "".join(c if c.isascii() and c.isalnum() and not c.isupper() else " " for c in plain)
        if plain == char or not plain.strip():
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            long_forms.append((char, plain))
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(source) + marks, "".join(target), long_forms


FOLD_FROM, FOLD_TO, FOLD_LONG = _folding_table()


def _code_ranges(chars: Sequence[str], gap: int = 32) -> str:
    """A regex class of few ranges that holds all of `chars`; ranges may cover other rare characters between them, but no
    general punctuation."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= gap and not (ranges[-1][1] < 0x2000 <= code):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


# The one wide range is tried first, so the many small ones cost nothing on the letters that make up most of a text.
FOLD_LONG_CLASS = f"[\\x{{{min(ord(char) for char, _ in FOLD_LONG):x}}}-\\x{{1ffff}}&&{_code_ranges([char for char, _ in FOLD_LONG])}]"
# Pairs of one string literal: a map literal of that size would cost hundreds of calls to the JVM in each plan.
FOLD_LONG_PAIRS = ";".join(f"{char}={plain}" for char, plain in FOLD_LONG)


def _replace_all(col: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def fold(col: Column) -> Column:
    """Lower case, compatibility-fold to base letters, ß as ss; punctuation is kept. Plain ASCII is only lower-cased."""
    low = F.lower(col)
    table = F.str_to_map(F.lit(FOLD_LONG_PAIRS), F.lit(";"), F.lit("="))
    one_by_one = F.transform(F.split(low, ""), lambda c: F.when(F.octet_length(c) > 1, F.coalesce(F.try_element_at(table, c), c)).otherwise(c))
    long_forms = F.when(low.rlike(FOLD_LONG_CLASS), F.array_join(one_by_one, "")).otherwise(low)
    folded = F.translate(F.replace(long_forms, F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO)
    return F.when(F.octet_length(col) == F.length(col), low).otherwise(folded)


def bound(value: Column, fn) -> Column:
    """`fn(value)` with `value` computed once, however often `fn` names it."""
    return F.transform(F.array(value), fn)[0]


# A run of characters between words, unless it is one blank already.
BETWEEN_WORDS = "[^a-z0-9](?:[^a-z0-9]++|(?<! ))"


def norm_text(col: Column) -> Column:
    """Folded text with every run of other characters as one blank."""
    return F.trim(F.regexp_replace(fold(F.coalesce(col, F.lit(""))), BETWEEN_WORDS, " "))


_FOLD_CHARS = {**dict(FOLD_LONG), "ß": "ss", **{c: (FOLD_TO[i] if i < len(FOLD_TO) else "") for i, c in enumerate(FOLD_FROM)}}


def norm_literal(text: str) -> str:
    """`norm_text` of a plan-time literal."""
    low = "".join(_FOLD_CHARS.get(c, c) for c in text.lower())
    return re.sub("[^a-z0-9]+", " ", low).strip(" ")


ASCII_OTHER = "".join(c for c in map(chr, range(1, 128)) if not c.isalnum())


def evidence_skeleton(col: Column) -> Column:
    """Letters and digits only, umlauts and broken characters deleted on both sides of a comparison."""
    cleared = F.translate(_replace_all(F.lower(col), [("ß", "ss")]), "äöü�" + ASCII_OTHER, "")
    return bound(cleared, lambda c: F.regexp_replace(fold(c), "[^a-z0-9]+", ""))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


# Function words that decide the language, and the per-word cap.
GERMAN_WORDS = ["der", "die", "das", "den", "dem", "und", "mit", "fur", "von", "wird", "werden", "ist", "sind", "ein",
                "eine", "auf", "zu", "im", "des", "unternehmen"]
ENGLISH_WORDS = ["the", "and", "with", "for", "from", "company", "market", "will", "is", "are", "a", "an", "of", "to",
                 "in", "on", "that", "this", "has"]
LANGUAGE_CAP = 8


def _equals(word: str):
    return lambda t: t == word


def capped_hits(token_array: Column, terms: Sequence[str], cap: int = LANGUAGE_CAP) -> Column:
    """Sum over `terms` of how often each occurs, each counted at most `cap` times.

    One pass keeps only the wanted words; the per-word counts then run over that short list.
    """
    def total(used: Column) -> Column:
        hits = [F.least(F.size(F.filter(used, _equals(w))), F.lit(cap)) for w in terms]
        return reduce(lambda a, b: a + b, hits)

    return F.transform(F.array(F.filter(token_array, lambda t: t.isin(*terms))), total)[0]


def detect_language(col: Column, first_tokens: int | None = None) -> Column:
    """`de`, `en` or `other` from whole function words of the text, or of its first tokens where a number is given."""
    words = tokens(norm_text(col))
    words = words if first_tokens is None else F.slice(words, 1, first_tokens)
    known = sorted(set(GERMAN_WORDS) | set(ENGLISH_WORDS))
    used = F.filter(words, lambda t: t.isin(*known))
    scores = F.transform(
        F.array(used), lambda u: F.struct(capped_hits(u, GERMAN_WORDS).alias("de"), capped_hits(u, ENGLISH_WORDS).alias("en")))
    verdict = F.transform(scores, lambda s: F.when((s.de >= 6) & (s.de >= s.en * 1.35), "de")
                          .when((s.en >= 6) & (s.en >= s.de * 1.35), "en").otherwise("other"))
    return verdict[0]


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


# Phrases that carry no content in a headline.
HEADLINE_NOISE = ["cosmeticbusiness", "cosmetic business", "pressemitteilung", "press release"]


def canonical_headline(col: Column, noise: Sequence[str] = HEADLINE_NOISE) -> Column:
    cut = F.regexp_replace(norm_text(col), r"\b(" + "|".join(noise) + r")\b", " ")
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def contains_term(norm: Column, term: Column | str) -> Column:
    """Whole-phrase match of a term in folded text; an empty term never matches."""
    if isinstance(term, str):
        t = norm_literal(term)
        return F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.lit(f" {t} ")) if t else F.lit(False)
    t = norm_text(term)
    return (t != "") & F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))


def contains_any(norm: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_term(norm, t) for t in terms], F.lit(False))


def headline_tokens(canonical: Column) -> Column:
    """Distinct tokens of at least four characters that are not years of this century."""
    return F.array_distinct(F.filter(F.split(canonical, " "), lambda t: (F.length(t) >= 4) & ~t.rlike(r"^20\d{2}$")))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def token_similarity(left: Column, right: Column) -> Column:
    """Struct of Jaccard `score` and `shared` token count of two headlines."""
    a, b = headline_tokens(canonical_headline(left)), headline_tokens(canonical_headline(right))
    return F.struct(jaccard(a, b).alias("score"), F.size(F.array_intersect(a, b)).alias("shared"))


# Signs of a paywall teaser on folded text, and the length below which paired words count.
PAYWALL_EXPLICIT = (
    r"jetzt angebot wahlen und weiterlesen|noch kein .*abonnement|nur fur abonnenten|artikel ist kostenpflichtig"
    r"|weiterlesen mit .*abo|subscribe to (?:continue|read)|sign in to continue|already a subscriber|remaining article"
)
PAYWALL_NOUN = r"\b(abonnent|abonnement|subscription|subscribe|premium)\b"
PAYWALL_VERB = r"\b(weiterlesen|vollstandigen artikel|continue reading|read more|sign in|login|anmelden)\b"
PAYWALL_CHARS = 1200


def has_any_of(norm: Column, pattern: str) -> Column:
    """`rlike`, with those alternatives of the pattern that are plain words looked up as they are, which costs far less."""
    one = r"(?:\(\?:[a-z0-9 |]*\)|[a-z0-9 .*])+"
    options = re.findall(one, pattern) if re.fullmatch(rf"{one}(?:\|{one})*", pattern) else [pattern]
    plain = [o for o in options if re.fullmatch("[a-z0-9 ]+", o)]
    rest = [o for o in options if o not in plain]
    found = [F.contains(norm, F.lit(o)) for o in plain] + ([norm.rlike("|".join(rest))] if rest else [])
    return reduce(lambda a, b: a | b, found)


def paywall_flag(
    col: Column,
    explicit: str = PAYWALL_EXPLICIT,
    noun: str = PAYWALL_NOUN,
    verb: str = PAYWALL_VERB,
    max_chars: int = PAYWALL_CHARS,
    norm: Column | None = None,
) -> Column:
    """Whether the text is a teaser; `norm`, where given, is its normalised form."""
    def judge(n: Column) -> Column:
        short = F.length(F.trim(col)) < max_chars
        return has_any_of(n, explicit) | (short & n.rlike(noun) & n.rlike(verb))

    return bound(norm_text(col), judge) if norm is None else judge(norm)


EVIDENCE_MIN = 12


def evidence_exists(quote: Column, text: Column) -> Column:
    """True where the quote's skeleton is long enough and part of the text's skeleton."""
    needle = evidence_skeleton(F.coalesce(quote, F.lit("")))
    return (F.length(needle) >= EVIDENCE_MIN) & F.contains(evidence_skeleton(F.coalesce(text, F.lit(""))), needle)


def clamp01(col: Column) -> Column:
    """Number between 0 and 1; anything that is no finite number is 0."""
    x = col.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


# Named entities and what they stand for. The ampersand comes last.
ENTITIES_EXACT = {
    "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß",
    "&bdquo;": "„", "&ldquo;": "“", "&rdquo;": "”", "&sbquo;": "‚", "&lsquo;": "‘", "&rsquo;": "’",
}
ENTITIES_ANY_CASE = {
    "&nbsp;": " ", "&#160;": " ", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&ndash;": "–", "&mdash;": "—",
    "&shy;": "", "&hellip;": "…", "&euro;": "€", "&deg;": "°", "&laquo;": "«", "&raquo;": "»", "&middot;": "·",
    "&quot;": '"', "&#x27;": "'", "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">",
}


def decode_entities(col: Column) -> Column:
    """Named entities, decimal and hexadecimal references, and the ampersand last.

    The text is cut at its ampersands once; each piece starts with at most one entity, which is looked up or decoded.
    """
    exact = F.create_map(*[F.lit(x) for kv in ENTITIES_EXACT.items() for x in (kv[0][1:], kv[1])])
    loose = F.create_map(*[F.lit(x) for kv in ENTITIES_ANY_CASE.items() for x in (kv[0][1:], kv[1])])

    def decode(part: Column, i: Column) -> Column:
        def resolve(name: Column) -> Column:
            number = F.when(name.rlike(r"^#\d+;$"), F.regexp_extract(name, r"\d+", 0).try_cast("long")).when(
                name.rlike("^#x[0-9a-fA-F]+;$"), F.conv(F.regexp_extract(name, "x([0-9a-fA-F]+)", 1), 16, 10).try_cast("long"))
            valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
            char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
            known = F.coalesce(F.try_element_at(exact, name), F.try_element_at(loose, F.lower(name)), char)
            rest = F.substr(part, F.length(name) + 1)
            return F.coalesce(F.concat(known, rest), F.concat(F.lit("&"), part))

        found = F.regexp_extract(part, r"^(#?[A-Za-z0-9]+;)", 1)
        return F.when(i == 0, part).when(found == "", F.concat(F.lit("&"), part)).otherwise(F.transform(F.array(found), resolve)[0])

    text = F.array_join(F.transform(F.split(col, "&"), decode), "")
    return F.when(F.contains(col, F.lit("&")), F.regexp_replace(text, "(?i)&amp;", "&")).otherwise(col)


# One-line navigation and service texts, template leaks and no-script notices that are not article text.
BOILERPLATE_LINES = [
    "menu", "menü", "menü schließen", "schließen", "navigation", "newsletter", "jetzt anmelden", "jetzt bewerben",
    "mehr erfahren", "zur startseite", "weiter zum inhalt", "kontakt", "impressum", "datenschutz", "privacy", "cookie",
    "social media", "facebook", "instagram", "linkedin", "youtube", "copyright", "(c)", "©", "weitere artikel",
    "mehr zum thema", "lesen sie auch", "related articles", "sign up", "subscribe", "book tickets", "apply now",
    "anzeige", "advertisement", "werbung", "zum inhalt springen", "skip to content", "nachrichten", "startseite",
    "home", "teilen", "share", "drucken", "print", "newsletter abonnieren", "cookies akzeptieren", "mehr dazu",
    "alle akzeptieren", "suche", "suchen", "suchanfrage", "suche anzeigen", "suche öffnen", "e-mailen", "e-mail",
    "kopieren", "story-link in zwischenablage kopiert", "merken", "folgen", "abonnieren", "anmelden", "registrieren",
    "login", "weiterlesen", "zurück", "vor", "weiter",
]
TEMPLATE_LEAK = r"^\s*(\$\{[^}]*\}|\{\{[^}]*\}\})\s*$"
NO_SCRIPT = (r"(?i)\b(browser is out of date|enable javascript|javascript aktivieren|bitte aktivieren sie javascript"
             r"|to get the best experience|activez javascript)\b")


def clean_article_text(col: Column, max_chars: int | None = None) -> Column:
    """Article text without markup, navigation lines, fragments and repeated lines; blank lines stay as separators.

    All work happens inside the row. Repeated lines are found by sorting (key, position) pairs, so a document of n
    lines costs n log n and no shuffle.
    """
    text = decode_entities(F.coalesce(col, F.lit("")))

    def without_markup(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
        return F.when(F.contains(x, F.lit("<")), F.regexp_replace(plain, r"<[^>]+>", "\n")).otherwise(x)

    def prepare(raw: Column, i: Column) -> Column:
        def parts(line: Column) -> Column:
            plain = F.regexp_replace(F.regexp_replace(line, r"\*\*\s*\*\*", ""), r"(^|\s)\*{1,2}(\s|$)", "$1$2")
            shown = F.when(F.contains(line, F.lit("*")), F.trim(F.regexp_replace(plain, r"\s+", " "))).otherwise(line)
            return F.struct(shown.alias("line"), (line == "").alias("blank"), line.rlike(TEMPLATE_LEAK).alias("leak"), i.alias("pos"))

        # Runs of blanks that are one blank already stay as they are.
        return bound(F.trim(F.regexp_replace(raw, r"[\s\x{a0}](?:[\s\x{a0}]++|(?<! ))", " ")), parts)

    def judge(x: Column) -> Column:
        line = x["line"]

        def by_body(body: Column) -> Column:
            marked = line.rlike(r"^#{2,3}\s+") | line.rlike(r"^-\s+")
            few_words = ~body.rlike(r"^\s*+(?:\S++\s++){4}\S")
            fragment = ((F.length(body) < 30) | few_words) & ~body.rlike("[.!?:”»\")]$") & ~marked
            drop = (
                x["leak"]
                | (line == "-")
                | fragment
                | line.rlike(r"^#{1,6}\s*$")
                | ((F.length(line) < 160) & line.rlike("[»›]"))
                | ~line.rlike(r"[^*#\-•·➟>\s][*#\-•·➟>\s]*+[^*#\-•·➟>\s]")
                | F.lower(body).isin(*BOILERPLATE_LINES)
                | line.rlike(NO_SCRIPT)
            )
            # A line without a key is not kept.
            return F.when(~x["blank"] & ~drop, norm_text(body)).otherwise("")

        body = F.regexp_replace(F.regexp_replace(line, r"^#{2,3}\s+", ""), r"^-\s+", "")
        return bound(bound(body, by_body), lambda key: F.struct(
            key.alias("key"), x["pos"].alias("pos"), line.alias("line"), x["blank"].alias("blank"), (key != "").alias("keep")))

    text = bound(text, without_markup)
    judged = F.transform(F.transform(F.split(text, "\n"), prepare), judge)
    kept = F.array_sort(F.filter(judged, lambda x: x["keep"] | x["blank"]))

    def first_of_key(arr: Column) -> Column:
        return F.filter(arr, lambda x, i: x["blank"] | (i == 0) | (F.get(arr, i - 1)["key"] != x["key"]))

    # `transform` over a one-element array binds the sorted list once instead of repeating its expression.
    unique = F.transform(F.array(kept), first_of_key)[0]
    ordered = F.array_sort(
        F.transform(unique, lambda x: F.struct(x["pos"], F.when(x["blank"], "").otherwise(x["line"]).alias("line")))
    )
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    joined = F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return joined if max_chars is None else F.substring(joined, 1, max_chars)


PASSAGE_FEATURES = [
    # What makes a passage informative (method, finding, quantity, customer, trend).
    r"\b(methodik|methodology|stichprobe|sample|befrag\w*|interviews?|erheb\w*|respondent\w*)\b",
    r"\b(ergebnis\w*|findings?|zeigt|found|reveals?|fazit|conclusion\w*)\b",
    r"\b\d+(?:[.,]\d+)?\s*(?:%|prozent|percent|mio|million|mrd|billion)\b",
    r"\b(customer|consumer|shopper|kund\w*|konsum\w*|marketing|marke\w*|brand|retail|handel\w*)\b",
    r"\b(trend\w*|insight\w*|benchmark\w*|strategie|strategy|framework|handlungsfeld\w*)\b",
]


def select_passages(col: Column, max_chars: int = 12_000, features: Sequence[str] = PASSAGE_FEATURES) -> Column:
    """The most informative blocks of a long text in their order: first four, last four, then by feature score.

    The greedy choice is a fold: a block that does not fit is skipped, later smaller ones may still be taken.
    """
    blocks = F.split(col, r"(?=\s)(?:\n{2,}|(?<=[.!?])\s+(?=[A-ZÄÖÜ]))")

    def trimmed(b: Column, i: Column) -> Column:
        return bound(F.regexp_replace(b, r"^\s+|\s+$", ""), lambda x: bound(F.trim(x), lambda t: F.struct(F.length(t).alias("len"), i.alias("i"), t.alias("t"))))

    def score(t: Column) -> Column:
        return bound(norm_text(t), lambda n: reduce(lambda x, y: x + y, [n.rlike(p).cast("int") for p in features]))

    usable = F.filter(F.transform(blocks, trimmed), lambda x: x["len"] >= 40)

    def choose(arr: Column) -> Column:
        n = F.size(arr)

        def queue(x: Column, j: Column) -> Column:
            # Only blocks between the first and the last four are ranked by what they hold.
            rank = F.when(j < 4, 0).when(j >= n - 4, 1).otherwise(2)
            order = F.when((j < 4) | (j >= n - 4), 0).otherwise(-score(x["t"]))
            return F.struct(rank.alias("rank"), order.alias("o"), x["i"].alias("i"), x["len"].alias("len"),
                            x["t"].alias("t"))

        ranked = F.array_sort(F.transform(arr, queue))
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,t:string>>").alias("picked"))

        def take(acc: Column, x: Column) -> Column:
            fits = acc["used"] + x["len"] + 2 <= max_chars
            item = F.array(F.struct(x["i"].alias("i"), x["t"].alias("t")))
            return F.struct(
                F.when(fits, acc["used"] + x["len"] + 2).otherwise(acc["used"]).alias("used"),
                F.when(fits, F.concat(acc["picked"], item)).otherwise(acc["picked"]).alias("picked"),
            )

        picked = F.aggregate(ranked, start, take, lambda acc: acc["picked"])
        return F.array_join(F.transform(F.array_sort(picked), lambda x: x["t"]), "\n\n")

    chosen = F.substring(F.transform(F.array(usable), choose)[0], 1, max_chars)
    return F.when(F.length(col) <= max_chars, col).otherwise(chosen)


def sentences(col: Column, min_len: int = 20) -> Column:
    """Sentences in order, without heading marks, of at least `min_len` characters."""
    parts = F.split(F.coalesce(col, F.lit("")), r"(?=\s)(?:(?<=[.!?])\s+|\n+)")
    trimmed = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^#{1,6}\s*", ""), r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: F.length(s) >= min_len)


def truncate_clean(col: Column, limit: int) -> Column:
    """Blank-collapsed text of at most `limit` characters, ended at a sentence (60 % or more) or a word."""
    text = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    head = F.substring(text, 1, limit)
    tidy = [(r"[*~]+$", ""), (r"[\s,;:–-]+$", "")]
    sentence = F.regexp_extract(head, r"^(.*[.!?])[^.!?]*$", 1)
    word = F.when(head.rlike(r"\s"), F.regexp_replace(head, r"\s*\S*$", "")).otherwise(head)
    best = F.when(F.length(sentence) >= int(limit * 0.6), sentence).when(word == "", head).otherwise(word)
    best = reduce(lambda c, p: F.regexp_replace(c, *p), tidy, best)
    return F.when(F.length(text) <= limit, text).otherwise(best)


TAIL_MIN_CORE, TAIL_MIN_CUT = 80, 80


def editorial_core(col: Column, markers: Sequence[str]) -> Column:
    """Struct of `text`, `trimmed` and `removed`: the body before the earliest known tail marker."""
    source = F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", "")

    def at(marker: str) -> Column:
        pos = F.regexp_instr(source, F.lit(f"({marker})")) - 1
        return F.when(pos >= TAIL_MIN_CORE, pos)

    first = F.array_min(F.array(*[at(m) for m in markers]))
    text = F.regexp_replace(F.substring(source, 1, first), r"\s+$", "")
    removed = F.length(source) - F.length(text)
    cut = first.isNotNull() & (F.length(text) >= TAIL_MIN_CORE) & (removed >= TAIL_MIN_CUT)
    return F.struct(
        F.when(cut, text).otherwise(source).alias("text"), cut.alias("trimmed"),
        F.when(cut, removed).otherwise(0).alias("removed"),
    )


QUOTE_MIN, CORE_MIN_CHARS, CORE_MIN_SHARE, CORE_MIN_CUT = 30, 220, 0.2, 120


def core_at_quote(body: Column, quote: Column) -> Column:
    """Struct of `text`, `trimmed` and `valid`: the body up to the end of a quote found verbatim or blank-insensitively.

    The blank-insensitive search compares texts without any whitespace; the cut is the shortest prefix of the body
    whose non-blank characters reach the end of the match, found by a regex that allows blanks between them.
    """
    source = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    raw = F.regexp_replace(F.coalesce(quote, F.lit("")), r"^\s+|\s+$", "")
    flat = F.regexp_replace(raw, r"\s+", " ")
    direct = F.instr(source, raw)
    # Every blank of the collapsed quote may stand for any run of whitespace; the rest is matched literally.
    loose = F.concat(F.lit("(\\Q"), F.replace(flat, F.lit(" "), F.lit("\\E\\s+\\Q")), F.lit("\\E)"))
    found = F.regexp_substr(source, loose)
    end = F.when(direct > 0, direct - 1 + F.length(raw)).when(
        found.isNotNull(), F.instr(source, found) - 1 + F.length(found)
    )
    text = F.regexp_replace(F.substring(source, 1, end), r"\s+$", "")
    removed = F.length(source) - F.length(text)
    ok = (
        (F.length(flat) >= QUOTE_MIN) & (F.length(source) >= CORE_MIN_CHARS) & end.isNotNull()
        & (F.length(text) >= CORE_MIN_CHARS) & (F.length(text) >= F.length(source) * CORE_MIN_SHARE)
        & (removed >= CORE_MIN_CUT)
    )
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, text).otherwise(source).alias("text"), ok.alias("trimmed"), ok.alias("valid"))


ID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def valid_id(col: Column) -> Column:
    """Trimmed lower-case id where it has the uuid form, else null."""
    x = F.lower(F.trim(col))
    return F.when(x.rlike(ID_PATTERN), x)
