"""Figures in text: extraction, comparison keys, attestation against a source and structural text profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgrain.functions.text import NBSP, fold, norm_text

# A figure with thousands or decimal separators, bounded by non-digits.
FIGURE = r"(?<!\d)(\d{1,3}(?:\.\d{3})+|\d+\.\d+|\d+(?:,\d+)?|\d+)(?!\d)"

# German number words, units and fractions.
NUMBER_WORDS = {
    "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8",
    "neun": "9", "zehn": "10", "elf": "11", "zwölf": "12", "zwoelf": "12", "dreizehn": "13", "vierzehn": "14",
    "fünfzehn": "15", "fuenfzehn": "15", "sechzehn": "16", "siebzehn": "17", "achtzehn": "18", "neunzehn": "19",
    "zwanzig": "20", "dreißig": "30", "dreissig": "30", "vierzig": "40", "fünfzig": "50", "fuenfzig": "50",
    "sechzig": "60", "siebzig": "70", "achtzig": "80", "neunzig": "90", "hundert": "100",
}
UNITS = r"Prozent(?:punkte)?|%|Mrd\.?|Milliarden?|Millionen?|Mio\.?"
FRACTIONS = ["viertel", "drittel", "hälfte", "haelfte", "zehntel", "fünftel", "fuenftel"]
FRACTION_LEADS = ["ein", "eine", "einem", "einen", "zwei", "drei", "vier"]


def _plain(col: Column) -> Column:
    return F.translate(F.coalesce(col, F.lit("")), NBSP, " ")


def _let(value: Column, fn) -> Column:
    """Evaluate `value` once per row and hand it to `fn`."""
    return F.transform(F.array(value), fn)[0]


def claimed_numbers(col: Column) -> Column:
    """Distinct figures that count as claims: two or more digits, no year of 19xx/20xx, no day.month."""
    raw = F.array_distinct(F.regexp_extract_all(_plain(col), F.lit(FIGURE), F.lit(1)))

    def keep(x: Column) -> Column:
        digits = F.regexp_replace(x, r"\D", "")
        day_month = x.rlike(r"^(0?[1-9]|[12]\d|3[01])\.(0?[1-9]|1[0-2])$")
        return (F.length(digits) >= 2) & ~digits.rlike(r"^(19|20)\d{2}$") & ~day_month

    return F.filter(raw, keep)


def verbal_numbers(col: Column, words: dict[str, str] = NUMBER_WORDS, units: str = UNITS,
                   fractions=FRACTIONS, leads=FRACTION_LEADS) -> Column:
    """Distinct number words followed by a unit, and fractions such as `ein Viertel`."""
    alt = "|".join(sorted(words, key=len, reverse=True))
    text = _plain(col)
    with_unit = F.regexp_extract_all(text, F.lit(rf"(?iu)(?<![A-Za-z0-9_])((?:{alt})\s*(?:{units}))(?![A-Za-z0-9_])"), F.lit(1))
    frac = F.regexp_extract_all(
        text, F.lit(rf"(?iu)(?<![A-Za-z0-9_])((?:{'|'.join(leads)})\s+(?:{'|'.join(fractions)}))(?![A-Za-z0-9_])"), F.lit(1))
    tidy = F.transform(F.concat(with_unit, frac), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(tidy)


def _token_key(token: Column) -> Column:
    digits = F.regexp_replace(token, r"\D", "")
    return (
        F.when(token.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(token, F.lit("."), F.lit("")))
        .when(token.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(token, F.lit(","), F.lit("")))
        .when(token.rlike(r"^\d+,\d+$"), F.replace(token, F.lit(","), F.lit(".")))
        .when(token.rlike(r"^\d+\.\d+$"), token)
        .otherwise(digits)
    )


def number_key(col: Column) -> Column:
    """Comparison key: 1.234 is 1234, 13,3 is 13.3; falls back to two or more bare digits."""
    first = F.coalesce(F.get(claimed_numbers(col), F.lit(0)), F.lit(""))
    decimal = F.regexp_extract(_plain(col), r"(?<!\d)(\d+[,.]\d+)(?!\d)", 1)
    token = F.when(first != "", first).otherwise(decimal)
    digits = F.regexp_replace(F.coalesce(col, F.lit("")), r"\D", "")
    bare = F.when(F.length(digits) >= 2, digits).otherwise("")
    return _let(token, lambda x: F.when(x != "", _token_key(x)).otherwise(bare))


def corpus_facts(corpus: Column) -> Column:
    """What attestation needs from a source text, computed once: text, figure keys, digit runs, word set."""
    text = _plain(corpus)
    return F.struct(
        text.alias("text"),
        F.lower(text).alias("lower"),
        F.array_distinct(F.transform(claimed_numbers(text), _token_key)).alias("keys"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))).alias("runs"),
        F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("words"),
    )


def _number_attested(claim: Column, facts: Column) -> Column:
    key = number_key(claim)
    by_key = (key != "") & (F.array_contains(facts["keys"], key) | (key.rlike(r"^\d+$") & F.array_contains(facts["runs"], key)))
    return F.contains(facts["text"], claim) | by_key


def attested(claim: Column, facts: Column) -> Column:
    """Literal, key-equal, digit-bounded or number-word match; a fraction only counts as the same fraction."""
    c = F.trim(_plain(claim))
    low = F.lower(c)
    fraction = F.regexp_extract(low, "(" + "|".join(FRACTIONS) + ")", 1)
    word = F.regexp_extract(low, "(" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")", 1)
    digits = F.regexp_replace(c, r"\D", "")
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(d).alias("d")) for w, d in NUMBER_WORDS.items()])
    word_digit = F.filter(table, lambda r: r["w"] == word)[0]["d"]
    same_digit = F.exists(table, lambda r: (r["d"] == digits) & F.array_contains(facts["words"], r["w"]))
    return (c != "") & (
        F.contains(facts["lower"], low)
        | _number_attested(c, facts)
        | F.when(fraction != "", F.contains(facts["lower"], fraction))
        .when(word != "", F.array_contains(facts["words"], word) | _number_attested(word_digit, facts))
        .otherwise((digits != "") & same_digit)
    )


def unattested_claims(claim: Column, corpus: Column) -> Column:
    """Figures and number words of `claim` that the corpus does not contain; an empty corpus finds nothing."""
    claims = F.array_distinct(F.concat(claimed_numbers(claim), verbal_numbers(claim)))
    missing = F.transform(F.array(corpus_facts(corpus)), lambda f: F.filter(claims, lambda c: ~attested(c, f)))[0]
    return F.when(F.coalesce(corpus, F.lit("")) == "", F.array().cast("array<string>")).otherwise(missing)


def figures_in_context(col: Column, before: int = 48, after: int = 72) -> Column:
    """Array of (figure, snippet): each claimed figure with its surroundings and ellipses where text is cut."""
    text = _plain(col)

    def snippet(fig: Column) -> Column:
        def build(at: Column) -> Column:
            start = F.greatest(F.lit(0), at - before)
            end = F.least(F.length(text), at + F.length(fig) + after)
            body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"\s+", " "))
            return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))

        return F.struct(fig.alias("figure"), _let(F.instr(text, fig) - 1, build).alias("snippet"))

    return F.transform(claimed_numbers(col), snippet)


def percent_value(col: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(col, F.lit("")), r"(?i)(-?\d{1,3}(?:[.,]\d+)?)\s*(?:%|Prozent)", 1)
    return F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")


def percent_values(col: Column) -> Column:
    raw = F.regexp_extract_all(col, F.lit(r"(?i)(-?\d{1,3}(?:[.,]\d+)?)\s*(?:%|Prozent)\b"), F.lit(1))
    return F.transform(raw, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


def magnitude(col: Column) -> Column:
    """Signed number in German notation times thousand, million or billion words."""
    raw = F.regexp_extract(
        F.coalesce(col, F.lit("")),
        r"(?<!\d)([-+]?\s*(?:\d{1,3}(?:[.\s]\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?))(?!\d)", 1)
    clean = F.regexp_replace(F.regexp_replace(raw, r"\s", ""), r"\.(?=\d{3}(?:\D|$))", "")
    value = F.replace(clean, F.lit(","), F.lit(".")).try_cast("double")
    low = norm_text(col)
    factor = (
        F.when(low.rlike(r"\bmrd\b|milliard"), 1e9).when(low.rlike(r"\bmio\b|million"), 1e6)
        .when(low.rlike(r"\btsd\b|tausend"), 1e3).otherwise(1.0)
    )
    return value * factor


def unit_of(col: Column) -> Column:
    low = norm_text(col)
    rest = F.trim(F.regexp_replace(low, r"\d+", ""))
    return (
        F.when(col.rlike("(?i)%|prozent"), "%").when(low.rlike("eur|euro") | F.contains(col, F.lit("€")), "eur")
        .when(low.rlike("usd|dollar") | F.contains(col, F.lit("$")), "usd").otherwise(rest)
    )


def _hundred_triple(values: Column) -> Column:
    """Three of the values sum to 99..101. Three copies of a value suffice, which bounds the triples tried."""

    def test(v: Column) -> Column:
        n = F.size(v)
        index = F.when(n >= 3, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(index, lambda i: F.exists(index, lambda j: (j > i) & F.exists(
            index, lambda k: (k > j) & (F.get(v, i) + F.get(v, j) + F.get(v, k)).between(99, 101))))

    distinct = F.array_distinct(values)
    bounded = F.flatten(F.transform(distinct, lambda d: F.slice(F.filter(values, lambda x: x == d), 1, 3)))
    return _let(bounded, test)


# Word patterns (folded text) behind the structural features.
PROFILE_WORDS = {
    "sequence": r"\b(?:zuerst|erstens|zweitens|drittens|danach|anschliessend|schliesslich|phase|schritt|stufe)\b",
    "process": r"\b(?:ablauf|prozess|vorgehen|schritt fuer schritt)\b",
    "roadmap": r"\b(?:woche|monat|quartal|phase|etappe|zuerst|danach|anschliessend|schliesslich)\b",
    "contrast": r"(?i)\b(?:mythos|irrtum|fehlannahme|entgegen|stattdessen|nicht\s+.{1,45}\s+sondern)\b",
    "list": r"\b(?:drei|vier|funf|3|4|5)\s+(?:hebel|grunde|faktoren|prinzipien|felder|massnahmen|saulen)\b",
    "intersection": r"\b(?:schnittmenge|zusammenspiel|kombination|sweet spot|verbindet)\b",
    "three": r"\b(?:drei|3)\b",
    "maturity": r"\b(?:reifegrad|reifestufe|maturity|basisstufe|fortgeschritten|exzellenzstufe)\b",
    "house": r"\b(?:strategiehaus|strategisches haus|fundament)\b",
    "pillar": r"\b(?:saule|saulen|dach)\b",
    "funnel": r"\b(?:funnel|trichter|conversion|reichweite|impression|klick|lead|abschluss|bindung)\b",
    "from_to": r"\bvon\b.{0,60}\bauf\b",
    "delta": r"\b(?:veranderung|delta|plus|minus|anstieg|ruckgang|zuwachs)\b",
    "comparison": r"\b(?:vergleich|gegenuber|jeweils|kategorie|segmente|gruppen|regionen)\b",
}


def evidence_profile(article: Column, signal: Column | None = None, words: dict[str, str] = PROFILE_WORDS) -> Column:
    """Struct of observable features: figure counts, quotes, lists, sequences, series, shares and so on."""
    signal = F.lit("") if signal is None else signal
    corpus = F.concat_ws("\n", article, signal)
    facts = F.struct(
        corpus.alias("c"), norm_text(corpus).alias("n"),
        percent_values(article).alias("pa"), percent_values(signal).alias("ps"),
        F.size(F.array_distinct(F.filter(F.transform(claimed_numbers(corpus), _token_key), lambda k: k != ""))).alias("nums"),
        F.size(F.array_distinct(F.regexp_extract_all(corpus, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))).alias("years"),
    )

    def features(x: Column) -> Column:
        c, n, nums = x["c"], x["n"], x["nums"]
        bullets = F.regexp_count(c, F.lit(r"(?m)^[ \t]*(?:[-–•]|\d+[.)])[ \t]+\S"))
        seq = F.regexp_count(n, F.lit(words["sequence"]))
        share = lambda p: (F.size(p) >= 3) & _hundred_triple(p)
        flags = {
            "has_quote": c.rlike('„[^“\n]{24,240}“|“[^”\n]{24,240}”|"[^"\n]{24,240}"'),
            "has_contrast": c.rlike(words["contrast"]),
            "has_list": (bullets >= 3) | n.rlike(words["list"]),
            "has_sequence": (seq >= 2) | n.rlike(words["process"]),
            "has_intersection": n.rlike(words["intersection"]) & n.rlike(words["three"]),
            "has_maturity": n.rlike(words["maturity"]),
            "has_house": n.rlike(words["house"]) & n.rlike(words["pillar"]),
            "has_funnel": n.rlike(words["funnel"]),
            "has_time_series": (x["years"] >= 3) & (nums >= 3),
            "has_waterfall": n.rlike(words["from_to"]) & n.rlike(words["delta"]) & (nums >= 3),
            "has_composition": share(x["pa"]) | share(x["ps"]),
            "has_comparison": (nums >= 4) & n.rlike(words["comparison"]),
            "has_roadmap": F.regexp_count(n, F.lit(words["roadmap"])) >= 4,
        }
        return F.struct(nums.alias("number_count"), F.greatest(F.size(x["pa"]), F.size(x["ps"])).alias("percent_count"),
                        *[v.alias(k) for k, v in flags.items()])

    return _let(facts, features)


def eligible_templates(profile: Column, dark: Column, carousel: Column) -> Column:
    """Template labels whose data or argument structure the profile really contains, per theme.

    Labels, their order and what each of them needs are fixed values.
    """
    p, n = profile, profile["number_count"]
    dark_rules = [("M", F.lit(True)), ("A", p["has_quote"]), ("H", n >= 2), ("S2", p["has_maturity"]),
                  ("S4", p["has_funnel"] & p["has_sequence"])]
    light_rules = [
        ("B", F.lit(True)), ("E", n >= 1), ("F", p["has_list"] | carousel), ("G", p["has_contrast"]),
        ("I", p["has_sequence"]), ("K", p["has_contrast"]), ("L", (n >= 1) & p["has_list"]),
        ("S1", p["has_intersection"]), ("S3", p["has_house"]), ("T1", p["has_time_series"]),
        ("T2", p["has_waterfall"]), ("T3", p["has_composition"]), ("T4", p["has_comparison"]),
        ("T5", p["has_funnel"] & (n >= 5)), ("T6", p["has_roadmap"]),
    ]

    def pick(rules):
        return F.array_compact(F.array(*[F.when(cond, label) for label, cond in rules]))

    return F.when(dark, pick(dark_rules)).otherwise(pick(light_rules))


# What makes a figure a measured value, and what marks an age group or rank instead.
LEAD_UNIT = rf"(?iu)^\s*(?:{UNITS}|Euro|€|Punkte?|Mal|Milliarde|Million)"
COHORT_BEFORE = (r"(?iu)(?:generation|gen\.?|kohorte|jahrgang|altersgruppe|zielgruppe|ü|ab|über|ueber|unter|top|platz"
                 r"|kapitel|teil|stufe|frage)\s*$")
COHORT_AFTER = r"(?iu)^\s*(?:\+|-\s*(?:jährige|jaehrige|jaehrig|jährig)|er-jahre|er\s+jahre|plus\b)"


def lead_numbers(col: Column) -> Column:
    """Digits of figures that carry a unit and are not cohort labels, plus number words with a unit."""
    text = _plain(col)

    def carries_unit(fig: Column) -> Column:
        # Walk over all occurrences: the text is split at the figure, each cut has a left and a right side.
        parts = F.split(text, F.concat(F.lit("\\Q"), fig, F.lit("\\E")), -1)
        cuts = F.sequence(F.lit(1), F.size(parts) - 1)

        def around(start: Column, count: Column | int) -> Column:
            return F.call_function("array_join", F.slice(parts, start, count), fig)

        def at(i: Column) -> Column:
            # Figures have two or more characters, so thirteen pieces always cover 24 characters.
            left = F.right(around(F.greatest(F.lit(1), i - 12), F.least(i, F.lit(13))), F.lit(24))
            right = F.left(around(i + 1, 13), F.lit(24))
            return ~left.rlike(COHORT_BEFORE) & ~right.rlike(COHORT_AFTER) & right.rlike(LEAD_UNIT)

        return F.when(F.size(parts) > 1, F.exists(cuts, at)).otherwise(F.lit(False))

    figures = F.transform(F.filter(claimed_numbers(col), carries_unit), lambda x: F.regexp_replace(x, r"\D", ""))
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(d).alias("d")) for w, d in NUMBER_WORDS.items()])
    alt = "(" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
    verbal = F.filter(verbal_numbers(col), lambda x: ~F.lower(x).rlike("|".join(FRACTIONS)))
    spoken = F.transform(verbal, lambda v: F.filter(table, lambda r: r["w"] == F.regexp_extract(F.lower(v), alt, 1))[0]["d"])
    return F.array_distinct(F.filter(F.concat(figures, spoken), lambda d: F.length(d) >= 2))


def fold_long(col: Column) -> Column:
    """Lower case with umlauts written as two letters."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])),
                  [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")], F.lower(F.coalesce(col, F.lit(""))))


# Endings that are cut off, the least length of a stem, and the share of stems that must match.
STEM_ENDINGS, STEM_CHARS, STEM_SHARE = "(?:en|er|es|te|ten|t|e)$", 4, 0.55


def content_stems(col: Column, stop: list[str]) -> Column:
    parts = F.transform(F.split(fold_long(col), "[^a-z0-9]+"), lambda t: F.regexp_replace(t, STEM_ENDINGS, ""))
    return F.filter(parts, lambda t: (F.length(t) >= STEM_CHARS) & ~t.isin(*stop))


def paraphrases(title: Column, source: Column, stop: list[str]) -> Column:
    """True where the title is contained in the source or most of its stems prefix-match stems of the source."""
    inputs = F.struct(
        F.trim(F.regexp_replace(fold_long(title), "[^a-z0-9]+", " ")).alias("nt"),
        F.regexp_replace(fold_long(source), "[^a-z0-9]+", " ").alias("ns"),
        content_stems(title, stop).alias("a"), F.array_distinct(content_stems(source, stop)).alias("b"),
    )

    def verdict(x: Column) -> Column:
        hits = F.size(F.filter(x["a"], lambda t: F.exists(x["b"], lambda u: F.startswith(u, t) | F.startswith(t, u))))
        n = F.size(x["a"])
        enough = F.when(n <= 3, hits >= 2).otherwise(hits / n >= STEM_SHARE)
        contained = (F.length(x["nt"]) >= 18) & F.contains(x["ns"], x["nt"])
        return contained | F.when((n < 2) | (F.size(x["b"]) < 2), F.lit(False)).otherwise(enough)

    return (F.trim(F.coalesce(source, F.lit(""))) != "") & _let(inputs, verdict)


def semantic_tokens(col: Column, stop: list[str]) -> Column:
    """Words of five or more characters without stop words, together with their lightly stemmed forms."""
    base = F.filter(F.array_distinct(F.split(norm_text(col), " ")), lambda w: (F.length(w) >= 5) & ~w.rlike(r"^\d+$") & ~w.isin(*stop))

    def with_stems(words: Column) -> Column:
        stems = F.transform(F.filter(words, lambda w: F.length(w) >= 7), lambda w: F.regexp_replace(w, "(?:ern|en|er|es|em|e|s)$", ""))
        return F.array_distinct(F.concat(words, F.filter(stems, lambda w: F.length(w) >= 5)))

    return _let(base, with_stems)


def semantic_overlap(claim: Column, context: Column, stop: list[str]) -> Column:
    """Phrase containment, two shared stems, or one shared stem of eight or more characters."""
    c, s = norm_text(claim), norm_text(context)
    shared = F.array_intersect(semantic_tokens(claim, stop), semantic_tokens(context, stop))
    overlap = _let(shared, lambda a: (F.size(a) >= 2) | F.exists(a, lambda w: F.length(w) >= 8))
    return ((F.length(c) >= 4) & F.contains(s, c)) | overlap
