"""Checks of text fields against length, sentence, number and link limits, as long rows (field, check, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the fields, and what counts as link, number and quote.
LIMITS = {"hook": 140, "strong_from": 1300, "strong_to": 2500, "hard": 3000, "carousel": 900, "cta": 42, "cover": 56}
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"']{4,}|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+/[^\s<>\"']*"
NUMBER = r"(?i)(?<!\d)\d+(?:[.,]\d+)?\s?(?:%|prozent|prozentpunkte|mio|mrd|millionen|milliarden|euro|€)?"
QUOTE = "[„\"»][^\"“«]{12,}[\"\"«]|[„\"][^\"“]{12,}"


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?]+(?:\s|$)"), lambda s: F.trim(s) != ""))


def first_line(text: Column) -> Column:
    return F.trim(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")[0])


def number_count(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.trim(x))
    return F.size(F.array_distinct(F.filter(found, lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 2)))


def _grade(*cases) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for cond, level in cases[1:-1]:
        out = out.when(cond, level)
    return out.otherwise(cases[-1])


def checks(field: str, text: Column, carousel: Column, lane: Column) -> list[tuple[str, Column]]:
    """(check name, severity or null where the check does not apply) for one field."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    n = F.length(trimmed)
    sents = sentence_count(trimmed)
    lim = LIMITS
    if field == "caption":
        hook = F.length(first_line(text))
        strong = n.between(lim["strong_from"], lim["strong_to"])
        ending = F.right(text, F.lit(220))
        return [
            ("hook_length", _grade((hook == 0, "info"), (hook <= lim["hook"], "ok"), "warn")),
            ("line_break", F.when((hook > 0) & ~F.contains(trimmed, F.lit("\n")), "warn")),
            ("length", F.when(carousel, _grade((n <= lim["carousel"], "ok"), "warn")).otherwise(
                _grade((n > lim["hard"], "warn"), (strong, "ok"), "info"))),
            ("question", F.when((n > 200) & ~ending.rlike(r"(?i)\?|\bwie\b|\bwas\b|\bwelche"), "info")),
        ]
    if field == "cta":
        verb = trimmed.rlike(r"^[A-ZÄÖÜ][a-zäöüß]+(en|ern|eln)\b")
        return [
            ("length", _grade((n == 0, "info"), (n <= lim["cta"], "ok"), "warn")),
            ("form", F.when(lane == "sales", _grade((trimmed.rlike(r"\?$"), "ok"), "info")).when(
                n > 0, _grade((verb, "ok"), "info"))),
        ]
    if field == "storyline":
        return [
            ("sentences", _grade((n == 0, "info"), (sents <= 2, "ok"), "warn")),
            ("spread", F.when(carousel, "info")),
            ("number", F.when((n > 0) & ~trimmed.rlike(r"\d"), "info")),
        ]
    if field == "headline":
        return [
            ("length", _grade((n == 0, "info"), (n <= lim["cover"], "ok"), "info")),
            ("one_sentence", F.when(n > 0, _grade((sents == 1, "ok"), "warn"))),
        ]
    if field == "evidence":
        nums, quotes = number_count(text), F.regexp_count(text, F.lit(QUOTE))
        return [
            ("numbers", _grade((nums > 0, "ok"), "warn")),
            ("possible", F.when((nums >= 1) | (quotes >= 1), "info")),
            ("quote", F.when(quotes == 0, "info")),
        ]
    if field == "source":
        link = trimmed.rlike(URL)
        return [
            ("link", _grade((n == 0, "info"), (link, "ok"), "warn")),
            ("year", F.when((n > 0) & ~link & ~trimmed.rlike(r"\d{4}"), "info")),
        ]
    if field == "core":
        return [("sentences", _grade((n == 0, "info"), (sents.between(2, 4), "ok"), "info"))]
    raise ValueError(f"unknown field {field}")


def text_lint(df: DataFrame, key: str, fields: dict[str, str], carousel: Column, lane: Column) -> DataFrame:
    """One row per (key, field, check) that applies; `fields` maps field kinds to columns."""
    found = [
        F.struct(F.lit(field).alias("field"), F.lit(name).alias("check"), severity.alias("severity"))
        for field, column in fields.items()
        for name, severity in checks(field, F.coalesce(F.col(column), F.lit("")), carousel, lane)
    ]
    rows = df.select(key, F.explode(F.array(*found)).alias("c")).select(key, "c.*")
    return rows.where(F.col("severity").isNotNull())


def slide_advice(count: Column, low: int = 6, high: int = 12) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n == 0, F.lit(None)).when(n < low, "info").when(n > high, "warn").otherwise("ok")
