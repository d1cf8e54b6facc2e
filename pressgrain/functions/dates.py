"""Dates written in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgrain.functions.text import fold

# German month names (folded) by number.
MONTHS = {"januar": 1, "februar": 2, "maerz": 3, "marz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8,
          "september": 9, "oktober": 10, "november": 11, "dezember": 12}
ISO = r"\b(20\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b"
NUMERIC = r"\b([0-3]?\d)\.\s?([01]?\d)\.\s?(20\d{2})\b"
LONG = r"\b([0-3]?\d)\.?\s+(" + "|".join(MONTHS) + r")\s+(20\d{2})\b"


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def parse_date_text(col: Column) -> Column:
    """First ISO, numeric German or long German date of a short text; an impossible calendar day is null."""
    low = fold(col)
    iso = F.regexp_extract(col, ISO, 0)
    part = lambda pat, i, src=col: F.regexp_extract(src, pat, i)
    numeric_ok = part(NUMERIC, 1).try_cast("int").between(1, 31) & part(NUMERIC, 2).try_cast("int").between(1, 12)
    month = F.create_map(*[x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))])
    long_name = part(LONG, 2, low)
    return (
        F.when(iso != "", F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))
        .when(numeric_ok, _date(part(NUMERIC, 3), part(NUMERIC, 2), part(NUMERIC, 1)))
        .when(long_name != "", _date(part(LONG, 3, low), F.try_element_at(month, long_name), part(LONG, 1, low)))
    )


VISIBLE = r"(^|[^0-9])([0-3][0-9][./-][01][0-9][./-]20[0-9]{2})([^0-9]|$)"


def visible_date(content: Column, head: int | None = None) -> Column:
    """First dd.mm.yyyy (or / or -) of the text, or of its first `head` characters, that survives a format round trip."""
    raw = F.regexp_replace(F.regexp_extract(content if head is None else F.left(content, F.lit(head)), VISIBLE, 2), "[/-]", ".")
    day = F.to_date(F.try_to_timestamp(raw, F.lit("dd.MM.yyyy")))
    return F.when(F.date_format(day, "dd.MM.yyyy") == raw, day)
