"""Company keys: folded names without punctuation, with or without legal forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgrain.functions.text import fold

# Words that do not tell companies apart, and words of file titles that do not either.
LEGAL_WORDS = ["ag", "co", "company", "corporation", "deutschland", "gmbh", "group", "gruppe", "holding", "inc",
               "incorporated", "kg", "markt", "plc", "se"]
TITLE_WORDS = [*LEGAL_WORDS, "aktuell", "current", "datei", "file", "jpeg", "jpg", "logo", "new", "neu", "official",
               "png", "svg", "webp"]


def company_key(col: Column, drop_words: Sequence[str] = ()) -> Column:
    """Folded letters and digits only; `&` reads as `und`, words of `drop_words` are left out."""
    folded = F.replace(fold(F.coalesce(col, F.lit(""))), F.lit("&"), F.lit(" und "))
    words = F.split(folded, "[^a-z0-9]+")
    if drop_words:
        words = F.filter(words, lambda w: ~w.isin(*drop_words))
    return F.array_join(words, "")


def slug(col: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")
