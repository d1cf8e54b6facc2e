"""Dashboard views: facets, orders, pages, run status, manual entries, error classes and topic keywords."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.functions.text import contains_term, norm_text


def facet_filter(df: DataFrame, selections: Mapping[str, Sequence[str]], search: str = "", search_cols: Sequence[str] = (),
                 array_selections: Mapping[str, Sequence[str]] | None = None, only: Column | None = None) -> DataFrame:
    """Rows in all selected facets; an empty selection means all. Free text is looked up in the joined fields."""
    out = df if only is None else df.where(only)
    for col, values in selections.items():
        if values:
            out = out.where(F.col(col).isin(*values))
    for col, values in (array_selections or {}).items():
        if values:
            out = out.where(F.arrays_overlap(F.col(col), F.array(*[F.lit(v) for v in values])))
    if search.strip():
        hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in search_cols]))
        out = out.where(F.contains(hay, F.lit(search.strip().lower())))
    return out


MODES = ("newest", "confidence", "default")


def ranked_view(df: DataFrame, mode: str, as_of: Column, status_rank: Mapping[str, int], limit: int) -> DataFrame:
    """First rows of a view in one of its orders; the id settles ties."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in status_rank.items() for x in kv]), F.col("status")), F.lit(len(status_rank)))
    today = F.to_date("ts") == F.to_date(as_of)
    orders = {
        "newest": [F.desc_nulls_last("ts"), F.asc("id")],
        "confidence": [F.desc_nulls_last("confidence"), F.desc_nulls_last("ts"), F.asc("id")],
        "default": [F.desc(today.cast("int")), rank.asc(), F.desc_nulls_last("confidence"), F.desc_nulls_last("ts"), F.asc("id")],
    }
    return df.orderBy(*orders[mode]).limit(limit)


def locale_sort(df: DataFrame, col: str, descending: bool = False, locale: str = "de_CI") -> DataFrame:
    key = F.collate(F.col(col), locale)
    return df.orderBy(key.desc() if descending else key.asc(), F.col(col))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int, cap: int | None = None) -> DataFrame:
    """One page in order. Spark still sorts what lies before the offset; `page_after` continues from a key instead."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, limit if cap is None else min(limit, cap)))


def page_after(df: DataFrame, key: Sequence[tuple[str, object]], limit: int) -> DataFrame:
    """Next page after the last seen key values, in ascending order of the key columns."""
    later = F.lit(False)
    same = F.lit(True)
    for col, value in key:
        later = later | (same & (F.col(col) > F.lit(value)))
        same = same & (F.col(col) == F.lit(value))
    return df.where(later).orderBy(*[c for c, _ in key]).limit(limit)


def newest_pool(df: DataFrame, ts: str, key: str, n: int | None, default: int = 1_000, cap: int | None = None) -> DataFrame:
    size = max(1, default if n is None else n)
    size = size if cap is None else min(size, cap)
    return df.orderBy(F.desc(ts), F.desc(key)).limit(size)


def nulls_last(df: DataFrame, col: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(col), F.asc(tie)).limit(limit)


def union_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_minus(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).distinct().join(b.select(on).distinct(), on, "left_anti")


def run_status(runs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Run to show: an active one before the newest; an error counts only if it is the newest run's."""
    order = F.struct(F.col("status").isin("queued", "running"), "ts", "run_id")
    shown = F.max_by(F.struct("run_id", "status"), order).alias("s")
    newest = F.max_by("status", F.struct("ts", "run_id")).alias("newest")
    out = runs.groupBy(*group).agg(shown, newest)
    label = F.when(F.col("s.status").isin("queued", "running"), "running").when(F.col("newest") == "error", "failed").otherwise("none active")
    tone = F.when(label == "running", "working").when(label == "failed", "error").otherwise("idle")
    return out.select(*group, F.col("s.run_id").alias("run_id"), F.col("s.status").alias("status"), label.alias("label"), tone.alias("tone"))


def error_class(text: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """First category whose pattern matches the error text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for name, pattern in reversed(list(rules)):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return F.when(low == "", F.lit(None)).otherwise(out)


# Limits of the fields of a manual entry, minimum lengths, and the labels of its context block.
MANUAL_LIMITS = {"headline": 200, "core": 1_200, "relevance": 800, "evidence": 2_000, "source": 300, "company": 120,
                 "offering": 200, "signal_label": 80, "audience": 300, "territory": 120, "occasion": 300,
                 "competitor": 300, "tone": 300}
MANUAL_MINIMUM = {"headline": 10, "core": 30, "evidence": 20}
MANUAL_CONTEXT = [("Quelle", "source"), ("Unternehmen", "company"), ("Zielgruppe", "audience"), ("Markt", "territory"),
                  ("Anlass", "occasion"), ("Wettbewerb", "competitor"), ("Anschluss", "offering")]
RELEVANCE_TITLE, EVIDENCE_TITLE, CONTEXT_TITLE = "Warum es zählt:", "Belege und Zahlen:", "Kontext:"


def _field(col: Column, limit: int | None) -> Column:
    text = F.regexp_replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\r"), F.lit("")), r"[ \t]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return text if limit is None else F.substring(text, 1, limit)


def manual_signal(entries: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Normalised manual entries, cut where `limits` names a field, with lane, mode, the first field that is too short (`issue`) and the corpus text."""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    lane = F.when(text("lane").rlike("sales|ansprache|memo"), "sales").otherwise("marketing")
    mode = F.when(text("mode").isin("manual", "hybrid"), text("mode")).otherwise("ai")
    rows = entries.select("entry_id", lane.alias("lane"), mode.alias("mode"), *[
        (_field(F.col(c), (limits or {}).get(c)) if c in entries.columns else F.lit("")).alias(c) for c in MANUAL_LIMITS])
    issue = F.coalesce(*[F.when(F.length(c) < n, F.lit(c)) for c, n in MANUAL_MINIMUM.items()])
    context = F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in MANUAL_CONTEXT]))
    parts = F.array_compact(F.array(
        F.col("headline"), F.lit(""), F.col("core"),
        F.when(F.col("relevance") != "", F.concat(F.lit(f"\n{RELEVANCE_TITLE}\n"), F.col("relevance"))),
        F.lit(""), F.lit(EVIDENCE_TITLE), F.col("evidence"),
        F.when(F.size(context) > 0, F.concat(F.lit(f"\n{CONTEXT_TITLE}\n"), F.array_join(context, "\n")))))
    corpus = F.regexp_replace(F.array_join(parts, "\n"), r"^\s+|\s+$", "")
    return rows.select("*", issue.alias("issue"), corpus.alias("corpus"))


def manual_rows(entries: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Article rows and signal rows of the complete manual entries."""
    good = manual_signal(entries).where("issue is null")
    null_if_blank = lambda c: F.when(F.col(c) != "", F.col(c))
    many = lambda c: F.array_compact(F.array(null_if_blank(c)))
    kind = F.lit("manual")
    article = good.select(
        F.col("entry_id").alias("article_id"), F.concat(F.lit("manual://signal/"), "entry_id").alias("url"), F.col("headline").alias("title"),
        F.col("corpus").alias("content"), as_of.alias("published_at"), kind.alias("article_type"), kind.alias("classification_status"),
        many("signal_label").alias("topics"), null_if_blank("territory").alias("territory"))
    signal = good.select(
        F.col("entry_id").alias("article_id"), F.lit("signal").alias("status"), "lane", null_if_blank("signal_label").alias("signal_label"),
        F.lit(0).alias("score"), "evidence", F.coalesce(null_if_blank("relevance"), F.col("core")).alias("why"), F.col("core").alias("summary"),
        null_if_blank("company").alias("company"), kind.alias("article_type"), null_if_blank("offering").alias("offering"),
        many("audience").alias("buying_center_roles"), null_if_blank("occasion").alias("trigger"))
    return article, signal


def without_manual(df: DataFrame, type_col: str) -> DataFrame:
    """Report rows: everything that is not a manual entry, an unknown type included."""
    return df.where(F.coalesce(F.col(type_col), F.lit("")) != "manual")


def case_guard(cases: DataFrame, group: str, subject: str, negative: str, reason: Column, need: int = 3, least: int = 24) -> DataFrame:
    """First three usable cases per group: complete, long enough, positive, not the subject, not named in the reason.

    Groups with fewer than three usable cases drop out.
    """
    from pressgrain.operators.ranking import top_k

    full = (F.trim("name") != "") & (F.trim("tag") != "") & (F.length(F.trim("text")) >= least)
    rows = cases.where(full & ~F.concat_ws(" ", "text", "tag").rlike(negative) & (F.lower("name") != F.lower(F.col(subject))))
    rows = rows.where(~contains_term(norm_text(reason), F.col("name")))
    ranked = top_k(rows, [group], [F.asc("pos")], need)
    enough = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= need).select(group)
    return ranked.join(enough, group, "left_semi")


def topic_keywords(text: Column, k: int, stop: Sequence[str]) -> Column:
    """First `k` distinct words of more than three letters that are neither stop words nor numbers."""
    keep = F.filter(F.split(norm_text(text), " "), lambda w: (F.length(w) > 3) & ~w.isin(*stop) & ~w.rlike(r"^\d+$"))
    return F.slice(F.array_distinct(keep), 1, k)


def sector_and_situations(text: Column, sectors: Sequence[tuple[str, str]], situations: Sequence[tuple[str, str]], k: int = 2) -> Column:
    """Struct of the first matching sector and the first `k` matching situations."""
    def pick(n: Column) -> Column:
        hit = lambda rules: F.array_compact(F.array(*[F.when(n.rlike(p), F.lit(name)) for name, p in rules]))
        return F.struct(F.get(hit(sectors), F.lit(0)).alias("sector"), F.slice(hit(situations), 1, k).alias("situations"))

    return F.transform(F.array(norm_text(text)), pick)[0]
