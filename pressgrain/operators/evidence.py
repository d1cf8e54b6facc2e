"""Quotes checked against article text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pressgrain.functions.numbers import semantic_tokens
from pressgrain.functions.text import EVIDENCE_MIN, FOLD_FROM, FOLD_LONG, FOLD_TO, _code_ranges, bound, evidence_skeleton, norm_text
from pressgrain.operators.dedup import written
from pressgrain.scale import broadcast_if_small, is_small


# First characters of the grams that serve as meeting points, rarest class first; together they cover folded text.
GRAM_STARTS = ["[bfgkpvwz0-9]", "[cdhlmuq]", "[aijorsxy]", "[etn ]"]


def _grams(skeleton: Column, n: int, start: str = ".") -> Column:
    """Overlapping character grams that begin with `start`, found in one pass."""
    return F.regexp_extract_all(skeleton, F.lit(f"(?=({start}.{{{n - 1}}}))"), F.lit(1))


def contained_pairs(hays: DataFrame, needles: DataFrame, gram: int, few: int = 2_000) -> DataFrame:
    """All (doc_id, item_id, needle) where a needle of at least `gram` characters occurs in a hay.

    Candidates meet on a character gram by equality and only they are compared in full. A needle is looked up by its
    smallest gram of the rarest class of first characters it has, and a hay emits its grams of that class, so a
    contained needle always meets its hay. Classes that no needle uses are not emitted; most needles own a gram of the
    first class, which is about an eighth of all grams. At most `few` different needles are looked for in each hay as they
    are, which costs less than its grams.
    """
    q = needles.select("item_id", "needle").where(F.length("needle") >= gram)
    if is_small(q, few):
        each = q.groupBy("needle").agg(F.collect_list("item_id").alias("items"))
        each = F.broadcast(each.agg(F.collect_list(F.struct("needle", "items")).alias("__needles")))
        hits = hays.select("doc_id", "hay").crossJoin(each).select("doc_id", F.explode(F.filter("__needles", lambda x: F.contains(F.col("hay"), x["needle"]))).alias("x"))
        return hits.select("doc_id", F.explode("x.items").alias("item_id"), F.col("x.needle").alias("needle"))
    found = [F.array_min(_grams(F.col("needle"), gram, start)) for start in GRAM_STARTS]
    picks = [F.when(g.isNotNull(), F.struct(F.lit(i).alias("level"), g.alias("gram"))) for i, g in enumerate(found)]
    q = q.withColumn("pick", F.coalesce(*picks)).select("item_id", "needle", "pick.*")
    used = sorted(r["level"] for r in q.where("level is not null").select("level").distinct().collect())
    d = hays.select("doc_id", "hay")

    def meet(level: int) -> DataFrame:
        grams = F.array_distinct(_grams(F.col("hay"), gram, GRAM_STARTS[level]))
        side = q.where(F.col("level") == level).drop("level")
        return d.select("doc_id", F.explode(grams).alias("gram")).join(broadcast_if_small(side), "gram").select("doc_id", "item_id", "needle")

    hits = q.select(F.lit(None).cast(d.schema["doc_id"].dataType).alias("doc_id"), "item_id", "needle").where(F.lit(False))
    for level in used:
        hits = hits.unionByName(meet(level))
    return hits.join(d, "doc_id").where(F.contains("hay", "needle")).select("doc_id", "item_id", "needle")


def quotes_in_documents(docs: DataFrame, quotes: DataFrame, gram: int = EVIDENCE_MIN) -> DataFrame:
    """All (doc_id, item_id) where the quote's skeleton is long enough and occurs in the document's."""
    hays = docs.select("doc_id", evidence_skeleton(F.col("text")).alias("hay"))
    return contained_pairs(hays, quotes.select("item_id", evidence_skeleton(F.col("quote")).alias("needle")), gram)


def overlapping_pairs(docs: DataFrame, claims: DataFrame, stop: list[str]) -> DataFrame:
    """All distinct (doc_id, item_id) for which `semantic_overlap` of the claim and the text holds.

    `docs` has doc_id and text, `claims` item_id and claim. Pairs meet on shared tokens by equality, or on a character gram
    where a text contains the whole claim.
    """
    c = claims.select("item_id", norm_text(F.col("claim")).alias("needle"), F.explode_outer(semantic_tokens(F.col("claim"), stop)).alias("token"))
    words = docs.select("doc_id", F.explode(semantic_tokens(F.col("text"), stop)).alias("token")).distinct()
    met = words.join(broadcast_if_small(c.select("item_id", "token").where("token is not null").distinct()), "token").groupBy("doc_id", "item_id")
    shared = met.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("token")).alias("longest")).where("n >= 2 or longest >= 8")
    whole = contained_pairs(docs.select("doc_id", norm_text(F.col("text")).alias("hay")), c.select("item_id", "needle").distinct(), 4)
    return shared.select("doc_id", "item_id").unionByName(whole.select("doc_id", "item_id")).distinct()


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """`doc_id`, `item_id`, `shared`, `score` of all pairs that share a token; every other pair has none and score 0.

    `left` has doc_id and `tokens`, `right` item_id and `tokens`, both of distinct tokens and distinct ids.
    """
    a = left.select("doc_id", F.size("tokens").alias("na"), F.explode("tokens").alias("token"))
    b = right.select("item_id", F.size("tokens").alias("nb"), F.explode("tokens").alias("token"))
    both = a.join(broadcast_if_small(b), "token").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return both.select("doc_id", "item_id", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("score"))


# Signs in folded text: a raw character that vanishes, one more letter of the same raw character, and the border of a stretch.
SKIP, AGAIN, EDGE = "\x01", "\x02", "\x03"


def _own_pieces() -> tuple[str, str]:
    """Characters that don't fold to one character each, as a regex class and as pairs with what they fold to: the letters of
    their long form, with a sign between them. The signs themselves are blanks."""
    table = {char: re.sub("[^a-z0-9]+", "", plain) for char, plain in FOLD_LONG} | {"ß": "ss", "\u0130": "i"}
    table |= {char: table[char.lower()] for char in map(chr, range(0x80, 0x20000)) if char not in table and char.lower() in table}
    found = f"[{SKIP}{AGAIN}{EDGE}[\\x{{80}}-\\x{{1ffff}}&&{_code_ranges(list(table))}]]"
    return found, ";".join([*(f"{sign}= " for sign in (SKIP, AGAIN, EDGE)), *(f"{char}={AGAIN.join(letters)}" for char, letters in table.items())])


OWN_PIECE, OWN_PAIRS = _own_pieces()
MARKS = FOLD_FROM[len(FOLD_TO):]
# Words with one blank between them, taken by one match: the borders of every word, tried one by one, would cost far more.
STRETCH = "[a-z0-9]+(?: [a-z0-9]+)*+"


def _coded(text: Column) -> Column:
    """Text folded character by character: a combining mark is a sign, and a long form has signs between its letters.

    Works on whole strings; only characters with long forms are cut out.
    """
    table = F.str_to_map(F.lit(OWN_PAIRS), F.lit(";"), F.lit("="))
    cut = F.split(text, f"(?={OWN_PIECE})|(?<={OWN_PIECE})", -1)
    long_forms = F.array_join(F.transform(cut, lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")
    signs = F.contains(text, F.lit(SKIP)) | F.contains(text, F.lit(AGAIN)) | F.contains(text, F.lit(EDGE))
    plain = F.octet_length(text) == F.length(text)
    low = F.lower(F.when(signs | (~plain & text.rlike(OWN_PIECE)), long_forms).otherwise(text))
    return bound(low, lambda x: F.when(plain, x).otherwise(F.translate(x, FOLD_FROM, FOLD_TO + SKIP * len(MARKS))))


def _letters(code: Column) -> Column:
    """The words of a coded text with single blanks; a blank stands exactly where two letters are not neighbours any more."""
    clear = F.replace(F.replace(code, F.lit(SKIP)), F.lit(AGAIN))
    return F.array_join(F.regexp_extract_all(clear, F.lit(STRETCH), F.lit(0)), " ")


def _running(values: Column, block: int = 256) -> Column:
    """Running sums of an array, block by block, so that no long array is copied for each of its values."""
    def sums(x: Column) -> Column:
        start = F.array().cast("array<int>")
        return F.aggregate(x, start, lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + v)))

    def joined(blocks: Column) -> Column:
        before = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return bound(before, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: v + F.get(t, i - 1))))))

    starts = F.sequence(F.lit(1), F.size(values), F.lit(block))
    blocks = F.transform(starts, lambda i: sums(F.slice(values, i, F.lit(block))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bound(blocks, joined))


def _raw_offsets(code: Column) -> Column:
    """For each character of `_letters`, how much further on it stands in the raw text.

    Few different values in long runs, so next to nothing once compressed.
    """
    def farther(parts: Column) -> Column:
        # Gaps and stretches take turns; a gap is one blank of the folded text unless it has nothing but signs.
        gaps = F.filter(parts, lambda x, i: i % 2 == 0)
        steps = F.transform(gaps, lambda x, i: F.length(x) - F.when(F.contains(x, F.lit(AGAIN)), 2 * F.length(F.regexp_replace(x, f"[^{AGAIN}]+", ""))).otherwise(0)
                            - F.when((i > 0) & x.rlike(f"[^{SKIP}{AGAIN}]"), 1).otherwise(0))
        # A stretch has the blank after it.
        runs = F.transform(F.filter(parts, lambda x, i: i % 2 == 1), lambda x, i: F.octet_length(x) + F.get(parts, 2 * i + 2).rlike(f"[^{SKIP}{AGAIN}]").cast("int"))
        return bound(_running(steps), lambda far: F.flatten(F.transform(runs, lambda n, i: F.array_repeat(F.get(far, i), n))))

    return bound(F.split(F.regexp_replace(code, STRETCH, f"{EDGE}$0{EDGE}"), EDGE, -1), farther)


def evidence_spans(texts: DataFrame, quotes: DataFrame, min_chars: int = 4) -> DataFrame:
    """Raw (doc_id, quote_id, start, end) of every non-overlapping occurrence of a document's quotes.

    Texts and quotes are compared folded; the offsets are those of the raw text. A text is folded once, then its quotes
    meet it by an equality join, so a document may have any number of quotes.
    """
    # An exploded array of one element is computed once; as a plain column every filter and join on it would fold anew.
    hays = texts.select("doc_id", F.explode(F.array(_coded(F.col("text")))).alias("code"))
    hays = hays.select("doc_id", F.explode(F.array(F.struct(_letters(F.col("code")).alias("hay"), _raw_offsets(F.col("code")).alias("far")))).alias("x")).select("doc_id", "x.hay", "x.far")
    needles = quotes.select("doc_id", "quote_id", F.explode(F.array(_letters(_coded(F.col("quote"))))).alias("needle"))
    rows = needles.where(F.length("needle") >= min_chars).join(hays, "doc_id")
    # Pieces between the occurrences: their lengths, summed up, are where the occurrences begin. Folded text is ASCII.
    step = F.octet_length("needle")
    gaps = F.transform(F.split("hay", F.concat(F.lit("\\Q"), "needle", F.lit("\\E")), -1), lambda x: F.octet_length(x))
    begins = bound(gaps, lambda g: F.transform(_running(F.slice(g, 1, F.size(g) - 1)), lambda n, i: n + i * step))
    rows = rows.select("doc_id", "quote_id", "far", step.alias("step"), F.explode(begins).alias("b"))
    last = F.col("b") + F.col("step") - 1
    return rows.select("doc_id", "quote_id", (F.col("b") + F.get("far", F.col("b"))).alias("start"), (last + F.get("far", last) + 1).alias("end"))


def segments(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Text cut at every span border, each piece with the sorted ids of the quotes that cover it.

    Borders are numbered per document; a span then covers the pieces from the number of its start to that of its end. The
    spans are found once and written; their borders are dealt by document once, and a span meets its two borders in a sum.
    """
    named = written(spans.select("doc_id", "start", "end", "quote_id").distinct(), "spans")
    lengths = texts.select("doc_id", F.length("text").alias("n")).join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    span = F.struct("start", "end", "quote_id")
    cuts = named.select("doc_id", F.explode(F.array("start", "end")).alias("cut"), span.alias("span"))
    cuts = cuts.unionByName(lengths.select("doc_id", F.explode(F.array(F.lit(0), "n")).alias("cut")), allowMissingColumns=True)
    borders = cuts.repartition("doc_id").groupBy("doc_id", "cut").agg(F.collect_list("span").alias("spans"))
    order = Window.partitionBy("doc_id").orderBy("cut")
    borders = borders.select("doc_id", "cut", "spans", (F.row_number().over(order) - 1).alias("segment"), F.lead("cut").over(order).alias("next"))
    pieces = borders.where("next is not null").select("doc_id", "segment", F.col("cut").alias("start"), F.col("next").alias("end"))
    met = borders.where("doc_id is not null").select("doc_id", "cut", "segment", F.explode("spans").alias("span"))
    number = lambda border: F.max(F.when(F.col("cut") == F.col("span")[border], F.col("segment"))).alias(border)
    covered = met.groupBy("doc_id", "span").agg(number("start"), number("end")).where("start < end")
    covered = covered.select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("segment"), "span.quote_id")
    # Dealt by an exchange of its own: the partitions of the two parts need not agree once each is coalesced.
    both = pieces.unionByName(covered, allowMissingColumns=True).repartition("doc_id").groupBy("doc_id", "segment")
    return both.agg(F.max("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("quote_id")).alias("quote_ids"))
