"""Secret scanning with a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: all segments must hold, a segment holds if one of its
strings may occur, and a string may occur where all its trigrams do. Only trigrams that some query names are indexed: the
postings are (trigram, document). Intersecting them gives each rule's candidates, which are then verified with the rule
itself. Rules whose pattern has no mandatory trigram scan every text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that one segment may stand for; beyond it the segment is cut there.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` in the common subset of Java and Python syntax. The characters of `group` (0: the whole match) must number
    `least` or more, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")


def _segments(tokens) -> list[set[str]]:
    """Sets of lower-case strings of which the text must hold one each, in the order of the pattern."""
    done: list[set[str]] = []
    now = {""}

    def cut() -> None:
        nonlocal now
        done.append(now)
        now = {""}

    def add(strings: set[str] | None) -> None:
        nonlocal now
        if strings is None:
            cut()
        elif len(now) * len(strings) > MOST_STRINGS:
            cut()
            now = set(strings) if len(strings) <= MOST_STRINGS else {""}
        else:
            now = {a + b for a, b in itertools.product(now, strings)}

    for kind, value in tokens:
        if kind is op.LITERAL:
            add({chr(value).lower()})
        elif kind is op.IN:
            add(_class(value))
        elif kind is op.SUBPATTERN:
            inner = _segments(value[3])
            for k, strings in enumerate(inner):
                if k:
                    cut()
                add(strings)
        elif kind is op.BRANCH:
            ways = [_segments(way) for way in value[1]]
            add(set().union(*(w[0] for w in ways)) if all(len(w) == 1 for w in ways) else None)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            inner = _segments(body)
            whole = inner[0] if len(inner) == 1 else None
            if high == 1 and low == 0:
                add(whole | {""} if whole is not None else None)
            else:
                for _ in range(min(low, 3)):
                    add(whole)
                if high != low or low > 3:
                    cut()
        elif kind is op.AT:
            continue
        else:
            cut()
    done.append(now)
    return done


def _class(items) -> set[str] | None:
    """The characters of a small class; None for large or negated ones."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All segments must hold; a segment holds if all trigrams of one of its sets occur. Empty: nothing is mandatory."""
    query = []
    for strings in _segments(regex_parser.parse(pattern)):
        ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in ways:
            query.append(sorted(ways, key=sorted))
    return query


def postings(docs: DataFrame, grams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index `gram`, `doc` of the given lower-case trigrams over the whole texts."""
    low = docs.select(docs[id_col].alias("doc"), F.lower(docs[text_col].cast("string")).alias("t"))
    found = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc", F.explode(found).alias("gram"))


def _literal(like: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A table of a few literal rows."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return like.sparkSession.range(1).select(F.inline(F.array(*structs)))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`doc`, `kinds`: which rules' queries hold for which documents. One row per document with a candidate."""
    rows, needed = [], {}
    for rule in rules:
        query = trigram_query(rule.pattern)
        needed[rule.kind] = len(query)
        rows += [(rule.kind, s, w, g, len(way)) for s, ways in enumerate(query) for w, way in enumerate(ways) for g in sorted(way)]
    clauses = _literal(index, rows, ("kind", "segment", "way", "gram", "need"))  # bounded by the rules
    whole = _literal(index, list(needed.items()), ("kind", "segments"))
    met = index.join(F.broadcast(clauses), "gram").groupBy("doc", "kind", "segment", "way", "need").agg(F.collect_set("gram").alias("seen"))
    met = met.where(F.size("seen") == F.col("need")).groupBy("doc", "kind").agg(F.collect_set("segment").alias("held"))
    met = met.join(F.broadcast(whole), "kind").where(F.size("held") == F.col("segments"))
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, order: int) -> Column:
    """Spans of the matches of one rule in the column `t`: array of (start, end, order, kind), in code points."""
    pattern = F.lit(rule.java)
    gaps = F.transform(F.split("t", rule.java, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all("t", pattern, F.lit(0)), lambda x: F.length(x))
    counted = sizes if not rule.group else F.transform(F.regexp_extract_all("t", pattern, F.lit(rule.group)), lambda x: F.length(x))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), counted.alias("own"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,order:int,kind:string>>").alias("spans"))

    def walk(a: Column, x: Column) -> Column:
        first, last = a["at"] + x["gap"], a["at"] + x["gap"] + x["size"]
        span = F.array(F.struct(first.alias("start"), last.alias("end"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind")))
        return F.struct(last.alias("at"), F.when(x["own"] >= rule.least, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(steps, start, walk, lambda a: a["spans"])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` plus `spans`: array of (start, end, order, kind), by start, then by the order of the rules.

    Per rule the matches are leftmost and do not overlap; those with too few characters are dropped after they were
    consumed. Offsets are code points, ends exclusive. A null text counts as empty. Repeated rows and null ids are
    scanned like any other; a column named `spans` is replaced.
    """
    none = F.array().cast("array<struct<start:int,end:int,order:int,kind:string>>")
    indexed = [r for r in rules if trigram_query(r.pattern)]
    grams = sorted({g for r in indexed for ways in trigram_query(r.pattern) for way in ways for g in way})
    inner = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(inner.alias("row"), docs[id_col].alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    full = [F.when(F.col("t").rlike(_quick(r)), _matches(r, k)).otherwise(none) for k, r in enumerate(rules) if r not in indexed]
    rows = rows.withColumn("scanned", F.concat(none, *full))
    if indexed:
        found = candidates(postings(docs, grams, id_col, text_col), indexed).withColumnRenamed("doc", "found")
        rows = rows.join(found, F.col("doc").eqNullSafe(F.col("found")), "left")
        checked = [F.when(F.array_contains("kinds", r.kind), _matches(r, k)).otherwise(none) for k, r in enumerate(rules) if r in indexed]
        rows = rows.withColumn("scanned", F.concat("scanned", *checked))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "spans"], F.array_sort("scanned").alias("spans"))


def _quick(rule: Rule) -> str:
    """A pattern that holds wherever a long enough match does; it only saves work for one-class rules."""
    body = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{body[1]}{{{rule.least}}}" if body and not rule.group else rule.java


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The texts with every span of `spans` replaced by `mark`; overlapping and touching spans share one. No spans: unchanged."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def walk(a: Column, x: Column) -> Column:
        fresh = (x["start"] > a["at"]) | ((x["start"] == 0) & (a["at"] == 0))
        kept = F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, x["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, kept).otherwise(a["out"]).alias("out"))

    whole = F.aggregate("spans", start, walk, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.length(F.col(text_col)))))
    return scanned.withColumn(text_col, F.when(F.size("spans") > 0, whole).otherwise(F.col(text_col)))
