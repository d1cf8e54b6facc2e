"""Rules as a table: texts meet the rules whose mandatory words they hold, and only those patterns are run.

Of each pattern a set of keys is derived, one of which every match must contain: a whole word where the pattern pins both
of its ends, otherwise a run of four letters of a word. The distinct words of all texts meet the patterns on such keys. A
pattern whose matches hold no blank runs on these words only, once each, and is decided by them; of any other its texts
must have a word with a key, and the pattern runs on those texts. Rules for which words say nothing, and patterns this small
reader does not know (look-around, back references, flags), are tried on every text, in blocks of rules.

Patterns run on normalised text: words of a-z and 0-9 with one blank between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.functions.text import norm_text
from pressgrain.operators.dedup import written
from pressgrain.scale import broadcast_if_small

GRAM = 4


class Unknown(Exception):
    """The pattern has a construct from which no key is taken."""


@dataclass(frozen=True)
class Piece:
    """Letters that stand in a word; `begins` and `ends` tell whether the word's borders are known to be there."""

    text: str
    begins: bool
    ends: bool

    @property
    def key(self) -> str | None:
        if self.begins and self.ends:
            return "=" + self.text
        # The middle of a long run says more than its ends, which are often common prefixes and endings.
        at = max(0, (len(self.text) - GRAM) // 2)
        return "~" + self.text[at : at + GRAM] if len(self.text) >= GRAM else None

    @property
    def weight(self) -> int:
        return len(self.text) + 2 * (self.begins and self.ends)


class _Reader:
    """Reads a pattern into nested lists: a sequence of letters, `None` for what can be anything, `border`, and
    alternatives as tuples of sequences."""

    BORDER = object()

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def read(self) -> tuple[list, ...]:
        found = self.alternatives()
        if self.i < len(self.p):
            raise Unknown
        return found

    def alternatives(self) -> tuple[list, ...]:
        out = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            out.append(self.sequence())
        return tuple(out)

    def sequence(self) -> list:
        out: list = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            item = self.item()
            least, exact = self.times()
            if least == 0:
                item = None
            out.append(item)
            if least and not exact:
                out.append(None)
        return out

    def item(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p[self.i : self.i + 1] == "?":
                if self.p[self.i : self.i + 2] != "?:":
                    raise Unknown
                self.i += 2
            inner = self.alternatives()
            if self.p[self.i : self.i + 1] != ")":
                raise Unknown
            self.i += 1
            return inner
        if c == "[":
            end = self.i + (self.p[self.i : self.i + 1] == "^")
            end += self.p[end : end + 1] == "]"
            while end < len(self.p) and self.p[end] != "]":
                if self.p[end] == "[" or self.p[end : end + 2] == "&&":
                    raise Unknown
                end += 2 if self.p[end] == "\\" else 1
            self.i = end + 1
            return None
        if c == "\\":
            c = self.p[self.i : self.i + 1]
            self.i += 1
            if c == "b":
                return self.BORDER
            if c in "dDwWsS":
                return None
            if not c or c.isalnum():
                raise Unknown
            return c
        if c in "^$":
            return self.BORDER
        if c in "*+?{":
            raise Unknown
        return None if c == "." else c

    def times(self) -> tuple[int, bool]:
        """Least number of times the item stands there, and whether it is exactly once."""
        c = self.p[self.i : self.i + 1]
        if c not in ("*", "+", "?", "{") or not c:
            return 1, True
        if c == "{":
            end = self.p.find("}", self.i)
            low = self.p[self.i + 1 : end].split(",")[0]
            if end < 0 or not low.isdigit():
                raise Unknown
            self.i, least = end + 1, min(1, int(low))
        else:
            self.i, least = self.i + 1, int(c == "+")
        if self.p[self.i : self.i + 1] in ("?", "+"):
            self.i += 1
        return least, False


def _cover(options: tuple[list, ...], begins: bool, ends: bool) -> list[Piece] | None:
    """Pieces one of which stands in every match of one of the options; None if there are no such pieces."""
    every: list[Piece] = []
    for sequence in options:
        covers, run, opened = [], "", begins

        def close(ended: bool) -> None:
            if run:
                covers.append([Piece(run, opened, ended)])

        for k, item in enumerate(sequence):
            if isinstance(item, str) and item.isalnum() and item.isascii():
                run += item
                continue
            border = item is _Reader.BORDER or item == " "
            close(border)
            if isinstance(item, tuple):
                before = begins if k == 0 else sequence[k - 1] is _Reader.BORDER or sequence[k - 1] == " "
                after = ends if k + 1 == len(sequence) else sequence[k + 1] is _Reader.BORDER or sequence[k + 1] == " "
                inner = _cover(item, before, after)
                if inner:
                    covers.append(inner)
            run, opened = "", border
        close(ends)
        usable = [c for c in covers if all(p.key for p in c)]
        if not usable:
            return None
        every += max(usable, key=lambda c: min(p.weight for p in c))
    return every


def keys_of(pattern: str | None) -> list[str] | None:
    """Keys one of which every text that the pattern matches has; None if any text may match."""
    try:
        cover = _cover(_Reader(pattern).read(), False, False) if pattern else None
    except Unknown:
        return None
    return sorted({p.key for p in cover}) if cover else None


# What a pattern may consist of so that no match can hold a blank: letters, digits, classes of them, borders, groups.
INSIDE = r"(?:[A-Za-z0-9_|)?*+]|\(\?:|\((?!\?)|\{\d+(?:,\d*)?\}|\\[bwd]|\[[A-Za-z0-9_-]+\])+"


def within_word(pattern: str | None) -> bool:
    """Whether the pattern occurs in a normalised text exactly if it occurs in one of its words, taken alone."""
    try:
        if not pattern or not re.fullmatch(INSIDE, pattern):
            return False
        _Reader(pattern).read()
        return re.search(pattern, "") is None
    except (Unknown, re.error):
        return False


def _tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each rule the conditions (0 trigger, 1 context) that some word of a text must meet, and those that are decided by it."""
    for batch in batches:
        tests, exact = [], []
        for trigger, context, title in zip(batch["trigger"], batch["context"], batch["exclude_title"]):
            own = [{"role": r, "pattern": p, "keys": keys_of(p), "inside": within_word(p)} for r, p in enumerate((trigger, context)) if p is not None]
            tests.append([x for x in own if x["keys"]])
            exact.append([x["role"] for x in tests[-1] if x["inside"]])
        yield batch.assign(tests=tests, exact=exact)


def text_keys(n: Column) -> Column:
    """All keys of a normalised text: its words, and all runs of four letters within them."""
    words = F.array_distinct(F.filter(F.split(n, " "), lambda w: w != ""))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (GRAM - 1)), lambda i: F.concat(F.lit("~"), F.substring(w, i, F.lit(GRAM))))
    inside = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= GRAM), grams))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), inside))


def _words_of(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """(`__w`, `__u`, role, `__need`) for every distinct word of the texts that passes a test.

    Words meet tests on their keys. Patterns that stay within a word run on it, of others a word must have a key.
    """
    words = written(rows.select(F.explode(F.split("__n", " ")).alias("__w")).where("__w <> ''").distinct(), "vocabulary")
    # Few bytes and much work: dealt by number, since by size all would come in one task.
    tasks = 4 * words.sparkSession.sparkContext.defaultParallelism
    words = words.repartition(tasks, "__w")
    index = tests.withColumn("__k", F.explode("keys")).drop("keys")
    met = words.select("__w", F.explode(text_keys(F.col("__w"))).alias("__k")).join(broadcast_if_small(index), "__k")
    return met.where(~F.col("inside") | F.rlike("__w", F.col("pattern"))).select("__w", "__u", "role", "__need").distinct()


def match_rule_table(texts: DataFrame, rules: DataFrame, key: str, text: str, title: str | None = None, block: int = 256) -> DataFrame:
    """(key, rule_id) for every rule whose trigger and context occur in the folded text.

    `rules` has rule_id and trigger, and optionally context (must occur as well) and exclude_title (must not occur in the
    folded `title`); null means no such condition. Rules with a null trigger match nothing. Repeated rules and rows of one
    key give a pair once. The table of rules may be of any size: its keys are broadcast only if they were found small.
    """
    spare = [c for c in ("context", "exclude_title") if c not in rules.columns]
    wide = rules.where("trigger IS NOT NULL").select("rule_id", "trigger", *(F.col(c) if c not in spare else F.lit(None).cast("string").alias(c) for c in ("context", "exclude_title")))
    kind = rules.schema["rule_id"].dataType.simpleString()
    schema = f"rule_id {kind}, trigger string, context string, exclude_title string, tests array<struct<role:int,pattern:string,keys:array<string>,inside:boolean>>, exact array<int>"
    pack = written(wide.distinct().mapInPandas(_tested, schema).withColumn("__u", F.monotonically_increasing_id()), "rules")
    rows = texts.select(key, F.monotonically_increasing_id().alias("__row"), norm_text(F.col(text)).alias("__n"), (norm_text(F.col(title)) if title else F.lit("")).alias("__t"))
    rows = written(rows, "folded")
    tests = pack.select("__u", F.size("tests").alias("__need"), F.explode("tests").alias("x")).select("__u", "__need", "x.*")
    held = written(_words_of(rows, tests), "words")
    # Of a row and a rule only which of the tests some word passes is kept, so the sums are small before the shuffle.
    met = rows.select(key, "__row", F.explode(F.array_distinct(F.split("__n", " "))).alias("__w")).join(broadcast_if_small(held), "__w")
    passed = met.groupBy("__row", key, "__u").agg((F.max((F.col("role") == 0).cast("int")) + F.max((F.col("role") == 1).cast("int"))).alias("__passed"), F.max("__need").alias("__need"))
    pairs = passed.where("__passed = __need").select(key, "__row", "__u")
    # Conditions that the words have decided are not run again.
    undecided = lambda c, role: F.when(~F.array_contains("exact", role), F.col(c)).alias(c)
    left = pack.where("size(tests) > 0").select("__u", "rule_id", undecided("trigger", 0), undecided("context", 1), "exclude_title")
    sure = left.where("trigger IS NULL AND context IS NULL AND exclude_title IS NULL").select("__u", "rule_id")
    found = pairs.join(broadcast_if_small(sure), "__u").select(key, "rule_id")
    asked = pairs.join(broadcast_if_small(left.join(sure, "__u", "left_anti")), "__u").drop(key).join(rows, "__row")
    asked = asked.where(_matches(F.col("__n"), F.col("__t"), F.col("trigger"), F.col("context"), F.col("exclude_title")))
    found = found.unionByName(asked.select(key, "rule_id"))
    open_ = pack.where("size(tests) = 0").drop("tests", "exact", "__u")
    # Blocks of rules without keys, dealt by their hash; a text is tried once per block, inside its row.
    count = max(1, -(-open_.count() // block))
    blocks = open_.groupBy(F.pmod(F.xxhash64("trigger", "context", "rule_id"), F.lit(count)).alias("__b")).agg(F.collect_list(F.struct("rule_id", "trigger", "context", "exclude_title")).alias("__rules"))
    tried = rows.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(blocks, "__b")
    hits = F.filter("__rules", lambda r: _matches(F.col("__n"), F.col("__t"), r["trigger"], r["context"], r["exclude_title"]))
    scanned = tried.select(key, F.explode(F.transform(hits, lambda r: r["rule_id"])).alias("rule_id"))
    return found.select(key, "rule_id").unionByName(scanned).distinct()


def _matches(n: Column, title: Column, trigger: Column, context: Column, exclude: Column) -> Column:
    return F.coalesce(F.rlike(n, trigger), F.lit(True)) & F.coalesce(F.rlike(n, context), F.lit(True)) & ~F.coalesce(F.rlike(title, exclude), F.lit(False))
