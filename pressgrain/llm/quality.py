"""Document quality by weak supervision: rules vote or abstain, and the posterior of "good" decides.

Everything per document is a column expression over the whole text. Votes of all documents are counted per vote pattern,
of which there are at most 3 to the number of rules; expectation-maximisation over that bounded table estimates how often
good documents occur and how each rule votes on good and on bad ones. The posterior is again a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import saved

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "der", "die", "und", "das", "den", "von", "ist", "für",
    "le", "la", "les", "des", "et", "que", "pour", "dans", "el", "los", "de", "en", "una", "las", "con",
]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row: `id_col`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, and what the
    voting rules need besides: `n_upper`, `n_letters`, `n_marks` (exclamation marks), `n_function`, `n_lines`.

    A null text counts as empty, and all its counts are zero. Repeated rows and null ids stay.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].alias("id"), text.alias("t")).withColumn("w", _words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    n = F.size("w")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    base = base.withColumn("h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<long>")))
    base = base.withColumn("l", lines)
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    numbered = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    base = base.withColumn("s", F.when(repeats, F.array_sort(numbered)))
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    base = base.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    steps = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.col("p").isNull(), 0).otherwise(F.aggregate(steps, F.lit(3), lambda a, x: a + x))
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.translate("t", " \t\n\x0b\x0c\r", "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": covered,
        "n_upper": F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", "")),
        "n_letters": F.length("t") - F.length(F.regexp_replace("t", r"\p{L}+", "")),
        "n_marks": without("!"),
        "n_function": F.size("w") - F.size(F.filter("w", lambda x: x.isin(FUNCTION_WORDS) == F.lit(False))),
        "n_lines": F.size("l"),
    }
    return base.select(F.col("id").alias(id_col), *[c.cast("long").alias(k) for k, c in counts.items()])


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where a condition over the measures holds, and abstains elsewhere."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


RULES = (
    Rule("symbols", "100 * n_symbols <= 2 * n_words", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("repeated_lines", "n_lines > 1 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("upper_case", "10 * n_upper <= n_letters", "10 * n_upper > 4 * n_letters"),
    Rule("exclamation", "100 * n_marks <= n_words", "10 * n_marks > n_words"),
    Rule("function_words", "100 * n_function >= 5 * n_words", "n_words >= 50 and 100 * n_function < n_words"),
    Rule("length", "n_words between 50 and 100000", "n_words < 20"),
)


@dataclass(frozen=True)
class VoteModel:
    """`prior` of good, and per rule the chance of a good vote, given that it votes, on good and on bad documents."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def logit(self, votes: Sequence[int]) -> float:
        total = math.log(self.prior / (1 - self.prior))
        for vote, g, b in zip(votes, self.on_good, self.on_bad):
            total += math.log(g / b) if vote > 0 else math.log((1 - g) / (1 - b)) if vote < 0 else 0.0
        return total

    def posterior(self, votes: Sequence[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, g, b in zip(votes, self.on_good, self.on_bad):
            total = total + F.when(vote > 0, math.log(g / b)).when(vote < 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200, tolerance: float = 1e-7) -> VoteModel:
    """Expectation-maximisation over (votes, count) patterns, with one pseudo-count per cell.

    It starts from the belief that every bad vote leaves a quarter of the odds of being good, and keeps every rule at
    least as likely to vote good on good documents as on bad ones, so the two classes cannot change places. Without
    patterns a rule counts as right in four of five cases.
    """
    model = VoteModel(0.8, (0.8,) * rules, (0.2,) * rules)
    beliefs = [0.9 * 0.25 ** votes.count(-1) for votes, _ in patterns]
    for _ in range(rounds if patterns else 0):
        docs, cells = [1.0, 1.0], [[[1.0, 1.0] for _ in range(rules)] for _ in range(2)]
        for (votes, count), belief in zip(patterns, beliefs):
            for side, weight in enumerate((count * belief, count * (1 - belief))):
                docs[side] += weight
                for rule, vote in enumerate(votes):
                    if vote:
                        cells[side][rule][vote < 0] += weight
        on_good = tuple(c[0] / sum(c) for c in cells[0])
        on_bad = tuple(min(c[0] / sum(c), g) for c, g in zip(cells[1], on_good))
        after = VoteModel(docs[0] / sum(docs), on_good, on_bad)
        moved = max(abs(after.prior - model.prior), *(abs(a - b) for a, b in zip(after.on_good + after.on_bad, model.on_good + model.on_bad)))
        model = after
        beliefs = [1 / (1 + math.exp(-max(-500.0, min(500.0, model.logit(votes))))) for votes, _ in patterns]
        if moved < tolerance:
            break
    return model


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`measures`, `votes` (array of int), `posterior`, `base_failed` and `kept` of every row.

    `base_failed`: fewer than 50 words, or over half of the words in repeated three-word windows. Such rows are not kept;
    others are if their posterior reaches `threshold`. Null and empty texts fail. An empty table gives an empty result.
    """
    counted = saved(measures(docs, id_col, text_col), "measures")
    votes = [rule.vote() for rule in rules]
    table = counted.select(F.array(*votes).alias("v")).groupBy("v").count().collect()  # at most 3 ** len(rules) rows
    model = fit([(tuple(r["v"]), r["count"]) for r in table], len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = counted.select("*", F.array(*votes).alias("votes"), model.posterior(votes).alias("posterior"), failed.alias("base_failed"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
