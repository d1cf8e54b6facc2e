"""Loose JSON, provider payloads, company profiles, configurations, labels and record shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgrain.functions.text import norm_text


def loose_json_text(col: Column) -> Column:
    """Outermost braces of a text without code fences, null where there are none."""
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), "(?i)```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parse_loose_json(col: Column, schema: str) -> Column:
    """Struct parsed from a framed answer; raw control characters inside strings are accepted."""
    return F.from_json(loose_json_text(col), schema, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})


COMPLETION_SCHEMA = (
    "choices array<struct<message:struct<content:string>,finish_reason:string>>, "
    "usage struct<prompt_tokens:bigint,prompt_cache_hit_tokens:bigint,prompt_cache_miss_tokens:bigint,"
    "completion_tokens:bigint,total_tokens:bigint,completion_tokens_details:struct<reasoning_tokens:bigint>>"
)


def parse_completion(col: Column) -> Column:
    """Struct of answer text, finish reason and the five token counts of a provider payload."""

    def fields(p: Column) -> Column:
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        u = p["usage"]
        cached, prompt, done = zero(u["prompt_cache_hit_tokens"]), zero(u["prompt_tokens"]), zero(u["completion_tokens"])
        thinking = zero(u["completion_tokens_details"]["reasoning_tokens"])
        choice = F.get(p["choices"], F.lit(0))
        total = zero(u["total_tokens"])
        return F.struct(
            F.trim(F.coalesce(choice["message"]["content"], F.lit(""))).alias("text"),
            F.coalesce(choice["finish_reason"], F.lit("")).alias("finish_reason"),
            F.coalesce(u["prompt_cache_miss_tokens"], F.greatest(prompt - cached, F.lit(0))).alias("input"),
            cached.alias("cached_input"), F.greatest(done - thinking, F.lit(0)).alias("output"),
            thinking.alias("thinking"), F.when(total != 0, total).otherwise(prompt + done).alias("total"),
        )

    return F.transform(F.array(F.from_json(col, COMPLETION_SCHEMA)), fields)[0]


PROFILE_SCHEMA = (
    "kpis array<struct<label:string,value:string,hint:string,estimated:boolean>>, "
    "sections array<struct<title:string,items:array<string>>>, sources array<struct<title:string,uri:string>>"
)


def _clean(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def normalise_profile(profile: Column, sections: Sequence[str], figures: int | None = None, items: int | None = None, most_sources: int | None = None) -> Column:
    """Company profile with its figures, sections in canonical order, distinct sources and a usable flag.

    A section is used once, for the first wanted title it begins like; of several that fit, the last one counts. The
    numbers bound figures, items of a section and sources.
    """

    def rebuild(p: Column) -> Column:
        kpis = F.filter(
            F.transform(p["kpis"], lambda k: F.struct(
                _clean(k["label"]).alias("label"), _clean(k["value"]).alias("value"),
                _clean(k["hint"]).alias("hint"), F.coalesce(k["estimated"], F.lit(False)).alias("estimated"))),
            lambda k: (k["label"] != "") & (k["value"] != ""))
        kpis = _first(kpis, figures)
        given = F.filter(
            F.transform(p["sections"], lambda s: F.struct(
                _clean(s["title"]).alias("title"),
                _first(F.filter(F.transform(s["items"], _clean), lambda i: i != ""), items).alias("items"))),
            lambda s: (s["title"] != "") & (F.size(s["items"]) > 0))

        def canonical(wanted: str) -> Column:
            begins = lambda s, w: F.startswith(F.lower(s["title"]), F.lit(w.lower()[:12]))
            earlier = sections[: list(sections).index(wanted)]
            hits = F.filter(given, lambda s: begins(s, wanted) & ~reduce(lambda a, w: a | begins(s, w), earlier, F.lit(False)))
            return F.when(F.size(hits) > 0, F.struct(F.lit(wanted).alias("title"), F.try_element_at(hits, F.lit(-1))["items"].alias("items")))

        ordered = F.array_compact(F.array(*[canonical(w) for w in sections]))
        named = F.filter(F.transform(p["sources"], lambda s: F.struct(_clean(s["title"]).alias("title"), s["uri"].alias("uri"))),
                         lambda s: s["title"] != "")
        titles = F.transform(named, lambda s: s["title"])
        first = F.filter(named, lambda s, i: F.array_position(titles, s["title"]) == i + 1)
        sources = _first(first, most_sources)
        usable = (F.size(kpis) >= 3) & (F.size(ordered) >= 3) & (F.size(sources) >= 1)
        return F.struct(kpis.alias("kpis"), ordered.alias("sections"), sources.alias("sources"), usable.alias("usable"))

    empty = F.struct(
        F.coalesce(profile["kpis"], F.array().cast("array<struct<label:string,value:string,hint:string,estimated:boolean>>")).alias("kpis"),
        F.coalesce(profile["sections"], F.array().cast("array<struct<title:string,items:array<string>>>")).alias("sections"),
        F.coalesce(profile["sources"], F.array().cast("array<struct<title:string,uri:string>>")).alias("sources"),
    )
    return F.transform(F.array(empty), rebuild)[0]


def flatten_config(json_col: Column) -> Column:
    """Map of dotted path to value for a configuration of sections and settings."""
    sections = F.map_entries(F.from_json(json_col, "map<string,map<string,string>>"))
    return F.map_from_entries(F.flatten(F.transform(sections, lambda s: F.transform(
        F.map_entries(s["value"]), lambda e: F.struct(F.concat(s["key"], F.lit("."), e["key"]), e["value"])))))


def config_merge(defaults: Column, override: Column, forced: Mapping[str, str] | None = None) -> Column:
    """Defaults overlaid by the override; forced paths cannot be changed."""
    merged = F.map_zip_with(defaults, F.coalesce(override, F.create_map().cast("map<string,string>")),
                            lambda k, d, o: F.coalesce(o, d))
    if not forced:
        return merged
    guard = F.create_map(*[F.lit(x) for kv in forced.items() for x in kv])
    return F.map_zip_with(merged, guard, lambda k, m, g: F.coalesce(g, m))


def config_diff(before: Column, after: Column) -> Column:
    """Array of (path, before, after) for every leaf whose value changed."""
    both = F.map_zip_with(before, after, lambda k, b, a: F.struct(b.alias("before"), a.alias("after")))
    changed = F.map_entries(F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"])))
    return F.transform(changed, lambda e: F.struct(e["key"].alias("path"), e["value"]["before"].alias("before"),
                                                   e["value"]["after"].alias("after")))


def canonical_labels(value: Column, offerings: Sequence[Mapping[str, str]]) -> Column:
    """Distinct offering names of a `+`/`;` list of one to three parts, empty if any part is unknown or ambiguous.

    The catalogue is a plan parameter of bounded size; aliases become one literal map, unique suffixes one filter.
    """
    aliases: dict[str, str] = {}
    for o in offerings:
        label, pillar = o["label"], o["pillar"]
        for alias in (label, o["id"], f"[{pillar}] {label}", f"{pillar}: {label}", f"{pillar} {label}", f"NAME {label}"):
            aliases[_norm_py(alias)] = label
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    names = F.array(*[F.struct(F.lit(_norm_py(o["label"])).alias("n"), F.lit(o["label"]).alias("label")) for o in offerings])
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\s+\+\s+|\s*;\s*"), lambda p: F.trim(p)), lambda p: p != "")

    def resolve(part: Column) -> Column:
        n = norm_text(part)
        suffix = F.filter(names, lambda o: (n == o["n"]) | F.endswith(n, F.concat(F.lit(" "), o["n"])))
        unique = F.when(F.size(suffix) == 1, F.get(suffix, F.lit(0))["label"]).otherwise("")
        return F.coalesce(F.try_element_at(table, n), unique)

    resolved = F.transform(parts, resolve)
    good = F.size(parts).between(1, 3) & ~F.exists(resolved, lambda x: x == "")
    return F.when(good, F.array_join(F.array_distinct(resolved), " + ")).otherwise("")


def _norm_py(value: str) -> str:
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub("[^a-z0-9]+", " ", plain.replace("ß", "ss")).strip()


def missing_parts(variant: Column, fields: Mapping[str, Column], requirements: Mapping[str, Sequence[str]]) -> Column:
    """Names of required parts a record lacks; `steps>=3` asks for a list length, a bare name for non-blank text."""

    def check(rule: str) -> Column:
        if ">=" in rule:
            name, n = rule.split(">=")
            ok = F.size(fields[name]) >= int(n)
        else:
            ok = F.trim(F.coalesce(fields[rule], F.lit(""))) != ""
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule))

    lists = [F.when(variant == v, F.array_compact(F.array(*[check(r) for r in rules]))) for v, rules in requirements.items()]
    return F.coalesce(*lists, F.array().cast("array<string>"))


def first_usable(*cols: Column, limit: int | None = None) -> Column:
    """First value that is not blank, trimmed; `limit` cuts it."""
    found = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cols], F.lit(""))
    return found if limit is None else F.substring(found, 1, limit)


def kicker(token: Column, known: Mapping[str, str], width: int | None = None) -> Column:
    """Display label of a token: a known one, else the token in capitals with blanks; `width` cuts it."""
    t = F.trim(F.coalesce(token, F.lit("")))
    plain = F.upper(F.regexp_replace(t, "[_-]+", " "))
    plain = plain if width is None else F.substring(plain, 1, width)
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.when(t == "", F.lit(None)).otherwise(F.coalesce(F.try_element_at(table, t), plain))


def label_fallback(topics: Column, signal_id: Column, territory: Column, label: Column, lane: Column,
                   known: Mapping[str, str]) -> Column:
    """First usable display label: topics, a known id, territory, label, then the default of the lane."""
    from_topics = F.get(F.filter(F.transform(topics, lambda x: kicker(x, known)), lambda k: k.isNotNull()), F.lit(0))
    from_id = F.when(F.trim(signal_id).isin(*known), kicker(signal_id, known))
    default = F.when(lane == "sales", "SALES INSIGHT").otherwise("INSIGHT")
    return F.coalesce(from_topics, from_id, kicker(territory, known), kicker(label, known), default)


def candidate_score(title: Column, mime: Column, keywords: Sequence[str], place: str, reject: str) -> Column:
    """Additive score of an image candidate: type, place words, age penalty and keyword hits; rejects get -20."""
    low = F.lower(title)
    kind = F.lower(F.coalesce(mime, F.lit("")))
    base = F.when(kind.rlike("jpe?g"), 5).when(kind.rlike("png|webp"), 3)
    old = low.rlike(r"(^|[^0-9])1[5-9]\d{2}([^0-9]|$)") | low.rlike(r"\bcirca\b")
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords if len(k) > 3], F.lit(False))
    score = base + F.when(low.rlike(place), 6).otherwise(0) - F.when(old, 6).otherwise(0) + F.when(hit, 3).otherwise(0)
    return F.when(low.rlike(reject), -20).when(base.isNull(), -5).otherwise(score)


def _names_company(text: Column, company: Column, when_empty: bool) -> Column:
    names = F.filter(F.split(norm_text(company), " "), lambda t: F.length(t) >= 4)
    n = norm_text(text)
    return F.when(F.size(names) == 0, F.lit(when_empty)).otherwise(F.exists(names, lambda t: F.contains(n, t)))


def _sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?](?:\s|$)"), lambda s: F.trim(s) != ""))


def strong_trigger(text: Column, company: Column, shallow: str) -> Column:
    """90 to 900 characters, two or three sentences, no stock phrase, names the company where one is known."""
    return (F.length(text).between(90, 900) & _sentence_count(text).between(2, 3) & ~text.rlike(shallow)
            & _names_company(text, company, True))


def concrete_link(text: Column, lane: Column, company: Column, verbs: str, stock: str) -> Column:
    """70 to 700 characters with a working verb; for sales also two sentences that name the company."""
    base = F.length(text).between(70, 700) & ~text.rlike(stock) & text.rlike(verbs)
    return base & ((lane != "sales") | ((_sentence_count(text) >= 2) & _names_company(text, company, False)))


def title_company(title: Column, lead: str, verbs: str) -> Column:
    """Company after a preposition at the end of a headline, or before an appointing verb; publisher suffix dropped."""
    head = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+\|\s+[^|]+$", ""))
    suffix = F.regexp_extract(head, rf"(?i)\b(?:{lead})\s+([^|–—:;,]{{2,80}})$", 1)
    prefix = F.regexp_extract(head, rf"(?i)^([^:|–—]{{2,80}}?)\s+(?:{verbs})\b", 1)
    best = F.when(suffix != "", suffix).otherwise(prefix)
    return F.regexp_replace(best, r"^[\s\"„“'’]+|[\s\"„“'’]+$", "")


def rule_terms(pattern: str) -> list[str]:
    """Readable terms of an alternation, for reports on what a rule looks for."""
    import re

    raw = re.sub(r"^\\b\(|\)\\b$", "", pattern)
    raw = re.sub(r"^\(|\)$", "", raw)
    parts = [p.replace("\\b", "").replace("\\w*", "…").replace("(?:", "(").replace("\\s", " ").replace("\\", "").strip()
             for p in raw.split("|")]
    return [p for p in parts if p]
