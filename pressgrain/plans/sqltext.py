"""SQL fragments for the oracle statements; written against DuckDB built-ins, not against the Spark operators."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower(coalesce({x},'')),'ß','ss')),'[^a-z0-9]+',' ','g'))"


def skeleton(x: str) -> str:
    drop = f"regexp_replace(replace(lower({x}),'ß','ss'),'[äöü�]','','g')"
    return f"regexp_replace(strip_accents({drop}),'[^a-z0-9]+','','g')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x},'^\\s+',''),'\\s+$','')"


def array(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
