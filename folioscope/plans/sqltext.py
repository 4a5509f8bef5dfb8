"""Pieces of SQL for the checks: text cleaning and rule scores, restated."""

from __future__ import annotations

from folioscope.config import QUALITY_PATTERNS, STRIP_PATTERNS
from folioscope.plans.bindings import RULES, SQL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(160), ' '), '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')")


def strip(x: str) -> str:
    out = clean(x)
    for p in STRIP_PATTERNS:
        out = f"regexp_replace({out}, {lit(p)}, ' ', 'gi')"
    out = f"regexp_replace({out}, '\\s+([,.;:])', '\\1', 'g')"
    return clean(f"regexp_replace({out}, '(^|\\s)[_|]+(\\s|$)', ' ', 'g')")


def matching(x: str) -> str:
    return collapse(f"translate(lower({x}), '‐‑‒–—', '-----')")


def title_key(x: str) -> str:
    return f"trim(regexp_replace(lower({clean(x)}), '[^a-z0-9]+', ' ', 'g'))"


def has(x: str, phrase: str) -> str:
    body = r"\s+".join(w.replace("-", r"[-\s]") for w in phrase.split(" "))
    return f"regexp_matches({x}, {lit(f'(^|[^a-z0-9]){body}($|[^a-z0-9])')})"


def listed(x: str, phrases: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(x, p)} THEN {lit(p)} END" for p in phrases) + "], lambda v: v IS NOT NULL)"


def flags(*fields: str) -> str:
    found = [f"CASE WHEN regexp_matches(lower({clean(f)}), {lit('|'.join(f'(?:{p})' for p in ps))}) THEN {lit(flag)} END" for f in fields for flag, ps in QUALITY_PATTERNS.items()]
    first = "list_filter([" + ", ".join(found) + "], lambda v: v IS NOT NULL)"
    return f"array_to_string(list_filter({first}, lambda v, i: list_position({first}, v) = i), '|')"


def scored(source: str, x: str, name: str) -> str:
    cs, cm, ps, pm = (listed(x, RULES[f][k]) for f in ("causal", "predictive") for k in ("strong", "moderate"))
    return f"""{name}_terms AS (SELECT *, {cs} AS cs, {cm} AS cm, {ps} AS ps, {pm} AS pm FROM {source}),
{name} AS (SELECT *, 2 * len(cs) + len(cm) AS c, 2 * len(ps) + len(pm) AS p, list_concat(cs, cm) AS ct, list_concat(ps, pm) AS pt FROM {name}_terms)"""


CASES = """CASE WHEN c > 0 AND p = 0 OR c > 0 AND p > 0 AND c >= p + 2 THEN 'causal' WHEN p > 0 AND c = 0 OR c > 0 AND p > 0 AND p >= c + 2 THEN 'predictive' ELSE 'other' END"""


def level(none: str) -> str:
    return f"""CASE WHEN c > 0 AND p = 0 THEN CASE WHEN len(cs) > 0 THEN 'high' ELSE 'medium' END WHEN p > 0 AND c = 0 THEN CASE WHEN len(ps) > 0 THEN 'high' ELSE 'medium' END
 WHEN c > 0 AND p > 0 AND abs(c - p) >= 2 THEN 'medium' WHEN c > 0 AND p > 0 THEN 'low' ELSE '{none}' END"""


CLASSIFIED = f"""{SQL["articles"]},
cleaned AS MATERIALIZED (SELECT *, {matching(strip("title"))} AS mt, {matching(strip("abstract"))} AS ma, {flags("title", "abstract")} AS flags FROM articles),
joined AS (SELECT *, array_to_string(list_filter([mt, ma], lambda v: v <> ''), ' ') AS t FROM cleaned),
{scored("joined", "t", "scored")},
classified AS MATERIALIZED (SELECT *, length(t) AS chars, CASE WHEN length(t) < 250 THEN 'insufficient_text' ELSE {CASES} END AS category,
 CASE WHEN length(t) < 250 THEN 'low' ELSE {level("medium")} END AS confidence FROM scored),
{scored("(SELECT article_id AS a2, mt AS tt FROM classified WHERE category = 'insufficient_text')", "tt", "triaged")},
triage AS (SELECT a2 AS article_id, {CASES} AS suggested, {level("low")} AS title_confidence FROM triaged)"""
