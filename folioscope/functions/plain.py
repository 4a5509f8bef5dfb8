"""What is done with one text in plain Python: cleaning, boilerplate, flags. Columns of text and features evaluate these on Arrow batches."""

from __future__ import annotations

import html
import re

from folioscope.config import QUALITY_PATTERNS, QUALITY_WORDINGS, STRIP_PATTERNS, STRIP_WORDINGS

_TAG = re.compile(r"<[^>]+>")
_STRIP = [re.compile(p, re.I) for p in STRIP_PATTERNS]
_FLAGS = {flag: re.compile("|".join(f"(?:{p})" for p in patterns)) for flag, patterns in QUALITY_PATTERNS.items()}
_BEFORE_SIGN, _BARS = re.compile(r" +([,.;:])"), re.compile(r"(^| )[_|]+( |$)")


def cleaned(s: str, entities: bool = True) -> str:
    """Markup to spaces, then entities decoded, then white space collapsed."""
    if "<" in s:
        s = _TAG.sub(" ", s)
    if entities and "&" in s:
        s = html.unescape(s)
    return " ".join(s.split())


def stripped(clean: str, low: str, entities: bool = True) -> str:
    """Clean text without archive terms, rights notices and lone bars; `low` is it in lower case."""
    out = clean
    if any(w in low for w in STRIP_WORDINGS):
        for p in _STRIP:
            out = p.sub(" ", out)
    if " ," in out or " ." in out or " ;" in out or " :" in out:
        out = _BEFORE_SIGN.sub(r"\1", out)
    if "_" in out or "|" in out:
        out = _BARS.sub(" ", out)
    return clean if out is clean and "<" not in out and "&" not in out else cleaned(out, entities)


def flags_of(low: str) -> list[str]:
    """Names of the pattern groups that clean lower-case text matches."""
    return [flag for flag, p in _FLAGS.items() if p.search(low)] if any(w in low for w in QUALITY_WORDINGS) else []
