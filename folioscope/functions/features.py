"""What rules ask of a text, found in one pass: its matching text's length, boilerplate flags, and the phrases in it.

The pass cleans a text, takes boilerplate out, and runs one automaton for all phrases over the result. It is one Arrow evaluation for a row,
however many phrases and fields there are; `feature_table` makes it one for each distinct text, keyed by content, for tables that share texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.plain import cleaned, flags_of, stripped
from folioscope.functions.text import col, text

_DASHES = "‐‑‒–—"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Phrases:
    """All places of all phrases in one pass over a matching text. A phrase stands between characters that are no letters or digits; its hyphens also match spaces."""

    def __init__(self, phrases: Iterable[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        forms: dict[str, list[int]] = {}
        for i, phrase in enumerate(phrases):
            for form in phrase_forms(phrase):
                forms.setdefault(form, []).append(i)
        for form, ids in forms.items():
            self.automaton.add_word(form, (len(form), ids))
        self.some = bool(forms)
        if self.some:
            self.automaton.make_automaton()

    def find(self, s: str) -> list[int]:
        """Numbers of the phrases in s, ascending."""
        found: set[int] = set()
        if self.some and s:
            last = len(s) - 1
            for end, (size, ids) in self.automaton.iter(s):
                if (end == last or s[end + 1] not in _WORD) and (end < size or s[end - size] not in _WORD):
                    found.update(ids)
        return sorted(found)


def plain_dashes(s: str) -> str:
    """Dashes as hyphens. A text without any isn't gone through character by character."""
    for d in _DASHES if not s.isascii() else "":
        s = s.replace(d, "-")
    return s


def phrase_forms(phrase: str) -> list[str]:
    """The phrase in lower case with single spaces, each hyphen after its beginning also as a space."""
    p = " ".join(phrase.lower().split())
    choices = [("-", " ") if c == "-" and i else (c,) for i, c in enumerate(p)]
    return ["".join(x) for x in itertools.product(*choices)] if p else []


@lru_cache(maxsize=16)
def _finder(phrases: tuple[str, ...]) -> Phrases:
    return Phrases(phrases)


def features(fields: list[Column | str], phrases: list[str] | tuple[str, ...] = (), entities: bool = True, title: int | None = None) -> Column:
    """struct(chars, flags, hits, title_hits) of a row's fields. chars: length of the fields' matching texts joined by one space, empty ones left out; flags: boilerplate
    flags of all fields in order of appearance, joined by `|`; hits: numbers of the phrases in the joined text; title_hits: in the field of that number alone."""
    phrases = tuple(phrases)

    def run(*columns: pa.Array) -> pa.Array:
        find = _finder(phrases).find
        chars, flags, hits, title_hits = [], [], [], []
        for values in zip(*columns, strict=True):
            pieces, seen = [], []
            for v in values:
                clean = cleaned(v.as_py(), entities)
                low = clean.lower()
                seen += flags_of(low)
                bare = stripped(clean, low, entities)
                pieces.append(plain_dashes(low if bare is clean else bare.lower()))
            joined = " ".join(p for p in pieces if p)
            chars.append(len(joined))
            flags.append("|".join(dict.fromkeys(seen)))
            hits.append(find(joined))
            title_hits.append([] if title is None else find(pieces[title]))
        found = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(chars, pa.int32()), pa.array(flags, pa.string()), pa.array(hits, found), pa.array(title_hits, found)], ["chars", "flags", "hits", "title_hits"])

    return F.arrow_udf(run, "chars int, flags string, hits array<int>, title_hits array<int>")(*[text(f) for f in fields])


def phrase_hits(c: Column | str, phrases: list[str] | tuple[str, ...]) -> Column:
    """Numbers of the phrases in a matching text."""
    phrases = tuple(phrases)

    def run(s: pa.Array) -> pa.Array:
        find = _finder(phrases).find
        return pa.array((find(v.as_py()) for v in s), pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text(c))


def stripped_size(c: Column | str, entities: bool = True) -> Column:
    """struct(clean_chars, stripped_chars, flags) of one text."""

    def run(s: pa.Array) -> pa.Array:
        sizes, left, flags = [], [], []
        for v in s:
            clean = cleaned(v.as_py(), entities)
            low = clean.lower()
            sizes.append(len(clean))
            left.append(len(stripped(clean, low, entities)))
            flags.append("|".join(flags_of(low)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(left, pa.int32()), pa.array(flags, pa.string())], ["clean_chars", "stripped_chars", "flags"])

    return F.arrow_udf(run, "clean_chars int, stripped_chars int, flags string")(text(c))


def content_key(c: Column | str) -> Column:
    """128-bit digest of a text, null as empty."""
    return F.md5(text(c).cast("binary"))


def feature_table(texts: DataFrame, entities: bool = True) -> DataFrame:
    """(content_key, clean_chars, stripped_chars, flags): one row for each distinct text of a table's one column, worked out once. Equal texts
    meet by their digest: Spark keeps one of each before the shuffle."""
    only = texts.select(F.col(texts.columns[0]).alias("__text"))
    distinct = only.select(content_key("__text").alias("content_key"), text("__text").alias("__text")).dropDuplicates(["content_key"])
    return distinct.withColumn("__f", stripped_size("__text", entities)).select("content_key", "__f.clean_chars", "__f.stripped_chars", "__f.flags")


def with_text_features(df: DataFrame, c: str, prefix: str, table: DataFrame | None = None, entities: bool = True) -> DataFrame:
    """df with <prefix>_clean_chars, _stripped_chars and _flags of a text column: looked up by content in a feature table, or else worked out row by row."""
    names = ("clean_chars", "stripped_chars", "flags")
    if table is None:
        return df.withColumn("__f", stripped_size(c, entities)).withColumns({f"{prefix}_{n}": F.col(f"__f.{n}") for n in names}).drop("__f")
    known = table.select(F.col("content_key").alias("__key"), *[F.col(n).alias(f"{prefix}_{n}") for n in names])
    return df.withColumn("__of", content_key(col(c))).join(known, F.col("__of") == F.col("__key"), "left").drop("__of", "__key")
