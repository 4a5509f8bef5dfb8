"""Text columns: cleaning, boilerplate, matching text. Null counts as empty; an empty string is what is missing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.config import DOI_PREFIXES
from folioscope.functions.plain import cleaned, flags_of, stripped

#: White space as Unicode has it, no-break spaces included, and the four separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]+"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def blank(c: Column | str) -> Column:
    """True where nothing but white space is there; a text is read up to its first other character."""
    return ~text(c).rlike(NOT_SPACE)


def present(c: Column | str) -> Column:
    return ~blank(c)


def _mapped(c: Column | str, one: Callable[[str], str]) -> Column:
    """one(text) of each row, null as empty, in one Arrow evaluation."""

    def run(s: pa.Array) -> pa.Array:
        return pa.array((one(v.as_py()) for v in s), pa.string())

    return F.arrow_udf(run, "string")(text(c))


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", " ")


def let(x: Column, make: Callable[[Column], Column]) -> Column:
    """make(x) with x evaluated once, however often make names it: expressions that name their input several times would double it at each step."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def clean(c: Column | str, entities: bool = True) -> Column:
    """Markup to spaces, then entities decoded, then white space collapsed: an escaped tag stays as text. A list gives its first
    entry that isn't empty before it comes here (see first_present). entities=False for sources that have none; only that stands within lambdas too."""
    return _mapped(c, cleaned) if entities else collapse(_bare(text(c)))


def strip_boilerplate(c: Column | str, entities: bool = True) -> Column:
    """Clean text without archive terms and rights notices."""

    def one(s: str) -> str:
        tidy = cleaned(s, entities)
        return stripped(tidy, tidy.lower(), entities)

    return _mapped(c, one)


def quality_flags(*fields: Column | str, entities: bool = True) -> Column:
    """Names of the pattern groups that any field matches, in order of first appearance, joined by `|`."""
    found = F.concat_ws("|", *[_mapped(f, lambda s: "|".join(flags_of(cleaned(s, entities).lower()))) for f in fields])
    return F.array_join(F.array_distinct(F.filter(F.split(found, r"\|"), lambda x: x != "")), "|")


def matching(c: Column | str, cleaned: bool = False) -> Column:
    """Lower case, five kinds of dashes as hyphens, white space collapsed (cleaned: it is already)."""
    out = F.regexp_replace(F.lower(text(c)), "[‐‑‒–—]", "-")
    return out if cleaned else collapse(out)


def classification_text(fields: list[str], entities: bool = True) -> Column:
    """Fields without boilerplate, made ready for matching, joined by one space where they aren't empty."""
    return join_pieces([matching(strip_boilerplate(f, entities), cleaned=True) for f in fields])


def join_pieces(pieces: list[Column | str]) -> Column:
    """What isn't empty, joined by one space."""
    return F.array_join(F.filter(F.array(*pieces), lambda x: x != ""), " ")


def doi(c: Column | str) -> Column:
    out = F.lower(F.trim(text(c)))
    out = F.regexp_replace(out, r"^https?://(dx\.)?doi\.org/", "")
    return F.trim(F.regexp_replace(out, r"^doi:\s*", ""))


def title_key(c: Column | str, entities: bool = True) -> Column:
    """Lower-case letters and digits, everything else as one space."""
    return F.trim(F.regexp_replace(F.lower(clean(c, entities)), "[^a-z0-9]+", " "))


def article_id(doi_col: Column | str, journal: Column | str, year: Column | str, title: Column | str, prefix: str = "art_", entities: bool = True) -> Column:
    base = F.when(text(doi_col) != "", F.concat(F.lit("doi:"), doi(doi_col))).otherwise(F.concat_ws(":", F.lit("title"), text(journal), text(year), title_key(title, entities)))
    return F.concat(F.lit(prefix), F.substring(F.sha1(base.cast("binary")), 1, 16))


def link_key(doi_col: Column | str, journal: Column | str, year: Column | str, title: Column | str, entities: bool = True) -> tuple[Column, Column]:
    """(rule, value): the DOI if there is one, else journal, year and title."""
    has = text(doi_col) != ""
    rule = F.when(has, "doi").otherwise("title_journal_year")
    return rule, F.when(has, doi(doi_col)).otherwise(F.concat_ws("|", text(journal), text(year), title_key(title, entities)))


def pages(c: Column | str) -> tuple[Column, Column]:
    """First and last page, split at the first hyphen or dash."""
    parts = F.split(F.trim(text(c)), r"\s*[-–—]\s*", 2)
    return F.trim(parts[0]), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def first_present(*columns: Column | str) -> Column:
    """The first value that isn't blank, else empty."""
    return F.coalesce(*[F.when(present(c), text(c)) for c in columns], F.lit(""))


def first_of_list(c: Column | str) -> Column:
    """First entry of an array that isn't blank, else empty."""
    return F.coalesce(F.get(F.filter(col(c), lambda x: present(x)), F.lit(0)), F.lit(""))


def best_date(*parts: Column | str) -> tuple[Column, Column]:
    """(ISO date, year) from date-part arrays in order of preference; month and day default to 1."""
    p = F.coalesce(*[F.when(F.size(col(c)) > 0, col(c)) for c in parts])
    day = F.format_string("%04d-%02d-%02d", F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), F.lit(1)), F.coalesce(F.get(p, F.lit(2)), F.lit(1)))
    return F.when(p.isNotNull(), day).otherwise(""), F.get(p, F.lit(0)).cast("int")


def author_names(authors: Column | str, entities: bool = False) -> Column:
    """Array of display names from structs (given, family, name): given and family, else name; blanks left out."""

    def one(a: Column) -> Column:
        both = F.concat_ws(" ", *[F.when(clean(a[x], entities) != "", clean(a[x], entities)) for x in ("given", "family")])
        return F.when(both != "", both).otherwise(clean(a["name"], entities))

    return F.coalesce(F.filter(F.transform(col(authors), one), lambda x: x != ""), F.array().cast("array<string>"))


def from_inverted_index(index: Column | str) -> Column:
    """Text from a map of word to positions; of two words on a position the later entry wins, gaps collapse."""
    entries = F.map_entries(col(index))
    flat = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))

    def joined(ordered: Column) -> Column:
        last = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["p"], F.lit(-1)) != x["p"])
        return collapse(F.array_join(F.transform(last, lambda x: x["w"]), " "))

    return F.coalesce(let(F.array_sort(flat), joined), F.lit(""))  # sorted once, not for each word


def keyword_set(*lists: Column | str, entities: bool = False) -> Column:
    """Union of name lists, cleaned, blanks left out, sorted, joined by `|`."""
    all_names = F.flatten(F.filter(F.array(*[col(c) for c in lists]), lambda x: x.isNotNull()))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(all_names, lambda x: clean(x, entities)), lambda x: x != ""))), "|")


def json_or_empty(c: Column | str) -> Column:
    """An array or struct as JSON, empty where there is nothing."""
    out = F.to_json(col(c))
    return F.when(out.isNull() | out.isin("[]", "{}"), "").otherwise(out)


def decade(c: Column | str) -> Column:
    """1987, `1987` or `1987.0` give `1980`, what isn't a number `missing`."""
    year = number(c)
    return F.coalesce((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("missing"))


def number(c: Column | str) -> Column:
    return col(c).cast("string").try_cast("double")


def score_bin(c: Column | str) -> Column:
    s = col(c)
    return F.when(s <= 0, "none").when(s <= 1, "low").when(s <= 3, "medium").otherwise("high")


def doi_prefix_family(c: Column | str, journals: tuple[str, ...] = ("10.1093",)) -> Column:
    """A known beginning, or else the registrant of a DOI, with the journal's code (up to the first dot) for registrants that hold many
    journals; empty without a DOI."""
    d = doi(c)
    parts = F.split(d, "/")
    code = F.trim(F.substring_index(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ".", 1))
    known = reduce(lambda out, p: F.when(d.startswith(p), p).otherwise(out), reversed(DOI_PREFIXES), F.when(parts[0].isin(*journals) & (code != ""), F.concat_ws("/", parts[0], code)).otherwise(parts[0]))
    return F.when(d == "", "").otherwise(known)


def _percent(c: Column, keep: str) -> Column:
    out = F.url_encode(c)
    for a, b in (("\\+", "%20"), ("\\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    for ch in keep:
        out = F.regexp_replace(out, f"%{ord(ch):02X}", "\\$" if ch == "$" else ch)
    return out


def doi_url(c: Column | str) -> Column:
    d = doi(c)
    return F.when(d == "", "").otherwise(F.concat(F.lit("https://doi.org/"), _percent(d, "/:;()._-")))


def repec_urls(article_url: Column | str, doi_col: Column | str, journal: Column | str) -> Column:
    """Index pages of an article: its own link if it leads to the index, and the page of one journal's DOIs. Addresses."""
    own, d = collapse(text(article_url)), doi(doi_col)
    page = F.concat(F.lit("https://ideas.repec.org/a/ucp/jpolec/doi"), F.replace(d, F.lit("/"), F.lit("-")), F.lit(".html"))
    return distinct_urls(F.when(F.lower(own).contains("econpapers") | F.lower(own).contains("repec"), own), F.when((F.lower(collapse(text(journal))) == "jpe") & d.startswith("10.1086/"), page))


def publisher_urls(article_url: Column | str, doi_col: Column | str) -> Column:
    """Publisher pages of an article, each once. Addresses by DOI prefix."""
    own, d = collapse(text(article_url)), doi(doi_col)
    pages = [("10.1257/", "https://www.aeaweb.org/articles?id=", d), ("10.7916/", "https://academiccommons.columbia.edu/doi/", F.upper(d)), ("10.3982/", "https://www.econometricsociety.org/doi/", F.upper(d))]
    return distinct_urls(F.when(F.lower(own).contains("aeaweb.org/articles"), own), *[F.when(d.startswith(p), F.concat(F.lit(u), _percent(x, "/._-"))) for p, u, x in pages])


def work_url(base: str, c: Column | str) -> Column:
    """base followed by the value with nothing but letters, digits and `_.-~` left as it is; empty for none."""
    return F.when(blank(c), "").otherwise(F.concat(F.lit(base), _percent(F.trim(text(c)), "")))


def title_url(base: str, c: Column | str) -> Column:
    return F.when(blank(c), "").otherwise(F.concat(F.lit(base), _percent(F.trim(text(c)), "/")))


def distinct_urls(*urls: Column) -> Column:
    """Array of the URLs that aren't blank, in order, each once."""
    return F.array_distinct(F.filter(F.array(*urls), lambda x: present(x)))


def open_pdf_url(locations: Column | str, fallback: Column | str) -> Column:
    """pdf_url of the first open location that has one, else a fallback that ends in .pdf, else empty."""
    good = F.filter(col(locations), lambda x: x["is_oa"] & present(x["pdf_url"]))
    return F.coalesce(F.get(good, F.lit(0))["pdf_url"], F.when(F.lower(text(fallback)).endswith(".pdf"), text(fallback)), F.lit(""))


def abstract_section(c: Column | str, max_chars: int = 4000, least: int = 150) -> Column:
    """What stands between `abstract` and the next heading of a document, if it has `least` characters; else the beginning."""
    whole = collapse(text(c))
    section = F.trim(F.regexp_extract(whole, r"(?is)\babstract\b[:.\s-]*(.*?)(?=\b(?:1\.?\s+)?introduction\b|\bkey\s*words?\b|\bjel\b|$)", 1))
    return F.when(F.length(section) >= least, section).otherwise(F.substring(whole, 1, max_chars))


def titles_contain(expected: Column | str, observed: Column | str, entities: bool = True) -> Column:
    """Either normalised title contains the other; never for empty ones."""
    a, b = title_key(expected, entities), title_key(observed, entities)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def stable_key(*parts: Column | str, length: int = 24, entities: bool = True) -> Column:
    """First hex digits of the SHA-1 of the cleaned parts joined by `|`."""
    return F.substring(F.sha1(F.concat_ws("|", *[clean(p, entities) for p in parts]).cast("binary")), 1, length)


def payload_key(**fields: Column | str) -> Column:
    """SHA-256 of the fields as JSON, keys sorted."""
    return F.sha2(F.to_json(F.struct(*[text(fields[k]).alias(k) for k in sorted(fields)])).cast("binary"), 256)


def preview(c: Column | str, limit: int) -> Column:
    """At most `limit` characters, an ellipsis for what is cut."""
    whole = collapse(text(c))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit - 3)), F.lit("...")))
