"""What a fetched HTML page holds: abstracts, PDF link, DOI, title. One vectorised helper reads the markup; the rest are expressions."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioscope.functions import text as T

PAGE = StructType([StructField(c, StringType()) for c in ("abstract", "index_abstract", "pdf_url", "doi", "title")])
_ABSTRACT_META = ("citation_abstract", "dc.description.abstract", "og:abstract", "abstract")
_DESCRIPTION_META = ("dc.description", "description", "og:description")


class _Reader(HTMLParser):
    """Meta tags, the text of abstract blocks, the title, and links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.blocks: list[str] = []
        self.title: list[str] = []
        self.depth = 0
        self.tag = ""
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a.get("content", ""))
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        self.in_title = self.in_title or tag == "title"
        if self.depth:
            self.depth += tag == self.tag
        elif tag in ("section", "div") and "abstract" in f"{a.get('class', '')} {a.get('id', '')}".lower():
            self.tag, self.depth = tag, 1
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        if self.depth and tag == self.tag:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data + " "
        if self.in_title:
            self.title.append(data)


def _squeeze(s: str) -> str:
    return " ".join(s.split())


def _read(html: str | None, base: str | None) -> tuple[str, str, str, str, str]:
    r = _Reader()
    r.feed(html or "")
    title = _squeeze(r.meta.get("citation_title") or r.meta.get("dc.title") or " ".join(r.title))
    direct = next((_squeeze(r.meta[m]) for m in _ABSTRACT_META if _squeeze(r.meta.get(m, ""))), "")
    block = next((_squeeze(b) for b in r.blocks if _squeeze(b)), "")
    marked = ""
    for m in _DESCRIPTION_META:
        found = _squeeze(r.meta.get(m, ""))
        if "abstract:" in found.lower():
            marked = found[found.lower().index("abstract:") + 9 :].strip()
            break
    index = next((_squeeze(r.meta[m]) for m in (*_ABSTRACT_META, "description") if _squeeze(r.meta.get(m, ""))), "")
    link = r.meta.get("citation_pdf_url") or next((x for x in r.links if x.lower().split("?")[0].endswith(".pdf") or "/download" in x.lower()), "")
    doi = r.meta.get("citation_doi") or r.meta.get("dc.identifier") or ""
    return block or direct or marked, index, urljoin(base or "", link) if link else "", doi, title


@F.pandas_udf(PAGE)
def _page(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(h, b) for h, b in zip(html, base, strict=True)], columns=PAGE.names)


def read_page(html: Column | str, base_url: Column | str) -> Column:
    """struct(abstract, index_abstract, pdf_url, doi, title) of a page."""
    return _page(T.text(html), T.text(base_url))


def usable_abstract(c: Column | str, title: Column | str = "", least: int = 80) -> Column:
    """The abstract without a leading label, or empty if it is a notice, the title alone, or a citation."""
    body = F.trim(F.regexp_replace(F.regexp_replace(T.collapse(T.text(c)), r"(?i)^downloadable!?\s*", ""), r"(?i)^abstract[:.\s]+", ""))
    notice = F.lower(body).rlike("no abstract (is )?available|abstract not available")
    same = T.title_key(body, False) == (T.title_key(title, False) if not isinstance(title, str) or title else F.lit("\x00"))
    citation = body.rlike(r"(?i)^[^.]{0,200}\b(vol\.|volume|pp\.|pages)\s*\d") & (F.length(body) < 250)
    return F.when(notice | same | citation | (F.length(body) < least), "").otherwise(body)


def page_outcome(html: Column | str, status: Column | str, abstract: Column, pdf_url: Column) -> Column:
    """What a fetched page is good for, the first that applies."""
    low, code = F.lower(T.text(html)), T.col(status).cast("int")
    missing = (code == 404) | low.rlike("page not found|doi not found|404 not found")
    challenge = low.rlike("captcha|access denied|are you a robot|just a moment|cf-challenge|enable javascript and cookies")
    return F.when(abstract != "", "abstract_found").when(pdf_url != "", "pdf_candidate").when(missing, "not_found").when(challenge, "access_challenge").when(code >= 400, "http_error").otherwise("no_metadata_found")


def verified_match(df, minimum_chars: int = 250):
    """df (doi, title, html, url, page_order) with `status`: a page's DOI must be the row's, the titles must contain each other and the abstract
    must be long enough; of several pages the first good one counts."""
    p = F.col("__p")
    work = df.withColumn("__p", read_page("html", "url"))
    good = (T.doi(p["doi"]) == T.doi("doi")) & (T.doi("doi") != "") & T.titles_contain("title", p["title"])
    body = usable_abstract(p["abstract"])
    status = F.when(~good, "no_verified_match").when(F.length(body) >= minimum_chars, "recovered").when(body != "", "abstract_too_short").otherwise("no_abstract")
    rank = F.when(status == "recovered", 0).when(status == "abstract_too_short", 1).when(status == "no_abstract", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("r"), F.col("page_order"), status.alias("status"), F.when(status == "recovered", body).otherwise("").alias("abstract")))
    return work.groupBy("doi", "title").agg(best.alias("x")).select("doi", "title", "x.status", "x.abstract")
