"""Queries over JSON pages that hold the documents as items of two metadata sources, and over what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.plans import sqltext as Q
from folioscope.plans.bindings import SQL as B
from folioscope.plans.bindings import articles, table
from folioscope.sources import pages as P

#: Items a page, and the years asked for.
ITEMS, START, END = 20, 1980, 2020


def _bodies(items, last):
    """(source_file, body): ITEMS items a page by number; every 7th page is cut short, every 11th has no list, every 13th is an error page by name."""
    n = F.col("page_no")
    grouped = items.groupBy(F.floor(F.col("doc_id") / ITEMS).cast("long").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "i")), lambda a, b: F.signum(a["doc_id"] - b["doc_id"]).cast("int")).alias("x"))
    listed = F.transform("x", lambda x: x["i"])
    meta = F.struct(F.lit("aer").alias("journal_short"), F.lit("A Review").alias("journal"), F.concat(F.lit("https://example.org/?page="), n).alias("query_url"))
    whole = F.to_json(F.struct(meta.alias("metadata"), F.when(n % 11 != 5, last(listed)).alias("response")))
    body = F.when(n % 7 == 3, F.substring(whole, 1, 60)).otherwise(whole)
    return grouped.select(F.concat(F.lit("page_"), n, F.when(n % 13 == 6, "_error.json").otherwise(".json")).alias("source_file"), body.alias("body"))


def _first(spark, sf_dir):
    """Documents as items of the first source: lists of titles, markup around texts, date parts of one to three numbers, page ranges, authors by parts."""
    item = """named_struct('DOI', if(doc_id % 6 = 0, null, concat('10.1000/ABC.', doc_id)), 'title', array('', substring_index(text, '\n', 1)), 'abstract', concat('<jats:p>', lang, ' <i>of</i>  ', source, '</jats:p>'), 'type', 'journal-article',
      'volume', cast(doc_id % 40 as string), 'page', element_at(array('12-30', ' 7 – 9 ', '5', null), cast(doc_id % 4 as int) + 1), 'URL', concat('https://example.org/', doc_id),
      'published-print', if(doc_id % 3 = 0, named_struct('date-parts', array(array(1975 + cast(doc_id % 51 as int), 1 + cast(doc_id % 12 as int), 1 + cast(doc_id % 28 as int)))), null),
      'issued', if(doc_id % 5 = 0 and doc_id % 3 <> 0, null, named_struct('date-parts', array(array(1975 + cast(doc_id % 50 as int))))),
      'author', array(named_struct('given', 'Ada', 'family', concat('L', doc_id % 9), 'name', null, 'affiliation', array(named_struct('name', source))), named_struct('given', null, 'family', null, 'name', if(doc_id % 2 = 0, 'A Group', ' '), 'affiliation', null)))"""
    items = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{item} as i")
    return P.parsed_pages(_bodies(items, lambda x: F.struct(F.struct(x.alias("items")).alias("message"))))


def _second(spark, sf_dir):
    """Documents as items of the second source; the words of the first line as an inverted index."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode(F.split(F.substring_index("text", "\n", 1), " ")).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("idx"))
    item = """named_struct('id', concat('https://example.org/W', doc_id), 'doi', if(doc_id % 4 = 0, null, concat('https://doi.org/10.1000/X', doc_id)), 'title', if(doc_id % 2 = 0, ' ', source), 'display_name', lang, 'publication_year', 1975 + cast(doc_id % 51 as int),
      'publication_date', '2001-02-03', 'type', 'article', 'biblio', named_struct('volume', cast(doc_id % 41 as string), 'first_page', '3', 'last_page', if(doc_id % 3 = 0, '', '8')), 'abstract_inverted_index', idx,
      'authorships', array(named_struct('author', named_struct('display_name', concat('B ', doc_id % 8)), 'institutions', array(named_struct('display_name', lang))), named_struct('author', named_struct('display_name', ''), 'institutions', array())),
      'keywords', array(named_struct('display_name', source), named_struct('display_name', ' zeta ')), 'topics', array(named_struct('display_name', lang), named_struct('display_name', 'zeta')))"""
    items = docs.join(index, "doc_id", "left").selectExpr("doc_id", f"{item} as i")
    return P.parsed_pages(_bodies(items, lambda x: F.struct(x.alias("results"))), "openalex")


def page_states(spark, sf_dir):
    return P.parsed_page_accounts(_first(spark, sf_dir)).select("source_file", "page_status", "items", F.length("unread_text").alias("unread_chars"))


def _good(pages):
    """Error pages by name are left out, as those in folders are."""
    return pages.where(~F.col("source_file").endswith("_error.json"))


def page_records(spark, sf_dir):
    out = P.crossref_items(_good(_first(spark, sf_dir)), START, END)
    return out.select("article_url", "source_record_id", "source_query_url", "title", "abstract", "publication_year", "publication_date", "doi", "volume", "first_page", "last_page", "pages_raw", "author_names", "num_authors", "author_affiliations_raw")


def indexed_records(spark, sf_dir):
    out = P.openalex_items(_good(_second(spark, sf_dir)), START, END)
    return out.select("openalex_id", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "publication_year", "doi", "volume", "pages_raw", "author_names", "num_authors", "author_affiliations_raw", "keywords")


def lookup_urls(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("d", F.concat("doi", F.lit("(a b);~*+<")))
    return a.select("article_id", T.doi_url("d").alias("doi_url"), T.work_url("https://api.example.org/works/", "d").alias("work_url"), T.title_url("https://example.org/?q=", F.concat("journal_short", F.lit(" / it's: 50%"))).alias("title_url"), T.doi_url("doi").alias("plain_doi_url"))


def pdf_links(spark, sf_dir):
    a = articles(spark, sf_dir).selectExpr("article_id", "cast(article_id as long) % 6 as k", "oa_pdf_url", "concat('https://example.org/', article_id, if(cast(article_id as long) % 4 = 0, '.PDF', '.html')) as oa_url")
    spot = lambda ok, url: F.struct(ok.alias("is_oa"), url.alias("pdf_url"))
    places = F.array(spot(F.col("k") > 1, F.when(F.col("k") == 3, F.concat(F.lit("best/"), "article_id"))), spot(F.col("k") != 4, F.col("oa_pdf_url")))
    return a.select("article_id", T.open_pdf_url(places, "oa_url").alias("pdf_url"))


def _extracted(spark, sf_dir):
    heading = F.element_at(F.array(*[F.lit(x) for x in (" 1. Introduction and more", " Key words: a, b", " JEL C1", "")]), (F.col("article_id").cast("long") % 4 + 1).cast("int"))
    return articles(spark, sf_dir).withColumn("body", F.concat("title", F.lit("  ABSTRACT: "), "abstract", heading))


def abstract_sections(spark, sf_dir):
    return _extracted(spark, sf_dir).select("article_id", F.md5(T.abstract_section("body").cast("binary")).alias("section_md5"))


def title_containment(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("k", F.col("article_id").cast("long") % 4)
    seen = F.when(F.col("k") == 0, F.concat(F.lit("The <b>"), "title", F.lit("</b>!"))).when(F.col("k") == 1, F.col("abstract")).when(F.col("k") == 2, F.substring_index("title", " ", 2)).otherwise("")
    return a.select("article_id", T.titles_contain("title", seen).alias("contained"))


def previews(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("article_id", T.preview("title", 40).alias("title_preview"), T.preview("abstract", 900).alias("abstract_preview"))


QUERIES = {f.__name__: f for f in (page_states, page_records, indexed_records, lookup_urls, pdf_links, abstract_sections, title_containment, previews)}

_N = f"doc_id // {ITEMS}"
_READ = f"({_N}) % 7 <> 3 AND ({_N}) % 11 <> 5 AND ({_N}) % 13 <> 6"
_HEAD = "split_part(text, chr(10), 1)"


def _kept(x: str, keep: str) -> str:
    for ch in keep:
        x = f"replace({x}, '%{ord(ch):02X}', '{ch}')"
    return x


_D = "doi || '(a b);~*+<'"
_RESOLVER = _kept(f"url_encode(lower(trim({_D})))", "/:;()._-")
SQL = {
    "page_states": f"""WITH p AS (SELECT {_N} AS n, count(*) AS c FROM documents GROUP BY 1), s AS (SELECT *, CASE WHEN n % 13 = 6 THEN 'error_page' WHEN n % 7 = 3 THEN 'malformed' WHEN n % 11 = 5 THEN 'no_items' ELSE 'ok' END AS page_status FROM p)
SELECT 'page_' || n || CASE WHEN n % 13 = 6 THEN '_error.json' ELSE '.json' END AS source_file, page_status, CASE WHEN page_status = 'ok' THEN c ELSE 0 END AS items, CASE WHEN n % 7 = 3 THEN 60 ELSE 0 END AS unread_chars FROM s""",
    "page_records": f"""WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1975 + doc_id % 51 WHEN doc_id % 5 = 0 THEN NULL ELSE 1975 + doc_id % 50 END AS y, ['12-30', ' 7 – 9 ', '5', ''][doc_id % 4 + 1] AS pg FROM documents WHERE {_READ})
SELECT 'https://example.org/' || doc_id AS article_url, CASE WHEN doc_id % 6 = 0 THEN '' ELSE '10.1000/ABC.' || doc_id END AS source_record_id, 'https://example.org/?page=' || ({_N}) AS source_query_url, {Q.clean(_HEAD)} AS title, {Q.clean("lang || ' of ' || source")} AS abstract, CAST(y AS INTEGER) AS publication_year,
CASE WHEN doc_id % 3 = 0 THEN printf('%04d-%02d-%02d', y, 1 + doc_id % 12, 1 + doc_id % 28) WHEN y IS NULL THEN '' ELSE printf('%04d-01-01', y) END AS publication_date, CASE WHEN doc_id % 6 = 0 THEN '' ELSE '10.1000/abc.' || doc_id END AS doi, CAST(doc_id % 40 AS VARCHAR) AS volume,
['12', '7', '5', ''][doc_id % 4 + 1] AS first_page, ['30', '9', '', ''][doc_id % 4 + 1] AS last_page, pg AS pages_raw, 'Ada L' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN '|A Group' ELSE '' END AS author_names, CASE WHEN doc_id % 2 = 0 THEN '2' ELSE '1' END AS num_authors,
'[{{"author":"Ada L' || (doc_id % 9) || '","affiliation":"' || source || '"}}]' AS author_affiliations_raw FROM d WHERE y IS NULL OR y BETWEEN {START} AND {END}""",
    "indexed_records": f"""WITH d AS (SELECT *, 1975 + doc_id % 51 AS y FROM documents WHERE {_READ})
SELECT 'https://example.org/W' || doc_id AS openalex_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS title, md5({Q.collapse(_HEAD)}) AS abstract_md5, CAST(y AS INTEGER) AS publication_year, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '10.1000/x' || doc_id END AS doi, CAST(doc_id % 41 AS VARCHAR) AS volume,
CASE WHEN doc_id % 3 = 0 THEN '3' ELSE '3-8' END AS pages_raw, 'B ' || (doc_id % 8) AS author_names, '1' AS num_authors, '[{{"author":"B ' || (doc_id % 8) || '","affiliation":"' || lang || '"}}]' AS author_affiliations_raw, array_to_string(list_sort(list_distinct([source, 'zeta', lang])), '|') AS keywords FROM d WHERE y BETWEEN {START} AND {END}""",
    "lookup_urls": f"""WITH {B["articles"]} SELECT article_id, 'https://doi.org/' || {_RESOLVER} AS doi_url, 'https://api.example.org/works/' || url_encode({_D}) AS work_url, 'https://example.org/?q=' || {_kept("url_encode(journal_short || ' / it''s: 50%')", "/")} AS title_url,
CASE WHEN doi = '' THEN '' ELSE 'https://doi.org/' || lower(doi) END AS plain_doi_url FROM articles""",
    "pdf_links": f"""WITH {B["articles"]}, k AS (SELECT article_id, oa_pdf_url, CAST(article_id AS BIGINT) AS i FROM articles)
SELECT article_id, CASE WHEN i % 6 = 3 THEN 'best/' || article_id WHEN i % 6 <> 4 AND oa_pdf_url <> '' THEN oa_pdf_url WHEN i % 4 = 0 THEN 'https://example.org/' || article_id || '.PDF' ELSE '' END AS pdf_url FROM k""",
    "abstract_sections": f"""WITH {B["articles"]}, b AS (SELECT article_id, {Q.collapse("title || '  ABSTRACT: ' || abstract || [' 1. Introduction and more', ' Key words: a, b', ' JEL C1', ''][CAST(article_id AS BIGINT) % 4 + 1]")} AS w FROM articles),
s AS (SELECT *, trim(regexp_extract(w, '\\babstract\\b[:.\\s-]*(.*?)(?:\\b(?:1\\.?\\s+)?introduction\\b|\\bkey\\s*words?\\b|\\bjel\\b|$)', 1, 'is')) AS x FROM b)
SELECT article_id, md5(CASE WHEN length(x) >= 150 THEN x ELSE substr(w, 1, 4000) END) AS section_md5 FROM s""",
    "title_containment": f"""WITH {B["articles"]}, o AS (SELECT article_id, {Q.title_key("title")} AS a, CASE CAST(article_id AS BIGINT) % 4 WHEN 0 THEN 'The <b>' || title || '</b>!' WHEN 1 THEN abstract WHEN 2 THEN array_to_string(string_split(title, ' ')[1:2], ' ') ELSE '' END AS seen FROM articles),
k AS (SELECT article_id, a, {Q.title_key("seen")} AS b FROM o) SELECT article_id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS contained FROM k""",
    "previews": f"""WITH {B["articles"]}, c AS (SELECT article_id, {Q.collapse("title")} AS t, {Q.collapse("abstract")} AS a FROM articles)
SELECT article_id, CASE WHEN length(t) <= 40 THEN t ELSE rtrim(substr(t, 1, 37)) || '...' END AS title_preview, CASE WHEN length(a) <= 900 THEN a ELSE rtrim(substr(a, 1, 897)) || '...' END AS abstract_preview FROM c""",
}
