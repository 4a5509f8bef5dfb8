"""Raw JSON pages of two metadata sources as source records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T

_DATE = "struct<`date-parts`:array<array<int>>>"
_META = "metadata struct<journal_short:string,journal:string,query_url:string>"
_CROSSREF = f"""{_META}, response struct<message:struct<items:array<struct<DOI:string,title:array<string>,abstract:string,type:string,volume:string,issue:string,page:string,URL:string,
  `published-print`:{_DATE},`published-online`:{_DATE},published:{_DATE},issued:{_DATE},created:{_DATE},
  author:array<struct<given:string,family:string,name:string,affiliation:array<struct<name:string>>>>>>>>""".replace("\n", "")
_OPENALEX = f"""{_META}, response struct<results:array<struct<id:string,doi:string,title:string,display_name:string,publication_year:int,publication_date:string,type:string,
  biblio:struct<volume:string,issue:string,first_page:string,last_page:string>,primary_location:struct<landing_page_url:string>,abstract_inverted_index:map<string,array<int>>,
  authorships:array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>,keywords:array<struct<display_name:string>>,topics:array<struct<display_name:string>>>>>""".replace("\n", "")


def _pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Page files below path; error pages are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path).withColumn("source_file", F.col("_metadata.file_path")).where(~F.col("source_file").endswith("_error.json"))


def parsed_pages(raw: DataFrame, kind: str = "crossref") -> DataFrame:
    """Pages that a table holds as text (source_file, body) as those read from files: metadata, response and source_file, and the body in `__bad` where it is no JSON object."""
    shape = {"crossref": _CROSSREF, "openalex": _OPENALEX}[kind]
    read = F.from_json("body", f"{shape}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    return raw.select("source_file", read.alias("p")).select("source_file", "p.metadata", "p.response", "p.__bad")


def _accounts(pages: DataFrame, items: str) -> DataFrame:
    size = F.when(F.col(items).isNotNull(), F.size(items)).otherwise(0)
    rows = pages.select("source_file", "__bad", F.col(items).isNotNull().alias("listed"), size.alias("items"))
    status = F.when(F.col("source_file").endswith("_error.json"), "error_page").when(F.col("__bad").isNotNull(), "malformed").when(~F.col("listed"), "no_items").otherwise("ok")
    return rows.select("source_file", status.alias("page_status"), F.when(status == "ok", F.col("items")).otherwise(0).alias("items"), F.coalesce("__bad", F.lit("")).alias("unread_text"))


def parsed_page_accounts(pages: DataFrame, kind: str = "crossref") -> DataFrame:
    """page_accounts of parsed_pages."""
    return _accounts(pages, {"crossref": "response.message.items", "openalex": "response.results"}[kind])


def page_accounts(spark: SparkSession, path: str, kind: str = "crossref") -> DataFrame:
    """One row for each page file: source_file, page_status (`ok`, `error_page` by its name, `malformed` JSON, `no_items` where the list isn't there), items, and for
    malformed pages the text that couldn't be read. crossref_records and openalex_records take the items of `ok` pages, so that all items are in one or the other."""
    shape, items = {"crossref": (_CROSSREF, "response.message.items"), "openalex": (_OPENALEX, "response.results")}[kind]
    raw = spark.read.schema(f"{shape}, __bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "__bad").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    return _accounts(raw.withColumn("source_file", F.col("_metadata.file_path")), items)


def quarantined(accounts: DataFrame) -> DataFrame:
    """The pages of page_accounts that gave no items though they should."""
    return accounts.where("page_status in ('malformed', 'no_items')")


def _in_years(year: Column, start: int, end: int) -> Column:
    return year.isNull() | year.between(start, end)


def crossref_records(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Records of the first source from start to end; those without a year are kept."""
    return crossref_items(_pages(spark, path, _CROSSREF), start, end)


def crossref_items(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Records of the items of pages (metadata, response, source_file) as files or parsed_pages give them."""
    items = pages.select("metadata", "source_file", F.posexplode("response.message.items").alias("item_no", "i"))
    date, year = T.best_date(*[F.get(F.col(f"i.`{k}`.`date-parts`"), F.lit(0)) for k in ("published-print", "published-online", "published", "issued", "created")])
    first, last = T.pages("i.page")
    names = T.author_names("i.author")
    affiliations = F.flatten(F.transform("i.author", lambda a: F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name:string>>")), lambda f: F.struct(F.concat_ws(" ", a["given"], a["family"]).alias("author"), f["name"].alias("affiliation")))))
    return items.select(
        F.lit("crossref").alias("source"), T.text("i.DOI").alias("source_record_id"), "source_file", "item_no", T.text("metadata.query_url").alias("source_query_url"), T.text("metadata.journal_short").alias("journal_short"), T.text("metadata.journal").alias("journal"),
        T.clean(T.first_of_list("i.title")).alias("title"), T.clean("i.abstract").alias("abstract"), year.alias("publication_year"), date.alias("publication_date"), T.doi("i.DOI").alias("doi"),
        T.text("i.volume").alias("volume"), T.text("i.issue").alias("issue"), first.alias("first_page"), last.alias("last_page"), T.text("i.page").alias("pages_raw"), T.text("i.type").alias("article_type"), T.text("i.URL").alias("article_url"),
        T.json_or_empty("i.author").alias("authors_raw"), F.array_join(names, "|").alias("author_names"), T.json_or_empty(F.coalesce(affiliations, F.array().cast("array<struct<author:string,affiliation:string>>"))).alias("author_affiliations_raw"), F.size(names).cast("string").alias("num_authors"),
        F.lit("").alias("keywords"), T.text("i.DOI").alias("crossref_id"), F.lit("").alias("openalex_id"),
    ).where(_in_years(F.col("publication_year"), start, end))


def openalex_records(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Records of the second source; the abstract is put together from its inverted index."""
    return openalex_items(_pages(spark, path, _OPENALEX), start, end)


def openalex_items(pages: DataFrame, start: int, end: int) -> DataFrame:
    items = pages.select("metadata", "source_file", F.posexplode("response.results").alias("item_no", "i"))
    names = F.coalesce(F.filter(F.transform("i.authorships", lambda a: T.clean(a["author"]["display_name"], False)), lambda x: x != ""), F.array().cast("array<string>"))
    places = F.flatten(F.transform("i.authorships", lambda a: F.transform(a["institutions"], lambda p: F.struct(a["author"]["display_name"].alias("author"), p["display_name"].alias("affiliation")))))
    title = T.first_present("i.title", "i.display_name")
    pages = F.concat_ws("-", *[F.when(T.present(c), F.col(c)) for c in ("i.biblio.first_page", "i.biblio.last_page")])
    return items.select(
        F.lit("openalex").alias("source"), T.text("i.id").alias("source_record_id"), "source_file", "item_no", T.text("metadata.query_url").alias("source_query_url"), T.text("metadata.journal_short").alias("journal_short"), T.text("metadata.journal").alias("journal"),
        T.clean(title).alias("title"), T.from_inverted_index("i.abstract_inverted_index").alias("abstract"), F.col("i.publication_year").alias("publication_year"), T.text("i.publication_date").alias("publication_date"), T.doi("i.doi").alias("doi"),
        T.text("i.biblio.volume").alias("volume"), T.text("i.biblio.issue").alias("issue"), T.text("i.biblio.first_page").alias("first_page"), T.text("i.biblio.last_page").alias("last_page"), pages.alias("pages_raw"), T.text("i.type").alias("article_type"), T.text("i.primary_location.landing_page_url").alias("article_url"),
        T.json_or_empty("i.authorships").alias("authors_raw"), F.array_join(names, "|").alias("author_names"), T.json_or_empty(F.coalesce(places, F.array().cast("array<struct<author:string,affiliation:string>>"))).alias("author_affiliations_raw"), F.size(names).cast("string").alias("num_authors"),
        T.keyword_set("i.keywords.display_name", "i.topics.display_name").alias("keywords"), F.lit("").alias("crossref_id"), T.text("i.id").alias("openalex_id"),
    ).where(_in_years(F.col("publication_year"), start, end))
