"""Record linkage: source records of one work become one article, with where each field came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.config import SOURCE_PRIORITY
from folioscope.functions.text import article_id, collapse, link_key, present, text, title_key
from folioscope.operators.shares import flag

BIBLIOGRAPHIC = ["title", "publication_year", "publication_date", "doi", "volume", "issue", "first_page", "last_page", "pages_raw", "article_type", "article_url", "journal_short"]
IDS = ["jel_codes", "field_jel_primary", "field_jel_broad", "openalex_id", "crossref_id", "jstor_id", "repec_handle", "publisher_record_id"]
FIELD_PRIORITY = (
    {f: SOURCE_PRIORITY["bibliographic"] for f in (*BIBLIOGRAPHIC, *IDS)}
    | {"abstract": SOURCE_PRIORITY["abstract"], "author_affiliations_raw": SOURCE_PRIORITY["affiliations"], "keywords": SOURCE_PRIORITY["keywords"]}
    | {f: SOURCE_PRIORITY["authors"] for f in ("authors_raw", "author_names", "num_authors")}
)
#: Output name of each field's source.
PROVENANCE = {"article_type": "article_type_source", "title": "title_source", "abstract": "abstract_source", "doi": "doi_source", "author_names": "authors_source", "author_affiliations_raw": "affiliations_source", "jel_codes": "jel_source", "keywords": "keywords_source", "field_jel_primary": "field_source"}
#: Fields whose values shouldn't differ within a work.
CHECKED = ["doi", "title", "publication_year", "volume", "issue", "article_type"]


def _best(field: str, order: Column) -> Column:
    """min over (priority of the source, record order, value, source) of the records that have the field: combines before the shuffle."""
    rank = F.lit(len(FIELD_PRIORITY[field]))
    for i, source in reversed(list(enumerate(FIELD_PRIORITY[field]))):
        rank = F.when(F.col("source") == source, i).otherwise(rank)
    return F.min(F.when(present(field), F.struct(rank.alias("rank"), order.alias("ord"), text(field).alias("value"), text("source").alias("source")))).alias(field)


def _normal(field: str, entities: bool) -> Column:
    value = F.lower(collapse(text(field)))
    if field == "title":
        value = title_key(field, entities)
    if field == "article_type":
        value = F.when(value.isin("article", "journal-article"), "article").otherwise(value)
    return F.when(present(field), value)


def link_articles(records: DataFrame, order: list[str], journals: DataFrame | None = None, prefix: str = "art_", entities: bool = True) -> DataFrame:
    """One article for each link key of source records. `order`: columns that order records; sources are named crossref and openalex.

    Each field's value is a min over structs, so a hot key (all records without DOI and title, say) is combined before it is
    shuffled and no group is collected."""
    rule, key = link_key("doi", "journal_short", "publication_year", "title", entities)
    fields = [f for f in FIELD_PRIORITY if f in records.columns]
    at = F.struct(*[F.col(c) for c in order])
    work = records.withColumns({"__rule": rule, "__key": key} | {f"__n_{f}": _normal(f, entities) for f in CHECKED if f in records.columns})
    differ = [f for f in CHECKED if f in records.columns]
    grouped = work.groupBy("__rule", "__key").agg(
        *[_best(f, at) for f in fields],
        F.count("*").alias("source_record_count"),
        F.max(F.col("source") == "crossref").alias("__crossref"),
        F.min(F.struct(at.alias("ord"), text("source").alias("source"))).alias("__first"),
        *[(F.min(f"__n_{f}") != F.max(f"__n_{f}")).alias(f"__differ_{f}") for f in differ],
    )
    value = {f: F.coalesce(F.col(f"{f}.value"), F.lit("")) for f in fields}
    source = {f: F.coalesce(F.col(f"{f}.source"), F.lit("")) for f in fields}

    def lacks(field: str) -> Column:
        return value.get(field, F.lit("")) == ""

    kind = value.get("article_type", F.lit(""))
    warnings = [
        *[F.when(F.coalesce(F.col(f"__differ_{f}"), F.lit(False)), f"conflicting_{f}") for f in differ],
        *[F.when(lacks(f), f"missing_{f}") for f in ("abstract", "doi", "article_type", "jel_codes")],
        F.when((kind != "") & ~kind.isin("article", "journal-article"), "nonstandard_article_type"),
    ]
    out = grouped.select(
        article_id(value["doi"], value["journal_short"], value["publication_year"], value["title"], prefix, entities).alias("article_id"),
        *[value[f].alias(f) for f in fields if f != "publication_year"],
        value["publication_year"].try_cast("double").try_cast("int").alias("publication_year"),
        *[source[f].alias(n) for f, n in PROVENANCE.items() if f in fields],
        F.coalesce(*[F.when(source[f] != "", source[f]) for f in ("volume", "publication_year") if f in fields], F.lit("")).alias("bibliographic_source"),
        F.when(F.col("__crossref"), "crossref").otherwise(F.col("__first.source")).alias("primary_source"),
        "source_record_count",
        F.col("__rule").alias("duplicate_resolution_rule"),
        F.array_join(F.array_sort(F.filter(F.array(*warnings), lambda x: x.isNotNull())), ";").alias("metadata_warning"),
    )
    if journals is not None:  # a lookup of journal names: journal_short, journal
        out = out.join(journals.groupBy("journal_short").agg(F.min("journal").alias("journal")), "journal_short", "left")
    return out


def source_overlap(records: DataFrame, entities: bool = True) -> DataFrame:
    """Each link key with its sources (sorted, joined by `|`) and record count."""
    rule, key = link_key("doi", "journal_short", "publication_year", "title", entities)
    return records.groupBy(rule.alias("rule"), key.alias("link_key")).agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.count("*").alias("record_count"))


def duplicate_dois(records: DataFrame) -> DataFrame:
    """DOIs with more than one record within a source and journal."""
    return records.where(present("doi")).groupBy("source", "journal_short", F.lower(F.trim("doi")).alias("doi")).agg(F.count("*").alias("record_count")).where("record_count > 1")


COVERAGE_FIELDS = ["title", "publication_year", "doi", "abstract", "authors_raw", "author_affiliations_raw", "keywords", "jel_codes", "volume", "issue", "pages_raw"]


def _filled(c: str) -> Column:
    """Not blank, and no empty list or object."""
    return present(c) & ~collapse(text(c)).isin("[]", "{}")


def coverage_by_source(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    fields = [f for f in fields or COVERAGE_FIELDS if f in records.columns]
    return records.groupBy("source", "journal_short", "publication_year").agg(F.count("*").alias("record_count"), *[F.round(F.avg(_filled(f).cast("double")), 4).alias(f"{f}_share") for f in fields])


def missingness(articles: DataFrame) -> DataFrame:
    """Missing count and share of each column, one row a column."""
    one = articles.agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(flag(~_filled(c))), F.lit(0)).alias(c) for c in articles.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing_count")) for c in articles.columns])
    return one.select("__n", F.explode(rows).alias("x")).select("x.variable", "x.missing_count", F.round(F.col("x.missing_count") / F.greatest(F.col("__n"), F.lit(1)), 4).alias("missing_share"))


def article_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("journal_short", "publication_year").agg(F.count("*").alias("article_count"))


def source_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("record_count"))
