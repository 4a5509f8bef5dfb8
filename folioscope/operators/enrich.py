"""Filling in missing text: candidates, evidence from attempts, upserts, backfill imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.checkpoints import materialized
from folioscope.functions import text as T
from folioscope.operators.rank import first_by
from folioscope.operators.titles import best_titles, title_ratio

# Which status wins an upsert, sources of formal abstracts, tiers, scopes that aren't research.
STATUS_RANK = {"enriched": 60, "pdf_candidate": 50, "partial_short_text": 40, "not_found": 30, "rate_limited": 20, "error": 20, "skipped_nonresearch_scope": 10}
ABSTRACT_SOURCES = ("crossref", "econpapers", "openalex", "publisher_metadata", "semantic_scholar")
TIER_FORMAL, TIER_FIRST_PAGES = "tier_a_formal_abstract", "tier_c_first_page_abstract_or_intro"
ACCEPTED_TIERS = ("tier_a_formal_abstract", "tier_b_source_description", "tier_c_first_page_abstract_or_intro")
REJECTED_TIERS = ("tier_d_title_only_triage", "tier_e_blocked")
NONRESEARCH = ("review_erratum_paratext", "comment_reply", "lecture_address")


def title_match(left: Column | str, right: Column | str, entities: bool = True) -> Column:
    """Similarity of normalised titles, 0 to 1. Not symmetric: the incoming title goes left."""
    return title_ratio(T.title_key(left, entities), T.title_key(right, entities))


def text_chars(title: Column | str, abstract: Column | str, entities: bool = True) -> Column:
    parts = F.array(T.clean(title, entities), T.strip_boilerplate(abstract, entities))
    return F.length(F.array_join(F.filter(parts, lambda x: x != ""), " "))


def _of(df: DataFrame, name: str, other: str = "") -> Column:
    return T.collapse(T.text(name)) if name in df.columns else F.lit(other)


def candidates(classified: DataFrame, minimum_chars: int = 250, category: str = "insufficient_text", entities: bool = True) -> DataFrame:
    """Rows of the category or with too few characters, with their current counts."""
    chars = F.coalesce(T.number("classification_text_chars"), F.lit(0)) if "classification_text_chars" in classified.columns else text_chars("title", "abstract", entities)
    work = classified.withColumn("current_text_chars", chars.cast("int")).where((F.col("causal_predictive_category") == category) | (F.col("current_text_chars") < minimum_chars))
    return work.withColumn("current_abstract_chars", F.length(T.clean("abstract", entities))).withColumn("has_current_abstract", F.col("current_abstract_chars") > 0)


def filter_candidates(rows: DataFrame, doi_prefixes: list[str] | None = None, journals: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    if doi_prefixes:
        known = T.doi("doi")
        any_prefix = F.lit(False)
        for p in doi_prefixes:
            any_prefix = any_prefix | known.startswith(p.lower())
        rows = rows.where(any_prefix)
    if journals:
        rows = rows.where(F.lower(T.text("journal_short")).isin(*[j.lower() for j in journals]))
    if start is not None:
        rows = rows.where(T.number("publication_year") >= start)
    if end is not None:
        rows = rows.where(T.number("publication_year") <= end)
    return rows


def priority_order(df: DataFrame) -> list[Column]:
    """With DOI, with title, recent, long first; ties by id."""
    year = F.coalesce(T.number("publication_year"), F.lit(0.0)) if "publication_year" in df.columns else F.lit(0.0)
    return [F.desc(T.doi("doi") != ""), F.desc(T.present("title")), F.desc(year), F.desc("current_text_chars"), F.asc("article_id")]


def evidence_tier(df: DataFrame) -> Column:
    """The given tier, else what status, source and detail of an enriched row say."""
    pick = lambda *names: T.first_present(*[n for n in names if n in df.columns]) if any(n in df.columns for n in names) else F.lit("")
    given, status, abstract = pick("evidence_tier"), pick("enrichment_status", "status"), pick("enriched_abstract", "abstract")
    source, detail = pick("enrichment_source", "source"), F.lower(pick("enrichment_detail", "detail"))
    first_pages = (source == "oa_pdf_first_pages") | detail.contains("pdf_text_first_pages") | detail.contains("source_text_type=first_pages")
    return F.when(given != "", given).when((status != "enriched") | (abstract == ""), "").when(first_pages, TIER_FIRST_PAGES).when(source.isin(*ABSTRACT_SOURCES), TIER_FORMAL).otherwise("")


def result_status(status: Column, abstract: Column, pdf_url: Column, chars: Column, minimum_chars: int = 250) -> Column:
    return F.when(status.isin("not_cached", "rate_limited"), status).when((pdf_url != "") & (abstract == ""), "pdf_candidate").when(abstract == "", "not_found").when(chars >= minimum_chars, "enriched").otherwise("partial_short_text")


def first_found(attempts: DataFrame, sources: list[str]) -> DataFrame:
    """One result for each article from an attempts table (article_id, source, status, abstract, oa_pdf_url): the first abstract found in
    the order of sources, unless a source before it was rate limited; with the first PDF link seen up to there.

    All are mins over structs, so nothing is collected by article."""
    order = F.lit(len(sources))
    for i, s in reversed(list(enumerate(sources))):
        order = F.when(F.col("source") == s, i).otherwise(order)
    work = attempts.withColumn("__o", order)
    found = (F.col("status") == "found") & T.present("abstract")
    has_pdf = T.present("oa_pdf_url")
    stop = F.min(F.when(found | (F.col("status") == "rate_limited"), F.struct(F.col("__o").alias("o"), "source", "status", T.text("abstract").alias("abstract"))))
    idle = F.col("status").isin("skipped", "not_cached")
    pdf = F.min(F.when(has_pdf, F.struct(F.col("__o").alias("o"), "oa_pdf_url", "source")))
    out = work.groupBy("article_id").agg(stop.alias("s"), pdf.alias("p"), F.min(idle).alias("idle"), F.max(F.col("status") == "not_cached").alias("nc"), F.count("*").alias("attempts"))
    pdf_ok = F.col("s").isNull() | (F.col("p.o") <= F.col("s.o"))
    use_pdf = pdf_ok & (F.col("s").isNull() | (F.col("s.status") == "found"))
    fallback = F.when(F.col("idle"), F.when(F.col("nc"), "not_cached").otherwise("skipped")).otherwise("not_found")
    return out.select(
        "article_id",
        F.when(F.col("s").isNotNull(), F.col("s.status")).otherwise(fallback).alias("status"),
        F.when(F.col("s").isNotNull(), F.col("s.source")).otherwise(F.coalesce("p.source", F.lit(""))).alias("source"),
        F.when(F.col("s.status") == "found", F.col("s.abstract")).otherwise("").alias("abstract"),
        F.when(use_pdf, F.coalesce("p.oa_pdf_url", F.lit(""))).otherwise("").alias("oa_pdf_url"),
        "attempts",
    )


def apply_enrichment(articles: DataFrame, enrichment: DataFrame, minimum_chars: int = 250, order: list[Column] | None = None, entities: bool = True) -> DataFrame:
    """Articles with better texts where there are some. Of several enrichment rows of an article the first by `order` counts."""
    e = first_by(enrichment, ["article_id"], order or [F.asc("enrichment_status")])
    raw = T.clean(_of(e, "enriched_abstract"), entities)
    cols = {"__status": _of(e, "enrichment_status"), "__source": _of(e, "enrichment_source"), "__url": _of(e, "enrichment_url"), "__record": _of(e, "source_record_id"), "__raw": raw, "__clean": T.strip_boilerplate(raw, entities), "__given": _of(e, "enriched_text_chars"), "__pdf": _of(e, "oa_pdf_url"), "__tier": evidence_tier(e)}
    flags = F.when(_of(e, "enrichment_quality_flags") != "", _of(e, "enrichment_quality_flags")).otherwise(T.quality_flags(raw, entities=entities))
    e = e.select("article_id", *[c.alias(n) for n, c in cols.items()], flags.alias("__flags"), F.lit(True).alias("__has"))
    drop = [c for c in ("causal_predictive_category", "classification_confidence", "classification_reason", "causal_language_indicator", "predictive_language_indicator", "causal_language_terms", "predictive_language_terms", "classification_method", "classification_text_chars", "has_usable_classification_text", "classification_text_quality_flags") if c in articles.columns]
    a = articles.drop(*drop).withColumn("abstract_original", T.text("abstract")).withColumn("abstract_source_original", _of(articles, "abstract_source"))
    work = a.join(e, "article_id", "left").withColumn("__chars", F.when(F.col("__clean") != "", text_chars("title", "__clean", entities)).otherwise(0))
    status = F.when((F.col("__status") == "enriched") & (F.col("__flags") != "") & (F.col("__chars") < minimum_chars), "partial_short_text").otherwise(F.col("__status"))
    work = work.withColumn("text_enrichment_status", F.when(F.col("__has"), status).otherwise("not_needed"))
    good = (F.col("text_enrichment_status") == "enriched") & (F.col("__clean") != "")
    current = text_chars("title", "abstract", entities)
    replace = good & ((F.col("__chars") >= current) | (current < minimum_chars))
    hidden = [c for c in work.columns if c.startswith("__")]
    shown = {
        "text_enrichment_source": F.coalesce("__source", F.lit("")), "text_enrichment_url": F.coalesce("__url", F.lit("")), "text_enrichment_source_record_id": F.coalesce("__record", F.lit("")),
        "text_enrichment_evidence_tier": F.when(good, F.col("__tier")).otherwise(""), "text_enrichment_chars": F.when(F.coalesce("__raw", F.lit("")) != "", F.col("__chars").cast("string")).otherwise(F.coalesce("__given", F.lit(""))),
        "text_enrichment_quality_flags": F.coalesce("__flags", F.lit("")), "oa_pdf_url": F.coalesce("__pdf", F.lit("")),
        "abstract": F.when(replace, F.col("__clean")).otherwise(T.text("abstract")), "abstract_source": F.when(replace, F.concat(F.lit("text_enrichment:"), "__source")).otherwise(_of(articles, "abstract_source")),
    }
    return work.withColumns(shown).drop(*hidden)


def _union_of(*lists: Column) -> Column:
    """Entries of `|`-joined lists in order of first appearance."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), r"\|") for c in lists]))
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")), "|")


def upsert_enrichment(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New state from the old one and new rows, one row an article on either side: the higher status wins and the current one on ties; a
    current skip as non-research always does. The PDF link and attempted sources of the other side are carried over, the scope follows the
    current side. A pure function of both, fit for foreachBatch."""
    names = list(dict.fromkeys([*previous.columns, *current.columns]))
    side = lambda df, p: df.select("article_id", F.struct(*[T.text(c).alias(c) if c in df.columns else F.lit("").alias(c) for c in names]).alias(p))
    both = side(previous, "p").join(side(current, "c"), "article_id", "full")
    rank = lambda s: sum((F.when(F.col(f"{s}.enrichment_status") == k, v).otherwise(0) for k, v in STATUS_RANK.items()), F.lit(0))
    forced = F.col("c.article_scope").isin(*NONRESEARCH) & (F.col("c.enrichment_status") == "skipped_nonresearch_scope") if "article_scope" in names else F.lit(False)
    current_wins = F.col("p").isNull() | (F.col("c").isNotNull() & (forced | (rank("c") >= rank("p"))))
    work = both.withColumn("b", F.when(current_wins, F.col("c")).otherwise(F.col("p"))).withColumn("o", F.when(current_wins, F.col("p")).otherwise(F.col("c")))
    out = {n: F.col(f"b.{n}") for n in names}
    if "oa_pdf_url" in names:
        out["oa_pdf_url"] = T.first_present("b.oa_pdf_url", "o.oa_pdf_url")
    if "article_scope" in names:
        fresh = F.col("p").isNotNull() & T.present("c.article_scope")
        for n in ("article_scope", "article_scope_reason"):
            if n in names:
                out[n] = F.when(fresh, F.col(f"c.{n}")).otherwise(F.col(f"b.{n}"))
    if "attempted_sources" in names:
        other = T.text("o.attempted_sources")
        out["attempted_sources"] = F.when(T.blank("b.attempted_sources") & T.present(other), other).when(T.present(other), _union_of(F.col("b.attempted_sources"), other)).otherwise(F.col("b.attempted_sources"))
    flat = work.select(*[c.alias(n) for n, c in out.items()])
    return flat.withColumn("evidence_tier", evidence_tier(flat))


def append_log(previous: DataFrame, current: DataFrame, stamp: str | None = None) -> DataFrame:
    """Rows of both under the union of their columns, equal rows once; `stamp` names the file that the current ones came from."""
    if stamp is not None:
        current = current.withColumn("import_source_file", F.lit(stamp))
    return previous.unionByName(current, allowMissingColumns=True).na.fill("").distinct()


def merge_document_text(enrichment: DataFrame, documents: DataFrame, minimum_chars: int = 250) -> DataFrame:
    """Extracted document text (article_id, pdf_text, pdf_text_type) as the abstract of rows that aren't enriched yet."""
    d = first_by(documents.where(F.length(T.text("pdf_text")) >= minimum_chars), ["article_id"], [F.desc(F.length("pdf_text")), F.asc("pdf_text")]).select("article_id", "pdf_text", "pdf_text_type")
    take = (F.col("enrichment_status") != "enriched") & F.col("pdf_text").isNotNull()
    source = F.when(F.col("pdf_text_type") == "abstract_section", "oa_pdf").otherwise("oa_pdf_first_pages")
    new = {"enrichment_source": F.when(take, source).otherwise(F.col("enrichment_source")), "enriched_abstract": F.when(take, F.col("pdf_text")).otherwise(F.col("enriched_abstract")), "enrichment_status": F.when(take, "enriched").otherwise(F.col("enrichment_status"))}
    return enrichment.join(d, "article_id", "left").withColumns(new).drop("pdf_text", "pdf_text_type")


# --- backfill imports


def tier_error(c: Column | str) -> Column:
    t = F.trim(T.text(c))
    return F.when(t == "", "missing_evidence_tier").when(t.isin(*REJECTED_TIERS), "unimportable_evidence_tier").when(~t.isin(*ACCEPTED_TIERS), "invalid_evidence_tier").otherwise("")


def source_error(source: Column | str, url: Column | str, record: Column | str, tier: Column | str) -> Column:
    """What a filled row lacks to be imported, empty for nothing."""
    return F.when(T.blank(source), "missing_source").when(T.blank(url) & T.blank(record), "missing_source_locator").otherwise(tier_error(tier))


def completion(abstract: Column | str, source: Column | str, url: Column | str, record: Column | str) -> Column:
    """Whether a row still needs its text, or only where the text is from."""
    named = T.present(source) & (T.present(url) | T.present(record))
    return F.when(T.blank(abstract), "needs_abstract_recovery").when(named, "ready_to_import").otherwise("needs_source_metadata")


def filter_empty(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a value under any of the names, one row with the number of those without)."""
    has = T.first_present(*[n for n in names if n in rows.columns]) != ""
    return rows.where(has), rows.agg(F.count_if(~has).alias("skipped"))


def match_backfill(backfill: DataFrame, articles: DataFrame, minimum: float = 0.9, require_source: bool = False, entities: bool = True, within: list[str] | None = None) -> DataFrame:
    """One row for each backfill row (row_number, article_id, doi, title, publication_year, abstract, source, ...): matched_id, matched_by and error.

    By article id if one is given, else by DOI (must be unique), else by title within the year; rows without a year ask all years. Titles meet by blocks
    of about one length (see titles). In order of row_number the first row of an article whose title fits is taken; later ones
    are duplicates (`within`: among rows of the same keys). Keys and flags of both tables are written once; texts stay where they are."""
    within = within or []
    needs = source_error(_of(backfill, "source"), _of(backfill, "source_url"), _of(backfill, "source_record_id"), _of(backfill, "evidence_tier")) if require_source else F.lit("")
    lacks = F.when(T.blank("abstract"), "missing_abstract").otherwise(needs)
    b = materialized(backfill.select("row_number", *within, _of(backfill, "article_id").alias("__id"), T.doi("doi").alias("__doi"), T.title_key("title", entities).alias("__t"), _of(backfill, "publication_year").alias("__y"), lacks.alias("__lacks")))
    a = materialized(articles.select(F.col("article_id").alias("__aid"), T.doi("doi").alias("__adoi"), T.title_key("title", entities).alias("__at"), T.collapse(T.text("publication_year")).alias("__ay")))
    by_id = a.groupBy(F.col("__aid").alias("__id")).agg(F.min("__at").alias("__t_id"))
    by_doi = a.where("__adoi <> ''").groupBy(F.col("__adoi").alias("__doi")).agg(F.count("*").alias("__n_doi"), F.min("__aid").alias("__m_doi"), F.min("__at").alias("__t_doi"))
    asks = b.where("__id = '' and __doi = '' and __t <> ''").select(F.col("__t").alias("t"), F.col("__y").alias("__y"))
    known = a.select(F.col("__at").alias("t"), F.col("__ay").alias("__y"), F.col("__aid").alias("key"))
    dated = best_titles(asks.where("__y <> ''"), known, minimum, ["__y"])
    undated = best_titles(asks.where("__y = ''"), known, minimum).withColumn("__y", F.lit(""))
    best = dated.unionByName(undated).select(F.col("t").alias("__t"), "__y", F.col("n").alias("__n_best"), F.col("key").alias("__m_title"))
    work = b.join(by_id, "__id", "left").join(by_doi, "__doi", "left").join(best, ["__t", "__y"], "left")
    by = F.when(F.col("__id") != "", F.when(F.col("__t_id").isNotNull(), "article_id").otherwise("unknown_article_id")).when(F.col("__doi") != "", F.when(F.col("__n_doi") == 1, "doi").when(F.col("__n_doi") > 1, "ambiguous_doi").otherwise("unknown_doi")).when(F.col("__t") == "", "missing_title").when(F.col("__n_best") == 1, "title_year").when(F.col("__n_best") > 1, "ambiguous_title").otherwise("no_title_match")
    matched = F.when(by == "article_id", F.col("__id")).when(by == "doi", F.col("__m_doi")).when(by == "title_year", F.col("__m_title"))
    work = work.withColumns({"matched_by": by, "matched_id": matched, "__mt": F.when(by == "article_id", F.col("__t_id")).when(by == "doi", F.col("__t_doi"))})
    early = F.when(F.col("__lacks") != "", F.col("__lacks")).when(F.col("matched_id").isNull(), "unmatched_article").otherwise("")
    asked = (F.col("__t") != "") & F.col("matched_by").isin("article_id", "doi")  # a match by title fits already
    work = work.withColumn("__early", early).withColumn("__s", title_ratio(F.when(asked, F.col("__t")), F.when(asked, F.col("__mt"))))
    work = work.withColumn("__fits", (F.col("__early") == "") & (~asked | (F.col("__s") >= minimum)))
    taken = F.min(F.when(F.col("__fits"), F.col("row_number"))).over(Window.partitionBy("matched_id", F.col("__early") == "", *within))
    error = F.when(F.col("__early") != "", F.col("__early")).when(F.col("row_number") == taken, "").when(taken < F.col("row_number"), "duplicate_backfill_article_id").otherwise("title_mismatch")
    return work.select("row_number", "matched_id", "matched_by", error.alias("error"))
