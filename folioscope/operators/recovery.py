"""Recovery of missing texts: priority queue, lanes, cells, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.classify import resolved
from folioscope.operators.rank import batch_id, global_rank, top_by
from folioscope.operators.shares import flag

# Journals that count more; in recovery_score the points, reasons and actions.
PRIORITY_JOURNALS, SECONDARY_JOURNALS = ("aer", "ecta", "jpe"), ("qje", "restud")


def _value(df: DataFrame, name: str) -> Column:
    return F.trim(T.text(name)) if name in df.columns else F.lit("")


def recovery_score(df: DataFrame, title_category: Column) -> tuple[Column, Column, Column]:
    """(score, action, reasons) of a row with too little text."""
    year = F.floor(T.number("publication_year")).cast("int")
    journal = F.lower(_value(df, "journal_short"))
    doi, work, url, pdf = (_value(df, c) != "" for c in ("doi", "openalex_id", "article_url", "oa_pdf_url"))
    partial = (_value(df, "text_enrichment_status") == "partial_short_text") | (_value(df, "abstract_source") != "")
    suggests = title_category.isin("causal", "predictive")
    points: list[tuple[Column, int, Column | str]] = [
        (year < 1990, 6, "pre_1990_high_missingness"),
        ((year >= 1990) & (year < 2000), 5, "1990s_high_missingness"),
        ((year >= 2000) & (year < 2010), 3, "pre_2010_missingness"),
        (year >= 2010, 1, "recent_missingness"),
        (journal.isin(*PRIORITY_JOURNALS), 3, "priority_journal_cell"),
        (journal.isin(*SECONDARY_JOURNALS), 1, "secondary_journal_cell"),
        (partial, 4, "partial_text_can_be_extended"),
        (~partial, 3, "missing_abstract"),
        (pdf, 5, "oa_pdf_available"),
        (doi, 4, "doi_available"),
        (work, 2, "openalex_id_available"),
        (url, 1, "article_landing_url_available"),
        (suggests, 2, F.concat(F.lit("title_triage_"), title_category)),
    ]
    score = sum((F.when(c, n).otherwise(0) for c, n, _ in points), F.lit(0))
    reasons = F.array_join(F.filter(F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, _, r in points]), lambda x: x.isNotNull()), "|")
    action = F.when(pdf, "review_oa_pdf_or_first_pages").when(partial, "extend_existing_short_abstract").when(doi, "recover_abstract_from_doi_or_publisher").when(work, "review_openalex_or_title_match").when(url, "review_article_landing_page").otherwise("manual_title_year_search")
    return score, action, reasons


def recovery_queue(df: DataFrame, triage: DataFrame | None = None, batch_size: int = 100) -> DataFrame:
    """Rows with too little text, ranked by score and put in batches, with the links a person needs to look them up. What titles suggest stands beside the
    rows (with_title_suggestion), or comes from a triage table, or is empty."""
    rows = df.where(resolved(df) == "insufficient_text")
    found = ["title_only_suggested_category", "title_only_confidence", "title_only_reason"]
    if triage is not None:
        one = triage.groupBy("article_id").agg(F.max(F.struct(*found)).alias("__t"))
        rows = rows.join(one, "article_id", "left").withColumns({c: F.coalesce(F.col(f"__t.{c}"), F.lit("")) for c in found}).drop("__t")
    elif not set(found) <= set(rows.columns):
        rows = rows.withColumns({c: F.lit("") for c in found})
    score, action, reasons = recovery_score(rows, F.col("title_only_suggested_category"))
    work = _value(rows, "openalex_id")
    title = _value(rows, "title")
    wide = rows.select(
        F.when(score >= 16, "high").when(score >= 10, "medium").otherwise("low").alias("recovery_priority"),
        score.cast("int").alias("recovery_priority_score"), action.alias("recovery_action"), reasons.alias("recovery_reason"),
        *[_value(rows, c).alias(c) for c in ("article_id", "journal_short", "publication_year")],
        T.decade("publication_year").alias("decade"),
        *[_value(rows, c).alias(c) for c in ("title", "doi", "openalex_id", "article_url", "oa_pdf_url", "text_enrichment_status", "text_enrichment_source", "abstract_source", "classification_text_chars", *found)],
        T.doi_url(_value(rows, "doi")).alias("doi_url"),
        T.work_url("https://api.crossref.org/works/", _value(rows, "doi")).alias("crossref_work_url"),
        F.when(work == "", "").when(work.startswith("https://openalex.org/"), work).otherwise(F.concat(F.lit("https://openalex.org/"), work)).alias("openalex_work_url"),
        *[T.title_url(u, title).alias(n) for n, u in (("openalex_title_search_url", "https://api.openalex.org/works?per-page=5&search="), ("crossref_title_search_url", "https://api.crossref.org/works?rows=5&query.title="), ("semantic_scholar_title_search_url", "https://www.semanticscholar.org/search?q="))],
        *[F.lit("").alias(c) for c in ("backfill_abstract", "source", "source_url", "source_record_id")],
        F.concat(F.lit("suggested_action="), action, F.lit(";recovery_reason="), reasons).alias("notes"),
    )
    ranked = global_rank(wide, [F.desc("recovery_priority_score"), F.asc("journal_short"), F.asc("publication_year"), F.asc("title"), F.asc("article_id")], "recovery_rank")
    return ranked.withColumn("recovery_batch", batch_id("recovery_rank", batch_size))


# --- target cells (journal by decade)


def target_level(rows: Column, share: Column) -> Column:
    """Rows or share of rows with too little text from which a cell is of a level."""
    return F.when((rows >= 250) | (share >= 0.45), "critical").when((rows >= 100) | (share >= 0.25), "high").when((rows >= 50) | (share >= 0.15), "medium").otherwise("low")


def target_score(rows: Column, share: Column, ready: Column, partial: Column) -> Column:
    """A point a row and a per cent, five for a ready row, one for a partial one, 50 of each at most."""
    return (rows + F.bround(share * 100) + F.least(ready * 5, F.lit(50)) + F.least(partial, F.lit(50))).cast("int")


def recoveries_needed(short: Column, rows: Column, share: float) -> Column:
    """How many of the rows must be recovered for at most this share to be left."""
    return F.when(rows > 0, F.greatest(F.lit(0), short - F.floor(F.lit(share) * rows))).otherwise(0).cast("long")


def projected_share(short: Column, rows: Column, recovered: Column) -> Column:
    return F.when(rows > 0, F.round(F.greatest(short - recovered, F.lit(0)) / rows, 6)).otherwise(F.lit(0.0))


def coverage_ratio(available: Column, needed: Column) -> Column:
    return F.when(needed > 0, F.round(F.least(available / needed, F.lit(1.0)), 4)).otherwise(F.lit(1.0))


def cell_targets(profile: DataFrame, queue: DataFrame, ready: DataFrame, least: int = 25, top: int = 20, share: float = 0.2, stretch: float = 0.1) -> DataFrame:
    """The cells where recoveries matter most: level, score, recoveries to a target and a stretch share, and what is at hand. ready: rows of the
    queue that can be worked on, with review_rank."""
    cell = ["journal_short", "decade"]
    queued = queue.where(T.present("article_id")).groupBy(*cell).agg(F.count("*").alias("queue_rows"), F.min("recovery_rank").alias("first_recovery_rank"))
    at_hand = ready.where(T.present("article_id")).groupBy(*cell).agg(F.count("*").alias("ready_rows"), F.min("review_rank").alias("first_ready_review_rank"))
    work = profile.where(F.col("insufficient_rows") >= least).join(queued, cell, "left").join(at_hand, cell, "left").na.fill(0, ["queue_rows", "ready_rows"])
    short, rows, ready_rows = F.col("insufficient_rows"), F.col("rows"), F.col("ready_rows")
    need = recoveries_needed(short, rows, share)
    out = work.select(
        *cell, F.col("rows").alias("cell_rows"), "insufficient_rows", "insufficient_share", target_level(short, F.col("insufficient_share")).alias("target_level"),
        target_score(short, F.col("insufficient_share"), ready_rows, F.col("partial_short_text_rows")).alias("target_score"),
        need.alias("recoveries_to_target_share"), recoveries_needed(short, rows, stretch).alias("recoveries_to_stretch_share"), projected_share(short, rows, ready_rows).alias("projected_share_after_ready"),
        coverage_ratio(ready_rows, need).alias("ready_target_coverage"), coverage_ratio(F.col("queue_rows"), need).alias("queue_target_coverage"),
        "queue_rows", "ready_rows", "partial_short_text_rows", "missing_abstract_rows", F.col("has_oa_pdf_rows").alias("oa_pdf_rows"), "first_recovery_rank", "first_ready_review_rank",
    )
    order = [F.desc("target_score"), F.desc("insufficient_rows"), F.desc("insufficient_share"), F.asc("journal_short"), F.asc("decade")]
    return global_rank(out.orderBy(*order).limit(top), order, "target_rank")


def cell_queue(targets: DataFrame, queue: DataFrame, per_cell: int) -> DataFrame:
    """The first rows of the queue in each target cell. targets has at most the rows of a top-k report and is broadcast."""
    rows = queue.join(F.broadcast(targets.select("journal_short", "decade", "target_rank", "target_level")), ["journal_short", "decade"])
    return top_by(rows, ["journal_short", "decade"], [F.asc("recovery_rank"), F.asc("article_id")], per_cell).withColumnRenamed("__n", "cell_row")
