"""Shares, coverage, sensitivity scenarios and trends. Each scenario report is one pass: rows are exploded into scenarios and
counted once, so all scenarios share one shuffle after the partial counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import CATEGORIES, EXCLUDED_SCOPES, FORMAL_ABSTRACT_TIER, GATE
from folioscope.functions.text import blank, decade, number, present, text
from folioscope.operators.classify import resolved


def rate(part: Column, whole: Column) -> Column:
    """part / whole to six places, 0 for nothing."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("long")


def shares(df: DataFrame, groups: list[str], value: str, count: str = "article_count") -> DataFrame:
    """Count of each value in each group, the group's total, and the share."""
    share = f"{value}_share"
    counted = df.withColumn(value, F.when(text(value) == "", "missing").otherwise(F.col(value))).groupBy(*groups, value).agg(F.count("*").alias(count))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    return counted.withColumn("group_total", F.sum(count).over(whole)).withColumn(share, F.round(F.col(count) / F.col("group_total"), 6))


def category_shares(df: DataFrame, groups: list[str]) -> DataFrame:
    return shares(df.withColumn("category", resolved(df)), groups, "category")


def confidence_distribution(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return shares(df.withColumn("confidence", resolved(df, "confidence")), groups or [], "confidence")


def insufficient_rates(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    out = df.withColumn("__c", resolved(df)).groupBy(*(groups or [])).agg(F.sum(flag(F.col("__c") == "insufficient_text")).alias("insufficient_text_count"), F.count("*").alias("group_total"))
    return out.withColumn("insufficient_text_count", F.coalesce("insufficient_text_count", F.lit(0))).withColumn("insufficient_text_share", rate(F.col("insufficient_text_count"), F.col("group_total")))


def abstract_coverage(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    has = present("abstract") if "abstract" in df.columns else F.lit(False)
    out = df.groupBy(*(groups or [])).agg(F.coalesce(F.sum(flag(has)), F.lit(0)).alias("abstract_count"), F.count("*").alias("group_total"))
    return out.withColumn("abstract_share", rate(F.col("abstract_count"), F.col("group_total")))


def sensitivity_shares(df: DataFrame, groups: list[str], triage: DataFrame | None = None) -> DataFrame:
    """Shares under five treatments of rows with too little text. Suggestions stand beside the rows, or come from a table of them; there a key
    has one, the last by text if there are several."""
    work = df.withColumn("__c", resolved(df))
    if triage is None:
        work = work.withColumn("__s", F.col("title_only_suggested_category"))
    else:
        work = work.join(triage.groupBy("article_id").agg(F.max("title_only_suggested_category").alias("__s")), "article_id", "left")
    short = F.col("__c") == "insufficient_text"

    def one(name: str, category: Column) -> Column:
        return F.struct(F.lit(name).alias("scenario"), category.alias("category"))

    cases = F.array(
        one("baseline", F.col("__c")),
        one("exclude_insufficient_text", F.when(~short, F.col("__c"))),
        one("insufficient_text_as_other", F.when(short, "other").otherwise(F.col("__c"))),
        one("title_triage_non_other", F.when(short & F.col("__s").isin("causal", "predictive"), F.col("__s")).otherwise(F.col("__c"))),
        one("title_triage_all_suggestions", F.when(short & F.col("__s").isin("causal", "predictive", "other"), F.col("__s")).otherwise(F.col("__c"))),
    )
    rows = work.select(*groups, F.explode(F.filter(cases, lambda x: x["category"].isNotNull())).alias("x")).select(*groups, "x.scenario", "x.category")
    return shares(rows, ["scenario", *groups], "category")


TIER_SCENARIOS = ("baseline_current_labels", "formal_abstract_only", "no_recovered_text")


def tier_bucket(df: DataFrame) -> Column:
    tier = F.trim(text("text_enrichment_evidence_tier")) if "text_enrichment_evidence_tier" in df.columns else F.lit("")
    enriched = F.trim(text("text_enrichment_status")) == "enriched" if "text_enrichment_status" in df.columns else F.lit(False)
    return F.when(tier != "", tier).when(enriched, "missing_recovered_text_tier").otherwise("no_recovered_text_tier")


def tier_shares(df: DataFrame) -> DataFrame:
    return category_shares(df.withColumn("evidence_tier", tier_bucket(df)), ["evidence_tier"])


def _tier_cases(df: DataFrame, groups: list[str]) -> DataFrame:
    tier = F.trim(text("text_enrichment_evidence_tier")) if "text_enrichment_evidence_tier" in df.columns else F.lit("")
    demoted = {"baseline_current_labels": F.lit(False), "formal_abstract_only": (tier != "") & (tier != FORMAL_ABSTRACT_TIER), "no_recovered_text": tier != ""}
    cases = F.array(*[F.struct(F.lit(s).alias("scenario"), F.when(d, "insufficient_text").otherwise(F.col("__c")).alias("category"), d.alias("demoted")) for s, d in demoted.items()])
    return df.withColumn("__c", resolved(df)).select(*groups, (tier != "").alias("recovered"), F.explode(cases).alias("x")).select(*groups, "recovered", "x.*")


def tier_sensitivity_shares(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    groups = groups or []
    return shares(_tier_cases(df, groups).select(*groups, "scenario", "category"), ["scenario", *groups], "category")


def tier_sensitivity_summary(df: DataFrame) -> DataFrame:
    counts = [F.sum(flag(F.col("category") == c)).alias(f"{c}_count") for c in CATEGORIES]
    out = _tier_cases(df, []).groupBy("scenario").agg(F.count("*").alias("rows"), F.sum(flag(F.col("recovered"))).alias("rows_with_recovered_text_tier"), F.sum(flag(F.col("demoted"))).alias("rows_demoted_to_insufficient_text"), *counts)
    return out.withColumns({f"{c}_share": rate(F.col(f"{c}_count"), F.col("rows")) for c in CATEGORIES})


def insufficient_profile(df: DataFrame) -> DataFrame:
    """Journal by decade: rows, rows with too little text, and what handles these have. Order: profile_order()."""
    has = {n: present(c) if c in df.columns else F.lit(False) for n, c in (("doi", "doi"), ("openalex", "openalex_id"), ("oa_pdf", "oa_pdf_url"), ("abstract", "abstract"))}
    partial = text("text_enrichment_status") == "partial_short_text" if "text_enrichment_status" in df.columns else F.lit(False)
    short = F.col("__c") == "insufficient_text"
    journal = F.when(text("journal_short") == "", "missing").otherwise(F.col("journal_short")) if "journal_short" in df.columns else F.lit("missing")
    work = df.withColumn("__c", resolved(df)).withColumn("journal_short", journal).withColumn("decade", decade("publication_year"))
    out = work.groupBy("journal_short", "decade").agg(
        F.count("*").alias("rows"),
        F.sum(flag(short)).alias("insufficient_rows"),
        *[F.sum(flag(short & has[n])).alias(f"has_{n}_rows") for n in ("doi", "openalex", "oa_pdf")],
        F.sum(flag(short & ~has["abstract"])).alias("missing_abstract_rows"),
        F.sum(flag(short & partial)).alias("partial_short_text_rows"),
    )
    return out.withColumn("insufficient_share", rate(F.col("insufficient_rows"), F.col("rows")))


def profile_order() -> list[Column]:
    return [F.desc("insufficient_rows"), F.desc("insufficient_share"), F.asc("journal_short"), F.asc("decade")]


def year_window(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows whose year is a number from start to end, both included."""
    return df.where(number("publication_year").between(start, end))


def scope_filter(df: DataFrame, column: str = "article_scope", excluded: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in scope, counts by scope with included flag and reason); all rows where there is no such column or nothing is excluded."""
    excluded = EXCLUDED_SCOPES if excluded is None else excluded
    if column not in df.columns or not excluded:
        return df, df.agg(F.lit("all_rows").alias("scope"), F.count("*").alias("rows"), F.lit(True).alias("included_in_analysis"), F.lit("no_scope_filter_configured_or_available").alias("reason"))
    scope = F.when(text(column) == "", "missing").otherwise(F.col(column))
    out = scope.isin(*excluded)
    summary = df.groupBy(scope.alias("scope")).agg(F.count("*").alias("rows"))
    out_named = F.col("scope").isin(*excluded)
    return df.where(~out), summary.select("scope", "rows", (~out_named).alias("included_in_analysis"), F.when(out_named, "excluded_nonresearch_scope").otherwise("").alias("reason"))


def trend_changes(trend: DataFrame, start: int, end: int, groups: list[str] | None = None) -> DataFrame:
    """Shares of two years side by side, by scenario, groups and category. A category absent in one year has share and count 0
    there and its group's total. One aggregation and one window; no join."""
    groups = groups or []
    year = text("publication_year")
    keys = ["scenario", *groups, "category"]
    at = {"start": year == str(start), "end": year == str(end)}
    picks = [F.max(F.when(c, F.col(v))).alias(f"{side}_{n}") for side, c in at.items() for v, n in (("category_share", "share"), ("article_count", "article_count"), ("group_total", "group_total"))]
    side = trend.where(at["start"] | at["end"]).groupBy(*keys).agg(*picks)
    whole = Window.partitionBy("scenario", *groups)
    out = side.withColumns({f"{s}_group_total": F.coalesce(F.max(f"{s}_group_total").over(whole), F.lit(0)) for s in at})
    out = out.withColumns({f"{s}_{n}": F.coalesce(f"{s}_{n}", F.lit(0)) for s in at for n in ("share", "article_count")})
    return out.select(*keys, F.lit(start).alias("start_year"), F.lit(end).alias("end_year"), "start_share", "end_share", F.round(F.col("end_share") - F.col("start_share"), 6).alias("share_change"), "start_article_count", "end_article_count", "start_group_total", "end_group_total")


def labelled(classified: DataFrame, validation: DataFrame) -> DataFrame:
    """Validation rows with a label (the adjudicated one first) beside the predicted label, confidence and reason."""
    manual = F.col("manual_label")
    if "adjudicated_label" in validation.columns:
        manual = F.when(present("adjudicated_label"), F.col("adjudicated_label")).otherwise(manual)
    rows = validation.withColumn("manual_label", manual).where(present("manual_label"))
    predicted = classified.select("article_id", resolved(classified).alias("predicted_label"), resolved(classified, "confidence").alias("predicted_confidence"), F.col("classification_reason").alias("__reason"))
    out = rows.join(predicted, "article_id", "left")
    reason = F.when(blank("classification_reason"), F.col("__reason")).otherwise(F.col("classification_reason")) if "classification_reason" in rows.columns else F.col("__reason")
    return out.withColumn("classification_reason", reason).drop("__reason").withColumn("agreement", F.coalesce(F.col("manual_label") == F.col("predicted_label"), F.lit(False)))


def confusion(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    return rows.groupBy("manual_label").pivot("predicted_label", labels or CATEGORIES).count().na.fill(0)


def category_metrics(rows: DataFrame) -> DataFrame:
    """True positives, counts, precision, recall and F1 of each label on either side; null where undefined."""
    sides = F.array(F.struct(F.col("manual_label").alias("label"), F.lit(1).alias("m"), F.lit(0).alias("p")), F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("m"), F.lit(1).alias("p")))
    hit = F.when(F.col("x.m") == 1, F.col("agreement").cast("long")).otherwise(0)
    out = rows.select("agreement", F.explode(sides).alias("x")).where("x.label <> ''").groupBy(F.col("x.label").alias("label")).agg(F.sum(hit).alias("true_positive"), F.sum("x.p").alias("predicted_count"), F.sum("x.m").alias("manual_count"))
    out = out.withColumn("precision", F.when(F.col("predicted_count") > 0, F.round(F.col("true_positive") / F.col("predicted_count"), 6))).withColumn("recall", F.when(F.col("manual_count") > 0, F.round(F.col("true_positive") / F.col("manual_count"), 6)))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 6)))


def agreement_summary(rows: DataFrame) -> DataFrame:
    high = F.col("predicted_confidence") == "high"
    yes = F.col("agreement").cast("double")
    return rows.agg(
        F.when(F.count("*") > 0, "available").otherwise("unavailable").alias("validation_status"),
        F.count("*").alias("labeled_count"),
        F.round(F.avg(yes), 6).alias("agreement_rate"),
        F.coalesce(F.sum(flag(high)), F.lit(0)).alias("high_confidence_labeled_count"),
        F.round(F.avg(F.when(high, yes)), 6).alias("high_confidence_agreement_rate"),
    )


def disagreements(rows: DataFrame) -> DataFrame:
    """Rows on which label and prediction differ, with empty adjudication columns."""
    given = ["validation_id", "article_id", "journal_short", "publication_year", "title", "manual_label", "manual_confidence", "predicted_label", "predicted_confidence", "classification_reason", "manual_notes", "adjudicated_label", "adjudication_notes", "adjudicator_id", "adjudication_date"]
    return rows.where(~F.col("agreement")).select(*[text(c).alias(c) if c in rows.columns else F.lit("").alias(c) for c in given])


def expansion_gate(classified: DataFrame, agreement: DataFrame | None, limits: dict | None = None) -> DataFrame:
    """One row: decision, reasons and the shares that were compared with the limits."""
    limits = limits or GATE
    by_journal = classified.withColumn("__c", resolved(classified)).groupBy("journal_short").agg(F.count("*").alias("n"), F.sum(flag(present("abstract"))).alias("a"), F.sum(flag(F.col("__c") == "insufficient_text")).alias("i"))
    one = by_journal.agg(rate(F.sum("a"), F.sum("n")).alias("overall_abstract_share"), F.coalesce(F.min(rate(F.col("a"), F.col("n"))), F.lit(0.0)).alias("min_journal_abstract_share"), rate(F.sum("i"), F.sum("n")).alias("insufficient_text_share"))
    if agreement is None:
        one = one.withColumns({"validation_status": F.lit("unavailable"), "high_confidence_agreement_rate": F.lit(None).cast("double")})
    else:
        one = one.join(F.broadcast(agreement.select("validation_status", "high_confidence_agreement_rate")), F.lit(True))  # one row each
    coverage = F.col("overall_abstract_share") < limits["abstract_share"]
    journal = F.col("min_journal_abstract_share") < limits["journal_abstract_share"]
    short = F.col("insufficient_text_share") > limits["insufficient_share"]
    missing = F.col("validation_status") != "available"
    weak = F.coalesce(F.col("high_confidence_agreement_rate") < limits["high_confidence_agreement"], F.lit(False))
    names = F.array(F.when(coverage, "overall_abstract_coverage"), F.when(journal, "journal_abstract_coverage"), F.when(short, "insufficient_text_share"), F.when(missing, "no_validation_labels"), F.when(weak, "high_confidence_agreement"))
    decision = F.when(coverage | journal | short, "pause_for_metadata_enrichment").when(missing, "pause_for_manual_validation").when(weak, "pause_for_classifier_revision").otherwise("proceed")
    return one.select(decision.alias("recommendation"), F.array_join(F.filter(names, lambda x: x.isNotNull()), "|").alias("reasons"), "overall_abstract_share", "min_journal_abstract_share", "insufficient_text_share")
