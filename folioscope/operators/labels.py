"""Labels: validation of values, all-or-nothing upserts, drift, agreement of reviewers, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import CATEGORIES, CONFIDENCE
from folioscope.functions import text as T
from folioscope.operators.rank import first_by
from folioscope.operators.shares import flag

KEY = ["validation_id", "article_id"]
LABEL_COLUMNS = ["manual_label", "manual_confidence", "manual_notes", "reviewer_id", "review_date"]


def errors_of(df: DataFrame, keys: list[str], checks: list[tuple[str, Column, str]]) -> DataFrame:
    """(keys, field, value, error): one row for each check (field, is wrong, error) that a row fails."""
    cases = F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), (T.text(f) if f in df.columns else F.lit("")).alias("value"), F.lit(e).alias("error"))) for f, bad, e in checks])
    return df.select(*keys, F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def _iso(c: str) -> Column:
    return T.text(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr(f"try_to_date({c}, 'yyyy-MM-dd')").isNotNull()


def validate_labels(packet: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Error rows of manual labels: invalid values, missing partners of a label, dates that aren't ISO dates, duplicate and unknown keys."""
    labelled = T.present("manual_label")
    checks = [
        ("manual_label", labelled & ~F.col("manual_label").isin(*CATEGORIES), "invalid_manual_label"),
        ("manual_confidence", T.present("manual_confidence") & ~F.col("manual_confidence").isin(*CONFIDENCE), "invalid_manual_confidence"),
        ("manual_confidence", labelled & T.blank("manual_confidence"), "missing_manual_confidence"),
        ("reviewer_id", labelled & T.blank("reviewer_id"), "missing_reviewer_id"),
        ("review_date", labelled & T.blank("review_date"), "missing_review_date"),
        ("review_date", T.present("review_date") & ~F.coalesce(_iso("review_date"), F.lit(False)), "invalid_review_date"),
        ("validation_id", F.col("__same") > 1, "duplicate_key"),
    ]
    work = packet.withColumn("__same", F.count("*").over(Window.partitionBy(*KEY)))
    if sample is not None:
        work = work.join(sample.select(*KEY).distinct().withColumn("__known", F.lit(True)), KEY, "left")
        checks.append(("validation_id", F.col("__known").isNull(), "unknown_key"))
    return errors_of(work, KEY, checks)


def merge_labels(sample: DataFrame, packet: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """sample with the packet's label columns, if no row of the packet has an error; else as it was."""
    columns = columns or LABEL_COLUMNS
    clean = validate_labels(packet, sample).agg((F.count("*") == 0).alias("__clean"))  # one row
    new = packet.where(T.present("manual_label")).select(*KEY, F.struct(*[T.text(c).alias(c) for c in columns]).alias("__new"))
    work = sample.join(new, KEY, "left").join(F.broadcast(clean), F.lit(True))
    use = F.col("__clean") & F.col("__new").isNotNull()
    return work.withColumns({c: F.when(use, F.col(f"__new.{c}")).otherwise(T.text(c) if c in sample.columns else F.lit("")) for c in columns}).drop("__new", "__clean")


def drift(sample: DataFrame, current: DataFrame, columns: list[str], key: str = "article_id") -> DataFrame:
    """One row for each cell of the sample that the current table has changed; a missing key gives one row.
    Of a key's several current rows the first by the compared values counts."""
    now = first_by(current, [key], [F.asc(c) for c in columns]).select(key, F.struct(*[T.text(c).alias(c) for c in columns]).alias("__now"))
    cells = F.when(F.col("__now").isNull(), F.array(F.struct(F.lit(key).alias("column"), T.text(key).alias("sample_value"), F.lit("").alias("current_value"), F.lit("missing_in_current").alias("issue")))).otherwise(
        F.filter(F.array(*[F.when(T.text(c) != F.col(f"__now.{c}"), F.struct(F.lit(c).alias("column"), T.text(c).alias("sample_value"), F.col(f"__now.{c}").alias("current_value"), F.lit("value_changed").alias("issue"))) for c in columns]), lambda x: x.isNotNull())
    )
    return sample.join(now, key, "left").select(key, F.explode(cells).alias("x")).select(key, "x.*")


def reviewer_agreement(submissions: DataFrame, key: list[str]) -> DataFrame:
    """One row: submitted, comparable, unanimous and disagreeing items and the agreement rate. An item is comparable with two labels or two reviewers."""
    items = _items(submissions, key)
    comparable = (F.col("n") >= 2) | (F.col("reviewers") >= 2)
    same = comparable & (F.col("labels") == 1)
    out = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("completed_labels"), F.count("*").alias("labeled_items"), F.coalesce(F.sum(flag(comparable)), F.lit(0)).alias("comparable_items"), F.coalesce(F.sum(flag(same)), F.lit(0)).alias("unanimous_items"))
    return out.withColumn("disagreeing_items", F.col("comparable_items") - F.col("unanimous_items")).withColumn("agreement_rate", F.when(F.col("comparable_items") > 0, F.round(F.col("unanimous_items") / F.col("comparable_items"), 4)))


def _items(submissions: DataFrame, key: list[str]) -> DataFrame:
    pair = F.concat_ws("=", T.text("reviewer_id"), "manual_label")
    return submissions.where(T.present("manual_label")).groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("reviewer_id").alias("reviewers"), F.count_distinct("manual_label").alias("labels"), F.array_join(F.array_sort(F.collect_set(pair)), "|").alias("reviewer_labels"))


def disagreement_packet(submissions: DataFrame, key: list[str]) -> DataFrame:
    """Items with several labels, with all `reviewer=label` pairs; a group holds one item's reviews."""
    return _items(submissions, key).where("labels > 1 and (n >= 2 or reviewers >= 2)").select(*key, "labels", "reviewer_labels")


def overlap_agreement(sample: DataFrame, overlap: DataFrame) -> DataFrame:
    """One row: second reviews that can be compared with the first label, and how many agree."""
    first = sample.select(*KEY, F.col("manual_label").alias("__first"))
    work = overlap.join(first, KEY, "left")
    both = T.present("manual_label") & T.present("__first")
    same = both & (F.col("manual_label") == F.col("__first"))
    return work.agg(F.count("*").alias("overlap_rows"), F.coalesce(F.sum(flag(T.present("manual_label"))), F.lit(0)).alias("completed_rows"), F.coalesce(F.sum(flag(both)), F.lit(0)).alias("comparable_rows"), F.coalesce(F.sum(flag(same)), F.lit(0)).alias("agreement_rows")).withColumn("agreement_rate", F.when(F.col("comparable_rows") > 0, F.round(F.col("agreement_rows") / F.col("comparable_rows"), 4)))


def completion(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Rows, labelled and missing ones, invalid labels, labels without confidence, reviewers and the latest date."""
    done = T.present("manual_label")
    return df.groupBy(*(groups or [])).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(flag(done)), F.lit(0)).alias("completed_rows"), F.coalesce(F.sum(flag(~done)), F.lit(0)).alias("remaining_rows"),
        F.coalesce(F.sum(flag(done & ~F.col("manual_label").isin(*CATEGORIES))), F.lit(0)).alias("invalid_labels"), F.coalesce(F.sum(flag(done & T.blank("manual_confidence"))), F.lit(0)).alias("missing_confidence"),
        F.count_distinct(F.when(done & T.present("reviewer_id"), F.col("reviewer_id"))).alias("reviewers"), F.coalesce(F.max(F.when(done, T.text("review_date"))), F.lit("")).alias("latest_review_date"),
    )


def as_metrics(one: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), T.text(c).alias("value")) for c in one.columns])).alias("x")).select("x.*")


def gate(checks: DataFrame) -> DataFrame:
    """One row from (ord, check, passed, detail): the overall status and the first check that blocks."""
    return checks.agg(F.when(F.count_if(~F.col("passed")) == 0, "pass").otherwise("blocked").alias("gate_status"), F.coalesce(F.min(F.when(~F.col("passed"), F.struct("ord", "check", "detail")))["check"], F.lit("")).alias("first_blocker"), F.count_if(F.col("passed")).alias("passed_checks"), F.count("*").alias("checks"))
