"""Whether labelling and the outputs after it may go on: readiness of a sample and the validation gate, as (metric, value) and checks from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

# The checks in order.
CHECKS = ["sample_readiness", "calibration", "manual_validation", "overlap_review", "adjudication", "classification_recommendation"]


def counted(df: DataFrame, metrics: dict[str, Column], by_value: dict[str, str] | None = None) -> DataFrame:
    """(metric, value): how many rows have each condition, and how many each value of the columns in by_value (prefix: column), from one pass over df: each row
    goes to its metrics, which are added up before the shuffle. A condition that no row has counts 0."""
    one = lambda name, hit: F.struct(name.alias("metric"), hit.cast("long").alias("n"))
    parts = [one(F.lit(m), c.cast("int")) for m, c in metrics.items()] + [one(F.concat(F.lit(p), T.text(c)), F.lit(1)) for p, c in (by_value or {}).items()]
    found = df.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.metric").agg(F.sum("x.n").alias("n"))
    zeros = df.sparkSession.createDataFrame([(m, 0) for m in metrics], "metric string, n long") if metrics else found.limit(0)
    return found.unionByName(zeros).groupBy("metric").agg(F.sum("n").cast("string").alias("value"))


def readiness(sample: DataFrame, drift: DataFrame, batches: DataFrame) -> DataFrame:
    """(metric, value): rows, labels, drifted articles and cells, rows of each validation category and scope, reviewer batches (batch_id, completed_manual_labels,
    remaining_manual_labels) and the first that isn't complete, and whether blind review can begin: with a sample that hasn't drifted."""
    done = T.present("manual_label")
    conditions = {"sample_rows": F.lit(True), "completed_manual_labels": done, "remaining_manual_labels": ~done}
    if "abstract" in sample.columns:
        conditions["sample_missing_abstract_rows"] = T.blank("abstract")
    listed = {p: c for p, c in (("sample_validation_category_", "validation_category"), ("sample_article_scope_", "article_scope")) if c in sample.columns}
    of_sample = counted(sample, conditions, listed)
    d = drift.agg(F.count("*").alias("drifted_cells"), F.count_distinct("article_id").alias("drifted_articles"))
    left, filled = (F.coalesce(T.number(f"{x}_manual_labels"), F.lit(0.0)) for x in ("remaining", "completed"))
    b = batches.agg(F.count("*").alias("reviewer_batches"), F.count_if(left == 0).alias("completed_reviewer_batches"), F.count_if(filled > 0).alias("started_reviewer_batches"), F.coalesce(F.min(F.when(left > 0, T.text("batch_id"))), F.lit("")).alias("next_incomplete_batch"))
    some = sample.limit(1).agg((F.count("*") > 0).alias("some"))
    one = d.join(F.broadcast(b), F.lit(True)).join(F.broadcast(some), F.lit(True))  # one row each
    rest = {c: F.col(c).cast("string") for c in ("drifted_articles", "drifted_cells", "reviewer_batches", "completed_reviewer_batches", "started_reviewer_batches", "next_incomplete_batch")}
    rest["ready_for_blind_review"] = F.when(F.col("some") & (F.col("drifted_articles") == 0), "yes").otherwise("no")
    return of_sample.unionByName(one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rest.items()]))))


def _row(metrics: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """One row with the values of some metrics as <prefix>_<name>, null where a metric isn't there or blank, and <prefix>_some: whether there is any metric."""
    value = lambda n: F.min(F.when((F.col("metric") == n) & T.present("value"), T.collapse(T.text("value")))).alias(f"{prefix}_{n}")
    return metrics.agg((F.count("*") > 0).alias(f"{prefix}_some"), *[value(n) for n in names])


def validation_checks(readiness: DataFrame, completion: DataFrame, calibration: DataFrame, overlap: DataFrame, adjudications: DataFrame, recommendation: DataFrame) -> DataFrame:
    """The six checks (ord, check, status, observed), from metric tables, the rows to adjudicate (adjudicated_label) and the recommendation. status is `pass`, `block`
    or, where there is nothing to review or adjudicate, `not_applicable`."""
    parts = [
        _row(readiness, ["ready_for_blind_review", "drifted_articles", "sample_rows", "completed_manual_labels", "remaining_manual_labels"], "r"), _row(completion, ["total_rows", "completed_manual_labels", "remaining_manual_labels"], "m"),
        _row(calibration, ["calibration_rows", "completed_calibration_labels", "completed_calibration_rows"], "c"), _row(overlap, ["overlap_rows", "completed_overlap_labels"], "o"),
        adjudications.agg(F.count("*").alias("a_rows"), F.count_if(T.present("adjudicated_label")).alias("a_done")), recommendation.agg(F.min(F.nullif(T.collapse(T.text("recommendation")), F.lit(""))).alias("recommended")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(F.broadcast(p), F.lit(True))  # one row each
    number = lambda *names, other=0: F.coalesce(*[T.number(n).cast("long") for n in names], F.lit(other) if isinstance(other, int) else other)
    ready, drifted = F.coalesce("r_ready_for_blind_review", F.lit("no")), number("r_drifted_articles")
    rows, labels = number("c_calibration_rows"), number("c_completed_calibration_labels")
    full = number("c_completed_calibration_rows", other=labels)
    total, done = number("m_total_rows", "r_sample_rows"), number("m_completed_manual_labels", "r_completed_manual_labels")
    left = number("m_remaining_manual_labels", "r_remaining_manual_labels", other=F.greatest(total - done, F.lit(0)))
    twice, both = number("o_overlap_rows"), number("o_completed_overlap_labels")
    recommended = F.coalesce("recommended", F.lit("missing"))
    say = lambda **x: F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in x.items()])
    passes = lambda c: F.when(c, "pass").otherwise("block")
    made = [
        (passes(F.col("r_some") & (ready == "yes") & (drifted == 0)), say(ready_for_blind_review=ready, drifted_articles=drifted)),
        (passes(F.col("c_some") & (rows > 0) & (full >= rows)), say(completed_calibration_rows=full, completed_calibration_labels=labels, calibration_rows=rows)),
        (passes((total > 0) & (done >= total) & (left == 0)), say(completed_manual_labels=done, total_rows=total, remaining_manual_labels=left)),
        (F.when(~F.col("o_some"), "block").when(twice <= 0, "not_applicable").otherwise(passes(both >= twice)), say(completed_overlap_labels=both, overlap_rows=twice)),
        (F.when(F.col("a_rows") == 0, "not_applicable").otherwise(passes(F.col("a_done") >= F.col("a_rows"))), say(completed_adjudications=F.col("a_done"), pending_adjudication_rows=F.col("a_rows"))),
        (passes(recommended == "proceed"), say(recommendation=recommended)),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("check"), s.alias("status"), o.alias("observed")) for i, (n, (s, o)) in enumerate(zip(CHECKS, made, strict=True))])))


def gate(checks: DataFrame) -> DataFrame:
    """One row from checks: validation_gate (`proceed`, or `blocked_` and the first check that blocks), first_blocking_check, blocking_checks."""
    blocks = F.col("status") == "block"
    first = F.min_by("check", F.when(blocks, F.col("ord")))
    return checks.agg(F.when(first.isNull(), "proceed").otherwise(F.concat(F.lit("blocked_"), first)).alias("validation_gate"), F.coalesce(first, F.lit("")).alias("first_blocking_check"), F.count_if(blocks).alias("blocking_checks"))
