"""Reproducible stratified samples: order by a keyed hash, so the result depends on neither partitions nor row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.classify import resolved
from folioscope.operators.rank import first_by, global_rank, padded_id, top_by


def draw(seed: int | str, key: str = "article_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), T.text(key)).cast("binary"))


def with_strata(df: DataFrame) -> DataFrame:
    causal, predictive = (F.coalesce(T.number(f"{f}_language_indicator"), F.lit(0.0)) for f in ("causal", "predictive"))
    confidence = resolved(df, "confidence")
    work = df.withColumns({
        "stratum_category": resolved(df), "stratum_confidence": confidence, "stratum_has_abstract": F.when(T.present("abstract"), "yes").otherwise("no"), "stratum_decade": T.decade("publication_year"),
        "stratum_causal": T.score_bin(causal), "stratum_predictive": T.score_bin(predictive), "is_ambiguous": ((causal > 0) & (predictive > 0)) | (confidence == "low"),
    })
    return work.withColumn("stratum", F.concat_ws("|", "stratum_category", "stratum_confidence", "stratum_has_abstract", "stratum_decade", "stratum_causal", "stratum_predictive"))


def _top(df: DataFrame, n: int, part: int) -> DataFrame:
    return df.orderBy("__d", "article_id").limit(n).withColumn("__part", F.lit(part))


def _settle(parts: list[DataFrame], fill: DataFrame, size: int) -> DataFrame:
    """The parts in order, each article once, filled up by draw order, cut to size."""
    pool = fill.orderBy("__d", "article_id").limit(size).withColumn("__part", F.lit(9))
    out = pool
    for p in parts:
        out = out.unionByName(p)
    once = first_by(out, ["article_id"], [F.asc("__part"), F.asc("__d")])
    return once.orderBy("__part", "__d", "article_id").limit(size)


def sample_rows(df: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """`size` rows: at most a fifth with too little text, at most 35 % ambiguous, one for each journal, decade and category, then others."""
    work = first_by(with_strata(df).withColumn("__d", draw(seed)), ["article_id"], [F.asc("__d")])
    short = F.col("stratum_category") == "insufficient_text"
    enough = work.where(~short)
    cells = top_by(enough, ["journal_short", "stratum_decade", "stratum_category"], [F.asc("__d"), F.asc("article_id")], 1).drop("__n")
    parts = [_top(work.where(short), size // 5, 0), _top(enough.where("is_ambiguous"), size * 35 // 100, 1), _top(cells, size, 2)]
    return _settle(parts, enough, size).drop("__d", "__part")


def calibration_packet(sample: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """size / 4 rows of each category and size / 4 ambiguous ones, each once, with calibration ids."""
    work = sample.withColumn("__d", draw(f"calibration-{seed}"))
    each = top_by(work, ["stratum_category"], [F.asc("__d"), F.asc("article_id")], max(1, size // 4)).drop("__n").withColumn("__part", F.lit(0))
    picked = _settle([each, _top(work.where("is_ambiguous"), max(1, size // 4), 1)], work, size).drop("__part")
    return global_rank(picked, [F.asc("__d"), F.asc("article_id")], "__k").withColumn("calibration_id", padded_id("CAL", "__k", 3)).drop("__k", "__d")


def overlap_packet(sample: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Rows for a second review: some of each category, then others."""
    work = sample.withColumn("__d", draw(f"overlap-{seed}"))
    each = top_by(work, ["stratum_category"], [F.asc("__d"), F.asc("article_id")], max(1, size // 8)).drop("__n").withColumn("__part", F.lit(0))
    return _settle([each], work, size).drop("__part", "__d")


BLIND = ["validation_id", "batch_id", "article_id", "journal_short", "publication_year", "title", "abstract", "manual_label", "manual_confidence", "manual_notes", "reviewer_id", "review_date"]
AUDIT = [*BLIND, "causal_predictive_category", "classification_confidence", "classification_reason", "stratum"]


def reviewer_packet(sample: DataFrame, mode: str = "blind") -> DataFrame:
    """Columns for reviewers; a blind packet has no predictions."""
    return sample.select(*[T.text(c).alias(c) if c in sample.columns else F.lit("").alias(c) for c in (BLIND if mode == "blind" else AUDIT)])


def label_template(sample: DataFrame, seed: int = 1, batch: int = 25) -> DataFrame:
    """A drawn sample (a bounded packet) numbered VAL0001... in draw order and put in batches B001..."""
    out = global_rank(sample.withColumn("__d", draw(seed)), [F.asc("__d"), F.asc("article_id")], "__k")
    at = ((F.col("__k") - 1) / batch).cast("long") + 1
    return out.withColumn("validation_id", padded_id("VAL", "__k", 4)).withColumn("batch_id", padded_id("B", at, 3)).drop("__d", "__k")
