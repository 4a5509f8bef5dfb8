"""Scopes of articles: candidates for exclusion, review packets, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import EXCLUDED_SCOPES
from folioscope.functions import text as T
from folioscope.operators.classify import article_scope
from folioscope.operators.labels import errors_of
from folioscope.operators.rank import global_rank, padded_id
from folioscope.operators.shares import flag

DECISIONS = ("exclude_from_research_scope", "keep_as_research", "unsure")


def scope_candidates(datasets: dict[str, DataFrame], type_scopes: dict[str, str], patterns: list[tuple[str, str]], excluded: list[str] | None = None) -> DataFrame:
    """Rows of several datasets whose title or type proposes a scope outside research and that aren't excluded yet."""
    excluded = excluded or EXCLUDED_SCOPES
    out = None
    for name, df in datasets.items():
        scope, reason = article_scope("title", "article_type", type_scopes, patterns)
        now = T.text("article_scope") if "article_scope" in df.columns else F.lit("")
        part = df.select(F.lit(name).alias("dataset"), "article_id", T.text("journal_short").alias("journal_short"), T.text("publication_year").alias("publication_year"), T.decade("publication_year").alias("decade"), T.text("title").alias("title"), now.alias("current_scope"), scope.alias("proposed_scope"), reason.alias("proposed_reason"))
        part = part.where(F.col("proposed_scope").isin(*excluded) & ~F.col("current_scope").isin(*excluded))
        out = part if out is None else out.unionByName(part)
    return out


def pattern_family(reason: Column | str, title: Column | str) -> Column:
    both = F.lower(F.concat_ws(" ", T.text(reason), T.text(title)))
    out = F.lit("other_pattern")
    for family, tokens in reversed([("erratum_correction", "errat|corrig|correction"), ("comment_reply", "comment|reply|rejoinder"), ("lecture_address", "lecture|address|nobel"), ("front_matter", "front matter|back matter|contents|editorial|minutes|report of"), ("book_review", "review")]):
        out = F.when(both.rlike(tokens), family).otherwise(out)
    return out


def candidate_summary(candidates: DataFrame) -> DataFrame:
    family = pattern_family("proposed_reason", "title")
    return candidates.groupBy("dataset", "proposed_scope", family.alias("pattern_family")).agg(F.count("*").alias("rows"), F.count_distinct("article_id").alias("articles"))


def review_packet(candidates: DataFrame, existing: DataFrame | None = None, recent_from: int = 2010) -> DataFrame:
    """One row for each article, what its datasets say joined in order of dataset, earlier decisions kept; recent ones first, numbered."""
    order = "dataset"
    joined = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct(F.col(order), T.text(c).alias("v")))), lambda x: x["v"])), "|").alias(c)  # noqa: E731  one entry a dataset
    rows = candidates.groupBy("article_id").agg(joined("dataset"), joined("current_scope"), joined("proposed_scope"), joined("proposed_reason"), F.min("title").alias("title"), F.min("journal_short").alias("journal_short"), F.min("publication_year").alias("publication_year"))
    kept = ["scope_decision", "reviewer_id", "review_date", "review_notes"]
    if existing is not None:
        rows = rows.join(existing.groupBy("article_id").agg(*[F.max(T.text(c)).alias(c) for c in kept]), "article_id", "left").na.fill("", kept)
    else:
        rows = rows.withColumns({c: F.lit("") for c in kept})
    lane = F.when(T.number("publication_year") >= recent_from, "recent").otherwise("older")
    rows = rows.withColumn("review_lane", lane)
    return global_rank(rows, [F.desc("review_lane"), F.asc("journal_short"), F.desc("publication_year"), F.asc("title"), F.asc("article_id")], "__k").withColumn("scope_review_id", padded_id("SR", "__k", 4)).drop("__k")


def validate_decisions(packet: DataFrame, targets: DataFrame) -> DataFrame:
    """Error rows: missing or duplicate ids, unknown targets, invalid decisions, decisions without scope, reviewer or date."""
    made = T.present("scope_decision")
    known = targets.select("article_id").distinct().withColumn("__known", F.lit(True))
    work = packet.withColumn("__same", F.count("*").over(Window.partitionBy("article_id"))).join(known, "article_id", "left")
    checks = [
        ("article_id", T.blank("article_id"), "missing_article_id"),
        ("article_id", T.present("article_id") & (F.col("__same") > 1), "duplicate_article_id"),
        ("article_id", T.present("article_id") & F.col("__known").isNull(), "unknown_article_id"),
        ("scope_decision", made & ~F.col("scope_decision").isin(*DECISIONS), "invalid_scope_decision"),
        ("proposed_scope", (F.col("scope_decision") == DECISIONS[0]) & T.blank("proposed_scope"), "missing_proposed_scope"),
        ("reviewer_id", made & T.blank("reviewer_id"), "missing_reviewer_id"),
        ("review_date", made & T.blank("review_date"), "missing_review_date"),
    ]
    return errors_of(work, ["article_id"], checks)


def apply_decisions(df: DataFrame, packet: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df with the decided scopes, change log); rows of the packet with errors are skipped. Excluded ones get the proposed scope, kept ones
    `research`, unsure ones keep theirs."""
    bad = errors.select("article_id").distinct()
    good = packet.where(F.col("scope_decision").isin(*DECISIONS)).join(bad, "article_id", "left_anti").select("article_id", F.col("scope_decision").alias("__d"), F.substring_index("proposed_scope", "|", 1).alias("__s"))
    new = F.when(F.col("__d") == DECISIONS[0], F.col("__s")).when(F.col("__d") == DECISIONS[1], "research").otherwise(T.text("article_scope"))
    work = df.join(good, "article_id", "left").withColumn("__new", new)
    log = work.where(F.col("__d").isNotNull()).select("article_id", F.col("__d").alias("scope_decision"), T.text("article_scope").alias("old_scope"), F.col("__new").alias("new_scope"), (T.text("article_scope") != F.col("__new")).alias("changed"))
    return work.withColumn("article_scope", F.when(F.col("__d").isNull(), F.col("article_scope")).otherwise(F.col("__new"))).drop("__d", "__s", "__new"), log


def review_completion(packet: DataFrame) -> DataFrame:
    made = T.present("scope_decision")
    return packet.agg(F.count("*").alias("rows"), F.coalesce(F.sum(flag(made)), F.lit(0)).alias("decided"), *[F.coalesce(F.sum(flag(F.col("scope_decision") == d)), F.lit(0)).alias(d) for d in DECISIONS])
