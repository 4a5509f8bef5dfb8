"""Summaries of an attempts table: one row for each article and source that was tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.checkpoints import materialized
from folioscope.functions import text as T
from folioscope.operators.rank import first_by, top_by
from folioscope.operators.shares import flag

# Statuses of attempts; those that count as failed.
STATUSES = ["found", "error", "not_found", "skipped", "not_cached", "rate_limited"]
FAILED = STATUSES[1:]


def top_values(df: DataFrame, keys: list[str], value: str, n: int, name: str, max_chars: int = 140, rows: Column | None = None) -> DataFrame:
    """The n most frequent values of each key as `value (count)`, joined by `; `: whole values are counted before anything is gathered, long ones
    cut for display. Ties by value. rows: how many rows one of df stands for."""
    counted = df.where(T.present(value)).groupBy(*keys, T.collapse(T.text(value)).alias("__v")).agg((F.count("*") if rows is None else F.sum(rows)).alias("__c"))
    best = top_by(counted, keys, [F.desc("__c"), F.asc("__v")], n)
    shown = F.when(F.length("__v") > max_chars, F.concat(F.rtrim(F.substring("__v", 1, max_chars - 3)), F.lit("..."))).otherwise(F.col("__v"))
    listed = F.array_sort(F.collect_list(F.struct("__n", F.concat(shown, F.lit(" ("), "__c", F.lit(")")).alias("s"))))  # n entries a key
    return best.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "; ").alias(name))


def _prepared(counted: DataFrame, rows: str) -> DataFrame:
    """Counted attempts with the prefix of their DOI, where there is one. The condition names the count, so that Spark doesn't ask it of every attempt."""
    return counted.withColumn("doi_prefix", T.doi_prefix_family("doi")).where(F.when(F.col(rows) > 0, F.col("doi_prefix")) != "")


def _articles(found: bool) -> Column:
    named = F.when(T.present("article_id"), F.col("article_id"))
    return F.count_distinct(F.when(F.col("found_attempts") > 0, named) if found else named)


def _counted(attempts: DataFrame) -> DataFrame:
    """The attempts of each DOI, article and source in one row with its prefix: how many, and by status. What is asked of a DOI or an article is
    worked out for these rows, not for every attempt."""
    status = F.coalesce("attempt_status", F.lit(""))
    by_status = [F.sum(flag(status == s)).alias(f"{s}_attempts") for s in STATUSES]
    return _prepared(attempts.groupBy("doi", "article_id", "attempt_source").agg(F.count("*").alias("attempt_rows"), *by_status, F.sum(flag(~status.isin(*STATUSES))).alias("other_attempts")), "attempt_rows")


def counted_attempts(attempts: DataFrame) -> DataFrame:
    """The counts that by_prefix_source() and by_prefix() are made of, written once for both."""
    return materialized(_counted(attempts))


def by_prefix_source(attempts: DataFrame, known: DataFrame | None = None, errors: bool = True) -> DataFrame:
    """DOI prefix by source: attempts, articles, articles found, attempts by status, the two most frequent errors (errors=False leaves these out). known: their counted_attempts()."""
    keys = ["doi_prefix", "attempt_source"]
    summed = [F.sum(c).alias(c) for c in (*[f"{s}_attempts" for s in STATUSES], "other_attempts")]
    counts = (_counted(attempts) if known is None else known).groupBy(*keys).agg(F.sum("attempt_rows").alias("attempt_rows"), _articles(False).alias("attempted_articles"), _articles(True).alias("found_articles"), *summed)
    if not errors:
        return counts
    failed = _prepared(attempts.where("attempt_status = 'error'").groupBy("doi", "attempt_source", "attempt_error").agg(F.count("*").alias("__rows")), "__rows")
    return counts.join(top_values(failed, keys, "attempt_error", 2, "top_errors", 80, F.col("__rows")), keys, "left").na.fill("", ["top_errors"])


def by_prefix(attempts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What prior attempts gave for each DOI prefix. known: their counted_attempts()."""
    failed = [F.sum(f"{s}_attempts").alias(f"prior_{s}_attempts") for s in FAILED]
    return (_counted(attempts) if known is None else known).groupBy("doi_prefix").agg(_articles(False).alias("prior_attempted_articles"), _articles(True).alias("prior_found_articles"), *failed)


def source_context(summary: DataFrame) -> DataFrame:
    """Of each prefix the source that found most articles (then most attempts found, most attempts, by name) and the one that failed most often."""
    failed = sum((F.col(f"{s}_attempts") for s in FAILED), F.lit(0))
    work = materialized(summary.withColumn("__failed", failed))  # few rows, read twice
    best = first_by(work, ["doi_prefix"], [F.desc("found_articles"), F.desc("found_attempts"), F.desc("attempt_rows"), F.asc("attempt_source")]).select("doi_prefix", F.col("attempt_source").alias("best_prior_source"), F.col("found_articles").alias("best_prior_source_found_articles"))
    worst = first_by(work, ["doi_prefix"], [F.desc("__failed"), F.desc("attempt_rows"), F.asc("attempt_source")]).select("doi_prefix", F.col("attempt_source").alias("top_failure_source"), F.col("__failed").alias("top_failure_attempts"))
    return best.join(worst, "doi_prefix")


def sample_attempts(attempts: DataFrame, per_group: int, order: list[Column]) -> DataFrame:
    """Equal attempts once, then the first rows of each source and status."""
    keys = ["article_id", "attempt_source", "attempt_status", "attempt_error", "attempt_url"]
    keys = [k for k in keys if k in attempts.columns]
    return top_by(first_by(attempts, keys, order), ["attempt_source", "attempt_status"], order, per_group).withColumnRenamed("__n", "sample_row")


def article_context(attempts: DataFrame, order: str) -> DataFrame:
    """Of each article `source:status` of its attempts, in order, each once. An article has a few attempts; a hot one is cut down to its
    distinct pairs before it is gathered."""
    pair = F.concat_ws(":", "attempt_source", "attempt_status")
    once = attempts.groupBy("article_id", pair.alias("p")).agg(F.min(order).alias("o"))
    return once.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda x: x["p"]), "|").alias("attempt_context"), F.count("*").alias("attempt_kinds"))


def url_candidates(packet: DataFrame, unit: str, columns: list[str], per_unit: int) -> DataFrame:
    """The first distinct URLs of each unit over several URL columns, in row and column order (`row_number`)."""
    urls = packet.select(unit, "row_number", F.posexplode(F.array(*[T.text(c) for c in columns])).alias("c", "url")).where(T.present("url"))
    first = urls.groupBy(unit, "url").agg(F.min(F.struct("row_number", "c")).alias("at"))
    return top_by(first, [unit], [F.asc("at"), F.asc("url")], per_unit).select(unit, "url", F.col("__n").alias("probe_row"))


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before left join after (article_id, journal_short, decade, category, chars): with recovered and newly insufficient flags. Of an article's several rows on a
    side the first by its values counts."""
    one = lambda df: first_by(df, ["article_id"], [F.asc(c) for c in df.columns if c != "article_id"])
    b = one(before).withColumnsRenamed({"category": "before_category", "chars": "before_chars"})
    a = one(after.select("article_id", "category", "chars")).select("article_id", F.col("category").alias("after_category"), F.col("chars").alias("after_chars"))
    short = lambda c: F.coalesce(F.col(c) == "insufficient_text", F.lit(False))
    out = b.join(a, "article_id", "left").withColumn("after_category", F.coalesce("after_category", "before_category")).withColumn("after_chars", F.coalesce("after_chars", "before_chars"))
    return out.withColumn("recovered", short("before_category") & ~short("after_category")).withColumn("newly_insufficient", ~short("before_category") & short("after_category"))


def impact_summary(rows: DataFrame, groupings: list[str]) -> DataFrame:
    """Totals overall and by each grouping column, one pass by grouping sets; medians are cut to whole numbers."""
    columns = [F.col(g) for g in groupings]
    sets = rows.groupingSets([[], *[[c] for c in columns]], *columns)
    name, value = F.lit("overall"), F.lit("all")
    for g in reversed(groupings):
        name, value = F.when(F.grouping(g) == 0, g).otherwise(name), F.when(F.grouping(g) == 0, F.col(g)).otherwise(value)
    count = lambda c: F.count_if(c)
    short = {w: F.col(f"{w}_category") == "insufficient_text" for w in ("before", "after")}
    return sets.agg(
        name.alias("grouping"), value.alias("group_value"), F.count("*").alias("rows"), *[count(c).alias(f"{w}_insufficient") for w, c in short.items()], count(F.col("recovered")).alias("recovered"), count(F.col("newly_insufficient")).alias("newly_insufficient"),
        (count(F.col("recovered")) - count(F.col("newly_insufficient"))).alias("net_recovered"), F.percentile("after_chars", F.lit(0.5)).cast("int").alias("median_chars"),
    ).drop(*groupings)
