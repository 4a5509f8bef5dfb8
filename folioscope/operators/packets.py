"""Packets for reviewers: profiles, difficulty guides, identity checks, adjudications, snapshots, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.config import CATEGORIES, CLASSIFICATION_RULES
from folioscope.functions import text as T
from folioscope.functions.features import features
from folioscope.operators.classify import all_phrases, resolved, with_scores
from folioscope.operators.labels import KEY, errors_of
from folioscope.operators.rank import first_by
from folioscope.operators.shares import flag


def unseen_rows(rows: DataFrame, doi_prefixes: list[str], *done: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows with one of the DOI prefixes whose key is in none of the other tables (imported, exported, scanned)."""
    if doi_prefixes:
        rows = rows.where(reduce(lambda a, b: a | b, [T.doi("doi").startswith(p.lower()) for p in doi_prefixes]))
    return reduce(lambda df, other: df.join(other.select(key).distinct(), key, "left_anti"), done, rows)


def profile(packet: DataFrame, chars: str = "classification_text_chars") -> DataFrame:
    """One row: rows, rows with and without abstract, least, median (cut to a whole number) and most characters."""
    n = T.number(chars)
    has = T.present("abstract")
    return packet.agg(F.count("*").alias("rows"), F.coalesce(F.sum(flag(has)), F.lit(0)).alias("with_abstract"), F.coalesce(F.sum(flag(~has)), F.lit(0)).alias("without_abstract"), F.min(n).cast("int").alias("min_chars"), F.percentile(n, 0.5).cast("int").alias("median_chars"), F.max(n).cast("int").alias("max_chars"))


def cue_profile(causal: Column, predictive: Column) -> Column:
    return F.when((causal > 0) & (predictive > 0), "causal_and_predictive_cues").when(causal > 0, "causal_cues").when(predictive > 0, "predictive_cues").otherwise("no_keyword_cues")


def text_status(chars: Column, abstract_chars: Column, minimum: int) -> Column:
    return F.when(abstract_chars == 0, "no_abstract").when(chars < minimum, "short_text").otherwise("usable_text")


def review_difficulty(status: Column, cues: Column) -> Column:
    return F.when((status == "no_abstract") | (cues == "causal_and_predictive_cues"), "high").when(status == "short_text", "medium").otherwise("routine")


def review_guide(packet: DataFrame, rules: dict = CLASSIFICATION_RULES, entities: bool = True) -> DataFrame:
    """Each packet row's characters, text status, cues and difficulty."""
    made = features([f for f in rules["text_fields"] if f in packet.columns], all_phrases(rules), entities)
    work = with_scores(packet.withColumn("__f", made), F.col("__f.hits"), rules)
    size, own = F.col("__f.chars"), F.length(F.trim(T.text("abstract")))
    status = text_status(size, own, rules["minimum_chars"])
    cues = cue_profile(F.col("__causal_score"), F.col("__predictive_score"))
    terms = [F.array_join(f"__{f}_terms", "|").alias(f"{f}_cue_terms") for f in ("causal", "predictive")]
    return work.select(*packet.columns, own.alias("abstract_chars"), size.alias("guide_text_chars"), status.alias("text_status"), cues.alias("cue_profile"), review_difficulty(status, cues).alias("review_difficulty"), *terms)


def guide_counts(guide: DataFrame) -> DataFrame:
    """Counts of each section of a guide, as (section, value, rows)."""
    parts = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("value")) for c in ("text_status", "cue_profile", "review_difficulty")])
    return guide.select(F.explode(parts).alias("x")).groupBy("x.section", "x.value").agg(F.count("*").alias("rows"))


def packet_errors(sample: DataFrame, packet: DataFrame, id_column: str, expected_rows: int | None = None) -> DataFrame:
    """Error rows of a packet against its sample: stale or unknown keys, missing and duplicate ids, duplicate keys, and one row where the packet has
    not as many rows as it was drawn with."""
    known = sample.select(*KEY).distinct().withColumn("__known", F.lit(True))
    ids = sample.select("validation_id").distinct().withColumn("__id", F.lit(True))
    same, keys = F.count("*").over(Window.partitionBy(id_column)), F.count("*").over(Window.partitionBy(*KEY))
    work = packet.withColumns({"__same": same, "__keys": keys}).join(known, KEY, "left").join(ids, "validation_id", "left")
    named = T.present(id_column)
    out = errors_of(work, KEY, [
        (id_column, ~named, "missing_packet_id"), (id_column, named & (F.col("__same") > 1), "duplicate_packet_id"), ("validation_id", (T.present("validation_id") | T.present("article_id")) & (F.col("__keys") > 1), "duplicate_packet_key"),
        ("article_id", F.col("__known").isNull() & F.col("__id").isNotNull(), "stale_packet_row"), ("validation_id", F.col("__id").isNull(), "unknown_packet_row"),
    ])
    if expected_rows is None:
        return out
    size = packet.agg(F.count("*").alias("n")).where(F.col("n") != expected_rows)
    none = F.lit("")
    return out.unionByName(size.select(none.alias("validation_id"), none.alias("article_id"), F.lit("packet_rows").alias("field"), F.col("n").cast("string").alias("value"), F.lit("packet_row_count_mismatch").alias("error")))


def submission_errors(packet: DataFrame, submissions: DataFrame, id_column: str) -> DataFrame:
    """Error rows of submissions: ids that aren't in the packet, several rows of one reviewer for an item."""
    known = packet.select(id_column).distinct().withColumn("__known", F.lit(True))
    work = submissions.withColumn("__same", F.count("*").over(Window.partitionBy(id_column, "reviewer_id"))).join(known, id_column, "left")
    return errors_of(work, [id_column], [(id_column, F.col("__known").isNull(), "unknown_submission_row"), ("reviewer_id", F.col("__same") > 1, "duplicate_reviewer_row")])


def row_progress(packet: DataFrame, submissions: DataFrame, errors: DataFrame, id_column: str, reviewers: int = 2) -> DataFrame:
    """Each packet row's number of reviews and errors, and its status."""
    done = submissions.where(T.present("manual_label")).groupBy(id_column).agg(F.count_distinct("reviewer_id").alias("reviews"))
    bad = errors.groupBy(id_column).agg(F.count("*").alias("errors"))
    work = packet.join(done, id_column, "left").join(bad, id_column, "left").na.fill(0, ["reviews", "errors"])
    return work.withColumn("progress_status", F.when(F.col("errors") > 0, "has_errors").when(F.col("reviews") >= reviewers, "complete").when(F.col("reviews") > 0, "partial").otherwise("not_started"))


def validate_adjudications(packet: DataFrame, sample: DataFrame) -> DataFrame:
    """Error rows of adjudications: duplicates, unknown keys, invalid labels, missing notes, adjudicator or date."""
    made = T.present("adjudicated_label")
    known = sample.select(*KEY).distinct().withColumn("__known", F.lit(True))
    work = packet.withColumn("__same", F.count("*").over(Window.partitionBy(*KEY))).join(known, KEY, "left")
    checks = [("validation_id", F.col("__same") > 1, "duplicate_key"), ("validation_id", F.col("__known").isNull(), "unknown_key"), ("adjudicated_label", made & ~F.col("adjudicated_label").isin(*CATEGORIES), "invalid_adjudicated_label")]
    return errors_of(work, KEY, checks + [(c, made & T.blank(c), f"missing_{c}") for c in ("adjudication_notes", "adjudicator_id", "adjudication_date")])


def snapshot(classified: DataFrame, label: str, queue: DataFrame | None = None, include: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """State of articles at a label in time: those of the queue and of `include`, or all; with the latest source they were imported from."""
    c = first_by(classified.withColumn("__c", resolved(classified)), ["article_id"], [F.asc("__c")])
    if queue is not None or include is not None:
        ids = reduce(lambda a, b: a.unionByName(b), [x.select("article_id") for x in (queue, include) if x is not None]).distinct()
        c = c.join(ids, "article_id", "left_semi")
    source = F.lit("")
    if history is not None:
        last = history.groupBy("article_id").agg(F.max_by("import_source_file", "import_row").alias("__src"))
        c = c.join(last, "article_id", "left")
        source = F.coalesce("__src", F.lit(""))
    return c.select(F.lit(label).alias("snapshot_label"), "article_id", T.text("journal_short").alias("journal_short"), T.decade("publication_year").alias("decade"), F.col("__c").alias("category"), F.coalesce(T.number("classification_text_chars"), F.lit(0.0)).cast("int").alias("chars"), source.alias("import_source"))


def queue_summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Rows and the median of missing characters (rounded, halves to even) by groups."""
    return rows.groupBy(*groups).agg(F.count("article_id").alias("rows"), F.bround(F.percentile("chars_needed_to_threshold", F.lit(0.5))).cast("int").alias("median_chars_needed_to_threshold"))
