"""Rule classification of rows: phrase scores, categories, title triage, scopes, resolved labels, model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.config import CATEGORIES, CLASSIFICATION_RULES, CONFIDENCE
from folioscope.functions.features import features
from folioscope.functions.text import blank, col, payload_key, present, text
from folioscope.operators.rank import first_by


FAMILIES = [(f, k) for f in ("causal", "predictive") for k in ("strong", "moderate")]


def all_phrases(rules: dict = CLASSIFICATION_RULES) -> list[str]:
    """The phrases of both families in the order in which hits are numbered."""
    return [p for f, k in FAMILIES for p in rules[f][k]]


def with_scores(df: DataFrame, hits: Column, rules: dict = CLASSIFICATION_RULES) -> DataFrame:
    """Adds __<family>_strong, _terms and _score for both families from the numbers of the phrases found, ascending: each counts once."""

    def among(start: int, phrases: list[str]) -> Column:
        if not phrases:
            return F.array().cast("array<string>")
        names = F.array(*[F.lit(p) for p in phrases])
        return F.transform(F.filter("__hits", lambda i: i.between(start, start + len(phrases) - 1)), lambda i: F.get(names, i - start))

    sizes = [len(rules[f][k]) for f, k in FAMILIES]
    found = {f"__{f}_{k}": among(sum(sizes[:at]), rules[f][k]) for at, (f, k) in enumerate(FAMILIES)}
    df = df.withColumn("__hits", hits).withColumns(found)
    return df.withColumns(
        {f"__{f}_terms": F.concat(f"__{f}_strong", f"__{f}_moderate") for f in ("causal", "predictive")}
        | {f"__{f}_score": rules["strong_weight"] * F.size(f"__{f}_strong") + rules["moderate_weight"] * F.size(f"__{f}_moderate") for f in ("causal", "predictive")}
    )


def _decision(rules: dict, prefix: str, none_confidence: str, none_reason: str) -> tuple[Column, Column, Column]:
    """Category, confidence and reason from the scores alone."""
    c, p, margin = F.col("__causal_score"), F.col("__predictive_score"), rules["dominance_margin"]
    one = {f: (F.col(f"__{f}_score") > 0) & (F.col(f"__{o}_score") == 0) for f, o in (("causal", "predictive"), ("predictive", "causal"))}
    both = (c > 0) & (p > 0)
    category = F.when(one["causal"] | both & (c >= p + margin), "causal").when(one["predictive"] | both & (p >= c + margin), "predictive").otherwise("other")
    level = {f: F.when(F.size(f"__{f}_strong") > 0, "high").otherwise("medium") for f in one}
    clear = both & (F.abs(c - p) >= margin)
    confidence = F.when(one["causal"], level["causal"]).when(one["predictive"], level["predictive"]).when(clear, "medium").when(both, "low").otherwise(none_confidence)
    listed = {f: F.concat(F.lit(f"{prefix} {f} language: "), F.array_join(F.slice(f"__{f}_terms", 1, 6), ", ")) for f in one}
    tie = f"{prefix} both causal and predictive language"
    reason = (
        F.when(one["causal"], listed["causal"]).when(one["predictive"], listed["predictive"])
        .when(both & (c >= p + margin), f"{tie}, with stronger causal score.").when(both & (p >= c + margin), f"{tie}, with stronger predictive score.")
        .when(both, f"{tie} without a clear dominant category.").otherwise(none_reason)
    )
    return category, confidence, reason


def classify(df: DataFrame, rules: dict = CLASSIFICATION_RULES, entities: bool = True, titles: bool = False) -> DataFrame:
    """Adds the classification columns: one pass over a row's texts finds all phrases. titles: also __title_hits, for title_triage."""
    fields = [f for f in rules["text_fields"] if f in df.columns]
    keep = df.columns
    made = features(fields, all_phrases(rules), entities, fields.index("title") if titles and "title" in fields else None)
    work = with_scores(df.withColumn("__f", made), F.col("__f.hits"), rules).withColumns({"__chars": F.col("__f.chars"), "__flags": F.col("__f.flags")})
    short = F.col("__chars") < rules["minimum_chars"]
    category, confidence, reason = _decision(rules, "Matched", "medium", "No causal or predictive rule terms matched in usable title/abstract text.")
    too_short = F.when(F.col("__flags") != "", "Title and abstract text are too short after removing source boilerplate.").otherwise("Title and abstract text are too short for reliable rule-based classification.")
    made = F.struct(
        F.when(short, "insufficient_text").otherwise(category).alias("causal_predictive_category"),
        F.when(short, "low").otherwise(confidence).alias("classification_confidence"),
        F.when(short, too_short).otherwise(reason).alias("classification_reason"),
        F.col("__causal_score").alias("causal_language_indicator"),
        F.col("__predictive_score").alias("predictive_language_indicator"),
        F.array_join("__causal_terms", "|").alias("causal_language_terms"),
        F.array_join("__predictive_terms", "|").alias("predictive_language_terms"),
        F.lit("rule_based").alias("classification_method"),
        F.col("__chars").alias("classification_text_chars"),
        (~short).alias("has_usable_classification_text"),
        F.col("__flags").alias("classification_text_quality_flags"),
        *([F.col("__f.title_hits").alias("__title_hits")] if titles else []),
    )
    return work.select(*keep, F.inline(F.array(made)))  # one row each; filters stay above, so that Spark doesn't repeat all steps in them


def resolved(df: DataFrame, kind: str = "category") -> Column:
    """The model's label where its status is ok and it isn't blank, else the rules'; blank as `missing`. kind: category or confidence."""
    own = F.col("causal_predictive_category" if kind == "category" else "classification_confidence").cast("string")
    if {f"llm_{kind}", "llm_status"} <= set(df.columns):
        own = F.when((text("llm_status") == "ok") & present(f"llm_{kind}"), F.col(f"llm_{kind}").cast("string")).otherwise(own)
    return F.when(F.coalesce(own, F.lit("")) == "", "missing").otherwise(own)


SUGGESTION = ["title_only_suggested_category", "title_only_confidence", "title_only_reason"]


def with_title_suggestion(df: DataFrame, rules: dict = CLASSIFICATION_RULES, entities: bool = True) -> DataFrame:
    """Adds what the title alone suggests, empty for rows with enough text, and the scores behind it. Uses what classify(titles=True) found, else looks at titles anew."""
    hits = F.col("__title_hits") if "__title_hits" in df.columns else F.col("__title_f.hits")
    if "__title_hits" not in df.columns:
        df = df.withColumn("__title_f", features(["title"], all_phrases(rules), entities))
    work = with_scores(df, hits, rules)
    made = dict(zip(SUGGESTION, _decision(rules, "Title matched", "low", "No causal or predictive rule terms matched in the title."), strict=True))
    short = resolved(df) == "insufficient_text"
    return work.withColumns({n: F.when(short, c).otherwise("") for n, c in made.items()})


def title_triage(df: DataFrame, rules: dict = CLASSIFICATION_RULES, entities: bool = True) -> DataFrame:
    """Suggestions by title alone for rows with too little text; the labels stay as they are. Order by triage_order()."""
    rows = df.withColumn("current_category", resolved(df)).where("current_category = 'insufficient_text'")
    work = with_title_suggestion(rows, rules, entities)
    given = ["article_id", "journal_short", "publication_year", "title", "classification_text_chars", "current_category"]
    return work.select(
        *[F.col(c) if c in work.columns else F.lit("").alias(c) for c in given],
        F.col("__causal_score").alias("title_causal_language_indicator"),
        F.col("__predictive_score").alias("title_predictive_language_indicator"),
        F.array_join("__causal_terms", "|").alias("title_causal_language_terms"),
        F.array_join("__predictive_terms", "|").alias("title_predictive_language_terms"),
        *SUGGESTION,
        F.lit(True).alias("needs_manual_review"),
    )


def position(c: Column | str, values: list[str], other: int = 9) -> Column:
    """The place of a value in a list, `other` if it isn't in it."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), col(c))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(other)


def triage_order() -> list[Column]:
    return [position("title_only_confidence", CONFIDENCE), position("title_only_suggested_category", CATEGORIES), F.col("journal_short"), F.col("publication_year"), F.col("title"), F.col("article_id")]


def article_scope(title: Column | str, kind: Column | str, type_scopes: dict[str, str], patterns: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(scope, reason): by article type, else by the first title pattern that matches, in order; blank titles are `unknown`, others `research`.
    patterns: (scope, regex)."""
    low = F.lower(F.trim(text(title)))
    own_type = F.lower(F.trim(text(kind)))
    hits = F.filter(F.array(*[F.when(low.rlike(f"(?i){p}"), F.struct(F.lit(s).alias("scope"), F.lit(p).alias("pattern"))) for s, p in patterns]), lambda x: x.isNotNull()) if patterns else None
    first = F.get(hits, F.lit(0)) if patterns else F.lit(None).cast("struct<scope:string,pattern:string>")
    by_type = F.lit(None).cast("string")
    for t, s in type_scopes.items():
        by_type = F.when(own_type == t, s).otherwise(by_type)
    scope = F.coalesce(by_type, F.when(low == "", "unknown"), first["scope"], F.lit("research"))
    reason = F.coalesce(F.when(by_type.isNotNull(), F.concat(F.lit("article_type:"), own_type)), F.when(low == "", "missing_title"), F.concat(F.lit("title_pattern:"), first["pattern"]), F.lit(""))
    return scope, reason


_ANSWER = "struct<category:string,confidence:string,reason:string>"


def parse_model_response(c: Column | str) -> Column:
    """struct(category, confidence, reason, error) of a response: `output_text`, or else the text of its nested pieces, must be an
    object with an allowed category and confidence and a reason. error is empty for a good one."""
    outer = F.from_json(col(c), "output_text string, output array<struct<content:array<struct<text:string>>>>")
    nested = F.array_join(F.filter(F.flatten(F.transform(outer["output"], lambda o: F.transform(o["content"], lambda p: p["text"]))), lambda x: x.isNotNull()), "")
    body = F.coalesce(F.when(present(outer["output_text"]), outer["output_text"]), nested, F.lit(""))
    answer = F.from_json(body, _ANSWER)
    keys = F.json_object_keys(body)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    error = (
        F.when(blank(body), "no_output_text")
        .when(keys.isNull(), "invalid_json")
        .when(~(has("category") & has("confidence") & has("reason")), "missing_keys")
        .when(~F.coalesce(answer["category"].isin(*CATEGORIES), F.lit(False)), "invalid_category")
        .when(~F.coalesce(answer["confidence"].isin(*CONFIDENCE), F.lit(False)), "invalid_confidence")
        .when(blank(answer["reason"]), "empty_reason")
        .otherwise("")
    )
    return F.struct(answer["category"].alias("category"), answer["confidence"].alias("confidence"), answer["reason"].alias("reason"), error.alias("error"))


def merge_model_results(df: DataFrame, responses: DataFrame, prompt: str, model: str, minimum_chars: int = 250, hybrid: bool = True) -> DataFrame:
    """Rule labels overwritten by good model responses (cache_key, response) where the text isn't short; llm_status says what happened. Of several
    responses with one key the first by text counts."""
    key = payload_key(article_id="article_id", prompt_version=F.lit(prompt), model=F.lit(model), title="title", abstract="abstract")
    keep = [c for c in df.columns if c not in ("causal_predictive_category", "classification_confidence", "classification_reason", "classification_method")]
    answers = first_by(responses, ["cache_key"], [F.asc("response")]).select(F.col("cache_key").alias("__key"), parse_model_response("response").alias("__a"))
    work = df.withColumn("__key", key).join(answers, "__key", "left")
    short = F.col("classification_text_chars") < minimum_chars
    status = F.when(short, "skipped_insufficient_text").when(F.col("__a").isNull(), "not_cached").when(F.col("__a.error") != "", "error").otherwise("ok")
    ok = F.col("llm_status") == "ok"
    return work.withColumn("llm_status", status).select(
        *keep,
        F.when(ok, F.col("__a.category")).otherwise(F.col("causal_predictive_category")).alias("causal_predictive_category"),
        F.when(ok, F.col("__a.confidence")).otherwise(F.col("classification_confidence")).alias("classification_confidence"),
        F.when(ok, F.col("__a.reason")).otherwise(F.col("classification_reason")).alias("classification_reason"),
        F.when(ok, "hybrid" if hybrid else "llm_based").otherwise(F.col("classification_method")).alias("classification_method"),
        "llm_status",
        F.when(F.col("llm_status") == "error", F.col("__a.error")).otherwise("").alias("llm_error"),
    )
