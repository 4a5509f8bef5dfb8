"""Default rules, thresholds and value lists. All are plain Python values that callers may replace."""

from __future__ import annotations

# Phrases and weights of the classification rules.
CLASSIFICATION_RULES = {
    "text_fields": ["title", "abstract"],
    "minimum_chars": 250,
    "strong_weight": 2,
    "moderate_weight": 1,
    "dominance_margin": 2,
    "causal": {
        "strong": ["causal effect", "causal effects", "treatment effect", "treatment effects", "randomized controlled trial", "randomised controlled trial", "difference-in-differences", "differences-in-differences", "regression discontinuity", "instrumental variable", "instrumental variables", "natural experiment", "identification strategy", "exogenous variation", "causal evidence"],
        "moderate": ["effect of", "effects of", "impact of", "impacts of", "randomized", "randomised", "experiment", "experimental evidence", "counterfactual", "quasi-experiment", "quasi-experimental", "plausibly exogenous"],
    },
    "predictive": {
        "strong": ["out-of-sample", "out of sample", "predictive accuracy", "prediction accuracy", "forecast accuracy", "forecasting accuracy", "machine learning", "supervised learning", "cross-validation", "cross validation", "nowcasting"],
        "moderate": ["predict", "predicts", "predicted", "predicting", "prediction", "predictions", "predictive", "forecast", "forecasts", "forecasting", "nowcast", "classification", "classify", "classifier"],
    },
}

# Wordings of archive terms and rights notices, by the flag that they raise.
QUALITY_PATTERNS = {
    "jstor_terms_boilerplate": [
        r"your use of the jstor archive indicates your acceptance",
        r"jstor(?:'|’)s terms and conditions of use",
        r"terms and conditions of use,?\s+available at",
        r"this content downloaded from .{0,240}? all use subject to https?://about\.jstor\.org/terms",
        r"\ball use subject to https?://about\.jstor\.org/terms\b",
    ],
    "access_or_rights_boilerplate": [r"copyright\s*(?:©|\(c\))?\s*\d{4}\s*all rights reserved", r"\ball rights reserved\b"],
}

# The wordings that are removed, in order.
STRIP_PATTERNS = [
    r"your use of the jstor archive indicates your acceptance of jstor(?:'|’)s terms and conditions of use,?\s+available at(?:\s+\S+)?",
    r"jstor(?:'|’)s terms and conditions of use",
    r"terms and conditions of use,?\s+available at(?:\s+\S+)?",
    r"this content downloaded from .{0,240}? all use subject to https?://about\.jstor\.org/terms",
    r"\ball use subject to https?://about\.jstor\.org/terms\b",
    r"copyright\s*(?:©|\(c\))?\s*\d{4}\s*all rights reserved",
    r"\ball rights reserved\b",
]

#: Lower-case wordings of which every text that a pattern above matches has at least one: the patterns run on such texts only.
STRIP_WORDINGS = ["terms and conditions of use", "all use subject to http", "all rights reserved"]
QUALITY_WORDINGS = ["your use of the jstor archive", *STRIP_WORDINGS]

# DOI prefixes with a family of their own.
DOI_PREFIXES = ["10.1257", "10.7916", "10.1086", "10.3982", "10.2307", "10.1111"]

# Which source a field is taken from first.
SOURCE_PRIORITY = {
    "bibliographic": ["crossref", "openalex"],
    "abstract": ["openalex", "crossref"],
    "authors": ["openalex", "crossref"],
    "affiliations": ["openalex", "crossref"],
    "keywords": ["openalex", "crossref"],
}

# Labels, scopes outside research, thresholds of the expansion gate, the tier of formal abstracts.
CATEGORIES = ["causal", "predictive", "other", "insufficient_text"]
CONFIDENCE = ["high", "medium", "low"]
EXCLUDED_SCOPES = ["review_erratum_paratext", "comment_reply", "lecture_address"]
GATE = {"abstract_share": 0.80, "journal_abstract_share": 0.60, "insufficient_share": 0.20, "high_confidence_agreement": 0.85}
FORMAL_ABSTRACT_TIER = "tier_a_formal_abstract"
