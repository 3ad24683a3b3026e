"""Recoding of messy clinical text into small category sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import as_column

UNKNOWN = "unknown"

# Texts that stand for "not known".
UNKNOWN_TOKENS = (
    "not reported", "not available", "unknown", "nan", "none", "null", "--", "[not available]", "[unknown]",
)

# Exact spellings and substrings of each category, in order of precedence.
SEX_VALUES = {"male": ("male", "m"), "female": ("female", "f")}
HISTOLOGY_RULES = (("escc", ("squamous", "escc")), ("eac", ("adenocarcinoma", "eac", "adeno")))
SMOKING_COMPAT_RULES = (
    ("non_smoker", ("never", "non-smoker", "nonsmoker", "lifelong non-smoker", "no")),
    ("smoker", ("current", "reformed", "former", "smoker", "yes", "1", "2", "3", "4", "5")),
)
# Word rules for the default mode: text is matched by whole words, numbers by value.
NON_SMOKER_WORDS = r"\b(never|non-?smoker|no)\b"
SMOKER_WORDS = r"\b(current|reformed|former|smoker|yes)\b"

# Roman numeral or digit with an optional sub-stage such as a, b2.
STAGE_PATTERN = r"^(iv|iii|ii|i|[1-4])([abc][0-9]?)?(\W|$)"



def clean_unknown(c: Column | str) -> Column:
    """Trimmed text, or ``unknown`` for NULL, blanks and the usual missing tokens."""
    text = F.trim(as_column(c).cast("string"))
    return F.when(text.isNull() | (text == "") | F.lower(text).isin(*UNKNOWN_TOKENS), UNKNOWN).otherwise(text)


def recode_exact(c: Column | str, values: Mapping[str, Sequence[str]] = SEX_VALUES) -> Column:
    """Category whose spelling equals the lower-cased text, else ``unknown``."""
    text = F.lower(clean_unknown(c))
    out = F.lit(UNKNOWN)
    for category, spellings in reversed(list(values.items())):
        out = F.when(text.isin(*spellings), category).otherwise(out)
    return out


def recode_contains(
    c: Column | str,
    rules: Sequence[tuple[str, Sequence[str]]] = HISTOLOGY_RULES,
    default: str = "other",
) -> Column:
    """First rule with a substring in the lower-cased text wins; unknown stays unknown."""
    text = F.lower(clean_unknown(c))
    out = F.lit(default)
    for category, needles in reversed(list(rules)):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | text.contains(needle)
        out = F.when(hit, category).otherwise(out)
    return F.when(text == UNKNOWN, UNKNOWN).otherwise(out)


def recode_smoking(c: Column | str, mode: str = "strict") -> Column:
    """Smoking status.

    ``strict`` matches whole words and reads a bare number by value: 0 and 1 (none, or the code
    for a lifelong non-smoker) against anything larger (codes 2..5, pack years). ``compat``
    searches substrings instead, which calls ``10`` and code 1 a smoker and ``60`` unknown.
    """
    if mode == "compat":
        return recode_contains(c, SMOKING_COMPAT_RULES, default=UNKNOWN)
    text = F.lower(clean_unknown(c))
    code = text.try_cast("double")
    return (
        F.when(text == UNKNOWN, UNKNOWN)
        .when(code.isin(0.0, 1.0), "non_smoker")
        .when(code > 0, "smoker")
        .when(text.rlike(NON_SMOKER_WORDS), "non_smoker")
        .when(text.rlike(SMOKER_WORDS), "smoker")
        .otherwise(UNKNOWN)
    )


def recode_stage(c: Column | str, mode: str = "strict") -> Column:
    """Early (I, II) or late (III, IV) stage.

    ``strict`` reads the whole roman numeral or digit. ``compat`` tests the prefix ``i`` first, so
    that III and IV count as early.
    """
    text = F.trim(F.replace(F.lower(clean_unknown(c)), F.lit("stage"), F.lit("")))
    if mode == "compat":
        return (
            F.when(text == UNKNOWN, UNKNOWN)
            .when(text.startswith("i") | text.startswith("1") | text.startswith("2"), "early_stage")
            .when(text.startswith("3") | text.startswith("4"), "late_stage")
            .otherwise(UNKNOWN)
        )
    numeral = F.regexp_extract(text, STAGE_PATTERN, 1)
    return (
        F.when(numeral.isin("i", "ii", "1", "2"), "early_stage")
        .when(numeral.isin("iii", "iv", "3", "4"), "late_stage")
        .otherwise(UNKNOWN)
    )


def slug(c: Column | str, length: int | None = None) -> Column:
    """Lower case, whitespace runs to underscores; unknown stays unknown. ``length`` cuts names on request."""
    name = F.regexp_replace(F.lower(clean_unknown(c)), r"\s+", "_")
    return name if length is None else F.substring(name, 1, length)
