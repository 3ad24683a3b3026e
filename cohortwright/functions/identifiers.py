"""Hierarchical sample identifiers (project-site-patient-sample-...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import as_column

# Spellings of "no identifier" and the barcode prefix.
NULL_ID_TOKENS = ("nan", "none", "null", "na")
BARCODE_PREFIX = "TCGA-"

# Leading parts that make up each level of a barcode.
KEY_LEVELS = {"sample": 4, "patient": 3}


def normalize_id(c: Column | str, null_tokens: tuple[str, ...] = NULL_ID_TOKENS) -> Column:
    """Trim, upper-case, dots to dashes; blanks and null tokens become NULL."""
    text = F.trim(as_column(c).cast("string"))
    missing = text == ""
    if null_tokens:
        missing = missing | F.lower(text).isin(*null_tokens)
    return F.when(~missing, F.upper(F.translate(text, ".", "-")))


def key_variants(
    c: Column | str,
    prefix: str = BARCODE_PREFIX,
    levels: dict[str, int] = KEY_LEVELS,
    null_tokens: tuple[str, ...] = NULL_ID_TOKENS,
) -> dict[str, Column]:
    """The full key and its shorter levels; levels are NULL without the prefix or enough parts."""
    full = normalize_id(c, null_tokens)
    parts = F.split(full, "-")
    keys = {"full": full}
    for name, depth in levels.items():
        usable = full.startswith(prefix) & (F.size(parts) >= depth)
        keys[name] = F.when(usable, F.substring_index(full, "-", depth))
    return keys


def type_code(c: Column | str, prefix: str = BARCODE_PREFIX) -> Column:
    """Two leading digits of the fourth barcode part."""
    full = normalize_id(c)
    code = F.regexp_extract(F.get(F.split(full, "-"), F.lit(3)), r"^(\d{2})", 1)
    return F.when(full.startswith(prefix), F.nullif(code, F.lit("")))
