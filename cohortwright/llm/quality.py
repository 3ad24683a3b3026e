"""Quality rules: a table of measures and limits compiled into one Spark projection, without user functions.

Every measure is a column expression over a document's words and lines; the rules only name a measure and its
least and greatest value. A document fails by each rule whose measure leaves its range, and the failed rules are
listed. The measures of a row need that row only, so nothing is shuffled and no key can be hot.

Null and empty texts have no words and no lines, all counts are 0, and they fail on ``n_words``. Repeated rows are
judged alike, one by one. Columns of the input stay as they are beside the struct ``quality``. Stop words are asked of
texts whose ``lang`` the list covers; without that column, or where it is null, that rule doesn't hold. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    """
    the of and to in is it that was for on are with as at be this have from or by not but an they which you we a
    le la les un une des du de et est dans que qui en pour pas sur au avec ce il elle se ne plus par
    der die das und ist nicht ein eine mit von zu den im auf dem für sich des auch als wie sie er
    el los las y una con por para es no se lo su del al más como o sus le ha pero son
    """.split()
)
STOP_LANGS = ("en", "fr", "de", "es")


@dataclass(frozen=True)
class Rule:
    measure: str
    least: float | None = None
    most: float | None = None
    langs: tuple[str, ...] | None = None  # the rule holds for texts of these languages only


RULES = (
    Rule("n_words", least=50),
    Rule("repeat_share", most=0.5),
    Rule("mean_word_chars", least=2, most=14),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_words", least=2, langs=STOP_LANGS),
    Rule("alphabetic_share", least=0.6),
    Rule("dup_line_share", most=0.5),
    Rule("bullet_line_share", most=0.9),
    Rule("ellipsis_line_share", most=0.5),
)


def words_of(text: Column) -> Column:
    """Words ``[^\x20\x09-\x0D]+`` of a text that isn't null."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used and wherever the plan moves it."""
    return F.get(F.transform(F.array(value), use), 0)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the array holds at least twice.

    Windows are hashed with their positions and sorted, so that equal ones are neighbours (an equal 64-bit hash of
    different windows of one text is taken for a repeat; at 20,000 words that has a chance of 1e-11).
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["at"]))

    at = bound(F.sort_array(windows), places)
    start = F.struct(F.lit(-3).alias("end"), F.lit(0).cast("bigint").alias("n"))
    total = F.aggregate(at, start, lambda a, x: F.struct(x.alias("end"), (a["n"] + F.least(F.lit(3), x - a["end"])).alias("n")), lambda a: a["n"])
    return F.when(n >= 3, total).otherwise(F.lit(0).cast("bigint"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def assess(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with a struct ``quality`` (replacing a column so named): counts, ratios, ``base_failed``, ``failed`` (names of rules) and ``kept``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lang = F.lower(F.col("lang").cast("string")) if "lang" in docs.columns else F.lit(None).cast("string")
    parts = F.struct(text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    quality = bound(parts, lambda x: bound(_counts(x["text"], x["words"], x["lines"]), lambda c: _verdict(c, rules, lang)))
    return docs.withColumn("quality", quality)


def _counts(text: Column, words: Column, lines: Column) -> Column:
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint").alias("stop_words"),
        F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("bigint").alias("n_alphabetic"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣–]"))).cast("bigint").alias("n_bullets"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint").alias("n_ellipses"),
    )


def _verdict(c: Column, rules: Sequence[Rule], lang: Column) -> Column:
    measures = {
        "n_words": c["n_words"],
        "repeat_share": _share(c["n_repeat_words"], c["n_words"]),
        "mean_word_chars": _share(c["word_chars"], c["n_words"]),
        "symbol_ratio": _share(c["n_symbols"], c["n_words"]),
        "stop_words": c["stop_words"],
        "alphabetic_share": _share(c["n_alphabetic"], c["n_words"]),
        "dup_line_share": _share(c["n_dup_lines"], c["n_lines"]),
        "bullet_line_share": _share(c["n_bullets"], c["n_lines"]),
        "ellipsis_line_share": _share(c["n_ellipses"], c["n_lines"]),
    }
    broken = []
    for rule in rules:
        m, out = measures[rule.measure], F.lit(False)
        if rule.least is not None:
            out = out | (m < rule.least)
        if rule.most is not None:
            out = out | (m > rule.most)
        if rule.langs is not None:
            out = out & F.coalesce(lang.isin(*rule.langs), F.lit(False))
        broken.append(F.when(out, F.lit(rule.measure)))
    base = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    failed = F.array_distinct(F.filter(F.array(*broken), lambda x: x.isNotNull()))
    return F.struct(
        *[c[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "stop_words")],
        *[m.cast("double").alias(name) for name, m in measures.items() if name not in ("n_words", "stop_words")],
        base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns only (a column ``quality`` of the input stays)."""
    own = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    return assess(docs.select(own, "text", *(["lang"] if "lang" in docs.columns else [])), rules).filter("quality.kept").select("row.*")
