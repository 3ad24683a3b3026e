"""Exact order statistics by histogram selection: find the bucket that holds a rank, refine that bucket only.

A pass counts the values of each open interval of a group in WIDTH equal buckets. Running counts tell which buckets
hold a wanted rank; the others are never looked at again. A bucket whose least and greatest value are equal is an
answer, one of at most SMALL rows is sorted, and the rest are the next pass's intervals, with their real limits as
ends. So a pass moves counts, never rows, the input is read again instead of being stored, and only groups or buckets
of at most SMALL rows are ever sorted. A group of ``n`` rows takes about ``log(n / SMALL) / log(WIDTH)`` passes; values
of very different magnitudes add a few, as every second pass cuts by logarithms.

Several counts of a group can be kept at once (rows of each fold, of each class); a rank may be asked among one count
minus another, so that what all folds but one hold comes from a total and the fold's own count.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributed import _group, is_small, materialize

SMALL, WIDTH = 65_536, 1_024
ROWS_PER_TASK = 1 << 19


@dataclass(frozen=True)
class Quantile:
    """The linear-interpolation quantile ``q`` among ``of`` minus ``minus``; ``q`` may use counts and ``_rows`` of the group."""

    q: float | Column
    of: str = "n"
    minus: str | None = None

    def among(self, name: str = "{}") -> Column:
        of = F.col(name.format(self.of))
        return of if self.minus is None else of - F.col(name.format(self.minus))


def _limits(wanted: Mapping[str, Quantile]) -> Column:
    """Zero-based lower and upper rank of each wanted quantile; null where nothing is counted."""
    out = []
    for name, w in wanted.items():
        position = F.when(w.among() > 0, (w.among() - 1).cast("double") * w.q)
        low = F.floor(position)
        out.append(F.struct(low.alias("low"), F.ceil(position).alias("high"), (position - low).alias("part")).alias(name))
    return F.struct(*out).alias("_wanted")


def _holds(w: Quantile, rank: Column) -> Column:
    """Whether a row of counts (``n`` here, ``_upto`` up to here) holds a rank."""
    upto = w.among("_upto_{}")
    return (upto > rank) & (upto - w.among() <= rank)


def _running(counts: DataFrame, by: Sequence[str], order: str, names: Sequence[str], before: bool) -> DataFrame:
    """Counts up to each row of groups that are small; ``before`` adds what lies below the interval."""
    here = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = {n: F.col(f"_before_{n}") if before else F.lit(0) for n in names}
    return counts.withColumns({f"_upto_{n}": base[n] + F.sum(n).over(here) for n in names})


def _bucket(v: Column, low: Column, high: Column, width: int, stretched: bool) -> Column:
    """Bucket of a value between its interval's ends: never falls as values rise, 0 at the low end and above 0 at the high end.

    ``stretched`` cuts an interval that spans many magnitudes by signed logarithms instead of evenly.
    """
    most = F.lit(sys.float_info.max)
    # Halves can't overflow; infinities and NaN count as the greatest numbers.
    half = lambda x: F.greatest(F.least(x, most), -most) / F.lit(2.0)
    if stretched:
        # 750 lies above -ln of the least positive number, so the scale keeps the order across zero.
        scale = lambda x: F.when(half(x) == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(half(x))) + 750.0))
        ends = [F.abs(half(low)), F.abs(half(high))]
        wide = (F.signum(low) != F.signum(high)) | (F.greatest(*ends) > 1024 * F.least(*ends))
        place = lambda x: F.when(wide, scale(x)).otherwise(half(x))
    else:
        place = half
    share = F.try_divide(place(v) - place(low), place(high) - place(low))
    return F.coalesce(F.least(F.floor(share * width), F.lit(width - 1)), F.when(v > low, F.lit(1)).otherwise(F.lit(0))).cast("int")


def _looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their group's line of a stored table or a projection of one, which is broadcast if ``table._few`` says so."""
    return rows.join(F.broadcast(table) if table._few else table, "_group")


def _measured(table: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Remembers whether a table is small; a projection of a stored one is measured by that."""
    table._few = is_small(table) if like is None else like._few
    return table


def _in_intervals(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows with the interval of their group they lie in; an interval is (_group, _id, _low, _high)."""
    table = _measured(intervals.groupBy("_group").agg(F.collect_list(F.struct("_id", "_low", "_high")).alias("_open")), intervals)
    mine = F.get(F.filter("_open", lambda o: (F.col("_v") >= o["_low"]) & (F.col("_v") <= o["_high"])), F.lit(0))
    return _looked_up(rows, table).withColumn("_in", mine).drop("_open").filter("_in is not null")


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, Quantile],
    counts: Mapping[str, Column] | None = None, small: int = SMALL, width: int = WIDTH,
) -> DataFrame:
    """``by`` and one column per wanted quantile, for every group with a non-missing value.

    ``counts``: what a row adds to each count, ``{"n": 1}`` by default. Values are compared as doubles. Groups of any
    size may be one key; an input that is costly to compute should be stored by the caller, as it is read in each pass.
    """
    counts = dict(counts or {"n": F.lit(1)})
    names = list(counts)
    # Without keys all rows are one group, by a number that is always 1 and not known to be: a join by a known constant is a nested loop.
    group = _group(by) if by else F.struct((F.hash(F.col(value)).bitwiseAND(0) + 1).alias("all"))
    rows = df.filter(F.col(value).isNotNull()).select(
        group.alias("_group"), F.col(value).cast("double").alias("_v"), *[c.cast("bigint").alias(n) for n, c in counts.items()]
    )
    sums = [F.sum(n).alias(n) for n in names]
    facts = rows.groupBy("_group").agg(*sums, F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    facts = _measured(materialize(facts.withColumn("_wanted", _limits(wanted))))
    targets = _measured(facts.select("_group", "_wanted"), facts)
    large = facts.filter(F.col("_rows") > small)
    some_large, n_small = facts.agg(
        F.coalesce(F.max("_rows") > small, F.lit(False)), F.coalesce(F.sum(F.when(F.col("_rows") <= small, F.col("_rows"))), F.lit(0))
    ).first()

    own = _looked_up(rows, _measured(facts.filter(F.col("_rows") <= small).select("_group"), facts)) if some_large else rows
    # No group of these is large, so its rows may meet in one task. Left alone, adaptive execution makes as few tasks as there
    # are cores, whose sorts grow with the input; beyond so many rows the number of tasks grows instead.
    tasks = n_small // ROWS_PER_TASK + 1
    few = tasks <= df.sparkSession.sparkContext.defaultParallelism
    values = (own.repartition("_group") if few else own.repartition(tasks, "_group")).groupBy("_group", "_v").agg(*sums)
    cells = [_running(values, ["_group"], "_v", names, before=False)]
    if some_large:
        cells += _selected(rows, large, targets, wanted, names, small, width)
    keep = ["_group", "_v", *names, *[f"_upto_{n}" for n in names]]
    found = functools.reduce(DataFrame.union, [c.select(*keep) for c in cells])
    ends = _looked_up(found, targets).groupBy("_group").agg(
        # Numbers one by one: an aggregate that holds a struct is a sorting one.
        *[F.max(f"_wanted.{n}.part").alias(f"_part_{n}") for n in wanted],
        *[F.max(F.when(_holds(w, F.col(f"_wanted.{n}.{end}")), F.col("_v"))).alias(f"_{end}_{n}") for n, w in wanted.items() for end in ("low", "high")],
    )
    between = lambda n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")
    # Equal ends need no step between them, which infinite ones couldn't take.
    value = lambda n: F.when(F.col(f"_low_{n}") == F.col(f"_high_{n}"), F.col(f"_low_{n}")).otherwise(between(n))
    return ends.select(*[F.col(f"_group.{b}").alias(b) for b in by], *[value(n).alias(n) for n in wanted])


def _selected(
    rows: DataFrame, large: DataFrame, targets: DataFrame, wanted: Mapping[str, Quantile], names: Sequence[str], small: int, width: int
) -> list[DataFrame]:
    """Rows of counts that hold the wanted ranks of large groups."""
    sums = [F.sum(n).alias(n) for n in names]
    answers = functools.reduce(
        Column.__or__, [F.coalesce(_holds(w, F.col(f"_wanted.{n}.{end}")), F.lit(False)) for n, w in wanted.items() for end in ("low", "high")]
    )
    zero = {f"_before_{n}": F.lit(0).cast("bigint") for n in names}
    intervals = _measured(large.select("_group", F.lit(0).cast("bigint").alias("_id"), "_low", "_high").withColumns(zero), targets)
    cells, pending, turn = [], [], 0
    while True:
        placed = _in_intervals(rows, intervals)
        # Even cuts suit most values; every second pass cuts by magnitude what even cuts would take long to reach.
        bucket = _bucket(F.col("_v"), F.col("_in._low"), F.col("_in._high"), width, turn % 2 == 1)
        histogram = placed.groupBy("_group", F.col("_in._id").alias("_id"), bucket.alias("_bucket")).agg(
            *sums, F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        histogram = histogram.join(intervals.drop("_low", "_high"), ["_group", "_id"])
        running = _running(histogram, ["_group", "_id"], "_bucket", names, before=True)
        kept = _looked_up(running, targets).filter(answers).drop("_wanted")
        kept = _measured(materialize(kept.withColumn("_id", F.xxhash64("_id", "_bucket"))))
        cells.append(kept.filter("_low = _high").withColumn("_v", F.col("_low")))
        rest = kept.filter("_low < _high").select(
            "_group", "_id", "_low", "_high", *[(F.col(f"_upto_{n}") - F.col(n)).alias(f"_before_{n}") for n in names], "_rows"
        )
        pending.append(rest.filter(F.col("_rows") <= small).drop("_rows"))
        intervals = _measured(rest.filter(F.col("_rows") > small).drop("_rows"), kept)
        turn += 1
        if intervals.isEmpty():
            break
    last = _measured(materialize(functools.reduce(DataFrame.union, pending)))
    values = _in_intervals(rows, last).groupBy("_group", F.col("_in._id").alias("_id"), "_v").agg(*sums)
    values = values.join(last.drop("_low", "_high"), ["_group", "_id"])
    return [*cells, _running(values, ["_group", "_id"], "_v", names, before=True)]


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float | Column]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, without holding or sorting a large group."""
    return order_statistics(df, by, value, {name: Quantile(q) for name, q in probs.items()})
