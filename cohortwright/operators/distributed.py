"""Building blocks that keep large or skewed groups spread over the cluster.

A window over ``partitionBy(key)`` puts a whole key into one task, and an exact ``percentile`` keeps
every distinct value of a group in one buffer. The helpers here give the same exact answers when a
single key holds a large share of the rows:

* ``running_totals`` / ``number_rows`` range-partition by (key, order), total each range, and add the
  totals of the earlier ranges to a window that only spans one range;
* ``number_by_hash`` does the same for a hash order, where the ranges are known without sampling;
* ``bottom_by_hash`` counts hash prefixes to find a group's first rows in hash order without sorting the group;
* ``lookup_join`` broadcasts a side only after measuring it, and otherwise leaves a shuffled join
  whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwright.functions.arithmetic import as_column

BROADCAST_BYTES = 32 << 20
HASH_BUCKET_BITS = 12

_own_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application for intermediate tables, in ``spark.checkpoint.dir``.

    Where that is unset a local session uses a temporary folder; a cluster, whose executors don't share
    local disks, is refused.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_scratch[app]


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; tables made from them can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: lineage is cut, the size is known."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside go when it ends, not when the driver next collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def stored_size(df: DataFrame) -> int:
    """Bytes that the rows of a stored table take in memory: fixed parts by type, texts and nested values as long as they are."""
    fixed, lengths = 16, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            fixed += 8
        else:
            fixed += 16
            flat = F.col(f"`{f.name}`") if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`").cast("string")
            lengths.append(F.coalesce(F.octet_length(flat), F.lit(0)).cast("bigint"))
    each = functools.reduce(Column.__add__, lengths) if lengths else F.lit(0).cast("bigint")
    rows, texts = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return rows * fixed + texts


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a stored table fits a broadcast, by its measured size."""
    return stored_size(df) <= (BROADCAST_BYTES if limit is None else limit)


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    limit: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Join a computed per-key table onto a large one.

    The table is stored first, so it is computed once and its size can be measured. Within the limit
    it is broadcast and ``big`` is not shuffled; above it the join is a plain equi-join.
    """
    table = table if stored else materialize(table)
    if is_small(table, limit):
        table = F.broadcast(table)
    return big.join(table, on, how)


def _group(by: Sequence[str]) -> Column:
    # One struct key: NULL parts compare equal, so joins and windows agree on missing keys.
    return F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(1).alias("all"))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column | str],
    totals: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order`` within ``by``.

    ``order`` must identify a row within its group for a deterministic result. With ``totals`` each
    group's full sum is added as ``<name>_total``. Rows sharing a group may lie in many partitions.
    """
    order = [as_column(o) for o in order]
    wanted = {name: as_column(c) for name, c in sums.items()}
    staged = df.withColumns({f"_in_{n}": c for n, c in wanted.items()}).withColumn("_group", _group(by))
    placed = materialize(
        staged.repartitionByRange("_group", *order).withColumn("_part", F.spark_partition_id())
    )
    part = placed.groupBy("_group", "_part").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in wanted])
    within = Window.partitionBy("_group")
    earlier = within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(
        "_group",
        "_part",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in wanted],
        *([F.sum(f"_sum_{n}").over(within).alias(f"{n}_total") for n in wanted] if totals else []),
    )
    here = (
        Window.partitionBy("_group", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = placed.join(offsets, ["_group", "_part"])
    out = joined.withColumns(
        {n: F.col(f"_before_{n}") + F.coalesce(F.sum(f"_in_{n}").over(here), F.lit(0)) for n in wanted}
    )
    return out.drop("_group", "_part", *[f"_in_{n}" for n in wanted], *[f"_before_{n}" for n in wanted])


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "row_number", total: bool = False
) -> DataFrame:
    """Row number from 1 in ``order`` within ``by``; ``total`` adds the group size as ``<name>_total``."""
    return running_totals(df, by, order, {name: F.lit(1).cast("bigint")}, totals=total)


def tie_ranks(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[str], name: str) -> DataFrame:
    """Average-tie rank of every row by falling ``score`` within ``by`` (1 is best).

    Rows are range-partitioned by (group, score, ``tie``), so that equal scores spread over as many ranges as they fill.
    Only a range's first and last score can go on in another one: the table of ranges holds how often each occurs
    there, and running sums over it give the peers that a row has outside its range. No row is joined by its score.
    The input is stored first, as ranging samples it before it moves it.
    """
    staged = materialize(df.withColumn("_group", _group(by)).withColumn("_score", F.col(score)))
    placed = materialize(
        staged.repartitionByRange("_group", F.col("_score").desc(), *tie).withColumn("_part", F.spark_partition_id())
    )
    discard(staged)
    ends = placed.groupBy("_group", "_part", "_score").agg(F.count("*").alias("_n"))
    parts = ends.groupBy("_group", "_part").agg(
        F.sum("_n").alias("_rows"),
        F.array_distinct(F.array(F.max(F.struct("_score", "_n")), F.min(F.struct("_score", "_n")))).alias("_ends"),
    )
    within = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    peers = Window.partitionBy("_group", "_end._score")
    shared = parts.withColumn("_end", F.explode("_ends")).select(
        "_group", "_part", "_before", "_end",
        F.coalesce(F.sum("_end._n").over(peers.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
        F.sum("_end._n").over(peers).alias("_all"),
    )
    table = shared.groupBy("_group", "_part").agg(
        F.any_value("_before").alias("_before"), F.collect_list(F.struct(F.col("_end._score").alias("_score"), "_earlier", "_all")).alias("_ends")
    )
    here = Window.partitionBy("_group", "_part").orderBy(F.col("_score").desc())
    joined = lookup_join(placed, table, ["_group", "_part"], "inner").withColumns({
        "_place": F.rank().over(here),
        "_own": F.count("*").over(here.rangeBetween(Window.currentRow, Window.currentRow)),
        "_end": F.get(F.filter("_ends", lambda e: e["_score"].eqNullSafe(F.col("_score"))), F.lit(0)),
    })
    above = F.col("_before") + F.col("_place") - 1 - F.coalesce(F.col("_end._earlier"), F.lit(0))
    peers_ = F.coalesce(F.col("_end._all"), F.col("_own"))
    return joined.withColumn(name, above + (peers_ + 1) / F.lit(2.0)).drop("_group", "_part", "_score", "_before", "_ends", "_place", "_own", "_end")


def number_by_hash(
    df: DataFrame, by: Sequence[str], hash_col: str, tie: Sequence[str], name: str = "row_number", total: bool = False
) -> DataFrame:
    """Row number in hash order within ``by``.

    The hash spreads evenly, so its leading bits cut every group into equal ranges; each group
    contributes at most ``2 ** HASH_BUCKET_BITS`` rows to the table of range sizes.
    """
    staged = df.withColumn("_group", _group(by)).withColumn(
        "_part", F.shiftright(F.col(hash_col), 32 - HASH_BUCKET_BITS).cast("int")
    )
    within = Window.partitionBy("_group")
    earlier = within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_group",
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(within).alias(f"{name}_total")] if total else []),
    )
    here = Window.partitionBy("_group", "_part").orderBy(hash_col, *tie)
    return (
        staged.join(offsets, ["_group", "_part"])
        .withColumn(name, F.col("_before") + F.row_number().over(here))
        .drop("_group", "_part", "_before")
    )


def bottom_by_hash(
    df: DataFrame, by: Sequence[str], hash_col: str, tie: Sequence[str], k: int, most: int = 100_000
) -> DataFrame:
    """The first ``k`` rows of each group by a 32-bit hash, then ``tie``, without sorting the group.

    Rows are counted by prefixes of the hash (partial counts, at most 4,096 per group); the prefix that holds rank ``k``
    cuts the group. Rows before it are in, those after it are out, and only those under it are ordered. While a cut
    prefix holds more than ``most`` rows, longer prefixes divide it; rows that share the whole hash are ranged by ``tie``.
    """
    staged = df.withColumn("_class", _group(by))
    # A group's hash range [_low, _high) still contested, and how many of its rows are in.
    cut = materialize(staged.select("_class").distinct().select(
        "_class", F.lit(0).cast("bigint").alias("_low"), F.lit(1 << 32).cast("bigint").alias("_high"), F.lit(k).cast("bigint").alias("_need"), F.lit(0).cast("bigint").alias("_held")
    ))
    crowded = True
    for shift in (20, 8, 0):
        if not crowded:
            break
        inside = lookup_join(staged.select("_class", F.col(hash_col).alias("_h")), cut, "_class", "inner", stored=True)
        inside = inside.filter((F.col("_h") >= F.col("_low")) & (F.col("_h") < F.col("_high")))
        counts = inside.groupBy("_class", "_need", F.shiftright("_h", shift).alias("_prefix")).agg(F.count("*").alias("_n"))
        running = counts.withColumn(
            "_upto", F.sum("_n").over(Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
        found = running.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need"))).select(
            "_class", F.shiftleft("_prefix", shift).alias("_new"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_n").alias("_in_cut")
        )
        # A group with fewer rows than wanted is in as a whole: nothing of it is contested any more.
        before, cut = cut, materialize(cut.drop("_held").join(found, "_class", "left").select(
            "_class", F.coalesce("_new", "_high").alias("_low"),
            F.when(F.col("_new").isNull(), F.col("_high")).otherwise(F.col("_new") + (1 << shift)).alias("_high"),
            F.coalesce("_left", F.lit(0)).alias("_need"), F.coalesce("_in_cut", F.lit(0)).alias("_held"),
        ))
        discard(before)
        crowded = not cut.filter(F.col("_held") > most).isEmpty()
    placed = lookup_join(staged, cut.drop("_held"), "_class", "inner")
    first = placed.filter(F.col(hash_col) < F.col("_low"))
    contested = placed.filter((F.col(hash_col) >= F.col("_low")) & (F.col(hash_col) < F.col("_high")))
    if crowded:
        numbered = number_rows(contested, ["_class"], [hash_col, *tie], "_place")
    else:
        numbered = contested.withColumn("_place", F.row_number().over(Window.partitionBy("_class").orderBy(hash_col, *tie)))
    chosen = numbered.filter(F.col("_place") <= F.col("_need")).drop("_place")
    return first.unionByName(chosen).drop("_class", "_low", "_high", "_need")


def value_counts(df: DataFrame, by: Sequence[str], value: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Non-missing values of each group with their multiplicity ``n`` (map-side combined)."""
    aggs = [F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in (extra or {}).items()]]
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)
