"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Targets: the budget is a share of all words; a source's part is proportional to its weight and stops at twice its
size. The stops are found by water-filling: sources in the order of stop / weight are full up to a level that two
running sums give, exactly as if the excess had been reshared until none is above.

Rounding: a document of a source with target / size = n + p is taken n times and once more with probability p. The
pivotal method settles these fractions in pairs: two documents exchange word mass, in a random direction with
chances that keep both expectations, until one of them is at 0 or 1. So the words of a source are kept exactly in
every step, and only its last unsettled document is rounded to the nearer side.

The pairs form a reduction tree. Documents of similar size are dealt by hash into blocks of about BLOCK rows
(a source that holds most rows has more blocks); each block settles all but one document, the residual. Residuals
form the blocks of the next level, until a source has one. A level shrinks the rows BLOCK times, and no block
grows with the data. Random numbers are hashes of id, text, level and seed, so reruns agree under any
partitioning. Rows that repeat id, text and source are numbered first and dealt by their number, too.

A null source is a source of its own, last in order. Null and empty texts have size 0 and are never taken. Repeated
rows take part one by one. An empty table, or one without words, gives no rows or zero targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwright.operators.distributed import number_rows, running_totals

from .quality import words_of
from .store import materialize, numbered_copies, text_key, whole

WEIGHTS, SHARE, STOP = (5, 2, 1), 1.5, 2
BLOCK = 512


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, stop: float = STOP) -> DataFrame:
    """(source, source_size, target) from stored rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sources.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(float(stop))})
    filled = materialize(
        running_totals(
            ranked.withColumn("level", F.col("most") / F.col("weight")), [], ["level", "rank"],
            {"full": F.col("most"), "weights": F.col("weight")}, totals=True,
        )
    )
    budget = F.lit(share) * F.col("full_total") / F.lit(float(stop))
    # The level at which the sources before this one are full and the others share the rest by weight.
    level = (budget - (F.col("full") - F.col("most"))) / (F.col("weights_total") - (F.col("weights") - F.col("weight")))
    found = filled.filter(level <= F.col("level")).agg(F.min_by(level, F.struct("level", "rank")).alias("water"))
    # One row, so no pair is made twice.
    water = found.first()
    water = water[0] if water and water[0] is not None else float("inf")
    return filled.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(water)).alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) fixed by its arguments."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _settle(items: Column) -> Column:
    """Folds a block of (size, p, u, row) into settled (row, extra) and at most one unsettled item."""
    item = "struct<size:double,p:double,u:double,row:bigint,order:bigint>"
    done = F.array().cast("array<struct<row:bigint,extra:int>>")
    start = F.struct(F.lit(None).cast(item).alias("open"), done.alias("done"))

    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        moved = F.when(b["u"] * (up + down) < down, up).otherwise(-down)

        def split(pair: Column) -> Column:
            one, two = pair["one"], pair["two"]
            settled = lambda x: (x["p"] <= 1e-12) | (x["p"] >= 1 - 1e-12)
            out = lambda x: F.struct(x["row"].alias("row"), F.round(x["p"]).cast("int").alias("extra"))
            return F.struct(
                F.when(~settled(one), one).when(~settled(two), two).alias("open"),
                F.concat(
                    F.when(settled(one), F.array(out(one))).otherwise(done),
                    F.when(settled(two), F.array(out(two))).otherwise(done),
                ).alias("new"),
            )

        def with_p(x: Column, p: Column) -> Column:
            return F.struct(x["size"].alias("size"), p.alias("p"), x["u"].alias("u"), x["row"].alias("row"), x["order"].alias("order"))

        pair = F.struct(with_p(a, a["p"] + moved / a["size"]).alias("one"), with_p(b, b["p"] - moved / b["size"]).alias("two"))
        after = F.get(F.transform(F.array(pair), split), 0)
        joined = F.get(F.transform(F.array(after), lambda x: F.struct(x["open"].alias("open"), F.concat(state["done"], x["new"]).alias("done"))), 0)
        return F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).otherwise(joined)

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, stop: float = STOP, seed: int = 11) -> DataFrame:
    """Per document row: row, doc_id, text_hash, size, source_size, target, copies (times taken) and taken (words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.col("source").cast("string").alias("source"), F.size(words_of(text)).cast("bigint").alias("size"),
    )
    rows = materialize(numbered_copies(materialize(rows), "row", ["doc_id", "text_hash", "source"], "copy"))
    source_rows = materialize(targets(rows, weights, share, stop).withColumn("source_hash", F.xxhash64("source", F.col("source").isNull())))
    # One row for each source: adaptive execution broadcasts it when it is small, and splits hot sources otherwise.
    own = source_rows.alias("s")
    joined = rows.alias("r").join(own, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "source_size", "target", "source_hash")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(ratio + 1e-12).cast("int")
    joined = joined.withColumns({"base": base, "p": F.greatest(F.lit(0.0), ratio - base)})
    joined = materialize(joined)
    open_ = joined.filter((F.col("p") > 1e-12) & (F.col("size") > 0)).select(
        "source_hash", F.col("size").cast("double").alias("size"), "p", "row", F.xxhash64("doc_id", "text_hash", "copy").alias("order")
    )
    settled, level = [], 0
    while True:
        # One row for each source and size class, however many documents they have.
        # Classes widen with the level, so every level has fewer rows than the one before.
        placed = open_.withColumn("class", F.floor(F.log2("size") * (4 / 4**level)).cast("int"))
        counts = placed.groupBy("source_hash", "class").agg(F.count("*").alias("n"))
        counts = counts.withColumn("of_source", F.sum("n").over(Window.partitionBy("source_hash")))
        # A source that fits one block is one, so that small documents can settle its large ones.
        whole = F.col("of_source") <= BLOCK
        blocks = F.when(whole, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK))
        placed = placed.join(counts, ["source_hash", "class"]).withColumns({
            "block": F.pmod(F.xxhash64("order", F.lit(level)), blocks).cast("int"), "class": F.when(whole, F.lit(0)).otherwise(F.col("class")),
        })
        # Large documents first, so that the last unsettled one tends to be small.
        item = F.struct((-F.col("size")).alias("last"), "order", "row", "p", _unit(F.col("order"), F.lit(seed), F.lit(level)).alias("u"))
        folded = placed.groupBy("source_hash", "class", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
        items = F.transform("items", lambda x: F.struct((-x["last"]).alias("size"), *[x[c].alias(c) for c in ("p", "u", "row", "order")]))
        state = materialize(folded.select("source_hash", _settle(items).alias("state")))
        settled.append(state.select(F.explode("state.done").alias("d")).select("d.row", "d.extra"))
        open_ = state.filter("state.open is not null").select("source_hash", *[f"state.open.{c}" for c in ("size", "p", "row", "order")])
        most = open_.groupBy("source_hash").count().agg(F.max("count")).first()[0]
        level += 1
        if (most or 0) <= 1:
            break
    settled.append(open_.select("row", F.round("p").cast("int").alias("extra")))
    extra = settled[0]
    for s in settled[1:]:
        extra = extra.union(s)
    copies = F.col("base") + F.coalesce("extra", F.lit(0))
    return joined.join(extra, "row", "left").select(
        "row", "doc_id", "text_hash", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken")
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns kept."""
    chosen = mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("taken_id"), F.col("text_hash").alias("taken_hash"), "copies")
    # Repeated rows (id and text) are exchangeable: their copies add up and are shared out again.
    chosen = chosen.groupBy("taken_id", "taken_hash").agg(F.sum("copies").alias("copies"))
    own = whole(docs).select("doc_id", text_key(F.col("text")).alias("text_hash"), "row").dropDuplicates(["doc_id", "text_hash"])
    match = own["doc_id"].eqNullSafe(F.col("taken_id")) & (own["text_hash"] == F.col("taken_hash"))
    repeated = own.join(chosen, match).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("row.*")
