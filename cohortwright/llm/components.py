"""Connected components by alternating large-star and small-star, on an edge table that is stored each round.

Large-star links every larger neighbour of a node to the least of its neighbourhood; small-star links the
node itself and its smaller neighbours to that least one. Both keep components and need only an aggregate and
an equi-join; a node with very many neighbours is a hot key whose minimum is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (a, b), one row per unordered pair, a < b."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        moved = both.join(least, "node").filter(F.col("other") > F.col("node")).select(F.col("least").alias("a"), F.col("other").alias("b"))
    else:
        lower = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        least = lower.groupBy("node").agg(F.min("other").alias("least"))
        moved = lower.join(least, "node").select(F.col("least").alias("a"), F.col("other").alias("b"))
        moved = moved.union(least.select(F.col("least").alias("a"), F.col("node").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Stored (node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round's edges are deleted once the next ones are stored.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.distinct())
    for _ in range(rounds):
        before, pairs = pairs, materialize(_star(_star(pairs, large=True), large=False))
        discard(before)
        # All is done when every leaf has one centre and no centre is a leaf: components are stars then.
        leaves = pairs.groupBy("b").agg(F.count("*").alias("n"))
        again = leaves.filter("n > 1").select("b").union(leaves.select("b").join(pairs.select(F.col("a").alias("b")), "b", "left_semi"))
        if again.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    own = pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    roots = materialize(pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).union(own))
    discard(pairs)
    return roots


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Stored (node, root) after more links (a, b): components of the old roots that they join, put behind the old ones."""
    old = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    lifted = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = components(lifted)
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    found = materialize(moved.union(up.join(roots, "node", "left_anti").select("node", "root")))
    discard(up)
    return found
