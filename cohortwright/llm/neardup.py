"""Near-duplicate documents by MinHash: universal hash minima, bands, signature check, exact check, components.

A document's set holds the hashes of its distinct k-word shingles (fewer words: the whole sequence as one;
no words: empty and linked with nothing). Documents with equal sets are one class from the start, so exact
copies never meet in pairs. Each class takes BANDS x ROWS minima of multiply-add hashes; two sets with
similarity 0.8 miss each other in all bands with probability (1 - 0.8^5)^45 < 2e-8; lower similarities are refused.

1. In each band bucket every class is paired with the least one (a star, as many pairs as members). Pairs
   whose sizes or signatures exclude the similarity (five standard deviations) go; the rest is confirmed on
   the full sets of both texts. Components come from alternating large-star and small-star.
2. In ROUNDS rounds each bucket that still holds several components takes two pivots, drawn anew: members outside
   its largest component are tested against one of that, its members against one of another. A round has as many
   pairs as members.
3. Members of buckets that stay mixed keep the rarest of their shingles, as many as sets need to share one if they
   have the similarity (prefix filter). A member none of whose rarest shingles a member of another component
   has among its own can have no link left and goes. What remains of a bucket compares the members outside
   its largest component with all others, in blocks of BLOCK inside tasks, by signatures and by full sets folded
   to 32 bits; pairs within reach of the threshold are confirmed. So no link is lost for having met only beside a pivot, and rows
   grow with the texts, not with the square of a group.

Stored tables are deleted once nothing reads them. Null and empty texts: set size 0, own component. Equal and repeated
rows: one class. A null ``doc_id`` can't name a component; it takes the least id of its component, or null. Empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined_roots
from .filters import build_filter, count_table, counts_of, passes
from .store import discard, keyed, materialize, text_key, texts, whole
from .words import SPACED, Words, chunks, cut, grams, mix, signed

ROWS, BANDS, BLOCK = 5, 45, 512
ROUNDS = 1
HASHES = ROWS * BANDS
_random = np.random.default_rng(20)
_FACTOR = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents in a row, and each document's first place in it."""
    h = words.hashes()
    g = grams(h, k)
    out, ends = [], [0]
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if b - a >= k:
            mine = np.sort(g[a : b - k + 1])
            mine = mine[np.concatenate(([True], mine[1:] != mine[:-1]))]
        elif b > a:
            mine = grams(h[a:b], b - a, seed=b - a + 1)
        else:
            mine = h[:0]
        out.append(mine)
        ends.append(ends[-1] + len(mine))
    return np.concatenate(out) if out else h[:0], np.array(ends)


_SKETCH = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()),
    ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("mins", pa.binary()),
])
_SKETCH_SQL = "uid bigint, doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>, mins binary"


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            all_, ends = sets(cut(part.column("text"), SPACED, lower=True), k)
            size = np.diff(ends)
            full = np.flatnonzero(size)
            mins = np.zeros((HASHES, part.num_rows), np.uint32)
            if len(full):
                x = (all_ >> np.uint64(32)).astype(np.uint32)
                for i in range(HASHES):
                    mins[i, full] = np.minimum.reduceat(x * _FACTOR[i] + _SHIFT[i], ends[full])
            bands = np.zeros((BANDS, part.num_rows), np.uint64)
            for b in range(BANDS):
                key = np.full(part.num_rows, b + 1, np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[b * ROWS + r])
                bands[b] = key
            bands, low = np.ascontiguousarray(bands.T), np.ascontiguousarray((mins & 255).astype(np.uint8).T)
            digest = [hashlib.blake2b(all_[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("uid"), part.column("doc_id"), part.column("text_hash"), pa.array(size.astype(np.int64)), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(signed(bands.ravel()))),
                    pa.array([row.tobytes() for row in low], pa.binary()),
                ],
                schema=_SKETCH,
            )


def least_agreement(threshold: float) -> int:
    """Equal signature bytes that a pair at the threshold has but for five standard deviations."""
    return int(HASHES * threshold - 5 * (HASHES * threshold * (1 - threshold)) ** 0.5)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), HASHES)


def _likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    least = least_agreement(threshold)
    for batch in batches:
        if batch.num_rows:
            equal = (_bytes(batch.column("mins_a")) == _bytes(batch.column("mins_b"))).sum(axis=1)
            yield batch.filter(pa.array(equal >= least)).select(["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text_a"):
            (x, at), (y, there) = (sets(cut(part.column(c), SPACED, lower=True), k) for c in ("text_a", "text_b"))
            linked = []
            for i in range(part.num_rows):
                a, b = x[at[i] : at[i + 1]], y[there[i] : there[i + 1]]
                both = np.concatenate((a, b))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield part.filter(pa.array(linked, pa.bool_())).select(["a", "b"])


def _passing(batches: Iterator[pa.RecordBatch], key: str, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column(key).to_numpy(zero_copy_only=False).view(np.uint64)
        yield batch.filter(pa.array(passes(bits, h)))


def _held(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            x, at = sets(cut(part.column("text"), SPACED, lower=True), k)
            held = pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("root"), held], names=["uid", "root", "held"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, n = np.unique(np.frombuffer(b"".join(batch.column("held").to_pylist()), np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], counts: Broadcast, percent: int) -> Iterator[pa.RecordBatch]:
    """The shingles that come first by count and hash: any two sets with the similarity share one of theirs."""
    for batch in batches:
        out = []
        for held in batch.column("held").to_pylist():
            h = np.frombuffer(held, np.uint64)
            out.append(signed(h[np.lexsort((h, counts_of(counts.value, h)))[: len(h) + (-percent * len(h)) // 100 + 1]]))
        for start in range(0, len(out), 256):
            mine = out[start : start + 256]
            places = np.repeat(np.arange(start, start + len(mine)), [len(m) for m in mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(pa.array(places)), batch.column("root").take(pa.array(places)), pa.array(np.concatenate(mine))], names=["uid", "root", "h"]
            )


def _similar(one: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether sorted 32-bit sets come within 0.01 of the threshold; folding to 32 bits changes that little."""
    size = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    shared = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(size) - size)
    return shared >= (threshold - 0.01) * (size + len(one) - shared)


def _across(table: pa.Table, threshold: float) -> pa.Table:
    """Pairs that first meet in this bucket, of a block of members outside its largest component and a block of all.

    Pairs are of different components, with signatures close enough and about the similarity on folded sets.
    """
    least, table = least_agreement(threshold), table.combine_chunks()
    mins = _bytes(table.column("mins"))
    root, uid, size = (table.column(c).to_numpy() for c in ("root", "uid", "n_shingles"))
    asks, minor = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "minor"))
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    mine = int((bands[0] == table.column("key")[0].as_py()).argmax())
    folded = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32) for x in table.column("held").to_pylist()]  # still sorted
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    found: list[list[np.ndarray]] = [[], []]
    for p in left:
        # Two members that both ask meet once.
        to = right[(root[right] != root[p]) & (~minor[right] | (uid[right] > uid[p]))]
        to = to[np.minimum(size[to], size[p]) >= threshold * np.maximum(size[to], size[p]) - 1e-9]
        near = to[(mins[to] == mins[p]).sum(axis=1) >= least]
        if len(near):
            near = near[~(bands[near, :mine] == bands[p, :mine]).any(axis=1)]
        if len(near):
            near = near[_similar(folded[p], [folded[q] for q in near], threshold)]
        found[0].append(np.full(len(near), uid[p]))
        found[1].append(uid[near])
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


class _Graph:
    """Classes of equal sets and what is needed to test pairs of them."""

    def __init__(self, docs: DataFrame, k: int, percent: int, log2_bits: int):
        self.k, self.percent, self.threshold = k, percent, percent / 100
        self.docs = texts(docs).withColumn("text_hash", text_key(F.col("text")))
        self.rows = materialize(keyed(self.docs).mapInArrow(lambda it: _sketches(it, k), _SKETCH_SQL))
        same = self.rows.filter("n_shingles > 0").groupBy("digest")
        self.classes = materialize(
            same.agg(
                F.min("uid").alias("uid"), F.min_by(F.struct("doc_id", "text_hash"), "uid").alias("of"), F.any_value("n_shingles").alias("n_shingles"),
                F.any_value("bands").alias("bands"), F.any_value("mins").alias("mins"),
            )
        )
        self.log2_bits = log2_bits

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes that sizes and signatures allow."""
        side, threshold = self.classes.select("uid", "n_shingles", "mins"), self.threshold
        a = side.select(F.col("uid").alias("a"), F.col("n_shingles").alias("n_a"), F.col("mins").alias("mins_a"))
        b = side.select(F.col("uid").alias("b"), F.col("n_shingles").alias("n_b"), F.col("mins").alias("mins_b"))
        sized = pairs.join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        return sized.select("a", "b", "mins_a", "mins_b").mapInArrow(lambda it: _likely(it, threshold), "a bigint, b bigint")

    def text_of(self, nodes: DataFrame) -> DataFrame:
        """Stored (uid, text) of the distinct classes ``uid``."""
        wanted = materialize(self.classes.join(nodes, "uid").select("uid", "of.doc_id", "of.text_hash"))
        bits = build_filter(wanted.withColumn("h", F.xxhash64("text_hash")), "h", self.log2_bits)
        held = self.docs.withColumn("h", F.xxhash64("text_hash"))
        held = held.mapInArrow(lambda it: _passing(it, "h", bits), held.schema).drop("h").alias("d")
        match = F.col("w.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("w.text_hash") == F.col("d.text_hash"))
        # Repeated rows give the same text, so any of them serves.
        found = materialize(wanted.alias("w").join(held, match).select("uid", "text").dropDuplicates(["uid"]))
        discard(wanted)
        return found

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Stored pairs (a, b) whose full sets have the similarity."""
        text = self.text_of(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct())
        a, b = (text.select(F.col("uid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        k, percent = self.k, self.percent
        linked = materialize(pairs.join(a, "a").join(b, "b").mapInArrow(lambda it: _confirmed(it, k, percent), "a bigint, b bigint"))
        discard(text)
        return linked

    def roots(self) -> DataFrame:
        """Stored (node, root) of all classes that are linked with another."""
        bucket = self.classes.select("uid", F.explode("bands").alias("key"))
        shared = bucket.groupBy("key").agg(F.min("uid").alias("least"), F.count("*").alias("n")).filter("n > 1")
        members = materialize(bucket.join(shared, "key"))
        stars = members.filter("uid != least").select(F.col("least").alias("a"), F.col("uid").alias("b")).distinct()
        tested = [materialize(self.near(stars))]
        links = self.confirmed(tested[0])
        members, all_members = materialize(members.filter("n > 2").select("uid", "key")), members
        discard(all_members)
        roots = components(links)
        discard(links)
        for n in range(ROUNDS + 1):
            placed = self.mixed(members, roots)
            across = self.pivots(placed, n) if n < ROUNDS else self.across(placed)
            for earlier in tested:
                across = across.join(earlier, ["a", "b"], "left_anti")
            across = materialize(self.near(across) if n < ROUNDS else across)
            new = None if across.isEmpty() else self.confirmed(across)
            discard(members, *([] if n < ROUNDS else [placed]))
            members = placed  # buckets of one component stay so
            tested.append(across)
            if new is not None and not new.isEmpty():
                before, roots = roots, joined_roots(roots, new)
                discard(before)
            discard(new)
        discard(*tested)
        return roots

    def mixed(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Stored (uid, key, root) of the members of buckets that hold several components."""
        placed = members.select("uid", "key").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        return materialize(placed.join(placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1"), "key").select("uid", "key", "root"))

    def pivots(self, placed: DataFrame, n: int) -> DataFrame:
        """One pair (a, b) at most for each member of a bucket, with a member of another component drawn for round ``n``."""
        drawn = F.xxhash64("uid", F.lit(n))
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("m"), F.min_by("uid", drawn).alias("pivot"))
        other = F.struct(F.xxhash64("root", F.lit(n)).alias("h"), "root", "pivot")
        parts = parts.groupBy("key").agg(F.max(F.struct("m", "root", "pivot")).alias("main"), F.min(other).alias("one"), F.max(other).alias("two"))
        second = F.when(F.col("one.root") != F.col("main.root"), F.col("one.pivot")).otherwise(F.col("two.pivot"))
        parts = parts.select("key", F.col("main.root").alias("main"), F.col("main.pivot").alias("first"), second.alias("second"))
        to = F.when(F.col("root") == F.col("main"), F.col("second")).otherwise(F.col("first"))
        return placed.join(parts, "key").select(F.least("uid", to).alias("a"), F.greatest("uid", to).alias("b")).distinct()

    def across(self, placed: DataFrame) -> DataFrame:
        """Likely pairs (a, b) between the components that a bucket still holds, all of them."""
        k, percent, threshold = self.k, self.percent, self.threshold
        roots = placed.select("uid", "root").distinct()
        text = self.text_of(roots.select("uid"))
        held = materialize(text.join(roots, "uid").mapInArrow(lambda it: _held(it, k), "uid bigint, root bigint, held binary"))
        discard(text)
        counts = count_table(held.select("held").mapInArrow(_shingles, "h bigint, n bigint"), "h")
        counts = placed.sparkSession.sparkContext.broadcast(counts)  # 2^20 numbers
        rarest = held.mapInArrow(lambda it: _rarest(it, counts, percent), "uid bigint, root bigint, h bigint")
        meet = rarest.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("h")
        live = materialize(rarest.join(meet, "h").select("uid").distinct())
        rest = self.mixed(placed.join(live, "uid", "left_semi"), held.select(F.col("uid").alias("node"), "root"))
        parts = rest.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("m"))
        rest = rest.join(parts, "key").withColumn("minor", F.col("root") != F.col("main.root"))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        of_all, of_minors = blocks(F.col("m")), blocks(F.col("m") - F.col("main.m"))
        turn = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
        # Members that ask go to every block of all, and all members to every block of those that ask.
        ask = rest.filter("minor").select("*", turn(of_minors).alias("i"), F.explode(F.sequence(F.lit(0), of_all - 1)).alias("j"), F.lit(True).alias("asks"))
        rest = ask.union(rest.select("*", F.explode(F.sequence(F.lit(0), of_minors - 1)).alias("i"), turn(of_all).alias("j"), F.lit(False).alias("asks")))
        facts = self.classes.select("uid", "n_shingles", "mins", "bands").join(held.select("uid", "held"), "uid")
        rest = rest.select("uid", "key", "root", "minor", "i", "j", "asks").join(facts, "uid")
        return rest.groupBy("key", "i", "j").applyInArrow(lambda t: _across(t, threshold), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, log2_bits: int = 24) -> DataFrame:
    """Per document row: uid, doc_id, text_hash, n_shingles, component_id, first (the one row of its component to keep).

    ``percent``: the least similarity, 80 to 100; the bands are made for 80.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands find pairs of a similarity of 80 % or more")
    graph = _Graph(docs, k, percent, log2_bits)
    roots = graph.roots()
    placed = graph.classes.select("uid", "digest").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    placed = placed.select("digest", F.coalesce("root", "uid").alias("root"))
    rows = graph.rows.select("uid", "doc_id", "text_hash", "n_shingles", "digest").join(placed, "digest", "left")
    rows = materialize(rows.withColumn("root", F.coalesce("root", "uid")).drop("digest"))
    discard(graph.rows, graph.classes, roots)
    best = rows.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best")
    )
    return rows.join(best, "root").select(
        "uid", "doc_id", "text_hash", "n_shingles", "component_id", (F.col("best.uid") == F.col("uid")).alias("first")
    )


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each near-duplicate component left, all columns kept, whatever their names."""
    kept = near_duplicates(docs, k, percent).filter("first").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    own = whole(docs).select("doc_id", text_key(F.col("text")).alias("text_hash"), "row")
    same = own["doc_id"].eqNullSafe(F.col("kept_id")) & (own["text_hash"] == F.col("kept_hash"))
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*")
