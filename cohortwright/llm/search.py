"""Ranked lexical search of many queries at once, with their common parts evaluated once.

1. Queries are dealt into blocks of about BLOCK_TERMS terms. Each block is mined for shared term sets: terms that occur
   in exactly the same items are one atom; each item's shared atoms, most frequent first, are a way in a prefix tree,
   and what two ways share is one node. Nodes, atoms and items make the block's query-sharing DAG.
2. For each block all documents are scanned once: postings of the block's terms are stored, corpus counts (documents N,
   terms L, document frequency of each term) come from them.
3. Tasks score documents against the whole block: a term's contribution goes to its atom's accumulator, a node's
   accumulator is its parent's plus its atom's, an item's score its deepest shared node's plus its own atoms'. Each partial
   accumulator is computed once for a run of documents, whatever number of items use it. Tasks keep each item's best
   k; a window over those gives the ranks.

A block's plan has a bounded size, and so have the accumulators of a run. Words are compared by 64-bit hashes. Null and empty texts have no terms: such
documents count in nothing, such items give no rows. Equal scores go by ascending doc_id, null last; repeated items and documents
each stand for themselves. Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keyed, materialize, texts
from .words import PLAIN, chunks, cut

BLOCK_TERMS = 32_768
RUN_CELLS = 1 << 22  # accumulator cells of one run of documents


@dataclass
class Plan:
    """The sharing DAG of a block of items; nodes follow their parents."""

    terms: np.ndarray  # hashes, sorted
    atom: np.ndarray  # each term's atom
    parent: list[int]  # each node's parent node, or -1
    added: list[int]  # each node's own atom
    items: list[tuple[int, int, list[int]]]  # uid, deepest shared node or -1, atoms of the item's own

    def packed(self) -> bytes:
        return pickle.dumps((self.terms, self.atom, self.parent, self.added, self.items))

    @classmethod
    def unpacked(cls, data: bytes) -> Plan:
        return cls(*pickle.loads(data))

    @property
    def n_atoms(self) -> int:
        return int(self.atom.max()) + 1 if len(self.atom) else 0

    @classmethod
    def mine(cls, items: dict[int, list[int]]) -> Plan:
        """From the distinct term hashes of each item."""
        holders: dict[int, list[int]] = defaultdict(list)
        for uid in sorted(items):
            for term in items[uid]:
                holders[term].append(uid)
        terms = np.array(sorted(holders), np.uint64)
        atoms: dict[tuple[int, ...], int] = {}
        atom = np.array([atoms.setdefault(tuple(holders[t]), len(atoms)) for t in terms.tolist()], np.int64)
        ways: dict[int, list[int]] = defaultdict(list)
        for held, a in sorted(atoms.items(), key=lambda x: (-len(x[0]), x[1])):
            for uid in held:
                ways[uid].append(a)
        widely = {a for held, a in atoms.items() if len(held) > 1}
        # How many items go along each prefix of shared atoms.
        used: Counter[tuple[int, int]] = Counter()
        node_of: dict[tuple[int, int], int] = {}
        trail: dict[int, list[int]] = {}
        for uid in sorted(ways):
            at, trail[uid] = -1, []
            for a in ways[uid]:
                if a not in widely:
                    break
                at = node_of.setdefault((at, a), len(node_of))
                trail[uid].append(at)
                used[at] += 1
        keep = {n: i for i, n in enumerate(sorted(n for n in used if used[n] > 1))}
        steps = {n: step for step, n in node_of.items() if n in keep}
        parent, added = [], []
        for n in sorted(keep):
            parent.append(keep.get(steps[n][0], -1))
            added.append(steps[n][1])
        planned = []
        for uid in sorted(ways):
            shared = [keep[n] for n in trail[uid] if n in keep]
            planned.append((uid, shared[-1] if shared else -1, ways[uid][len(shared) :]))
        return cls(terms, atom, parent, added, planned)

    def scores(self, run: int, doc: np.ndarray, term: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Every item's score of ``run`` documents, from (document, term, contribution)."""
        atoms = np.zeros((self.n_atoms, run), np.int64)
        np.add.at(atoms, (self.atom[term], doc), gain)
        nodes = np.zeros((len(self.parent) + 1, run), np.int64)  # the last row stands for no node
        for i, (parent, atom) in enumerate(zip(self.parent, self.added)):
            np.add(nodes[parent], atoms[atom], out=nodes[i])
        out = np.empty((len(self.items), run), np.int64)
        for row, (_, node, own) in zip(out, self.items):
            row[:] = nodes[node]
            for a in own:
                row += atoms[a]
        return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = cut(part.column("text"), PLAIN, lower=True)
            h, at = words.hashes(), words.offsets
            terms = [np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("item_id"), pa.array(terms, pa.list_(pa.int64()))], names=["uid", "item_id", "terms"])


def _mined(block: pa.Table) -> pa.Table:
    items = {uid: np.array(terms, np.int64).view(np.uint64).tolist() for uid, terms in zip(block.column("uid").to_pylist(), block.column("terms").to_pylist())}
    return pa.table({"block": block.column("block")[:1], "plan": pa.array([Plan.mine(items).packed()], pa.binary())})


_POSTINGS_SQL = "uid bigint, doc_id bigint, n bigint, term array<int>, tf array<int>"
_POSTINGS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def _postings(batches: Iterator[pa.RecordBatch], terms: Broadcast) -> Iterator[pa.RecordBatch]:
    wanted = terms.value
    for batch in batches:
        for part in chunks(batch):
            words = cut(part.column("text"), PLAIN, lower=True)
            h = words.hashes()
            at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
            hit = wanted[at] == h
            code, tf = np.unique(words.doc_of()[hit] * len(wanted) + at[hit], return_counts=True)
            doc, term = np.divmod(code, len(wanted))
            place = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("uid"), part.column("doc_id"), pa.array(words.per_doc.astype(np.int64)),
                    pa.ListArray.from_arrays(place, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(place, pa.array(tf.astype(np.int32))),
                ],
                schema=_POSTINGS,
            )


class _Best:
    """Each item's best k documents of a task so far."""

    def __init__(self, k: int):
        self.k = k
        self.rows: dict[int, tuple[np.ndarray, ...]] = {}

    def take(self, item: int, score: np.ndarray, doc_id: np.ndarray, absent: np.ndarray, uid: np.ndarray) -> None:
        least = max(1, int(np.partition(score, -self.k)[-self.k])) if len(score) > self.k else 1
        near = np.flatnonzero(score >= least)
        if not len(near):
            return
        new = (score[near], absent[near], doc_id[near], uid[near])
        if item in self.rows:
            new = tuple(np.concatenate(x) for x in zip(self.rows[item], new))
        order = np.lexsort((new[3], new[2], new[1], -new[0]))[: self.k]
        self.rows[item] = tuple(x[order] for x in new)


_FOUND_SQL = "item bigint, uid bigint, doc_id bigint, score bigint"


def _ranked(batches: Iterator[pa.RecordBatch], plan: Broadcast, weights: Broadcast, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    dag, w, best = Plan.unpacked(plan.value), weights.value, _Best(k)
    rows = dag.n_atoms + len(dag.parent) + len(dag.items) + 1
    run = max(1, RUN_CELLS // rows)
    for batch in batches:
        for start in range(0, batch.num_rows, run):
            part = batch.slice(start, run)
            n = part.column("n").to_numpy()
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            term, tf = (pc.list_flatten(part.column(c)).to_numpy().astype(np.int64) for c in ("term", "tf"))
            doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("term")).to_numpy())
            scores = dag.scores(part.num_rows, doc, term, w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])))
            absent = pc.is_null(part.column("doc_id")).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(part.column("doc_id"), 0).to_numpy()
            uid = part.column("uid").to_numpy()
            for (item, _, _), score in zip(dag.items, scores):
                best.take(item, score, ids, absent, uid)
    for item, (score, absent, ids, uid) in best.rows.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(uid), item)), pa.array(uid), pa.array(ids, mask=absent), pa.array(score)], names=["item", "uid", "doc_id", "score"]
        )


def _weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def plans(queries: DataFrame, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(uid, item_id) of the queries, and (block, plan) of their blocks; both stored."""
    own = keyed(queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")))
    items = materialize(own.select("uid", "item_id", "text").mapInArrow(_item_terms, "uid bigint, item_id bigint, terms array<bigint>"))
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    block = F.pmod(F.xxhash64("uid"), F.lit(-(-total // block_terms) or 1)).alias("block")
    mined = items.filter(F.size("terms") > 0).select("uid", "terms", block).groupBy("block").applyInArrow(_mined, "block bigint, plan binary")
    return items.select("uid", "item_id"), materialize(mined)


def _search_block(docs: DataFrame, plan: bytes, k: int) -> DataFrame:
    """(item, uid, doc_id, score): the best k documents of each task for every item of a block."""
    context = docs.sparkSession.sparkContext
    wanted = Plan.unpacked(plan).terms
    terms = context.broadcast(wanted)
    held = materialize(docs.mapInArrow(lambda it: _postings(it, terms), _POSTINGS_SQL).filter("n > 0"))
    n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
    seen = {r.term: r.df for r in held.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    # Only the block's own terms come back, at most as many as the block holds.
    weights = context.broadcast(np.array([_weight(seen.get(i, 0), n_docs) for i in range(len(wanted))], np.int64))
    sent = context.broadcast(plan)
    return held.filter(F.size("term") > 0).mapInArrow(lambda it: _ranked(it, sent, weights, n_docs, n_terms, k), _FOUND_SQL)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    items, blocks = plans(queries, block_terms)
    own = keyed(texts(docs)).select("uid", "doc_id", "text")
    found = None
    for row in blocks.orderBy("block").toLocalIterator():
        part = _search_block(own, row.plan, k)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND_SQL)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid")]
    for by in (["item", F.pmod(F.xxhash64("uid"), F.lit(64))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return found.join(items.withColumnRenamed("uid", "item"), "item").select("item_id", "rank", "doc_id", "score")
