"""Benchmark decontamination by winnowing.

Every document and item keeps the least of each ``w`` neighbouring ``k``-word hashes. Two texts that share
``t = k + w - 1`` consecutive words share all hashes of some such neighbourhood, so they keep the same one of
them: a join of kept hashes misses no shared span of t words. A hit carries the words around it (at most
t - k on either side), is compared word by word, and is extended to the longest shared span there. Every
shared window of t words lies within that reach of the hash both sides kept, so the union of the extended
hits is exactly the union of all shared windows.

* Items shorter than t words are one window of their own length and get their own k and w.
* Kept hashes of documents are sent on only if the items' filter (fixed size) lets them pass.
* Null or empty texts have no words and no hits. Repeated document rows are judged one by one; repeated
  item rows count once. An item without an id is written as ``null``. Empty tables give empty or hitless
  results. Other columns are ignored.
* A hash that very many documents hold (a popular passage) is one key of a sort-merge join whose hot
  document side adaptive execution splits; the item side has one row per place in the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import build_filter, passes
from .store import EMPTY_SHA256, keyed, materialize, merged_length, text_key, texts, whole
from .words import PLAIN, Words, chunks, cut, fits, grams, minima, signed

WINDOW = 10
_PLACE = "struct<t:int,h:bigint,at:int,lead:int,around:binary>"


def scheme(t: int) -> tuple[int, int]:
    """Words per hash and hashes per neighbourhood that guarantee spans of t words."""
    k = (t + 1) // 2
    return k, t - k + 1


def _kept(words: Words, hashes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    k, w = scheme(t)
    g = grams(hashes, k, seed=t)
    at = np.flatnonzero(minima(g, fits(words, t), w))
    return at, g[at]


def _place(words: Words, doc: int, t: int, h: int, at: int) -> dict:
    k, w = scheme(t)
    a, b = max(at - w + 1, words.offsets[doc]), min(at + k + w - 1, words.offsets[doc + 1])
    return {"t": t, "h": h, "at": int(at - words.offsets[doc]), "lead": int(at - a), "around": words.joined(a, b)}


def _item_places(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words, rows = cut(part.column("text"), PLAIN, lower=True), []
            length, hashes = words.per_doc, words.hashes()
            for t in range(1, window + 1):
                at, h = _kept(words, hashes, t)
                doc = np.searchsorted(words.offsets, at, side="right") - 1
                mine = np.minimum(length[doc], window) == t
                for p, x, d in zip(at[mine], signed(h[mine]).tolist(), doc[mine]):
                    rows.append({"item_id": part.column("item_id")[int(d)].as_py(), **_place(words, d, t, x, p)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ITEM)


_ITEM = pa.schema([("item_id", pa.string()), ("t", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.binary())])
_DOC = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([f for f in _ITEM if f.name != "item_id"]))),
])
_SPAN = pa.schema([("uid", pa.int64()), ("item_id", pa.string()), ("first", pa.int64()), ("last", pa.int64())])


def _doc_places(batches: Iterator[pa.RecordBatch], lengths: list[int], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = cut(part.column("text"), PLAIN, lower=True)
            hashes = words.hashes()
            places: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for t in lengths:
                at, h = _kept(words, hashes, t)
                may = passes(bits, h)
                at, h = at[may], h[may]
                doc = np.searchsorted(words.offsets, at, side="right") - 1
                for p, x, d in zip(at, signed(h).tolist(), doc):
                    places[d].append(_place(words, d, t, x, p))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("uid", "doc_id", "text_hash")), pa.array(words.per_doc.astype(np.int64)), pa.array(places, _DOC.field("places").type)],
                schema=_DOC,
            )


def extend(mine: list[bytes], at: int, theirs: list[bytes], there: int, k: int) -> tuple[int, int] | None:
    """The longest span equal around the k words at ``at`` and ``there``, as [first, last) of ``mine``."""
    if mine[at : at + k] != theirs[there : there + k]:
        return None
    a, b = 0, k
    while a < at and a < there and mine[at - a - 1] == theirs[there - a - 1]:
        a += 1
    while at + b < len(mine) and there + b < len(theirs) and mine[at + b] == theirs[there + b]:
        b += 1
    return at - a, at + b


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            span = extend(r["around"].split(b" "), r["lead"], r["item_around"].split(b" "), r["item_lead"], scheme(r["t"])[0])
            if span and span[1] - span[0] >= r["t"]:
                base = r["at"] - r["lead"]
                rows.append({"uid": r["uid"], "item_id": r["item_id"], "first": base + span[0], "last": base + span[1]})
        yield pa.RecordBatch.from_pylist(rows, schema=_SPAN)


def shared_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, log2_bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """(documents: uid, doc_id, text_hash, n_words), (spans: uid, item_id, first, last: words of the document that an item has too)."""
    places = materialize(
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda it: _item_places(it, window), "item_id string, t int, h bigint, at int, lead int, around binary")
        .distinct()
    )
    lengths = sorted(r[0] for r in places.select("t").distinct().collect())
    bits = build_filter(places, "h", log2_bits)
    found = materialize(
        keyed(texts(docs).withColumn("text_hash", text_key(F.col("text")))).mapInArrow(
            lambda it: _doc_places(it, lengths, bits), f"uid bigint, doc_id bigint, text_hash bigint, n_words bigint, places array<{_PLACE}>"
        )
    )
    hits = found.select("uid", F.explode("places").alias("p")).select("uid", "p.*")
    theirs = places.select("item_id", "t", "h", F.col("lead").alias("item_lead"), F.col("around").alias("item_around"))
    spans = hits.join(theirs, ["t", "h"]).mapInArrow(_extended, "uid bigint, item_id string, first bigint, last bigint").distinct()
    return found.select("uid", "doc_id", "text_hash", "n_words"), materialize(spans)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted item ids), contaminated, and the merged facts' digest."""
    found, spans = shared_spans(docs, items, window)
    per_doc = spans.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = merged_length(spans, "uid", "n_hit")
    joined = found.join(per_doc.join(hit, "uid"), "uid", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.sha2(F.array_join("items", ","), 256), F.lit(EMPTY_SHA256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any shared window, all columns and repeated rows kept."""
    found, spans = shared_spans(docs, items, window)
    hit = found.join(spans.select("uid").distinct(), "uid").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    own = whole(docs).select("doc_id", text_key(F.col("text")).alias("text_hash"), "row")
    same = own["doc_id"].eqNullSafe(F.col("hit_id")) & (own["text_hash"] == F.col("hit_hash"))
    return own.join(hit, same, "left_anti").select("row.*")
