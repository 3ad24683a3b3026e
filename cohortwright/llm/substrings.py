"""Repeated passages by compressed full-text indexes: which words lie in a window that an earlier document has too.

A window is W consecutive words. All occurrences of a window must meet, so documents are cut by content: each
window belongs to the least hash of its k-word grams, and the run of neighbouring windows with the same least
hash forms a segment that goes to that hash's shard. Equal windows have equal least hashes, so they share a shard.

1. Hashes held by one document only can't repeat: a map-side combined aggregate finds the repeated ones, and a
   filter of fixed size lets only segments with such hashes leave the scan.
2. Tasks combine equal segments (least and greatest document) before the shuffle, so copies don't add up in a shard. A hash with very many segments
   is cut into single windows, dealt by their own content, so that no shard holds a hot group.
3. Each shard builds an FM-index of its distinct segments: suffixes sorted to depth W by prefix doubling, their
   Burrows-Wheeler transform in a wavelet matrix with rank directories. The segments stream through it: backward
   search from every word gives matching statistics cut at W, and windows that reach W report their interval of
   suffixes; the least document of that interval is the window's earliest one.
4. Windows whose earliest document precedes the segment's own are joined back to the segment's places.

Documents with equal ``doc_id`` are one document for "smaller". A null id is greater than any other and equals
other nulls. Null and empty texts have no words. Repeated rows give equal rows; empty tables none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import build_filter, passes
from .store import materialize, text_key, texts
from .words import SPACED, Words, chunks, covered, cut, fits, grams, signed

WINDOW, GRAM = 13, 5
HOT = 4096
SEGMENTS_PER_SHARD = 20_000
NO_ID = (1 << 63) - 1


def segments(words: Words, hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window + 1, least gram hash) of each run of windows with one least gram."""
    g, n = grams(hashes, k), len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g[:0]
    least = g[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, g[j : j + n], out=least)
    whole = np.append(fits(words, window)[:n], False)
    starts = np.flatnonzero(whole[:-1] & ~(np.concatenate(([False], whole[:-2] & (least[1:] == least[:-1])))))
    # A run ends before the next one starts, or where windows stop lying in one document.
    stop = np.flatnonzero(whole[:-1] & (~whole[1:] | np.append(least[1:] != least[:-1], True))) + 1
    return starts, stop, least[starts]


def _least_hashes(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = cut(part.column("text"), SPACED, lower=False)
            first, _, h = segments(words, words.hashes(), window, k)
            doc = part.column("doc").to_numpy()[np.searchsorted(words.offsets, first, side="right") - 1]
            # How many documents of this part hold each hash.
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h = h[new]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[start])), pa.array(np.diff(np.append(start, len(h))))], names=["h", "n"])


@dataclass
class _Cut:
    """How documents are cut: window and gram length, and the filters of repeated and of hot hashes."""

    window: int
    k: int
    repeated: np.ndarray
    hot: np.ndarray

    def __call__(self, part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(words, document, first word within all words, route, contents as 32-bit word hashes) of the candidate segments.

        Two windows that differ in one word are taken for equal with a chance of 2^-32.
        """
        words = cut(part.column("text"), SPACED, lower=False)
        hashes = words.hashes()
        first, last, h = segments(words, hashes, self.window, self.k)
        keep = passes(self.repeated, h)
        first, last, h = first[keep], last[keep], h[keep]
        # Hot hashes: every window is a segment of its own, routed by its own words.
        split = passes(self.hot, h)
        counts = np.where(split, last - first, 1)
        which = np.repeat(np.arange(len(h)), counts)
        step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        single = split[which]
        a = first[which] + np.where(single, step, 0)
        b = np.where(single, a + self.window, last[which] + self.window - 1)
        route = h[which]
        if single.any():
            route[single] = grams(hashes, self.window, seed=3)[a[single]]
        raw = (hashes >> np.uint64(32)).astype("<u4")
        contents = [raw[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
        return words, np.searchsorted(words.offsets, a, side="right") - 1, a, route, contents


def key_of(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _unique(batches: Iterator[pa.RecordBatch], cutter: _Cut, held: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Distinct segments of a task with their least and greatest document, sent on whenever ``held`` are gathered."""
    found: dict[bytes, tuple[int, int, int]] = {}

    def out() -> pa.RecordBatch:
        least, most, route = (np.array(x, np.int64) for x in zip(*found.values())) if found else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(least), pa.array(most), pa.array(route)], names=["words", "doc", "last_doc", "route"]
        )

    for batch in batches:
        for part in chunks(batch):
            _, doc, _, route, contents = cutter(part)
            ids = part.column("doc").to_numpy()[doc].tolist()
            for c, d, r in zip(contents, ids, signed(route).tolist()):
                had = found.get(c)
                found[c] = (d, d, r) if had is None else (min(d, had[0]), max(d, had[1]), r)
            if len(found) > held:
                yield out()
                found.clear()
    yield out()


def _places(batches: Iterator[pa.RecordBatch], cutter: _Cut) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words, doc, a, _, contents = cutter(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.column("doc").to_numpy()[doc]), pa.array(part.column("text_hash").to_numpy()[doc]),
                    pa.array((a - words.offsets[doc]).astype(np.int64)), pa.array([key_of(c) for c in contents], pa.binary()),
                ],
                names=["doc", "text_hash", "at", "key"],
            )


class WaveletMatrix:
    """Symbols by bit planes, most significant first; each plane keeps its bits packed with a count every 64 bits."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64)))))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        every = np.arange(1 << self.levels)
        self.begin = self.place(every, np.zeros_like(every))

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[plane][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[plane][word] + np.bitwise_count(inside)

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence leads in the last plane, seen from each symbol."""
        for plane in range(self.levels):
            one = (symbol >> (self.levels - 1 - plane) & 1).astype(bool)
            ones = self._ones(plane, at)
            at = np.where(one, self.zeros[plane] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before ``at``."""
        return self.place(symbol, at) - self.begin[symbol]


class FMIndex:
    """Backward search over word sequences that are separated by symbol 0; suffixes are ordered to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < depth:
            # A suffix that has ended sorts first, like the separator that no pattern holds.
            later = np.zeros(n, np.int64)
            later[: n - width] = rank[width:] + 1
            pair = rank * (n + int(rank.max(initial=0)) + 2) + later
            _, rank = np.unique(pair, return_inverse=True)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(text[self.suffixes - 1])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))))

    def of_symbol(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[symbol], self.first[symbol + 1]

    def extend_left(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)


def least_in_ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for many non-empty ranges, off a table of power-of-two minima."""
    table = [values]
    while len(table[-1]) > 1 and 1 << len(table) <= int((hi - lo).max(initial=1)):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][: len(table[-1]) - half], table[-1][half:]))
    level = np.floor(np.log2(hi - lo)).astype(np.int64)
    out = np.empty(len(lo), values.dtype)
    for x in np.unique(level):
        on = level == x
        out[on] = np.minimum(table[x][lo[on]], table[x][hi[on] - (1 << x)])
    return out


def earliest(contents: list[bytes], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each distinct segment, the least document that holds each of its windows."""
    raw = np.frombuffer(b"".join(contents), "<u4")
    length = np.array([len(c) // 4 for c in contents])
    symbols, coded = np.unique(raw, return_inverse=True)
    owner = np.repeat(np.arange(len(contents)), length)
    text = np.zeros(len(raw) + len(contents) + 1, np.int64)
    at = np.arange(len(raw)) + owner + 1  # one separator stands before each segment
    text[at] = coded + 1
    holder = np.full(len(text), NO_ID)
    holder[at] = docs[owner]
    index = FMIndex(text, window)
    # Windows by their last word; each backward step takes the word before.
    end = np.cumsum(length)
    last = np.flatnonzero(np.arange(len(raw)) - np.repeat(end - length, length) >= window - 1)
    least = docs[owner[last]].copy()
    going = np.arange(len(last))
    lo, hi = index.of_symbol(text[at[last]])
    for step in range(1, window):
        # A suffix range of one place is the window's own; its matching statistics can't reach another segment.
        more = hi - lo > 1
        going, lo, hi = going[more], lo[more], hi[more]
        if not len(going):
            break
        lo, hi = index.extend_left(text[at[last[going] - step]], lo, hi)
    if len(going):
        least[going] = least_in_ranges(holder[index.suffixes], lo, hi)
    return np.split(least, np.cumsum(length - window + 1)[:-1])


def _shard(table: pa.Table, window: int) -> pa.Table:
    """``key`` and each window's earliest document, for the segments in which any document comes later than that."""
    merged: dict[bytes, tuple[int, int]] = {}
    for c, least, most in zip(table.column("words").to_pylist(), table.column("doc").to_pylist(), table.column("last_doc").to_pylist()):
        had = merged.get(c)
        merged[c] = (least, most) if had is None else (min(least, had[0]), max(most, had[1]))
    contents, docs = list(merged), np.array([v[0] for v in merged.values()])
    greatest = np.array([v[1] for v in merged.values()])
    found = earliest(contents, docs, window)
    size = np.array([len(f) for f in found])
    every = np.concatenate(found)
    late = np.flatnonzero(np.minimum.reduceat(every, np.cumsum(size) - size) < greatest)
    return pa.table({"key": pa.array([key_of(contents[i]) for i in late], pa.binary()), "earliest": pa.array([found[i] for i in late], pa.list_(pa.int64()))})


_RESULT_SQL = "doc bigint, text_hash bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _kept(part: pa.RecordBatch, window: int, places: list | None) -> pa.RecordBatch:
    words = cut(part.column("text"), SPACED, lower=False)
    keep = np.ones(len(words.starts), bool)
    for d, at in enumerate(places or ()):
        if at:
            a, b, first = int(words.offsets[d]), int(words.offsets[d + 1]), np.array(at)
            keep[a:b] = ~covered(first, first + window, b - a)
    buffer, offsets = words.spaced(keep)
    digests = [hashlib.sha256(buffer[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    kept = np.diff(np.concatenate(([0], np.cumsum(keep)))[words.offsets])
    names = ["doc", "text_hash", "n_words", "n_removed", "kept_sha256"]
    return pa.RecordBatch.from_arrays(
        [part.column("doc"), part.column("text_hash"), pa.array(words.per_doc.astype(np.int64)), pa.array((words.per_doc - kept).astype(np.int64)), pa.array(digests, pa.string())],
        names=names,
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = GRAM, log2_bits: int = 27) -> DataFrame:
    """(doc, text_hash, at): windows, by first word, that also start in a document with a smaller id."""
    held = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("text_hash"), "text")
    hashes = held.select("doc", "text").mapInArrow(lambda it: _least_hashes(it, window, k), "h bigint, n bigint")
    hashes = materialize(hashes.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    cutter = _Cut(window, k, build_filter(hashes, "h", log2_bits), build_filter(hashes.filter(F.col("n") > HOT), "h", 24))
    candidates = hashes.agg(F.sum("n")).first()[0] or 0
    unique = held.select("doc", "text").mapInArrow(lambda it: _unique(it, cutter), "words binary, doc bigint, last_doc bigint, route bigint")
    shards = max(1, candidates // SEGMENTS_PER_SHARD)
    found = unique.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).drop("route").groupBy("shard")
    found = found.applyInArrow(lambda t: _shard(t.combine_chunks(), window), "key binary, earliest array<bigint>")
    places = held.mapInArrow(lambda it: _places(it, cutter), "doc bigint, text_hash bigint, at bigint, key binary")
    late = places.join(found, "key").select("doc", "text_hash", F.posexplode("earliest").alias("step", "least"), "at")
    return late.filter("least < doc").select("doc", "text_hash", (F.col("at") + F.col("step")).alias("at")).distinct()


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    late = repeated_windows(docs, window).groupBy("doc", "text_hash").agg(F.collect_list("at").alias("places"))
    late = materialize(late)
    bits = build_filter(late.withColumn("h", F.xxhash64("doc", "text_hash")), "h", 24)
    held = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("text_hash"), "text")
    held = held.withColumn("h", F.xxhash64("doc", "text_hash"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free = ~passes(bits, batch.column("h").to_numpy().view(np.uint64))
            for part in chunks(batch.filter(pa.array(free))):
                yield _kept(part, window, None)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column("h").to_numpy().view(np.uint64))))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield _kept(part, window, part.column("places").to_pylist())

    rest = held.mapInArrow(suspect, held.schema).join(late, ["doc", "text_hash"], "left").mapInArrow(marked, _RESULT_SQL)
    out = held.mapInArrow(clean, _RESULT_SQL).union(rest)
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
