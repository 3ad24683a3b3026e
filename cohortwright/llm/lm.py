"""Language-model scores by context-tree weighting over bytes, beside a smoothed word-unigram base.

A byte is eight binary decisions, one for each node on its path through a binary tree of the 256 bytes. Every node is
predicted in the contexts of 0 to ``depth`` preceding bytes by Krichevsky-Trofimov estimates, and all depths are
mixed with the weights that context-tree weighting gives them after the training texts: with P_e the estimator's
probability of a context's bits and P_w = (P_e + product of the P_w of its longer contexts) / 2, a context stops
the descent with weight P_e / (2 P_w). A node that training never reached in a context leaves its weight to the
longest context that did reach it. A text starts after ``depth`` start marks (byte FE) and ends with an end mark (FF);
neither byte occurs in UTF-8. The score is the log10 probability of the whole text with its end.

As Spark jobs, no table is broadcast but one of fixed size (256 x 256 nodes) and a line for each 1,024 rows:

1. Documents are stored and dealt into buckets of neighbouring rows by bytes. A bucket sends the distinct words and grams
   (the preceding bytes and the byte itself, 8 bytes at most) it holds with their counts in training texts, as packed
   sorted arrays, one for each part of the keys. A part of the grams holds all contexts with the same last three bytes.
2. A part merges what it got, stores its keys, their counts and which bucket asked for which, and sends a row for each node
   of depth 3. Groups by hash of the last two bytes climb to depth 2; sums give depths 1 and 0. The mixture so far
   comes back down the same way.
3. Parts answer each bucket with the values of its keys, packed again, and a cogroup scores the documents. The log10
   probabilities of grams travel in units of 2^-36.

Null texts count as empty: one end token. A null ``doc_id`` counts as the empty text in the hash (held out). Repeated
rows are trained on and scored one by one. Without training texts all contexts are unreached: a bit has chance 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .store import materialize, shuffles_deleted, texts
from .words import SPACED, buffers, chunks, cut, mix

UNIT_BITS = 10  # rows that stay together: 1,024
BUCKET_BYTES = 40 << 20
MAX_DEPTH = 7  # a gram is one 64-bit number
ROWS_PER_GROUP = 1 << 21  # bytes of text for each part of the keys
NODES_PER_GROUP = 1 << 17
KEYS_AT_ONCE, GRAMS_AT_ONCE = 1 << 15, 1 << 23
UNIT = 2.0**-36
START, END = 0xFE, 0xFF
_LN2, _LN10, _LNPI = float(np.log(2)), float(np.log(10)), float(np.log(np.pi))


def byte_grams(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(preceding bytes, latest first, and the byte itself as one number, document) of every byte and end of the texts."""
    data, offsets = buffers(column)
    n, width = len(offsets) - 1, depth + 1
    length = np.diff(offsets)
    padded = np.full(len(data) + width * n, START, np.uint64)
    doc = np.repeat(np.arange(n), length)
    padded[np.arange(len(data)) + width * doc + depth] = data
    ends = offsets[1:] + width * np.arange(1, n + 1) - 1
    padded[ends] = END
    key = padded.copy()
    for back in range(1, width):
        key[back:] |= padded[:-back] << np.uint64(8 * (width - back))
    owner = np.repeat(np.arange(n), length + width)
    real = np.ones(len(padded), bool)
    for mark in range(depth):
        real[ends - length - mark - 1] = False
    return key[real], owner[real]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Which of the sorted numbers differ from the one before."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def _counted(train: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their counts in training texts."""
    train, other = np.sort(train), np.sort(other)
    start = np.flatnonzero(_firsts(train))
    counts = np.diff(np.append(start, len(train)))
    known, more = train[start], other[_firsts(other)]
    at = np.searchsorted(known, more)
    new = np.ones(len(more), bool)
    new[at < len(known)] = known[at[at < len(known)]] != more[at < len(known)]
    return np.insert(known, at[new], more[new]), np.insert(counts, at[new], 0)


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by planes of equal bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(n)


def _sorted_packed(ordered: np.ndarray) -> bytes:
    return _packed(np.diff(ordered.astype(np.uint64), prepend=np.uint64(0)))


def _sorted_unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(packed, n), dtype=np.uint64)


def _part(context: np.ndarray, parts: int) -> np.ndarray:
    return mix(context + np.uint64(1)) % np.uint64(parts)


_ASKED_SQL = "part bigint, bucket bigint, n bigint, keys binary, counts binary"


def _asked(batches: Iterator[pa.RecordBatch], depth: int, to: int, parts: int) -> Iterator[pa.RecordBatch]:
    """What a bucket holds of each part of the words (-1 and below) and grams (0 and above), and how often in training texts.

    A bucket may send a part several times; its keys are sent sorted and each once.
    """
    held: list[list[np.ndarray]] = [[], [], [], []]
    size, bucket = 0, None

    def out() -> Iterator[pa.RecordBatch]:
        for kind in (0, 1):
            mine = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in held[2 * kind : 2 * kind + 2]]
            for x in held[2 * kind : 2 * kind + 2]:
                x.clear()
            keys, counts = _counted(*mine)
            del mine
            if not len(keys):
                continue
            part = _part(keys >> np.uint64(8 * (depth + 1 - to)) if kind else keys, parts).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order], counts[order], part[order].astype(np.int64)
            cuts = np.append(np.flatnonzero(_firsts(part)), len(part))
            rows = [
                (int(part[a]) if kind else -1 - int(part[a]), bucket, int(b - a), _sorted_packed(keys[a:b]), _packed(counts[a:b]))
                for a, b in zip(cuts, cuts[1:])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "bucket", "n", "keys", "counts"])

    for batch in batches:
        of = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(edges, edges[1:]):
            if b > a and of[a] != bucket:
                yield from out()
                size, bucket = 0, int(of[a])
            for piece in chunks(batch.slice(a, b - a)):
                train = piece.column("train").to_numpy(zero_copy_only=False)
                words = cut(piece.column("text"), SPACED, lower=True)
                hashes, known = words.hashes(), np.repeat(train, words.per_doc)
                keys, doc = byte_grams(piece.column("text"), depth)
                learned = train[doc]
                for into, some in zip(held, (hashes[known], hashes[~known], keys[learned], keys[~learned])):
                    into.append(some)
                size += len(keys)
                if size >= GRAMS_AT_ONCE:
                    yield from out()
                    size = 0
    yield from out()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, carried back."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))


def estimated(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of such a row of bits."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - _LNPI


class _Mixture:
    """The mixed chance of a one at each node so far, and the weight left for longer contexts."""

    def __init__(self, one: np.ndarray, rest: np.ndarray, last: np.ndarray):
        self.one, self.rest, self.last = one, rest, last

    def deepen(self, zeros: np.ndarray, ones: np.ndarray, stop: np.ndarray | float) -> _Mixture:
        seen = zeros + ones > 0
        kt = (ones + 0.5) / (zeros + ones + 1)
        used, last = np.where(seen, stop, 1.0), np.where(seen, kt, self.last)
        return _Mixture(self.one + self.rest * used * last, self.rest * (1 - used), last)

    def at(self, row: np.ndarray) -> _Mixture:
        return _Mixture(self.one[row], self.rest[row], self.last[row])


def _weighted(estimate: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln P_w, weight of stopping) of a context from its own ln P_e and the sum of ln P_w of its longer contexts."""
    both = np.logaddexp(estimate, longer) - _LN2
    return both, np.exp(estimate - _LN2 - both)


@dataclass
class _Level:
    """Nodes of the contexts of one depth: ``key`` is context and node, ``row`` the place of each next deeper node."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray | float
    row: np.ndarray


def _climb(level: _Level, depth: int, to: int) -> list[_Level]:
    """The levels from ``depth`` up to ``to``, deepest first; all longer contexts of a context are in the table."""
    levels = [level]
    for d in range(depth - 1, to - 1, -1):
        key, row = np.unique(level.key & np.uint64((1 << (8 * d + 8)) - 1), return_inverse=True)
        zeros, ones, longer = (np.bincount(row, x, len(key)) for x in (level.zeros, level.ones, level.weighted))
        level = _Level(key, zeros, ones, *_weighted(estimated(zeros, ones), longer), row)
        levels.append(level)
    return levels


_HALVES, _WHOLES = log_gamma(np.arange(4096) + 0.5), log_gamma(np.arange(4096) + 1.0)


def _estimated_counts(same: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``estimated``, of counts; small ones are looked up."""
    other, top = total - same, len(_HALVES) - 1
    out = _HALVES[np.minimum(same, top)] + _HALVES[np.minimum(other, top)] - _WHOLES[np.minimum(total, top)] - _LNPI
    large = total > top
    if large.any():
        out[large] = estimated(same[large].astype(float), other[large].astype(float))
    return out


class _Paths:
    """The eight nodes on the way to each gram's byte, at one depth; grams are sorted by context, then byte.

    ``total[b]`` counts how often node b was passed, ``total[b + 1]`` how often with this gram's bit; ``node[b]`` numbers the nodes.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.total, self.node, self.first = key, np.empty((9, len(key)), np.int64), [], []
        self.total[8] = n
        upto = np.concatenate(([0], np.cumsum(n)))
        for b in range(8):
            first = _firsts(key >> np.uint64(8 - b))
            start = np.flatnonzero(first)
            node = np.cumsum(first) - 1
            self.total[b] = (upto[np.append(start[1:], len(key))] - upto[start])[node]
            self.node.append(node)
            self.first.append(start)
        self.weighted = _estimated_counts(self.total[1:], self.total[:8])
        self.stop: np.ndarray | float = 1.0
        self.row: np.ndarray | None = None

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each node was passed with the other bit, and with the gram's own."""
        return self.total[:8] - self.total[1:], self.total[1:]

    def shorter(self) -> _Paths:
        """The grams whose contexts lack the earliest byte; ``row`` of this has their places."""
        key = ((self.key >> np.uint64(16)) << np.uint64(8)) | (self.key & np.uint64(255))
        key, self.row = np.unique(key, return_inverse=True)
        out = _Paths(key, np.bincount(self.row, self.total[8], len(key)).astype(np.int64))
        for b in range(8):
            start, node = self.first[b], out.node[b]
            longer = np.bincount(node[self.row[start]], self.weighted[b][start], node[-1] + 1)[node]
            estimate = out.weighted[b].copy()
            if b == 0:
                out.stop = np.empty_like(out.weighted)
            out.weighted[b], out.stop[b] = _weighted(estimate, longer)
        return out


def _slices(key: np.ndarray, depth: int, to: int) -> Iterator[slice]:
    """Runs of whole contexts of depth ``to``, of about so many keys."""
    start = np.flatnonzero(_firsts(key >> np.uint64(8 * (depth + 1 - to))))
    group = _firsts(start // KEYS_AT_ONCE)
    cuts = np.append(start[group], len(key)).tolist()
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def _paths(key: np.ndarray, n: np.ndarray, depth: int, to: int) -> list[_Paths]:
    levels = [_Paths(key, n)]
    for _ in range(depth - to):
        levels.append(levels[-1].shorter())
    return levels


def _turned(key: np.ndarray, to: int) -> np.ndarray:
    """Context bytes latest last instead of latest first, and the other way round; the last byte stays."""
    out = key & np.uint64(255)
    for i in range(1, to + 1):
        out = out | (key >> np.uint64(8 * i) & np.uint64(255)) << np.uint64(8 * (to + 1 - i))
    return out


def _node_keys(key: np.ndarray, b: int) -> np.ndarray:
    return (key & ~np.uint64(255)) | np.uint64(1 << b) | ((key & np.uint64(255)) >> np.uint64(8 - b))


def _nodes(last: _Paths, to: int) -> list[np.ndarray]:
    """(key, zeros, ones, weighted) of the nodes of depth ``to``."""
    out = []
    for b in range(8):
        at = last.first[b]
        key, total, same = last.key[at], last.total[b][at], last.total[b + 1][at]
        bit = (key >> np.uint64(7 - b) & np.uint64(1)).astype(bool)
        out.append((_turned(_node_keys(key, b), to), np.where(bit, total - same, same), np.where(bit, same, total - same), last.weighted[b][at]))
    return [np.concatenate(c) for c in zip(*out)]


_PARTS_SQL = "part bigint, n bigint, keys binary, counts binary, tokens bigint, types bigint, asked array<struct<bucket: bigint, n: bigint, places: binary>>, nodes binary"


def _merged(table: pa.Table, depth: int, to: int) -> pa.Table:
    """A part's keys with their counts in all training texts, the places of the keys that each bucket asked for, and the nodes of depth ``to``."""
    part, rows = table.column("part")[0].as_py(), table.select(["bucket", "n", "keys", "counts"]).to_pylist()
    all_keys = np.concatenate([_sorted_unpacked(r["keys"], r["n"]) for r in rows])
    key, place = np.unique(all_keys, return_inverse=True)
    counts = np.bincount(place, np.concatenate([_unpacked(r["counts"], r["n"]) for r in rows]), len(key)).astype(np.int64)
    del all_keys
    of: dict[int, list[np.ndarray]] = {}
    at = 0
    for r in rows:
        of.setdefault(r["bucket"], []).append(place[at : at + r["n"]])
        at += r["n"]
    asked = []
    for bucket, places in of.items():
        mine = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
        asked.append({"bucket": bucket, "n": len(mine), "places": _sorted_packed(mine)})
    nodes = b""
    if part >= 0:
        found = [_nodes(_paths(key[s], counts[s], depth, to)[-1], to) for s in _slices(key, depth, to)]
        cols = [np.concatenate(c) for c in zip(*found)]
        nodes = pa.compress(np.stack([cols[0].view(np.int64), cols[1], cols[2], cols[3].view(np.int64)]).tobytes(), codec="zstd", asbytes=True)
        nodes = len(cols[0]).to_bytes(8, "little") + nodes
    return pa.table({
        "part": [part], "n": [len(key)], "keys": [_sorted_packed(key)], "counts": [_packed(counts)], "tokens": [int(counts.sum())],
        "types": [int((counts > 0).sum())], "asked": pa.array([asked], pa.list_(pa.struct([("bucket", pa.int64()), ("n", pa.int64()), ("places", pa.binary())]))),
        "nodes": pa.array([nodes], pa.binary()),
    })


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in batch.column("nodes").to_pylist():
            n = int.from_bytes(held[:8], "little")
            cols = np.frombuffer(pa.decompress(held[8:], decompressed_size=32 * n, codec="zstd"), np.int64).reshape(4, n)
            arrays = [cols[0], cols[1].astype(float), cols[2].astype(float), cols[3].view(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], names=["key", "zeros", "ones", "weighted"])


def _stored(table: pa.Table) -> _Level:
    key, zeros, ones, weighted = (table.column(c).to_numpy() for c in ("key", "zeros", "ones", "weighted"))
    return _Level(key.view(np.uint64), zeros, ones, weighted, 1.0, np.arange(len(key)))


def _upper(level: _Level, depth: int, to: int) -> pa.Table:
    last = _climb(level, depth, to)[-1]
    return pa.table({"key": last.key.view(np.int64), "zeros": last.zeros, "ones": last.ones, "weighted": last.weighted})


_Top = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Above:
    """Stored rows of the mixture of all shorter contexts, by node."""

    def __init__(self, table: pa.Table):
        key = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.key, self.mixture = key[order], _Mixture(*(table.column(c).to_numpy()[order] for c in ("one", "rest", "last")))


def _before(key: np.ndarray, above: _Above | _Top) -> _Mixture:
    """The mixture of all shorter contexts at these nodes, from the stored rows or the top of the tree."""
    if isinstance(above, tuple):
        recent, node = (key >> np.uint64(8) & np.uint64(255)).astype(int), (key & np.uint64(255)).astype(int)
        return _Mixture(*(t[recent, node] for t in above))
    return above.mixture.at(np.searchsorted(above.key, key))


def _descend(levels: list[_Level], above: _Top) -> _Mixture:
    """The mixture before the deepest level, at its nodes."""
    mixed = _before(levels[-1].key, above)
    for level in levels[:0:-1]:
        mixed = mixed.deepen(level.zeros, level.ones, level.stop).at(level.row)
    return mixed


def _lower(table: pa.Table, depth: int, to: int, top: _Top, parts: int) -> pa.Table:
    level = _stored(table)
    mixed = _descend(_climb(level, depth, to), top)
    part = _part(_turned(level.key, depth) >> np.uint64(8), parts).astype(np.int64)
    return pa.table({"part": part, "key": table.column("key"), "one": mixed.one, "rest": mixed.rest, "last": mixed.last})


def _gram_scores(key: np.ndarray, n: np.ndarray, above: _Above | _Top, depth: int, to: int) -> np.ndarray:
    """log10 probability of the last byte of each gram."""
    levels = _paths(key, n, depth, to)
    last = levels[-1]
    turned = _turned(last.key, to)
    mixed = [_before(_node_keys(turned, b), above) for b in range(8)]
    one, rest, latest = (np.stack([getattr(m, c) for m in mixed]) for c in ("one", "rest", "last"))
    bit = np.stack([last.key >> np.uint64(7 - b) & np.uint64(1) for b in range(8)]).astype(bool)
    # From here on the chance of the gram's own bit; the weight spent so far is 1 - rest.
    mixture = _Mixture(np.where(bit, one, 1 - rest - one), rest, np.where(bit, latest, 1 - latest))
    for level, deeper in zip(levels[:0:-1], levels[-2::-1]):
        mixture = mixture.deepen(*level.counts(), level.stop)
        mixture = _Mixture(*(x[:, deeper.row] for x in (mixture.one, mixture.rest, mixture.last)))
    one = mixture.deepen(*levels[0].counts(), levels[0].stop).one
    return np.log10(one.prod(axis=0))


_ANSWERS_SQL = "bucket bigint, gram boolean, n bigint, keys binary, answers binary"


def _answered(table: pa.Table, above: _Above | _Top, depth: int, to: int) -> pa.Table:
    """Counts of words and log10 probabilities of grams, for each bucket that asked."""
    out = []
    for row in table.to_pylist():
        key, answers = _sorted_unpacked(row["keys"], row["n"]), _unpacked(row["counts"], row["n"])
        gram = row["part"] >= 0
        if gram:
            counts = answers.astype(np.int64)
            value = np.concatenate([_gram_scores(key[s], counts[s], above, depth, to) for s in _slices(key, depth, to)])
            answers = np.rint(-value / UNIT).astype(np.uint64)
        for a in row["asked"]:
            places = _sorted_unpacked(a["places"], a["n"]).astype(np.int64)
            out.append((a["bucket"], gram, a["n"], _sorted_packed(key[places]), _packed(answers[places])))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*out)) or [()] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["bucket", "gram", "n", "keys", "answers"])


def _top(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixture of depths 0 and 1 for each last byte (256 x 256 nodes)."""
    zeros, ones, longer = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for recent, node, z, o, w in rows:
        zeros[recent, node], ones[recent, node], longer[recent, node] = z, o, w
    weighted, stop = _weighted(estimated(zeros, ones), longer)
    z0, o0 = zeros.sum(axis=0), ones.sum(axis=0)
    _, stop0 = _weighted(estimated(z0, o0), weighted.sum(axis=0))
    start = _Mixture(np.zeros((256, 256)), np.ones((256, 256)), np.full((256, 256), 0.5))
    mixed = start.deepen(z0[None], o0[None], stop0[None]).deepen(zeros, ones, stop)
    return mixed.one, mixed.rest, mixed.last


def _scores(docs: pa.Table, answers: pa.Table, ends: int, whole: float, depth: int) -> pa.Table:
    """``answers``: packed counts of words, log10 probabilities of grams."""
    base_of = lambda n: np.log10((n + 0.1) / whole)
    known = []
    for gram in (False, True):
        mine = answers.filter(pc.equal(answers.column("gram"), gram)).select(["n", "keys", "answers"]).to_pylist()
        key = np.concatenate([_sorted_unpacked(r["keys"], r["n"]) for r in mine] or [np.zeros(0, np.uint64)])
        value = np.concatenate([_unpacked(r["answers"], r["n"]) for r in mine] or [np.zeros(0, np.uint64)])
        order = np.argsort(key)
        key, value = key[order], value[order]
        known.append((key, value * -UNIT if gram else value.astype(np.int64)))
        del mine, order

    def looked_up(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        # Neighbours in order are found near each other.
        order = np.argsort(wanted)
        out = np.empty(len(wanted), table[1].dtype)
        out[order] = table[1][np.searchsorted(table[0], wanted[order])]
        return out

    parts = []
    for batch in docs.to_batches():
        for part in chunks(batch):
            n = part.num_rows
            words = cut(part.column("text"), SPACED, lower=True)
            count, doc = looked_up(known[0], words.hashes()), words.doc_of()
            base, have = np.bincount(doc, base_of(count), n), np.bincount(doc, count > 0, n)
            grams, of = byte_grams(part.column("text"), depth)
            score = np.bincount(of, looked_up(known[1], grams), n)
            size = np.bincount(of, minlength=n)
            parts.append(pa.table({
                "doc_id": part.column("doc_id"), "held_out": pa.array(~part.column("train").to_numpy(zero_copy_only=False)),
                "n_tokens": words.per_doc.astype(np.int64) + 1, "n_known": have.astype(np.int64) + int(ends > 0),
                "base_score": base + base_of(ends), "score": score, "bits_per_byte": -score * (_LN10 / _LN2) / size,
            }))
    return pa.concat_tables(parts)


_SCORED_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double"


_NODES_SQL = "key bigint, zeros double, ones double, weighted double"


def _grouped(rows: DataFrame, to: int, groups: int) -> GroupedData:
    """Rows whose contexts share their last ``to`` bytes are together."""
    context = F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * to) - 1)
    return rows.withColumn("part", F.pmod(F.xxhash64(context), F.lit(groups))).groupBy("part")


def _answers(parts: DataFrame, depth: int, to: int, n_parts: int) -> DataFrame:
    """What each bucket asked for, from the stored parts."""
    nodes = parts.filter("part >= 0").select("nodes").mapInArrow(_node_rows, _NODES_SQL)
    if to > 2:
        nodes = materialize(nodes)
        middle = _grouped(nodes, 2, nodes.count() // NODES_PER_GROUP + 1)
        second = middle.applyInArrow(lambda t: _upper(_stored(t), to, 2), _NODES_SQL)
    else:
        second = nodes
    recent, node = F.shiftrightunsigned("key", 8).bitwiseAND(255).alias("recent"), F.col("key").bitwiseAND(255).alias("node")
    top = _top(second.groupBy(recent, node).agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect())
    asked = parts.select("part", "n", "keys", "counts", "asked")
    if to > 2:
        above = middle.applyInArrow(lambda t: _lower(t, to, 2, top, n_parts), "part bigint, key bigint, one double, rest double, last double")
        both = asked.groupBy("part").cogroup(above.groupBy("part"))
        return both.applyInArrow(lambda t, a: _answered(t, _Above(a), depth, to), _ANSWERS_SQL)
    return asked.groupBy("part").applyInArrow(lambda t: _answered(t, top, depth, to), _ANSWERS_SQL)


def score(docs: DataFrame, depth: int = 3) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    if not 3 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 3 to {MAX_DEPTH}")
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    unit = F.shiftright(F.monotonically_increasing_id(), UNIT_BITS)
    held = materialize(texts(docs).withColumns({"train": train, "unit": unit}), compression="zstd")
    # Units of 1,024 neighbouring rows, dealt into buckets by bytes in their order; a byte more for each text's end.
    sizes = held.groupBy("unit").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("bytes"), F.count_if("train").alias("ends"))
    upto = F.sum("bytes").over(Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    units = materialize(sizes.withColumn("bucket", F.floor(upto / BUCKET_BYTES).cast("bigint")))
    size, ends = units.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
    held = held.join(F.broadcast(units.select("unit", "bucket")), "unit").drop("unit")
    to, n_parts = min(3, depth - 1), size // ROWS_PER_GROUP + 1
    asked = held.select("bucket", "train", "text").mapInArrow(lambda it: _asked(it, depth, to, n_parts), _ASKED_SQL)
    with shuffles_deleted(docs.sparkSession):
        parts = materialize(asked.groupBy("part").applyInArrow(lambda t: _merged(t, depth, to), _PARTS_SQL), compression="uncompressed")
    tokens, types = parts.filter("part < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types = tokens + ends, types + int(ends > 0)
    whole = tokens + 0.1 * (types + 1)
    answers = _answers(parts, depth, to, n_parts)
    out = held.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lambda a, b: _scores(a, b, ends, whole, depth), _SCORED_SQL)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")
