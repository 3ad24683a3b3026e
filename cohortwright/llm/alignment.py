"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, with corpus-wide counts of id pairs.

1. Tasks cut texts at single spaces before a word and encode each distinct piece of a chunk once. No token goes across
   such a cut: A's word pattern ends a word there, and B has no piece with a space behind another character (both
   checked when the files are read). Where ends of both tokenizers' tokens meet, a group ends;
   between any two neighbouring ends lies exactly one link. A chunk of documents becomes one row: its digests and an
   inverted index, for each id pair the bitmap of its documents (compressed) and one bitmap plane for each bit of the
   multiplicities.
2. Bitmaps of a pair are OR-merged within a chunk and popcounted. Chunks share no document, so their popcounts add up:
   document counts and, with planes weighted by powers of two, link counts of a pair, over the whole corpus.
3. Postings return scores: each chunk's pairs get their count and whether it is the highest of its first id; the
   chunk's bitmaps deal them to its documents.

Rows that cross the network are a chunk's distinct pairs, never links or documents. Null and empty texts, and those that
either tokenizer doesn't give back byte by byte, have no tokens. A null doc_id and repeated rows count as documents of
their own. Very long texts are a chunk each. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keyed, materialize, texts
from .words import buffers, chunks

TOKENIZERS = "/opt/tokenizers"
CHUNK_BYTES = 4 << 20

# Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_byte = np.arange(256)
# Bytes that may follow a cutting space: no white space, and none that begins a white space character beyond ASCII.
_STARTS_WORD = (_byte > 0x20) & (_byte != 0x7F) & ~np.isin(_byte, [0xC2, 0xE1, 0xE2, 0xE3])


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE vocabulary file; ids of ordinary tokens follow the order of merges."""

    def __init__(self, data: bytes):
        model = json.loads(data)
        special = {t["id"] for t in model.get("added_tokens", [])}
        of = _byte_characters()
        entries = {i: bytes(of[c] for c in piece) for piece, i in model["model"]["vocab"].items() if i not in special}
        merged = [model["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        if merged != sorted(merged) or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("ids must follow the merges, and texts be cut by the byte-level word pattern alone")
        self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={piece: i for i, piece in entries.items()}, special_tokens={})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(p) for p in pieces]


class Pieces:
    """A sentencepiece model with byte fallback; it adds the space before a text itself."""

    def __init__(self, data: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = []
        for i in range(self.coder.vocab_size()):
            piece = self.coder.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode())
        if any(re.search("[^▁]▁", self.coder.id_to_piece(i)) for i in range(len(self.bytes))):
            raise ValueError("no piece may go across a space")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.coder.encode([p[1:] for p in pieces], num_threads=1)


class _Coder:
    """Both tokenizers, made once in a worker from the files' bytes."""

    made: dict[bytes, tuple[ByteLevel, Pieces]] = {}

    @classmethod
    def of(cls, files: tuple[bytes, bytes]) -> tuple[ByteLevel, Pieces]:
        key = hashlib.sha256(files[0] + files[1]).digest()
        if key not in cls.made:
            cls.made.clear()
            cls.made[key] = ByteLevel(files[0]), Pieces(files[1])
        return cls.made[key]


def _flat(coded: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row, their byte lengths, and each piece's first place."""
    count = np.array([len(c) for c in coded], np.int64)
    ids = np.fromiter((i for c in coded for i in c), np.int64, int(count.sum()))
    return ids, sizes[ids], np.concatenate(([0], np.cumsum(count)))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]


class Aligned:
    """Distinct pieces of text with their groups as text and their links as pairs of ids."""

    def __init__(self, pieces: list[bytes], a: ByteLevel, b: Pieces):
        words = [p.decode() for p in pieces]
        length = np.array([len(p) for p in pieces], np.int64)
        sizes_a, sizes_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        coded_a, coded_b = a.encode(words), b.encode(words)
        self.valid = np.array(
            [b"".join([a.bytes[i] for i in x]) == p == b"".join([b.bytes[i] for i in y]) for x, y, p in zip(coded_a, coded_b, pieces)], bool
        )
        coded_a, coded_b = ([x if ok else [] for x, ok in zip(c, self.valid)] for c in (coded_a, coded_b))
        ids_a, bytes_a, at_a = _flat(coded_a, sizes_a)
        ids_b, bytes_b, at_b = _flat(coded_b, sizes_b)
        end_a, end_b = np.cumsum(bytes_a), np.cumsum(bytes_b)
        piece_end = np.cumsum(np.where(self.valid, length, 0))
        # Every stretch between neighbouring ends of either side is one link.
        ends = np.union1d(end_a, end_b)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        of_a, of_b = np.searchsorted(end_a, starts, "right"), np.searchsorted(end_b, starts, "right")
        self.pair = ids_a[of_a] * len(b.bytes) + ids_b[of_b]
        self.link_at = np.concatenate(([0], np.searchsorted(ends, piece_end, "right")))
        both = np.isin(ends, end_a, assume_unique=True) & np.isin(ends, end_b, assume_unique=True)
        self.n_a, self.n_b, self.n_groups = np.diff(at_a), np.diff(at_b), _sums(both, self.link_at)
        self.groups = self._groups(ids_a, ids_b, end_a, end_b, ends[both], piece_end)

    def _groups(self, ids_a, ids_b, end_a, end_b, group_end, piece_end) -> list[str]:
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        last_a, last_b = (np.searchsorted(e, group_end, "right").tolist() for e in (end_a, end_b))
        said, x, y = [], 0, 0
        for i, j in zip(last_a, last_b):
            said.append(f"{names_a[x] if i == x + 1 else ','.join(names_a[x:i])}|{names_b[y] if j == y + 1 else ','.join(names_b[y:j])}")
            x, y = i, j
        at = [0, *np.searchsorted(group_end, piece_end, "right").tolist()]
        return [";".join(said[i:j]) for i, j in zip(at, at[1:])]


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of texts that each begin with a space, and each text's first piece.

    A piece begins with a text, and at a space after none and before a word.
    """
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        begins[1:-2] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & _STARTS_WORD[data[2:]]
    begins[offsets] = True
    begins[-1] = False
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def squeeze(codes: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte by byte of their eight bytes."""
    steps = np.diff(codes, prepend=0).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u8").ravel().astype(np.int64))


class Postings:
    """An inverted index of a chunk: its distinct pairs, and bitmap planes of the documents of each.

    Bit (pair, document) of plane j is bit j of how often the document holds the pair linked; the OR of a pair's planes is the
    bitmap of its documents. A bit's code is the pair's place x documents + document; a plane is a sorted row of codes.
    """

    def __init__(self, pairs: np.ndarray, n_docs: int, planes: list[np.ndarray], merged: np.ndarray | None = None):
        self.pairs, self.n_docs, self.planes = pairs, n_docs, planes
        self.merged = np.unique(np.concatenate([*planes, pairs[:0]])) if merged is None else merged

    @classmethod
    def build(cls, pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_docs: int) -> Postings:
        """From (pair, document, times) in any order; repeated ones add up."""
        pairs, place = np.unique(pair, return_inverse=True)
        code = place.astype(np.int64) * n_docs + doc
        order = np.argsort(code)
        code, times = code[order], times[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        many = np.add.reduceat(times, first) if len(first) else times
        code = code[first]
        return cls(pairs, n_docs, [code[(many >> bit & 1) > 0] for bit in range(int(many.max()).bit_length() if len(many) else 0)], code)

    def popcounts(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents of every pair (bits of its OR-merged planes), and links (bits of planes times powers of two)."""
        at = np.arange(len(self.pairs) + 1) * self.n_docs
        count = lambda codes: np.diff(np.searchsorted(codes, at))
        return count(self.merged), sum((count(plane) << bit for bit, plane in enumerate(self.planes)), np.zeros(len(self.pairs), np.int64))

    def dealt(self, value: np.ndarray) -> np.ndarray:
        """For every document, the sum of its pairs' values, each as often as it is linked there."""
        out = np.zeros(self.n_docs, np.int64)
        for bit, plane in enumerate(self.planes):
            place, doc = np.divmod(plane, self.n_docs)
            np.add.at(out, doc, value[place] << bit)
        return out


_DIGESTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema(
    [("block", pa.int64()), *[(c, _LONGS) for c in _DIGESTS[:5]], ("groups_sha256", pa.list_(pa.string())), ("groups", pa.list_(pa.string())),
     ("n_docs", pa.int64()), ("pairs", pa.binary()), ("documents", pa.binary()), ("links", pa.binary()), ("planes", pa.list_(pa.binary()))]
)
_BLOCK_SQL = (
    "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, groups array<string>, n_docs bigint, pairs binary, documents binary, links binary, planes array<binary>"
)


def align_chunk(part: pa.RecordBatch, a: ByteLevel, b: Pieces, keep_groups: bool) -> dict[str, object]:
    """One row of a chunk of documents: their digests and the chunk's postings."""
    n = part.num_rows
    data, offsets = buffers(part.column("text"))
    data = np.insert(data, offsets[:-1], 0x20)
    offsets = offsets + np.arange(n + 1)
    starts, first = cut_pieces(data, offsets)
    raw, ends = data.tobytes(), [*starts[1:].tolist(), len(data)]
    known: dict[bytes, int] = {}
    piece = np.fromiter((known.setdefault(raw[i:j], len(known)) for i, j in zip(starts.tolist(), ends)), np.int64, len(starts))
    held = Aligned(list(known), a, b)
    valid = _sums(~held.valid[piece], first) == 0
    totals = [np.where(valid, _sums(x[piece], first), 0) for x in (held.n_a, held.n_b, held.n_groups, np.diff(held.link_at))]
    groups = [";".join([held.groups[p] for p in piece[i:j].tolist()]) if ok else "" for i, j, ok in zip(first.tolist(), first[1:].tolist(), valid)]
    # Each distinct piece of each valid document, with its links.
    doc = np.repeat(np.arange(n), np.diff(first))
    both, times = np.unique((piece * n + doc)[valid[doc]], return_counts=True)
    which, doc = np.divmod(both, max(n, 1))
    size = np.diff(held.link_at)[which]
    link = np.repeat(held.link_at[:-1][which] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else size
    postings = Postings.build(held.pair[link], np.repeat(doc, size), np.repeat(times, size), n)
    documents, links = postings.popcounts()
    return {
        "block": part.column("uid")[0].as_py(), "doc_id": part.column("doc_id").to_pylist(),
        **{name: total.tolist() for name, total in zip(_DIGESTS[1:5], totals)},
        "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], "groups": groups if keep_groups else None,
        "n_docs": n, "pairs": squeeze(postings.pairs), "documents": documents.astype("<i8").tobytes(), "links": links.astype("<i8").tobytes(), "planes": [squeeze(p) for p in postings.planes],
    }


def _indexed(batches: Iterator[pa.RecordBatch], files: Broadcast, keep_groups: bool) -> Iterator[pa.RecordBatch]:
    a, b = _Coder.of(files.value)
    for batch in batches:
        for part in chunks(batch, size=CHUNK_BYTES):
            yield pa.RecordBatch.from_pylist([align_chunk(part, a, b, keep_groups)], schema=_BLOCK)


def _postings(row: dict[str, object]) -> Postings:
    # The sums of a document need no merged bitmap.
    return Postings(unsqueeze(row["pairs"]), row["n_docs"], [unsqueeze(p) for p in row["planes"]], np.zeros(0, np.int64))


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pairs, documents, links = unsqueeze(row["pairs"]), *(np.frombuffer(row[c], "<i8") for c in ("documents", "links"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), row["block"])), *map(pa.array, (pairs, documents, links))], names=["block", "pair", "documents", "links"]
            )


_SCORED = pa.schema([(c, pa.int64()) for c in _DIGESTS[:5]] + [("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())])


def _scored(block: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one chunk with the scores of their pairs."""
    row = block.to_pylist()[0]
    postings, pairs = _postings(row), pairs.sort_by("pair")
    count, best = (pairs.column(c).to_numpy() for c in ("documents", "best"))
    columns = {c: row[c] for c in _DIGESTS[:6]} | {"groups": row["groups"] or [None] * row["n_docs"]}
    columns |= {"n_best": postings.dealt(best.astype(np.int64)), "count_sum": postings.dealt(count)}
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in _SCORED}, schema=_SCORED)


class Alignment:
    """Documents of a corpus, aligned under two tokenizers."""

    def __init__(self, docs: DataFrame, file_a: str, file_b: str, keep_groups: bool = False):
        spark = docs.sparkSession
        with open(file_a, "rb") as one, open(file_b, "rb") as two:
            read = one.read(), two.read()
        self.width = len(Pieces(read[1]).bytes)
        files = spark.sparkContext.broadcast(read)  # two vocabulary files, a few megabytes whatever the corpus
        own = keyed(texts(docs)).select("uid", "doc_id", "text")
        self.blocks = materialize(own.mapInArrow(lambda it: _indexed(it, files, keep_groups), _BLOCK_SQL))
        held = self.blocks.select("block", "pairs", "documents", "links")
        self.held = held.mapInArrow(_popcounts, "block bigint, pair bigint, documents bigint, links bigint")
        self.counts = materialize(self.held.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")))

    def pairs(self) -> DataFrame:
        """(id_a, id_b, documents, links, best): every linked pair; best where no pair of its id_a is in more documents."""
        pair = self.counts.withColumns({"id_a": F.floor(F.col("pair") / self.width), "id_b": F.col("pair") % self.width})
        most = pair.groupBy("id_a").agg(F.max("documents").alias("most"))
        return pair.join(most, "id_a").select("pair", "id_a", "id_b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """One row per document: numbers of tokens, groups and links, and the scores that its pairs' counts give it."""
        scores = materialize(self.pairs().select("pair", "documents", "best"))
        asked = self.held.select("block", "pair").join(scores, "pair")
        schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"
        blocks = self.blocks.drop("documents", "links")
        return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_scored, schema)


def align(docs: DataFrame, folder: str = TOKENIZERS, keep_groups: bool = False) -> Alignment:
    """``docs`` under a byte-level BPE vocabulary (A) and a sentencepiece model (B) of ``folder``."""
    return Alignment(docs, os.path.join(folder, "byte_bpe_50k.json"), os.path.join(folder, "piece_bpe_32k.model"), keep_groups)
