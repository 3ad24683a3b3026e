"""Main text of web pages by wrapper induction.

1. Every page is read into a tree of its block elements (``dom``). Neighbouring siblings with the same label count
   as one repeated node, so a tree is as long as its layout, not as its text.
2. The page of a host with the most kinds of nodes is the host's reference tree. Simple tree matching aligns every
   page of the host with it: each node gets a slot, the reference node it matches, or the path from the nearest
   matched one. Each page of distinct content (title, first heading and longest block) votes once. A text that more than half of the
   pages with a slot hold there, at least MIN_PAGES, is constant: template. All else is a varying slot.
3. A page's varying slots are its content where neither their element, role nor class names something else (menus,
   sidebars, adverts, comments, ...). With an article or main element, that one's blocks; otherwise the least
   element with most of the text that isn't links.

A page's votes are counts by (host, slot, text), so no task sees a host's pages; wrappers join pages by host,
broadcast within BROADCAST_BYTES of them, and otherwise with pages and wrappers dealt by host and a salt that
grows with the host. Null or empty html: empty text. Null urls share one host. Repeated rows: one result each.
An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dom import Block, Page, children, hash64, parse, runs
from .store import materialize

MIN_PAGES = 5
MOST_TEXT = 0.7  # share of the text that the main element holds where no article or main names it
BROADCAST_BYTES = 16 << 20
SALT_PAGES, HOT_HOSTS = 2_000, 10_000


class Matcher:
    """Simple tree matching. Trees are shapes: a label and the shapes of its runs of children, each stored once."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def shape(self, label: str, kids: tuple[int, ...]) -> int:
        i = self.ids.setdefault((label, kids), len(self.label))
        if i == len(self.label):
            self.label.append(label)
            self.kids.append(kids)
            self.size.append(1 + sum(self.size[k] for k in kids))
        return i

    def shapes(self, labels: list[str], kids: list[list[int]]) -> list[int]:
        """The shape of every node; a run stands for its largest member."""
        out = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            out[i] = self.shape(labels[i], tuple(out[self.model(run, out)] for run in runs(kids[i], labels)))
        return out

    def model(self, run: list[int], shapes: list[int]) -> int:
        return max(run, key=lambda i: self.size[shapes[i]])

    def match(self, a: int, b: int) -> int:
        """Pairs of nodes in the best alignment of two shapes that keeps order and ancestors."""
        if self.label[a] != self.label[b]:
            return 0
        if (a, b) not in self.known:
            self.known[a, b] = 1 + int(self.table(self.kids[a], self.kids[b])[-1, -1])
        return self.known[a, b]

    def table(self, a: tuple[int, ...], b: tuple[int, ...]) -> np.ndarray:
        """Best total of the first i and the first j children, row by row."""
        out = np.zeros((len(a) + 1, len(b) + 1), np.int64)
        for i, x in enumerate(a):
            gain = np.array([self.match(x, y) for y in b], np.int64)
            np.maximum.accumulate(np.maximum(out[i, 1:], np.where(gain > 0, out[i, :-1] + gain, 0)), out=out[i + 1, 1:])
        return out

    def pairs(self, a: tuple[int, ...], b: tuple[int, ...]) -> dict[int, int]:
        """Child j of the second for each child i of the first that the best alignment matches."""
        best, out = self.table(a, b), {}
        i, j = len(a), len(b)
        while i and j:
            gain = self.match(a[i - 1], b[j - 1])
            if gain and best[i, j] == best[i - 1, j - 1] + gain:
                i, j = i - 1, j - 1
                out[i] = j
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        return out


class Reference:
    """A reference tree, with one node for each run of siblings, numbered in page order."""

    def __init__(self, matcher: Matcher, labels: list[str], parents: list[int]):
        kids = children(parents)
        shapes = matcher.shapes(labels, kids)
        self.matcher, self.shape, self.kids = matcher, [shapes[0]], [[]]
        todo = [(0, 0)]
        while todo:
            node, at = todo.pop()
            for run in runs(kids[node], labels):
                model = matcher.model(run, shapes)
                self.kids[at].append(len(self.shape))
                self.shape.append(shapes[model])
                self.kids.append([])
                todo.append((model, len(self.shape) - 1))
        self.memo: dict[tuple[int, int], dict[int, int]] = {}

    def slots(self, labels: list[str], parents: list[int]) -> list[int]:
        """The slot of every node of a page: a reference node, or a hash of the way from one."""
        kids, m = children(parents), self.matcher
        shapes = m.shapes(labels, kids)
        slot = [0] * len(labels)
        matched = [-1] * len(labels)
        matched[0] = 0 if m.label[shapes[0]] == m.label[self.shape[0]] else -1
        for node in range(len(labels)):  # parents come first
            mine, to = runs(kids[node], labels), {}
            if matched[node] >= 0 and mine:
                key = (shapes[node], matched[node])
                if key not in self.memo:
                    self.memo[key] = m.pairs(m.kids[shapes[node]], tuple(self.shape[k] for k in self.kids[matched[node]]))
                to = self.memo[key]
            for i, run in enumerate(mine):
                there = self.kids[matched[node]][to[i]] if i in to else -1
                way = there if there >= 0 else hash64(f"{slot[node]}>{labels[run[0]]}")
                for member in run:
                    matched[member], slot[member] = there, way
        return slot


def pack(thing: object) -> bytes:
    return zlib.compress(json.dumps(thing).encode())


def unpack(data: bytes) -> list:
    return json.loads(zlib.decompress(data))


def content(page: Page, template: set[tuple[int, int]], slots: list[int] | None) -> tuple[list[str], int]:
    """Texts of the page's content blocks in page order, and the number of template blocks it holds."""
    constant = [b for b in page.blocks if slots and (slots[b.node], hash64(b.text)) in template]
    out = {b.node for b in constant}
    live = [b for b in page.blocks if not b.dropped and b.node not in out]
    chosen = _areas(live) or _largest(page, live) or _areas([b for b in page.blocks if b.node not in out])
    return [b.text for b in chosen], len(constant)


def _areas(live: list[Block]) -> list[Block]:
    """Blocks of articles, with headings beside them in the main element; else the main element's."""
    article, main = [b for b in live if b.area == "article"], [b for b in live if b.area == "main"]
    if article:
        return [b for b in live if b.area == "article" or (b.area == "main" and b.heading)]
    return main


def _largest(page: Page, live: list[Block]) -> list[Block]:
    """Blocks of the least element with MOST_TEXT of the text outside of links; lists of links aren't content."""
    live = [b for b in live if 2 * b.linked <= len("".join(b.text.split()))]
    if not live:
        return []
    held = np.zeros(len(page.labels), np.int64)
    for b in live:
        held[b.node] += len(b.text) - b.linked
    for i in range(len(held) - 1, 0, -1):
        held[page.parents[i]] += held[i]
    # The last such node in page order is the deepest: with more than half of the text, they lie on one path.
    root = int(np.flatnonzero(held >= MOST_TEXT * held[0])[-1])
    if page.labels[root].split(".")[0] in ("#", "p"):
        root = page.parents[root] if page.labels[root] != "#" else page.parents[page.parents[root]] if page.parents[root] > 0 else 0
    inside = np.zeros(len(held), bool)
    for i in range(len(held)):
        inside[i] = i == root or (i > 0 and inside[page.parents[i]])
    return [b for b in live if inside[b.node]]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


_TREES = "host string, page bigint, content bigint, kinds int, tree binary, held binary"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = parse(html)
            live = [b for b in page.blocks if not b.dropped]
            heading, longest = next((b.text for b in live if b.heading), ""), max((b.text for b in live), key=len, default="")
            held = [(b.node, hash64(b.text)) for b in live]
            rows.append((host, hash64(html or ""), hash64(f"{page.title}\n{heading}\n{longest}"), len(set(page.labels)), pack((page.labels, page.parents)), pack(held)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
            names=["host", "page", "content", "kinds", "tree", "held"],
        )


class _Wrappers(dict):
    """Wrappers that a task has unpacked; a fuller store starts afresh."""

    def of(self, host: str, data: bytes) -> tuple[Reference, set[tuple[int, int]]]:
        key = (host, data)
        if key not in self:
            if len(self) >= 64:
                self.clear()
            (labels, parents), template = unpack(data)
            self[key] = Reference(Matcher(), labels, parents), {tuple(t) for t in template}
        reference, template = self[key]
        if len(reference.matcher.label) > 100_000:
            del self[key]  # its shapes have grown; the next page begins anew
        return reference, template


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers = _Wrappers()
    for batch in batches:
        out: list[tuple[str, int, int]] = []
        for host, tree, held, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "held", "wrapper"))):
            slots = wrappers.of(host, wrapper)[0].slots(*unpack(tree))
            mine = {(slots[node], text) for node, text in unpack(held)}
            out += [(host, slot, text) for slot, text in mine] + [(host, slot, None) for slot in {slot for slot, _ in mine}]
        columns = zip(*out) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["host", "slot", "text"])


def by_host(pages: DataFrame, wrappers: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pages with their host's ``wrapper``; ``wrappers`` is stored, one row per host, and measured first."""
    held = wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    if held <= broadcast_bytes:
        return pages.join(F.broadcast(wrappers), "host")
    sizes = materialize(pages.groupBy("host").agg(F.count("*").alias("n")))
    # Hosts above a step that at most HOT_HOSTS of them can exceed are dealt over several salts.
    step = max(SALT_PAGES, sizes.agg(F.sum("n")).first()[0] // HOT_HOSTS + 1)
    hot = F.broadcast(sizes.filter(F.col("n") > step).select("host", F.ceil(F.col("n") / step).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    own = F.pmod(F.xxhash64(*[c for c in pages.columns if c != "host"]), salts).cast("int")
    wide = wrappers.join(hot, "host", "left").select("host", "wrapper", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    return pages.join(hot, "host", "left").withColumn("_salt", own).drop("_salts").join(wide, ["host", "_salt"]).drop("_salt")


def induce(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per host of pages (host, html): its reference tree and constant (slot, text) pairs, packed."""
    trees = materialize(pages.select("host", "html").mapInArrow(_trees, _TREES))
    # A reference without template, in the packed form that a wrapper has.
    tree = trees.groupBy("host").agg(F.max_by("tree", F.struct("kinds", "page")).alias("tree"))
    references = materialize(tree.mapInArrow(_bare, "host string, wrapper binary"))
    voters = trees.groupBy("host", "content").agg(F.min_by(F.struct("tree", "held"), "page").alias("v")).select("host", "v.*")
    counts = materialize(by_host(voters, references, broadcast_bytes).mapInArrow(_votes, "host string, slot bigint, text bigint").groupBy("host", "slot", "text").count())
    of = counts.filter("text is null").select("host", "slot", F.col("count").alias("pages"))
    constant = counts.filter(F.col("text").isNotNull() & (F.col("count") >= MIN_PAGES)).join(of, ["host", "slot"]).filter("2 * count > pages")
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("slot", "text"))).alias("template"))
    return materialize(references.join(constant, "host", "left").mapInArrow(_full, "host string, wrapper binary"))


def _bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrapper = [pack((unpack(t), [])) for t in batch.column("tree").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(wrapper, pa.binary())], names=["host", "wrapper"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wrapper = [
            pack((unpack(w)[0], [(t["slot"], t["text"]) for t in template or []]))
            for w, template in zip(batch.column("wrapper").to_pylist(), batch.column("template").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(wrapper, pa.binary())], names=["host", "wrapper"])


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers = _Wrappers()
    for batch in batches:
        texts, constant = [], []
        for host, html, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
            page = parse(html)
            reference, template = wrappers.of(host, wrapper)
            blocks, n = content(page, template, reference.slots(page.labels, page.parents) if template else None)
            texts.append("\n\n".join(blocks))
            constant.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(constant, pa.int64())],
            schema=_TEXTS,
        )


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text (content blocks joined by an empty line), n_chars and n_template (template blocks left out)."""
    own = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("host", host_of(F.col("url")))
    wrappers = induce(own, broadcast_bytes)
    return by_host(own, wrappers, broadcast_bytes).mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint, n_template bigint")
