"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return SPACED.findall(text or "")


def plain(text):
    return PLAIN.findall(lower(text))


def contamination(docs, items, t=10):
    windows = defaultdict(set)
    for item in items:
        w = plain(item["text"])
        n = min(t, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add("null" if item["item_id"] is None else str(item["item_id"]))
    out = []
    for d in docs:
        w, hit, found = plain(d["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if mine := windows.get(tuple(w[j : j + n])):
                    found |= mine
                    hit.update(range(j, j + n))
        out.append((d["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def phrase_places(docs, phrases):
    out = []
    for d in docs:
        w, places, labels = plain(d["text"]), [], set()
        for phrase, label in phrases.items():
            q = phrase.split()
            here = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
            places += here
            labels |= {label} if here else set()
        out.append((d["doc_id"], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return out


def without_lines(docs, min_sites):
    sites = defaultdict(set)
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            sites[line].add(d["source"])
    out = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [x for x in lines if not (spaced(x) and len(sites[x]) >= min_sites)]
        out.append((d["doc_id"], sum(bool(spaced(x)) for x in lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality_counts(docs):
    out = []
    for d in docs:
        text = d["text"] or ""
        w, lines = spaced(text), [x for x in text.split("\n") if spaced(x)]
        n = len(w)
        times = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        covered = {j for i in range(n - 2) if times[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((d["doc_id"], n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n))
    return out


def id_hash(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def unigram(docs):
    tokens = [[*spaced(lower(d["text"])), None] for d in docs]
    count = Counter(x for d, w in zip(docs, tokens) if id_hash(d["doc_id"]) % 10 for x in w)
    n, v = sum(count.values()), len(count)
    return [
        (d["doc_id"], id_hash(d["doc_id"]) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        for d, w in zip(docs, tokens)
    ]


class ContextTree:
    """Context-tree weighting over bytes, one counter for each node, with exact recursion."""

    def __init__(self, texts, depth=3):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for text in texts:
            for context, node, bit in self.bits(text):
                for d in range(depth + 1):
                    self.counts[context[depth - d :], node][bit] += 1
        self.children = defaultdict(set)
        for context, node in self.counts:
            if context:
                self.children[context[1:], node].add(context)
        self.stop = {}
        for node in {node for _, node in self.counts}:
            self._weigh(b"", node)

    def bits(self, text):
        data = bytes([0xFE] * self.depth) + (text or "").encode() + b"\xff"
        for i in range(self.depth, len(data)):
            node = 1
            for j in range(7, -1, -1):
                bit = data[i] >> j & 1
                yield data[i - self.depth : i], node, bit
                node = 2 * node + bit

    def _weigh(self, context, node):
        a, b = self.counts[context, node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == self.depth:
            return own
        longer = sum(self._weigh(c, node) for c in self.children[context, node])
        top = max(own, longer)
        both = top + math.log((math.exp(own - top) + math.exp(longer - top)) / 2)
        self.stop[context, node] = math.exp(own - math.log(2) - both)
        return both

    def score(self, text):
        total = 0.0
        for context, node, bit in self.bits(text):
            one, rest, last = 0.0, 1.0, 0.5
            for d in range(self.depth + 1):
                key = context[self.depth - d :], node
                if key not in self.counts:
                    break
                a, b = self.counts[key]
                last = (b + 0.5) / (a + b + 1)
                stop = 1.0 if d == self.depth else self.stop[key]
                one, rest = one + rest * stop * last, rest * (1 - stop)
            one += rest * last
            total += math.log10(one if bit else 1 - one)
        return total


def mix_targets(docs, weights=(5, 2, 1), share=1.5, stop=2):
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(spaced(d["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        rest, total = share * sum(size.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > stop * size[s]]
        for s in over or list(free):
            target[s] = stop * size[s] if over else rest * weight[s] / total
            free.discard(s)
    return size, target


def without_windows(docs, t=13):
    top = 1 << 63
    ids = [top if d["doc_id"] is None else d["doc_id"] for d in docs]
    words, first = [spaced(d["text"]) for d in docs], {}
    for i, w in zip(ids, words):
        for j in range(len(w) - t + 1):
            key = tuple(w[j : j + t])
            first[key] = min(i, first.get(key, top))
    out = []
    for d, i, w in zip(docs, ids, words):
        keep = [True] * len(w)
        for j in range(len(w) - t + 1):
            if first[tuple(w[j : j + t])] < i:
                keep[j : j + t] = [False] * t
        kept = [x for x, k in zip(w, keep) if k]
        out.append((d["doc_id"], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def components(docs, k, percent=80):
    sets = []
    for d in docs:
        w = spaced(lower(d["text"]))
        sets.append(frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[root(i)].append(d["doc_id"])
    return [(d["doc_id"], len(s), min(least[root(i)], default=None)) for i, (d, s) in enumerate(zip(docs, sets))]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) of every item, scored one document at a time."""
    held = [(d["doc_id"], c) for d in docs if (c := Counter(TERM.findall(lower(d["text"]))))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in items:
        scores = []
        for doc_id, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(TERM.findall(lower(item["text"]))) if t in c
            )
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item["item_id"], rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def tree_match(a, b):
    """Simple tree matching of nested (label, children), by its recurrence."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + tree_match(x, y))
    return m[-1][-1] + 1


def aligned(docs, encode_a, bytes_a, encode_b, bytes_b):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), whole texts at once, link by link."""
    held = []
    for d in docs:
        text = d["text"] or ""
        a, b, want = encode_a(" " + text), encode_b(text), (" " + text).encode()
        links, groups = Counter(), []
        if text and b"".join(map(bytes_a, a)) == want == b"".join(map(bytes_b, b)):
            left, right = _places(a, bytes_a), _places(b, bytes_b)
            j = 0
            for x, at, n in left:
                while right[j][1] + right[j][2] <= at:
                    j += 1
                k = j
                while k < len(right) and right[k][1] < at + n:
                    links[x, right[k][0]] += 1
                    k += 1
            ends = {at + n for _, at, n in left} & {at + n for _, at, n in right}
            for side, name in ((left, 0), (right, 1)):
                cut, now = [], []
                for x, at, n in side:
                    now.append(str(x))
                    if at + n in ends:
                        cut.append(",".join(now))
                        now = []
                groups.append(cut)
            groups = [f"{x}|{y}" for x, y in zip(*groups)]
            held.append((d["doc_id"], len(a), len(b), groups, links))
        else:
            held.append((d["doc_id"], 0, 0, [], links))
    count = Counter(p for *_, links in held for p in links)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    return [
        (
            doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, n_a, n_b, groups, links in held
    ]


def _places(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, len(of(i))))
        at += len(of(i))
    return out
