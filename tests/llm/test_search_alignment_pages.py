"""Ranked search, cross-tokenizer alignment and HTML extraction against plain Python, on edge cases and small tables."""

import html
import json
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
import sentencepiece
from conftest import edge_pages
from test_operators import given, rows_of, some  # noqa: F401
from tokenizers import Tokenizer

from cohortwright.llm import alignment, dom, search, wrappers
from cohortwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FILE_A, FILE_B = (f"{alignment.TOKENIZERS}/{f}" for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_search(spark, given):  # noqa: F811
    where, docs, items = given
    assert rows_of(QUERIES["op11_search"](spark, where), "item_id", "rank", "doc_id", "score") == sorted(brute.ranked(docs, items), key=some)


def test_search_in_blocks(spark, given, monkeypatch):  # noqa: F811
    """Many blocks of items, and runs of one document."""
    monkeypatch.setattr(search, "RUN_CELLS", 1)
    where, docs, items = given
    docs, wanted = docs[:40], sorted(brute.ranked(docs[:40], items, 3), key=some)
    df = spark.createDataFrame([(d["doc_id"], d["text"], 1) for d in docs], "doc_id bigint, text string, uid int")
    out = search.search(df, spark.read.parquet(f"{where}/benchmark.parquet"), 3, block_terms=40)
    assert rows_of(out, "item_id", "rank", "doc_id", "score") == wanted


def test_plan_shares_parts():
    """Each shared set is one node, each item is its node and its own atoms, and no term counts twice."""
    items = {1: [1, 2, 3, 4], 2: [1, 2, 3, 5], 3: [1, 2, 6], 4: [7], 5: [1, 2, 3, 4]}
    plan = search.Plan.mine(items)
    assert len(plan.parent) == 3  # {1, 2}, {1, 2, 3}, {1, 2, 3, 4}
    terms = plan.terms.tolist()
    for i, (uid, node, own) in enumerate(plan.items):
        for t in terms:
            row = np.array([terms.index(t)])
            assert plan.scores(1, np.array([0]), row, np.array([1]))[i, 0] == int(t in items[uid])


def _reference_coders():
    a, b = Tokenizer.from_file(FILE_A), sentencepiece.SentencePieceProcessor(model_file=FILE_B)
    a.encode_special_tokens = True
    character = alignment._byte_characters()
    pieces = {i: bytes(character[c] for c in p) for p, i in a.get_vocab().items() if i != 50256}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: a.encode(t, add_special_tokens=False).ids, pieces.get, b.encode, bytes_b


def test_alignment(spark, given):  # noqa: F811
    where, docs, _ = given
    out = QUERIES["op12_alignment"](spark, where)
    want = brute.aligned(docs, *_reference_coders())
    assert rows_of(out, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == sorted(want, key=some)


def test_alignment_of_odd_spaces(spark, monkeypatch):
    """Runs of all kinds of white space, marks of either tokenizer as plain text, chunks of a few bytes."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 64)
    random.seed(5)
    bits = [" ", "  ", "   ", "\n", "\t", "\r\n", " ", " ", "　", "\u0085", "a", "the", "it's", "12", "日本", "é", "🙂", "<s>", "<0x0A>", "<|endoftext|>", "...", "\x1f", "\x7f", "Ġ"]
    docs = [{"doc_id": i, "text": "".join(random.choices(bits, k=random.randint(1, 25)))} for i in range(400)]
    docs += [{"doc_id": 1000, "text": "a ▁ b"}, {"doc_id": None, "text": None}, {"doc_id": 1001, "text": ""}, {"doc_id": 1001, "text": " "}]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string").repartition(3)
    kept = alignment.align(df, keep_groups=True)
    want = brute.aligned(docs, *_reference_coders())
    out = kept.documents()
    assert rows_of(out.drop("groups"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == sorted(want, key=some)
    assert sum(r.groups.count(";") + 1 for r in out.collect() if r.groups) == sum(w[3] for w in want)
    assert kept.pairs().agg({"links": "sum"}).first()[0] == sum(w[4] for w in want)


def test_postings():
    """Bitmaps and planes of an index agree with counting, before and after packing."""
    rng = np.random.default_rng(8)
    pair, doc, times = rng.integers(0, 50, 3000), rng.integers(0, 40, 3000), rng.integers(1, 9, 3000)
    many = Counter()
    for p, d, t in zip(pair.tolist(), doc.tolist(), times.tolist()):
        many[p, d] += t
    built = alignment.Postings.build(pair, doc, times, 40)
    again = alignment.Postings(alignment.unsqueeze(alignment.squeeze(built.pairs)), 40, [alignment.unsqueeze(alignment.squeeze(p)) for p in built.planes])
    for postings in (built, again):
        documents, links = postings.popcounts()
        for p, n, m in zip(postings.pairs.tolist(), documents.tolist(), links.tolist()):
            assert (n, m) == (sum(1 for q, _ in many if q == p), sum(t for (q, _), t in many.items() if q == p))
        value = rng.integers(0, 99, len(postings.pairs))
        of = dict(zip(postings.pairs.tolist(), value.tolist()))
        assert postings.dealt(value).tolist() == [sum(t * of[p] for (p, e), t in many.items() if e == d) for d in range(40)]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = edge_pages()
    where = tmp_path_factory.mktemp("pages")
    spark.createDataFrame([(*r[:3], "x", 1) for r in rows], "page_id bigint, url string, html string, host string, text int").repartition(4).write.parquet(f"{where}/pages.parquet")
    return str(where), sorted(((r[0], r[1], "\n\n".join(r[3]), len("\n\n".join(r[3]))) for r in rows), key=some)


def test_html(spark, pages):
    where, want = pages
    assert rows_of(QUERIES["op13_html"](spark, where), "page_id", "url", "text", "n_chars") == want


def test_html_with_hot_hosts(spark, pages, monkeypatch):
    """Wrappers too large to broadcast: pages and wrappers dealt by host and salt, the same rows."""
    monkeypatch.setattr(wrappers, "SALT_PAGES", 3)
    where, want = pages
    out = wrappers.main_text(spark.read.parquet(f"{where}/pages.parquet"), broadcast_bytes=0)
    assert rows_of(out, "page_id", "url", "text", "n_chars") == want
    assert sum(r.n_template for r in out.collect()) >= 10


def test_html_of_given_pages(spark):
    """The given pages' articles, cut out with regular expressions."""
    got = {r.page_id: r.text for r in QUERIES["op13_html"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.sub(r"<footer>.*|<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1], flags=re.S)
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def _random_tree(rng, depth):
    return rng.choice("abc"), [_random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)]


def _listed(tree):
    """Labels and parents of a nested tree, whose root and runs are kept apart by position."""
    labels, parents, todo = [], [], [(tree, -1)]
    while todo:
        (label, kids), parent = todo.pop(0)
        labels.append(label)
        parents.append(parent)
        todo += [(k, len(labels) - 1) for k in kids]
    return labels, parents


def _without_runs(tree):
    """Neighbours with the same label left out, so that runs change nothing."""
    kids = []
    for k in tree[1]:
        if not kids or kids[-1][0] != k[0]:
            kids.append(_without_runs(k))
    return tree[0], kids


def test_tree_matching():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (("r", _without_runs(_random_tree(rng, 3))[1]) for _ in range(2))
        matcher = wrappers.Matcher()
        shapes = [matcher.shapes(labels, dom.children(parents))[0] for labels, parents in (_listed(a), _listed(b))]
        assert matcher.match(*shapes) == brute.tree_match(a, b)
        reference = wrappers.Reference(matcher, *_listed(b))
        slots = reference.slots(*_listed(a))
        assert sum(0 <= s < len(reference.shape) for s in slots) == brute.tree_match(a, b)


def test_wrapper_of_a_host(spark):
    """The wrapper holds the layout's tree and the texts that most pages have at one place, however few slots vary."""
    rows = [("h", f"<body><article><h1>T{i}</h1><p>Always this.</p><p>Now {i}</p></article></body>") for i in range(9)]
    wrapper = wrappers.induce(spark.createDataFrame(rows, "host string, html string")).collect()
    (labels, _), template = wrappers.unpack(wrapper[0].wrapper)
    assert len(wrapper) == 1 and "article" in labels and [t for _, t in template] == [dom.hash64("Always this.")]
    assert json.dumps(template)
