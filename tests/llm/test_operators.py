"""Every operator's query against plain Python, on edge cases and on the smallest tables."""

import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from cohortwright.llm import licenses, lines, lm, mixing, neardup, quality, substrings, toxicity
from cohortwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def some(x):
    return tuple((v is None, str(v)) for v in x)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=some)


@pytest.fixture(scope="module", params=["edges", "sf"])
def given(request, spark, edges):
    if request.param == "edges":
        return edges
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return SF, docs, [r.asDict() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def test_decontaminate(spark, given):
    where, docs, items = given
    assert rows_of(QUERIES["op1_decontaminate"](spark, where)) == sorted(brute.contamination(docs, items), key=some)


def test_licenses(spark, given):
    where, docs, _ = given
    out = QUERIES["op2_licenses"](spark, where)
    assert rows_of(out, "doc_id", "n_base", "first_word", "last_word", "base_labels") == sorted(brute.phrase_places(docs, licenses.PHRASES), key=some)
    for r in out.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_texts(spark):
    words = licenses.TEMPLATES["bsd"].split()
    edited = " ".join(words[:40] + ["my", "own", "words"] + words[42:])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([licenses.TEMPLATES["isc"], "before " + edited + " after", " ".join(words[:20]), "nothing of it"])], "doc_id bigint, text string")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert found[0].labels == "isc" and found[0].score == 1
    assert found[1].labels == "bsd" and 0.9 < found[1].score < 1 and all(s.label == "bsd" for s in found[1].spans)
    assert found[2].labels == "" and 0 < found[2].score < 0.5
    assert found[3].score == 0


def test_matching_statistics():
    machine = licenses.Automaton.build({"b c": "x"}, {"t": "a b c b c d", "u": "c d a b"})
    words = {h: i for i, h in enumerate(machine.vocabulary)}
    assert len(words) == 4
    texts = [list(map(int, np.random.default_rng(s).integers(0, 4, 60))) for s in range(5)]
    names = {int(c): w for w, c in zip("abcd", machine.coded(licenses.cut(licenses.pa.array(["a b c d"]), licenses.PLAIN, lower=True).hashes()))}
    for codes in texts:
        for i, (_, n) in enumerate(machine.stream(codes)):
            have = "".join(names[c] for c in codes[: i + 1])
            assert n == max(k for k in range(i + 2) if any(have[len(have) - k :] in t for t in ("abcbcd", "cdab", "bc")))


def test_lines(spark, given):
    where, docs, _ = given
    out = lines.without_boilerplate(spark.read.parquet(f"{where}/documents.parquet"), "source", 4)
    assert rows_of(out) == sorted(brute.without_lines(docs, 4), key=some)
    assert QUERIES["op3_lines"](spark, where).count() == len(docs)


def test_quality(spark, given):
    where, docs, _ = given
    out = QUERIES["op4_quality"](spark, where)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(out, *names) == sorted(brute.quality_counts(docs), key=some)
    assert not [r for r in out.collect() if r.base_failed and r.kept]
    kept = quality.keep_good(spark.read.parquet(f"{where}/documents.parquet"))
    assert kept.columns == spark.read.parquet(f"{where}/documents.parquet").columns
    assert kept.count() == out.filter("kept").count()


def test_lm(spark, given):
    where, docs, _ = given
    out = QUERIES["op5_lm"](spark, where).collect()
    want = sorted(brute.unigram(docs), key=some)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=some)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_context_tree(spark):
    texts = ["abracadabra", "abba", None, "", "ünï cödé", "abracadabra", "zzz"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    tree = brute.ContextTree([t for i, t in enumerate(texts) if brute.id_hash(i) % 10])
    for r in lm.score(docs).collect():
        assert r.score == pytest.approx(tree.score(texts[r.doc_id]), rel=1e-9)


@pytest.mark.parametrize("depth", (4, 5, 7))
def test_context_tree_deep(spark, monkeypatch, depth):
    """Longer contexts, with several groups of each kind."""
    monkeypatch.setattr(lm, "ROWS_PER_GROUP", 40)
    texts = ["abracadabra", "abba", None, "", "ünï cödé", "abracadabra abracadabra", "日本語の日本語", "zzz"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    tree = brute.ContextTree([t for i, t in enumerate(texts) if brute.id_hash(i) % 10], depth)
    for r in lm.score(docs, depth).collect():
        assert r.score == pytest.approx(tree.score(texts[r.doc_id]), rel=1e-9)


def test_context_tree_in_pieces(monkeypatch):
    """Buckets that send a part several times, and parts that climb in several slices."""
    texts = ["abracadabra", "abba", None, "", "ünï cödé", "abracadabra abracadabra", "日本語の日本語", "zzz"] * 2
    rows = pa.record_batch({"bucket": [i // 6 for i in range(16)], "train": [i % 3 > 0 for i in range(16)], "text": texts})
    keys, doc = lm.byte_grams(rows.column("text"), 7)
    found = {}
    for at_once in (1 << 15, 4):
        monkeypatch.setattr(lm, "KEYS_AT_ONCE", at_once)
        monkeypatch.setattr(lm, "GRAMS_AT_ONCE", 8 * at_once)
        monkeypatch.setattr(lm, "chunks", lambda batch: (batch.slice(i, 1) for i in range(batch.num_rows)))
        sent = pa.Table.from_batches(lm._asked(iter([rows]), 7, 3, 3))
        parts = [lm._merged(sent.filter(pc.equal(sent.column("part"), p)), 7, 3).to_pylist()[0] for p in sorted(set(sent.column("part").to_pylist()))]
        got = Counter()
        for p in (p for p in parts if p["part"] >= 0):
            key, n = lm._sorted_unpacked(p["keys"], p["n"]), lm._unpacked(p["counts"], p["n"])
            got.update(dict(zip(key.tolist(), (n.astype(np.int64) + 1).tolist())))
            for a in p["asked"]:
                places = lm._sorted_unpacked(a["places"], a["n"]).astype(np.int64)
                mine = set(keys[doc // 6 == a["bucket"]].tolist())
                assert key[places].tolist() == sorted(mine & set(key.tolist()))
        assert got == Counter(keys.tolist()) - Counter(keys[doc % 3 == 0].tolist()) + Counter(set(keys.tolist()))
        nodes = lm._node_rows(pa.record_batch({"nodes": [p["nodes"]]}) for p in parts if p["part"] >= 0)
        found[at_once] = pa.Table.from_batches(list(nodes)).sort_by("key").to_pydict()
    assert found[4]["key"] == found[1 << 15]["key"] and np.allclose(found[4]["weighted"], found[1 << 15]["weighted"], rtol=1e-12)


def test_lm_buckets_send_packed_keys():
    """Under four bytes for a distinct gram, where a row each took more than sixteen."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    rows = pa.table({"bucket": [0] * len(table), "train": [True] * len(table), "text": table.column("text")})
    sent = pa.Table.from_batches(lm._asked(iter(rows.combine_chunks().to_batches()), 7, 3, 2))
    grams = sent.filter(pc.greater_equal(sent.column("part"), 0))
    taken = sum(len(x) for c in ("keys", "counts") for x in grams.column(c).to_pylist())
    n = sum(grams.column("n").to_pylist())
    assert taken < 4 * n, taken / n


def test_lm_query_is_deep(spark, given):
    where, docs, _ = given
    out = QUERIES["op5_lm"](spark, where).collect()
    short = lm.score(spark.read.parquet(f"{where}/documents.parquet"), 3).collect()
    # Copies of long texts are told better by longer contexts.
    assert sum(r.score for r in out) > 1.02 * sum(r.score for r in short)


def test_mixing(spark, given):
    where, docs, _ = given
    out = mixing.mix(spark.read.parquet(f"{where}/documents.parquet")).collect()
    size, target = brute.mix_targets(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((d["doc_id"] is None, d["doc_id"] or 0, len(brute.spaced(d["text"]))) for d in docs)
    assert {(r.source_size, round(r.target, 6)) for r in out} == {(size[s], round(target[s], 6)) for s in size}
    taken, greatest, sources = defaultdict(int), defaultdict(int), {}
    for r in out:
        sources[(r.source_size, r.target)] = r.target
        taken[(r.source_size, r.target)] += r.taken
        greatest[(r.source_size, r.target)] = max(greatest[(r.source_size, r.target)], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    for s in taken:
        assert abs(taken[s] - sources[s]) <= greatest[s] / 2 + 1
    again = mixing.mix(spark.read.parquet(f"{where}/documents.parquet").repartition(5)).collect()
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text_hash, r.size, r.taken) for r in rows)
    assert key(out) == key(again)


def test_mixing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 97 AS int)) AS text", "if(id < 400, 'hot', concat('s', id % 3)) AS source")
    out = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source_size].append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 98


def test_sharding(spark, given):
    where, docs, _ = given
    out = QUERIES["op7_sharding"](spark, where).collect()
    text = lambda d: (d["text"] or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d["doc_id"], len(text(d)) + 1, zlib.crc32(text(d))) for d in docs)
    slots, shard_of = defaultdict(list), {}
    for r in out:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
        assert shard_of.setdefault(r.doc_id, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_substrings(spark, given):
    where, docs, _ = given
    assert rows_of(QUERIES["op8_substrings"](spark, where)) == sorted(brute.without_windows(docs), key=some)


def test_substrings_hot(spark, edges, monkeypatch):
    """Hot hashes are cut into single windows, with the same result."""
    monkeypatch.setattr(substrings, "HOT", 1)
    monkeypatch.setattr(substrings, "SEGMENTS_PER_SHARD", 50)
    where, docs, _ = edges
    assert rows_of(QUERIES["op8_substrings"](spark, where)) == sorted(brute.without_windows(docs), key=some)


def test_fm_index():
    random = np.random.default_rng(2)
    contents = list({random.integers(1, 4, 16).astype("<u4").tobytes() for _ in range(300)})
    docs = random.permutation(len(contents))
    first = {}
    windows = [[c[4 * j : 4 * j + 52] for j in range(4)] for c in contents]
    for ws, d in zip(windows, docs):
        for w in ws:
            first[w] = min(d, first.get(w, d))
    for ws, found in zip(windows, substrings.earliest(contents, docs, 13)):
        assert [first[w] for w in ws] == found.tolist()


def test_toxicity(spark, given):
    where, docs, _ = given
    out = QUERIES["op9_toxicity"](spark, where).collect()
    assert Counter((r.doc_id, r.held_out) for r in out) == Counter((d["doc_id"], brute.id_hash(d["doc_id"]) % 4 == 2) for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, toxic[r.doc_id]) for r in QUERIES["op9_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    score, label = np.array(held).T
    rank = score.argsort().argsort() + 1
    ones = label.sum()
    assert (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones)) > 0.9


def test_toxicity_thresholds(spark):
    """The best F1 of each language over all its labelled rows, ties and rare labels included."""
    random = np.random.default_rng(4)
    rows = [(lang, float(random.integers(0, 40)) / 40, int(random.random() < share)) for lang, n, share in (("a", 400, 0.1), ("b", 60, 0.5), (None, 300, 0.9), ("few", 40, 0.05)) for _ in range(n)]
    got = {r.lang: r.limit for r in toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, score double, toxic int")).collect()}
    want = {}
    for lang in ("a", "b", "", "few"):
        mine = [(s, t) for name, s, t in rows if (name or "") == lang]
        ones = sum(t for _, t in mine)
        if min(ones, len(mine) - ones) >= 5:
            levels = sorted({s for s, _ in mine})
            f1 = lambda at: 2 * sum(t for s, t in mine if s >= at) / (sum(s >= at for s, _ in mine) + ones)
            best = max(levels, key=lambda at: (f1(at), at))
            want[lang] = (best + max((s for s in levels if s < best), default=0.0)) / 2
    assert got == want and "few" not in want and len(want) == 3


@pytest.mark.parametrize("sample", (250, 8000))
def test_toxicity_rare_language(spark, sample):
    """A language has its own threshold wherever its labelled rows lie, in the network's sample or outside."""
    random = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{w}" for w in random.integers(0, 300, 30)), "xx" if i % 10 < 5 else "en", int(random.random() < 0.15)) for i in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    out = toxicity.classify(docs, labels, 2.0, sample).collect()
    found = {r.doc_id for r in out if r.toxic_by_lang}
    assert {lang for i, _, lang, _ in rows if i in found} == {"xx", "en"}


def test_near_duplicates(spark, given):
    where, docs, _ = given
    out = QUERIES["op10_minhash"](spark, where)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == sorted(brute.components(docs, 4), key=some)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out.collect())


def test_large_near_group(spark, monkeypatch):
    """A chain of near copies whose ends differ, in blocks smaller than the group."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    words = [f"w{i}" for i in range(150)]
    docs, at = [], list(words)
    for i in range(60):
        docs.append({"doc_id": i, "text": " ".join(at)})
        at[(i * 7) % 150] = f"n{i}"
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string")
    assert rows_of(neardup.near_duplicates(df, 4), "doc_id", "n_shingles", "component_id") == sorted(brute.components(docs, 4), key=some)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


def test_pipeline(spark, edges):
    """Each stage judged on its own input."""
    where, _, items = edges
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, out = [r.asDict() for r in docs.collect()], corpus_pipeline.materialize(stage(spark, docs, where))
        after = [r.asDict() for r in out.collect()]
        ids = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
        if name != "consistent_sharding":
            assert out.columns == columns
        if name == "quality_rules":
            good = [d for d, q in zip(before, brute.quality_counts(before)) if not q[-1]]
            assert not ids(after) - ids(good)
        elif name == "near_duplicates":
            roots = brute.components(before, 5)
            assert Counter(c for _, _, c in brute.components(after, 5)) == Counter({c: 1 for _, _, c in roots})
        elif name == "benchmark_decontamination":
            assert ids(after) == ids([d for d, c in zip(before, brute.contamination(before, items)) if not c[-1]])
        elif name == "source_mixing":
            assert set(ids(after)) <= set(ids(before)) and max(ids(after).values(), default=0) <= 2
            assert ids(after) == ids([r.asDict() for r in stage(spark, docs.repartition(4), where).collect()])
        else:
            assert ids(after) == ids(before)
            slots = defaultdict(list)
            for r in after:
                slots[int(r["shard"])].append(r["slot"])
            assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        docs = out
    assert toxicity.SAMPLE > 0 and corpus_pipeline.run(spark, where).count() == docs.count()


def test_pipeline_of_nothing(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
