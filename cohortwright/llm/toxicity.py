"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

Words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z) are hashed into BUCKETS embeddings. Filters of 1, 2
and 3 words slide over them; each filter's rectified maximum over the document is a feature of a logistic output. The
network is trained in numpy with Adagrad on at most SAMPLE labelled documents, taken in hash order of their ids from
the labelled rows given (the only bound, of the fit alone; whole texts are used). One coordinate of an embedding starts from the word's
smoothed log-odds among training documents, the rest at random. Scoring is a narrow pass over all rows: a word's
product with every filter row is tabulated once, so a document costs a few gathers a word.

All labelled rows given choose for each language the threshold with the best F1 (``toxic_by_lang`` in the result), each
by the score of a network that did not learn from it: rows of the sample are scored by FOLDS further networks, each
fitted without its fold, all others by the network itself. A language with fewer than LEAST rows of either label keeps
the default. Language, source and id never enter the score. Null and empty texts have no words: all features are 0. Documents
without label are scored only; rows of ``labels`` with a null id or label are left out, repeated ones count as their
greatest label. Without labelled rows every score is 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwright.operators.distributed import lookup_join, running_totals

from .store import materialize, texts
from .words import PLAIN, chunks, cut

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
SAMPLE, EPOCHS, BATCH, RATE, DECAY = 8000, 6, 32, 0.05, 1e-5
FOLDS, LEAST = 5, 5


def _bucketed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = cut(column, PLAIN, lower=True)
    return (words.hashes() >> np.uint64(48)).astype(np.int32), words.offsets


@dataclass
class Network:
    seed: int = 5
    embeddings: np.ndarray = field(init=False)
    filters: list[np.ndarray] = field(init=False)
    bias: list[np.ndarray] = field(init=False)
    out: np.ndarray = field(init=False)
    shift: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        random = np.random.default_rng(self.seed)
        self.embeddings = random.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [random.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0] = np.abs(f[:, 0])
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = random.normal(0.2, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def start_from(self, ids: list[np.ndarray], labels: np.ndarray) -> None:
        """Log-odds of each bucket among documents with and without the label as first coordinate."""
        counts = np.zeros((2, BUCKETS))
        for x, y in zip(ids, labels):
            counts[y, np.unique(x)] += 1
        n = np.bincount(labels, minlength=2)
        odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
        # Rare buckets say little: their odds shrink with their count.
        total = counts.sum(axis=0)
        self.embeddings[:, 0] = np.clip(odds * total / (total + 20), -3, 5)
        prior = (n[1] + 0.5) / (n.sum() + 1)
        self.shift[:] = np.log(prior / (1 - prior))

    def pooled(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Features of each document and, for each width, the word where each filter is greatest (-1: none)."""
        n, x = len(offsets) - 1, self.embeddings[ids]
        features, places = np.zeros((n, len(self.out)), np.float32), []
        for k, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias)):
            place = np.full((n, FILTERS), -1)
            for d in range(n):
                a, m = offsets[d], offsets[d + 1] - offsets[d] - w + 1
                if m > 0:
                    act = sum(x[a + i : a + i + m] @ f[i] for i in range(w)) + b
                    top = act.argmax(axis=0)
                    best = act[top, np.arange(FILTERS)]
                    features[d, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
                    place[d] = np.where(best > 0, a + top, -1)
            places.append(place)
        return features, places

    def fit(self, ids: list[np.ndarray], labels: np.ndarray) -> None:
        self.start_from(ids, labels)
        random = np.random.default_rng(self.seed + 1)
        values = [self.embeddings, *self.filters, *self.bias, self.out, self.shift]
        squares = [np.full_like(v, 1e-3) for v in values]
        for _ in range(EPOCHS):
            order = random.permutation(len(ids))
            for first in range(0, len(order), BATCH):
                docs = order[first : first + BATCH]
                flat = np.concatenate([ids[d] for d in docs])
                offsets = np.concatenate(([0], np.cumsum([len(ids[d]) for d in docs])))
                features, places = self.pooled(flat, offsets)
                error = (_sigmoid(features @ self.out + self.shift) - labels[docs]) / len(docs)
                back = error[:, None] * self.out
                steps = [None] * len(values)
                steps[-2], steps[-1] = features.T @ error + DECAY * self.out, np.array([error.sum()])
                touched, grads = [], []
                for k, w in enumerate(WIDTHS):
                    d, f = np.nonzero(places[k] >= 0)
                    at, g = places[k][d, f], back[d, k * FILTERS + f]
                    step = DECAY * self.filters[k]
                    for i in range(w):
                        word = flat[at + i]
                        np.add.at(step[i].T, f, g[:, None] * self.embeddings[word])
                        touched.append(word)
                        grads.append(g[:, None] * self.filters[k][i][:, f].T)
                    steps[1 + k] = step
                    steps[1 + len(WIDTHS) + k] = np.bincount(f, g, FILTERS)
                if sum(map(len, touched)):
                    rows, where = np.unique(np.concatenate(touched), return_inverse=True)
                    grad = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(grad, where, np.concatenate(grads))
                    squares[0][rows] += grad**2
                    self.embeddings[rows] -= RATE * grad / np.sqrt(squares[0][rows])
                for v, s, step in zip(values[1:], squares[1:], steps[1:]):
                    s += step**2
                    v -= (RATE * step / np.sqrt(s)).astype(np.float32)

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embeddings @ f[i] for i in range(w)] for w, f in zip(WIDTHS, self.filters)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scored(ids: np.ndarray, offsets: np.ndarray, net: Network, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Chance of the label for each document, all documents at once."""
    n, length = len(offsets) - 1, np.diff(offsets)
    logit = np.full(n, float(net.shift[0]))
    for k, (w, b) in enumerate(zip(WIDTHS, net.bias)):
        have = np.flatnonzero(length >= w)
        if not len(have):
            continue
        act = tables[k][0][ids]
        for i in range(1, w):
            act[:-i] += tables[k][i][ids[i:]]
        left = np.repeat(offsets[1:], length) - np.arange(len(ids))
        act[left < w] = -np.inf
        best = np.maximum.reduceat(act, offsets[have], axis=0) + b
        logit[have] += np.maximum(best, 0) @ net.out[k * FILTERS : (k + 1) * FILTERS]
    return _sigmoid(logit)


def _score_batches(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    tables = net.tables()
    for batch in batches:
        for part in chunks(batch):
            ids, offsets = _bucketed(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(scored(ids, offsets, net, tables))], names=["doc_id", "lang", "score"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            ids, offsets = _bucketed(part.column("text"))
            flat = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "toxic", "fold")), pa.array(flat, pa.binary())], names=["doc_id", "lang", "toxic", "fold", "ids"])


def _without(fold: int, ids: list[np.ndarray], label: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a fold's documents by a network that learnt from the others."""
    mine = np.flatnonzero(folds == fold)
    if not len(mine):
        return mine, np.zeros(0)
    net, others = Network(), np.flatnonzero(folds != fold)
    if len(others):
        net.fit([ids[i] for i in others], label[others])
    else:
        net.out[:] = 0
    return mine, scored(np.concatenate([ids[i] for i in mine]), np.concatenate(([0], np.cumsum([len(ids[i]) for i in mine]))), net, net.tables())


def known_labels(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).dropna()
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, chosen: DataFrame) -> tuple[Network, DataFrame]:
    """The network, and (lang, score, toxic) of the chosen labelled documents by networks that did not learn from them."""
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = texts(docs, F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen.select("*", fold)), "doc_id")
    rows = rows.mapInArrow(_ids, "doc_id bigint, lang string, toxic int, fold int, ids binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.ids))
    net = Network()
    if not rows:
        net.out[:] = 0
        return net, spark.createDataFrame([], "lang string, score double, toxic int")
    ids, label, folds = [np.frombuffer(r.ids, np.int32) for r in rows], np.array([r.toxic for r in rows], np.int64), np.array([r.fold for r in rows])
    sent = spark.sparkContext.broadcast((ids, label, folds))
    # One task for each fold.
    apart = spark.sparkContext.parallelize(range(FOLDS), FOLDS).map(lambda k: _without(k, *sent.value)).collect()
    net.fit(ids, label)
    out = [(rows[i].lang, float(s), rows[i].toxic) for places, scores in apart for i, s in zip(places, scores)]
    return net, spark.createDataFrame(out, "lang string, score double, toxic int")


def best_thresholds(judged: DataFrame) -> DataFrame:
    """(lang, limit) from (lang, score, toxic): half way below the score with the best F1, the highest of equal ones.

    Equal scores are combined first; running counts are range-partitioned, so a language may hold all rows.
    """
    counts = materialize(judged.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "score").agg(F.sum("toxic").alias("hit"), F.count("*").alias("n")))
    upto = running_totals(counts, ["lang"], [F.col("score").desc()], {"hits": "hit", "rows": "n"}, totals=True)
    enough = upto.filter((F.col("hits_total") >= LEAST) & (F.col("rows_total") - F.col("hits_total") >= LEAST))
    f1 = 2 * F.col("hits") / (F.col("rows") + F.col("hits_total"))
    best = enough.groupBy("lang").agg(F.max_by("score", F.struct(f1, "score")).alias("best"))
    below = lookup_join(counts, best, "lang", "inner").groupBy("lang", "best").agg(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("below"))
    return below.select("lang", ((F.col("best") + F.coalesce("below", F.lit(0.0))) / 2).alias("limit"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted, toxic_by_lang."""
    known = materialize(known_labels(labels.filter(~held_out(F.col("doc_id")))))
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    net, judged = train(docs, chosen)
    lang = F.col("lang").cast("string").alias("lang")
    out = materialize(texts(docs, lang).mapInArrow(lambda it: _score_batches(it, net), "doc_id bigint, lang string, score double"))
    others = known.join(F.broadcast(chosen), "doc_id", "left_anti")
    limits = best_thresholds(judged.unionByName(out.join(others, "doc_id").select("lang", "score", "toxic")))
    out = lookup_join(out.withColumn("lang", F.coalesce("lang", F.lit(""))), limits, "lang")
    limit = F.coalesce("limit", F.lit(threshold))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= limit).alias("toxic_by_lang"))
