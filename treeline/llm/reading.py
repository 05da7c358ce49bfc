"""How demanding a document's prose is, from a model of its sentences.

A regularised word and character model gives every sentence a distribution over the levels; a calibrated second model turns a
document's sentence distributions into its level. Both are fitted on a bounded sample of rated documents, and applied to all.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.prose import sentences
from treeline.session import cut

LEVELS = (1, 2, 3, 4)
#: The most rated documents that the models are fitted on, the first by a hash of their id.
MOST_RATED = 2000
#: The most words of them, in all; a document that would exceed it is left out of the sample.
MOST_RATED_WORDS = 4_000_000
#: The most word types that the word model keeps, the most frequent ones; others are judged by their characters.
MOST_WORDS = 30_000
BUCKETS = 1 << 14
ROUNDS = 120


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _hash(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % BUCKETS


def grams(word: str) -> list[int]:
    """Buckets of a word's character sequences of three to five, with its ends."""
    w = f"^{word}$"
    return [_hash(w[i : i + n]) for n in (3, 4, 5) for i in range(len(w) - n + 1)] or [_hash(w)]


class Adam:
    """Gradient steps with the usual moments."""

    def __init__(self, *shapes: tuple[int, ...], rate: float = 0.1):
        self.w = [np.zeros(s) for s in shapes]
        self.m, self.v, self.t, self.rate = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0, rate

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for w, m, v, g in zip(self.w, self.m, self.v, grads):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


@dataclass
class SentenceModel:
    """Logits of a sentence: a bias and the mean of its words' logits, each a word's own and those of its character sequences."""

    words: dict[str, np.ndarray] = field(default_factory=dict)
    chars: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, len(LEVELS)), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(LEVELS)))

    @classmethod
    def fit(cls, docs: list[list[list[str]]], target: np.ndarray) -> SentenceModel:
        """Every sentence counts by the rating of its document, a distribution over the levels; documents weigh alike."""
        types: dict[str, int] = {}
        flat, lengths, rows = [], [], []
        for d, doc in enumerate(docs):
            for s in doc:
                flat += [types.setdefault(w, len(types)) for w in s]
                lengths.append(len(s))
                rows.append(d)
        if not flat:
            return cls()
        x, n, rows = np.array(flat), np.array(lengths), np.array(rows)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        y = target[rows]
        per = 1 / np.bincount(rows, minlength=len(docs))[rows]
        per /= per.sum()
        owner = np.repeat(np.arange(len(n)), n)
        gram = [grams(w) for w in types]
        gi, gn = np.concatenate([np.array(g) for g in gram]), np.array([len(g) for g in gram])
        gw = np.repeat(np.arange(len(gram)), gn)
        gstart = np.concatenate([[0], np.cumsum(gn)[:-1]])
        k = len(LEVELS)
        frequent = np.argsort(-np.bincount(x, minlength=len(types)), kind="stable")[:MOST_WORDS]
        kept = np.zeros((len(types), 1))
        kept[frequent] = 1
        opt = Adam((len(types), k), (BUCKETS, k), (k,))
        for _ in range(ROUNDS):
            w, c, b = opt.w
            logits = w * kept + np.add.reduceat(c[gi], gstart, axis=0) / gn[:, None]
            p = _softmax(np.add.reduceat(logits[x], start, axis=0) / n[:, None] * 3 + b)
            g = (p - y) * per[:, None]
            gx = g / n[:, None] * 3
            gt = np.stack([np.bincount(x, gx[owner, j], len(types)) for j in range(k)], axis=1)
            gc = np.stack([np.bincount(gi, (gt[:, j] / gn)[gw], BUCKETS) for j in range(k)], axis=1)
            opt.step([gt * kept + 1e-5 * w, gc + 1e-5 * c, g.sum(axis=0)])
        w, c, b = opt.w
        logits = w * kept + np.add.reduceat(c[gi], gstart, axis=0) / gn[:, None]
        return cls({t: logits[i].astype(np.float32) for t, i in types.items() if kept[i, 0]}, c.astype(np.float32), b)

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Looks up words' logits, computing each word type's once."""

    def __init__(self, model: SentenceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def at(self, word: str) -> int:
        i = self.index.get(word)
        if i is None:
            known = self.model.words.get(word)
            i = self.index[word] = len(self.rows)
            self.rows.append(known if known is not None else self.model.chars[grams(word)].mean(axis=0))
        return i

    def features(self, docs: list[list[list[str]]]) -> np.ndarray:
        """One row a document: what its sentences' distributions, lengths and votes come to; documents must have sentences."""
        if len(self.rows) > 500_000:
            self.clear()
        at, get = self.at, self.index.get
        flat = [at(w) if (i := get(w)) is None else i for doc in docs for s in doc for w in s]
        n = np.array([len(s) for doc in docs for s in doc])
        table = np.array(self.rows)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        logits = np.add.reduceat(table[np.array(flat)], start, axis=0) / n[:, None] * 3 + self.model.bias
        p = _softmax(logits)
        per = np.array([len(doc) for doc in docs])
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        mean = lambda v: np.add.reduceat(v, first, axis=0) / per[:, None]
        share = mean(p)
        votes = mean(np.eye(len(LEVELS))[p.argmax(axis=1)])
        spread = np.sqrt(np.maximum(mean(p * p) - share**2, 0))
        level = mean((p @ np.array(LEVELS))[:, None])
        return np.hstack([share, votes, spread, level, mean(logits) / 3, np.log(mean(n[:, None].astype(float))), mean(np.log(n[:, None]))])


@dataclass
class DocumentModel:
    """Softmax of standardised features of a document."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray) -> DocumentModel:
        center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
        opt = Adam((z.shape[1], len(LEVELS)), rate=0.05)
        for _ in range(600):
            w = opt.w[0]
            opt.step([z.T @ (_softmax(z @ w) - target) / len(z) + 3e-4 * w])
        return cls(center, scale, opt.w[0])

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.center) / self.scale, np.ones((len(x), 1))])
        return _softmax(z @ self.weights)


FOLDS = 3


def fit_part(docs: list[list[list[str]]], target: np.ndarray, part: int) -> SentenceModel | np.ndarray:
    """One of the fits: for parts below ``FOLDS`` the features of every so-manieth document by a model of the others, else the model of all."""
    if part == FOLDS:
        return SentenceModel.fit(docs, target)
    held = np.arange(len(docs)) % FOLDS == part
    model = SentenceModel.fit([d for d, h in zip(docs, held) if not h], target[~held])
    return model.reader().features([d for d, h in zip(docs, held) if h])


def fit(docs: list[list[list[str]]], target: np.ndarray, parts: Callable[[list[int]], list] | None = None) -> tuple[SentenceModel, DocumentModel]:
    """Both models. The second sees the first's judgement of documents that it was not fitted on, so that it is calibrated.

    ``parts`` makes the fits of the given numbers, for example in tasks.
    """
    folds = list(range(FOLDS)) if len(docs) >= 4 * FOLDS else []
    *features, model = parts([*folds, FOLDS]) if parts else [fit_part(docs, target, p) for p in (*folds, FOLDS)]
    if not folds:
        return model, DocumentModel.fit(model.reader().features(docs), target)
    x = np.zeros((len(docs), features[0].shape[1]))
    for f, rows in zip(folds, features):
        x[np.arange(len(docs)) % FOLDS == f] = rows
    return model, DocumentModel.fit(x, target)


def in_tasks(spark: SparkSession, docs: list[list[list[str]]], target: np.ndarray) -> Callable[[list[int]], list]:
    """Makes the fits side by side, a task each, of a sample that is bounded."""
    shared = spark.sparkContext.broadcast((docs, target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                made = pickle.dumps(fit_part(*shared.value, part))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([made], pa.binary())], names=["part", "made"])

    def parts(numbers: list[int]) -> list:
        wanted = spark.range(0, FOLDS + 1, 1, FOLDS + 1).where(F.col("id").isin(numbers))
        got = {r.part: pickle.loads(r.made) for r in wanted.mapInArrow(run, "part long, made binary").collect()}
        return [got[n] for n in numbers]

    return parts


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[" ".join(s) for s in sentences(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "sentences"])


def rated_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_RATED, most_words: int = MOST_RATED_WORDS) -> tuple[list[list[list[str]]], np.ndarray]:
    """(sentences, ratings) of at most ``most`` rated documents with prose, of at most ``most_words`` words in all, the first by hash.

    Several ratings of one document share its weight, and of rows with one id only one counts. Ratings outside the levels and of
    unknown documents do not count.
    """
    votes = labels.where(F.col("level").isin(*LEVELS)).groupBy("doc_id").agg(*[F.count_if(F.col("level") == v).alias(f"n{v}") for v in LEVELS])
    chosen = F.broadcast(votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    words = cut(texts.mapInArrow(_sentences, "doc_id long, sentences array<string>").where("size(sentences) > 0"))
    length = F.aggregate("sentences", F.lit(0).cast("long"), lambda n, s: n + F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1)
    kept, total = [], 0
    for r in words.select("doc_id", length.alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r.n <= most_words:
            kept.append(r.doc_id)
            total += r.n
    got = words.where(F.col("doc_id").isin(kept)).join(chosen, "doc_id").orderBy("doc_id").collect()
    ratings = np.array([[r[f"n{v}"] for v in LEVELS] for r in got], float).reshape(len(got), len(LEVELS))
    return [[s.split(" ") for s in r.sentences] for r in got], ratings / np.maximum(ratings.sum(axis=1, keepdims=True), 1)


def reading_levels(docs: DataFrame, labels: DataFrame, most: int = MOST_RATED) -> DataFrame:
    """(doc_id, level, difficulty, sentences): level 1 to 4, and the expected level, of each document with running prose.

    Documents without prose are left out, and so are all where nothing is rated. Other columns are not read.
    """
    sample, ratings = rated_sample(docs, labels, most)
    schema = "doc_id long, level int, difficulty double, sentences int"
    if not sample:
        return docs.sparkSession.createDataFrame([], schema)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(sample, ratings, in_tasks(spark, sample, ratings)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentence_model, document_model = shared.value
        reader = sentence_model.reader()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(ids), 256):
                read = [(i, s) for i, t in zip(ids[at : at + 256], texts[at : at + 256]) if (s := sentences(t))]
                if not read:
                    continue
                p = document_model.predict(reader.features([s for _, s in read]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in read], pa.int64()), pa.array(np.array(LEVELS)[p.argmax(axis=1)], pa.int32()), pa.array(p @ np.array(LEVELS, float)), pa.array([len(s) for _, s in read], pa.int32())],
                    names=["doc_id", "level", "difficulty", "sentences"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
