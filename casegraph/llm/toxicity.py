"""Toxicity by classifier chains: linear models whose later ones see earlier categories' probabilities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns_as, word_hashes
from .minhash import runs


def word_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted hashes of each whole text's distinct words (ASCII punctuation separates, A-Z lower-cased)."""
    words, counts = word_hashes(texts, letters=True)
    at = 0
    for n in counts.tolist():
        yield np.unique(words[at : at + n])
        at += n


@dataclass
class Chain:
    """Categories in chain order, the known words, and one linear model each over words, then earlier probabilities."""

    names: list[str]
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def presences(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)), bool)
        if len(self.words):
            for k, s in enumerate(word_sets(texts)):
                at = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
                x[k, at[self.words[at] == s]] = True
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)))
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            out[:, k] = sigmoid(x @ w[: x.shape[1]] + out[:, :k] @ w[x.shape[1] :] + b)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 30.0) -> tuple[np.ndarray, float]:
    """Ridge regression on +1 and -1, both classes of equal weight; the margins' weights and bias."""
    if not y.any() or y.all():
        return np.zeros(x.shape[1]), 1.0 if y.all() else -1.0
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    xb = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
    gram = ((xb.T * weight.astype(np.float32)) @ xb).astype(np.float64)
    gram[np.arange(x.shape[1]), np.arange(x.shape[1])] += ridge
    w = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), xb.T @ (weight * np.where(y, 1.0, -1.0)))
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by damped Newton steps."""
    a, c = 2.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + c)
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * margin).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * c])
        h = np.array([[(v * margin * margin).sum() + 1e-2, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    return float(a), float(c)


def cut_of(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that gives the best F1 out of fold, halfway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    ends = np.append(np.diff(p[order]) < 0, True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fit(df: DataFrame, labels: DataFrame, categories: list[str], sample: int = 8_000, words: int = 120, folds: int = 5) -> Chain:
    """Trains a chain on labels (doc_id and a 0/1 column for each category).

    At most about ``sample`` labels by a hash of doc_id, and each category's ``words`` most telling words (chi-square,
    at least four documents), bound what reaches the driver; statistics are folded in Spark. Each model after the first
    also gets earlier categories' probabilities, in training those predicted out of fold. Labels given twice count as
    their greatest; null ones are left out.
    """
    spark = df.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), *[F.col(c).cast("int").alias(f"__y{k}") for k, c in enumerate(categories)]).dropna()
    n = marks.count()
    marks = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < F.lit(min(1 << 20, (sample << 20) // max(n, 1))))
    marks = marks.groupBy("__id").agg(*[F.max(f"__y{k}").alias(f"y{k}") for k in range(len(categories))])
    ys = [f"y{k}" for k in range(len(categories))]
    docs = with_columns_as(df, doc_id="long", text="string")
    rows = materialize(docs.join(F.broadcast(marks), F.col("doc_id") == F.col("__id")).select(F.xxhash64("doc_id", "text").alias("fold"), "text", *ys), "labelled")
    chain = Chain(categories)

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in runs(texts):
                sets = list(word_sets(texts[lo:hi]))
                at = np.repeat(np.arange(lo, hi), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *[b.column(y).take(pa.array(at)) for y in ys]], ["word", *ys])

    total = rows.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    if not total["n"]:
        chain.weights, chain.biases, chain.cuts = [np.zeros(k) for k in range(len(categories))], [-30.0] * len(categories), [1.0] * len(categories)
        return chain
    counted = rows.select("text", *ys).mapInArrow(explode, "word long, " + ", ".join(f"{y} int" for y in ys)).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).filter("n >= 4")
    counted = materialize(counted, "counted")
    known: set[int] = set()
    for y in ys:
        all_n, all_y = float(total["n"]), float(total[y])
        expected = F.col("n") * (all_y / all_n)
        chi = (F.col(y) - expected) * (F.col(y) - expected) / F.greatest(expected, F.lit(1e-9))
        known |= {r["word"] for r in counted.orderBy(F.desc(chi), "word").limit(words).collect()}
    chain.words = np.sort(np.array(sorted(known), np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(chain)

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column("text").to_pylist(), []
            for lo, hi in runs(texts):
                found += [np.packbits(r).tobytes() for r in shared.value.presences(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([b.column("fold"), *[b.column(y) for y in ys], pa.array(found, pa.binary())], ["fold", *ys, "bits"])

    got = rows.select("fold", *ys, "text").mapInArrow(bits, "fold long, " + ", ".join(f"{y} int" for y in ys) + ", bits binary").toPandas().sort_values(["fold", "bits"])
    width = -(-len(chain.words) // 8)
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), width), axis=1)[:, : len(chain.words)].astype(np.float32)
    fold = (got["fold"].to_numpy() % folds + folds) % folds
    before = np.zeros((len(got), 0), np.float32)
    for y in ys:
        goal = got[y].to_numpy() > 0
        given = np.concatenate([x, before], axis=1)
        margin = np.zeros(len(got))
        for k in range(folds):
            w, b = linear(given[fold != k], goal[fold != k]) if (fold != k).any() else (np.zeros(given.shape[1]), -1.0)
            margin[fold == k] = given[fold == k] @ w + b
        a, c = calibrate(margin, goal)
        w, b = linear(given, goal)
        chain.weights.append(w * a)
        chain.biases.append(b * a + c)
        guess = sigmoid(margin * a + c)
        chain.cuts.append(cut_of(guess, goal))
        before = np.concatenate([before, guess[:, None].astype(np.float32)], axis=1)
    return chain


def predict(df: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> and is_<category> of each row, from its whole text alone.

    Null and empty texts have no words and get what the models say of none, but are never flagged. Rows stand alone.
    """
    shared = df.sparkSession.sparkContext.broadcast(chain)
    names = [*(f"p_{c}" for c in chain.names), *(f"is_{c}" for c in chain.names)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            texts, found = b.column("text").to_pylist(), [np.zeros((0, len(chain.names)))]
            for lo, hi in runs(texts):
                found.append(chain.probabilities(chain.presences(texts[lo:hi]).astype(np.float32)))
            p = np.concatenate(found)
            some = np.array([bool(t and t.strip()) for t in texts], bool)
            flags = [(p[:, k] >= cut) & some for k, cut in enumerate(chain.cuts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c) for c in p.T], *[pa.array(f) for f in flags]], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} {'double' if n.startswith('p_') else 'boolean'}" for n in names)
    return with_columns_as(df, doc_id="long", text="string").mapInArrow(run, schema)


#: The query's chain: text of low quality, toxic text, and text that is both.
CATEGORIES = ["low_quality", "toxic", "toxic_low_quality"]


def result(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic (the verdict) and the chain's probabilities and flags."""
    marks = labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic"), ((1 - F.col("quality").cast("int")) * F.col("toxic").cast("int")).alias("toxic_low_quality"))
    out = predict(df, fit(df, marks, CATEGORIES))
    return out.select("doc_id", F.col("is_toxic").alias("toxic"), *[c for c in out.columns if c not in ("doc_id", "is_toxic")])
