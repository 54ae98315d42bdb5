"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, classes, slices
from .common import MULT, mix, with_columns_as

#: The spectrum: n-grams of 1 to ORDERS characters, hashed to DIM presences.
ORDERS, DIM = 3, 1 << 14
_GRAM = (mix(np.arange(1, 9, dtype=np.uint64) * MULT) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def presences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of gram presences (texts x DIM, 0 or 1) of the lower-cased whole texts, and whether each has a letter.

    A run of characters that are no letters counts as one blank.
    """
    joined = "\0".join(t.lower() for t in texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    owner = np.zeros(len(cps), np.int64)
    size = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), size)
    letter = classes()[0][cps] == LETTER
    letter[np.cumsum(size) - 1] = False
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for its run
    keep[np.cumsum(size) - 1] = True
    owner, letter = owner[keep], letter[keep]
    code = np.where(letter, cps[keep], 32).astype(np.uint32) * _GRAM[0]
    flags = np.zeros(len(texts) * DIM, bool)
    total = np.zeros(len(code), np.uint32)
    for k in range(ORDERS):
        total = total[: len(code) - k] + code[k:] * _GRAM[k + 1]
        if not len(total):
            break
        same = owner[: len(total)] == owner[k:]
        slot = ((total ^ (total >> np.uint32(15))) * _GRAM[6 + k % 2] >> np.uint32(18)).astype(np.int64)
        flags[(owner[: len(total)] * DIM + slot)[same]] = True
    return flags.reshape(len(texts), DIM), has


def normalised(flags: np.ndarray) -> np.ndarray:
    """Rows of unit length: their products are the normalised presence kernel."""
    x = flags.astype(np.float32)
    return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)


def fit(train: DataFrame, sample: int = 4_000, landmarks: int = 256, ridge: float = 1e-3, most_languages: int = 512) -> tuple[list[str], np.ndarray]:
    """Languages and weights (DIM x languages) from columns doc_id, text, lang.

    The sample has about ``sample`` rows, an equal share for each language as far as it has them, chosen by a hash of
    doc_id; landmarks are its first rows, language by language. Only the ``most_languages`` most frequent languages are
    learned, so that the weights (64 KB each) have a bound; texts of rarer ones get another label. Kernel ridge regression (one language against the rest,
    rows weighted so that languages count alike) runs in the landmarks' Nystroem space; since the normalised presence
    kernel is a product, landmarks and coefficients fold into one matrix.
    """
    train = train.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return [], np.zeros((DIM, 0), np.float32)
    share = max(1, sample // len(counts))
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 20, -(-(share << 20) // n)))])
    some = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.coalesce(F.element_at(limits, F.col("lang")), F.lit(0)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column("text").to_pylist(), []
            for part in slices(texts, 1 << 18):
                flags, has = presences(part)
                found += [np.packbits(f).tobytes() if h else None for f, h in zip(flags, has, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("order"), pa.array(found, pa.binary())], ["lang", "order", "bits"])

    rows = some.select("lang", F.xxhash64("doc_id", "text").alias("order"), "text").mapInArrow(run, "lang string, order long, bits binary").filter("bits is not null").toPandas()
    rows = rows.sort_values(["lang", "order", "bits"]).reset_index(drop=True)
    names = sorted(rows["lang"].unique())
    if not names:
        return [], np.zeros((DIM, 0), np.float32)
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), DIM // 8)
    vectors = lambda at: normalised(np.unpackbits(bits[at], axis=1))
    rank = rows.groupby("lang").cumcount().to_numpy()
    z = vectors(np.flatnonzero(rank < max(2, landmarks // len(names))))
    value, basis = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = basis[:, keep] / np.sqrt(value[keep])  # K ** -1/2 on its range
    phi = np.concatenate([vectors(np.arange(lo, min(lo + 256, len(rows)))) @ z.T for lo in range(0, len(rows), 256)]) @ root
    at = rows["lang"].map({n: k for k, n in enumerate(names)}).to_numpy()
    weight = (1 / np.bincount(at))[at] / len(names)
    target = np.where(at[:, None] == np.arange(len(names)), 1.0, -1.0)
    phi1 = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
    coef = np.linalg.solve(phi1.T @ (phi1 * weight[:, None]) + ridge * np.diag([1.0] * phi.shape[1] + [0.0]) / len(names), phi1.T @ (target * weight[:, None]))
    folded = z.T @ (root @ coef[:-1]).astype(np.float32)
    return names, np.concatenate([folded, coef[-1:].astype(np.float32)])


def predict(df: DataFrame, names: list[str], weights: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of each row from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. The score is the winner's share
    after a softmax of the one-against-rest margins. Batches of presences are multiplied with the weights.
    """
    shared = df.sparkSession.sparkContext.broadcast((names, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for b in batches:
            lang, score = [], []
            for part in slices([t or "" for t in b.column("text").to_pylist()], 1 << 18):
                for lo in range(0, len(part), 256):  # a row of presences for each text
                    flags, has = presences(part[lo : lo + 256])
                    if not names:
                        has[:] = False
                        margin = np.zeros((len(flags), 1))
                    else:
                        margin = normalised(flags) @ weights[:-1] + weights[-1]
                    best = margin.argmax(axis=1)
                    share = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
                    top = 1 / share.sum(axis=1)
                    lang += [names[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                    score += np.where(has, top, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return with_columns_as(df, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    """A fifth of the documents by crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def result(df: DataFrame) -> DataFrame:
    """Fits on rows that aren't held out, predicts all: doc_id, held_out, lang_pred, score."""
    docs = with_columns_as(df, doc_id="long", text="string", lang="string")
    names, weights = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, names, weights).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
