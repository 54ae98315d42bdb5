"""Best-fit packing of token pieces into sequences under token, document-count and attention-cost capacities.

A piece's demand (length, 1, length squared) depends on its length alone, so the plan is made for whole classes of equal
pieces: a histogram of at most ``max_tokens`` counts goes to the driver, vector best-fit decreasing runs over classes of
bins with equal residuals, and every piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, with_columns_as

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a shard, and the most shards: an offset table has at most shards x max_tokens rows.
SHARD_ROWS, MOST_SHARDS = 20_000, 32_768


def token_pieces(df: DataFrame, path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: ids of the text and end_id; a longer document is cut into full pieces, the first may be shorter.

    Null text counts as empty (one piece with the end id alone). Repeated rows stay apart.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        enc = bpe.load(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            docs, row = b.column("doc_id").to_pylist(), 0
            out: list[list] = [[], [], [], [], []]
            for part in bpe.slices(texts):
                flat, counts = enc.encode_batch(part)
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, np.uint32(end_id))
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                lo = 0
                for hi in ends:
                    at, piece = lo, 0
                    while at < hi:
                        stop = min(hi, at + ((hi - at) % max_tokens or max_tokens))
                        for o, v in zip(out, (docs[row], piece, at - lo, stop - at, zlib.crc32(flat[at:stop].tobytes())), strict=True):
                            o.append(v)
                        at, piece = stop, piece + 1
                    lo, row = hi, row + 1
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_columns_as(df, doc_id="long", text="string").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], max_tokens: int, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Places classes of equal pieces, longest first; rows (length, first rank, pieces, first sequence, offset).

    A bin fits if every residual (tokens, documents, cost) covers the demand. ``norm`` takes the bin with the least
    weighted norm of what would be left, ``dot`` the one with the greatest weighted dot product of demand and residual;
    a new sequence opens only if none fits. Residuals are shares of the capacities. A capacity that the token capacity
    implies can't bind and isn't kept in a bin's state. Bins of one state are interchangeable and form one class, so a
    step places as many pieces as the rule would place there one after the other.
    """
    caps = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], np.int64)
    binding = np.array([True, caps[1] < max_tokens, caps[2] < max_tokens**2])
    scale = np.array(weights) / np.maximum(caps, 1)
    out: list[tuple[int, int, int, int, int]] = []
    residual = np.zeros((0, 3), np.int64)
    holds: list[list[list[int]]] = []  # of each state: [first sequence, sequences]
    where: dict[tuple, int] = {}
    sequences = 0

    def put(state: np.ndarray, first: int, n: int) -> None:
        nonlocal residual
        key = tuple(np.where(binding, state, 0).tolist())
        if (at := where.get(key)) is None:
            at = where[key] = len(holds)
            holds.append([])
            residual = np.vstack([residual, state])
        holds[at].append([first, n])

    for length in sorted(counts, reverse=True):
        left, rank = int(counts[length]), 0
        need = np.array([length, 1, length * length], np.int64)
        if (binding & (need > caps)).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            live = np.array([bool(h) for h in holds], bool)
            after = residual - need
            fits = np.flatnonzero(live & ((after >= 0) | ~binding).all(axis=1)) if len(holds) else np.zeros(0, np.int64)
            if len(fits):
                if rule == "norm":
                    best = fits[np.argmin((((after[fits] * scale) ** 2) * binding).sum(axis=1))]
                else:
                    best = fits[np.argmax((need * scale * residual[fits] * scale * binding).sum(axis=1))]
                state, bins = residual[best].copy(), holds[best]
            else:
                state, bins = caps.copy(), [[sequences, left]]
            many = int(np.min(np.where(binding, state // need, np.int64(1) << 60))) if rule == "norm" or not len(fits) else 1
            many = min(many, left)
            took = 0
            while bins and left:
                first, n = bins.pop()
                each = many if left >= many else left
                use = min(n, left // each)
                if use < n and len(fits):
                    bins.append([first + use, n - use])
                for k in range(each):
                    out.append((length, rank + k * use, use, first, max_tokens - int(state[0]) + k * length))
                rank, left, took = rank + each * use, left - each * use, took + use
                put(state - each * need, first, use)
                if not len(fits):
                    sequences += use
                    if left:
                        bins.append([sequences, left])
    return np.array(out, np.int64).reshape(-1, 5)


def pack(df: DataFrame, path: str, max_tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Packs all documents; returns PIECES with sequence_id and offset (gapless from 0 in each sequence).

    Equal rows are interchangeable. An empty table gives no rows. Only the histogram of lengths reaches the driver.
    """
    pieces = materialize(token_pieces(df, path, max_tokens), "pieces")
    spark = df.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(counts, max_tokens, max_docs, max_cost, rule, weights)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    shards = min(MOST_SHARDS, 1 + sum(counts.values()) // SHARD_ROWS)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), F.lit(shards)).cast("int"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "length").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "length", "base")

    def place(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        t = shared.value
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable")
        rank = rows.groupby("length").cumcount().to_numpy() + rows["length"].map(base.set_index("length")["base"]).to_numpy()
        span = int(t[:, 1].max()) + int(t[:, 2].max()) + 1
        k = np.searchsorted(t[:, 0] * span + t[:, 1], rows["length"].to_numpy() * span + rank, side="right") - 1
        return rows.assign(sequence_id=t[k, 3] + rank - t[k, 1], offset=t[k, 4])[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return dealt.groupBy("shard").cogroup(offsets.groupBy("shard")).applyInPandas(place, PIECES + ", sequence_id long, offset long")
