"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.operators.storage import saved

#: Odd multiplier of the polynomial word and gram hashes.
MULT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: later branches don't recompute it and a lost executor costs nothing."""
    return saved(df, label)


def row_of(df: DataFrame, but: tuple[str, ...] = ()) -> tuple[Column, dict[str, str]]:
    """All columns of df as one struct named row, and each one's field in it: no name of a user's can clash outside."""
    field = {c: f"c{k}" for k, c in enumerate(df.columns) if c not in but}
    return F.struct(F.lit(0).alias("_"), *[df[f"`{c}`"].alias(f) for c, f in field.items()]).alias("row"), field


def by_key(rows: DataFrame, small: DataFrame, hot: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with small, which has a row or few for each key; rows has hot: whether a key is one of the broadcast few.

    A frequent key's rows stay where they are and meet a broadcast of its rows of small; only the others are shuffled.
    """
    few = small.join(F.broadcast(hot), "key", "left_semi")
    rest = small.join(F.broadcast(hot), "key", "left_anti")
    return rows.filter("hot").join(F.broadcast(few), keys, how).unionByName(rows.filter("not hot").join(rest, keys, how))


def with_columns_as(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null. Extra columns never clash with an operator's own."""
    have = set(df.columns)
    return df.select(*[(df[c] if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def packed_rows(*columns: np.ndarray, tail: np.ndarray | None = None) -> bytes:
    """Equally long columns one after the other behind their length, compressed; tail holds bytes of any number."""
    parts = [np.array([len(columns[0])], np.int64), *columns, *([] if tail is None else [tail])]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def unpacked_rows(blob: bytes, *kinds: type, tail: bool = False) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return (*out, np.frombuffer(raw, np.uint8, -1, at)) if tail else tuple(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = {}


def powers(n: int) -> np.ndarray:
    """MULT ** 0 .. n-1 modulo 2 ** 64, grown on demand."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        np.multiply.accumulate(np.full(size - 1, MULT), out=have[1:])
        _POWERS["p"] = have
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte but letters and digits.
_PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One random 64-bit value per byte, from a rule.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULT)


def word_hashes(texts: list[str | None], lower: bool = True, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and each text's number of words.

    With letters, any ASCII character but letters and digits separates words. Only A-Z are lower-cased. A word's hash is a polynomial over random byte values, finalised; it is the same in any
    process.
    """
    blob = "\n".join([t or "" for t in texts]).encode() + b"\n"
    raw = np.frombuffer(blob, np.uint8)
    space = (_PUNCT if letters else _SPACE)[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    sizes = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    if lower:
        raw = _LOWER[raw]
    length = stop - start
    at = np.flatnonzero(~space)
    inside = at - np.repeat(start, length)
    value = _BYTE[raw[at]] * powers(int(length.max()))[inside]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64)), counts
