"""Values in free text replaced by labels and back, for any number of values and texts.

Values aren't broadcast. A value is known by the hash of its anchor: the whole value up to 64 code points, of a longer one the
first 64, 128, 256, ... that it has. Tasks hash all substrings of their texts that have the length of an anchor (rolling, with
numpy), two bit maps of fixed size drop nearly all, and what is left asks for its values in a join by hash. Each text then meets
its own few values in an automaton that reads it once. Hashes only propose; the automaton compares characters.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.operators.storage import parts, saved

#: Anchors up to this length are whole values.
WHOLE = 64
#: Code points of the prefix that is looked up before all anchors are.
PREFIX = 4
#: Bits of the maps of anchors and of prefixes (8 MB and 1 MB, whatever the input).
ANCHOR_BITS, PREFIX_BITS = 26, 23
#: Code points hashed side by side.
SLICE = 1 << 20
#: Up to this many words of a text need no automaton.
FEW = 8
#: Kinds of labels, a fixed vocabulary.
MOST_KINDS = 1000
#: Types of columns that pass through a task as they are.
PASSED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.DecimalType)
#: Stands where a label would else run into its surroundings, or where a text spells a label by itself; doubled if the text has it.
MARK = "\u2060"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BETWEEN = 0x110000  # no code point: nothing matches across two texts


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Hashes:
    """Hashes of substrings of code points, each in constant time."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        up, down = np.full(n + 1, _BASE), np.full(n + 1, _BACK)
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * np.cumprod(up, dtype=np.uint64)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        lengths = np.atleast_1d(lengths)
        h = (self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + lengths.astype(np.uint64) * _MIX
        for _ in range(2):
            h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def anchor_length(n: np.ndarray) -> np.ndarray:
    """n up to WHOLE, beyond it the greatest power of two that isn't above n."""
    return np.where(n <= WHOLE, n, 1 << (np.frexp(np.maximum(n, 1).astype(float))[1] - 1))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a map for each hash."""
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(64 - bits)) & mask).astype(np.int64)


def _together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts with one that is none after each, and where each text starts."""
    parts = [codes(t) for t in texts]
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    out = np.full(starts[-1], _BETWEEN, dtype=np.uint32)
    for p, s in zip(parts, starts, strict=False):
        out[s : s + len(p)] = p
    return out, starts


def known(words: DataFrame) -> DataFrame:
    """words (word, label) with length of the anchor, its hash, two bits for it and two for the word's prefix; empty and null words go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points, starts = _together(list(b["word"]))
            size = np.diff(starts) - 1
            hashes, anchor = Hashes(points), anchor_length(size)
            h = hashes.of(starts[:-1], anchor)
            first = hashes.of(starts[:-1], np.minimum(size, PREFIX))
            b["length"], b["hash"] = anchor, h.view(np.int64)
            b["bit"], b["bit2"] = _places(h, ANCHOR_BITS)
            b["front"], b["front2"] = _places(first, PREFIX_BITS)
            yield b

    rows = words.filter("word <> '' and label is not null").groupBy("word").agg(F.min("label").alias("label"))
    return rows.mapInPandas(run, "word string, label string, length long, hash long, bit long, bit2 long, front long, front2 long")


def _bits(rows: DataFrame, one: str, two: str, bits: int) -> np.ndarray:
    """A map of 2^bits bits, made by all tasks in pieces of 4 KB."""
    each = rows.select(F.explode(F.array(one, two)).alias("bit"))
    number = F.floor(F.col("bit") / 32768)
    made = each.groupBy(number.alias("piece")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("map")).collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in made:
        at = int(r["piece"]) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
    return out


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter, a digit or an underscore."""
    return np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(_BETWEEN)), bool, _BETWEEN)


def _edges(points: np.ndarray) -> np.ndarray:
    """Whether a run of letters, digits and underscores starts or ends before each point, and after the last."""
    letter = np.zeros(len(points) + 2, bool)
    real = points < _BETWEEN
    letter[1:-1][real] = _letters()[points[real]]
    return letter[1:] != letter[:-1]


def _proposals(points: np.ndarray, lengths: list[int], anchors: np.ndarray, prefixes: np.ndarray, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of substrings that may be anchors; whole: only those that chosen() may take as whole words."""
    border = _edges(points) if whole else None
    short, top = [n for n in lengths if n < PREFIX], max(lengths)
    for s in range(0, len(points), SLICE):
        part = points[s : s + SLICE + top]
        hashes, stop = Hashes(part), min(SLICE, len(part))
        starts = np.arange(min(stop, max(len(part) - PREFIX + 1, 0)))
        starts = starts[border[starts + s]] if whole else starts
        a, b = _places(hashes.of(starts, PREFIX), PREFIX_BITS)
        likely = starts[_set(prefixes, a) & _set(prefixes, b)]
        for n in lengths:
            at = (np.arange(stop) if n in short else likely)
            at = at[at + n <= len(part)]
            if whole:  # a longer word's end is not known yet
                at = at[border[at + s] & (border[at + s + n] if n < WHOLE else True)]
            h = hashes.of(at, n)
            a, b = _places(h, ANCHOR_BITS)
            hit = _set(anchors, a) & _set(anchors, b)
            yield at[hit] + s, h[hit]


def found(texts: DataFrame, words: DataFrame, whole: bool = False) -> DataFrame:
    """(id, hash) of words that may be in texts (id, text), each once a text (once a slice of a long one); words from known()."""
    lengths = sorted(r["length"] for r in words.select("length").distinct().collect())  # at most WHOLE and the powers of two
    if not lengths:
        return texts.select("id", F.lit(0).cast("long").alias("hash")).filter("false")
    anchors, prefixes = (_bits(words, *c, n) for c, n in ((("bit", "bit2"), ANCHOR_BITS), (("front", "front2"), PREFIX_BITS)))
    session = texts.sparkSession.sparkContext
    shared = session.broadcast((anchors, prefixes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            points, starts = _together(list(b["text"]))
            ids = b["id"].to_numpy()
            for at, h in _proposals(points, lengths, *shared.value, whole):
                own = ids[np.searchsorted(starts, at, side="right") - 1]
                yield pd.DataFrame({"id": own, "hash": h.view(np.int64)}).drop_duplicates()

    return texts.filter("text is not null").mapInPandas(run, "id long, hash long")


def _hits(text: str, words: dict[str, str]) -> Iterator[tuple[int, tuple[str, str]]]:
    """Last place, word and label wherever a word stands in a text; a few short words are looked up one by one."""
    if len(words) <= FEW and max(map(len, words)) <= WHOLE:
        for w, label in words.items():
            at = text.find(w)
            while at >= 0:
                yield at + len(w) - 1, (w, label)
                at = text.find(w, at + 1)
        return
    machine = ahocorasick.Automaton()
    for w, label in words.items():
        machine.add_word(w, (w, label))
    machine.make_automaton()
    yield from machine.iter(text)


def chosen(text: str, words: dict[str, str], whole: bool) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, label) in a text: longest words first, then by word, then from the left.

    whole: only where a word starts and ends at the edge of a run of letters, digits and underscores.
    """
    letter = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    edge = lambda i: letter(i - 1) != letter(i)
    hits = sorted((-len(w), w, end + 1 - len(w), label) for end, (w, label) in _hits(text, words))
    taken, out = bytearray(len(text)), []
    for size, _, start, label in hits:
        end = start - size
        if (not whole or (edge(start) and edge(end))) and taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * -size
            out.append((start, end, label))
    return sorted(out)


def _is_letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def hide(text: str, words: dict[str, str], kinds: re.Pattern) -> str:
    """The text with words as labels; what would not come back by itself is marked."""
    out, last = [], 0
    for start, end, label in [*(chosen(text, words, False) if words else []), (len(text), len(text), "")]:
        piece = text[last:start].replace(MARK, MARK * 2)
        if "-" in piece:  # no kind stands for a label without it
            piece = kinds.sub(rf"\g<0>{MARK}", piece)
        if last and _is_letter(piece[:1]):  # a label stands before it
            out.append(MARK)
        out.append(piece)
        if label and (_is_letter(piece[-1]) if piece else last):
            out.append(MARK)
        out.append(label)
        last = end
    return "".join(out)


def restore(text: str, words: dict[str, str]) -> str:
    """The inverse of hide()."""
    out, last = [], 0
    for start, end, value in [*(chosen(text, words, True) if words else []), (len(text), len(text), "")]:
        piece = text[last:start]
        out += [re.sub(f"{MARK}({MARK}?)", r"\1", piece) if MARK in piece else piece, value]
        last = end
    return "".join(out)


def _kinds(labels: DataFrame) -> re.Pattern:
    """What a label begins with, where a text spells one by itself."""
    kinds = [r["kind"] for r in labels.select(F.regexp_extract("label", r"^(\w+)-\d+$", 1).alias("kind")).distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"labels have over {MOST_KINDS} kinds")
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(filter(None, kinds), key=len, reverse=True)) or ["(?!)"]) + r")(?=-\d)")


def _through(texts: DataFrame, column: str, words: DataFrame, kinds: re.Pattern | None) -> DataFrame:
    """hide(), or restore() without kinds, over all texts: rows and what they ask for meet by number, other columns pass by."""
    others = [F.col(f"`{c}`") for c in texts.columns if c != column]
    rows = saved(texts.select(F.monotonically_increasing_id().alias("id"), F.col(f"`{column}`").alias("text"), F.struct(F.lit(0).alias("0"), F.struct(*others).alias("of") if others else F.lit(0).alias("of")).alias("row")))
    index = saved(known(words))
    n = parts(texts.sparkSession, rows.count())
    own = found(rows.select("id", "text"), index, kinds is None).join(index.select("hash", "word", "label"), "hash").select("id", "word", "label")
    own = own.repartition(n, "id").groupBy("id").agg(F.collect_list("word").alias("words"), F.collect_list("label").alias("labels"))
    by = isinstance(rows.schema["row"].dataType["of"].dataType, T.StructType) and all(isinstance(f.dataType, PASSED) for f in rows.schema["row"].dataType["of"].dataType)
    beside = "row" if by else "id"  # columns of plain types pass through the tasks, others join again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            words, labels = b.column("words"), b.column("labels")  # lists of one length, read flat
            at = words.offsets.to_pylist()
            pairs = list(zip(words.flatten().to_pylist(), labels.flatten().to_pylist(), strict=True))
            first = at[0] if at else 0
            for k, text in enumerate(b.column("text").to_pylist()):
                mine = dict(pairs[at[k] - first : at[k + 1] - first])
                made.append(None if text is None else restore(text, mine) if kinds is None else hide(text, mine, kinds))
            yield pa.RecordBatch.from_arrays([b.column(beside), pa.array(made, pa.string())], [beside, "new"])

    met = rows.select("id", "text", *(["row"] if by else [])).repartition(n, "id").join(own, "id", "left")
    new = met.mapInArrow(run, T.StructType([rows.schema[beside], T.StructField("new", T.StringType())]))
    out = new if by else rows.select("id", "row").join(new, "id")
    return out.select(*[(F.col("new") if c == column else F.col(f"row.of.`{c}`")).alias(c) for c in texts.columns])


def hidden(texts: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """texts with the values in a column replaced by their labels; labels: value, label (a kind, a hyphen and a number).

    Longest values first, then by value, then from the left, on the text as it was. Null texts stay null; empty values match
    nothing; of two labels of one value the smaller counts; rows may repeat, column names may not.
    """
    return _through(texts, column, labels.select(F.col("value").alias("word"), "label"), _kinds(labels))


def restored(texts: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Whole labels become values again; of a text that hidden() made, exactly the text it was made from."""
    return _through(texts, column, labels.select(F.col("label").alias("word"), F.col("value").alias("label")), None)
