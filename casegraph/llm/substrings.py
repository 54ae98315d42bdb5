"""Exact removal of byte strings that start in an earlier document, through suffix arrays of their surroundings.

A match of MATCH bytes carries its least gram along, its anchor. Documents are dealt into groups. Each group tells every
shard of anchors what it holds and hears which anchors several documents have: only there can matches be. What the matches
of such an anchor span (the context) goes, once for each group, to a shard of contexts; there each anchor's different
contexts form one string whose suffix array brings equal matches together, and their least document goes back to the
groups that asked. Each group then cuts its texts. Contexts of an anchor in very many documents go in two pieces, by the
bytes that all matches of a piece hold, so that one anchor spreads over the shards. Hashes only sort and deal: wherever
two strings are taken for one, their bytes were compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULT, mix, packed_rows, unpacked_rows, with_columns_as
from .grams import GRAM, MATCH, SLICE_BYTES, SPAN, Grams, span_hashes
from .suffixes import _ranges, suffix_arrays

#: Bytes of text in a group of documents, for a shard of contexts and for a shard of anchors.
GROUP_BYTES, SHARD_BYTES, CENSUS_BYTES = 4 << 20, 2 << 20, 16 << 20
#: Documents (255 a group at most count) that make an anchor a common one, whose contexts go in pieces.
COMMON = 1024
LEAST_ID = -(1 << 63)
#: Bytes before the anchor in a match, in classes: matches of one class and anchor are equal only if they agree in the
#: bytes that all of the class hold, so only such contexts are sorted in one string.
BACK = ((23, SPAN - 1), (15, 22), (8, 14), (0, 7))
#: The classes in which the contexts of a common anchor go to the shards.
WIDE = ((15, SPAN - 1), (0, 14))
#: Bytes of pieces that are sorted at once (whole strings, one at least).
SORT_BYTES = 1 << 20


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Index, place in the joined bytes and bytes of each text; of a long one parts, each match being in just one of them."""
    at = 0
    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - MATCH + 1), SLICE_BYTES):
            yield k, at + lo, t[lo : lo + SLICE_BYTES + MATCH - 1]
        at += len(t)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _differ(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a differ from those from b; sizes are of eight or more."""
    out = np.zeros(len(a), bool)
    if len(a):
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        for k in range(0, int(size.max()), 8):
            at = np.minimum(k, size - 8)
            out |= words[a + at] != words[b + at]
    return out


def _classes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal strings (and places of the anchor in them) are neighbours, stable, and where a new one begins.

    The last of the keys is the most important. Strings of equal keys are compared; should they differ, their bytes decide.
    """
    order = np.lexsort(keys)
    new = _heads(*(k[order] for k in keys))
    if not len(order):
        return order, new
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    check = np.flatnonzero(~new)
    x, y = order[check], head[check]
    wrong = (size[x] != size[y]) | (offset[x] != offset[y])
    wrong[~wrong] = _differ(raw, begin[x[~wrong]], begin[y[~wrong]], size[x[~wrong]])
    if wrong.any():
        edge = np.append(np.flatnonzero(new), len(order))
        for run in np.unique(np.cumsum(new)[check[wrong]] - 1).tolist():
            lo, hi = int(edge[run]), int(edge[run + 1])
            name = lambda k: (int(offset[k]), raw[begin[k] : begin[k] + size[k]].tobytes())
            rows = sorted(order[lo:hi].tolist(), key=lambda k: (name(k), k))
            order[lo:hi] = rows
            new[lo + 1 : hi] = [name(a) != name(b) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    return order, new


#: Indexes of some pieces' texts, their places in the joined bytes, and their grams.
Slice = tuple[np.ndarray, np.ndarray, Grams]


def _grams(texts: list[bytes]) -> Iterator[Slice]:
    """The grams of the texts, so many bytes at once."""
    some, size = [], 0
    for piece in _pieces(texts):
        some.append(piece)
        size += len(piece[2])
        if size >= SLICE_BYTES:
            yield np.array([k for k, _, _ in some]), np.array([at for _, at, _ in some]), Grams([t for _, _, t in some])
            some, size = [], 0
    if some:
        yield np.array([k for k, _, _ in some]), np.array([at for _, at, _ in some]), Grams([t for _, _, t in some])


class Contexts:
    """Contexts in the joined bytes of some texts: owner, begin, size, place of the anchor and its hash."""

    def __init__(self, grams: Iterable[Slice], wanted: Callable[[np.ndarray], np.ndarray]):
        """Of the anchors whose hashes are wanted."""
        parts = []
        for texts, places, g in grams:
            some = np.flatnonzero(wanted(g.hashes)) if len(g.hashes) else ()
            if len(some):
                first, size = g.contexts(some)
                piece = g.owners()[some]
                parts.append((texts[piece], places[piece] + first - g.start[piece], size, g.at[some] - first, g.hashes[some]))
        self.owner, self.begin, self.size, self.offset, self.anchor = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (*[np.int64] * 4, np.uint64))

    def piece(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the contexts with matches that begin lo to hi bytes before the anchor: index, begin, size, place of the anchor."""
        start = np.maximum(self.offset - hi, 0)
        count = np.minimum(self.size - MATCH + 1, self.offset - lo + 1) - start
        some = np.flatnonzero(count > 0)
        return some, self.begin[some] + start[some], count[some] + MATCH - 1, self.offset[some] - start[some]


def _content(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A hash of each string and its anchor's place; in slices by order of begin."""
    by = np.argsort(begin, kind="stable")
    out = np.empty(len(begin), np.uint64)
    out[by] = span_hashes(raw, begin[by], size[by], sized=True)
    return out + offset.astype(np.uint64) * MULT


def _sorted_texts(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """The rows of a group in an order of their own (id, then text), ids and texts."""
    z = zstandard.ZstdDecompressor()
    ids = [LEAST_ID if i is None else i for i in table.column("doc_id").to_pylist()]
    texts = [b"" if x is None else z.decompress(x) for x in table.column("packed").to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return table.take(pa.array(order, pa.int64())), np.array([ids[k] for k in order], np.int64), [texts[k] for k in order]


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards of hashes, in their order."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _anchors(grams: Iterable[Slice]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors in order, and in how many texts each is."""
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for texts, _, g in grams:
        found.append(g.hashes)
        owner.append(texts[g.owners()])
    h, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = _heads(h, owner)
    h = h[first]
    head = np.flatnonzero(_heads(h))
    return h[head], np.diff(np.append(head, len(h)))


def _rows(names: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(names)], [n for n, _ in names])


_GROUP_ROW = [("group", pa.int64()), ("shard", pa.int64()), ("packed", pa.binary())]


def tell(table: pa.Table, shards: int) -> pa.Table:
    """A group's anchors for each of the census shards: the lower halves of their hashes, and their texts up to 255."""
    group = table.column("group")[0].as_py()
    h, texts = _anchors(_grams(_sorted_texts(table)[2]))
    shard = _shard_of(h, shards)
    edge = np.append(np.flatnonzero(_heads(shard)), len(h)).tolist() if len(h) else [0]
    low, many = h.astype(np.uint32), np.minimum(texts, 255).astype(np.uint8)
    return _rows(_GROUP_ROW, [(group, int(shard[x]), packed_rows(low[x:y], many[x:y])) for x, y in zip(edge[:-1], edge[1:], strict=True)])


def census(table: pa.Table) -> pa.Table:
    """For each group and each anchor it told: 0 if it is in one text only, 2 if it is common, else 1."""
    got = [unpacked_rows(x, np.uint32, np.uint8) for x in table.column("packed").to_pylist()]
    sizes = [len(a) for a, _ in got]
    value, many = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(value, kind="stable")
    head = np.flatnonzero(_heads(value[order]))
    total = np.add.reduceat(many[order].astype(np.int64), head)
    mark = np.empty(len(value), np.uint8)
    mark[order] = np.repeat((total > 1).astype(np.uint8) + (total >= COMMON), np.diff(np.append(head, len(value))))
    end = np.cumsum(sizes)
    marks = [packed_rows(mark[e - n : e]) for n, e in zip(sizes, end, strict=True)]
    return pa.table([table.column("group"), table.column("shard"), pa.array(marks, pa.binary())], [n for n, _ in _GROUP_ROW])


def ask(table: pa.Table, marks: pa.Table, shards: int) -> pa.Table:
    """A group's different contexts of shared anchors, for the shards: where, whose first and last, and their bytes."""
    if not table.num_rows:
        return _rows(_GROUP_ROW, [])
    _, ids, texts = _sorted_texts(table)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    told = np.concatenate([np.zeros(0, np.uint8), *(unpacked_rows(x, np.uint8)[0] for _, x in sorted(zip(marks.column("shard").to_pylist(), marks.column("packed").to_pylist(), strict=True)))])
    grams = list(_grams(texts))
    have = _anchors(grams)[0]
    shared, common = have[told > 0], have[told > 1]
    known = lambda of, h: of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h if len(of) else np.zeros(len(h), bool)
    f = Contexts(grams, lambda h: known(shared, h))
    del grams
    wide = known(common, f.anchor)
    whole = np.flatnonzero(~wide)
    parts = [(whole, f.begin[whole], f.size[whole], f.offset[whole], f.anchor[whole])]
    for lo, hi in WIDE if wide.any() else ():
        some, begin, size, offset = f.piece(lo, hi)
        pick = wide[some]
        some, begin, size, offset = some[pick], begin[pick], size[pick], offset[pick]
        by = np.argsort(begin + offset, kind="stable")
        key = np.empty(len(some), np.uint64)
        key[by] = span_hashes(raw, (begin + offset)[by] - lo, np.full(len(some), MATCH - hi + lo))
        parts.append((some, begin, size, offset, mix(key + np.uint64(lo + 1))))
    of, begin, size, offset, home = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, new = _classes(raw, begin, size, offset, _content(raw, begin, size, offset), home)
    head = np.flatnonzero(new)
    doc = ids[f.owner[of]][order]
    high = np.maximum.reduceat(doc, head) if len(head) else doc
    low = np.minimum.reduceat(doc, head) if len(head) else doc
    one = order[head]
    shard = _shard_of(mix(home[one]), shards)
    by = np.lexsort((begin[one], shard))
    group, edge = table.column("group")[0].as_py(), np.append(np.flatnonzero(_heads(shard[by])), len(by)).tolist() if len(by) else [0]
    rows = []
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        at = by[x:y]
        k = one[at]
        where, first, last = begin[k].astype(np.uint32), low[at].view(np.uint64), high[at].view(np.uint64)
        rows.append((group, int(shard[at[0]]), packed_rows(np.diff(where, prepend=np.uint32(0)), np.diff(first, prepend=np.uint64(0)), last - first, size[k].astype(np.uint8), offset[k].astype(np.uint8), tail=raw[_ranges(begin[k], size[k])])))
    return _rows(_GROUP_ROW, rows)


def _least_documents(string: np.ndarray, least: np.ndarray, count: np.ndarray, left: np.ndarray, core: int, right: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least document of each of the first count matches in each piece, in a row.

    Pieces stand by string and differ. Those of a string share the core bytes behind the left ones, which are one symbol
    there: equal matches have it at the same place.
    """
    out = np.repeat(least, count)
    run = np.flatnonzero(_heads(string))
    symbols = left + right + 2
    strings = np.add.reduceat(symbols, run)
    n = int(strings.sum())
    to = np.cumsum(symbols) - symbols
    text = np.zeros(n, np.uint16)
    text[_ranges(to, left)] = raw[_ranges(at, left)].astype(np.uint16) + 1
    text[to + left] = 257
    text[_ranges(to + left + 1, right)] = raw[_ranges(at + left + core, right)].astype(np.uint16) + 1
    order = suffix_arrays(text, strings)
    which = np.full(n, -1, np.int64)  # the match that starts here
    which[_ranges(to, count)] = np.arange(len(out))
    match = which[order]
    match = match[match >= 0]
    here, of = _ranges(at, count)[match], np.repeat(string, count)[match]
    same = of[1:] == of[:-1]
    same[same] = ~_differ(raw, here[1:][same], here[:-1][same], np.full(int(same.sum()), MATCH))
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    out[match] = np.repeat(np.minimum.reduceat(out[match], head), np.diff(np.append(head, len(match))))
    return out


def _fill(docs_of: np.ndarray, raw: np.ndarray, least: np.ndarray, begin: np.ndarray, offset: np.ndarray, windows: np.ndarray, first: np.ndarray, lo: int, hi: int) -> None:
    """Writes the least documents of the matches with lo to hi bytes before the anchor.

    Contexts stand in order of begin; a context's matches of one class are its piece, and all of them hold its core.
    """
    start = np.maximum(offset - hi, 0)
    count = np.minimum(windows, offset - lo + 1) - start
    some = np.flatnonzero(count > 0)
    if not len(some):
        return
    start, count = start[some], count[some]
    at, size, to = begin[some] + start, count + MATCH - 1, first[some] + start
    middle, core = (begin + offset)[some] - lo, MATCH - hi + lo
    none, long = np.zeros(len(some), np.int64), np.full(len(some), core)
    order, new = _classes(raw, middle, long, none, span_hashes(raw, middle, long))
    string = np.empty(len(some), np.int64)
    string[order] = np.cumsum(new)
    order, new = _classes(raw, at, size, none, span_hashes(raw, at, size, sized=True), string)
    head = np.flatnonzero(new)
    one = order[head]
    best = np.minimum.reduceat(least[some][order], head)
    run = np.flatnonzero(_heads(string[one]))
    members = np.diff(np.append(run, len(one)))
    # A piece alone in its string is as it is. Equally long strings are sorted together: a slice takes as many steps as
    # its longest string has groups.
    bytes_ = np.add.reduceat(size[one], run)
    rank = np.flatnonzero(members > 1)
    rank = rank[np.argsort(bytes_[rank], kind="stable")]
    sorted_, ends = _ranges(run[rank], members[rank]), np.cumsum(members[rank])
    pieces = np.cumsum(count[one]) - count[one]
    found = np.repeat(best, count[one])
    x = 0
    for y in ends[np.append(np.diff(np.cumsum(bytes_[rank]) // SORT_BYTES) > 0, True)].tolist() if len(rank) else []:
        part = sorted_[x:y]
        k = one[part]
        left = middle[k] - at[k]
        found[_ranges(pieces[part], count[k])] = _least_documents(string[k], best[part], count[k], left, core, size[k] - left - core, raw, at[k])
        x = y
    slot = np.empty(len(order), np.int64)
    slot[order] = np.cumsum(new) - 1
    docs_of[_ranges(to, count)] = found[_ranges(pieces[slot], count)]


def answer(table: pa.Table) -> pa.Table:
    """To each group, for those of its contexts that hold something to cut: where they are, and each match's least document."""
    got = [unpacked_rows(x, np.uint32, np.uint64, np.uint64, np.uint8, np.uint8, tail=True) for x in table.column("packed").to_pylist()]
    group = np.repeat(np.array(table.column("group").to_pylist(), np.int64), [len(g[0]) for g in got])
    where = np.concatenate([np.cumsum(g[0], dtype=np.uint32) for g in got])
    low = np.concatenate([np.cumsum(g[1], dtype=np.uint64) for g in got])
    high = (low + np.concatenate([g[2] for g in got])).view(np.int64)
    low = low.view(np.int64)
    size, offset = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (3, 4))
    raw = np.concatenate([g[5] for g in got])
    del got
    begin = np.cumsum(size) - size
    anchor = span_hashes(raw, begin + offset, np.full(len(size), GRAM))
    order, new = _classes(raw, begin, size, offset, _content(raw, begin, size, offset), anchor)
    head = np.flatnonzero(new)
    one = order[head]
    least = np.minimum.reduceat(low[order], head)
    back = np.argsort(one)  # contexts in order of their bytes
    slot = np.empty(len(one), np.int64)
    slot[back] = np.arange(len(one))
    one, least = one[back], least[back]
    kind = np.empty(len(order), np.int64)
    kind[order] = slot[np.cumsum(new) - 1]
    windows = size[one] - MATCH + 1
    first = np.cumsum(windows) - windows
    docs_of = np.empty(int(windows.sum()), np.int64)
    for lo, hi in BACK:
        _fill(docs_of, raw, least, begin[one], offset[one], windows, first, lo, hi)
    lowest = np.minimum.reduceat(docs_of, first)
    want = np.flatnonzero(lowest[kind] < high)  # others have nothing to cut
    want = want[np.argsort(group[want], kind="stable")]
    edge = np.append(np.flatnonzero(_heads(group[want])), len(want)).tolist() if len(want) else [0]
    shard, rows = table.column("shard")[0].as_py(), []
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        at = want[x:y]
        k = kind[at]
        docs = docs_of[_ranges(first[k], windows[k])].view(np.uint64)
        rows.append((int(group[at[0]]), shard, packed_rows(where[at], size[at].astype(np.uint8), offset[at].astype(np.uint8), tail=np.diff(docs, prepend=np.uint64(0)).view(np.uint8))))
    return _rows(_GROUP_ROW, rows)


def _covered(raw: np.ndarray, ids: np.ndarray, texts: list[bytes], answers: pa.Table) -> np.ndarray:
    """The bytes of a group that go."""
    change = np.zeros(len(raw) + 1, np.int32)
    got = [unpacked_rows(x, np.uint32, np.uint8, np.uint8, tail=True) for x in answers.column("packed").to_pylist()]
    if not got:
        return np.zeros(len(raw), bool)
    begin, size, offset = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(3))
    least = np.concatenate([np.cumsum(g[3].view(np.uint64), dtype=np.uint64) for g in got]).view(np.int64)
    count = size - MATCH + 1
    first = np.cumsum(count) - count
    n = len(size)
    by = np.argsort(begin + offset, kind="stable")
    wanted = np.unique(span_hashes(raw, (begin + offset)[by], np.full(n, GRAM)))
    f = Contexts(_grams(texts), lambda h: wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
    # What was asked for is a whole context or a piece: of each context all three, beside the answered ones, in classes.
    parts = [(np.full(n, -1), begin, size, offset), (np.arange(len(f.owner)), f.begin, f.size, f.offset), *(f.piece(lo, hi) for lo, hi in WIDE)]
    of, at, long, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, new = _classes(raw, at, long, place, _content(raw, at, long, place))
    which = np.cumsum(new) - 1
    reply = np.full(int(new.sum()), -1)
    given = order < n
    reply[which[given]] = order[given]
    k = reply[which]
    hit = ~given & (k >= 0)
    k, x = k[hit], order[hit]
    doc, m = ids[f.owner[of[x]]], count[k]
    edge = np.append(np.unique(np.cumsum(m) // SLICE_BYTES, return_index=True)[1], len(m)).tolist()
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):  # so many matches at once
        part = slice(lo, hi)
        gone = least[_ranges(first[k[part]], m[part])] < np.repeat(doc[part], m[part])
        spots = _ranges(at[x[part]], m[part])[gone]
        np.add.at(change, spots, 1)
        np.add.at(change, spots + MATCH, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def remove(table: pa.Table, answers: pa.Table, whole: bool) -> pa.Table:
    """Each row of a group after the cut: its counts and hash or, if whole, its other columns and the text that is left."""
    table, ids, texts = _sorted_texts(table)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    covered = _covered(raw, ids, texts, answers)
    stop = np.cumsum([len(t) for t in texts]).tolist()
    size, gone, spans, kept, left = [], [], [], [], []
    for k, (lo, hi) in enumerate(zip([0, *stop[:-1]], stop, strict=True)):
        c = covered[lo:hi]
        gone.append(int(c.sum()))
        rest = raw[lo:hi][~c].tobytes() if gone[-1] else texts[k]
        if whole:
            left.append(rest.decode("utf-8", "ignore"))
        else:
            size.append(hi - lo)
            spans.append(int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if gone[-1] else 0)
            kept.append(hashlib.sha256(rest).hexdigest())
    if whole:
        return pa.table([table.column("row"), pa.array(gone, pa.int64()), pa.array(left, pa.string())], ["row", "n_removed", "left"])
    cols = [pa.array(x, pa.int64()) for x in (size, gone, spans)]
    return pa.table([table.column("doc_id"), *cols, pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 or, if whole, row (any column of docs), n_removed and the text left.

    Each byte goes that a MATCH-byte string covers which also starts in a document with a smaller doc_id, judged on the
    input. Null text counts as empty and shorter texts have no match. Rows of one doc_id don't cut each other; a null
    doc_id is smaller than all others. A character that a cut splits isn't part of the text that is left. A very long text
    is a group by itself and read in parts. Rows that repeat each get their result; an empty table has none.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    groups, shards, wards = (int(total // n + 1) for n in (GROUP_BYTES, SHARD_BYTES, CENSUS_BYTES))
    row = ["row"] if whole else []

    def press(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([None if t is None else z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("doc_id"), packed, *map(b.column, row)], ["group", "doc_id", "packed", *row])

    told = "group long, shard long, packed binary"
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("group")
    dealt = docs.select(group, "doc_id", "text", *row).mapInArrow(press, _schema("group long, doc_id long, packed binary", docs, row)).groupBy("group")
    marks = dealt.applyInArrow(lambda t: tell(t, wards), told).groupBy("shard").applyInArrow(census, told)
    asked = dealt.cogroup(marks.groupBy("group")).applyInArrow(lambda t, m: ask(t, m, shards), told)
    answers = asked.groupBy("shard").applyInArrow(answer, told)
    out = "n_removed long, left string" if whole else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return dealt.cogroup(answers.groupBy("group")).applyInArrow(lambda t, a: remove(t, a, whole), _schema(out, docs, row, first=True))


def _schema(columns: str, docs: DataFrame, row: list[str], first: bool = False) -> T.StructType:
    own, passed = list(T.StructType.fromDDL(columns)), [docs.schema[c] for c in row]
    return T.StructType(passed + own if first else own + passed)


def result(df: DataFrame) -> DataFrame:
    return cut(with_columns_as(df, doc_id="long", text="string"))


def stage(df: DataFrame) -> DataFrame:
    """df with its texts and n_chars after the cut; a document goes if bytes were removed and no word is left.

    Null, short and unmatched texts stay as they are; rows that repeat are cut alike. Extra columns pass, whatever their names.
    """
    field = {c: f"c{k}" for k, c in enumerate(df.columns) if c != "text"}
    row = F.struct(F.col("text").isNull().alias("none"), *[df[f"`{c}`"].alias(f) for c, f in field.items()]).alias("row")
    docs = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"), row)
    done = cut(docs, whole=True).filter((F.col("n_removed") == 0) | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(~F.col("row")["none"], F.col("left"))
    length = lambda old: F.when(F.col("n_removed") > 0, F.char_length("left").cast("long")).otherwise(old)
    old = lambda c: F.col("row")[field[c]]
    return done.select(*[(text if c == "text" else length(old(c)) if c == "n_chars" else old(c)).alias(c) for c in df.columns])
