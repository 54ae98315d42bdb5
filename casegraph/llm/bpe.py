"""Byte-level BPE by speculation and verification.

A greedy longest match proposes tokens for every new word; a vectorised check tests whether each adjacent pair could
stand next to one another in a finished encoding; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import MULT, mix, powers, with_columns_as

#: Fixed value: the split of byte-level BPE before merging, as public_tokenizers.PATTERN states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are encoded at once; bounds memory, not results.
SLICE_CHARS = 1 << 20
#: The word cache starts anew beyond so many words or ids.
CACHE_WORDS, CACHE_IDS = 2_000_000, 12_000_000
#: Words of up to so many bytes are merged side by side.
LOCKSTEP = 64
NEVER = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable Latin-1, else 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Lookup:
    """A static map of non-negative 64-bit keys to numbers for arrays of keys; a miss gives the default."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 2))
        self.default, self.levels = np.int64(default), []
        keys, values = keys.astype(np.int64), values.astype(np.int64)
        while len(keys) or not self.levels:
            slot, first = np.unique(self.slot(keys), return_index=True)
            k = np.full(1 << (64 - int(self.shift)), -1, np.int64)
            v = np.full(len(k), default, np.int64)
            k[slot], v[slot] = keys[first], values[first]
            self.levels.append((k, v))
            keys, values = np.delete(keys, first), np.delete(values, first)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULT) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        (k, v), *rest = self.levels
        out = np.where(k[at] == keys, v[at], self.default)
        for k, v in rest:
            hit = k[at] == keys
            out[hit] = v[at[hit]]
        return out


#: Classes of code points for the split, and two code points beyond Unicode: a text's end and a special token.
LETTER, NUMBER, OTHER, SPACE, MARK = range(5)
END, SPECIAL = 0x110000, 0x110001


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point as the pattern's own property classes tell it, and a random value for hashes."""
    kind = np.full(SPECIAL + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            at = np.frombuffer(m[0].encode("utf-32-le"), "<u4")
            kind[at] = k
    kind[END:] = MARK
    return kind, mix(np.arange(1, SPECIAL + 2, dtype=np.uint64) * MULT)


def split(cps: np.ndarray) -> np.ndarray:
    """Starts of the words of PATTERN in code points whose texts end with a mark; a mark is a word of its own.

    A run of one class is a word and takes one blank before it along. White space before a word gives up its last
    character, which stands alone unless it is that blank. An apostrophe that begins a word takes the endings
    s, t, m, d, re, ve and ll along.
    """
    kind = classes()[0][cps]
    start = np.ones(len(cps), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[kind == MARK] = True
    after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after] = cps[after - 1] != 32
    quote = np.flatnonzero(cps == 39)
    quote = quote[start[quote]]
    if len(quote):
        pad = np.concatenate([cps, np.full(3, END, cps.dtype)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            start[at + size] |= kind[at + size] == LETTER
    return np.flatnonzero(start)


class Bpe:
    """Tables of one vocabulary file and a bounded cache of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1
        self.token: list[bytes] = [b""] * self.size
        for s, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for s, i in self.special.items():
            self.token[i] = s.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        # A token's rank is that of the merge that makes it; a single byte's is -1.
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[a, b] = (r, whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, a, b
        pairs = np.array([(a * self.size + b, r, w) for (a, b), (r, w) in self.merge.items()], np.int64)
        self.pair_rank = Lookup(pairs[:, 0], pairs[:, 1], NEVER)
        self.made = np.zeros(len(model["merges"]), np.int64)
        self.made[pairs[:, 1]] = pairs[:, 2]
        specials = set(self.special.values())
        self.byte_id = np.zeros(256, np.int64)
        for i, t in enumerate(self.token):
            if len(t) == 1 and self.rank[i] < 0 and i not in specials:
                self.byte_id[t[0]] = i
        # Only tokens that their own bytes encode to may be proposed: a trie of them.
        every = [i for i, t in enumerate(self.token) if t and i not in specials]
        flat, count = self.exact([self.token[i] for i in every])
        first = flat[np.cumsum(count) - count]
        edge: dict[int, int] = {}
        ends = [-1]
        for i, n, t in zip(every, count, first, strict=True):
            if n == 1 and t == i:
                node = 0
                for c in self.token[i]:
                    if (key := node * 256 + c) not in edge:
                        edge[key] = len(ends)
                        ends.append(-1)
                    node = edge[key]
                ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.edge = Lookup(np.fromiter(edge, np.int64, len(edge)), np.fromiter(edge.values(), np.int64, len(edge)), -1)
        self.token_len = np.fromiter(map(len, self.token), np.int64, self.size)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.learned = self.merged_exactly = 0
        self.forget()

    def forget(self) -> None:
        """Empties the cache: sorted word hashes and, for each, where its ids are."""
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # -- exact merging --------------------------------------------------------------------------------------------
    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and their counts: each word's first pair of least rank merges, round by round.

        All words of up to LOCKSTEP bytes merge side by side; longer ones go through a heap, n log n for any length.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        if len(size) and size.max() > LOCKSTEP:
            long = size > LOCKSTEP
            short, short_count = self.exact([w for w, x in zip(words, long, strict=True) if not x])
            at, out = np.cumsum(short_count), []
            parts = iter(np.split(short, at[:-1]) if len(at) else [])
            for w, x in zip(words, long, strict=True):
                out.append(np.array(self.heap_merge(w), np.int64) if x else next(parts))
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        done_ids, done_owner = [], []
        rank = self.adjacent(ids, owner)
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(rank, first)
            run = np.diff(np.concatenate((first, [len(ids)])))
            if (least >= NEVER).any():  # finished words leave
                over = np.repeat(least >= NEVER, run)
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                continue
            hit = np.flatnonzero(rank == np.repeat(least, run))
            hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            hit = hit - np.arange(len(hit))
            for at in (hit[hit > 0] - 1, hit):
                nxt = np.minimum(at + 1, len(ids) - 1)
                rank[at] = np.where((nxt > at) & (owner[nxt] == owner[at]), self.pair_rank(ids[at] * self.size + ids[nxt]), NEVER)
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def adjacent(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of the merge of each id with the next one of its word."""
        rank = np.full(len(ids), NEVER)
        if len(ids) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.pair_rank(ids[:-1] * self.size + ids[1:]), NEVER)
        return rank

    def heap_merge(self, word: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, merge = len(ids), self.merge
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i] = merge[a, b][1]
            ids[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := prv[i]) >= 0 and (m := merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    # -- speculation ----------------------------------------------------------------------------------------------
    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from left to right, all words side by side down the trie."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        stop = np.cumsum(size)
        who = np.flatnonzero(size)
        begin = (stop - size)[who]
        limit, at = stop[who], begin.copy()
        node, token, after = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), at.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            step = np.where(at < limit, self.edge(node * 256 + raw[np.minimum(at, len(raw) - 1)]), -1)
            on = step >= 0
            at = at + on
            node = np.where(on, step, node)
            end = np.where(on, self.ends[node], -1)
            hit = end >= 0
            token, after = np.where(hit, end, token), np.where(hit, at, after)
            cut = ~on
            if cut.any():
                found.append((who[cut], begin[cut], token[cut]))
                at, node, begin = np.where(cut, after, at), np.where(cut, 0, node), np.where(cut, after, begin)
                live = ~cut | (after < limit)
                who, begin, limit, at, node, token, after = (x[live] for x in (who, begin, limit, at, node, token, after))
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner, begin, token = (np.concatenate(x) for x in zip(*found, strict=True))
        return token[np.argsort(begin, kind="stable")], np.bincount(owner, minlength=len(words))

    # -- verification ---------------------------------------------------------------------------------------------
    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens survives as it is when their joined bytes are merged.

        Going back in time, the last part of the left and the first part of the right token are undone, latest merge
        first (the right one on a tie: a left occurrence merges earlier). A pair of such parts that itself merges before
        either is used up breaks the boundary.
        """
        ok = np.ones(len(left), bool)
        live = np.arange(len(left))
        l, r = left.astype(np.int64), right.astype(np.int64)
        until_l, until_r = np.full(len(l), NEVER), np.full(len(r), NEVER)
        while len(live):
            m = self.pair_rank(l * self.size + r)
            broken = (m < until_l) & (m <= until_r) & (m < NEVER)
            ok[live[broken]] = False
            rank_l, rank_r = self.rank[l], self.rank[r]
            undo_r = rank_r >= rank_l
            go = ~broken & (np.maximum(rank_l, rank_r) >= 0)
            until_r, until_l = np.where(undo_r, rank_r, until_r)[go], np.where(undo_r, until_l, rank_l)[go]
            l, r = np.where(undo_r, l, self.right[l])[go], np.where(undo_r, self.left[r], r)[go]
            live = live[go]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Proposes, verifies and merges what fails. Ids in a row, and counts."""
        flat, count = self.greedy(words)
        owner = np.repeat(np.arange(len(words)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.unique(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]])
        self.learned += len(words)
        self.merged_exactly += len(wrong)
        if len(wrong):
            right, n = self.exact([words[k] for k in wrong.tolist()])
            bad = np.zeros(len(words), bool)
            bad[wrong] = True
            keep = ~bad[owner]
            flat, owner = np.concatenate([flat[keep], right]), np.concatenate([owner[keep], np.repeat(wrong, n)])
            flat, count = flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))
        return flat, count

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if len(self.hashes) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.forget()
        parts: list[str] = []
        marks: list[int] = []
        for t in texts:
            if self.at_special is not None and any(s in t for s in self.special):
                for k, p in enumerate(self.at_special.split(t)):
                    if k % 2:
                        marks[-1] = -2 - self.special[p]
                    else:
                        parts.append(p)
                        marks.append(-1)
            else:
                parts.append(t)
                marks.append(-1)
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        joined = "\0".join(parts) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
        cps[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1] = END
        start = split(cps)
        size = np.diff(np.concatenate((start, [len(cps)])))
        value = classes()[1][cps] * powers(int(size.max()))[np.arange(len(cps)) - np.repeat(start, size)]
        hashed = mix(np.add.reduceat(value, start) + size.astype(np.uint64))
        mark = np.flatnonzero(cps[start] == END)
        unique, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        new = np.flatnonzero(np.concatenate([self.hashes, [np.uint64(0)]])[at] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            lo = start[first[new]]
            words = [joined[a:b].encode() for a, b in zip(lo.tolist(), (lo + size[first[new]]).tolist(), strict=True)]
            flat, count = self.encode_words(words)
            spot = at[new]
            self.start = np.insert(self.start, spot, len(self.flat) + np.cumsum(count) - count)
            self.count = np.insert(self.count, spot, count)
            self.hashes = np.insert(self.hashes, spot, unique[new])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            at = np.searchsorted(self.hashes, unique)
        at = at[back]
        count, begin = self.count[at], self.start[at]
        codes = np.array(marks, np.int64)
        count[mark] = codes < -1
        where = np.cumsum(count)
        total = int(where[-1])
        ids = self.flat[np.repeat(begin - where + count, count) + np.arange(total)]
        ids[where[mark[codes < -1]] - 1] = -2 - codes[codes < -1]
        ends = where[mark[codes == -1]]
        return ids.astype("<u4"), np.diff(np.concatenate(([0], ends)))

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        ids = ids.astype(np.int64)
        size = self.token_len[ids]
        where = np.cumsum(size)
        total = int(where[-1]) if len(where) else 0
        raw = self.token_flat[np.repeat((self.token_start[ids] - where + size).astype(np.int32), size) + np.arange(total, dtype=np.int32)].tobytes()
        ends = np.concatenate(([0], where))[np.cumsum(counts)].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def slices(texts: list[str], most: int = SLICE_CHARS):
    """Runs of whole texts of about so many characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def encode_decode(df: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Encodes and decodes column text of df.

    Null text counts as empty: no ids, digest of nothing. Repeated rows and any doc_id (null too) are kept as they are;
    other columns are ignored. Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches):
        bpe = load(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for part in slices(texts):
                flat, counts = bpe.encode_batch(part)
                back = bpe.decode_batch(flat, counts)
                ends = np.cumsum(counts).tolist()
                for lo, hi, t in zip([0, *ends[:-1]], ends, back, strict=True):
                    out[0].append(hi - lo)
                    out[1].append(hashlib.sha256(flat[lo:hi].tobytes()).hexdigest())
                    out[2].append(hashlib.sha256(t.encode()).hexdigest())
                    if ids:
                        out[3].append(flat[lo:hi].astype(np.int32))
                        out[4].append(t)
            cols = [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return with_columns_as(df, doc_id="long", text="string").mapInArrow(run, schema)
