"""Near-duplicate classes by MinHash bands with sequential Bayesian verification.

Documents of one shingle set are one vertex. Vertices that share a band of their signature are candidates: first each
with its bucket's leader (a linear number of pairs), then, in buckets that still hold several components, the vertices
outside the leader's component with all of the bucket, in blocks of bounded size. A pair's signatures are compared batch by batch; it is dropped as soon as the posterior probability
that its similarity reaches the threshold falls under the chosen miss probability. Survivors are decided on full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MULT, by_key, materialize, mix, row_of, with_columns_as, word_hashes
from .components import components

#: Texts are hashed so many characters at once; shingles of a block of a large bucket; buckets that count as hot at most.
SLICE_CHARS, BLOCK_SHINGLES, HOT_KEYS = 1 << 20, 1 << 17, 10_000
#: Vertices that make a bucket hot at least.
HOT_MEMBERS = 256
_FACTOR = mix(np.arange(1, 65, dtype=np.uint64) * MULT) | np.uint64(1)


class Plan:
    """Shingle width, threshold in percent, bands x rows of the signature, and the tables of the sequential test."""

    def __init__(self, width: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-6, batch: int = 20):
        self.width, self.percent, self.rows, self.miss = width, percent, rows, miss
        s = percent / 100
        self.bands = int(np.ceil(np.log(miss) / np.log1p(-(s**rows))))
        self.size = self.bands * rows
        rule = mix(np.arange(1, 2 * self.size + 1, dtype=np.uint64) * MULT + np.uint64(7))
        self.a = (rule[: self.size] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (rule[self.size :] >> np.uint64(32)).astype(np.uint32)
        self.stops = [*range(batch, self.size, batch), self.size]
        self.least = [self._least(n) for n in self.stops]

    def _least(self, n: int) -> int:
        """Fewest matches among n at which the posterior (uniform prior) of reaching the threshold is at least miss."""
        x = (np.arange(20_000) + 0.5) / 20_000
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            if density[x >= self.percent / 100].sum() / density.sum() >= self.miss:
                return m
        return n

    def survive(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indexes of the rows whose signatures pass every batch."""
        live, got, lo = np.arange(len(left)), np.zeros(len(left), np.int64), 0
        for hi, least in zip(self.stops, self.least, strict=True):
            got = got + (left[live, lo:hi] == right[live, lo:hi]).sum(axis=1)
            keep = got >= least
            live, got, lo = live[keep], got[keep], hi
        return live

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """The decision on full sets, in whole numbers."""
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.percent * (len(a) + len(b) - common)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Each text's set of shingles as sorted 64-bit hashes; fewer words than a shingle give one of them all."""
        words, counts = word_hashes(texts)
        w = self.width
        total = np.zeros(max(0, len(words) - w + 1), np.uint64)
        for k in range(w):
            total += words[k : k + len(total)] * _FACTOR[k]
        total = mix(total + np.uint64(w))
        at = 0
        for n in counts.tolist():
            if n >= w:
                yield np.unique(total[at : at + n - w + 1])
            elif n:
                yield mix((words[at : at + n] * _FACTOR[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            at += n

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 2048):
            np.minimum(out, (self.a[:, None] * h[None, at : at + 2048] + self.b[:, None]).min(axis=1), out=out)
        return out


def runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, tie) of each row with its set's size, 128-bit digest v and signature; v is null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            size, v, sig = [], [], []
            for lo, hi in runs(texts):
                for s in plan.sets(texts[lo:hi]):
                    size.append(len(s))
                    v.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(plan.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(size, pa.int64()), pa.array(v, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "tie", "n", "v", "sig"])

    return docs.mapInArrow(run, "doc_id long, tie long, n long, v binary, sig binary")


def bands(vertices: DataFrame, plan: Plan) -> DataFrame:
    """(key, v, n) for each band of each vertex."""
    salt = mix(np.arange(1, plan.bands + 1, dtype=np.uint64) * MULT + np.uint64(11))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, plan.bands, plan.rows).astype(np.uint64)
            key = mix((mix(sig + np.uint64(1)) * _FACTOR[: plan.rows]).sum(axis=2) + salt)
            at = np.repeat(np.arange(b.num_rows), plan.bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), b.column("v").take(at), b.column("n").take(at)], ["key", "v", "n"])

    return vertices.select("v", "n", "sig").mapInArrow(run, "key long, v binary, n long")


def verified(pairs: DataFrame, vertices: DataFrame, sets_of, plan: Plan) -> DataFrame:
    """The pairs (a, b) that are links: the sequential test on signatures, then the full sets of the survivors."""

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield b.take(pa.array(plan.survive(left, right))).select(["a", "b"])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [k for k, (x, y) in enumerate(zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True)) if plan.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
            yield b.take(pa.array(keep, pa.int64())).select(["a", "b"])

    sig = lambda c: vertices.select(F.col("v").alias(c), F.col("sig").alias(f"sig_{c}"))
    tested = materialize(pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a binary, b binary"), "tested")
    sets = sets_of(tested.select(F.col("a").alias("v")).union(tested.select(F.col("b").alias("v"))).distinct())
    full = lambda c: sets.select(F.col("v").alias(c), F.col("shingles").alias(f"set_{c}"))
    return tested.join(full("b"), "b").join(full("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(decide, "a binary, b binary")


def across(members: DataFrame, hot: DataFrame, sets_of, plan: Plan) -> DataFrame:
    """Links between the components that still meet in a bucket; members (key, hot, v, n, label, main: the leader's component).

    Vertices of a bucket fall into blocks: those of the leader's component and the others, by size (a class holds sizes that
    may link, or they are in neighbouring ones), then by hash into parts of bounded size. Each pair of blocks that may link,
    one of them of others, is one task's group, so a bucket of any size is spread. Within it, pairs already connected are
    skipped: it returns a forest, not all pairs.
    """
    step = float(np.log(100 / plan.percent)) * (1 + 1e-9)  # a little more than linked sizes differ by
    sized = members.withColumn("size", F.floor(F.log("n") / step).cast("int"))
    totals = sized.groupBy("key", "main", "size").agg(F.sum("n").alias("total")).select("key", "main", "size", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("parts"))
    totals = materialize(totals, "parts")
    placed = materialize(by_key(sized, totals, hot, ["key", "main", "size"]).select("key", "hot", "v", "n", "label", F.struct("main", "size", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part")).alias("block")), "blocks")
    blocks = totals.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct("main", "size", k.alias("part")))).alias("block"))
    x, y = blocks.withColumnRenamed("block", "x"), blocks.withColumnRenamed("block", "y")
    meet = x.join(y, "key").filter("x <= y and not (x.main and y.main) and abs(x.size - y.size) <= 1").select("key", F.struct("x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    groups = placed.join(meet, ["key", "block"]).withColumn("right", F.col("block") == F.col("pair.y"))
    groups = groups.withColumn("left", F.col("block") == F.col("pair.x")).join(sets_of(members.select("v").distinct(), signed=True), "v")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "v"], kind="stable").reset_index(drop=True)
        full = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), -1)
        n, left, right = (rows[c].to_numpy() for c in ("n", "left", "right"))
        home = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        out = []
        for i in range(len(rows)):
            lo = int(np.searchsorted(100 * n[:i], plan.percent * n[i]))
            fit = (home[lo:i] != home[i]) & ((left[lo:i] & right[i]) | (right[lo:i] & left[i]))
            other = np.flatnonzero(fit) + lo
            for k in other[plan.survive(np.broadcast_to(sig[i], (len(other), plan.size)), sig[other])].tolist() if len(other) else ():
                if home[i] != home[k] and plan.linked(full[i], full[k]):
                    home[home == home[i]] = home[k]
                    out.append((rows["v"][i], rows["v"][k]))
        return pd.DataFrame(out, columns=["a", "b"])

    names = F.struct("key", "pair")
    return groups.select(names.alias("group"), "v", "n", "label", "left", "right", "shingles", "sig").groupBy("group").applyInPandas(link, "a binary, b binary")


def classes(df: DataFrame, plan: Plan) -> DataFrame:
    """Per row: doc_id, tie (hash of the text), n_shingles, label (its class; null without words) and component_id.

    component_id is the least doc_id of the class. Rows are documents: repeated rows are copies. Texts without words (null, blank) have an empty set and link with
    nothing. A null doc_id takes part and counts as none for component_id. An empty table gives no rows.
    """
    docs = with_columns_as(df, doc_id="long", text="string").withColumn("tie", F.xxhash64("text"))
    rows = materialize(signatures(docs, plan), "signatures")
    vertices = materialize(rows.filter("v is not null").groupBy("v").agg(F.min_by(F.struct("doc_id", "tie"), F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("of"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows")), "vertices")
    keyed = materialize(bands(vertices, plan), "bands")
    buckets = materialize(keyed.groupBy("key").agg(F.min("v").alias("leader"), F.count("*").alias("members")).filter("members > 1"), "buckets")
    least = max(HOT_MEMBERS, keyed.count() // HOT_KEYS)
    hot = materialize(buckets.filter(F.col("members") > least).select("key"), "hot")  # at most HOT_KEYS of them
    flagged = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    members = materialize(by_key(flagged, buckets, hot, ["key"]), "members")

    def sets_of(wanted: DataFrame, signed: bool = False) -> DataFrame:
        """(v, shingles) of the wanted vertices, from one document of each; signed: with their signatures, taken once."""
        ids = vertices.join(wanted, "v", "left_semi").select("v", "of.doc_id", "of.tie")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, found = b.column("text").to_pylist(), []
                for lo, hi in runs(texts):
                    found += [s.tobytes() for s in plan.sets(texts[lo:hi])]
                more = [pa.array([plan.signature(np.frombuffer(s, np.uint64)).tobytes() for s in found], pa.binary())] if signed else []
                yield pa.RecordBatch.from_arrays([b.column("v"), pa.array(found, pa.binary()), *more], ["v", "shingles", "sig"][: 2 + signed])

        same = docs["doc_id"].eqNullSafe(ids["doc_id"]) & (docs["tie"] == ids["tie"])
        return materialize(docs.join(ids, same).select("v", "text").dropDuplicates(["v"]).mapInArrow(run, "v binary, shingles binary" + (", sig binary" if signed else "")), "sets")

    stars = members.filter("v <> leader").select(F.col("leader").alias("a"), F.col("v").alias("b")).distinct()
    links = materialize(verified(stars, vertices, sets_of, plan), "links")
    labels = components(links)
    labelled = members.filter("members > 2").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.when(F.col("v") == F.col("leader"), F.col("label"))).alias("first")).filter("x <> y").select("key", "first")
    rest = by_key(labelled, materialize(mixed, "mixed"), hot, ["key"]).select("key", "hot", "v", "n", "label", (F.col("label") == F.col("first")).alias("main"))
    rest = materialize(rest, "rest")
    if not rest.isEmpty():
        more = materialize(across(rest, hot, sets_of, plan), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    least = vertices.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    named = least.groupBy("label").agg(F.min("of.doc_id").alias("component_id"), F.sum("rows").alias("size")).filter("size > 1")
    of = materialize(least.join(named, "label").select("v", "label", "component_id"), "classes")
    return rows.join(of, "v", "left").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.coalesce("label", "v").alias("label"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(df: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    return classes(df, plan).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, plan: Plan) -> DataFrame:
    """The rows of df without near-duplicates: of each class the row of the least doc_id stays, once if it is repeated.

    Rows without words all stay.
    """
    found = classes(df, plan)
    first = found.filter("label is not null").groupBy("label").agg(F.min_by(F.struct("doc_id", "tie"), F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("of")).select("of.*", F.lit(False).alias("blank"))
    blank = found.filter("label is null").select("doc_id", "tie", F.lit(True).alias("blank")).distinct()
    kept = materialize(first.union(blank), "kept")
    row, field = row_of(df)
    tied = df.select(row, df["doc_id"].cast("long").alias("id"), F.xxhash64(df["text"].cast("string")).alias("hash"))
    once = tied.join(kept, tied["id"].eqNullSafe(kept["doc_id"]) & (tied["hash"] == kept["tie"])).select("row", "id", "hash", "blank")
    rank = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0)))
    return once.withColumn("rank", rank).filter("rank = 1 or blank").select(*[F.col("row")[f].alias(c) for c, f in field.items()])


#: The classes by brute force: all pairs that share a shingle, then everything each document reaches.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)]) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sets UNION SELECT v, b FROM reach JOIN both_ ON r = a),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON v = doc_id
"""
