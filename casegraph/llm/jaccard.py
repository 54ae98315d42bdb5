"""Exact shingle-Jaccard join: count vectors of hashed token groups in a forest of R-trees, then full sets.

Tokens (shingles) are hashed into groups; a document's counts by group are its point. Two documents share at most the sum of
their points' coordinate minima, and documents under a node at most that of its upper corner, so nodes and pairs whose bound
cannot reach the threshold are dropped; what is left is decided on full sets.

One tree over all points would prune little, as unrelated documents of one length have nearly equal counts. So there is a
tree for each key of an exact prefix filter: linked documents share a token among the first n - ceil(t * n) + 1 of their own,
in any order of tokens that is the same for all. The order puts tokens that are frequent in a bounded sample last, which
changes no result, only the size of the trees. A tree first joins each point with its leader (linear); only trees that then
hold several components get leaves of bounded size, whose upper corners are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_columns_as
from .components import components
from .minhash import Plan, runs

#: Documents that the token order is fitted on, and in how many of them a token counts as frequent; frequent tokens kept.
SAMPLE, FREQUENT, KEPT = 8_000, 6, 1 << 17
#: Groups of a point: a power of two near an eighth of the tokens.
LEAST_GROUPS, MOST_GROUPS = 8, 4096
#: Tokens of a leaf's documents, and documents; points of a tree that is one leaf; parts that a frequent token's documents are dealt to first.
LEAF_TOKENS, LEAF_DOCS, LEAF_POINTS, PARTS = 1 << 16, 512, 64, 32
#: Points of small trees that a task takes at once.
TASK_POINTS = 20_000


def groups_for(n: int) -> int:
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(0, int(n // 8).bit_length() - 1)))


def point(tokens: np.ndarray) -> bytes:
    """Counts by group; groups nest, so a longer point folds to a shorter one."""
    g = groups_for(len(tokens))
    return np.bincount((tokens & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.uint32).tobytes()


def folded(counts: np.ndarray, g: int) -> np.ndarray:
    return counts.reshape(-1, g).sum(axis=0)


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """The bound: summed minima over the groups of the shorter point."""
    g = min(len(a), len(b))
    return int(np.minimum(folded(a, g), folded(b, g)).sum())


class Join:
    """Width of a token in words, threshold in percent, and the sets of texts."""

    def __init__(self, width: int = 5, percent: int = 80):
        self.plan, self.width, self.percent = Plan(width=width, percent=percent), width, percent

    def reaches(self, shared: int, total: int) -> bool:
        """Whether so many shared tokens make two sets of so many together link."""
        return (100 + self.percent) * shared >= self.percent * total

    def prefix(self, tokens: np.ndarray, order: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """The first tokens, any linked set holds one of them: rare ones by hash, then frequent ones by their rank."""
        n = len(tokens)
        size = n + (-self.percent * n // 100) + 1
        if not len(frequent):
            return tokens[:size]
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[at] == tokens
        rare = tokens[~common]
        if len(rare) >= size:
            return rare[:size]
        last = tokens[common]
        return np.concatenate((rare, last[np.argsort(order[at[common]], kind="stable")][: size - len(rare)]))


def frequent_tokens(docs: DataFrame, join: Join, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at least FREQUENT documents of a sample, ascending, and their ranks from the least frequent on."""
    every = max(1, -(-docs.count() // sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in runs(texts := b.column("text").to_pylist()):
                tokens, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *join.plan.sets(texts[lo:hi])]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times.astype(np.int64))], ["token", "n"])

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(every)) == 0).select("tie", "text").dropDuplicates(["tie"]).select("text")
    counts = chosen.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "token").limit(KEPT).collect()  # bounded by KEPT
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.arange(len(tokens), 0, -1)
    by = np.argsort(tokens, kind="stable")
    return tokens[by], order[by]


def described(docs: DataFrame, join: Join, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, tie) of each row with its set's size, 128-bit digest v, point and prefix; null for an empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, order = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            out: list[list] = [[], [], [], []]
            for lo, hi in runs(texts):
                for s in join.plan.sets(texts[lo:hi]):
                    full = len(s) > 0
                    for x, y in zip(out, (len(s), xxhash.xxh3_128_digest(s.tobytes()) if full else None, point(s) if full else None, join.prefix(s, order, tokens).tobytes() if full else None), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["doc_id", "tie", "n", "v", "point", "prefix"])

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, n long, v binary, point binary, prefix binary")


def keyed(vertices: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, part, id) of each token of each prefix; frequent ones are dealt to parts from 0 by vertex."""
    shared = vertices.sparkSession.sparkContext.broadcast(frequent[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("prefix").to_pylist()
            sizes = np.fromiter((len(x) // 8 for x in lists), np.int64, len(lists))
            key = np.frombuffer(b"".join(lists), np.uint64)
            ids = np.repeat(b.column("id").to_numpy(), sizes)
            part = np.full(len(key), -1, np.int32)
            if len(tokens):
                hit = tokens[np.minimum(np.searchsorted(tokens, key), len(tokens) - 1)] == key
                part[hit] = ids[hit] % PARTS
            for lo in range(0, len(key), 1 << 17):
                cut = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(part[cut]), pa.array(ids[cut])], ["key", "part", "id"])

    return vertices.select("id", "prefix").mapInArrow(run, "key long, part int, id long")


def bounded(pairs: DataFrame, points: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose points' bound reaches the threshold."""

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (x, y, n, m) in enumerate(zip(*(b.column(c).to_pylist() for c in ("point_a", "point_b", "n_a", "n_b")), strict=True)):
                if 100 * min(n, m) >= join.percent * max(n, m) and join.reaches(most_shared(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)), n + m):
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64())).select(["a", "b"])

    side = lambda c: points.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"point_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "point_a", "point_b").mapInArrow(test, "a long, b long")


def decided(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs that link, by their full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [k for k, (x, y) in enumerate(zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True)) if join.plan.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
            yield b.take(pa.array(keep, pa.int64())).select(["a", "b"])

    full = lambda c: sets.select(F.col("id").alias(c), F.col("tokens").alias(f"set_{c}"))
    return pairs.join(full("b"), "b").join(full("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def different_trees(members: DataFrame) -> DataFrame:
    """(key, id, label) of trees of bounded size; of trees with the same members the one of the least key stands for all."""
    trees = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("all"))
    return trees.groupBy("all").agg(F.min("key").alias("key")).select("key", F.explode("all").alias("x")).select("key", "x.id", "x.label")


def within_leaves(members: DataFrame, points: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) of different components in trees of one leaf whose bound reaches the threshold, many trees to a task.

    members: key, id, label; points: id, n, point. A pair counts in the first tree that both are in, so it is made once.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "n", "id"], kind="stable").reset_index(drop=True)
        key, n, ids, label, keys = (rows[c].to_numpy() for c in ("key", "n", "id", "label", "keys"))
        points = [np.frombuffer(p, np.uint32) for p in rows["point"]]
        out = []
        for lo, hi in stretches(key):
            earlier = [frozenset(k[: np.searchsorted(k, key[lo])].tolist()) for k in keys[lo:hi]]
            for i in range(lo + 1, hi):
                for k in np.flatnonzero((100 * n[lo:i] >= join.percent * n[i]) & (label[lo:i] != label[i])).tolist():
                    if earlier[i - lo].isdisjoint(earlier[k]) and join.reaches(most_shared(points[lo + k], points[i]), int(n[lo + k] + n[i])):
                        out.append((min(ids[lo + k], ids[i]), max(ids[lo + k], ids[i])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    trees = members.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    rows = dealt(members, "key").join(trees, "id").join(points, "id").select("key", "id", "n", "label", "point", "keys", "task")
    return rows.groupBy("task").applyInPandas(run, "a long, b long")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with a task: all of one key together, TASK_POINTS rows or so to a task."""
    tasks = max(1, rows.count() // TASK_POINTS)
    return rows.withColumn("task", F.pmod(F.xxhash64(*keys), F.lit(tasks)))


def stretches(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last row of each run of equal values of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    edge = [*np.flatnonzero(new).tolist(), len(new)]
    yield from zip(edge[:-1], edge[1:], strict=True)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of some hundred sets share, by products of their presence matrix, some tokens at a time."""
    m = len(sets)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[which]
    owner = np.repeat(np.arange(m), [len(s) for s in sets])[column >= 0]
    column = column[column >= 0]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((m, m), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        cut = slice(*np.searchsorted(column, (lo, lo + 4096)))
        present = np.zeros((m, 4096), np.float32)
        present[owner[cut], column[cut] - lo] = 1
        out += (present @ present.T).astype(np.int64)
    out[np.diag_indices(m)] = [len(s) for s in sets]
    return out


class Facing:
    """Points of a pair of leaves, ascending by size, and for each one those before it that it may link with."""

    def __init__(self, rows: pd.DataFrame, join: Join):
        self.join, self.points = join, [np.frombuffer(p, np.uint32) for p in rows["point"]]
        self.n, self.left, self.right = (rows[c].to_numpy() for c in ("n", "left", "right"))
        self.home = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        g = min(map(len, self.points))
        self.counts = np.array([folded(p, g) for p in self.points])
        key = rows["key"].iloc[0]
        self.earlier = [frozenset(k[: np.searchsorted(k, key)].tolist()) for k in rows["keys"]]

    def first_in(self, i: int, k: int) -> bool:
        """Whether this tree is the first that both are in."""
        return self.earlier[i].isdisjoint(self.earlier[k])

    def before(self, i: int) -> list[int]:
        """Those of other components whose counts, folded to the coarsest point's groups, can reach the threshold."""
        n, home, join = self.n, self.home, self.join
        lo = int(np.searchsorted(100 * n[:i], join.percent * n[i]))
        other = np.flatnonzero((home[lo:i] != home[i]) & ((self.left[lo:i] & self.right[i]) | (self.right[lo:i] & self.left[i]))) + lo
        if not len(other):
            return []
        shared = np.minimum(self.counts[other], self.counts[i]).sum(axis=1)
        return other[(100 + join.percent) * shared >= join.percent * (n[other] + n[i])].tolist()

    def may_link(self, i: int, k: int) -> bool:
        return self.home[i] != self.home[k] and self.join.reaches(most_shared(self.points[i], self.points[k]), int(self.n[i] + self.n[k]))


def across(members: DataFrame, sets_of, join: Join) -> DataFrame:  # noqa: ANN001
    """Links between the components that still meet in a tree; members: key, id, n, label, main (of the leader's component), point.

    A tree's points fall into leaves by size and hash, each of bounded tokens, which hold an upper corner and their sizes;
    the component of the leader has leaves of its own, which don't meet each other. Pairs of leaves whose corners can reach
    the threshold face each other point by point; a pair of points counts in the first tree that both are in. Sets are sent
    only for points with such a partner; a task returns a forest of their links.
    """
    step = float(np.log(100 / join.percent)) * (1 + 1e-9)  # a little more than linked sizes differ by
    sized = members.withColumn("size", F.floor(F.log("n") / step).cast("long"))
    parts = sized.groupBy("key", "main", "size").agg(F.ceil(F.greatest(F.sum("n") / LEAF_TOKENS, F.count("*") / LEAF_DOCS)).cast("long").alias("parts"))
    leaf = F.shiftleft("size", 33) + 2 * F.pmod(F.xxhash64("id"), F.col("parts")) + F.col("main").cast("long")
    placed = materialize(sized.join(parts, ["key", "main", "size"]).select("key", "id", "n", "label", "point", leaf.alias("leaf")), "leaves")

    def corner(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "leaf"], kind="stable").reset_index(drop=True)
        key, name, n, out = rows["key"].to_numpy(), rows["leaf"].to_numpy(), rows["n"].to_numpy(), []
        for lo, hi in stretches(key, name):
            points = [np.frombuffer(p, np.uint32) for p in rows["point"][lo:hi]]
            g = min(map(len, points))
            top = np.max([folded(p, g) for p in points], axis=0).astype(np.uint32)
            out.append((key[lo], name[lo], n[lo:hi].min(), n[lo:hi].max(), top.tobytes()))
        return pd.DataFrame(out, columns=["key", "leaf", "least", "most", "corner"])

    corners = dealt(placed.select("key", "leaf", "n", "point"), "key", "leaf").groupBy("task").applyInPandas(corner, "key long, leaf long, least long, most long, corner binary")
    corners = materialize(corners, "corners")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, (x, y, n, m, p, q) in enumerate(zip(*(b.column(c).to_pylist() for c in ("corner_x", "corner_y", "least_x", "least_y", "most_x", "most_y")), strict=True)):
                if 100 * min(p, q) >= join.percent * max(n, m) and join.reaches(most_shared(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)), n + m):
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64())).select(["key", "x", "y"])

    side = lambda c: corners.select("key", F.col("leaf").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("least", "most", "corner")])
    both = side("x").join(side("y"), "key").filter("x <= y and not (x % 2 = 1 and y % 2 = 1) and shiftright(y, 33) - shiftright(x, 33) <= 1")
    met = materialize(both.mapInArrow(meet, "key long, x long, y long"), "meet")
    trees = members.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # of its prefix
    ends = met.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("leaf"))
    facing = placed.join(ends, ["key", "leaf"]).join(trees, "id").select("key", "x", "y", "id", "n", "label", "point", "keys", (F.col("leaf") == F.col("x")).alias("left"), (F.col("leaf") == F.col("y")).alias("right"))
    facing = materialize(facing, "facing")

    def partners(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "x", "y", "n", "id"], kind="stable").reset_index(drop=True)
        key, x, y, ids = (rows[c].to_numpy() for c in ("key", "x", "y", "id"))
        out = []
        for lo, hi in stretches(key, x, y):
            pair, some = Facing(rows[lo:hi], join), set()
            for i in range(1, hi - lo):
                for k in pair.before(i):
                    if not (i in some and k in some) and pair.first_in(i, k) and pair.may_link(i, k):
                        some |= {i, k}
            out += [lo + k for k in sorted(some)]
        return pd.DataFrame({"key": key[out], "x": x[out], "y": y[out], "id": ids[out]})

    asked = dealt(facing, "key", "x", "y").groupBy("task").applyInPandas(partners, "key long, x long, y long, id long")
    asked = materialize(asked, "asked")
    groups = asked.join(facing, ["key", "x", "y", "id"]).join(sets_of(asked.select("id").distinct()), "id")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        n, ids, left, right = (rows[c].to_numpy() for c in ("n", "id", "left", "right"))
        home = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        shared = overlaps([np.frombuffer(t, np.uint64) for t in rows["tokens"]])
        fits = ((100 + join.percent) * shared >= join.percent * (n[:, None] + n)) & ((left[:, None] & right) | (right[:, None] & left))
        out = []
        for i in range(1, len(rows)):
            for k in np.flatnonzero(fits[i, :i] & (home[:i] != home[i])).tolist():
                if home[i] != home[k]:
                    home[home == home[i]] = home[k]
                    out.append((ids[i], ids[k]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return groups.groupBy("key", "x", "y").applyInPandas(link, "a long, b long")


def jaccard_join(df: DataFrame, join: Join | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of each row.

    Documents of one set are one vertex. Null and blank texts have an empty set and link with nothing. Rows that repeat are
    copies; a null doc_id takes part and counts as none for component_id (null if there is no other). An empty table gives
    no rows; long texts are taken in slices; extra columns are not read.
    """
    join = join or Join()
    docs = with_columns_as(df, doc_id="long", text="string").withColumn("tie", F.xxhash64("text"))
    frequent = frequent_tokens(docs, join)
    rows = materialize(described(docs, join, frequent), "described")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tie")
    classes = rows.filter("v is not null").groupBy("v").agg(F.min_by(F.struct("doc_id", "tie"), order).alias("of"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("prefix").alias("prefix"))
    vertices = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vertices")
    bucket = Window.partitionBy("key", "part")
    star = keyed(vertices, frequent).withColumns({"leader": F.min("id").over(bucket), "most": F.max("id").over(bucket)})
    # Of a frequent key every part stays, as its documents may be spread one to a part.
    members = materialize(star.filter("leader < most or part >= 0").select("key", "part", "id", "leader"), "members")

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = vertices.join(wanted, "id", "left_semi").select("id", "of.doc_id", "of.tie")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, found = b.column("text").to_pylist(), []
                for lo, hi in runs(texts):
                    found += [s.tobytes() for s in join.plan.sets(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "tokens"])

        same = docs["doc_id"].eqNullSafe(ids["doc_id"]) & (docs["tie"] == ids["tie"])
        return materialize(docs.join(ids, same).select("id", "text").dropDuplicates(["id"]).mapInArrow(run, "id long, tokens binary"), "sets")

    heads = members.groupBy("key").agg(F.min("leader").alias("head"), F.max("leader").alias("last")).filter("head < last").select("key", "head")
    between = members.select("key", "leader").distinct().join(heads, "key").filter("leader <> head").select(F.col("head").alias("a"), F.col("leader").alias("b"))
    pairs = materialize(members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).union(between).distinct(), "pairs")
    near = materialize(bounded(pairs, vertices, join), "near")
    links = materialize(decided(near, sets_of(near.select(F.col("a").alias("id")).union(near.select("b")).distinct()), join), "links")
    labels = components(links)
    labelled = materialize(members.select("key", "id").join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    trees = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), F.min_by("label", "id").alias("first")).filter("x <> y and m > 2").select("key", "first", "m")
    rest = labelled.join(trees, "key").select("key", "id", "label", (F.col("label") == F.col("first")).alias("main"), (F.col("m") <= LEAF_POINTS).alias("small"))
    rest = materialize(rest, "rest")
    points = vertices.select("id", "n", "point")
    small = materialize(different_trees(rest.filter("small").select("key", "id", "label")), "small")
    few = within_leaves(small, points, join).join(pairs, ["a", "b"], "left_anti")  # those are decided
    few = materialize(few, "leaf_pairs")
    more = decided(few, sets_of(few.select(F.col("a").alias("id")).union(few.select("b")).distinct()), join)
    links = materialize(links.union(more), "links")
    large = rest.filter("not small").drop("small")
    if not large.isEmpty():
        large = materialize(large.join(points, "id"), "large")
        links = materialize(links.union(across(large, sets_of, join)), "links")
    labels = components(links)
    least = vertices.select("v", "of", "id").join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = least.groupBy("label").agg(F.min("of.doc_id").alias("component_id"))
    of = materialize(least.join(named, "label").select("v", "component_id"), "classes")
    return rows.select("doc_id", "n", "v").join(of, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: All pairs that share a shingle, then everything each document reaches.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sets UNION SELECT v, b FROM reach JOIN both_ ON r = a),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON v = doc_id
"""
