"""Graph operators on link tables: components, cases, centralities, bridges, communities, candidates, paths.

Vertices and links are DataFrames (a < b, weight). Iterations write each round to the shared folder; per-component
algorithms run grouped by component; larger ones take a way that is spread over the tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions import vocab
from casegraph.operators.storage import clear, mark, numbered, parts, saved


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


#: A component of up to this many links is one task's (some 300 MB), a larger one is spread over the tasks.
LINKS = 2_000_000
#: Up to this many links that are left after a round of components() are joined in one task.
FINISH = 1_000_000
#: Links that thinned() looks at together.
TOGETHER = 200_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places reaches by links between places."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _whole_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, to) of all links (a, b) of one task: a vertex of each component."""
    rows = list(batches)
    if rows:
        rows = pd.concat(rows, ignore_index=True)
        at, names = pd.factorize(pd.concat([rows["a"], rows["b"]]))
        yield pd.DataFrame({"v": names, "to": names[_roots(at[: len(rows)], at[len(rows) :], len(names))]})


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components: of each task's links, some at a time, as few as connect the same vertices.

    Where all links of a dense group are made in one task, its vertices less one are left, and nothing is shuffled.
    """
    kind = links.schema["a"].dataType.simpleString()

    def fewer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.chunked_array([b.column(c) for c in ("a", "b") for b in held]).combine_chunks().dictionary_encode()
        at, names = both.indices.to_numpy(), both.dictionary
        root = _roots(at[: len(at) // 2], at[len(at) // 2 :], len(names))
        more = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(root[more])), names.take(pa.array(more))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= TOGETHER:
                yield fewer(held)
                held, n = [], 0
        if n:
            yield fewer(held)

    return links.select("a", "b").filter("a <> b").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame, finish: int = FINISH) -> DataFrame:
    """(v, label): the least vertex that v reaches.

    Each round every vertex goes to the one of least hash among itself and its neighbours, and links join what is left: of any
    graph a fixed share goes on average, of dense ones nearly all, so that all rounds together cost little more than the first.
    Least members climb with the vertices, labels go down the rounds again; no join has all of a component under one key.
    Up to ``finish`` links that are left are joined in one task, which saves the last rounds.
    """
    start = mark()
    kind = links.schema["a"].dataType.simpleString()
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b"))
    low, homes = None, []
    for turn in itertools.count():
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        last = edges.count() <= finish
        if last:
            home = edges.coalesce(1).mapInPandas(_whole_home, f"v {kind}, to {kind}")
        else:
            both = edges.union(edges.select("b", "a"))
            home = both.groupBy(F.col("a").alias("v")).agg(F.min(place("b")).alias("m"))
            home = home.select("v", F.least("m", place("v"))["to"].alias("to"))
        home = saved(home.withColumn("low", F.col("v")) if low is None else home.join(low, "v", "left").withColumn("low", F.coalesce("low", "v")))
        homes.append(home)
        if last:
            break
        low = home.groupBy(F.col("to").alias("v")).agg(F.min("low").alias("low"))
        one, two = home.select(F.col("v").alias("a"), F.col("to").alias("x")), home.select(F.col("v").alias("b"), F.col("to").alias("y"))
        joined = edges.join(one, "a").join(two, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = saved(joined.distinct())
        if edges.isEmpty():
            break
    labels = None
    for home in reversed(homes):
        up = home.groupBy(F.col("to")).agg(F.min("low").alias("least"))
        if labels is not None:
            up = up.join(labels.withColumnRenamed("v", "to"), "to", "left").select("to", F.coalesce("label", "least").alias("least"))
        labels = home.select("v", "to").join(up, "to").select("v", F.col("least").alias("label"))
    labels = saved(labels)
    clear(links.sparkSession, start, but_last=1)
    return labels


def projection(scored: DataFrame, manual: DataFrame) -> DataFrame:
    """One weight for each unordered pair: a manual link (0.99) before derived ones of at least the cluster threshold.

    scored has a row for each pair. Manual links go to where their first report is, so that no derived one is shuffled.
    """
    by_hand = saved(manual.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    derived = scored.filter(F.col("score") >= vocab.CLUSTER).select("a", "b", F.col("score").alias("weight"))
    near = derived.join(by_hand.groupBy("a").agg(F.collect_list("b").alias("hand")), "a", "left").withColumn("manual", F.coalesce(F.array_contains("hand", F.col("b")), F.lit(False)))
    known = saved(near.select("a", "b", F.when(F.col("manual"), vocab.MOST).otherwise(F.col("weight")).alias("weight"), "manual"))
    more = by_hand.join(known.filter("manual").select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit(vocab.MOST).alias("weight"), F.lit(True).alias("manual"))
    return known.union(more)


class Implied:
    """Links that stand for all pairs of classes of vertices: blocks (x, y, score; x <= y) and members (class, v).

    A block is every pair of one member of x and another of y. known (a < b) are pairs with a row of their own, be it a link or
    not; inside (a, b, x, y, score) are those of them that a block has too, so that none counts twice. All tables grow with
    members and blocks, none with pairs.
    """

    def __init__(self, blocks: DataFrame, members: DataFrame, known: DataFrame):
        self.members = members
        sizes = members.groupBy("class").agg(F.count("*").alias("n"))
        n = lambda c: sizes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"))
        self.blocks = saved(blocks.filter(F.col("score") >= vocab.CLUSTER).join(n("x"), "x").join(n("y"), "y").select("x", "y", "score", "n_x", "n_y"))
        one = self.blocks.select("x", "y", "score", "n_y")
        self.both = one.union(self.blocks.filter("x <> y").select("y", "x", "score", "n_x"))  # x, y in both orders, with the size of y
        end = lambda v, c: members.select(F.col("v").alias(v), F.col("class").alias(c))
        met = known.select("a", "b").distinct().join(end("a", "x"), "a").join(end("b", "y"), "b")
        self.inside = saved(met.withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")}).join(self.blocks.select("x", "y", "score"), ["x", "y"]).select("a", "b", "x", "y", "score"))

    def certificate(self) -> DataFrame:
        """Links (a, b, weight) with the same components and bridges: members of a class with two members of the other.

        A vertex alone in its class keeps all of its links, larger classes stay connected without any one link.
        """
        first = self.members.groupBy("class").agg(F.min("v").alias("rep"))
        second = self.members.join(first, "class").filter("v <> rep").groupBy("class").agg(F.min("v").alias("rep"))
        some = self.both.join(self.members.select(F.col("class").alias("x"), "v"), "x").join(first.union(second).withColumnRenamed("class", "y"), "y").filter("v <> rep")
        ends = some.select(F.least("v", "rep").alias("a"), F.greatest("v", "rep").alias("b"), F.col("score").alias("weight")).distinct()
        return ends.join(self.inside.select("a", "b"), ["a", "b"], "left_anti")

    def summary(self) -> DataFrame:
        """a (a member of the block), weight and links of each block, known pairs left out."""
        apart = self.inside.groupBy("x", "y").agg(F.count("*").alias("known"))
        first = self.members.groupBy(F.col("class").alias("x")).agg(F.min("v").alias("a"))
        count = F.expr("if(x = y, n_x * (n_x - 1) div 2, n_x * n_y)") - F.coalesce("known", F.lit(0).cast("long"))
        return self.blocks.join(apart, ["x", "y"], "left").withColumn("links", count).filter("links > 0").join(first, "x").select("a", F.col("score").alias("weight"), "links")

    def pairs_of(self, asked: DataFrame) -> DataFrame:
        """The implied links (a, b, weight) of the asked vertices (v), on demand."""
        mine = self.members.join(asked.select("v").distinct(), "v").select(F.col("class").alias("x"), "v")
        met = mine.join(self.both, "x").join(self.members.select(F.col("class").alias("y"), F.col("v").alias("w")), "y").filter("v <> w")
        return met.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), F.col("score").alias("weight")).distinct().join(self.inside.select("a", "b"), ["a", "b"], "left_anti")


def cases(labels: DataFrame, links: DataFrame, implied: Implied | None = None) -> DataFrame:
    """Components of two and more: reports, links, least and greatest weight."""
    rows = links.select("a", "weight", F.lit(1).cast("long").alias("links"))
    rows = rows if implied is None else rows.unionByName(implied.summary())
    each = rows.groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"), F.min("weight").alias("least"), F.max("weight").alias("most"))
    of = each.join(labels, "v").groupBy("label").agg(F.sum("links").alias("links"), F.round(F.min("least"), 3).alias("min_weight"), F.round(F.max("most"), 3).alias("max_weight"))
    return labels.groupBy("label").agg(F.count("*").alias("reports")).join(of, "label").select(F.col("label").alias("first_report"), "reports", "links", "min_weight", "max_weight")


def all_cases(labels: DataFrame, links: DataFrame, reports: DataFrame, implied: Implied | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases with their names in order (most reports, then first report), and (case, sid) of every report.

    Components are L001, L002, ... by size; a report without links is a case R<id> by itself. reports: sid.
    """
    grouped = numbered(cases(labels, links, implied), F.desc("reports"), "first_report", name="no")
    named = saved(grouped.select(F.concat(F.lit("L"), F.lpad(F.col("no").cast("string"), F.greatest(F.lit(3), F.length(F.col("no").cast("string"))), F.lit("0"))).alias("case"), "first_report", "reports", "links", "min_weight", "max_weight"))
    member = labels.join(named.select("case", F.col("first_report").alias("label")), "label").select("case", F.col("v").alias("sid"))
    alone = reports.select("sid").join(labels.select(F.col("v").alias("sid")), "sid", "left_anti")
    name = F.concat(F.lit("R"), F.col("sid").cast("string")).alias("case")
    single = alone.select(name, F.col("sid").alias("first_report"), F.lit(1).cast("long").alias("reports"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("double").alias("min_weight"), F.lit(None).cast("double").alias("max_weight"))
    return named.union(single).orderBy(F.desc("reports"), "first_report"), member.union(alone.select(name, "sid"))


def degree(links: DataFrame, n: int, vertices: DataFrame | None = None, implied: Implied | None = None) -> DataFrame:
    """Neighbours over n - 1 (one if n is at most one); of vertices (v) too that have none. A pair has one row, as in projection()."""
    near = links.filter("a <> b").select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))
    if implied is not None:
        of = implied.both.groupBy(F.col("x").alias("class")).agg(F.sum(F.col("n_y") - (F.col("x") == F.col("y")).cast("long")).alias("degree"))
        more = implied.members.join(of, "class").select("v", "degree")
        less = implied.inside.select(F.explode(F.array("a", "b")).alias("v"), F.lit(-1).cast("long").alias("degree"))
        near = near.unionByName(more).unionByName(less).groupBy("v").agg(F.sum("degree").alias("degree")).filter("degree > 0")
    if vertices is not None:
        near = vertices.select("v").join(near, "v", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return near.withColumn("centrality", F.round(F.col("degree") / F.lit(n - 1), 6) if n > 1 else F.lit(1.0))


def pagerank(links: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, implied: Implied | None = None, labels: DataFrame | None = None, most: int | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Weighted PageRank over the vertices of links and the given ones (v).

    A vertex without links passes its rank to all alike; such vertices all have one rank, which follows from their number. So
    components don't depend on each other: one of up to LINKS links (or ``most`` vertices) is a task's, larger ones go by
    rounds over all tasks. A task iterates from even ranks, which have the sum of the result, and ends when a round moves less
    than ``tolerance`` of all rank; a round moves at most 2 * damping ** k, so the default tolerance is met within 90 of the 100
    rounds. Rounds over all tasks are those of conjugate gradients (links go both ways, so the system is symmetric but for
    scale), which end when a plain round would move less; 25 will do for the default. With implied links all go by rounds. Implied links pass rank by class: what
    the members of x give, times the block's score, is what each member of y gets; a negative weight takes back what a
    block gives a pair of its own row, or a vertex itself. whole: groups as in grouped(), which aren't expanded; with them a
    component of up to MEMBERS (or ``most``) members is a task's. labels are those of links and whole then, and are needed.
    """
    spark = links.sparkSession
    kind = links.schema["a"].dataType.simpleString()
    if whole is not None:
        rows = saved(grouped(links, whole, labels, net=True))
        given_by = rows.select(F.explode("at").alias("v"), (F.col("weight") * (F.size("at") - 1)).alias("weight"))
    else:
        if implied is None:
            links = saved(links.select("a", "b", "weight"))
        both = links.select("a", "b", "weight").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
        given_by = both.select(F.col("a").alias("v"), "weight")
    if implied is not None:
        back = implied.inside.select("a", "b", (-F.col("score")).alias("weight"))
        own = implied.members.join(implied.blocks.filter("x = y").select(F.col("x").alias("class"), "score"), "class").select(F.col("v").alias("a"), F.col("v").alias("b"), (-F.col("score")).alias("weight"))
        back = back.union(back.select("b", "a", "weight")).union(own)
        mass = implied.both.groupBy(F.col("x").alias("class")).agg(F.sum(F.col("score") * F.col("n_y")).alias("weight"))
        given_by = given_by.union(back.select("a", "weight")).union(implied.members.join(mass, "class").select("v", "weight"))
        both = both.unionByName(back)
    # Differences of weights that cancel leave rounding only.
    linked = saved(given_by.groupBy("v").agg(F.sum("weight").alias("total")).filter("total > 1e-9"))
    alone = saved(vertices.select("v").join(linked, "v", "left_anti")) if vertices is not None else spark.createDataFrame([], f"v {kind}")
    lonely = alone.count()
    n = linked.count() + lonely
    if not n:
        return spark.createDataFrame([], f"v {kind}, rank double")
    single = (1 - damping) / (n - damping * lonely)  # (1 - damping) / n and what all of its like give it
    even = single / (1 - damping)

    def iterated(names: np.ndarray, flow) -> np.ndarray:  # noqa: ANN001
        rank = np.full(len(names), even)
        for _ in range(rounds):
            old, rank = rank, single + damping * flow(rank)
            if np.abs(rank - old).sum() < tolerance * len(names) / n:
                break
        return rank

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, names = _places(rows)
        a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(rows["weight"].to_numpy(float), 2)
        w = w / np.bincount(a, w, len(names))[a]
        return pd.DataFrame({"v": names, "rank": iterated(names, lambda rank: np.bincount(b, w * rank[a], len(names)))})

    def run_groups(table: pa.Table) -> pa.Table:
        names, c, v, sizes, w = _held(table)
        each = w[c]
        total, own = np.bincount(v, each * (sizes[c] - 1), len(names)), np.bincount(v, each, len(names))

        def flow(rank: np.ndarray) -> np.ndarray:
            part = rank / total
            return np.bincount(v, each * np.bincount(c, part[v], len(sizes))[c], len(names)) - own * part

        return pa.table({"v": names, "rank": iterated(names, flow)})

    def solved(some: DataFrame, flows) -> DataFrame:  # noqa: ANN001
        """Ranks of vertices (v, total): flows() gives what links carry of each vertex's part, as rows (v, flow)."""
        start = mark()
        carried = lambda state, c: state.join(flows(state.select("v", (F.col(c) / F.col("total")).alias("part"))).groupBy("v").agg(F.sum("flow").alias("flow")), "v", "left").withColumn("flow", damping * F.coalesce("flow", F.lit(0.0)))
        left = F.lit(single) - F.col("x") + F.col("flow")
        state = saved(carried(some.withColumn("x", F.lit(even)), "x").select("v", "total", "x", left.alias("r"), left.alias("p")))
        squares, moved = state.agg(F.sum(F.col("r") * F.col("r") / F.col("total")), F.sum(F.abs("r"))).first()
        for _ in range(rounds):
            if not moved or moved < tolerance:
                break
            new = saved(carried(state, "p").select("v", "total", "x", "r", "p", (F.col("p") - F.col("flow")).alias("q")))
            clear(spark, start, but_last=1)
            way = squares / new.agg(F.sum(F.col("p") * F.col("q") / F.col("total"))).first()[0]
            new = new.select("v", "total", (F.col("x") + way * F.col("p")).alias("x"), (F.col("r") - way * F.col("q")).alias("r"), "p")
            before = squares
            squares, moved = new.agg(F.sum(F.col("r") * F.col("r") / F.col("total")), F.sum(F.abs("r"))).first()
            state = new.withColumn("p", F.col("r") + squares / before * F.col("p"))
        return state.select("v", (F.col("x") + F.col("r")).alias("rank"))

    def spread(vertices: DataFrame | None, links: DataFrame | None) -> DataFrame:
        some = linked if vertices is None else linked.join(vertices.select("v"), "v", "left_semi")
        edges = saved(both if links is None else links.select("a", "b", "weight").union(links.select("b", "a", "weight")))

        def flows(part: DataFrame) -> DataFrame:
            flow = edges.join(part.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), (F.col("weight") * F.col("part")).alias("flow"))
            if implied is not None:
                sent = implied.members.join(part, "v").groupBy(F.col("class").alias("x")).agg(F.sum("part").alias("part"))
                got = implied.both.join(sent, "x").groupBy(F.col("y").alias("class")).agg(F.sum(F.col("score") * F.col("part")).alias("flow"))
                flow = flow.unionByName(implied.members.join(got, "class").select("v", "flow"))
            return flow

        return solved(some, flows)

    def spread_groups(rows: DataFrame) -> DataFrame:
        groups = saved(rows.withColumn("c", F.monotonically_increasing_id()))
        member = saved(groups.select("c", F.explode("at").alias("v")))
        own = saved(groups.select(F.explode("at").alias("v"), "weight").groupBy("v").agg(F.sum("weight").alias("own")))

        def flows(part: DataFrame) -> DataFrame:
            sent = member.join(part, "v").groupBy("c").agg(F.sum("part").alias("part"))
            got = groups.join(sent, "c").select(F.explode("at").alias("v"), (F.col("weight") * F.col("part")).alias("flow"))
            return got.union(own.join(part, "v").select("v", -F.col("own") * F.col("part")))

        return solved(linked.join(own.select("v"), "v", "left_semi"), flows)

    schema = f"v {kind}, rank double"
    if whole is not None:
        found, large, more = _by_group(rows, run_groups, schema, MEMBERS if most is None else most)
        found = found.union(spread_groups(large)) if more else found
    else:
        found = _by_component(links, run, schema, most, spread, labels) if implied is None else spread(None, None)
    return found.union(alone.select("v", F.lit(single).alias("rank")))


def positions(degree: DataFrame, rank: DataFrame, between: DataFrame, bridges: DataFrame, n: int = vocab.TOP_CENTRAL) -> DataFrame:
    """(metric, place, v, w, value): the n most central of each metric and the first n bridges (v to w, without a value); equal ones by vertex."""
    lists = [("degree", degree, "centrality"), ("betweenness", between, "betweenness"), ("pagerank", rank, "rank")]
    first = lambda df, value: df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), "v").limit(n)
    best = [first(df, value).select(F.lit(name).alias("metric"), F.col("v").cast("string").alias("v"), F.lit(None).cast("string").alias("w"), F.col(value).alias("value")) for name, df, value in lists]
    some = bridges.orderBy("a", "b").limit(n).select(F.lit("bridge").alias("metric"), F.col("a").cast("string").alias("v"), F.col("b").cast("string").alias("w"), F.lit(None).cast("double").alias("value"))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "v", "w"))
    return reduce(DataFrame.unionByName, best + [some]).select("metric", place.alias("place"), "v", "w", F.round("value", 4).alias("value"))


def named_communities(home: DataFrame) -> DataFrame:
    """v, community C001, ... (by size, then least member; numbers of single vertices stay out), algorithm, weight and seed."""
    sizes = home.groupBy("community").agg(F.count("*").alias("size"))
    names = numbered(sizes.filter("size > 1"), F.desc("size"), "community", name="no")
    named = names.select("community", "size", F.concat(F.lit("C"), F.lpad(F.col("no").cast("string"), F.greatest(F.lit(3), F.length(F.col("no").cast("string"))), F.lit("0"))).alias("name"))
    return home.join(named, "community").select("v", F.col("name").alias("community"), "size", F.lit("local_moves").alias("algorithm"), F.lit("score").alias("weight"), F.lit(None).cast("int").alias("seed"))


def _by_component(links: DataFrame, fn, schema: str, most: int | None, rest=None, labels: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """fn over each component's links; larger ones go to rest, as (label, v) and links.

    Larger are those of more than most vertices, without most those of more than LINKS links. There are few of them (at most
    the size of the graph over that limit), so that the rows of no component meet in a join by its label. labels: those of
    components(), if they are known.
    """
    labels = components(links) if labels is None else labels
    rows = saved(links.join(labels, links["a"] == labels["v"]).select("label", "a", "b", "weight"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")) if most is None else labels.groupBy("label").agg(F.count("*").alias("n"))
    large = saved(sizes.filter(F.col("n") > (LINKS if most is None else most)).select("label"))
    more = rest is not None and not large.isEmpty()
    small = rows.join(F.broadcast(large), "label", "left_anti")
    small = small.repartition(parts(links.sparkSession, rows.count()), "label").groupBy("label").applyInPandas(fn, schema)
    if not more:
        return small
    return small.unionByName(rest(labels.join(F.broadcast(large), "label", "left_semi").select("label", "v"), rows.join(F.broadcast(large), "label", "left_semi")))


#: A component whose groups have up to this many members together is one task's (some 1 GB).
MEMBERS = 20_000_000


def grouped(links: DataFrame, whole: DataFrame, labels: DataFrame, net: bool) -> DataFrame:
    """(label, at, weight): groups of vertices (at) of which any two are linked, by component; a link is a group of two.

    whole: such groups; links stand beside them and replace what a group says of their pair. net: all weights of a pair sum up
    to its own, so links are less what groups give. Otherwise a link must be heavier than what it replaces, and groups where
    one isn't go by pairs.
    """
    whole = saved(whole.select("at", "weight").withColumn("c", F.monotonically_increasing_id()))
    member = whole.select("c", "weight", F.explode("at").alias("v"))
    # The joins merge: lists are small as files and large as rows, and Spark would send them to the driver.
    met = links.select("a", "b", F.col("weight").alias("own")).join(member.withColumnRenamed("v", "a").hint("merge"), "a").join(member.select("c", F.col("v").alias("b")).hint("merge"), ["c", "b"])
    if net:
        less = met.groupBy("a", "b").agg(F.sum("weight").alias("less"))
        pairs = links.join(less.hint("merge"), ["a", "b"], "left").select("a", "b", (F.col("weight") - F.coalesce("less", F.lit(0.0))).alias("weight")).filter("weight <> 0")
    else:
        weak = saved(met.filter("own <= weight").select("c").distinct())
        split = whole.join(weak, "c").select(F.posexplode("at").alias("i", "a"), "at", "weight").select("a", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("b"), "weight")
        split = split.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
        pairs = links.select("a", "b", "weight").union(split.join(links.select("a", "b").hint("merge"), ["a", "b"], "left_anti"))
        whole = whole.join(weak, "c", "left_anti")
    rows = whole.select("at", "weight").union(pairs.select(F.array("a", "b"), "weight"))
    return rows.withColumn("v", F.col("at")[0]).join(labels.hint("merge"), "v").select("label", "at", "weight")


def _by_group(rows: DataFrame, fn, schema: str, most: int) -> tuple[DataFrame, DataFrame, bool]:  # noqa: ANN001
    """fn over the groups of each component of up to so many members; the others, and whether there are any."""
    sizes = rows.groupBy("label").agg(F.sum(F.size("at")).alias("n"))
    large = saved(sizes.filter(F.col("n") > most).select("label"))
    small = rows.join(F.broadcast(large), "label", "left_anti")
    small = small.repartition(parts(rows.sparkSession, sizes.agg(F.sum("n")).first()[0]), "label").groupBy("label").applyInArrow(fn, schema)
    return small, rows.join(F.broadcast(large), "label", "left_semi"), not large.isEmpty()


def _held(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The vertices of groups; of each member of a group that and its vertex's place; the sizes and weights of groups."""
    at = table["at"].combine_chunks()
    sizes = at.value_lengths().to_numpy().astype(np.int64)
    names, v = np.unique(at.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    return names, np.repeat(np.arange(len(sizes)), sizes), v, sizes, table["weight"].to_numpy()


def _places(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of links as places in the sorted vertices, and those."""
    at, names = pd.factorize(pd.concat([rows["a"], rows["b"]]), sort=True)
    return at[: len(rows)], at[len(rows) :], np.asarray(names)


#: Up to this many vertices in a component betweenness takes all of them as sources, beyond it a sample.
EXACT = 5_000


def omitted(links: DataFrame, metric: str = "betweenness", most: int = EXACT) -> DataFrame:
    """Components for whose size a metric is estimated, as rows instead of silence."""
    return components(links).groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit(metric).alias("metric"), "label", "n", F.lit(most).alias("limit"))


def _neighbours(rows: pd.DataFrame) -> dict:
    out: dict = {}
    for a, b, w in rows[["a", "b", "weight"]].itertuples(index=False):
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return {k: dict(sorted(v.items())) for k, v in sorted(out.items())}


def _forest(links: DataFrame, vertices: DataFrame) -> tuple[DataFrame, int]:
    """(v, parent, depth) of a breadth-first forest from each label's vertex, and its depth; links in both directions."""
    seen = saved(vertices.filter("v = label").select("v", F.lit(None).cast(vertices.schema["v"].dataType).alias("parent"), F.lit(0).alias("depth")))
    front, depth = seen, 0
    while True:
        step = front.select(F.col("v").alias("a")).join(links, "a").groupBy(F.col("b").alias("v")).agg(F.min("a").alias("parent"))
        new = saved(step.join(seen.select("v"), "v", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if new.isEmpty():
            return seen, depth
        front, depth = new, depth + 1
        seen = saved(seen.unionByName(new)) if depth % 16 == 0 else seen.unionByName(new)


def _bridges_wide(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Bridges of components of any size, level by level from the leaves of a breadth-first forest.

    Each link outside the forest has a 128-bit hash. The hashes at a vertex and under it, combined by exclusive or, are those
    of the links that leave its subtree beside the one to its parent; that one is a bridge if they are zero. A wrong bridge
    has a chance of 2 ** -128.
    """
    both = saved(_both(links))
    forest, depth = _forest(both, vertices)
    forest = saved(forest)
    up = forest.filter("parent is not null").select(F.col("v").alias("a"), F.col("parent").alias("b"))
    rest = both.join(up.union(up.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    ends = [F.least("a", "b"), F.greatest("a", "b")]
    own = rest.select(F.col("a").alias("v"), F.xxhash64(F.lit(1), *ends).alias("x"), F.xxhash64(F.lit(2), *ends).alias("y")).groupBy("v").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    base = saved(forest.join(own, "v", "left").select("v", "parent", "depth", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("x", "y")]))
    level, out = None, base.limit(0).select(F.col("v").alias("a"), F.col("v").alias("b"))
    for d in range(depth, 0, -1):
        rows = base.filter(F.col("depth") == d).select("v", "parent", "x", "y")
        if level is not None:
            below = level.select(F.col("parent").alias("v"), F.lit(None).cast(level.schema["v"].dataType).alias("parent"), "x", "y")
            rows = rows.unionByName(below).groupBy("v").agg(F.max("parent").alias("parent"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        level = saved(rows)
        out = out.unionByName(level.filter("x = 0 and y = 0").select(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b")))
    return out


def bridges(links: DataFrame, most: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Links whose loss splits their component: a depth-first walk with low points, without recursion.

    Components over ``most`` vertices (without it: over LINKS links) go to _bridges_wide, which is spread over the tasks.
    """

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, names = _places(rows)
        n = len(names)
        pairs = np.unique(np.minimum(a, b)[a != b] * n + np.maximum(a, b)[a != b])
        a, b = np.concatenate([pairs // n, pairs % n]), np.concatenate([pairs % n, pairs // n])
        order = np.argsort(a, kind="stable")
        near, stops = b[order].tolist(), np.cumsum(np.bincount(a, minlength=n)).tolist()
        at, seen, low, out, count = [0, *stops[:-1]], [-1] * n, [0] * n, [], 0
        for root in range(n):
            if seen[root] >= 0:
                continue
            seen[root] = low[root] = count
            count += 1
            stack = [(root, -1)]
            while stack:
                v, above = stack[-1]
                if at[v] < stops[v]:
                    w = near[at[v]]
                    at[v] += 1
                    if seen[w] < 0:
                        seen[w] = low[w] = count
                        count += 1
                        stack.append((w, v))
                    elif w != above and seen[w] < low[v]:
                        low[v] = seen[w]
                else:
                    stack.pop()
                    if above >= 0:
                        low[above] = min(low[above], low[v])
                        if low[v] > seen[above]:
                            out.append((min(v, above), max(v, above)))
        ends = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": names[ends[:, 0]], "b": names[ends[:, 1]]})

    kind = links.schema["a"].dataType.simpleString()
    return _by_component(links, find, f"a {kind}, b {kind}", most, _bridges_wide, labels)


#: Lengths count in units of 1e-12: equal sums are equal numbers, and a path may have 9 million links of weight 1.
_UNIT = 1e12


def _flow(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(s, v, x): sums of x over all walks of one step (s, v, to) or more from start; steps have no cycles."""
    front = total = None
    for k in itertools.count():
        front = saved((start if front is None else front).join(steps, ["s", "v"]).groupBy("s", F.col("to").alias("v")).agg(F.sum("x").alias("x")))
        if k and front.isEmpty():
            return total.groupBy("s", "v").agg(F.sum("x").alias("x"))
        total = front if total is None else total.unionByName(front)
        if k % 16 == 15:
            total = saved(total.groupBy("s", "v").agg(F.sum("x").alias("x")))


def _dependencies(sources: DataFrame, links: DataFrame) -> DataFrame:
    """(v, total, squares): how far shortest paths from the sources (s) depend on v; links are (a, b, length), both ways.

    Distances fall by rounds of relaxation from what fell last. The links on shortest paths have no cycles, so that both sums are
    linear: paths of k links add up from those of k - 1, and so does what flows back. Rounds grow with the links of a path.
    """
    far = saved(sources.select("s", F.col("s").alias("v"), F.lit(0).cast("long").alias("far"), F.lit(True).alias("fresh")))
    while True:
        start = mark() - 1
        step = far.filter("fresh").select("s", F.col("v").alias("a"), "far").join(links, "a").select("s", F.col("b").alias("v"), (F.col("far") + F.col("length")).alias("far"), F.lit(None).cast("long").alias("old"))
        known = far.select("s", "v", "far", F.col("far").alias("old"))
        least = known.unionByName(step).groupBy("s", "v").agg(F.min("far").alias("far"), F.min("old").alias("old"))
        far = saved(least.select("s", "v", "far", (F.col("old").isNull() | (F.col("far") < F.col("old"))).alias("fresh")))
        clear(far.sparkSession, start, but_last=1)
        if far.filter("fresh").isEmpty():
            break
    ends = far.select("s", F.col("v").alias("to"), F.col("far").alias("there"))
    tried = far.select("s", F.col("v").alias("a"), "far").join(links, "a").select("s", F.col("a").alias("v"), F.col("b").alias("to"), (F.col("far") + F.col("length")).alias("there"))
    steps = saved(tried.join(ends, ["s", "to", "there"], "left_semi").select("s", "v", "to"))
    one = sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("x"))
    paths = saved(_flow(one, steps).withColumnRenamed("x", "paths"))
    back = _flow(paths.select("s", "v", (1 / F.col("paths")).alias("x")), steps.select("s", F.col("to").alias("v"), F.col("v").alias("to")))
    load = back.join(paths, ["s", "v"]).select("v", (F.col("x") * F.col("paths")).alias("load"))
    return load.groupBy("v").agg(F.sum("load").alias("total"), F.sum(F.col("load") * F.col("load")).alias("squares"))


#: Sources whose paths one task finds in a component of links, and of groups.
SOURCES, GROUP_SOURCES = 64, 16


def _dependencies_here(sources: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """What _dependencies() gives, of one component that is here as a whole (its links once)."""
    a, b, names = _places(links)
    n, length = len(names), np.tile(links["length"].to_numpy(np.int64), 2)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(b, kind="stable")
    a, b, length = a[order], b[order], length[order]
    first = np.searchsorted(b, np.arange(n))  # every vertex has a link
    total, squares = np.zeros(n), np.zeros(n)
    for s in np.searchsorted(names, sources["s"].to_numpy()):
        far = np.full(n, np.iinfo(np.int64).max // 4)
        far[s] = 0
        while True:
            there = far[a] + length
            least = np.minimum(far, np.minimum.reduceat(there, first))
            if (least == far).all():
                break
            far = least
        tight = np.flatnonzero(there == far[b])
        v, to = a[tight], b[tight]
        front = np.zeros(n)
        front[s] = 1.0
        paths = front.copy()
        while (front := np.bincount(to, front[v], n)).any():
            paths += front
        front, load = 1 / paths, np.zeros(n)
        while (front := np.bincount(v, front[to], n)).any():
            load += front
        load *= paths
        load[s] = 0.0
        total += load
        squares += load * load
    return pd.DataFrame({"v": names, "total": total, "squares": squares})


def _dependencies_groups(sources: pa.Table, table: pa.Table) -> pa.Table:
    """What _dependencies() gives, of one component whose groups are here as a whole: a step goes into a group and out of it."""
    names, c, v, sizes, w = _held(table)
    n, m, length, first = len(names), len(sizes), np.round(_UNIT / w).astype(np.int64), np.cumsum(sizes) - sizes
    order = np.argsort(v, kind="stable")
    group, at = c[order], np.searchsorted(v[order], np.arange(n))
    total, squares = np.zeros(n), np.zeros(n)
    for s in np.searchsorted(names, sources["s"].to_numpy()):
        far = np.full(n, np.iinfo(np.int64).max // 4)
        far[s] = 0
        while True:
            there = np.minimum.reduceat(far[v], first) + length
            least = np.minimum(far, np.minimum.reduceat(there[group], at))
            if (least == far).all():
                break
            far = least
        into, out = np.flatnonzero(far[v] + length[c] == there[c]), np.flatnonzero(there[c] == far[v])
        (x, a), (b, y) = (v[into], c[into]), (c[out], v[out])
        front = np.zeros(n)
        front[s] = 1.0
        paths = front.copy()
        while (front := np.bincount(y, np.bincount(a, front[x], m)[b], n)).any():
            paths += front
        front, load = 1 / paths, np.zeros(n)
        while (front := np.bincount(x, np.bincount(b, front[y], m)[a], n)).any():
            load += front
        load *= paths
        load[s] = 0.0
        total += load
        squares += load * load
    return pa.table({"v": names, "total": total, "squares": squares})


def _betweenness_wide(vertices: DataFrame, links: DataFrame | None, n: int, exact: int, pivots: int, rows: int, edges: int = LINKS, groups: DataFrame | None = None) -> DataFrame:
    """(v, betweenness, error, pivots) of components of any size, from the paths of some sources.

    Components of up to ``edges`` links, or members if there are groups instead, go to tasks with some of their sources each, larger ones by rounds over (source,
    vertex) rows, some ``rows`` at a time. Sources are the vertices of least hash, all or ``pivots`` of a component; the error is one of a sample without replacement.
    """
    spark = vertices.sparkSession
    ends = saved(vertices.select("label", "v"))
    if groups is not None:
        held = groups.groupBy("label").agg(F.sum(F.size("at")).alias("n"))
        many = saved(held.filter(F.col("n") > edges).select("label"))
        each = groups.join(F.broadcast(many), "label", "left_semi").select("label", "weight", F.posexplode("at").alias("i", "a"), "at")
        links = each.select("label", "a", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("b"), "weight")
    way = links.filter("a <> b").select("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.lit(_UNIT) / F.col("weight")).cast("long").alias("length"))
    way = saved(way.groupBy("label", "a", "b").agg(F.min("length").alias("length")))
    large = saved(way.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > edges).select("label")) if groups is None else many
    placed = saved(numbered(ends, "label", F.xxhash64("v"), "v", name="no"))
    sizes = placed.groupBy("label").agg(F.count("*").alias("size"), F.min("no").alias("first"))
    sizes = saved(sizes.withColumn("k", F.when(F.col("size") <= exact, F.col("size")).otherwise(F.least("size", F.lit(pivots)))))
    sources = placed.join(sizes, "label").filter("no - first < k").join(large.withColumn("large", F.lit(True)), "label", "left")
    sources = saved(sources.select("label", F.col("v").alias("s"), "size", F.coalesce("large", F.lit(False)).alias("large"), F.floor((F.col("no") - F.col("first")) / (SOURCES if groups is None else GROUP_SOURCES)).alias("part")))
    kind = vertices.schema["v"].dataType.simpleString()
    here = sources.filter("not large")
    asked = here.groupBy("label").agg((F.max("part") + 1).alias("parts"))
    whole = way if groups is None else groups
    copies = whole.join(asked.hint("merge"), "label").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *whole.columns)
    schema = f"v {kind}, total double, squares double"
    if groups is None:
        each = copies.groupBy("label", "part").cogroup(here.groupBy("label", "part"))
        loads = [saved(each.applyInPandas(lambda x, y: _dependencies_here(y, x), schema))]
    else:
        some = parts(spark, held.join(asked, "label").agg(F.sum(F.col("n") * F.col("parts"))).first()[0])
        each = copies.repartition(some, "label", "part").groupBy("label", "part").cogroup(here.repartition(some, "label", "part").groupBy("label", "part"))
        loads = [saved(each.applyInArrow(lambda x, y: _dependencies_groups(y, x), schema))]
    wide = way.join(large, "label", "left_semi").select("a", "b", "length")
    wide = wide.union(wide.select("b", "a", "length"))
    both = wide if large.isEmpty() else saved(wide)
    batches = -(-(sources.filter("large").agg(F.sum("size")).first()[0] or 0) // rows)
    for batch in range(batches):
        start = mark()
        part = sources.filter(F.col("large") & (F.pmod(F.xxhash64(F.lit(1), "s"), F.lit(batches)) == batch)).select("s")
        loads.append(saved(_dependencies(part, both)))
        clear(spark, start, but_last=1)
    load = reduce(DataFrame.unionByName, loads)
    load = ends.join(sizes, "label").join(load.groupBy("v").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")), "v", "left").na.fill(0.0, ["total", "squares"])
    spread = F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.col("k"), F.lit(0.0)) / F.greatest(F.col("k") - 1, F.lit(1))
    error = F.col("size") * F.sqrt((1 - F.col("k") / F.col("size")) * spread / F.col("k"))
    scale = F.lit(float(max((n - 1) * (n - 2), 1)))
    return load.select("v", (F.col("total") * F.col("size") / F.col("k") / scale).alias("betweenness"), (error / scale).alias("error"), F.col("k").alias("pivots"))


def betweenness(links: DataFrame, n: int, most: int = vocab.BETWEENNESS_NODES, vertices: DataFrame | None = None, exact: int = EXACT, pivots: int = 256, rows: int = 20_000_000, edges: int = LINKS, labels: DataFrame | None = None, whole: DataFrame | None = None, members: int = MEMBERS) -> DataFrame:
    """Betweenness with distance 1 / weight, over all n vertices: shortest-path counts from each source, summed back.

    Columns: v, betweenness, error, pivots (sources in v's component). Components of up to ``most`` vertices are a task each;
    larger ones of up to ``edges`` links a task for some
    of their sources each, the largest go by rounds over all tasks, ``rows`` (source, vertex) rows at a time. Up to ``exact`` vertices all are sources
    and the error is 0; beyond that ``pivots`` of them are, and the error is the standard error of the estimate, which shrinks
    with the root of the pivots. A vertex that few sources depend on can be further off, but by Hoeffding's bound, but for a
    chance p, by no more than sqrt(ln(2 / p) / (2 pivots)) of the size's pairs. vertices (v) without links have zero. Weights
    are positive. whole: groups as in grouped(), which are steps by themselves; a component of up to ``members`` of them goes
    to tasks for some of its sources each. labels are those of links and whole then, and are needed.
    """
    import heapq

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(rows)
        total = dict.fromkeys(near, 0.0)
        for s in near:
            far, paths, before, order, heap = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)]
            done = set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for w, weight in near[v].items():
                    e = d + 1 / weight
                    if w not in far or e < far[w] - 1e-12:
                        far[w], paths[w], before[w] = e, paths[v], [v]
                        heapq.heappush(heap, (e, w))
                    elif abs(e - far[w]) <= 1e-12 and w not in done:
                        paths[w] += paths[v]
                        before[w].append(v)
            load = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before[w]:
                    load[v] += paths[v] / paths[w] * (1 + load[w])
                if w != s:
                    total[w] += load[w]
        scale = max((n - 1) * (n - 2), 1)
        return pd.DataFrame([(v, x / scale, 0.0, len(total)) for v, x in total.items()], columns=["v", "betweenness", "error", "pivots"])

    kind = links.schema["a"].dataType.simpleString()
    wide = lambda large, rest: _betweenness_wide(large, rest, n, exact, pivots, rows, edges)
    if whole is None:
        found = _by_component(links, run, f"v {kind}, betweenness double, error double, pivots long", most, wide, labels)
    else:
        found = _betweenness_wide(labels, None, n, exact, pivots, rows, members, saved(grouped(links, whole, labels, net=False)))
    return found if vertices is None else vertices.select("v").join(found, "v", "left").na.fill(0.0, ["betweenness", "error"]).na.fill(0, ["pivots"])


def _local_moves(edges: DataFrame, double: float, tolerance: float, patience: int) -> tuple[DataFrame, bool]:
    """(v, com) of the best modularity that rounds of moves reach from single vertices, and whether it beats those.

    edges (a, b, w) go both ways; a loop holds what is inside its vertex, both ways; double is the sum of w. A round offers each
    vertex its neighbours' communities; those whose turn a hash gives move to the best, equal ones to the least. As half of all
    vertices stand still no two can trade places for ever. Rounds end when none wants to move or ``patience`` rounds gain nothing.
    """
    mass = saved(edges.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("loop")))
    others = edges.filter("a <> b")
    home = best = mass.select("v", F.col("v").alias("com"))
    first = top = None
    misses = 0
    for turn in itertools.count():
        now = home.join(mass, "v")
        total = now.groupBy("com").agg(F.sum("k").alias("total"))
        near = others.join(home.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "com", "w").union(home.select("v", "com", F.lit(0.0)))
        offers = near.groupBy("v", "com").agg(F.sum("w").alias("w")).join(now.withColumnRenamed("com", "own"), "v").join(total, "com")
        own = F.col("com") == F.col("own")
        gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0)) / double, 9)
        choice = offers.withColumn("gain", gain).groupBy("v", "own", "k", "loop").agg(
            F.min_by("com", F.struct(-F.col("gain"), "com")).alias("to"), (F.max("gain") > F.max(F.when(own, F.col("gain")))).alias("wants"), F.sum(F.when(own, F.col("w"))).alias("w")
        )
        choice = saved(choice)
        by_home = choice.groupBy("own").agg(F.sum(F.col("w") + F.col("loop")).alias("inside"), F.sum("k").alias("k"), F.max("wants").alias("wants"))
        inside, squares, wants = by_home.agg(F.sum("inside"), F.sum(F.col("k") * F.col("k")), F.max("wants")).first()
        quality = inside / double - squares / double**2
        first = quality if first is None else first
        misses = 0 if top is None or quality > top + tolerance else misses + 1
        if top is None or quality > top:
            best, top = home, quality
        if not wants or misses > patience:
            return best, top > first
        moves = F.col("wants") & (F.pmod(F.xxhash64(F.lit(turn), "v"), F.lit(2)) == 0)
        home = choice.select("v", F.when(moves, F.col("to")).otherwise(F.col("own")).alias("com"))


def _moves_here(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, double: float, tolerance: float, patience: int, start: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """_local_moves() over links between places, of one component, from a start; its quality is its part of the whole graph's."""
    mass, own_loop = np.bincount(a, w, n), w[a == b].sum()
    x, y, w = a[a != b], b[a != b], w[a != b]
    every = np.arange(n)
    home = best = every if start is None else start
    first = top = None
    misses = 0
    for turn in itertools.count():
        whole = np.bincount(home, mass, n)
        key, at = np.unique(np.concatenate([x * n + home[y], every * n + home]), return_inverse=True)
        v, com = key // n, key % n
        to_com = np.bincount(at, np.concatenate([w, np.zeros(n)]), len(key))
        own = com == home[v]
        gain = np.round(to_com - mass[v] * (whole[com] - np.where(own, mass[v], 0.0)) / double, 9)
        starts = np.searchsorted(v, every)
        most = np.maximum.reduceat(gain, starts)
        goes = np.flatnonzero(gain == most[v])
        goes = com[goes[np.searchsorted(v[goes], every)]]  # of equal ones the least
        wants = most > gain[own]
        quality = (to_com[own].sum() + own_loop) / double - (whole * whole).sum() / double**2
        first = quality if first is None else first
        misses = 0 if top is None or quality > top + tolerance else misses + 1
        if top is None or quality > top:
            best, top = home, quality
        if not wants.any() or misses > patience:
            return best, top > first
        home = np.where(wants & _turn(every, turn, n), goes, home)


#: Offers that _moves_groups() looks at together.
OFFERS = 5_000_000


def _moves_groups(c: np.ndarray, v: np.ndarray, sizes: np.ndarray, w: np.ndarray, n: int, double: float, tolerance: float, patience: int, start: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """_moves_here() over groups: what a group offers are its communities with their members, and vertices choose some at a time."""
    order = np.argsort(v, kind="stable")
    group, vertex = c[order], v[order]
    each, at = w[group], np.searchsorted(vertex, np.arange(n + 1))
    mass = np.bincount(vertex, each * (sizes[group] - 1), n)
    every = np.arange(n)
    home = best = every if start is None else start
    first = top = None
    misses = 0
    for turn in itertools.count():
        whole = np.bincount(home, mass, n)
        key, count = np.unique(c * n + home[v], return_counts=True)
        offered, begins = key % n, np.searchsorted(key, np.arange(len(sizes) + 1) * n)
        offers = np.diff(begins)[group]
        stops = np.cumsum(offers)[at[1:] - 1]  # of each vertex
        goes, wants, inside, low = np.empty(n, np.int64), np.empty(n, bool), 0.0, 0
        while low < n:
            high = max(low + 1, np.searchsorted(stops, (stops[low - 1] if low else 0) + OFFERS, "right"))
            here = slice(at[low], at[high])
            many = offers[here]
            which = np.arange(many.sum()) + np.repeat(begins[group[here]] - (np.cumsum(many) - many), many)
            x, com = np.repeat(vertex[here], many), offered[which]
            amount = np.repeat(each[here], many) * (count[which] - (com == home[x]))
            key, back = np.unique((x - low) * n + com, return_inverse=True)
            x, com, to_com = key // n, key % n, np.bincount(back, amount)
            own, mine = com == home[x + low], mass[x + low]
            gain = np.round(to_com - mine * (whole[com] - np.where(own, mine, 0.0)) / double, 9)
            span = np.arange(high - low)
            most = np.maximum.reduceat(gain, np.searchsorted(x, span))
            goal = np.flatnonzero(gain == most[x])
            goes[low:high] = com[goal[np.searchsorted(x[goal], span)]]  # of equal ones the least
            wants[low:high] = most > gain[own]
            inside += to_com[own].sum()
            low = high
        quality = inside / double - (whole * whole).sum() / double**2
        first = quality if first is None else first
        misses = 0 if top is None or quality > top + tolerance else misses + 1
        if top is None or quality > top:
            best, top = home, quality
        if not wants.any() or misses > patience:
            return best, top > first
        home = np.where(wants & _turn(every, turn, n), goes, home)


def _turn(every: np.ndarray, turn: int, n: int) -> np.ndarray:
    mix = (every.astype(np.uint64) + np.uint64(turn * n + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mix = (mix ^ (mix >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mix >> np.uint64(40)) & np.uint64(1) == 0


def _climbed(moves, merged, double: float, tolerance: float, patience: int) -> np.ndarray:  # noqa: ANN001
    """The community of each place: moves and contraction until none gains, then moves of single vertices again, and so on.

    moves: of single vertices from a start; merged: the links (x, y, weight) of communities.
    """
    of, better = None, True
    while better:
        home, better = moves(of)
        if not better:
            return home if of is None else of
        of = np.unique(home, return_inverse=True)[1]
        x, y, z, more = *merged(of), True
        while more:
            size = of.max() + 1
            key, at = np.unique(x * size + y, return_inverse=True)
            x, y, z = key // size, key % size, np.bincount(at, z)
            home, more = _moves_here(x, y, z, size, double, tolerance, patience)
            if more:
                home = np.unique(home, return_inverse=True)[1]
                x, y, of = home[x], home[y], home[of]
    return of


def _communities_here(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, double: float, tolerance: float, patience: int) -> np.ndarray:
    return _climbed(lambda of: _moves_here(a, b, w, n, double, tolerance, patience, of), lambda of: (of[a], of[b], w), double, tolerance, patience)


def _communities_groups(c: np.ndarray, v: np.ndarray, sizes: np.ndarray, w: np.ndarray, n: int, double: float, tolerance: float, patience: int) -> np.ndarray:
    def merged(of: np.ndarray) -> tuple[np.ndarray, ...]:
        size = of.max() + 1
        key, count = np.unique(c * size + of[v], return_counts=True)
        group, com = key // size, key % size
        begins = np.searchsorted(group, np.arange(len(sizes) + 1))
        many = np.diff(begins)[group]
        one = np.repeat(np.arange(len(key)), many)
        two = np.arange(len(one)) + np.repeat(begins[group] - (np.cumsum(many) - many), many)
        return com[one], com[two], w[group[one]] * count[one] * (count[two] - (one == two))

    return _climbed(lambda of: _moves_groups(c, v, sizes, w, n, double, tolerance, patience, of), merged, double, tolerance, patience)


def communities(links: DataFrame, tolerance: float = 1e-5, patience: int = 5, labels: DataFrame | None = None, most: int | None = None, whole: DataFrame | None = None) -> DataFrame:
    """(v, community): local moves by modularity gain, communities contracted, until none gains; names are least vertices.

    A move gains by the whole graph's modularity, whose only other parts are constant, so components don't depend on each
    other: one of up to LINKS links (or ``most`` vertices) is a task's, larger ones go by joins over all tasks. No round that
    lowers modularity stays. Equality with another library's partition is not promised. whole: groups as in grouped(), which a
    task doesn't expand; with them a component of up to MEMBERS (or ``most``) members is a task's. labels are those of links
    and whole then, and are needed.
    """
    kind = links.schema["a"].dataType.simpleString()
    if whole is None:
        links = saved(links.select("a", "b", "weight"))
        double = 2 * (links.agg(F.sum("weight")).first()[0] or 0.0)
    else:
        rows = saved(grouped(links, whole, labels, net=True))
        double = rows.agg(F.sum(F.col("weight") * F.size("at") * (F.size("at") - 1))).first()[0] or 0.0

    def named(names: np.ndarray, of: np.ndarray) -> dict:
        first = np.full(len(names), len(names))
        np.minimum.at(first, of, np.arange(len(names)))
        return {"v": names, "community": names[first[of]]}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, names = _places(rows)
        w = np.tile(rows["weight"].to_numpy(float), 2)
        return pd.DataFrame(named(names, _communities_here(np.concatenate([a, b]), np.concatenate([b, a]), w, len(names), double, tolerance * w.sum() / double, patience)))

    def run_groups(table: pa.Table) -> pa.Table:
        names, c, v, sizes, w = _held(table)
        return pa.table(named(names, _communities_groups(c, v, sizes, w, len(names), double, tolerance * (w * sizes * (sizes - 1)).sum() / double, patience)))

    schema = f"v {kind}, community {kind}"
    if whole is None:
        return _by_component(links, run, schema, most, lambda _, rest: _communities_wide(rest, double, tolerance, patience), labels)
    found, large, more = _by_group(rows, run_groups, schema, MEMBERS if most is None else most)
    if not more:
        return found
    each = large.select("weight", F.posexplode("at").alias("i", "a"), "at").select("a", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("b"), "weight")
    return found.union(_communities_wide(each, double, tolerance, patience))


def _communities_wide(links: DataFrame, double: float, tolerance: float, patience: int) -> DataFrame:
    """communities() of components of any size: all is joins and aggregates over the links of the level."""
    plain = links.select("a", "b", F.col("weight").alias("w"))
    edges = saved(plain.union(plain.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    of = saved(edges.select(F.col("a").alias("v"), F.col("a").alias("com")).distinct())
    better = bool(double)
    while better:
        start = mark()
        home, better = _local_moves(edges, double, tolerance, patience)
        if better:
            one, two = home.toDF("a", "x"), home.toDF("b", "y")
            joined = edges.join(one, "a").join(two, "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))
            edges, of = saved(joined), saved(of.join(home.toDF("com", "new"), "com").select("v", F.col("new").alias("com")))
        clear(links.sparkSession, start, but_last=2 * better)
    names = of.groupBy("com").agg(F.min("v").alias("community"))
    return of.join(names, "com").select("v", "community")


def adamic_adar(pairs: DataFrame, known: DataFrame, top: int = vocab.TOP_CANDIDATES) -> DataFrame:
    """Structural candidates: pairs that share identifiers and have no link yet, by the sum of 1 / ln(reports)."""
    s = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti").groupBy("a", "b").agg(F.round(F.sum(1 / F.log(F.greatest(F.col("df"), F.lit(2)).cast("double"))), 4).alias("score"), F.count("*").alias("shared"))
    return s.orderBy(F.desc("score"), "a", "b").limit(top)


def paths(edges: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """Shortest provenance paths from start (v) along edges (src, dst): v, node, hops and the least path as text."""
    seen = saved(start.select("v", F.col("v").alias("node"), F.lit(0).alias("hops"), F.col("v").alias("path")))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("v", F.col("dst").alias("node"), F.concat_ws(" > ", "path", "dst").alias("path"))
        new = step.groupBy("v", "node").agg(F.min("path").alias("path")).join(seen.select("v", "node"), ["v", "node"], "left_anti")
        front = saved(new.select("v", "node", F.lit(hop).alias("hops"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
