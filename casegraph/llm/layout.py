"""Rows laid out along a Z-order curve over four columns, and a hierarchical min-max zone map that answers box queries.

Coordinates are equal-depth cuts of each column (64 cut values in all are known to the driver). The curve has 16 ** 4 cells,
so there are at most 65,536 distinct queries, whatever the number of rows. Files are runs of the sorted rows; a tree over
consecutive files holds the least and greatest coordinate of each node. All distinct queries descend it together, a level a
join: a node apart from the query is dropped, one inside it adds all of its files, any other passes the query to its
children; at a file the list of its cells decides whether one of its rows matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.operators.storage import numbered

from .common import materialize, with_columns_as

DIMS = ("source", "lang", "length", "date")
#: Binary digits of a coordinate, cuts of a column, days.
BITS, CUTS, DAYS = 4, 16, 365
#: Children of a node, as a power of two; rows that a file holds; keys that a level of the tree is dealt by at least.
FAN_BITS, FILE_ROWS, SPREAD = 3, 1000, 2048
#: How far a query reaches on each side.
REACH = (0, 0, 2, 2)


def values(df: DataFrame) -> DataFrame:
    """doc_id, source, lang, length (bytes of text, -1 for null), date of each row."""
    d = with_columns_as(df, doc_id="long", text="string", source="string", lang="string")
    date = F.crc32(F.col("doc_id").cast("string").cast("binary")) % DAYS
    return d.select("doc_id", "source", "lang", F.coalesce(F.octet_length("text").cast("long"), F.lit(-1).cast("long")).alias("length"), date.alias("date"))


def cuts(rows: DataFrame, n: int) -> dict[str, list[tuple[int, str | int]]]:
    """For each column the coordinates above 0 in use with their least values.

    A coordinate is floor(CUTS * s / n), s being the rows with a smaller value. Rows fold to counts of distinct values first;
    those are sorted over the tasks, and sums of the sorted parts (a row for each part and column) give what lies before.
    """
    of = lambda k, text, number: F.struct(F.lit(k).alias("dim"), text.cast("string").alias("text"), number.cast("long").alias("number"))
    none = F.lit(None)
    pieces = rows.select(F.explode(F.array(of(0, F.col("source"), none), of(1, F.col("lang"), none), of(2, none, F.col("length")), of(3, none, F.col("date")))).alias("p")).select("p.*")
    counts = pieces.groupBy("dim", "text", "number").agg(F.count("*").alias("n"))
    order = materialize(counts.orderBy("dim", "text", "number").withColumn("at", F.monotonically_increasing_id()), "values").withColumn("part", F.shiftright("at", 33))
    sizes = order.groupBy("dim", "part").agg(F.sum("n").alias("m"))
    before = sizes.select("dim", "part", (F.sum("m").over(Window.partitionBy("dim").orderBy("part")) - F.col("m")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("dim", "part").orderBy("at")) - F.col("n")
    smaller = order.withColumn("inside", inside).join(before, ["dim", "part"]).withColumn("at_cut", F.expr(f"{CUTS} * (before + inside) div {n}"))
    least = smaller.groupBy("dim", "at_cut").agg(F.min_by(F.struct("text", "number"), "at").alias("v")).filter("at_cut > 0")
    out: dict[str, list] = {d: [] for d in DIMS}
    for r in least.select("dim", "at_cut", "v.*").collect():  # CUTS - 1 rows for each column at most
        out[DIMS[r["dim"]]].append((int(r["at_cut"]), r["text"] if r["dim"] < 2 else r["number"]))
    return out


def coordinate(column: str, found: list[tuple[int, str | int]]) -> Column:
    """The coordinate of a value, null being the smallest."""
    out = F.lit(0)
    for k, least in sorted(found, key=lambda x: x[0]):
        out = F.when(F.col(column) >= F.lit(least), k).otherwise(out)
    return out


def interleaved(coords: list[Column]) -> Column:
    """The digits of the coordinates, highest first, in turn."""
    out = F.lit(0).cast("long")
    for b in range(BITS - 1, -1, -1):
        for c in coords:
            out = out * 2 + F.shiftright(c, b).bitwiseAND(F.lit(1))
    return out


def taken(z: Column, dim: int) -> Column:
    """The coordinate of a column that z holds."""
    k = len(DIMS)
    return reduce(lambda acc, b: acc * 2 + F.shiftright(z, b * k + k - 1 - dim).bitwiseAND(F.lit(1)).cast("int"), range(BITS - 1, -1, -1), F.lit(0))


def tree(cells: DataFrame, files: int) -> list[DataFrame]:
    """Levels of the zone map from files (with the list of their cells) up to one root: node, files, lo0, hi0, ..."""
    ends = [f(taken(F.col("z"), d)).alias(f"{n}{d}") for d in range(len(DIMS)) for n, f in (("lo", F.min), ("hi", F.max))]
    levels = [materialize(cells.groupBy(F.col("file").alias("node")).agg(F.lit(1).cast("long").alias("files"), F.collect_set("z").alias("cells"), *ends), "files")]
    while files > 1:
        files = (files - 1 >> FAN_BITS) + 1
        up = [f(f"{n}{d}").alias(f"{n}{d}") for d in range(len(DIMS)) for n, f in (("lo", F.min), ("hi", F.max))]
        levels.append(materialize(levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("files").alias("files"), *up), "level"))
    return levels


def answers(cells: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """(z, touched, matching) of each distinct query, which its cell z stands for, and the files' bounds."""
    levels = tree(cells, files)
    box = [(taken(F.col("q"), d) - r, taken(F.col("q"), d) + r) for d, r in enumerate(REACH)]
    meets = reduce(Column.__and__, [(F.col(f"lo{d}") <= hi) & (F.col(f"hi{d}") >= lo) for d, (lo, hi) in enumerate(box)])
    within = reduce(Column.__and__, [(F.col(f"lo{d}") >= lo) & (F.col(f"hi{d}") <= hi) for d, (lo, hi) in enumerate(box)])
    holds = lambda z: reduce(Column.__and__, [taken(z, d).between(lo, hi) for d, (lo, hi) in enumerate(box)])
    front = cells.select(F.col("z").alias("q")).distinct().withColumn("node", F.lit(0).cast("long"))
    found = []
    for k in range(len(levels) - 1, -1, -1):
        # Few nodes meet all queries, so a level with few nodes is dealt by hashes of queries too.
        salts = max(1, SPREAD // ((files - 1 >> FAN_BITS * k) + 1))
        nodes = levels[k].withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = front.withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int")).join(nodes.hint("merge"), ["node", "salt"]).filter(meets).withColumn("within", within)
        if k:
            met = materialize(met.select("q", "node", "files", "within"), "met")
            front = met.filter("not within").select("q", F.explode(F.sequence(F.shiftleft("node", FAN_BITS), F.shiftleft("node", FAN_BITS) + (1 << FAN_BITS) - 1)).alias("node")).filter(F.col("node") <= files - 1 >> FAN_BITS * (k - 1))
            found.append(met.filter("within").select("q", F.col("files").alias("touched"), F.col("files").alias("matching")))
        else:
            found.append(met.select("q", F.lit(1).cast("long").alias("touched"), (F.col("within") | F.exists("cells", holds)).cast("long").alias("matching")))
    told = reduce(DataFrame.unionByName, found).groupBy(F.col("q").alias("z")).agg(F.sum("touched").alias("touched"), F.sum("matching").alias("matching"))
    return told, levels[0]


def layout(df: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """doc_id, z, position, file, files_touched, files_matching, file_bounds of each row.

    Null is the smallest value of its column; a null text has length -1, a null doc_id no date. Equal values share a
    coordinate, however many; rows of equal z and doc_id (rows that repeat) take their positions in any order, which changes
    no result. An empty table gives no rows. Texts are only measured, so any length is fine; extra columns are not read.
    """
    rows = materialize(values(df), "rows")
    n = rows.count()
    found = cuts(rows, n) if n else {d: [] for d in DIMS}
    z = interleaved([coordinate(d, found[d]) for d in DIMS])
    placed = numbered(rows.select("doc_id", z.alias("z")), "z", "doc_id", name="number").select("doc_id", "z", (F.col("number") - 1).cast("long").alias("position"))
    placed = materialize(placed.withColumn("file", F.floor(F.col("position") / file_rows).cast("long")), "placed")
    cells = materialize(placed.groupBy("file", "z").agg(F.count("*").alias("rows")), "cells")
    told, bounds = answers(cells, max(1, -(-n // file_rows)))
    text = F.concat_ws(",", *[F.col(f"{e}{d}").cast("string") for d in range(len(DIMS)) for e in ("lo", "hi")])
    # Facts of a cell of a file first (a file has file_rows cells at most), so that rows are dealt once and evenly.
    # Tables that grow with the rows are merged, not broadcast, however small they are.
    facts = cells.select("file", "z").join(told.hint("merge"), "z").join(bounds.select(F.col("node").alias("file"), text.alias("file_bounds")).hint("merge"), "file")
    return placed.join(facts.hint("merge"), ["file", "z"]).select("doc_id", "z", "position", "file", F.col("touched").alias("files_touched"), F.col("matching").alias("files_matching"), "file_bounds")


SQL = r"""
WITH v AS (SELECT doc_id, encode(source) AS s, encode(lang) AS l, coalesce(octet_length(encode(text)), -1) AS n,
 xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
     lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 365 AS d FROM documents),
c AS (SELECT doc_id, (16 * (rank() OVER (ORDER BY s NULLS FIRST) - 1) // count(*) OVER ())::BIGINT AS cs, (16 * (rank() OVER (ORDER BY l NULLS FIRST) - 1) // count(*) OVER ())::BIGINT AS cl,
      (16 * (rank() OVER (ORDER BY n) - 1) // count(*) OVER ())::BIGINT AS cn, (16 * (rank() OVER (ORDER BY d NULLS FIRST) - 1) // count(*) OVER ())::BIGINT AS cd FROM v),
z AS (SELECT *, list_reduce(list_concat([0::BIGINT], flatten([[cs >> b & 1, cl >> b & 1, cn >> b & 1, cd >> b & 1] FOR b IN [3, 2, 1, 0]])), lambda x, y: 2 * x + y) AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM z),
f AS (SELECT *, position // 1000 AS file FROM p),
b AS (SELECT file, min(cs) AS s0, max(cs) AS s1, min(cl) AS l0, max(cl) AS l1, min(cn) AS n0, max(cn) AS n1, min(cd) AS d0, max(cd) AS d1 FROM f GROUP BY file),
q AS (SELECT DISTINCT z, cs, cl, cn, cd FROM f),
t AS (SELECT q.z, count(*) AS touched FROM q JOIN b ON cs BETWEEN s0 AND s1 AND cl BETWEEN l0 AND l1 AND cn + 2 >= n0 AND cn - 2 <= n1 AND cd + 2 >= d0 AND cd - 2 <= d1 GROUP BY q.z),
m AS (SELECT q.z, count(DISTINCT f.file) AS matching FROM q JOIN f ON f.cs = q.cs AND f.cl = q.cl AND abs(f.cn - q.cn) <= 2 AND abs(f.cd - q.cd) <= 2 GROUP BY q.z)
SELECT doc_id, z, position, file, touched AS files_touched, matching AS files_matching, concat_ws(',', s0, s1, l0, l1, n0, n1, d0, d1) AS file_bounds
FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)
"""
