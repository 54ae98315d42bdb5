"""Interaction audit of document filters by subset-zeta transforms.

Each document gets a mask of the filters it fails. A part's counts by mask become, by one zeta transform (five steps over 32
counts), the documents that fail nothing outside each subset, hence the survivors of every subset of filters. All that an
order of filters does, step by step, are differences between neighbouring subsets; documents are read once for all orders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns_as

LETTERS = "ABCDE"
N = len(LETTERS)
FULL = (1 << N) - 1
#: Bytes of text that are split into words at once.
SLICE_BYTES = 1 << 20
_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def own_mask(raw: bytes, points: int) -> int:
    """The failed conditions A to D of one text as bits, A lowest; words are taken slice by slice, each cut at a blank."""
    words, seen, at = 0, set(), 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + SLICE_BYTES)
        end = gap.start() if gap else len(raw)
        found = raw[at:end].split()  # bytes split at exactly the blanks that separate words
        words += len(found)
        seen.update(found)
        at = end + 1
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return (words < 50) | (100 * len(seen) < 65 * words) << 1 | (100 * upper > 5 * points) << 2 | marked << 3


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and mask (A to D) of each row of doc_id, text, part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, mask = [], []
            for t in b.column("text"):
                text = t.as_py()
                raw = text.encode()
                digest.append(hashlib.sha256(raw).digest())
                mask.append(own_mask(raw, len(text)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(digest, pa.binary()), pa.array(mask, pa.int32())], ["doc_id", "part", "digest", "mask"])

    return docs.select("doc_id", "part", "text").mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic: documents of each part by the filters they fail.

    Equal texts meet by digest only to find their least id, which folds in each task; that one row goes back to the rows by
    digest and id together, so a text in any share of all rows never gathers in one task.
    """
    rows = with_columns_as(docs, doc_id="long", text="string", source="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    # Rows that repeat fold here; E depends on id and text alone.
    known = materialize(masks(rows).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks")
    first = known.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    given = with_columns_as(labels, doc_id="long", quality="long", toxic="long").filter("doc_id is not null and (quality = 1 or toxic = 1)")
    given = given.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    told = known.join(given, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    marked = told.withColumn("mask", F.col("mask") + F.when(copy, 1 << 4).otherwise(0))
    share = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("m"), share("good"), share("toxic")).withColumnRenamed("m", "n")


def zeta(sums: DataFrame, *columns: str) -> DataFrame:
    """Each array of counts by mask as sums over all subsets of the mask: a pass for each bit.

    A projection for each pass, so that no expression is repeated inside itself.
    """

    def added(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, i: x + F.when(F.shiftright(i, bit) % 2 == 1, F.get(F.col(c), i - F.lit(1 << bit))).otherwise(0))

    for bit in range(N):
        sums = sums.withColumns({c: added(c, bit) for c in columns})
    return sums


def shapley(k: int) -> Column:
    """Removals by the filter of bit k, summed over all orders: each subset without it counts as often as orders begin with it."""
    weigh = lambda s: factorial(s.bit_count()) * factorial(N - 1 - s.bit_count())
    return sum((weigh(s) * (left("n", F.lit(s)) - left("n", F.lit(s | 1 << k))) for s in range(FULL + 1) if not s >> k & 1), F.lit(0).cast("long"))


def left(count: str, gone: Column) -> Column:
    """Survivors of a subset of filters: what fails within its complement only."""
    return F.get(F.col(count), F.lit(FULL) - gone)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty, a null source is the part of the empty string. A row with null doc_id has no smaller one and
    is smaller than none, so E never fails it and it makes no other row fail; no label belongs to it. Rows that repeat are documents of their own (of
    equal ids none is smaller); a document with several labels is good or toxic if one says so. An empty table gives no
    rows; texts of any length are read in slices; extra columns are not read.
    """
    by_part = counted(docs, labels).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))  # 32 masks at most
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(FULL)), lambda i: F.coalesce(F.try_element_at("m", i)[c], F.lit(0).cast("long")))
    sums = by_part.select("part", at("n").alias("n"), at("good").alias("good"), at("toxic").alias("toxic"))
    sums = materialize(zeta(sums, "n", "good", "toxic"), "zeta")  # a row for each part
    # All orders and steps of a part are rows made from its 32 sums.
    orders = F.split(F.lit(",".join(map("".join, permutations(LETTERS)))), ",")
    rows = sums.withColumn("worth", F.array(*map(shapley, range(N)))).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(N))))
    place = lambda i: F.instr(F.lit(LETTERS), F.substring("filter_order", i, 1)) - 1
    bit_of = lambda i: F.call_function("shiftleft", F.lit(1), place(i))
    before = sum((F.when(F.col("step") > i, bit_of(i)).otherwise(0) for i in range(1, N)), F.lit(0))
    k = F.get(F.array(*[place(i) for i in range(1, N + 1)]), F.col("step") - 1)
    rows = rows.withColumn("before", before).withColumn("k", k).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("k")))
    here, then, total = F.col("before"), F.col("before") + F.col("bit"), left("n", F.lit(0))
    removed = left("n", here) - left("n", then)
    lost = lambda c: (left(c, here) - left(c, then)).alias(f"{c}_lost")
    fails = total - left("n", F.col("bit"))
    only = F.get(F.col("n"), F.col("bit")) - F.get(F.col("n"), F.lit(0))
    return rows.select("part", "filter_order", "step", left("n", then).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), only.alias("unique_fails"), lost("good"), lost("toxic"), F.get("worth", F.col("k")).alias("shapley"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s::INT AS s, o[s:s] AS x, string_split(o[1:s - 1], '') AS before FROM orders, generate_series(1, 5) g(s)),
each AS (SELECT part, o, s, x, good, toxic, fails[x] AS here, len(list_filter(before, lambda y: y <> '' AND coalesce(fails[y], false))) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: fails[y])) AS n FROM f, steps),
rows_ AS (SELECT part, o, s, x, count(*) FILTER (NOT gone AND NOT here) AS kept, count(*) FILTER (NOT gone AND here) AS removed, count(*) FILTER (gone AND here) AS redundant,
         count(*) FILTER (here AND n = 1) AS unique_fails, count(*) FILTER (NOT gone AND here AND good) AS good_lost, count(*) FILTER (NOT gone AND here AND toxic) AS toxic_lost FROM each GROUP BY ALL)
SELECT part, o AS filter_order, s AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM rows_
"""
