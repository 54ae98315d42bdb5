"""Line dedup by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_of

#: Lines of a window.
WIDTH = 3


def _hashes(lines: str) -> Column:
    """Two independent 64-bit hashes of each line, and whether it holds a word."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("p"), F.xxhash64(F.lit("second"), x).alias("q"), x.rlike(r"[^\x20\x09-\x0D]").alias("w")))


def dedup_lines(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """A row of df (a struct of all but its text), n_lines, n_removed and text (without removed lines) each, and the fields.

    Lines end at ``\\n``. A window is three consecutive lines of a document, one of them with a word. Of equal windows
    the first in order of doc_id, then hash of the text, then position stays; the lines of every later one go, also where
    windows overlap in one document. Documents of under three lines are whole. Null text stays null with no lines; rows
    that repeat both doc_id and text count as one document and all get its result. A null doc_id sorts first. An empty
    table gives no rows, a very long text is lines like any other, and extra columns pass, whatever their names.
    """
    ids = df.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.split(F.col("text").cast("string"), "\n", -1).alias("all")).filter(F.size("all") >= WIDTH)
    hashed = ids.select("doc", "tie", _hashes("all").alias("h"))
    count = F.size("h") - WIDTH + 1
    part = lambda k: F.slice("h", F.lit(k + 1), count)
    joined = F.arrays_zip(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))
    window = F.transform(joined, lambda z: F.when(z["a"]["w"] | z["b"]["w"] | z["c"]["w"], F.struct(F.xxhash64(z["a"]["p"], z["b"]["p"], z["c"]["p"]).alias("p"), F.xxhash64(z["a"]["q"], z["b"]["q"], z["c"]["q"]).alias("q"))))
    exploded = hashed.select("doc", "tie", F.posexplode(window).alias("at", "w")).filter("w is not null").select("doc", "tie", "at", "w.p", "w.q")
    spots = materialize(exploded, "windows")
    place = F.struct("doc", "tie", "at")
    first = spots.groupBy("p", "q").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("p", "q", "first")
    later = spots.join(first, ["p", "q"]).filter(place > F.col("first"))
    starts = later.groupBy("doc", "tie").agg(F.sort_array(F.collect_set("at")).alias("at"))
    row, field = row_of(df, ("text",))
    base = df.select(row, df["doc_id"].cast("long").alias("id"), F.xxhash64(df["text"].cast("string")).alias("hash"), df["text"].cast("string").alias("old"))
    both = base.join(starts, base["id"].eqNullSafe(starts["doc"]) & (base["hash"] == starts["tie"]), "left")
    lines = F.split("old", "\n", -1)
    # Merging covered positions: what stays are the gaps between a window's end and the next window's start.
    split = both.withColumn("lines", F.when(F.col("at").isNotNull(), lines)).withColumn("edges", F.concat(F.array(F.lit(-WIDTH)), "at", F.array(F.size("lines"))))
    gaps = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: F.struct((a + WIDTH).alias("lo"), (b - a - WIDTH).alias("n")))
    kept = split.withColumn("gaps", F.filter(gaps, lambda g: g["n"] > 0)).withColumn("kept", F.flatten(F.transform("gaps", lambda g: F.slice(F.col("lines"), g["lo"] + 1, g["n"]))))
    return kept.select(
        "row",
        F.when(F.col("old").isNull(), 0).otherwise(F.coalesce(F.size("lines"), F.size(lines))).cast("long").alias("n_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("at").isNull(), F.col("old")).otherwise(F.array_join("kept", "\n")).alias("text"),
    ), field


def result(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of each row."""
    out, field = dedup_lines(df.select("doc_id", "text"))
    return out.select(F.col("row")[field["doc_id"]].alias("doc_id"), "n_lines", "n_removed", "text")


def stage(df: DataFrame) -> DataFrame:
    """df with its texts and n_chars after line dedup; a document goes if lines were removed and no word is left."""
    out, field = dedup_lines(df)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    old = lambda c: F.col("row")[field[c]]
    length = lambda c: F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(old(c))
    return out.select(*[(F.col("text") if c == "text" else length(c) if c == "n_chars" else old(c)).alias(c) for c in df.columns])


SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
spots AS (SELECT doc_id, text, l, unnest(generate_series(1, len(l) - 2)) AS pos FROM docs WHERE len(l) >= 3),
windows AS (SELECT doc_id, text, pos, l[pos:pos + 2] AS w FROM spots
            WHERE regexp_matches(l[pos] || l[pos + 1] || l[pos + 2], '[^\x20\x09-\x0D]')),
ranked AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, pos) AS r FROM windows),
covered AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS i FROM ranked WHERE r > 1),
gone AS (SELECT doc_id, text, list(i) AS g FROM covered GROUP BY ALL)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
       CASE WHEN g IS NULL THEN d.text
            ELSE array_to_string([d.l[i] FOR i IN generate_series(1, len(d.l)) IF NOT list_contains(g, i)], chr(10)) END AS text
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) d LEFT JOIN gone USING (doc_id, text)
"""
