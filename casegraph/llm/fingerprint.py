"""Canonical exact digests of documents.

A text is normalised (NFKC), case-folded and has its white space folded; its wide xxhash is the bucket. Buckets with more
than one document compare the canonical bytes themselves: only if some differ do classes of one bucket get numbers.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_columns_as

#: Slots of the map of suspect digests: a broadcast of SLOTS / 8 bytes whatever the input; more suspects only make
#: more texts take part in the comparison.
SLOTS = 1 << 23
#: Documents of an id range, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1_000, 100_000
LEAST_ID = -(1 << 63)


def canonical(text: str) -> str:
    """NFKC, full case folding (then NFKC again, as folding can undo it), white-space runs as one blank, ends stripped."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digest(text: str, bits: int = 128) -> str:
    """xxh3-128 of the canonical text in UTF-8; fewer bits only serve to test the comparison."""
    return f"{xxhash.xxh3_128_intdigest(canonical(text).encode()) >> (128 - bits):0{(bits + 3) // 4}x}"


def edit(text: str, other: str) -> str:
    """The last half (rounded down) of text replaced by as many of the first code points of other, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(df: DataFrame, bits: int = 128) -> DataFrame:
    """Digests of each text and of its edit with the next document (descending doc_id; the first follows the last).

    Ids are cut into ranges at quantiles that are themselves ids; a range's greatest id also goes to the range above as
    its guest, so each range finds its neighbours without the others. A null doc_id sorts below all; documents of one
    doc_id sort by the digest of their text.
    """
    spark = df.sparkSession
    docs = with_columns_as(df, doc_id="long", text="string")
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    stats = docs.select(key.alias("k")).agg(F.count("*").alias("n"), F.max("k").alias("top"), F.min("k").alias("low")).first()
    ranges = max(1, min(MOST_RANGES, stats["n"] // RANGE_ROWS))
    cuts = docs.select(key.cast("double").alias("k")).stat.approxQuantile("k", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    # Doubles of huge ids are inexact: a cut must be an id that exists, so the greatest id of each range is looked up.
    cuts = np.unique(np.array(cuts, np.float64))
    at = F.lit(0)
    if len(cuts):
        shared = spark.sparkContext.broadcast(cuts)

        @F.pandas_udf("int")
        def at_range(k):  # noqa: ANN001, ANN202
            return k.map(lambda x: 0) if not len(shared.value) else k.__class__(np.searchsorted(shared.value, k.to_numpy(np.float64), side="left").astype("int32"))

        at = at_range(key.cast("double"))
    tops = dict(docs.select(key.alias("k"), at.alias("r")).groupBy("r").agg(F.max("k").alias("m")).collect()) if stats["n"] else {}
    used = sorted(tops)
    above = {tops[r]: i for i, r in enumerate(used, 1)}  # the greatest id of a range is a guest of the next one that has rows
    above[stats["top"]] = 0  # and the greatest of all of the lowest one
    place = {r: i for i, r in enumerate(used)}
    top = spark.sparkContext.broadcast((cuts, place, above))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, place, above = top.value
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            keys = np.array([LEAST_ID if i is None else i for i in ids], np.int64)
            spot = [place[int(r)] for r in np.searchsorted(cuts, keys.astype(np.float64), side="left")]
            rows: list[tuple] = []
            for i, k, r, t in zip(ids, keys.tolist(), spot, b.column("text").to_pylist(), strict=True):
                raw = (t or "").encode()
                row = (i, xxhash.xxh3_64_intdigest(raw) >> 1, press.compress(raw))
                rows.append((r, False, -k - 1, *row))
                if k in above:
                    rows.append((above[k], True, -k - 1, *row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "guest", "desc", "doc_id", "tie", "packed"])

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        last = None  # (range, doc_id, text, canonical form, digest) that waits for its next one
        for b in batches:
            out: list[tuple] = []
            for r, guest, i, z in zip(*(b.column(c).to_pylist() for c in ("range", "guest", "doc_id", "packed")), strict=True):
                if guest and (last is None or last[0] != r):
                    continue  # a further document of the guest's id
                text = press.decompress(z).decode()
                form = canonical(text)
                own = digest(text, bits)
                if last is not None and last[0] == r:
                    out.append(finish(last, text, form, own))
                last = None if guest else (r, i, text, form, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next"])

    def finish(last: tuple, text: str, form: str, own: str) -> tuple:
        _, i, mine, my_form, my_digest = last
        edited = edit(mine, text)
        its = digest(edited, bits)
        near_edited = float(its == my_digest and canonical(edited) == my_form)
        return i, len(mine), hashlib.sha256(edited.encode()).hexdigest(), my_digest, its, near_edited, float(own == my_digest and form == my_form)

    dealt = docs.mapInArrow(deal, "range int, guest boolean, desc long, doc_id long, tie long, packed binary")
    return (
        dealt.repartition("range").sortWithinPartitions("range", "guest", "desc", "tie")
        .select("range", "guest", "doc_id", "packed")
        .mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double")
    )


def collisions(df: DataFrame, digests: DataFrame, bits: int = 128) -> DataFrame:
    """Rows (doc_id, digest, class) of documents whose bucket holds different canonical texts; class 0 is the least.

    Only texts whose digest shares a slot with a repeated digest are compared. Each task first folds a bucket to its
    least and greatest text, so a bucket of any size costs a row for each task; where the two are equal bytes, so are all.
    """
    spark = df.sparkSession
    width = min(bits, 23)
    slot = F.conv(F.substring("digest", 1, (width + 3) // 4), 16, 10).cast("long") % SLOTS
    repeated = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").withColumn("slot", slot)
    found = repeated.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect()
    marked = np.zeros(SLOTS, bool)
    each = 8 * 4096
    for r in found:
        lo = (r["bucket"] - 1) * each
        marked[lo : lo + each] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[: len(marked[lo : lo + each])].astype(bool)
    shared = spark.sparkContext.broadcast(np.packbits(marked).tobytes())

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(shared.value, np.uint8))
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                d = digest(t or "", bits)
                if marked[int(d[: (width + 3) // 4], 16) % SLOTS]:
                    out.append((i, d, press.compress(canonical(t or "").encode())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "digest", "form"])

    rows = with_columns_as(df, doc_id="long", text="string").mapInArrow(suspects, "doc_id long, digest string, form binary")
    mixed = rows.groupBy("digest").agg(F.min("form").alias("a"), F.max("form").alias("z")).filter("a <> z").select("digest")
    mixed = materialize(mixed, "mixed")
    if mixed.isEmpty():
        return spark.createDataFrame([], "doc_id long, digest string, class int")
    hit = rows.join(mixed, "digest", "left_semi")
    numbered = hit.select("digest", "form").distinct().withColumn("class", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)
    return hit.join(numbered, ["digest", "form"]).select("doc_id", "digest", "class").distinct()


def fingerprint(df: DataFrame, bits: int = 128) -> DataFrame:
    """Per document: length, digest of its edited text, fingerprints of both, and whether they agree.

    Equal canonical texts have equal fingerprints and others differ: a bucket's digest, with ``-k`` after it for its
    k-th further text. near_edited and near_next are 1 if the canonical texts are equal bytes, else 0. Null text counts
    as empty; repeated rows each give a row; a single document is its own next. No rows give no rows.
    """
    base = materialize(with_next(df, bits), "digests")
    out = base.withColumn("fingerprint", F.col("digest"))
    clash = collisions(df, base.select("digest"), bits)
    if not clash.isEmpty():
        clash = materialize(clash.filter("class > 0"), "classes")
        out = base.join(clash, ["doc_id", "digest"], "left").withColumn("fingerprint", F.when(F.col("class") > 0, F.concat_ws("-", "digest", "class")).otherwise(F.col("digest")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
