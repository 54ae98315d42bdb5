"""URL verdicts: given host and path rules first, else association rules mined from labelled URLs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns_as

BLOCK, ALLOW = "label block", "label allow"


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    at = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:at], rest[at:]
    stop = min((k for c in "?#" if (k := tail.find(c)) >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def tokens(url: str | None) -> list[str]:
    """Distinct tokens: scheme, host labels and suffixes, path words with numbers as one, query keys, fragment."""
    host, path = parts(url)
    if not host:
        return []
    url = url or ""
    names = host.split(".")
    found = {f"scheme {url.partition('://')[0].lower()}", f"host {host}", *(f"name {n}" for n in names[:-1]), f"end {'.'.join(names[-2:])}", f"top {names[-1]}"}
    found |= {f"path {'#' if w.isdigit() else w.lower()}" for w in re.split(r"[/._-]+", path) if w}
    query = url.partition("?")[2].partition("#")[0]
    found |= {f"query {k.partition('=')[0].lower()}" for k in query.split("&") if k}
    if "#" in url:
        found.add("fragment")
    return sorted(found)


def _token_rows(df: DataFrame, extra: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [t + [BLOCK if bad else ALLOW] for u, bad in zip(b.column("url").to_pylist(), b.column(extra).to_pylist(), strict=True) if (t := tokens(u))]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    return df.select("url", extra).mapInArrow(run, "items array<string>")


def document_number(url: str = "url") -> Column:
    """The document a page's URL names: the number after its language folder; null if there is none."""
    return F.expr(f"try_cast(regexp_extract({url}, '://[^/?#]*/[a-z]+/([0-9]{{1,18}})', 1) as bigint)")


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.004, confidence: float = 0.6, lift: float = 1.5, sample: int = 50_000) -> list[tuple[list[str], float]]:
    """Antecedents whose URLs are labelled bad with at least this confidence, lift and support, best first.

    A URL is bad if the document it names is labelled toxic or of low quality. Spark FP-growth counts token combinations of
    at most about ``sample`` labelled URLs (by a hash of page_id). A rule goes if a part of it is a rule: what the longer one
    blocks, the shorter one does. The support bounds the rest.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc"), F.greatest(F.coalesce(F.col("toxic").cast("int"), F.lit(0)), 1 - F.coalesce(F.col("quality").cast("int"), F.lit(1))).alias("bad")).filter("doc is not null").groupBy("doc").agg((F.max("bad") > 0).alias("bad"))
    named = with_columns_as(pages, page_id="long", url="string").withColumn("doc", document_number()).filter("doc is not null").join(marks, "doc")
    n = named.count()
    if not n:
        return []
    some = named.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < F.lit(min(1 << 20, (sample << 20) // n)))
    rows = _token_rows(some, "bad")
    total = rows.count()
    if not total:
        return []
    # Tokens of nearly every URL tell nothing and would double the itemsets each.
    common = [r["t"] for r in rows.select(F.explode("items").alias("t")).groupBy("t").count().filter(F.col("count") > 0.9 * total).filter(~F.col("t").isin(BLOCK, ALLOW)).collect()]
    rows = rows.select(F.array_except("items", F.array(*[F.lit(c) for c in common]).cast("array<string>")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=max(support, 4 / total), minConfidence=confidence).fit(rows).freqItemsets
    with_bad = sets.filter(F.array_contains("items", BLOCK)).select(F.sort_array(F.array_remove("items", BLOCK)).alias("left"), F.col("freq").alias("hits"))
    plain = sets.filter(~F.array_contains("items", BLOCK)).select(F.sort_array("items").alias("left"), F.col("freq").alias("all"))
    base = with_bad.filter(F.size("left") == 0).first()
    if base is None:
        return []
    floor = max(confidence, lift * base["hits"] / total)
    good = materialize(with_bad.filter(F.size("left") > 0).join(plain, "left").withColumn("c", F.col("hits") / F.col("all")).filter(F.col("c") >= floor).select("left", "hits", "c"), "url-rules")
    return [(r["left"], r["c"]) for r in minimal(good).orderBy(F.desc("c"), F.size("left"), F.desc("hits"), "left").collect()]


def minimal(rules: DataFrame) -> DataFrame:
    """Rules (left: sorted tokens) of which no proper part is a rule.

    Each rule is met with those that begin with one of its tokens, in rounds by length: the shortest ones stay, and their
    supersets go before the next round.
    """
    rest, out = rules, None
    for n in range(1, (rules.agg(F.max(F.size("left"))).first()[0] or 0) + 1):
        short = rest.filter(F.size("left") == n)
        out = short if out is None else out.unionByName(short)
        parts = short.select(F.col("left")[0].alias("t"), F.col("left").alias("part"))
        over = rest.filter(F.size("left") > n).withColumn("t", F.explode("left")).join(parts, "t").filter(F.size(F.array_except("part", "left")) == 0).select("left").distinct()
        rest = materialize(rest.filter(F.size("left") > n).join(over, "left", "left_anti"), "url-rules")
        if rest.isEmpty():
            break
    return rules if out is None else out


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: list[tuple[list[str], float]]) -> DataFrame:
    """page_id, host, path, rule and verdict of each row.

    rules: (block or allow, ``host/path``); the longest that fits decides. Else a URL is blocked if all tokens of a mined
    rule are in it: an inverted index from tokens to rules counts them. Null or odd URLs have no tokens and are allowed.
    Each row stands alone: copies and ties are no matter, an empty table gives none.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast((sorted(rules, key=lambda r: -len(r[1])), mined))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, mined = shared.value
        split = [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in given]
        index: dict[str, list[int]] = defaultdict(list)
        for k, (left, _) in enumerate(mined):
            for t in left:
                index[t].append(k)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                verdict, rule = next(((v, r) for v, r, h, p in split if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))
                if verdict is None:
                    hits = Counter(k for t in tokens(url) for k in index.get(t, ()))
                    verdict = "block" if any(n == len(mined[k][0]) for k, n in hits.items()) else "allow"
                for o, v in zip(out, (host, path, rule, verdict), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *[pa.array(o, pa.string()) for o in out]], ["page_id", "host", "path", "rule", "verdict"])

    return with_columns_as(pages, page_id="long", url="string").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
