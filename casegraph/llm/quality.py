"""Quality rules: text statistics and a learned decision list, as Spark expressions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of

#: Words of a window whose repetition counts.
SPAN = 8
#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"
#: Windows of a text whose positions fit a packed number, in which the rest is the hash; in longer texts pairs are sorted.
LOW = (1 << 24) - 1
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "n_words", "distinct_share", "capitals_share", "line_words")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_stats(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The row (a struct of df's columns), each statistic, and f_<feature> of each feature; and the struct's fields.

    Null text has no words. Words are ``[^\\x20\\x09-\\x0D]+``; a repeated word is one in a window of eight words that the
    text holds twice or more. Windows are compared by 64-bit hashes built by doubling; only for texts with a repeated one
    are positions sorted with hashes, so work is n log n in the words of any text, however long. Each row stands for itself:
    copies and empty tables are no matter, and extra columns pass, whatever their names.
    """
    row, field = row_of(df)
    a = df.select(row, F.coalesce(df["text"].cast("string"), F.lit("")).alias("t"))
    a = a.withColumn("w", F.transform(F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)))
    a = a.withColumn("n", F.size("w"))
    for source, width, name in (("w", 1, "h2"), ("h2", 2, "h4"), ("h4", 4, "h")):
        left = F.greatest(F.size(source) - width, F.lit(0))
        a = a.withColumn(name, F.zip_with(F.slice(source, F.lit(1), left), F.slice(source, F.lit(width + 1), left), lambda x, y: F.xxhash64(x, y)))
    a = a.withColumn("m", F.size("h"))
    a = a.withColumn("r", F.size(F.array_distinct("h")) < F.col("m"))
    packed = F.sort_array(F.transform("h", lambda h, i: h.bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long"))))
    short = F.col("m") <= LOW
    a = a.withColumn("p", F.when(F.col("r") & short, packed))
    a = a.withColumn("q", F.when(F.col("r") & ~short, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    where = lambda j: F.element_at("p", j).bitwiseAND(F.lit(LOW)).cast("int")  # noqa: E731  j from 1
    hash_at = lambda j: F.element_at("h", where(j) + 1)

    def twice(j: Column) -> Column:
        near = [F.when((j + d >= 1) & (j + d <= F.col("m")), hash_at(j + d) == hash_at(j)).otherwise(False) for d in (-1, 1, -2, 2)]
        return near[0] | near[1] | near[2] | near[3]

    starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), F.col("m")), twice), where))
    pair = lambda j: F.element_at("q", j)
    alike = lambda j: F.when(j > 1, pair(F.greatest(j - 1, F.lit(1)))["h"] == pair(j)["h"]).otherwise(False) | F.when(j < F.col("m"), pair(F.least(j + 1, F.col("m")))["h"] == pair(j)["h"]).otherwise(False)
    long = F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), F.col("m")), alike), lambda j: pair(j)["i"]))
    a = a.withColumn("s", F.when(F.col("r") & short, starts).when(F.col("r"), long))
    steps = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda x, y: F.least(y - x, F.lit(SPAN)).cast("long"))
    covered = F.aggregate(steps, F.lit(SPAN).cast("long"), lambda acc, x: acc + x)
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumn("l", lines)
    length = F.char_length("t")
    a = (
        a.withColumn("n_words", F.col("n").cast("long"))
        .withColumn("word_chars", F.char_length(_without(F.col("t"), _BLANKS)).cast("long"))
        .withColumn("n_symbols", (length - F.char_length(_without(F.col("t"), SYMBOLS))).cast("long"))
        .withColumn("n_lines", F.size("l"))
        .withColumn("n_dup_lines", (F.size("l") - F.size(F.array_distinct("l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.when(F.col("r"), covered), F.lit(0)).cast("long"))
        .withColumn("n_distinct", F.size(F.array_distinct("w")))
        .withColumn("capitals", F.regexp_count("t", F.lit("[A-Z]{3,}")))
    )
    per = lambda x, y: F.col(x).cast("double") / F.greatest(F.col(y), F.lit(1))
    values = {"symbol_share": per("n_symbols", "word_chars"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"), "n_words": F.col("n_words").cast("double"), "distinct_share": per("n_distinct", "n_words"), "capitals_share": per("capitals", "n_words"), "line_words": per("n_words", "n_lines")}
    return a.select("row", *STATS, *[F.round(values[f], 6).alias(f"f_{f}") for f in FEATURES]), field


Condition = tuple[str, str, float]  # feature, ">=" or "<=", threshold


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.8, least: int = 8, cuts: int = 32) -> list[list[Condition]]:
    """Sequential covering: rules that reject, in order, each a conjunction of thresholds.

    A rule grows on two thirds of what earlier rules left, by FOIL gain over quantile thresholds, until it covers no good
    row; it is pruned on the other third, dropping final conditions while that doesn't lower its score; it counts only if
    it is right for a share ``precision`` of at least ``least`` rows of either part. Every rule takes some bad rows along, so
    there is no limit on their number.
    """
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    part = np.arange(len(bad)) % 3 == 2

    def covers(rule: list[Condition]) -> np.ndarray:
        on = np.ones(len(bad), bool)
        for f, op, v in rule:
            c = x[:, FEATURES.index(f)]
            on &= c >= v if op == ">=" else c <= v
        return on

    while True:
        grow, prune = left & ~part, left & part
        rule: list[Condition] = []
        on = grow.copy()
        while (on & ~bad).any() and len(rule) < 4:
            p0, n0 = (on & bad).sum(), (on & ~bad).sum()
            if not p0:
                break
            best = (0.0, None)
            for k, f in enumerate(FEATURES):
                c = x[:, k]
                for v in np.unique(np.quantile(c[on], np.linspace(0, 1, cuts + 1)).round(6)).tolist():
                    for op in (">=", "<="):
                        hit = on & (c >= v if op == ">=" else c <= v)
                        p, n = (hit & bad).sum(), (hit & ~bad).sum()
                        if p >= least and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0] + 1e-9:
                            best = (gain, (f, op, v))
            if best[1] is None:
                break
            rule.append(best[1])
            on &= covers([best[1]])

        def worth(r: list[Condition], rows: np.ndarray) -> float:
            hit = covers(r) & rows
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / max(1, p + n)

        while len(rule) > 1 and worth(rule[:-1], prune) >= worth(rule, prune):
            rule.pop()
        if not rule:
            break
        hit = covers(rule)
        right = [(hit & rows & bad).sum() >= precision * max(least / 2, (hit & rows).sum()) for rows in (grow, prune)]
        if not all(right):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list: null-safe conditions in order, the first that holds rejects; else the row is kept."""
    out = None
    for rule in rules:
        on = F.lit(True)
        for f, op, v in rule:
            c = F.col(f"f_{f}")
            on = on & (c >= v if op == ">=" else c <= v)
        out = F.when(on, False) if out is None else out.when(on, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(df: DataFrame, labels: DataFrame, sample: int = 12_000) -> list[list[Condition]]:
    """Rules from labelled rows of df: at most about ``sample`` labels by a hash of doc_id, so the driver's part is bounded.

    Labels of a doc_id given twice count as good if any is; null labels and ids are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__q")).filter("__id is not null and __q is not null")
    n = marks.count()
    some = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < F.lit(min(1 << 20, (sample << 20) // max(n, 1)))).groupBy("__id").agg(F.max("__q").alias("__q"))
    rows, field = with_stats(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__q"))
    own = [F.col("row")[field[c]].alias(n) for c, n in (("doc_id", "doc_id"), ("__q", "q"))]
    found = rows.select(*own, *[f"f_{f}" for f in FEATURES]).toPandas().sort_values(["doc_id", *[f"f_{f}" for f in FEATURES]])
    if found.empty:
        return []
    found = found.sample(frac=1, random_state=7)
    return learn(found[[f"f_{f}" for f in FEATURES]].to_numpy(float), found["q"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(df: DataFrame, rules: list[list[Condition]]) -> tuple[DataFrame, dict[str, str]]:
    """with_stats(df) with base_failed and kept; each row by itself, so copies, null and empty texts are fine."""
    rows, field = with_stats(df)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules))), field


def result(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row; very long texts are read whole like any other."""
    out, field = judge(df.select("doc_id", "text"), fit(df, labels))
    return out.select(F.col("row")[field["doc_id"]].alias("doc_id"), *STATS, "base_failed", "kept")


def stage(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of df that neither the base rules nor the learned list reject; null and empty texts fail the base rules."""
    # The row number keeps the filter above the statistics: pushed below them, it would hold each of them many times over.
    judged, field = judge(df, fit(df, labels))
    kept = judged.withColumn("at", F.monotonically_increasing_id()).filter((F.col("at") >= 0) & F.col("kept"))
    return kept.select(*[F.col("row")[f].alias(c) for c, f in field.items()])
