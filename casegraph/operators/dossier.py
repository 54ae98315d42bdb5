"""The dossier: tables for a report on the whole run or on one case, pseudonyms and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions import vocab
from casegraph.operators import pseudonyms, review, views
from casegraph.operators.storage import saved

#: Values shorter than this are no identifiers to hide (fixed value).
LEAST_LENGTH = 4


def build(run: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a dossier, from the tables of plans.build."""
    links = run["links"]
    sides = lambda sustain: F.transform(F.filter("details", lambda d: d["corroborates"] != F.lit(sustain)), lambda d: F.struct(d["rule"].alias("rule"), d["node_id"].alias("value"), d["weight"].alias("weight")))
    shown = links.select("arista_id", "a", "b", "relation", "score", "band", "state", sides(True).alias("sustain"), sides(False).alias("corroborate"), F.split("locator", r" \| ").alias("evidence")).orderBy(F.desc("score"), "a", "b")
    out = {
        "reports": run["about"].join(views.identifiers(run["current"]), "sid", "left").orderBy("sid"),
        "links": shown,
        "weights": weights(links), "rules": rules(links),
        "discarded": run["discarded"],
        "manual": run["manual"].select(F.col("src_value").alias("a"), F.col("dst_value").alias("b"), F.col("attrs")["by"].alias("by"), F.col("attrs")["at"].alias("at"), F.col("attrs")["reason"].alias("reason")),
        "alerts": run["alerts"],
        "contradictions": run["contradictions"].filter("current").select("attrs", "explanation", F.split(F.col("attrs")["reports"], ",").alias("reports")),
        "hypotheses": run["identities"].filter("current").select("src_value", "dst_value", F.col("attrs")["account"].alias("account"), F.array_distinct(F.array(F.substring_index("src_value", "/", 1), F.substring_index("dst_value", "/", 1))).alias("reports")),
        "cases": run["cases"], "members": run["members"],
    }
    return out


def weights(links: DataFrame) -> DataFrame:
    """Number, greatest, least and mean score, in all (also of no links) and by band, in one pass."""
    agg = [F.count("*").alias("links"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.round(F.avg("score"), 4).alias("avg_score")]
    return links.groupingSets([[], ["band"]], "band").agg(F.grouping("band").alias("all"), *agg).select(F.when(F.col("all") == 1, "all").otherwise(F.col("band")).alias("band"), "links", "max_score", "min_score", "avg_score")


def rules(links: DataFrame) -> DataFrame:
    """How often each rule fired in links, and its mean weight."""
    return links.select(F.explode("details").alias("d")).groupBy("d.rule").agg(F.count("*").alias("times"), F.round(F.avg("d.weight"), 4).alias("avg_weight"))


def of_pairs(df: DataFrame, x: str, y: str, reports: DataFrame) -> DataFrame:
    """Rows of pairs with either end among reports (sid)."""
    own = reports.select("sid").distinct()
    flag = lambda c: own.select(F.col("sid").alias(c), F.lit(True).alias(f"__{c}"))
    return df.join(flag(x), x, "left").join(flag(y), y, "left").filter(f"__{x} or __{y}").select(*df.columns)


def trim(dossier: dict[str, DataFrame], reports: DataFrame) -> dict[str, DataFrame]:
    """The dossier of some reports (sid): rows of pairs with either end among them, of lists with any, of reports themselves."""
    own = reports.select("sid").distinct()
    either = lambda df, x, y: of_pairs(df, x, y, own)

    def any_of(df: DataFrame) -> DataFrame:
        rows = df.withColumn("__id", F.monotonically_increasing_id())
        hit = rows.select("__id", F.explode("reports").alias("sid")).join(own, "sid", "left_semi").select("__id").distinct()
        return rows.join(hit, "__id", "left_semi").drop("__id")

    out = {k: either(dossier[k], "a", "b") for k in ("links", "discarded", "manual")}
    out |= {"reports": dossier["reports"].join(own, "sid", "left_semi"), "alerts": either(dossier["alerts"], "archived", "trigger")}
    out |= {k: any_of(dossier[k]) for k in ("contradictions", "hypotheses")}
    out["members"] = dossier["members"].join(dossier["members"].join(own, "sid", "left_semi").select("case").distinct(), "case", "left_semi")
    out["cases"] = dossier["cases"].join(out["members"].select("case").distinct(), "case", "left_semi")
    return out | {"weights": weights(out["links"]), "rules": weights_of_rules(out["links"])}


def weights_of_rules(links: DataFrame) -> DataFrame:
    """As rules(), for links of a dossier."""
    return links.select(F.explode(F.concat("sustain", "corroborate")).alias("d")).groupBy("d.rule").agg(F.count("*").alias("times"), F.round(F.avg("d.weight"), 4).alias("avg_weight"))


def sensitive(nodes: DataFrame) -> DataFrame:
    """kind, value, order of what pseudonyms stand for."""
    rows = nodes.filter(F.col("kind").isin(*vocab.SENSITIVE) & (F.length("value") >= LEAST_LENGTH))
    return rows.groupBy("value").agg(F.min("kind").alias("kind"), F.min("node_id").alias("order")).select("kind", "value", "order")


def payload(dossier: dict[str, DataFrame]) -> DataFrame:
    """The dossier as rows of section and JSON text, for pseudonyms or for a writer."""
    out = None
    for name, df in dossier.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = part if out is None else out.union(part)
    return out


def pseudonymised(dossier: dict[str, DataFrame], nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The payload (section, json) with pseudonyms for all sensitive values of the nodes, and the labels, which stay here."""
    labels = saved(review.pseudonyms(sensitive(nodes)))
    return pseudonyms.hidden(payload(dossier), "json", labels), labels
