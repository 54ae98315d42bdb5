"""Identity hypotheses, contradictions, and identities that people validated; mentions are grouped, never merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.operators import graph, similarity
from casegraph.operators.storage import saved
from casegraph.sources.reports import edge


def captures(edges: DataFrame) -> DataFrame:
    """Observations of addresses by report: time, port, and whether the address or the capture hides its user."""
    attr = lambda k: F.col("attrs")[k]
    flag = lambda k: F.coalesce(attr(k) == "true", F.lit(False))
    seen = edges.filter("relation = 'OBSERVADO_DESDE_IP'")
    return seen.select(F.col("dst").alias("node_id"), F.col("dst_value").alias("value"), "sid", F.col("src").alias("anchor"), F.col("observed_ts").alias("ts"), attr("port").alias("port"), (flag("cgnat") | flag("private") | nz.given(attr("proxy"))).alias("nat"), "locator")


def contradictions(edges: DataFrame) -> DataFrame:
    """CONTRADICE edges: consecutive observations of an account or person from addresses too far apart for their time.

    A place has the coordinates it was first given, an address its last place, by report and locator.
    """
    number = lambda k: F.col("attrs")[k].try_cast("double").alias(k)
    order = F.struct("sid", "locator")
    located = edges.filter("relation = 'GEOLOCALIZA_EN'").select("src", "dst", number("lat"), number("lon"), order.alias("order"))
    valid = located.filter("lat between -90 and 90 and lon between -180 and 180 and not isnan(lat) and not isnan(lon)")
    place = valid.groupBy("dst").agg(F.min_by(F.struct("lat", "lon"), "order").alias("at"))
    of = located.join(place, "dst").groupBy(F.col("src").alias("ip")).agg(F.max_by("at", "order").alias("at"))
    seen = captures(edges).filter("ts is not null").withColumnRenamed("node_id", "ip").join(of, "ip")
    far = similarity.impossible_travel(seen.select("anchor", "ip", "ts", "at.lat", "at.lon", F.struct("sid", "locator", "value").alias("ord")))
    rows = far.withColumn("reportId", F.lit(None).cast("string"))
    attrs = {"km": F.round("km", 1), "hours": F.round("hours", 2), "kmh": F.round(F.col("km") / F.col("hours"), 1), "anchor": F.col("anchor"), "reports": F.array_join(F.array_distinct(F.array("from_ord.sid", "to_ord.sid")), ",")}
    return edge(rows, ("IP", F.col("from_ord.value")), ("IP", F.col("to_ord.value")), "CONTRADICE", F.concat_ws(" | ", "from_ord.locator", "to_ord.locator"), "resolucion_determinista", confidence=vocab.CONTRADICTION_SURE, attrs=attrs, source=F.concat(F.lit("derivacion:contradiccion:"), "anchor"))


def hypotheses(edges: DataFrame) -> DataFrame:
    """POSIBLE_MISMA_IDENTIDAD edges between mentions that use one account."""
    used = edges.filter("relation = 'USA_CUENTA'").select(F.col("src_value").alias("mention"), F.col("dst").alias("account"))
    rows = similarity.identity_pairs(used).withColumn("reportId", F.lit(None).cast("string"))
    return edge(rows, ("PERSONA_MENCION", F.col("a")), ("PERSONA_MENCION", F.col("b")), "POSIBLE_MISMA_IDENTIDAD", F.concat(F.lit("USA_CUENTA -> "), "account"), "resolucion_determinista", confidence=vocab.IDENTITY_SURE, attrs={"account": F.col("account")}, source=F.concat(F.lit("derivacion:identidad:"), "account"))


def consolidate(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identities of validated hypotheses (identity, mentions, reports, who, when), and IDENTIFICADO_COMO edges.

    reviewed: hypotheses with state and, if known, by and at. The composition of mentions is the identity: two groups of the
    same reports stay two.
    """
    for c in ("by", "at"):
        if c not in reviewed.columns:
            reviewed = reviewed.withColumn(c, F.lit(None).cast("string"))
    valid = reviewed.filter("state = 'validada'")  # not written: what follows reads a few of its columns, once each
    labels = graph.components(graph.thinned(valid.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    both = F.array(*[F.struct(F.col(e).alias("v"), F.col(f"{e}_value").alias("value")) for e in ("src", "dst")])
    ends = valid.select(F.explode(both).alias("e"), "by", "at", "arista_id").select("e.*", "by", "at", "arista_id")
    # Hypotheses of one account are made in one task, so what they say alike of a mention is one row before it travels.
    told = ends.select("v", "value", "by", "at").distinct().groupBy("v").agg(F.min("value").alias("value"), F.collect_set("by").alias("by"), F.max("at").alias("at"))
    group = labels.join(told, "v").groupBy("label").agg(
        F.array_sort(F.collect_list("v")).alias("mentions"), F.array_sort(F.collect_set(F.substring_index("value", "/", 1))).alias("reports"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("by")))).alias("who"), F.max("at").alias("when"),
    )
    group = saved(group.withColumn("digest", F.sha2(F.array_join("mentions", "|"), 256)).withColumn("identity", F.concat(F.lit("id-"), F.substring("digest", 1, 16))))
    own = ends.groupBy("v").agg(F.min("value").alias("value"), F.array_join(F.array_sort(F.collect_set("arista_id")), " | ").alias("locator"))
    named = labels.join(own, "v")
    rows = named.join(group.select("label", "identity", "digest", F.size("mentions").alias("n"), F.array_join("reports", ", ").alias("of"), F.array_join("who", ", ").alias("by"), "when"), "label").withColumn("reportId", F.lit(None).cast("string"))
    facts = {"reports": F.col("of"), "fingerprint": F.concat(F.lit("sha256:"), "digest"), "mentions": F.col("n"), "validated_by": F.nullif(F.col("by"), F.lit("")), "validated_at": F.col("when")}
    edges = edge(rows, ("PERSONA_MENCION", F.col("value")), ("IDENTIDAD", F.col("identity")), "IDENTIFICADO_COMO", F.col("locator"), "consolidacion_identidad", confidence=vocab.MOST, attrs={"by": F.col("by"), "at": F.col("when")}, dst_facts=facts, source=F.concat(F.lit("validacion:identidad:"), "identity"))
    return group.select("identity", "mentions", "reports", "who", "when"), edges


def remapped(nodes: DataFrame, unified: DataFrame) -> DataFrame:
    """node_id and shown: the identity that a mention was unified under, else the node itself."""
    to = unified.select(F.col("src").alias("node_id"), F.col("dst").alias("identity")).distinct()
    return nodes.select("node_id").join(to, "node_id", "left").select("node_id", F.coalesce("identity", "node_id").alias("shown"))
