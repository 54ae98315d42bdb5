"""What people look at: cases, links with their evidence, entities, queues, coverage, candidates with support, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.operators.storage import parts, saved


def current(edges: DataFrame, origin: str | None = None, relation: str | None = None, rejected: bool = False) -> DataFrame:
    """Edges by origin and relation; rejected ones only on demand."""
    out = edges if rejected else edges.filter("current")
    out = out.filter(F.col("origin") == origin) if origin else out
    return out.filter(F.col("relation") == relation) if relation else out


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def reviewable(edges: DataFrame) -> DataFrame:
    """Edges that a person may decide on: not those that a person made."""
    return edges.filter((F.col("origin") != "afirmada") & (F.col("relation") != "IDENTIFICADO_COMO"))


def split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current edges and rejected ones."""
    return edges.filter("current"), edges.filter("not current")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by kind and of edges by origin and by relation: what, name, n. Edges are read once for both."""
    first = nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n")
    both = edges.groupingSets([["origin"], ["relation"]], "origin", "relation").agg(F.grouping("origin").alias("by"), F.count("*").alias("n"))
    by_relation = F.col("by") == 1
    return first.union(both.select(F.when(by_relation, "relation").otherwise("origin").alias("what"), F.when(by_relation, F.col("relation")).otherwise(F.col("origin")).alias("name"), "n"))


def ends(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge: node_id, kind, value and the edge's own columns."""
    both = F.array(*[F.struct(F.col(e).alias("node_id"), F.col(f"{e}_kind").alias("kind"), F.col(f"{e}_value").alias("value")) for e in ("src", "dst")])
    return edges.select(F.explode(both).alias("e"), "sid", "relation", "origin", "locator", "method", "version").select("e.*", "sid", "relation", "origin", "locator", "method", "version")


def coverage(edges: DataFrame, about: DataFrame) -> DataFrame:
    """Different identifiers of each report by kind (aliases count, payment aliases and places don't), also of reports without any."""
    seen = ends(edges).filter(F.col("kind").isin(*vocab.COVERED) & F.col("sid").isNotNull()).select("sid", "kind", "node_id").distinct().groupBy("sid", "kind").agg(F.count("*").alias("n"))
    each = seen.groupBy("sid").agg(F.sum("n").alias("identifiers"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("detail"))
    out = about.select("sid", "platform", "state", "motive").join(each, "sid", "left").withColumn("identifiers", F.coalesce("identifiers", F.lit(0).cast("long")))
    return out.withColumn("linkable", F.col("identifiers") > 0)


def identifiers(edges: DataFrame) -> DataFrame:
    """sid and a map of kind to the sorted values that the report has."""
    rows = ends(edges).filter(F.col("kind").isin(*vocab.SENSITIVE) & F.col("sid").isNotNull()).groupBy("sid", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return rows.groupBy("sid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "values")))).alias("identifiers"))


def candidates(pairs: DataFrame, links: DataFrame, manual: DataFrame, edges: DataFrame, top: int = vocab.TOP_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Structural candidates (Adamic-Adar) without any link, rejected ones and manual ones included, and their support.

    pairs: shared identifiers (node_id, kind, df, a, b). Support: a, b, node_id, side, relation, locator, method, each once.
    """
    known = links.select("a", "b").union(manual.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    some = pairs.filter(F.col("kind").isin(*vocab.CANDIDATE_KINDS)).join(known, ["a", "b"], "left_anti")
    gain = 1 / F.log(F.greatest(F.col("df"), F.lit(2)).cast("double"))
    best = saved(some.groupBy("a", "b").agg(F.round(F.sum(gain), 4).alias("score"), F.count("*").alias("shared")).orderBy(F.desc("score"), "a", "b").limit(top))
    shown = some.join(F.broadcast(best.select("a", "b")), ["a", "b"]).select("a", "b", "node_id", "kind", "df", F.round(gain, 4).alias("gain"))
    of = ends(edges).select("node_id", "sid", "relation", "locator", F.concat_ws("@", "method", "version").alias("method")).distinct()
    side = lambda s: shown.join(of.withColumnRenamed("sid", s), ["node_id", s]).select("a", "b", "node_id", "kind", "df", "gain", F.lit(s).alias("side"), "relation", "locator", "method")
    return best, side("a").union(side("b"))


def queue(edges: DataFrame, origin: str | None = None, rows: int | None = None) -> DataFrame:
    """Pending edges: inferred ones first, then by confidence; at most so many rows where a list asks for that."""
    out = edges.filter("state = 'pendiente' and current")
    out = out.filter(F.col("origin") == origin) if origin else out
    out = out.withColumn("band", nz.band(F.coalesce("confidence", F.lit(0.0)))).orderBy(F.col("origin") != "inferida", F.desc(F.coalesce("confidence", F.lit(0.0))), "arista_id")
    return out.limit(rows) if rows else out


def reports_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, sid): the reports that mention each node; an identity has those of its mentions, a report itself."""
    seen = ends(edges).filter("sid is not null").select("node_id", "sid")
    own = nodes.filter("kind = 'REPORTE'").select("node_id", F.col("value").alias("sid"))
    unified = edges.filter("relation = 'IDENTIFICADO_COMO'").select("src", "dst")
    base = seen.union(own).distinct()
    return base.union(unified.join(base, unified["src"] == base["node_id"]).select(F.col("dst").alias("node_id"), "sid")).distinct()


def in_case(reached: DataFrame, members: DataFrame) -> DataFrame:
    """(case, node_id): a node belongs to a case if any report of the case mentions it; members: case, sid."""
    return reached.join(members, "sid").select("case", "node_id").distinct()


def entities(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Entities with the number of their reports: shared ones first, then by kind and value."""
    n = reached.groupBy("node_id").agg(F.count("*").alias("reports"))
    rows = nodes.filter("kind <> 'REPORTE'").join(n, "node_id", "left").withColumn("reports", F.coalesce("reports", F.lit(0).cast("long")))
    return rows.orderBy(F.col("reports") < 2, "kind", "value")


def link_evidence(fired: DataFrame, edges: DataFrame) -> DataFrame:
    """For each firing of a pair the edges that touch its identifier within either report: a, b, rule, weight, node_id, side, relation, locator."""
    touching = ends(edges).filter("sid is not null").select("node_id", "sid", "relation", "locator").distinct()
    side = lambda s: fired.select("a", "b", "rule", "weight", "corroborates", "node_id").join(touching.withColumnRenamed("sid", s), ["node_id", s]).select("a", "b", "rule", "weight", "corroborates", "node_id", F.lit(s).alias("side"), "relation", "locator")
    return side("a").union(side("b")).orderBy("a", "b", "corroborates", F.desc("weight"), "node_id", "side", "locator")


def current_link(links: DataFrame, manual: DataFrame) -> DataFrame:
    """The link that stands for each pair: a manual one before the derived one."""
    derived = links.filter("current").select("a", "b", F.struct(F.lit(0).alias("rank"), "score", F.coalesce("relation", F.lit("COINCIDE_CON")).alias("relation")).alias("r"))
    by_hand = manual.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct(F.lit(1).alias("rank"), F.lit(None).cast("double").alias("score"), F.lit("VINCULADO_POR_OPERADOR").alias("relation")).alias("r"))
    return derived.unionByName(by_hand).groupBy("a", "b").agg(F.max("r").alias("r")).select("a", "b", "r.relation", "r.score")


def shown_links(links: DataFrame, least: float = 0.0, case: DataFrame | None = None) -> DataFrame:
    """Current links of at least a weight (one without a weight always passes), of a case's reports (sid) if given, by weight."""
    out = links.filter(F.col("current") & (F.col("score").isNull() | (F.col("score") >= least)))
    if case is not None:
        sids = case.select("sid")
        out = out.join(sids.withColumnRenamed("sid", "a"), "a", "left_semi").join(sids.withColumnRenamed("sid", "b"), "b", "left_semi")
    return out.orderBy(F.desc_nulls_last("score"), "a", "b")


def found(nodes: DataFrame, reached: DataFrame, text: str = "", shared: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """Entities whose kind, value or attributes hold a text, whatever its case; shared ones or kinds only on demand."""
    blob = F.lower(F.concat_ws(" ", "kind", "value", F.map_values("attrs")))
    out = entities(nodes, reached).filter(blob.contains(text.lower()))
    out = out.filter("reports > 1") if shared else out
    return out.filter(F.col("kind").isin(*kinds)) if kinds else out


def focus(reached: DataFrame, node: str, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reports that a datum reaches, and the edges of those reports that touch it."""
    sids = reached.filter(F.col("node_id") == node).select("sid")
    return sids, edges.filter((F.col("src") == node) | (F.col("dst") == node))


def viewer(run: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a viewer shows: nodes with their reports and the node they are shown as, edges, evidence of links, lists."""
    reached = reports_of(run["nodes"], run["edges"])
    of = reached.groupBy("node_id").agg(F.array_sort(F.collect_set("sid")).alias("reports"))
    same = run["edges"].filter("relation = 'IDENTIFICADO_COMO'").select(F.col("src").alias("node_id"), F.col("dst").alias("identity"))
    nodes = run["nodes"].join(of, "node_id", "left").join(same, "node_id", "left").withColumn("shown", F.coalesce("identity", "node_id")).drop("identity")
    linked = run["links"].select("a", "b")
    return {"nodes": nodes, "edges": run["edges"], "evidence": link_evidence(run["firings"].join(linked, ["a", "b"], "left_semi"), run["edges"]), "membership": in_case(reached, run["members"])} | {k: run[k] for k in ("links", "discarded", "alerts", "cases", "candidates", "coverage")}


def neighbours(edges: DataFrame) -> DataFrame:
    """Different neighbours of each node by relation."""
    both = edges.select(F.col("src").alias("node_id"), "relation", F.col("dst").alias("other")).union(edges.select("dst", "relation", "src"))
    return both.distinct().groupBy("node_id", "relation").agg(F.count("*").alias("neighbours"))


def paths(edges: DataFrame, wanted: DataFrame, depth: int = 4) -> DataFrame:
    """Shortest ways from a report to a datum over the report's own edges, in either direction; wanted: sid, node_id.

    Of equally short ways the one by people, then accounts, then others, events, organisations, and by node id.
    """
    prefer = lambda k: F.when(F.col(k).isin("PERSONA_MENCION", "IDENTIDAD"), 0).when(F.col(k) == "CUENTA", 1).when(F.col(k) == "EVENTO", 3).when(F.col(k) == "ORGANIZACION", 4).otherwise(2)
    # All of a report's rows are in one part from here on, so neither joins nor groups by report shuffle again.
    n = parts(edges.sparkSession, edges.count(), 250_000)
    asked = wanted.groupBy("sid", F.col("node_id").alias("at")).agg(F.count("*").cast("int").alias("times")).repartition(n, "sid")
    start = asked.select("sid").distinct()
    own = edges.filter("sid is not null").select("sid", "src", prefer("src_kind").alias("of_src"), "dst", prefer("dst_kind").alias("of_dst")).repartition(n, "sid").join(start, "sid", "left_semi")
    way = lambda a, b: F.struct(F.col(a).alias("at"), F.col(b).alias("to"), F.col(f"of_{b}").alias("prefer"))
    step = own.select("sid", F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("s")).select("sid", "s.at", "s.to", F.struct("s.prefer", F.col("s.to").alias("node")).alias("step")).distinct()
    front = start.withColumn("at", nz.node_id(F.lit("REPORTE"), F.col("sid"))).withColumn("way", F.array(F.struct(F.lit(0).alias("prefer"), F.col("at").alias("node"))))
    found = front.join(asked, ["sid", "at"])
    for _ in range(depth):
        grown = front.join(step, ["sid", "at"]).filter(~F.exists("way", lambda s: s["node"] == F.col("to")))
        front = grown.select("sid", F.col("to").alias("at"), F.concat("way", F.array("step")).alias("way")).groupBy("sid", "at").agg(F.min("way").alias("way"))
        found = found.unionByName(front.join(asked, ["sid", "at"]))
    # A datum that is reached again by a longer way is listed with the shortest; a way of each length is the least of its length.
    best = found.groupBy("sid", F.col("at").alias("node_id")).agg(F.min(F.struct(F.size("way").alias("size"), "way")).alias("w"), F.first("times").alias("times"))
    out = best.select("sid", "node_id", "w.size", "w.way", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return out.select("sid", "node_id", (F.col("size") - 1).alias("hops"), F.transform("way", lambda s: s["node"]).alias("path"))


def label(node: Column) -> Column:
    """A node id for people: kind in words, then the value."""
    return F.concat(nz.title(F.lower(F.translate(F.substring_index(node, "::", 1), "_", " "))), F.lit(" "), F.regexp_replace(node, "^[A-Z_]+::", ""))
