"""The engine's queries over the driver's tables: each operator bound to whole tables, with the SQL that checks it.

A report is an order. Its account is the customer, its device the part of its first line, its alias the order date, its
location the customer's nation. Nothing is sliced: pair caps, as everywhere but in all_cases, decide what is expanded. projection, components,
cases, degree_centrality and adamic_adar are bound by their SQL to links through accounts; their namesakes with ``_whole`` and
all other graph queries take the links of all kinds. phash_neighbours has its ``_whole`` for texts of under 64 words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import normalize as nz
from casegraph.functions import vocab
from casegraph.functions.textmine import mentions
from casegraph.operators import graph, linkage, review, similarity, views
from casegraph.operators.storage import parts, saved
from casegraph.sources import reports as source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# -- bindings ---------------------------------------------------------------------------------------------------------
def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    first = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("part"))
    # The join by order comes last: what is grouped by report afterwards is in its place, in parts of as many orders at any size.
    base = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    base = base.repartition(parts(spark, orders.count(), 250_000), "o_orderkey").join(first, "o_orderkey", "left")
    kinds = F.array(
        F.struct(F.lit("CUENTA").alias("kind"), F.col("o_custkey").cast("string").alias("value"), F.lit("custkey").alias("locator")),
        F.struct(F.lit("DISPOSITIVO").alias("kind"), F.col("part").cast("string").alias("value"), F.lit("partkey").alias("locator")),
        F.struct(F.lit("ALIAS").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), F.lit("orderdate").alias("locator")),
        F.struct(F.lit("UBICACION").alias("kind"), F.col("c_nationkey").cast("string").alias("value"), F.lit("nationkey").alias("locator")),
    )
    return base.select(F.col("o_orderkey").alias("sid"), F.explode(kinds).alias("k")).select("sid", "k.kind", "k.value", F.lit(False).alias("from_text"), "k.locator")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without locators, which no query reads, written once."""
    return saved(linkage.index(incidence(spark, sf_dir)).select("node_id", "kind", "sid", "text_only"))


def _scored(spark: SparkSession, sf_dir: str, idx: DataFrame | None = None, freq: DataFrame | None = None) -> DataFrame:
    idx = _index(spark, sf_dir) if idx is None else idx
    freq = saved(linkage.frequency(idx)) if freq is None else freq
    return linkage.score(linkage.firings(linkage.shared(idx, freq), table(spark, sf_dir, "orders").count()))


_CAP = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.PAIR_CAPS.items()) + f" ELSE {vocab.DEFAULT_CAP} END"
_DISC = "CASE WHEN df <= 10 THEN 1.0::DOUBLE ELSE greatest(0.15, least(1.0, ln(11.0) / ln(1.0 + df))) END"
_BASE = f"""
first AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1),
base AS (SELECT o_orderkey AS sid, o_custkey, part, strftime(o_orderdate, '%Y-%m-%d') AS d, c_nationkey FROM orders
         LEFT JOIN first ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
inc AS (SELECT sid, 'CUENTA' AS kind, o_custkey::VARCHAR AS value FROM base UNION ALL SELECT sid, 'DISPOSITIVO', part::VARCHAR FROM base
        UNION ALL SELECT sid, 'ALIAS', d FROM base UNION ALL SELECT sid, 'UBICACION', c_nationkey::VARCHAR FROM base),
idx AS (SELECT DISTINCT kind || '::' || lower(trim(value)) AS node_id, kind, sid FROM inc WHERE value IS NOT NULL),
freq AS (SELECT *, df * (df - 1) // 2 AS possible_pairs, {_CAP} AS cap FROM (SELECT node_id, kind, count(*) AS df FROM idx GROUP BY ALL)),
shared AS (SELECT x.node_id, x.kind, df, x.sid AS a, y.sid AS b FROM idx x JOIN idx y ON x.node_id = y.node_id AND x.sid < y.sid
           JOIN freq f ON f.node_id = x.node_id WHERE possible_pairs <= cap),
n AS (SELECT count(*) AS n FROM orders),
fired AS (SELECT a, b, CASE kind WHEN 'CUENTA' THEN 'R01_CUENTA' WHEN 'DISPOSITIVO' THEN 'R02_DISPOSITIVO' WHEN 'ALIAS' THEN 'R08_ALIAS' ELSE 'R09_UBICACION' END AS rule,
          round(CASE kind WHEN 'CUENTA' THEN 0.98::DOUBLE WHEN 'DISPOSITIVO' THEN 0.92::DOUBLE * {_DISC} WHEN 'ALIAS' THEN 0.22::DOUBLE * {_DISC} ELSE 0.08::DOUBLE * {_DISC} END, 4) AS weight,
          kind IN ('ALIAS', 'UBICACION') OR (kind <> 'CUENTA' AND (df >= 50 OR (n >= 200 AND df > 0.2 * n))) AS corr FROM shared, n),
scored AS (SELECT a, b, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, count(*) AS firings, bool_or(NOT corr) AS sustained,
           CASE WHEN bool_or(NOT corr) THEN round(least(1 - product(1 - least(weight, 0.99)), 0.99), 4) ELSE 0.0 END AS score FROM fired GROUP BY a, b),
links AS (SELECT a, b, rules, firings, score, CASE WHEN score >= 0.9 THEN 'alta' WHEN score >= 0.7 THEN 'media' ELSE 'baja' END AS band FROM scored WHERE sustained AND score >= 0.55)
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- linkage ----------------------------------------------------------------------------------------------------------
@query(f"WITH {_BASE} SELECT * FROM links")
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.links(_scored(spark, sf_dir))


@query(f"WITH {_BASE} SELECT a, b, rules, score, CASE WHEN NOT sustained THEN 'no_sostenido' ELSE 'bajo_umbral' END AS reason FROM scored WHERE NOT (sustained AND score >= 0.55)")
def links_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.discarded(_scored(spark, sf_dir))


@query(f"WITH {_BASE} SELECT node_id, kind, df, possible_pairs::BIGINT AS possible_pairs FROM freq")
def ident_index_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.frequency(linkage.index(incidence(spark, sf_dir))).select("node_id", "kind", "df", "possible_pairs")


@query(f"WITH {_BASE} SELECT DISTINCT a, b FROM shared")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = _index(spark, sf_dir)
    return linkage.shared(idx, linkage.frequency(idx)).select("a", "b").distinct()


@query(f"WITH {_BASE} SELECT node_id, kind, df, possible_pairs::BIGINT AS possible_pairs, cap::BIGINT AS cap, CASE WHEN kind IN ('ALIAS', 'UBICACION') THEN 'contexto_masivo' ELSE 'grupo_compacto' END AS policy FROM freq WHERE possible_pairs > cap")
def pair_caps_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.groups(linkage.frequency(linkage.index(incidence(spark, sf_dir))))


@query(f"""WITH {_BASE} SELECT a, b, score, 'POSIBLE_DUPLICADO_DE' AS relation FROM links JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b
WHERE rules LIKE '%R01_CUENTA%' AND x.o_orderpriority = y.o_orderpriority AND abs(epoch_us(x.o_orderdate) - epoch_us(y.o_orderdate)) / 3.6e9 <= 240""")
def possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_orderpriority").alias("platform"), F.col("o_orderdate").alias("ts"))
    return linkage.duplicates(linkage.links(_scored(spark, sf_dir)), reports, hours=240.0)


@query(f"""WITH {_BASE} SELECT band, count(*) AS links, round(min(score), 4) AS min_score, round(max(score), 4) AS max_score, round(avg(score), 4) AS avg_score FROM links GROUP BY band""")
def weights_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = linkage.links(_scored(spark, sf_dir))
    return s.groupBy("band").agg(F.count("*").alias("links"), F.round(F.min("score"), 4).alias("min_score"), F.round(F.max("score"), 4).alias("max_score"), F.round(F.avg("score"), 4).alias("avg_score"))


@query(f"""WITH {_BASE}, mine AS (SELECT sid FROM base JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0)
SELECT a, b, score FROM links WHERE a IN (SELECT sid FROM mine) OR b IN (SELECT sid FROM mine)""")
def case_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with either end in a case: the orders of one region's customers."""
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    mine = table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")
    flag = lambda s: mine.select(F.col("o_orderkey").alias(s), F.lit(True).alias(f"in_{s}"))
    s = linkage.links(_scored(spark, sf_dir))
    return s.join(flag("a"), "a", "left").join(flag("b"), "b", "left").filter("in_a or in_b").select("a", "b", "score")


# -- reviewed graph ---------------------------------------------------------------------------------------------------
def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual links: each customer's first and last order."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    return o.filter("a < b").select("a", "b")


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links through accounts alone, as _GRAPH has them: a clique for each customer. The whole graph is _whole()."""
    idx = linkage.index(incidence(spark, sf_dir).filter("kind = 'CUENTA'"))
    return linkage.score(linkage.firings(linkage.shared(idx, linkage.frequency(idx)), table(spark, sf_dir, "orders").count()))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.projection(_accounts(spark, sf_dir), _manual(spark, sf_dir))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection of the scored links of all kinds and of manual ones."""
    return graph.projection(linkage.links(_scored(spark, sf_dir)), _manual(spark, sf_dir))


def _reach(spark: SparkSession, sf_dir: str, links: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Components of the whole graph, from links that span them, and its links if asked for."""
    idx = _index(spark, sf_dir)
    freq = saved(linkage.frequency(idx))
    manual = _manual(spark, sf_dir)
    some = linkage.spanning(idx, freq, table(spark, sf_dir, "orders").count()).union(manual)
    return graph.components(some), graph.projection(linkage.links(_scored(spark, sf_dir, idx, freq)), manual) if links else None


def _compact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole graph without a row for each link: components, links of pairs of their own, groups that are linked throughout."""
    idx = _index(spark, sf_dir)
    whole, scored = linkage.compact(idx, saved(linkage.frequency(idx)), table(spark, sf_dir, "orders").count())
    links = saved(graph.projection(linkage.links(scored), _manual(spark, sf_dir)))
    stars = whole.select(F.col("at")[0].alias("a"), F.explode("at").alias("b")).filter("a <> b")
    return graph.components(stars.union(links.select("a", "b"))), links, whole


_GRAPH = f"""{_BASE}, manual AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey HAVING min(o_orderkey) < max(o_orderkey)),
proj AS (SELECT a, b, CASE WHEN bool_or(m) THEN 0.99 ELSE max(w) END AS weight, bool_or(m) AS manual FROM
 (SELECT a, b, 0.98::DOUBLE AS w, false AS m FROM shared WHERE kind = 'CUENTA' UNION ALL SELECT a, b, 0.99::DOUBLE, true FROM manual) GROUP BY a, b),
comp AS (SELECT sid AS v, min(sid) OVER (PARTITION BY o_custkey) AS label, count(*) OVER (PARTITION BY o_custkey) AS n FROM base)"""


@query(f"WITH {_GRAPH} SELECT a, b, weight::DOUBLE AS weight, manual FROM proj")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.projection(_accounts(spark, sf_dir), _manual(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT v, label FROM comp WHERE n > 1")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_graph(spark, sf_dir))


@query(f"""WITH {_GRAPH} SELECT label AS first_report, max(n) AS reports, count(*) AS links, round(min(weight), 3)::DOUBLE AS min_weight, round(max(weight), 3)::DOUBLE AS max_weight
FROM proj JOIN comp ON v = a GROUP BY label""")
def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _graph(spark, sf_dir)
    return graph.cases(graph.components(links), links)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"))


@query(f"WITH {_GRAPH}, e AS (SELECT a AS v FROM proj UNION ALL SELECT b FROM proj) SELECT o_orderkey AS v, count(v) AS degree, round(count(v) / ((SELECT count(*) FROM orders) - 1)::DOUBLE, 6) AS centrality FROM orders LEFT JOIN e ON v = o_orderkey GROUP BY o_orderkey")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return graph.degree(_graph(spark, sf_dir), o.count(), o)


@query()
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, links, whole = _compact(spark, sf_dir)
    return graph.pagerank(links, _orders(spark, sf_dir), labels=labels, whole=whole)


@query()
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, links = _reach(spark, sf_dir, links=True)
    return graph.bridges(links, labels=labels)


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    labels, links, whole = _compact(spark, sf_dir)
    return graph.betweenness(links, o.count(), vertices=o, labels=labels, whole=whole)


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, links, whole = _compact(spark, sf_dir)
    return graph.communities(links, labels=labels, whole=whole)


@query(f"WITH {_GRAPH}, s AS (SELECT a, b, df FROM shared ANTI JOIN proj USING (a, b)) SELECT a, b, round(sum(1 / ln(greatest(df, 2))), 4) AS score, count(*) AS shared FROM s GROUP BY a, b ORDER BY score DESC, a, b LIMIT 15")
def adamic_adar(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = _index(spark, sf_dir)
    return graph.adamic_adar(linkage.shared(idx, linkage.frequency(idx)), graph.projection(_accounts(spark, sf_dir), _manual(spark, sf_dir)))


# The whole graph: what the five account-only queries above answer, over the links of all kinds.
_WHOLE = f"""{_BASE}, manual AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey HAVING min(o_orderkey) < max(o_orderkey)),
proj AS (SELECT a, b, CASE WHEN bool_or(m) THEN 0.99 ELSE max(w) END::DOUBLE AS weight, bool_or(m) AS manual FROM
 (SELECT a, b, score AS w, false AS m FROM links WHERE score >= {vocab.CLUSTER} UNION ALL SELECT a, b, 0.99::DOUBLE, true FROM manual) GROUP BY a, b),
e AS (SELECT a, b FROM proj UNION ALL SELECT b, a FROM proj)"""
_REACH = f"""WITH RECURSIVE {_WHOLE}, comp(v, label) USING KEY (v) AS (SELECT a AS v, least(a, min(b)) AS label FROM e GROUP BY a
 UNION SELECT e.b, min(c.label) FROM comp c JOIN e ON e.a = c.v JOIN recurring.comp r ON r.v = e.b WHERE c.label < r.label GROUP BY e.b)"""


@query(f"WITH {_WHOLE} SELECT a, b, weight, manual FROM proj")
def projection_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir)


@query(f"{_REACH} SELECT v, label FROM comp")
def components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reach(spark, sf_dir)[0]


@query(f"""{_REACH}, sizes AS (SELECT label, count(*) AS reports FROM comp GROUP BY 1)
SELECT label AS first_report, any_value(reports) AS reports, count(*) AS links, round(min(weight), 3) AS min_weight, round(max(weight), 3) AS max_weight FROM proj JOIN comp ON v = a JOIN sizes USING (label) GROUP BY label""")
def cases_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cases(*_reach(spark, sf_dir, links=True))


@query(f"WITH {_WHOLE} SELECT o_orderkey AS v, count(a) AS degree, round(count(a) / ((SELECT count(*) FROM orders) - 1)::DOUBLE, 6) AS centrality FROM orders LEFT JOIN e ON a = o_orderkey GROUP BY o_orderkey")
def degree_centrality_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return graph.degree(_whole(spark, sf_dir), o.count(), o)


@query(f"""{_REACH.replace(" WHERE possible_pairs <= cap)", ")")}, sizes AS (SELECT label, count(*) AS reports FROM comp GROUP BY 1), l AS (SELECT label, count(*) AS links FROM proj JOIN comp ON v = a GROUP BY 1),
named AS (SELECT 'L' || lpad(no::VARCHAR, greatest(3, length(no::VARCHAR))::INT, '0') AS "case", label, reports, links FROM (SELECT *, row_number() OVER (ORDER BY reports DESC, label) AS no FROM sizes JOIN l USING (label)))
SELECT "case", label AS first_report, reports, links FROM named UNION ALL SELECT 'R' || o_orderkey, o_orderkey, 1, 0 FROM orders ANTI JOIN comp ON v = o_orderkey""")
def all_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by number, orders without links as cases of one; no identifier has a cap here."""
    idx, manual = _index(spark, sf_dir), _manual(spark, sf_dir)
    span, pairs, blocks, members = linkage.uncapped(idx, saved(linkage.frequency(idx)), table(spark, sf_dir, "orders").count())
    links = graph.projection(pairs, manual)
    labels = graph.components(span.union(manual))
    return graph.all_cases(labels, links, _orders(spark, sf_dir).withColumnRenamed("v", "sid"), graph.Implied(blocks, members, links))[0].select("case", "first_report", "reports", "links")


_PATH = "path AS (SELECT l_orderkey AS a, l_orderkey + 1 AS b FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 100 <> 0) WHERE l_orderkey + 1 IN (SELECT o_orderkey FROM orders))"


@query(f"WITH {_PATH}, v AS (SELECT a AS v FROM path UNION SELECT b FROM path), s AS (SELECT v, CASE WHEN v - 1 IN (SELECT a FROM path) THEN 0 ELSE 1 END AS first FROM v) SELECT v, max(CASE WHEN first = 1 THEN v END) OVER (ORDER BY v) AS label FROM s")
def components_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of long paths (orders of neighbouring numbers, cut at each hundredth), where labels must travel far."""
    o = _orders(spark, sf_dir)
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a")).distinct().filter("a % 100 <> 0").withColumn("b", F.col("a") + 1)
    return graph.components(a.join(o.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b"))


@query(f"""WITH {_WHOLE}, known AS (SELECT a, b FROM links UNION SELECT a, b FROM manual), s AS (SELECT a, b, df FROM shared ANTI JOIN known USING (a, b))
SELECT a, b, round(sum(1 / ln(greatest(df, 2))), 4) AS score, count(*) AS shared FROM s GROUP BY a, b ORDER BY score DESC, a, b LIMIT 15""")
def adamic_adar_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without any link, proposed ones under the cluster threshold included."""
    idx = _index(spark, sf_dir)
    known = linkage.links(_scored(spark, sf_dir)).select("a", "b").union(_manual(spark, sf_dir))
    return graph.adamic_adar(linkage.shared(idx, linkage.frequency(idx)), known)


@query("""WITH first AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1)
SELECT o_orderkey AS sid, (o_custkey IS NOT NULL)::BIGINT + (part IS NOT NULL)::BIGINT + (o_orderdate IS NOT NULL)::BIGINT AS identifiers,
 (o_custkey IS NOT NULL)::BIGINT + (part IS NOT NULL)::BIGINT + (o_orderdate IS NOT NULL)::BIGINT > 0 AS linkable FROM orders LEFT JOIN first ON l_orderkey = o_orderkey""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, devices and aliases count as identifiers, places don't."""
    inc = incidence(spark, sf_dir).filter("value is not null")
    node = nz.node_id(F.col("kind"), F.col("value"))
    one = lambda kind, value: [F.lit(None).cast("string").alias(f"{kind}{x}") for x in ("", "_kind", "_value")] if value is None else [value.alias(kind), F.col("kind").alias(f"{kind}_kind"), F.col("value").alias(f"{kind}_value")]
    edges = inc.select(*one("src", None), *one("dst", node), "sid", F.lit("observada").alias("origin"), F.lit("USA").alias("relation"), "locator", F.lit("").alias("method"), F.lit("").alias("version"))
    about = _orders(spark, sf_dir).select(F.col("v").alias("sid"), *[F.lit(None).cast("string").alias(c) for c in ("platform", "state", "motive")])
    return views.coverage(edges, about).select("sid", "identifiers", "linkable")


@query("""SELECT o_orderkey::VARCHAR AS v, node, hops, path FROM (
SELECT o_orderkey, 'o' || o_orderkey AS v, 'o' || o_orderkey AS node, 0 AS hops, 'o' || o_orderkey AS path FROM orders
UNION ALL SELECT o_orderkey, '', 'c' || o_custkey, 1, 'o' || o_orderkey || ' > c' || o_custkey FROM orders
UNION ALL SELECT o_orderkey, '', 'n' || c_nationkey, 2, 'o' || o_orderkey || ' > c' || o_custkey || ' > n' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT o_orderkey, '', 'r' || n_regionkey, 3, 'o' || o_orderkey || ' > c' || o_custkey || ' > n' || c_nationkey || ' > r' || n_regionkey
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""".replace("o_orderkey::VARCHAR AS v", "'o' || o_orderkey AS v"))
def provenance_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    name = lambda p, x: F.concat(F.lit(p), F.col(x))
    edges = o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))
    edges = edges.union(c.select(name("c", "c_custkey"), name("n", "c_nationkey"))).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).distinct()
    return graph.paths(edges, o.select(name("o", "o_orderkey").alias("v")))


# -- review -----------------------------------------------------------------------------------------------------------
_DECISION = "CASE event_type WHEN 'purchase' THEN 'validada' WHEN 'error' THEN 'rechazada' ELSE 'en_revision' END"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions on an edge: user and key."""
    key = F.concat(F.lit("e_"), F.col("user_id"), F.lit("_"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("secuencia"), key.alias("arista_id"), F.expr(_DECISION).alias("decision"))


_LEDGER = f"ledger AS (SELECT event_id AS secuencia, 'e_' || user_id || '_' || json_extract_string(props, '$.k') AS arista_id, {_DECISION} AS decision FROM events), last AS (SELECT arista_id, arg_max(decision, secuencia) AS decision, count(*) AS decisions, max(secuencia) AS last FROM ledger GROUP BY 1)"
_EDGES = "edges AS (SELECT 'e_' || c_custkey % 200 || '_' || c_nationkey AS arista_id, CASE WHEN bool_or(c_acctbal > 0) THEN 'inferida' ELSE 'derivada' END AS origin, round(max(c_acctbal) / 10000, 4) AS confidence FROM customer GROUP BY 1)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("e_"), F.col("c_custkey") % 200, F.lit("_"), F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").groupBy(key.alias("arista_id")).agg(F.when(F.bool_or(F.col("c_acctbal") > 0), "inferida").otherwise("derivada").alias("origin"), F.round(F.max("c_acctbal") / 10000, 4).alias("confidence"))


@query(f"WITH {_LEDGER} SELECT * FROM last")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_decision(_ledger(spark, sf_dir), "arista_id", "secuencia")


@query(f"WITH {_LEDGER}, {_EDGES} SELECT last.* FROM last ANTI JOIN edges USING (arista_id)")
def ledger_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.orphans(ledger_latest(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_LEDGER}, {_EDGES} SELECT arista_id, origin, confidence, coalesce(decision, 'pendiente') AS state, coalesce(decision, '') <> 'rechazada' AS current FROM edges LEFT JOIN last USING (arista_id)")
def review_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply(_edges(spark, sf_dir), ledger_latest(spark, sf_dir))


@query(f"WITH {_LEDGER}, {_EDGES} SELECT arista_id, origin, confidence FROM edges LEFT JOIN last USING (arista_id) WHERE decision IS NULL")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.queue(review_split(spark, sf_dir)).select("arista_id", "origin", "confidence")


_BOOK = """raw AS (SELECT event_id AS seq, 'e_' || user_id AS edge, event_type AS decision FROM events),
loose AS (SELECT *, '{"arista_id": "' || edge || '", "decision": "' || decision || '", "prev_hash": "sha256:none", "secuencia": ' || seq || '}' AS body FROM raw),
own AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN 'sha256:tampered' ELSE 'sha256:' || sha256(body) END AS hash FROM loose),
linked AS (SELECT r.*, CASE WHEN r.seq % 3 = 0 AND o.hash IS NOT NULL THEN o.hash ELSE 'sha256:none' END AS prev FROM raw r LEFT JOIN own o ON o.seq = r.seq - 1),
book AS (SELECT seq, prev, 'sha256:' || sha256('{"arista_id": "' || edge || '", "decision": "' || decision || '", "prev_hash": "' || prev || '", "secuencia": ' || seq || '}') AS computed FROM linked),
kept AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'sha256:tampered' ELSE computed END AS hash FROM book)"""


@query(f"""WITH {_BOOK} SELECT x.seq AS secuencia, x.prev AS prev_hash, coalesce(y.hash, 'genesis') AS expected, x.hash, x.computed FROM kept x LEFT JOIN kept y ON y.seq = x.seq - 1
WHERE x.prev <> coalesce(y.hash, 'genesis') OR x.hash <> x.computed""")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken records of a ledger of events: each third names its predecessor's hash, each fifth was tampered with."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("secuencia"), F.concat(F.lit("e_"), "user_id").alias("edge"), F.col("event_type").alias("decision"))
    body = lambda prev: F.format_string('{"arista_id": "%s", "decision": "%s", "prev_hash": "%s", "secuencia": %d}', "edge", "decision", prev, "secuencia")
    kept = lambda text: F.when(F.col("secuencia") % 5 == 0, "sha256:tampered").otherwise(F.concat(F.lit("sha256:"), F.sha2(text, 256)))
    before = e.select((F.col("secuencia") + 1).alias("secuencia"), kept(body(F.lit("sha256:none"))).alias("before"))
    book = e.join(before, "secuencia", "left").withColumn("prev_hash", F.when((F.col("secuencia") % 3 == 0) & F.col("before").isNotNull(), F.col("before")).otherwise("sha256:none"))
    book = book.withColumn("record", body(F.col("prev_hash"))).withColumn("hash", kept(F.col("record")))
    return review.broken_chain(book.select("secuencia", "record", "prev_hash", "hash"))


def _alerts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Over the scored links: finished orders are archived, open ones active, others have no state; what lines bring."""
    o = table(spark, sf_dir, "orders")
    motive = F.element_at(F.array(*[F.lit(m) for m in MOTIVES]), (F.col("o_orderkey") % len(MOTIVES) + 1).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "Archivado").when(F.col("o_orderstatus") == "O", "en_analisis")
    about = o.select(F.col("o_orderkey").alias("sid"), state.alias("state"), motive.alias("motive"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "ip_atribuible").when(F.col("l_linestatus") == "O", "ubicacion_determinable")
    merit = about.filter(F.lower("state").isin(*vocab.ACTIVE) | F.col("priority").isin(*vocab.MERIT_PRIORITIES)).select("sid", F.lit("caso_con_merito").alias("kind"))
    brought = lines.select(F.col("l_orderkey").alias("sid"), kind.alias("kind")).filter("kind is not null").union(merit).distinct()
    return review.alerts(linkage.links(_scored(spark, sf_dir)), about, brought)


#: One motive that the rules don't know, and none, beside those they know.
MOTIVES = ("sin_datos_de_usuario", "no_atribuible_nat", "sin_archivos", "sin_ubicacion", "material_sin_relevancia", "otro", "")
# The reference's rule, written out: needs by motive; one step lower if the trigger is archived too; links of 0.70 and more.
_ALERTS = f"""WITH {_BASE}, st AS (SELECT o_orderkey AS sid, o_orderstatus AS s, o_orderpriority AS p,
 CASE o_orderkey % 7 WHEN 0 THEN 'sin_datos_de_usuario' WHEN 1 THEN 'no_atribuible_nat' WHEN 2 THEN 'sin_archivos' WHEN 3 THEN 'sin_ubicacion' WHEN 4 THEN 'material_sin_relevancia' WHEN 5 THEN 'otro' ELSE '_default' END AS motive FROM orders),
br AS (SELECT DISTINCT l_orderkey AS sid, CASE WHEN l_returnflag = 'R' THEN 'ip_atribuible' WHEN l_linestatus = 'O' THEN 'ubicacion_determinable' END AS kind FROM lineitem
 UNION SELECT sid, 'caso_con_merito' FROM st WHERE s = 'O' OR p LIKE '1%' OR p LIKE '2%'),
ends AS (SELECT a AS archived, b AS trigger, score FROM links WHERE score >= 0.7 UNION ALL SELECT b, a, score FROM links WHERE score >= 0.7),
r AS (SELECT archived, trigger, score, x.motive, y.s AS other, list_sort(coalesce(list(kind) FILTER (CASE x.motive
  WHEN 'sin_datos_de_usuario' THEN kind = 'identificador_atribuible' WHEN 'no_atribuible_nat' THEN kind IN ('identificador_atribuible', 'ip_atribuible') WHEN 'sin_archivos' THEN kind = 'evidencia_con_hash'
  WHEN 'sin_ubicacion' THEN kind IN ('ubicacion_determinable', 'ip_atribuible') WHEN 'material_sin_relevancia' THEN kind IN ('caso_con_merito', 'evidencia_con_hash')
  ELSE kind IN ('identificador_atribuible', 'evidencia_con_hash', 'ip_atribuible', 'caso_con_merito') END), [])) AS brings
  FROM ends JOIN st x ON x.sid = archived AND x.s = 'F' JOIN st y ON y.sid = trigger LEFT JOIN br ON br.sid = trigger GROUP BY archived, trigger, score, x.motive, y.s)
"""


@query(_ALERTS + """SELECT archived, trigger, motive, array_to_string(brings, ',') AS brings, score, CASE WHEN other = 'F' THEN CASE WHEN motive IN ('sin_datos_de_usuario', 'no_atribuible_nat', 'sin_archivos') THEN 'media' ELSE 'baja' END
 WHEN motive IN ('sin_datos_de_usuario', 'no_atribuible_nat', 'sin_archivos') THEN 'alta' ELSE 'media' END AS priority FROM r WHERE len(brings) > 0""")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir)[0].select("archived", "trigger", "motive", "brings", "score", "priority")


@query(_ALERTS + "SELECT archived, trigger, motive FROM r WHERE len(brings) = 0")
def alerts_silenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir)[1].select("archived", "trigger", "motive")


@query("SELECT 'CUENTA' AS kind, c_name AS value, 'CUENTA-' || row_number() OVER (ORDER BY c_custkey) AS label FROM customer UNION ALL SELECT 'ORGANIZACION', s_name, 'ORGANIZACION-' || row_number() OVER (ORDER BY s_suppkey) FROM supplier")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("CUENTA").alias("kind"), F.col("c_name").alias("value"), F.col("c_custkey").alias("order"))
    s = table(spark, sf_dir, "supplier").select(F.lit("ORGANIZACION").alias("kind"), F.col("s_name").alias("value"), F.col("s_suppkey").alias("order"))
    return review.pseudonyms(c.union(s))


# -- times and places ---------------------------------------------------------------------------------------------------
_HOURS = "CASE user_id % 3 WHEN 0 THEN 12 ELSE 24 END"


@query(f"""WITH o AS (SELECT (user_id * 31 + date_diff('day', DATE '2024-01-01', ts)) % 4000 AS ip, user_id AS sid, ts, {_HOURS} AS h FROM events),
few AS (SELECT ip, count(DISTINCT sid) AS df FROM o GROUP BY 1 HAVING count(DISTINCT sid) > 1 AND count(DISTINCT sid) * (count(DISTINCT sid) - 1) // 2 <= 2500),
w AS (SELECT ip, min(h) AS win FROM o GROUP BY 1),
best AS (SELECT x.ip, x.sid AS a, y.sid AS b, min(abs(epoch_us(x.ts) - epoch_us(y.ts)) / 3.6e9) AS hours FROM o x JOIN o y ON x.ip = y.ip AND x.sid < y.sid WHERE x.ip IN (SELECT ip FROM few) GROUP BY ALL)
SELECT ip, a, b, round(hours, 4) AS hours, win AS "window", CASE WHEN hours <= win THEN 'R06_IP_VENTANA' ELSE 'R07_IP_SUELTA' END AS rule FROM best JOIN w USING (ip)""")
def ip_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    o = e.select(((F.col("user_id") * 31 + F.datediff("ts", F.lit("2024-01-01").cast("date"))) % 4000).alias("ip"), F.col("user_id").alias("sid"), "ts", F.expr(_HOURS).alias("h"))
    return linkage.window_match(o, o.groupBy("ip").agg(F.min("h").alias("hours")))


_NAT = "json_extract_string(props, '$.k')::INT"


@query(f"""WITH c AS (SELECT (user_id * 31 + date_diff('day', DATE '2024-01-01', ts)) % 4000 AS ip, user_id AS sid, CASE WHEN event_type <> 'error' THEN ts END AS ts, {_HOURS} AS h,
 {_NAT} % 3 <> 0 AS port, {_NAT} % 4 = 0 AS nat, lpad(event_id::VARCHAR, 12, '0') AS locator FROM events),
idx AS (SELECT DISTINCT ip, sid FROM c), freq AS (SELECT ip, count(*) AS df FROM idx GROUP BY 1 HAVING count(*) * (count(*) - 1) // 2 <= {vocab.PAIR_CAPS["IP"]}),
n AS (SELECT count(DISTINCT sid) AS n FROM c), w AS (SELECT ip, min(h) AS win FROM c WHERE ip % 2 = 0 GROUP BY 1),
pairs AS (SELECT x.ip, x.sid AS a, y.sid AS b, df FROM idx x JOIN idx y ON x.ip = y.ip AND x.sid < y.sid JOIN freq f ON f.ip = x.ip),
best AS (SELECT p.ip, a, b, arg_min((abs(epoch_us(x.ts) - epoch_us(y.ts)) / 3.6e9, x.port AND y.port, x.nat OR y.nat), (abs(epoch_us(x.ts) - epoch_us(y.ts)), x.locator, y.locator)) AS m
 FROM pairs p JOIN c x ON x.ip = p.ip AND x.sid = a AND x.ts IS NOT NULL JOIN c y ON y.ip = p.ip AND y.sid = b AND y.ts IS NOT NULL GROUP BY p.ip, a, b),
f AS (SELECT p.*, m[2] AS ports, m[3] AS nat, coalesce(m[1] <= coalesce(win, {vocab.DEFAULT_HOURS}), false) AS near FROM pairs p LEFT JOIN best USING (ip, a, b) LEFT JOIN w ON w.ip = p.ip)
SELECT a, b, 'IP::' || ip AS node_id, CASE WHEN near THEN 'R06_IP_VENTANA' ELSE 'R07_IP_SUELTA' END AS rule,
 round(CASE WHEN near THEN 0.72::DOUBLE ELSE 0.28::DOUBLE END * CASE WHEN near AND nat THEN CASE WHEN ports THEN {vocab.NAT_WITH_PORT}::DOUBLE ELSE {vocab.NAT_WITHOUT_PORT}::DOUBLE END ELSE 1.0::DOUBLE END * {_DISC}, 4) AS weight,
 NOT near OR (nat AND NOT ports) OR df >= 50 OR (n >= 200 AND df > 0.2 * n) AS corroborates FROM f, n""")
def ip_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's own address rules over events: ports, proxies, captures without time, and windows known for half of the addresses."""
    k = F.get_json_object("props", "$.k").cast("int")
    ip = (F.col("user_id") * 31 + F.datediff("ts", F.lit("2024-01-01").cast("date"))) % 4000
    e = table(spark, sf_dir, "events").select(ip.cast("string").alias("value"), F.col("user_id").alias("sid"), F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"), F.expr(_HOURS).alias("h"), F.when(k % 3 != 0, k.cast("string")).alias("port"), (k % 4 == 0).alias("nat"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("locator"))
    c = saved(e.withColumn("node_id", nz.node_id(F.lit("IP"), F.col("value"))))
    idx = saved(linkage.index(c.select("sid", F.lit("IP").alias("kind"), "value", F.lit(False).alias("from_text"), "locator")))
    windows = c.filter(F.col("value").cast("int") % 2 == 0).groupBy("node_id").agg(F.min("h").alias("hours"))
    fired = linkage.ip_firings(linkage.shared(idx, linkage.frequency(idx)), c, windows, c.select("sid").distinct().count())
    return fired.select("a", "b", "node_id", "rule", "weight", "corroborates")


@query("""WITH p AS (SELECT user_id AS anchor, json_extract_string(props, '$.k')::INT AS ip, ts, event_id AS ord FROM events),
q AS (SELECT *, (ip * 37 % 180 - 90)::DOUBLE AS lat, (ip * 53 % 360 - 180)::DOUBLE AS lon FROM p),
n AS (SELECT *, lead(ip) OVER w AS i2, lead(ts) OVER w AS t2, lead(lat) OVER w AS la2, lead(lon) OVER w AS lo2, lead(ord) OVER w AS o2 FROM q WINDOW w AS (PARTITION BY anchor ORDER BY ts, ord)),
d AS (SELECT *, round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(la2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la2)) * pow(sin(radians(lo2 - lon) / 2), 2)))), 3) AS km, (epoch_us(t2) - epoch_us(ts)) / 3.6e9 AS h FROM n WHERE t2 IS NOT NULL AND ip <> i2)
SELECT anchor, ord AS from_ord, o2 AS to_ord, km, round(h, 4) AS hours FROM d WHERE h > 0 AND km >= 50 AND km / h > 900""")
def impossible_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("anchor"), k.alias("ip"), "ts", (k * 37 % 180 - 90).cast("double").alias("lat"), (k * 53 % 360 - 180).cast("double").alias("lon"), F.col("event_id").alias("ord"))
    return similarity.impossible_travel(e)


# -- extraction, normalisers, texts -------------------------------------------------------------------------------------
@query("SELECT 'e_' || substr(sha1('REPORTE::' || o_orderkey || '|CUENTA::' || o_custkey || '|USA_CUENTA|lectura|custkey|caso:' || o_orderkey), 1, 16) AS arista_id, o_orderkey FROM orders")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = nz.edge_id(nz.node_id(F.lit("REPORTE"), F.col("o_orderkey").cast("string")), nz.node_id(F.lit("CUENTA"), F.col("o_custkey").cast("string")), F.lit("USA_CUENTA"), F.lit("lectura"), F.lit("custkey"), F.concat(F.lit("caso:"), F.col("o_orderkey")))
    return o.select(key.alias("arista_id"), "o_orderkey")


@query("SELECT source, arg_min(lang, doc_id) AS value, coalesce(array_to_string(list_sort(list_filter(list(DISTINCT lang), lambda x: x <> f)), ','), '') AS variants FROM (SELECT *, first_value(lang) OVER (PARTITION BY source ORDER BY doc_id) AS f FROM documents) GROUP BY source, f")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.first_writer(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("SELECT 'USA_CUENTA' AS relation, count(DISTINCT (o_orderkey, o_custkey)) AS edges FROM orders UNION ALL SELECT 'USA_DISPOSITIVO', count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem UNION ALL SELECT 'UBICADO_EN', count(DISTINCT (s_suppkey, s_nationkey)) FROM supplier")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("orders", "o_orderkey", "o_custkey", "USA_CUENTA"), ("lineitem", "l_orderkey", "l_partkey", "USA_DISPOSITIVO"), ("supplier", "s_suppkey", "s_nationkey", "UBICADO_EN")]
    edges = None
    for t, u, v, r in parts:
        e = table(spark, sf_dir, t).select(F.lit(r).alias("relation"), F.col(u).cast("long").alias("src"), F.col(v).cast("long").alias("dst")).distinct()
        edges = e if edges is None else edges.unionByName(e)
    return edges.groupBy("relation").agg(F.count("*").alias("edges"))


@query(r"""WITH k AS (SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '\s+', ' ', 'g'), '[^\w\s@.-]', '', 'g') AS alias FROM customer),
f AS (SELECT *, regexp_replace(alias, '[\s._-]+', '', 'g') AS key FROM k) SELECT c_custkey, alias, CASE WHEN length(key) >= 4 AND regexp_matches(key, '[a-z]{2}') THEN key END AS alias_key FROM f""")
def normalize_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", nz.alias(F.col("c_name")).alias("alias"), nz.alias_key(F.col("c_name")).alias("alias_key"))


_MAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"


@query(rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS raw FROM documents),
e AS (SELECT *, lower(trim(raw)) AS t FROM m) SELECT doc_id, raw, CASE WHEN regexp_matches(t, '@(gmail|googlemail)\.com$') THEN replace(regexp_replace(split_part(t, '@', 1), '\+.*$', ''), '.', '') || '@gmail.com' ELSE t END AS email FROM e""")
def normalize_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("raw"))
    return m.select("doc_id", "raw", nz.email(F.col("raw")).alias("email"))


_PHONE = r"\+[0-9][0-9 ().-]{5,18}[0-9]"


@query(rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE}')) AS raw FROM documents), d AS (SELECT *, regexp_replace(raw, '\D', '', 'g') AS d FROM m),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(substr(d, 3), '^0', ''), '^9', ''), '^(11|2\d\d|3\d\d)15(\d+)$', '\1\2') AS n FROM d)
SELECT doc_id, raw, CASE WHEN NOT starts_with(d, '54') THEN '+' || d WHEN length(n) BETWEEN 8 AND 11 THEN '+54' || n END AS phone FROM n""")
def normalize_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PHONE), F.lit(0))).alias("raw"))
    return m.select("doc_id", "raw", nz.phone(F.col("raw")).alias("phone"))


_QUAD = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


@query(rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_QUAD}')) AS raw FROM documents), p AS (SELECT *, list_transform(string_split(raw, '.'), lambda x: x::BIGINT) AS o FROM m),
n AS (SELECT doc_id, raw, CASE WHEN list_max(o) <= 255 AND NOT regexp_matches(raw, '(^|\.)0[0-9]') THEN o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] END AS number FROM p)
SELECT doc_id, raw, number, number BETWEEN 1681915904 AND 1686110207 AS cgnat FROM n""")
def normalize_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_QUAD), F.lit(0))).alias("raw"))
    n = m.withColumn("number", nz.ipv4_number(F.col("raw")))
    return n.withColumn("cgnat", F.col("number").between(1681915904, 1686110207))


@query()
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole masking pipeline over texts and chat turns."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sid"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("sid"), "text")
    return mentions(d.union(c))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: a line for each turn, users as the reported side, profiles by turn."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", " ")
    line = F.concat(F.lit("[2026-01-01] "), F.when(F.col("role") == "user", "Reported User").otherwise("Other User"), F.lit(" (Profile P"), (F.col("turn") % 3).cast("string"), F.lit("): "), said)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("t"))
    return turns.select(F.col("conv_id").cast("string").alias("reportId"), F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))


_TURNS = "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no FROM conversations)"


@query("""WITH t AS (SELECT conv_id, turn % 3 AS p, arg_min(role, turn) AS role, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id::VARCHAR AS conv_id, 'P' || p AS profile, CASE WHEN role = 'user' THEN 'Reported User' ELSE 'Other User' END AS role FROM t""")
def chat_profiles_first_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _transcripts(spark, sf_dir).withColumn("event", F.col("reportId")).withColumn("locator", F.lit("n")).withColumn("esp", F.lit("Plaza"))
    # Texts could name profiles themselves; only the headers are left here.
    notes = notes.withColumn("text", F.regexp_replace("text", r"(?m)(\(Profile P\d\): ).*$", "$1"))
    return source.chat_profiles(notes).select(F.col("reportId").alias("conv_id"), F.col("id").alias("profile"), "role")


@query(rf"""WITH {_TURNS} SELECT conv_id::VARCHAR AS conv_id, 'n#linea=' || no AS locator, length(regexp_replace(coalesce(text, ''), '^\s+', '')) AS characters FROM t WHERE role = 'user'""")
def reported_lines_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _transcripts(spark, sf_dir).select("reportId", F.lit("transcripcion_chat").alias("kind"), F.lit("n").alias("locator"), "text")
    return similarity.reported_lines(texts).select(F.col("reportId").alias("conv_id"), "locator", F.length("text").cast("long").alias("characters"))


@query("SELECT 'sha256:' || sha256(text) AS text_id, 'documents/' || doc_id AS locator, length(text) AS characters FROM documents WHERE text IS NOT NULL")
def restricted_text_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("text_id"), F.concat(F.lit("documents/"), F.col("doc_id")).alias("locator"), F.length("text").cast("long").alias("characters"))


@query("SELECT sha256(text) AS value, count(*) AS members, count(DISTINCT source) AS sources, min(doc_id) AS first_sid FROM documents GROUP BY 1 HAVING count(*) > 1")
def evidence_same_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.same_evidence(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("value"), "source", F.col("doc_id").alias("sid")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: two of one evidence each, a report for each, language and length as the fingerprint of sound."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("reportId"), F.col("doc_id").alias("ord"), F.concat(F.lit("e"), F.floor(F.col("doc_id") / 2)).alias("evidence"), F.concat(F.lit("documents["), "doc_id", F.lit("]")).alias("locator"), F.lit(None).cast("string").alias("phash"), F.lit(None).cast("long").alias("hash"), F.concat_ws("-", "lang", "n_chars").alias("audio"))


@query(f"""WITH f AS (SELECT doc_id, 'e' || (doc_id // 2) AS e, concat_ws('-', lang, n_chars) AS audio FROM documents), few AS (SELECT audio FROM f GROUP BY audio HAVING count(*) * (count(*) - 1) // 2 <= {vocab.PAIR_CAPS['HUELLA_AUDIO']})
SELECT x.e AS evidence_a, y.e AS evidence_b, 'documents[' || x.doc_id || '].details.audio_fingerprint | documents[' || y.doc_id || '].details.audio_fingerprint' AS locator, 0.86::DOUBLE AS confidence
FROM f x JOIN f y ON x.audio = y.audio AND x.doc_id < y.doc_id AND x.e <> y.e WHERE x.audio IN (SELECT audio FROM few)""")
def audio_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files of one fingerprint in different reports and evidences; too frequent fingerprints stay groups."""
    return similarity.equal_audio(_files(spark, sf_dir))[0].select(F.col("src_value").alias("evidence_a"), F.col("dst_value").alias("evidence_b"), "locator", "confidence")


@query("""WITH f AS (SELECT doc_id, 'e' || (doc_id // 2) AS e, concat_ws('-', lang, n_chars) AS audio FROM documents), n AS (SELECT audio, count(*) AS files, count(DISTINCT doc_id) AS reports, count(DISTINCT e) AS evidences FROM f GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT x.audio, count(*) AS pairs FROM f x JOIN f y ON x.audio = y.audio AND x.doc_id < y.doc_id AND x.e <> y.e GROUP BY 1) SELECT n.*, coalesce(pairs, 0)::BIGINT AS pairs FROM n LEFT JOIN p USING (audio)""")
def audio_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fingerprint of several files with the exact number of its edges, of any size."""
    return similarity.equal_audio(_files(spark, sf_dir))[1].select("audio", "files", "reports", "evidences", "pairs")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), h AS (SELECT doc_id, w FROM w WHERE len(w) >= 64),
u AS (SELECT doc_id, unnest(w) AS x, (unnest(generate_series(1, len(w))) - 1) % 64 AS bit FROM h),
p AS (SELECT doc_id, bit, sum(length(x)) % 2 AS b FROM u GROUP BY ALL),
f AS (SELECT doc_id, sum(CASE WHEN bit < 63 THEN b::HUGEINT << bit::INT ELSE -(b::HUGEINT << 63) END)::BIGINT AS hash FROM p GROUP BY 1),
g AS (SELECT hash, count(*) AS members, min(doc_id) AS first_sid FROM f GROUP BY 1)
SELECT x.hash AS hash_a, y.hash AS hash_b, bit_count(xor(x.hash, y.hash))::INT AS distance, round(1 - bit_count(xor(x.hash, y.hash)) / 64.0::DOUBLE, 4) AS similarity,
x.members AS members_a, y.members AS members_b, x.first_sid AS sid_a, y.first_sid AS sid_b FROM g x JOIN g y ON x.hash < y.hash WHERE bit_count(xor(x.hash, y.hash)) <= 8""")
def phash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit hash of whole texts: bit i is the parity of the lengths of words i, i + 64, i + 128, ..."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w")).filter(F.size("w") >= 64)
    bits = F.aggregate(F.transform("w", lambda x, i: F.when(F.length(x) % 2 == 1, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    return similarity.hash_neighbours(w.select(bits.alias("hash"), F.col("doc_id").alias("sid")))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
j AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w), 64) - 1)) AS j FROM w), u AS (SELECT doc_id, w[j % len(w) + 1] AS x, j % 64 AS bit FROM j),
p AS (SELECT doc_id, bit, sum(length(x)) % 2 AS b FROM u GROUP BY ALL),
f AS (SELECT doc_id, sum(CASE WHEN bit < 63 THEN b::HUGEINT << bit::INT ELSE -(b::HUGEINT << 63) END)::BIGINT AS hash FROM p GROUP BY 1),
g AS (SELECT hash, count(*) AS members, min(doc_id) AS first_sid FROM f GROUP BY 1)
SELECT x.hash AS hash_a, y.hash AS hash_b, bit_count(xor(x.hash, y.hash))::INT AS distance, round(1 - bit_count(xor(x.hash, y.hash)) / 64.0::DOUBLE, 4) AS similarity,
x.members AS members_a, y.members AS members_b, x.first_sid AS sid_a, y.first_sid AS sid_b FROM g x JOIN g y ON x.hash < y.hash WHERE bit_count(xor(x.hash, y.hash)) <= 8""")
def phash_neighbours_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phash_neighbours over all texts: one of under 64 words is repeated up to 64, so that a word weighs several bits.

    An empty text hashes to 0; null has no hash.
    """
    w = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    w = w.withColumn("w", F.when(F.size("w") >= 64, F.col("w")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.get(F.col("w"), j % F.size("w")))))
    bits = F.aggregate(F.transform("w", lambda x, i: F.when(F.length(x) % 2 == 1, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    return similarity.hash_neighbours(w.select(bits.alias("hash"), F.col("doc_id").alias("sid")))


#: An invented place lexicon on words that the synthetic prose has.
PLACES = {"estructura:the": ("estructura", ("blend", "onand")), "rasgo:con": ("rasgo", ("hened", "anat")), "referencia:und": ("referencia", ("esand", "edth")), "color:pour": ("color", ("thwh", "oner")), "acceso:shed": ("acceso", ("rely", "ofof"))}
_TAGS = " UNION ALL ".join(f"SELECT doc_id AS sid, '{t}' AS tag, '{d}' AS dimension FROM documents WHERE regexp_matches(lower(text), '(^|[^\\w\\p{{L}}])({'|'.join(f)})([^\\w\\p{{L}}]|$)')" for t, (d, f) in PLACES.items())


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.place_tags(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), "text"), PLACES)


@query(_TAGS)
def place_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir)


@query(f"""WITH t AS ({_TAGS}), w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in vocab.PLACE_WEIGHTS.items())}) x(dimension, weight)),
p AS (SELECT sid, list_sort(list(tag)) AS tags, list(DISTINCT dimension) AS dims FROM t GROUP BY sid), c AS (SELECT tags, any_value(dims) AS dims, count(*) AS members, min(sid) AS sid FROM p GROUP BY tags),
m AS (SELECT x.sid AS sid_a, y.sid AS sid_b, x.members AS members_a, y.members AS members_b, list_intersect(x.dims, y.dims) AS common, list_distinct(list_concat(x.dims, y.dims)) AS every FROM c x JOIN c y ON x.sid < y.sid),
s AS (SELECT *, round((SELECT sum(weight) FROM w WHERE list_contains(common, dimension)) / (SELECT sum(weight) FROM w WHERE list_contains(every, dimension)), 4) AS score FROM m)
SELECT sid_a, sid_b, members_a, members_b, score FROM s WHERE len(common) >= 2 AND list_has_any(common, ['estructura', 'rasgo', 'referencia']) AND score >= 0.45""")
def place_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.place_similarity(_tags(spark, sf_dir))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as mentions; nation and market segment as the account they use."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("mention"), F.concat_ws("/", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500)).alias("account"))


_MENTIONS = "ment AS (SELECT c_custkey AS mention, concat_ws('/', c_nationkey, c_mktsegment, floor(c_acctbal / 500)::BIGINT) AS account FROM customer), star AS (SELECT min(mention) OVER (PARTITION BY account) AS a, mention AS b, account FROM ment)"


@query(f"WITH {_MENTIONS} SELECT x.mention AS a, y.mention AS b, x.account FROM ment x JOIN ment y ON x.account = y.account AND x.mention < y.mention")
def identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.identity_pairs(_mentions(spark, sf_dir))


@query(f"WITH {_MENTIONS} SELECT 'id-' || substr(sha256(string_agg(b::VARCHAR, '|' ORDER BY b::VARCHAR)), 1, 16) AS identity, count(*) AS mentions, min(b) AS first_mention FROM star GROUP BY account HAVING count(*) > 1")
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = graph.components(similarity.identity_pairs(_mentions(spark, sf_dir)).select("a", "b"))
    name = F.concat(F.lit("id-"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("v").cast("string"))), "|"), 256), 1, 16))
    return labels.groupBy("label").agg(name.alias("identity"), F.count("*").alias("mentions"), F.min("v").alias("first_mention")).drop("label")
