"""Queries that bind the operators of the whole run (edges, evidence, identities, dossier, pseudonyms) to whole tables.

A report is an order, with a person of its own who uses the customer's account; the account has the part of the order's first
line as its device and the customer's nation as its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import vocab
from casegraph.operators import dossier, identity, linkage, pseudonyms, review, views
from casegraph.operators.storage import saved
from casegraph.plans.queries import _BASE, _manual, _scored, incidence, query, table
from casegraph.sources import reports as source


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = incidence(spark, sf_dir).groupBy("sid").pivot("kind", ["CUENTA", "DISPOSITIVO", "UBICACION"]).agg(F.first("value"))
    return wide.select(F.col("sid").cast("string").alias("reportId"), F.col("CUENTA").alias("account"), F.col("DISPOSITIVO").alias("device"), F.col("UBICACION").alias("place"))


def run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as the run has them. They aren't written: each query computes the columns that it reads, from a table of reports."""
    r = saved(_reports(spark, sf_dir))
    person, account = ("PERSONA_MENCION", F.concat_ws("/", "reportId", F.col("account"))), ("CUENTA", F.col("account"))
    known = r.filter("account is not null")
    out = [
        source.edge(known, person, ("REPORTE", F.col("reportId")), "REPORTADO_EN", F.lit("order"), "lectura"),
        source.edge(known, person, account, "USA_CUENTA", F.lit("custkey"), "lectura"),
        source.edge(r, account, ("DISPOSITIVO", F.col("device")), "USA_DISPOSITIVO", F.lit("partkey"), "lectura"),
        source.edge(r, account, ("UBICACION", F.col("place")), "UBICADO_EN", F.lit("nationkey"), "lectura"),
    ]
    return source.single(source.together(out))


_ED = f"""{_BASE}, ob AS (SELECT sid::VARCHAR AS sid, o_custkey::VARCHAR AS c, part::VARCHAR AS p, c_nationkey::VARCHAR AS n FROM base WHERE o_custkey IS NOT NULL),
ed AS (SELECT sid, 'PERSONA_MENCION' AS sk, sid || '/' || c AS sv, 'REPORTE' AS dk, sid AS dv, 'REPORTADO_EN' AS relation, 'order' AS locator FROM ob
 UNION ALL SELECT sid, 'PERSONA_MENCION', sid || '/' || c, 'CUENTA', c, 'USA_CUENTA', 'custkey' FROM ob
 UNION ALL SELECT sid, 'CUENTA', c, 'DISPOSITIVO', p, 'USA_DISPOSITIVO', 'partkey' FROM ob WHERE p IS NOT NULL
 UNION ALL SELECT sid, 'CUENTA', c, 'UBICACION', n, 'UBICADO_EN', 'nationkey' FROM ob WHERE n IS NOT NULL),
en AS (SELECT sid, relation, locator, sk AS kind, sv AS value, sk || '::' || sv AS node_id FROM ed UNION ALL SELECT sid, relation, locator, dk, dv, dk || '::' || dv FROM ed)"""


def _nodes(edges: DataFrame) -> DataFrame:
    return views.ends(edges).select("node_id", "kind", "value").distinct()


# -- edges and nodes ----------------------------------------------------------------------------------------------------
@query(f"""WITH {_ED}, o AS (SELECT *, CASE relation {' '.join(f"WHEN '{r}' THEN '{vocab.ORIGIN[r]}'" for r in ('REPORTADO_EN', 'USA_CUENTA', 'USA_DISPOSITIVO', 'UBICADO_EN'))} END AS origin FROM ed)
SELECT 'node' AS what, kind AS name, count(DISTINCT node_id) AS n FROM en GROUP BY kind UNION ALL SELECT 'origin', origin, count(*) FROM o GROUP BY origin UNION ALL SELECT 'relation', relation, count(*) FROM o GROUP BY relation""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = run_edges(spark, sf_dir)
    return views.summary(_nodes(edges), edges)


_FACT = lambda c: f"SELECT source, '{c}' AS fact, arg_min({c}::VARCHAR, doc_id) AS value, list_sort(list(DISTINCT {c}::VARCHAR)) AS every FROM documents WHERE source IS NOT NULL AND {c} IS NOT NULL GROUP BY source"


@query(f"WITH f AS ({_FACT('lang')} UNION ALL {_FACT('n_chars')}) SELECT 'FUENTE::' || source AS node_id, fact, value, array_to_string(list_filter(every, lambda x: x <> value), ',') AS variants FROM f")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the first value of each fact and the later different ones."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    facts = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string")), lambda _, v: v.isNotNull())
    made = source.merged(d.select(F.concat(F.lit("FUENTE::"), "source").alias("node_id"), F.lit("FUENTE").alias("kind"), F.col("source").alias("value"), facts.alias("facts"), F.col("doc_id").alias("ord")))
    each = made.select("node_id", "variants", F.explode("attrs").alias("fact", "value"))
    return each.select("node_id", "fact", "value", F.coalesce(F.array_join(F.try_element_at("variants", F.col("fact")), ","), F.lit("")).alias("variants"))


@query(f"WITH {_ED} SELECT node_id, kind, count(DISTINCT sid) AS reports FROM en WHERE kind <> 'REPORTE' GROUP BY ALL")
def entity_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = run_edges(spark, sf_dir)
    nodes = saved(_nodes(edges))
    return views.entities(nodes, views.reports_of(nodes, edges)).select("node_id", "kind", "reports")


@query(f"WITH {_ED} SELECT DISTINCT 'C' || (sid::BIGINT % 97) AS \"case\", node_id FROM en")
def case_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of cases, here classes of order numbers."""
    edges = run_edges(spark, sf_dir)
    members = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_orderkey") % 97).alias("case"), F.col("o_orderkey").cast("string").alias("sid"))
    return views.in_case(views.reports_of(_nodes(edges), edges), members)


@query(f"""WITH {_ED}, k AS (SELECT sid, kind AS type, value, locator, CASE WHEN relation = 'USA_CUENTA' AND kind = 'CUENTA' OR relation = 'USA_DISPOSITIVO' AND kind = 'DISPOSITIVO' THEN 'identificador_atribuible' WHEN kind = 'UBICACION' THEN 'ubicacion_determinable' END AS kind FROM en)
SELECT sid, kind, type, value, min(locator) AS locator FROM k WHERE kind IS NOT NULL GROUP BY ALL
UNION ALL SELECT o_orderkey::VARCHAR, 'caso_con_merito', 'REPORTE', o_orderkey::VARCHAR, 'estado_institucional' FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority[1] IN ('1', '2')""")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sid"), F.when(F.col("o_orderstatus") == "O", "en_analisis").otherwise("archivado").alias("state"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    return review.contributions(run_edges(spark, sf_dir), about)


@query(f"WITH {_ED} SELECT sid, 'UBICACION::' || n AS node_id, 3 AS hops, 'REPORTE::' || sid || ' > PERSONA_MENCION::' || sid || '/' || c || ' > CUENTA::' || c || ' > UBICACION::' || n AS path FROM ob WHERE n IS NOT NULL")
def report_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each report reaches its place."""
    edges = run_edges(spark, sf_dir)
    wanted = edges.filter("relation = 'UBICADO_EN'").select("sid", F.col("dst").alias("node_id"))
    return views.paths(edges, wanted).withColumn("path", F.array_join("path", " > "))


@query(f"""WITH {_ED}, m AS (SELECT c, sid, 'PERSONA_MENCION::' || sid || '/' || c AS m FROM ob)
SELECT 'id-' || substr(sha256(string_agg(m, '|' ORDER BY m)), 1, 16) AS identity, count(*) AS mentions, string_agg(sid, ',' ORDER BY sid) AS reports FROM m GROUP BY c HAVING count(*) > 1""")
def identities_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's hypotheses, all of them validated, as identities."""
    guessed = identity.hypotheses(run_edges(spark, sf_dir)).withColumn("state", F.lit("validada"))
    return identity.consolidate(guessed)[0].select("identity", F.size("mentions").cast("long").alias("mentions"), F.array_join("reports", ",").alias("reports"))


# -- links --------------------------------------------------------------------------------------------------------------
def _linked(spark: SparkSession, sf_dir: str, locators: bool = False) -> DataFrame:
    """Linked pairs with their details, as the run scores them; locators are gathered and written only for who reads them."""
    idx = saved(linkage.index(incidence(spark, sf_dir))) if locators else None
    return _scored(spark, sf_dir, idx).filter("linked")


_ALL = _BASE.replace("fired AS (SELECT a, b, CASE kind", "fired AS (SELECT a, b, kind, node_id, CASE kind")


@query(f"WITH {_ALL} SELECT a, b, rule, node_id, weight, corr AS corroborates FROM fired JOIN links USING (a, b)")
def link_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of every link with its identifier and effective weight."""
    return _linked(spark, sf_dir).select("a", "b", F.explode("details").alias("d")).select("a", "b", "d.rule", "d.node_id", "d.weight", "d.corroborates")


@query(f"""WITH {_ALL} SELECT a, b, string_agg(DISTINCT CASE kind WHEN 'CUENTA' THEN 'custkey' WHEN 'DISPOSITIVO' THEN 'partkey' WHEN 'ALIAS' THEN 'orderdate' ELSE 'nationkey' END, ' | '
 ORDER BY CASE kind WHEN 'CUENTA' THEN 'custkey' WHEN 'DISPOSITIVO' THEN 'partkey' WHEN 'ALIAS' THEN 'orderdate' ELSE 'nationkey' END) AS locator FROM fired JOIN links USING (a, b) GROUP BY a, b""")
def link_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir, locators=True).select("a", "b", "locator")


@query(f"WITH {_ALL} SELECT rule, count(*) AS times, round(avg(weight), 4) AS avg_weight FROM fired JOIN links USING (a, b) GROUP BY rule")
def rule_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.rules(_linked(spark, sf_dir))


@query(f"""WITH {_BASE} SELECT coalesce(band, 'all') AS band, count(*) AS links, max(score) AS max_score, min(score) AS min_score, round(avg(score), 4) AS avg_score FROM links GROUP BY GROUPING SETS ((), (band))""")
def weights_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.weights(_linked(spark, sf_dir))


_HAND = "manual AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey HAVING min(o_orderkey) < max(o_orderkey))"


@query(f"""WITH {_BASE}, {_HAND}, l AS (SELECT a, b, score, 'COINCIDE_CON' AS relation FROM links WHERE (a + b) % 5 <> 0)
SELECT a, b, CASE WHEN m.a IS NULL THEN relation ELSE 'VINCULADO_POR_OPERADOR' END AS relation, CASE WHEN m.a IS NULL THEN score END AS score FROM l FULL JOIN manual m USING (a, b)""")
def current_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link that stands for each pair: manual ones first, rejected ones (here each fifth) not at all."""
    links = _linked(spark, sf_dir).withColumn("current", (F.col("a") + F.col("b")) % 5 != 0).withColumn("relation", F.lit("COINCIDE_CON"))
    return views.current_link(links, _manual(spark, sf_dir))


@query(f"""WITH {_BASE}, {_HAND}, mine AS (SELECT sid FROM base JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0),
every AS (SELECT 'links' AS section, a, b FROM links UNION ALL SELECT 'discarded', a, b FROM scored WHERE NOT (sustained AND score >= 0.55) UNION ALL SELECT 'manual', a, b FROM manual)
SELECT * FROM every WHERE a IN (SELECT sid FROM mine) OR b IN (SELECT sid FROM mine)""")
def dossier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a dossier that is trimmed to the orders of one region's customers."""
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    mine = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    own = table(spark, sf_dir, "orders").join(mine, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("sid"))
    section = F.when(F.col("linked"), "links").otherwise("discarded").alias("section")
    pairs = _scored(spark, sf_dir).select(section, "a", "b").union(_manual(spark, sf_dir).select(F.lit("manual"), "a", "b"))
    return dossier.of_pairs(pairs, "a", "b", own)


# -- pseudonyms ---------------------------------------------------------------------------------------------------------
_KINDS = {"CUENTA": ("customer", "c_name", "c_custkey"), "ORGANIZACION": ("supplier", "s_name", "s_suppkey")}
_LABELS = "firsts AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS value, min({o}) AS o FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for k, (t, c, o) in _KINDS.items()) + "), labels AS (SELECT value, kind || '-' || row_number() OVER (PARTITION BY kind ORDER BY o, value) AS label FROM firsts)"
_LINES = "lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey"


def _payload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A text for each line of an order that names customer and supplier, and the labels of both."""
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("value"), F.col(o).alias("order")) for k, (t, c, o) in _KINDS.items()]
    labels = review.pseudonyms(parts[0].union(parts[1]).filter("value is not null"))
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    who = orders.select("o_orderkey", "o_custkey").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("o_orderkey", "c_name")
    wide = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey").join(who, "o_orderkey", "left").join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    said = lambda c: F.coalesce(F.col(c), F.lit("-"))
    text = F.concat(F.lit('{"cuenta": "'), said("c_name"), F.lit('", "linea": '), "l_linenumber", F.lit("} de "), said("s_name"), F.lit("."))
    return wide.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", text.alias("text")), saved(labels)


def _text(account: str, vendor: str) -> str:
    return f"""'{{"cuenta": "' || coalesce({account}, '-') || '", "linea": ' || l_linenumber || '}} de ' || coalesce({vendor}, '-') || '.' AS text"""


@query(f"WITH {_LABELS} SELECT l_orderkey, l_linenumber, {_text('x.label', 'y.label')} FROM {_LINES} LEFT JOIN labels x ON x.value = c_name LEFT JOIN labels y ON y.value = s_name")
def hidden_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for every customer and supplier."""
    texts, labels = _payload(spark, sf_dir)
    return pseudonyms.hidden(texts, "text", labels)


@query(f"SELECT l_orderkey, l_linenumber, {_text('c_name', 's_name')} FROM {_LINES}")
def restored_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts there and back."""
    texts, labels = _payload(spark, sf_dir)
    return pseudonyms.restored(saved(pseudonyms.hidden(texts, "text", labels)), "text", labels)
