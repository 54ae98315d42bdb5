"""Writers: tables, one JSON or GraphML file for viewers, a Markdown report of the run and of each case."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from casegraph.functions import vocab
from casegraph.operators import views


def tables(run: dict[str, DataFrame], folder: str, texts_folder: str) -> None:
    """Each table of a run as Parquet; restricted texts go to a folder of their own and into no other table."""
    for name, df in run.items():
        df.write.mode("overwrite").parquet(f"{texts_folder if name == 'texts' else folder}/{name}")


def graph_rows(run: dict[str, DataFrame]) -> DataFrame:
    """The graph as rows of part (node, edge, source, violation) and JSON: what graph_json writes, still distributed."""
    parts = [("node", run["nodes"]), ("edge", run["edges"]), ("source", run["sources"]), ("violation", run["violations"])]
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = rows if out is None else out.union(rows)
    return out


def _streamed(path: str, head: str, blocks: list[tuple[str, Iterator[str], str]], tail: str) -> str:
    """One file, written row by row: the driver never holds a table."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(head)
        for before, rows, between in blocks:
            out.write(before)
            for k, row in enumerate(rows):
                out.write((between if k else "") + row)
        out.write(tail)
    return path


def graph_json(run: dict[str, DataFrame], path: str) -> str:
    """One JSON document: meta, sources, nodes, edges, violations."""
    rows = lambda df: (r["j"] for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator())
    counts = {f"{r['what']}:{r['name']}": r["n"] for r in views.summary(run["nodes"], run["edges"]).collect()}
    head = '{"meta": ' + json.dumps({"summary": counts}, ensure_ascii=False)
    return _streamed(path, head, [(f', "{name}": [\n', rows(run[name]), ",\n") if k == 0 else (f'], "{name}": [\n', rows(run[name]), ",\n") for k, name in enumerate(("sources", "nodes", "edges", "violations"))], "]}\n")


def graphml(run: dict[str, DataFrame], path: str) -> str:
    """GraphML: attributes as text, maps and lists as JSON; edge attributes without a value are left out."""
    flat = lambda df: [c for c in df.columns if c not in ("node_id", "src", "dst")]

    def of(df: DataFrame, side: str, shape: Callable[[Row], str]) -> tuple[list[str], Iterator[str]]:
        names = flat(df)
        plain = [(F.to_json(c) if df.schema[c].dataType.typeName() in ("map", "array", "struct") else F.col(c).cast("string")).alias(c) for c in names]
        keep = [F.col(c) for c in df.columns if c not in names]
        rows = df.select(*keep, *plain).toLocalIterator()
        data = lambda r: "".join(f'<data key="{side}_{c}">{escape(r[c])}</data>' for c in names if r[c] is not None)
        return names, (shape(r).replace("\0", data(r)) for r in rows)

    node_names, node_rows = of(run["nodes"], "n", lambda r: f"<node id={quoteattr(r['node_id'])}>\0</node>\n")
    edge_names, edge_rows = of(run["edges"], "e", lambda r: f"<edge source={quoteattr(r['src'])} target={quoteattr(r['dst'])}>\0</edge>\n")
    keys = "".join(f'<key id="{s}_{c}" for="{k}" attr.name="{c}" attr.type="string"/>\n' for s, k, cs in (("n", "node", node_names), ("e", "edge", edge_names)) for c in cs)
    head = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + keys + '<graph edgedefault="directed">\n'
    return _streamed(path, head, [("", node_rows, ""), ("", edge_rows, "")], "</graph>\n</graphml>\n")


def _table(df: DataFrame, columns: list[str], rows: int) -> str:
    some = df.select(*columns).limit(rows + 1).collect()
    lines = [f"| {' | '.join(columns)} |", "|" + "-|" * len(columns)]
    lines += ["| " + " | ".join("—" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in some[:rows]]
    return "\n".join(lines) + (f"\n\nSiguen más filas; aquí van {rows}." if len(some) > rows else "") if some else "Ninguno."


def markdown(run: dict[str, DataFrame], path: str) -> str:
    """The report of a run in eight sections; lists are limited as people read them, the tables hold all."""
    central = run["positions"].filter(F.col("place") <= vocab.REPORT_CENTRAL).orderBy("metric", "place")
    sections = [
        ("Resumen del grafo", _table(views.summary(run["nodes"], run["edges"]).orderBy("what", "name"), ["what", "name", "n"], 100)),
        ("Vinculaciones propuestas", _table(views.shown_links(run["links"]), ["a", "b", "relation", "score", "rules"], vocab.QUEUE_ROWS)),
        ("Pares descartados", _table(run["discarded"].orderBy("a", "b"), ["a", "b", "rules", "reason"], vocab.QUEUE_ROWS)),
        ("Alertas de reapertura", _table(run["alerts"], ["archived", "trigger", "priority", "brings", "score"], vocab.QUEUE_ROWS)),
        ("Casos", _table(run["cases"], ["case", "first_report", "reports", "links"], vocab.QUEUE_ROWS)),
        ("Contradicciones e identidades", _table(run["contradictions"].filter("current").select("src_value", "dst_value", "explanation"), ["src_value", "dst_value", "explanation"], vocab.QUEUE_ROWS)),
        ("Posición en el grafo", "Describe lugares en el grafo, no personas.\n\n" + _table(central, ["metric", "place", "v", "w", "value"], 4 * vocab.REPORT_CENTRAL)),
        ("Cola de revisión", _table(views.queue(run["all_edges"]), ["arista_id", "relation", "origin", "confidence"], vocab.QUEUE_ROWS)),
    ]
    text = "# Informe de la corrida\n\nToda vinculación es una propuesta y ninguna acredita autoría.\n\n" + "\n\n".join(f"## {k}. {t}\n\n{b}" for k, (t, b) in enumerate(sections, 1))
    Path(path).write_text(text + "\n", encoding="utf-8")
    return path


def narratives(run: dict[str, DataFrame], folder: str) -> None:
    """A text for each case, in a folder by case; cases that are no more lose theirs."""
    links = run["links"].filter("current")
    of = links.join(run["members"].select("case", F.col("sid").alias("a")), "a").select("case", F.struct((-F.col("score")).alias("o"), F.concat(F.lit("- Los reportes "), "a", F.lit(" y "), "b", F.lit(" se vinculan por "), F.replace("rules", F.lit(","), F.lit(", ")), F.lit(" (puntaje "), F.col("score").cast("string"), F.lit(").")).alias("line")).alias("l"))
    said = of.groupBy("case").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("# Caso "), "case", F.lit("\n\nReportes: "), F.col("reports").cast("string"), F.lit(". Vínculos: "), F.col("links").cast("string"), F.lit(".\n\n"))
    rows = run["cases"].join(said, "case", "left").select("case", F.concat(head, F.coalesce("lines", F.lit("Sin vinculaciones."))).alias("value"))
    rows.write.mode("overwrite").partitionBy("case").text(folder)
