"""Commands on a run: ``python -m casegraph.cli --reports FOLDER --state DIR COMMAND ...``; what a person decides goes to ledgers in DIR."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from casegraph.functions import vocab
from casegraph.operators import review
from casegraph.plans import api
from casegraph.plans.build import build


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="casegraph", description=__doc__)
    out.add_argument("--reports", action="append", required=True, help="folder of reports; later ones override")
    out.add_argument("--state", required=True, help="folder of the ledgers")
    out.add_argument("--manifest", action="append", default=[], help="multimedia manifest")
    todo = out.add_subparsers(dest="command", required=True)
    queue = todo.add_parser("queue")
    queue.add_argument("--origin", choices=sorted(vocab.FIRST_STATE))
    queue.add_argument("--rows", type=int, default=vocab.CLI_ROWS)
    todo.add_parser("show").add_argument("edge")
    for name in ("links", "alerts", "cases", "identities", "audit"):
        todo.add_parser(name)
    decide = todo.add_parser("decide")
    decide.add_argument("edge")
    decide.add_argument("decision", choices=vocab.DECISIONS)
    decide.add_argument("--force", action="store_true", help="reject an observation")
    for name in ("link", "unlink", "unify"):
        pair = todo.add_parser(name)
        pair.add_argument("a")
        pair.add_argument("b")
    for name in ("decide", "link", "unlink", "unify"):
        todo.choices[name].add_argument("--user", required=True)
        todo.choices[name].add_argument("--note", default="")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("casegraph").getOrCreate()
    decisions, manual = f"{args.state}/decisions.jsonl", f"{args.state}/links.jsonl"
    if args.command == "audit":
        bad = api.audit(spark, *api.existing(decisions, manual))
        return show(bad) if bad is not None else 0
    read = lambda p: review.read_ledger(spark, p) if api.existing(p) else None
    run = build(spark, args.reports, decisions=read(decisions), manual=read(manual), manifests=args.manifest)
    if args.command == "queue":
        return show(api.queue(run, args.origin, args.rows).select("arista_id", "relation", "origin", "confidence", "explanation"))
    if args.command == "show":
        return show(api.show(run, args.edge))
    if args.command in run:
        return show(run[args.command])
    if args.command == "decide":
        print(api.decide(run, decisions, args.edge, args.decision, args.user, args.note, args.force))
    elif args.command == "unify":
        print(api.unify(run, decisions, args.a, args.b, args.user, args.note))
    else:
        act = api.link if args.command == "link" else api.unlink
        print(act(run, manual, args.a, args.b, args.user, args.note))
    return 0


def show(df: DataFrame, rows: int = 200) -> int:
    df.show(rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
