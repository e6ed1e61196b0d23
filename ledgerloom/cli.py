"""Command line: ``python -m ledgerloom.cli query gen|explain|validate|optimize|analyze|run|templates ...`` over a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    query = p.add_subparsers(dest="group", required=True).add_parser("query", help="queries of the bilingual language").add_subparsers(dest="action", required=True)
    for name, what in (("gen", "a query for a task in words"), ("explain", "what a query reads and does"), ("validate", "check names and types"), ("optimize", "advice on a query"), ("analyze", "everything at once"), ("run", "run a query and print its first rows")):
        a = query.add_parser(name, help=what)
        a.add_argument("text")
        a.add_argument("--data", required=name not in ("explain",), help="folder of the tables")
        a.add_argument("--rows", type=int, default=20)
    query.add_parser("templates", help="names of the query templates")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=1, default=str))
    from ledgerloom.plans import builder, validator, workflow
    from ledgerloom.plans.catalog import sample_catalog

    if args.action == "templates":
        show([t[0] for t in validator.TEMPLATES])
        return 0
    if args.action == "explain":
        show(builder.explain(args.text))
        return 0
    if spark is None:
        from ledgerloom.session import build_session

        spark = build_session("local[*]", "ledgerloom-cli")
    catalog = sample_catalog(spark, args.data)
    if args.action == "gen":
        name, text = workflow.generate(args.text, catalog)
        show({"template": name, "text": text})
    elif args.action == "validate":
        found = validator.validate(args.text, catalog)
        show([asdict(f) for f in found])
        return int(any(f.severity == "error" for f in found))
    elif args.action == "optimize":
        show(workflow.advise(args.text, spark))
    elif args.action == "analyze":
        show(asdict(workflow.run(args.text, catalog, spark)))
    else:
        builder.Engine(spark, catalog).run(args.text).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
