"""python -m wardloom.cli: profile, validate, export and compare from the shell."""

from __future__ import annotations

import argparse
import json
import sys

from wardloom import manifest, session, standards
from wardloom.operators import quality, relational
from wardloom.sources import interchange, tabular


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wardloom")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("profile", help="figures of every column of a file")
    p.add_argument("path")
    p = commands.add_parser("models", help="entities of a standard")
    p.add_argument("standard")
    p = commands.add_parser("ddl", help="definition of one entity")
    p.add_argument("standard")
    p.add_argument("entity")
    p = commands.add_parser("validate", help="rules from a JSON list on a file")
    p.add_argument("path")
    p.add_argument("rules")
    p = commands.add_parser("export", help="resources as lines of JSON")
    p.add_argument("path")
    p.add_argument("out")
    p = commands.add_parser("replay", help="check the inputs of a recorded run")
    p.add_argument("manifest")
    args = parser.parse_args(argv)
    if args.command == "models":
        print("\n".join(standards.load(args.standard).entities))
        return 0
    if args.command == "ddl":
        print(standards.load(args.standard).ddl(args.entity))
        return 0
    if args.command == "replay":
        with open(args.manifest) as f:
            problems = manifest.verify_inputs(json.load(f))
        print(json.dumps(problems))
        return int(bool(problems))
    spark = session.build(app="wardloom-cli")
    df = tabular.read_source(spark, args.path)
    if args.command == "profile":
        print(json.dumps(tabular.to_records(relational.profile(df)), default=str))
        return 0
    if args.command == "export":
        interchange.write_ndjson(df, args.out)
        return 0
    with open(args.rules) as f:
        rules = [quality.parse_rule(r) for r in json.load(f)]
    results = quality.evaluate(df, rules)
    print(quality.text_report(results))
    return int(not results.where("severity = 'error' and not passed").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
