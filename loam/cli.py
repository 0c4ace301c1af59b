"""Commands: init, sync, introspect, generate, validate, fix.

    python -m loam.cli init --ddl schema.sql -o config.yaml
    python -m loam.cli generate -c config.yaml -o out.sql [--format parquet]
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from loam.functions.generators import Registry
from loam.plans.build import build
from loam.plans.config import dumps, load, save
from loam.plans.fix import FixError, candidates, fix
from loam.plans.lint import ERROR, counts, fix_order, lint
from loam.plans.merge import sync


def _registry(folder: str | None) -> Registry:
    registry = Registry()
    if folder:
        from loam.plugins import load_plugins

        load_plugins(folder, registry)
    return registry


def _model(args):
    if args.ddl:
        from loam.sources.ddl import read_ddl

        with open(args.ddl, encoding="utf-8") as f:
            model = read_ddl(f.read())
    else:
        from loam.sources.catalog import model_from_catalog, model_from_spark_catalog, read_jdbc_catalog

        spark = _spark()
        model = model_from_catalog(read_jdbc_catalog(spark, args.url), args.schema) if args.url else model_from_spark_catalog(spark, args.database)
    return model.only(args.only or (), args.exclude or ())


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loam").config("spark.sql.session.timeZone", "UTC").getOrCreate()


#: The widest columns of a report; longer locations lose their beginning, longer messages run over.
LOCATION_WIDTH, MESSAGE_WIDTH = 45, 50


def _report(issues) -> int:
    places = [i.location if len(i.location) <= LOCATION_WIDTH else "…" + i.location[1 - LOCATION_WIDTH :] for i in issues]
    wide = max(map(len, places), default=0)
    long = min(max((len(i.message) for i in issues), default=0), MESSAGE_WIDTH)
    for i, place in zip(issues, places):
        print(f"{i.level:<5}{i.kind:<24}{place:<{wide}}  {i.message:<{long}}".rstrip() + (f"  ({i.hint})" if i.hint else ""))
    n = counts(issues)
    print(f"{n['ERR']} errors, {n['WARN']} warnings, {n['INFO']} notes")
    return int(n[ERROR] > 0)


def _fix(args, registry) -> int:
    cfg = load(args.config)
    if args.location:
        hits = [i for i in fix_order(lint(cfg, registry)) if i.location == args.location and (not args.kind or i.kind == args.kind)]
        if not hits:
            print(f"nothing to fix at {args.location}", file=sys.stderr)
            return 1
        try:
            choice = json.loads(args.choice)
        except ValueError:
            choice = args.choice
        fix(cfg, hits[0], choice, registry)
        save(cfg, args.config)
        return 0
    if not sys.stdin.isatty():
        print("fix asks questions: give --location and --choice without a terminal", file=sys.stderr)
        return 2
    for issue in fix_order(lint(cfg, registry)):
        print(f"{issue.level} {issue.kind} {issue.location}: {issue.message}")
        if issue.column:
            print("  candidates: " + ", ".join(n for n, _ in candidates(cfg, registry, issue)))
        answer = input("  choice (empty: skip): ").strip()
        if not answer:
            continue
        try:
            fix(cfg, issue, json.loads(answer) if answer[0] in "{[" else answer, registry)
            save(cfg, args.config)
        except FixError as e:
            print(f"  {e}")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loam")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "sync", "introspect"):
        c = sub.add_parser(name)
        c.add_argument("--ddl")
        c.add_argument("--url")
        c.add_argument("--database", default="default")
        c.add_argument("--schema", action="append", default=None)
        c.add_argument("--only", action="append")
        c.add_argument("--exclude", action="append")
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("-o", "--output", default="-" if name == "introspect" else "config.yaml")
    for name in ("generate", "validate", "fix"):
        c = sub.add_parser(name)
        c.add_argument("-c", "--config", default="config.yaml")
        c.add_argument("-o", "--output", default="out.sql")
        c.add_argument("--format", choices=("sql", "sql-parts", "parquet"), default="sql")
        c.add_argument("--location")
        c.add_argument("--kind")
        c.add_argument("--choice", default="")
    for c in sub.choices.values():
        c.add_argument("--factories", help="folder of plugins")
    args = p.parse_args(argv)
    registry = _registry(args.factories)
    if args.command in ("init", "sync", "introspect"):
        args.schema = args.schema or ["public"]
        model = _model(args)
        if args.command == "introspect":
            text = json.dumps(dataclasses.asdict(model), indent=2, ensure_ascii=False)
        else:
            fresh = build(model, registry, args.seed)
            if args.command == "sync":
                old = load(args.output)
                scope = lambda k: (not args.only or any(k in (o, f"public.{o}") for o in args.only)) and not any(k in (x, f"public.{x}") for x in args.exclude or ())
                fresh = sync(old, fresh, scope)
            text = dumps(fresh)
        if args.output == "-":
            print(text)
        else:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        return 0
    if args.command == "fix":
        return _fix(args, registry)
    cfg = load(args.config)
    for w in cfg.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if args.command == "validate":
        return _report(lint(cfg, registry))
    from loam.operators.emit import write_parquet, write_script, write_script_parts
    from loam.operators.generate import Generator

    made = Generator(_spark(), cfg, registry).run(keep_row=True)
    columns = {k: cfg.tables[k].active() for k in made.tables}
    if args.format == "parquet":
        write_parquet(made.tables, args.output)
    elif args.format == "sql-parts":
        write_script_parts(made.tables, made.plan, args.output, columns)
    else:
        write_script(made.tables, made.plan, args.output, columns)
    for cycle in made.plan.cycles:
        print(f"cycle: {', '.join(cycle)}", file=sys.stderr)
    for child, causes in made.plan.emptied.items():
        print(f"emptied: {child}, as {', '.join(p for p, _ in causes)} has no rows", file=sys.stderr)
    for d in made.dropped:
        print(f"dropped: {d.table} {d.requested - d.emitted} of {d.requested} rows: {d.reason}", file=sys.stderr)
    for w in made.warnings:
        print(f"warning: {w}", file=sys.stderr)
    print(f"wrote {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
