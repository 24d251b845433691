"""python -m subsetry COMMAND CONFIG ...; run with --help."""

from __future__ import annotations

import argparse
import json
import signal
import sys
import threading

from pyspark.sql import SparkSession

from . import runtime
from .operators import report
from .plans.plan import Edge
from .plans.resolve import load_plan
from .sources import infer
from .sources.catalog import Catalog, ForeignKey, from_ddl
from .sources.database import Database
from .streaming.state import Interrupted, RunState


def get_calls(words: list[str]) -> list[tuple[str, dict[str, object]]]:
    """name --param value --param=value name2 …"""
    out: list[tuple[str, dict[str, object]]] = []
    i = 0
    while i < len(words):
        w = words[i]
        if not w.startswith("--"):
            out.append((w, {}))
        elif not out:
            raise SystemExit(f"{w} stands before any function name")
        else:
            name, eq, value = w[2:].partition("=")
            if not eq:
                i += 1
                if i == len(words):
                    raise SystemExit(f"{w} needs a value")
                value = words[i]
            out[-1][1][name] = value
        i += 1
    return out


def variables(pairs: list[str], file: str | None) -> dict[str, object]:
    """Those of a JSON file, as texts where they are not; NAME=VALUE pairs win."""
    out: dict[str, object] = {}
    if file:
        with open(file, encoding="utf-8") as f:
            out = {k: v if isinstance(v, str) else json.dumps(v) for k, v in json.load(f).items()}
    return out | dict(p.split("=", 1) for p in pairs)


def _interruptible(state: RunState) -> None:
    """The first Ctrl-C stops the run after what is complete, so that it can be resumed; the second ends it at once."""

    def stop(number, frame) -> None:
        signal.signal(signal.SIGINT, signal.default_int_handler)
        print("stopping; run again with --resume", file=sys.stderr)
        threading.Thread(target=state.stop).start()

    signal.signal(signal.SIGINT, stop)


def _place(spark: SparkSession, where: str, properties: list[str], schema: str | None) -> str | Database:
    return Database(spark, where, dict(x.split("=", 1) for x in properties), schema) if where.startswith("jdbc:") else where


def _catalog(spark: SparkSession, args: argparse.Namespace) -> Catalog:
    place = _place(spark, args.source, args.source_property, args.source_schema)
    if isinstance(place, Database):
        found = place.catalog()
    else:
        keys: dict = {}
        if args.keys:
            with open(args.keys, encoding="utf-8") as f:
                keys = json.load(f)
        fks = [ForeignKey(**k) for k in keys.pop("foreign_keys", [])]
        found = Catalog.parquet(spark, place, keys, foreign_keys=fks)
    if args.schema_dump:
        with open(args.schema_dump, encoding="utf-8") as f:
            found = found.described(f.read())
    return found


def _guess(args: argparse.Namespace) -> str:
    """Relations and a configuration, guessed from a schema dump or from the source."""
    if args.schema_dump and not args.source:
        with open(args.schema_dump, encoding="utf-8") as f:
            columns, meta = from_ddl(f.read())
    else:
        found = _catalog(SparkSession.builder.appName("subsetry").getOrCreate(), args)
        columns, meta = infer.columns_of(found), found.meta
    known = [Edge(k.table, k.columns[0], k.parent, k.parent_columns[0]) for m in meta.values() for k in m.foreign_keys if len(k.columns) == 1]
    if args.command == "configure":
        return infer.configuration(columns, meta, known, roots=args.root)
    graph = infer.Graph([*known, *infer.infer_relations(columns, meta, known)], list(columns))
    return {"list": graph.as_list, "grouped": graph.grouped, "dot": graph.dot, "summary": graph.summary}[args.form]()


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    own = argv[: argv.index("--")] if "--" in argv else argv
    p = argparse.ArgumentParser(prog="subsetry", description=__doc__, epilog="get takes, after --, functions and their parameters: name --param value")
    p.add_argument("command", choices=["import", "get", "export", "load", "dry-run", "check", "plan", "relations", "configure"])
    p.add_argument("config", nargs="?", help="configuration file; for load, the bundle or its http(s) URL; none for relations and configure")
    p.add_argument("--source", help="folder of Parquet tables, or a JDBC URL")
    p.add_argument("--keys", help="JSON file: {table: [key columns]} and, under \"foreign_keys\", their descriptions")
    p.add_argument("--schema-dump", help="CREATE TABLE statements that describe the source's tables")
    p.add_argument("--target", help="folder to write to, or a JDBC URL")
    p.add_argument("--state", help="shared folder for the state of a run into a database")
    for side in ("source", "target"):
        p.add_argument(f"--{side}-property", action="append", default=[], metavar="NAME=VALUE", help="of the JDBC connection, such as user, password, driver")
        p.add_argument(f"--{side}-schema")
    p.add_argument("--var", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--var-file")
    p.add_argument("--form", choices=["list", "grouped", "dot", "summary"], default="list", help="of relations")
    p.add_argument("--root", action="append", default=[], help="for configure: a table to make an aggregate of")
    for flag in ("resume", "clean", "report", "ignore-case"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--untouched", choices=["full", "empty"], default="full")
    args = p.parse_args(own)
    given = variables(args.var, args.var_file)
    if args.command in ("relations", "configure"):
        print(_guess(args))
        return 0
    if args.command == "check":
        problems = runtime.check(args.config, given)
        print("\n".join(problems) or "ok")
        return int(bool(problems))
    if args.command == "plan":
        print(runtime.plan_json(args.config, given))
        return 0
    spark = SparkSession.builder.appName("subsetry").getOrCreate()
    to = _place(spark, args.target, args.target_property, args.target_schema) if args.target else None
    try:
        if args.command == "load":
            out = runtime.run_load(spark, args.config, to, args.resume, args.clean, args.ignore_case, args.state)
        else:
            catalog, plan = _catalog(spark, args), load_plan(args.config, given)
            if args.command == "dry-run":
                runtime.dry_run(catalog, plan, args.ignore_case).show(1000, False)
                tables = report.planned(catalog, plan, args.untouched)
                tables.show(100_000, False)
                report.planned_total(tables).show(10, False)
                return 0
            if args.command == "get":
                out = runtime.run_get(catalog, plan, get_calls(argv[len(own) + 1 :]), to, args.clean, args.ignore_case, state=args.state)
            elif args.command == "export":
                out = runtime.run_export(catalog, plan, args.target, args.untouched, args.ignore_case)
            else:
                out = runtime.run_import(catalog, plan, to, args.resume, args.clean, args.untouched, args.ignore_case, state=args.state, started=_interruptible)
    except Interrupted as e:
        print(e, file=sys.stderr)
        return 130
    for w in out.warnings:
        print("warning:", w, file=sys.stderr)
    print(f"{len(out.rows)} tables, {sum(out.rows.values())} rows")
    if out.preserved:
        print(f"{sum(out.preserved.values())} rows of {len(out.preserved)} tables preserved")
    if args.report and out.times:
        times = out.timings(spark)
        for table in (report.by_step(times), report.by_table(times), report.slowest(times)):
            table.show(20, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
