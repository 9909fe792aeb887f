"""Command line: python -m retort.cli COMMAND. Everything it does is in ``workflow``, ``service`` and ``plans`` (GV12)."""

from __future__ import annotations

import argparse
import json

from retort.ml import tasks
from retort.session import build_session
from retort.workflow import STAGES, Workflow


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="retort")
    commands = out.add_subparsers(dest="command", required=True)
    for name in STAGES:
        one = commands.add_parser(name, help=f"run the {name} stage")
        one.add_argument("--root", required=True)
        one.add_argument("--version", default="v2")
        if name == "canonical":
            one.add_argument("--artifact", required=True)
    every = commands.add_parser("run", help="run the stages from one to another")
    every.add_argument("--root", required=True)
    every.add_argument("--version", default="v2")
    every.add_argument("--artifact", required=True)
    every.add_argument("--first", default=STAGES[0], choices=STAGES)
    every.add_argument("--last", default=STAGES[-1], choices=STAGES)
    route = commands.add_parser("route", help="show a route")
    route.add_argument("--root", required=True)
    route.add_argument("route_id")
    find = commands.add_parser("search", help="find routes")
    find.add_argument("--root", required=True)
    find.add_argument("--text", default="")
    find.add_argument("--limit", type=int, default=20)
    models = commands.add_parser("models", help="list registered models")
    models.add_argument("--root", required=True)
    query = commands.add_parser("query", help="run a named query")
    query.add_argument("name")
    query.add_argument("folder")
    for name, words in (("anomaly", "fit the condition statistics alone"), ("freeze", "freeze the canonical tables as a baseline"), ("check-release", "count the canonical tables for a release"), ("identity", "audit routes and their assignment")):
        commands.add_parser(name, help=words).add_argument("--root", required=True)
    special = commands.add_parser("specialist", help="train tasks with several labels and regressions")
    special.add_argument("--root", required=True)
    special.add_argument("--tasks", nargs="+", required=True, choices=sorted([*tasks.MULTILABEL, *tasks.REGRESSIONS]))
    lock = commands.add_parser("lock", help="lock a release if every gate holds")
    lock.add_argument("--root", required=True)
    lock.add_argument("--release", default="v2")
    inventory = commands.add_parser("audit-source", help="list an artifact's members and sizes")
    inventory.add_argument("artifact")
    bench = commands.add_parser("benchmark-mapper", help="time the fallback mapper by batch size")
    bench.add_argument("--root", required=True)
    bench.add_argument("--sizes", nargs="+", type=int, default=[8, 16, 32, 64])
    bench.add_argument("--rows", type=int, default=512)
    export = commands.add_parser("export", help="make a publication folder of the final tables")
    export.add_argument("--root", required=True)
    export.add_argument("--target", required=True)
    serving = commands.add_parser("serve", help="answer over HTTP")
    serving.add_argument("--root", required=True)
    serving.add_argument("--port", type=int, default=8000)
    serving.add_argument("--key")
    commands.add_parser("queries", help="list the named queries")
    commands.add_parser("environment", help="show versions")
    return out


def _inventory(spark, args):
    from retort.sources.datasets import Artifact

    return dict(Artifact(spark, args.artifact).inventory())


def _benchmark(spark, args):
    from retort.sources.datasets import read_dataset
    from retort.stages import mapping

    return mapping.benchmark(read_dataset(spark, args.root, "context/mapping_candidates"), mapping.Surroundings(), tuple(args.sizes), args.rows)


def _identity(spark, args):
    from retort.governance.acceptance import route_audit
    from retort.sources.datasets import read_dataset

    return route_audit(read_dataset(spark, args.root, "canonical/routes"), read_dataset(spark, args.root, "canonical/steps"))


def _export(spark, args):
    from retort.sources.datasets import bundle

    return bundle(spark, args.root, args.target, ["final/steps", "final/routes"], {"name": "retort"})


OTHERS = {
    "audit-source": _inventory,
    "benchmark-mapper": _benchmark,
    "identity": _identity,
    "export": _export,
    "anomaly": lambda spark, args: Workflow(spark, args.root).anomaly(),
    "freeze": lambda spark, args: Workflow(spark, args.root).freeze(),
    "check-release": lambda spark, args: Workflow(spark, args.root).check_release(),
    "specialist": lambda spark, args: Workflow(spark, args.root).specialist(tuple(args.tasks)),
    "lock": lambda spark, args: Workflow(spark, args.root).lock(args.release),
}


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "environment":
        from retort.governance.acceptance import environment

        print(json.dumps(environment(), indent=2))
        return 0
    if args.command in ("queries", "query"):
        from retort.plans.catalog import QUERIES

        if args.command == "queries":
            print("\n".join(sorted(QUERIES)))
            return 0
        QUERIES[args.name](build_session(), args.folder).show(50, truncate=False)
        return 0
    spark = build_session()
    if args.command == "serve":
        from retort.api import Api, serve

        serve(Api(spark, args.root, key=args.key), args.port)
        return 0
    if args.command in OTHERS:
        result = OTHERS[args.command](spark, args)
    elif args.command in ("route", "search", "models"):
        from retort.governance.registry import Registry
        from retort.service import Routes
        from retort.sources.datasets import read_dataset

        if args.command == "models":
            result = [r.asDict() for r in Registry(spark, f"{args.root}/registry", read_only=True).models().collect()]
        else:
            service = Routes(*[read_dataset(spark, args.root, n) for n in ("final/routes", "final/steps", "context/route_edges")])
            result = service.get(args.route_id) if args.command == "route" else service.find(args.text, limit=args.limit)
    else:
        flow = Workflow(spark, args.root, args.version)
        if args.command == "run":
            result = flow.run(args.artifact, args.first, args.last)
        else:
            result = flow.canonical(args.artifact) if args.command == "canonical" else getattr(flow, args.command)()
    print(json.dumps(result, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
