"""Command line: run, templates, checks, stages."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from quarryline import config as C


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarryline", description="Analyse a tree of source files on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="run the pipeline over a tree")
    a.add_argument("path", nargs="?")
    a.add_argument("--config")
    a.add_argument("--output")
    a.add_argument("--format", choices=C.FORMATS)
    a.add_argument("--chunk-size", type=int)
    a.add_argument("--include", action="append")
    a.add_argument("--exclude", action="append")
    a.add_argument("--no-fallback", action="store_true")
    a.add_argument("--master", default="local[*]")
    a.add_argument("--work", help="folder all executors share, for the responses")
    a.add_argument("--provider", action="append", default=[], metavar="MODULE:NAME", help="a provider of your own, in the order they are tried")
    c = sub.add_parser("create-config", help="write a starting configuration")
    c.add_argument("path")
    c.add_argument("--template", choices=("multi", "single", "minimal"), default="multi")
    v = sub.add_parser("validate", help="check a configuration")
    v.add_argument("path")
    sub.add_parser("validate-env", help="list the providers the environment names")
    sub.add_parser("list-stages", help="list installed stages")
    return p


def overrides(args: argparse.Namespace) -> dict:
    pairs = {"codebase_path": args.path, "output_dest": args.output, "output_format": args.format, "chunk_size": args.chunk_size, "include_patterns": args.include, "exclude_patterns": args.exclude}
    out = {k: v for k, v in pairs.items() if v is not None}
    return {**out, "enable_fallback": False} if args.no_fallback else out


def load_object(name: str):
    """The object that MODULE:NAME stands for."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "create-config":
        with open(args.path, "w") as f:
            json.dump(C.template(args.template), f, indent=2)
        return 0
    if args.command == "validate":
        bad = C.violations(C.load_file(args.path))
        print("\n".join(bad) or "valid")
        return int(bool(bad))
    if args.command == "validate-env":
        print("\n".join(m["name"] for m in C.from_environment()) or "none")
        return 0
    if args.command == "list-stages":
        from quarryline.plans.stages import Registry

        r = Registry()
        r.discover()
        print("\n".join(r.names()) or "none")
        return 0
    found = args.config or C.discover(".", *([args.path] if args.path else []))
    raw = C.merge(C.load_file(found) if found else C.template("minimal", args.path or ""), overrides(args))
    if bad := C.violations(raw):
        print("\n".join(bad), file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from quarryline.plans.pipeline import Engine
    from quarryline.plans.stages import Registry

    try:
        stages = Registry()
        stages.discover()
        more = {"providers": tuple(map(load_object, args.provider))} if args.provider else {}
        out = Engine.create(SparkSession.builder.master(args.master).getOrCreate(), raw, stages=stages, work=args.work, **more).run()
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - shown to the user
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out["statistics"], default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
