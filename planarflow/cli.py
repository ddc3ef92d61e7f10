"""Command line: run a census, or compare a summary with the published numbers."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from planarflow.plans.golden import verdicts
from planarflow.plans.run import Run, git_revision


def parse(args: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="planarflow")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("census", help="enumerate the good drawings of K(m,n)")
    run.add_argument("m", type=int)
    run.add_argument("n", type=int)
    run.add_argument("--output-dir", required=True)
    where = run.add_mutually_exclusive_group()
    where.add_argument("--workers", type=int, help="local[N]; without it the session's own master")
    where.add_argument("--serial", action="store_true", help="local[1]")
    run.add_argument("--no-flag-classes", action="store_true")
    run.add_argument("--delete-stages", action="store_true", help="delete the tables of earlier stages when the run is done")
    run.add_argument("--source-revision", help="without it, what git says of this folder")
    check = sub.add_parser("check", help="compare summary.json with the published numbers")
    check.add_argument("summary")
    return top.parse_args(args)


def main(args: list[str] | None = None) -> int:
    a = parse(args)
    if a.command == "check":
        with open(a.summary, encoding="utf-8") as f:
            found = verdicts(json.load(f))
    else:
        build = SparkSession.builder.appName(f"K({a.m},{a.n})")
        if a.serial or a.workers:
            build = build.master(f"local[{1 if a.serial else a.workers}]")
        found = verdicts(Run(build.getOrCreate(), a.output_dir, a.m, a.n, a.source_revision or git_revision()).run(not a.no_flag_classes, not a.delete_stages))
    for verdict, name, got, want in found:
        print(verdict, name, got, want)
    return int(any(v[0] == "FAIL" for v in found))


if __name__ == "__main__":
    sys.exit(main())
