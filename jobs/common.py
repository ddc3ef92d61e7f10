"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def settings(path: str | None, default: str) -> dict:
    """A job's config: the file beside its code, and what a file of the caller's says otherwise."""
    held = json.loads((Path(__file__).parent / default).read_text())
    return held | (json.loads(Path(path).read_text()) if path else {})


def main(name: str, paths: dict[str, str], work: Callable[..., dict]) -> None:
    """Read the arguments, start a session, do the work, stop the session."""
    parser = argparse.ArgumentParser(description=work.__doc__)
    for path, says in paths.items():
        parser.add_argument(f"--{path}", required=True, help=says)
    parser.add_argument("--config", help="JSON file with settings that differ from the default ones")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, *(given[p] for p in paths), config=settings(given["config"], f"{name}.json"))
    finally:
        spark.stop()
