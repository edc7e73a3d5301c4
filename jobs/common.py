"""What the jobs share: their session, settings and log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str | None, known: dict) -> dict:
    """The settings of a JSON file over the defaults; Spark reads it, so it may lie anywhere. A name that the job does not know is an error."""
    found = json.loads(spark.read.text(path, wholetext=True).first()["value"]) if path else {}
    if strange := set(found) - set(known):
        raise ValueError(f"unknown settings {sorted(strange)}; known are {sorted(known)}")
    return known | found


def any_path(path: str) -> str:
    """The path as a pattern that fits it alone: a stream reads a folder as such, a single file only where a pattern names it."""
    parent, slash, name = path.rstrip("/").rpartition("/")
    return f"{parent}{slash}{{{name}}}"


def main(name: str, paths: dict[str, str], run: Callable, known: dict) -> None:
    """Read the command line, open a session, run the job and close the session."""
    parser = argparse.ArgumentParser(prog=name)
    for path, says in paths.items():
        parser.add_argument(f"--{path}", required=True, help=says)
    parser.add_argument("--config", help="JSON file of settings: " + ", ".join(known))
    given = vars(parser.parse_args())
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = settings(spark, given.pop("config"), known)
        run(spark, *given.values(), **config)
    finally:
        spark.stop()
