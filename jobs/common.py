"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def settings(name: str) -> dict:
    """The settings beside the job: ``<name>.json``."""
    with open(os.path.join(HERE, f"{name}.json")) as f:
        return json.load(f)


def command(job: str, paths: dict[str, str], run: Callable[..., object], args: list[str] | None = None) -> None:
    """Run a job in a session of its own. ``paths``: its path arguments and what they are."""
    parser = argparse.ArgumentParser(prog=f"jobs.{job}", description=(run.__doc__ or "").split("\n\n")[0])
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", help="a JSON file of settings; the job's own by default")
    parser.add_argument("--scratch", help="a folder that all executors share, where spark.checkpoint.dir names none")
    given = parser.parse_args(args)
    config = settings(job)
    if given.config:
        with open(given.config) as f:
            config |= json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(job)
    if given.scratch:
        builder = builder.config("spark.checkpoint.dir", given.scratch)
    spark = builder.getOrCreate()
    try:
        run(spark, **{name: getattr(given, name) for name in paths}, config=config)
    finally:
        spark.stop()
