"""What the jobs share: settings from a small JSON file, logging, and counts taken while rows are written."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults`` overridden by the JSON object at ``path``, which Spark reads; a name that is not among them is an error."""
    told = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if path else {}
    unknown = sorted(set(told) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return defaults | told


class Counter:
    """Counts the rows of plans as they run, without another pass; ``rows`` is known once the plan was written."""

    def __init__(self, name: str):
        self.name, self.seen = name, Observation()

    def of(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"))

    @property
    def rows(self) -> int:
        return int(self.seen.get["rows"])


def main(run: Callable[..., dict], arguments: dict[str, str], argv: list[str] | None = None) -> None:
    """The command line: one option for each path in ``arguments`` (name: help), and ``--config``; it makes and stops the session."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for name, told in arguments.items():
        parser.add_argument(f"--{name}", required=True, help=told)
    parser.add_argument("--config", help="JSON file of settings")
    a = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        print(json.dumps(run(spark, **{n: a[n] for n in arguments}, config=a["config"])))
    finally:
        spark.stop()
