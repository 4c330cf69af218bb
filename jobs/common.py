"""What the jobs share: config files, the command line's session, and paths of streams."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def config_of(module_file: str, given: dict | None = None) -> dict:
    """The config file beside a job, with what is given in place of its values."""
    known = json.loads(Path(module_file).with_suffix(".json").read_text())
    if unknown := set(given or {}) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | (given or {})


def stream_path(path: str) -> str:
    """A folder or a single file as a pattern, which is how a file stream also takes a single file; a pattern stays as it is."""
    path = path.rstrip("/")
    return path if any(x in path for x in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def command_line(what: str, run: Callable[..., dict]) -> None:
    """--input, --output, --checkpoint and --config; makes a session and stops it."""
    p = argparse.ArgumentParser(description=what)
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file whose values replace those of the file beside the job")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(what).config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    try:
        print(json.dumps(run(spark, a.input, a.output, a.checkpoint, json.loads(Path(a.config).read_text()) if a.config else None)))
    finally:
        spark.stop()
