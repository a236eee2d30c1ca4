"""What the jobs' command lines share: config files, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

Config = TypeVar("Config")
log = logging.getLogger("regionspark.jobs")


def load_config(kind: type[Config], path: str | None = None, text: str | None = None) -> Config:
    """A config of this kind from a JSON file or text; keys that it does not have are an error, missing ones keep their default."""
    values = json.loads(Path(path).read_text() if path else text or "{}")
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown keys in {path or 'config'}: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def command_line(description: str, kind: type[Config], paths: dict[str, str], run: Callable[..., object]) -> None:
    """Parse the paths and --config, make a session, run the job in it and stop it."""
    parser = argparse.ArgumentParser(description=description)
    for name, meaning in paths.items():
        parser.add_argument(f"--{name}", required=True, help=meaning)
    parser.add_argument("--config", help="JSON file; see the file of the same name beside the job")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = load_config(kind, args.config)
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        run(spark, *[getattr(args, name) for name in paths], config)
    finally:
        spark.stop()
