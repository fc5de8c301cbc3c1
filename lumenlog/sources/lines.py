"""Reading log lines and writing rejects."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """One row ``value`` for each LF-ended line; paths, folders, globs and .gz are read.

    ``split_bytes``: how much of a file a task reads at most, for the whole session.
    """
    if split_bytes is not None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    return spark.read.text(path, lineSep="\n")


def read_stdin(spark: SparkSession) -> DataFrame:
    """Standard input, spooled to a file of this machine until it ends: for a local session only."""
    with tempfile.NamedTemporaryFile(prefix="lumenlog-", suffix=".log", delete=False) as f:
        atexit.register(lambda: os.path.exists(f.name) and os.unlink(f.name))
        while chunk := sys.stdin.buffer.read(1 << 20):
            f.write(chunk)
    return read_lines(spark, f"file://{f.name}")


def write_rejects(rejected: DataFrame, path: str) -> None:
    rejected.select("value").write.text(path, lineSep="\n")
