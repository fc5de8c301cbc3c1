"""The report of an access log, or of standard input.

Rejected lines go to the folder that --rejects names, written by the executors; without it
a local session prints them to stderr, and a cluster leaves them out.
"""

from __future__ import annotations

import argparse
import shutil
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from lumenlog.operators.parse import attempt
from lumenlog.plans.report import render
from lumenlog.sources.lines import read_lines, read_stdin, write_rejects


def main(args: list[str]) -> int:
    asked = argparse.ArgumentParser(prog="lumenlog", description=__doc__)
    asked.add_argument("path", nargs="?", help="file, folder or glob; standard input without it")
    asked.add_argument("--rejects", help="folder for the lines that are no log lines")
    asked.add_argument("--split-bytes", type=int, help="bytes of a file that a task reads at most")
    own = asked.parse_args(args)
    spark = SparkSession.builder.appName("lumenlog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        lines = read_lines(spark, own.path, own.split_bytes) if own.path else read_stdin(spark)
    except AnalysisException as e:
        print(e.getErrorClass() or str(e), own.path)
        return 1
    rows = attempt(lines)
    rejected = rows.where("not accepted").select("value")
    if own.rejects:
        write_rejects(rejected, own.rejects)
    elif spark.sparkContext.master.startswith("local"):
        for r in rejected.toLocalIterator(prefetchPartitions=True):
            print(r.value, file=sys.stderr)
    for line in render(rows.where("accepted").drop("value", "accepted"), shutil.get_terminal_size((80, 24)).columns, color=sys.stdout.isatty()):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
