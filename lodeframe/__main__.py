"""``python -m lodeframe --sql-file FILE | --plan-file FILE | --job FILE [--tables DIR] [--parquet OUT]``: runs a
script, a plan or a job and prints the last result, or writes it as Parquet. ``-`` reads the script from standard input."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lodeframe.session import Engine


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodeframe", description=__doc__)
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--sql-file", help="a script, or - for standard input")
    what.add_argument("--plan-file", help="a plan as JSON")
    what.add_argument("--job", help="a job (sql, tables, output) as JSON or YAML")
    parser.add_argument("--tables", help="a directory whose NAME.parquet become tables")
    parser.add_argument("--parquet", help="write the result here instead of printing it")
    parser.add_argument("--rows", type=int, default=100, help="rows to print at most")
    options = parser.parse_args(args)

    spark = SparkSession.builder.appName("lodeframe").getOrCreate()
    engine = Engine(spark)
    if options.tables:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(options.tables)
        for entry in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop):
            path = entry.getPath()
            if path.getName().endswith(".parquet"):
                engine.catalog.register_frame(path.getName().removesuffix(".parquet"), spark.read.parquet(path.toString()))
    if options.job:
        out = engine.run_job(options.job)
    elif options.plan_file:
        out = engine.run_plan_file(options.plan_file)
    else:
        out = engine.run_script(sys.stdin.read() if options.sql_file == "-" else Path(options.sql_file).read_text())
    if out is not None and out.columns:
        if options.parquet:
            engine.write_result(out, options.parquet)
        else:
            out.show(options.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
