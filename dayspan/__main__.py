"""Command line: run registered queries and write their results.

    python -m dayspan --list
    python -m dayspan day_matrix --data /root/testdata/sf0.1 --out /shared/out/day_matrix --partition-by year

The session comes from ``spark-submit`` (or a local one when run directly);
results are written by the executors, never collected.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from dayspan.plans import catalog
from dayspan.session import drop_stage_tables, ensure_checkpoint_dir
from dayspan.sources.tables import write_table


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="dayspan")
    ap.add_argument("queries", nargs="*", help="names of registered queries")
    ap.add_argument("--list", action="store_true", help="list the registered queries")
    ap.add_argument("--data", default="/root/testdata/sf0.01", help="folder with the input tables")
    ap.add_argument("--out", help="output folder (one sub-folder per query)")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--partition-by", nargs="*", default=None)
    ap.add_argument("--keep-stage-tables", action="store_true", help="leave the stage tables of this run in the shared folder")
    args = ap.parse_args(argv)
    if args.list or not args.queries:
        for name in sorted(catalog.QUERIES):
            print(name, "(oracle)" if name in catalog.ORACLE else "(rows only)")
        return 0
    unknown = [q for q in args.queries if q not in catalog.QUERIES]
    if unknown:
        ap.error(f"unknown queries: {unknown}")
    if not args.out:
        ap.error("--out is required to run queries")
    builder = SparkSession.builder.appName("dayspan")
    if not SparkSession.getActiveSession():
        builder = builder.config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    for name in args.queries:
        df = catalog.QUERIES[name](spark, args.data)
        parts = [c for c in (args.partition_by or []) if c in df.columns]
        write_table(df, f"{args.out.rstrip('/')}/{name}", fmt=args.format, partition_by=parts or None)
        if not args.keep_stage_tables:
            drop_stage_tables(spark)
        print(f"{name}: written to {args.out.rstrip('/')}/{name}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
