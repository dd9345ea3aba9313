"""python -m loomlight validate|analyze|sessions|export ... : a thin command line over the library."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomlight")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("validate", "what a file of spans can answer"), ("analyze", "tools, loops, failures and costs")):
        commands.add_parser(name, help=text).add_argument("path")
    s = commands.add_parser("sessions", help="session logs to rows")
    s.add_argument("adapter")
    s.add_argument("path")
    s.add_argument("--out", required=True)
    e = commands.add_parser("export", help="spans as JSON lines, redacted")
    e.add_argument("path")
    e.add_argument("--out", required=True)
    e.add_argument("--metadata-only", action="store_true")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .plans import reports
    from .sources import readers, sessions, writers

    spark = SparkSession.builder.appName("loomlight").getOrCreate()
    if args.command == "validate":
        text, ok = reports.validation_report(spark, args.path)
        print(text, end="")
        return 0 if ok else 1
    if args.command == "analyze":
        print(reports.analysis_report(spark, args.path), end="")
    elif args.command == "sessions":
        sessions.adapter(args.adapter)(spark, args.path).write.mode("overwrite").parquet(args.out)
    else:
        spans = writers.redact_spans(readers.merged(readers.read_spans(spark, args.path)[0])[0])
        if args.metadata_only:
            spans = spans.withColumn("content", spans["content"].substr(0, 0)).withColumn("status_message", spans["status_message"].substr(0, 0))
        writers.write_spans(spans, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
