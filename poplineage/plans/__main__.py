"""Command line: ``spark-submit … poplineage/plans/__main__.py convert|chronicle|linear|analyze|report …``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from poplineage.plans import jobs
from poplineage.sources.event_log import read_initial
from poplineage.operators.events import cells_from_initial_file
from poplineage.sources.tables import save_parquet


def main() -> None:
    parser = argparse.ArgumentParser(prog="poplineage")
    commands = parser.add_subparsers(dest="job", required=True)
    for job in ("convert", "chronicle", "linear", "analyze", "report", "campaign"):
        command = commands.add_parser(job)
        command.add_argument("source")
        command.add_argument("target")
        if job == "chronicle":
            command.add_argument("--initial", help="file with the initial configuration")
            command.add_argument("--strict", action="store_true")
            command.add_argument("--parent-rule", default="previous_row", choices=["previous_row", "kind_aware"])
        if job == "convert":
            command.add_argument("--cut-off", action="store_true", help="files may be broken off")
        if job in ("analyze", "report", "campaign"):
            command.add_argument("threshold", nargs="?", type=int, default=jobs.muller.LARGE_CLONE)
    text = commands.add_parser("text")
    for name in ("source", "parents", "target"):
        text.add_argument(name)
    args = parser.parse_args()

    spark = SparkSession.builder.appName("poplineage").getOrCreate()
    if args.job == "convert":
        jobs.convert(spark, args.source, args.target, args.cut_off)
    elif args.job == "chronicle":
        cells = cells_from_initial_file(read_initial(spark, args.initial)) if args.initial else None
        jobs.chronicle(spark, args.source, args.target, cells, args.strict, args.parent_rule)
    elif args.job == "linear":
        jobs.linear_chronicle(spark, args.source, args.target)
    elif args.job == "text":
        for name, df in jobs.snapshot_text_analysis(spark, args.source, args.parents).items():
            save_parquet(df, f"{args.target}/{name}.parquet")
    elif args.job == "campaign":
        jobs.campaign(spark, args.source, args.target, args.threshold)
    else:
        kept = jobs.analyze(spark, args.source, args.target, args.threshold)
        if args.job == "report":
            for name, df in jobs.report(kept).items():
                save_parquet(df, f"{args.target}/report/{name}.parquet")


if __name__ == "__main__":
    main()
