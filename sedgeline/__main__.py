"""python -m sedgeline tasks | download | filter | features | som ...: the phases from the command line."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from sedgeline import runs
from sedgeline.operators import som, stages
from sedgeline.params import DEFAULT, Params
from sedgeline.sources import archives, download, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sedgeline")
    top.add_argument("--verbose", action="store_true", help="say more of what is done")
    phases = top.add_subparsers(dest="phase", required=True)
    tasks = phases.add_parser("tasks", help="files of a saved catalog that are still to be fetched")
    tasks.add_argument("--catalog", required=True)
    tasks.add_argument("--state")
    tasks.add_argument("--year-start", type=int, default=2011)
    tasks.add_argument("--year-end", type=int, default=2024)
    tasks.add_argument("--output", help="folder for the list; without it the list is printed")
    fetched = phases.add_parser("download", help="archives of a catalog that are still to be fetched")
    fetched.add_argument("--catalog", required=True, help="a saved catalog, or its address")
    fetched.add_argument("--url", required=True, help="address of an archive, with {item_code} and {fiscal_year}")
    fetched.add_argument("--root", default=".", help="folder in which dataset/ is")
    fetched.add_argument("--state", default="download_state")
    fetched.add_argument("--year-start", type=int, default=2011)
    fetched.add_argument("--year-end", type=int, default=2024)
    fetched.add_argument("--delay", type=float, default=2.0, help="seconds to wait after an archive")
    fetched.add_argument("--attempts", type=int, default=3)
    fetched.add_argument("--backoff", type=float, default=5.0, help="seconds before the second attempt; they double")
    fetched.add_argument("--timeout", type=float, default=60.0)
    fetched.add_argument("--connections", type=int, default=1, help="archives that are fetched at once")
    fetched.add_argument("--dry-run", action="store_true", help="print the tasks only")
    found = phases.add_parser("filter", help="archives to filtered measurements")
    found.add_argument("--dataset-dir", default="dataset")
    found.add_argument("--output-dir", default="output")
    found.add_argument("--distance-cutoff", type=float, default=DEFAULT.distance_cutoff_km)
    found.add_argument("--dose-threshold", type=float)
    found.add_argument("--min-temporal-points", type=int, default=DEFAULT.min_dates)
    found.add_argument("--csv", action="store_true")
    found.add_argument("--dry-run", action="store_true")
    found.add_argument("--sensitivity", action="store_true")
    features = phases.add_parser("features", help="filtered measurements to a feature matrix")
    features.add_argument("--input", default="output/filtered")
    features.add_argument("--output-dir", default="output")
    features.add_argument("--early-late-cutoff", default=DEFAULT.early_late_cutoff)
    features.add_argument("--csv", action="store_true")
    features.add_argument("--dry-run", action="store_true")
    maps = phases.add_parser("som", help="a feature matrix to clusters")
    maps.add_argument("--input", default="output/feature_matrix")
    maps.add_argument("--scaling", default="output/feature_summary")
    maps.add_argument("--output-dir", default="output")
    maps.add_argument("--rlen", type=int, default=20, help="passes over the rows")
    maps.add_argument("--alpha", type=float, nargs=2, default=(0.05, 0.01), metavar=("FIRST", "LAST"), help="rate of a presentation, falling over the passes")
    maps.add_argument("--shares", type=int, default=1, help="a pass shows one of so many shares of the rows")
    maps.add_argument("--bubble", action="store_true", help="all neurons within the radius learn alike")
    maps.add_argument("--batch", action="store_true", help="train by means of whole passes, without rates")
    return top


def show(df: DataFrame) -> None:
    """Every row, a line each; rows come from Spark in parts."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.phase == "filter" and args.sensitivity and args.dose_threshold is not None:
        print("--sensitivity compares fixed thresholds: leave --dose-threshold out", file=sys.stderr)
        return 1
    logging.basicConfig(format="%(asctime)s %(levelname)-8s %(message)s", level=logging.WARNING)
    logging.getLogger("sedgeline").setLevel(logging.DEBUG if args.verbose else logging.INFO)
    if args.phase in ("tasks", "download") and args.year_start > args.year_end:
        print("--year-start is after --year-end", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("sedgeline").getOrCreate()
    if args.phase == "tasks":
        tasks = runs.plan_downloads(spark, args.catalog, args.state, args.year_start, args.year_end)
        tables.write_csv(tasks, args.output, mark=False) if args.output else show(tasks)
    elif args.phase == "download":
        catalog = args.catalog
        if catalog.startswith(("http://", "https://")):
            runs.fetch_catalog(spark, catalog, f"{args.root}/_catalog", args.timeout)
            catalog = f"{args.root}/_catalog"
        if args.dry_run:
            show(runs.plan_downloads(spark, catalog, args.state, args.year_start, args.year_end))
        else:
            settings = download.Settings(args.url, args.attempts, args.backoff, timeout=args.timeout, delay=args.delay)
            made = runs.download_archives(spark, catalog, settings, args.root, args.state, args.year_start, args.year_end, args.connections)
            print("\n".join(f"{k}: {v}" for k, v in made.items()))
    elif args.phase == "filter":
        threshold = DEFAULT.dose_threshold if args.dose_threshold is None else args.dose_threshold
        params = Params(distance_cutoff_km=args.distance_cutoff, dose_threshold=threshold, min_dates=args.min_temporal_points)
        if args.dry_run:
            show(archives.inventory(spark, args.dataset_dir).orderBy("source_class", "source_item"))
        elif args.sensitivity:
            runs.compare_thresholds(spark, args.dataset_dir, args.output_dir, params)
        else:
            runs.filter_measurements(spark, args.dataset_dir, args.output_dir, params, args.csv)
    elif args.phase == "features":
        if args.dry_run:
            stages.profile(tables.read_checked(spark, args.input)).show(truncate=False)
        else:
            runs.build_features(spark, args.input, args.output_dir, Params(early_late_cutoff=args.early_late_cutoff), args.csv)
    else:
        how = som.Training(args.rlen, None if args.batch else tuple(args.alpha), args.shares, args.bubble)
        runs.cluster_features(spark, args.input, args.scaling, args.output_dir, how=how)
    return 0


if __name__ == "__main__":
    sys.exit(main())
