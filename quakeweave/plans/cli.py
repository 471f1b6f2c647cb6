"""Command line: run a relocation, build travel times, compare catalogs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quakeweave.operators.compare import compare_catalogs, event_errors
from quakeweave.plans import pipeline
from quakeweave.plans.config import load_config
from quakeweave.sources import sinks, text


def session() -> SparkSession:
    return SparkSession.builder.appName("quakeweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def compare_files(spark: SparkSession, catalog_path: str, truth_path: str, prefix: str) -> dict:
    """Metrics of a relocated catalog; row k of the truth file is event k.  Writes <prefix>_metrics.csv and <prefix>_event_errors.csv."""
    at = lambda k: F.element_at("v", k)
    catalog = text.read_numeric_matrix(spark, catalog_path, "#", True).select(at(-1).cast("long").alias("event_id"), at(7).alias("lat"), at(8).alias("lon"), at(9).alias("depth_km"))
    rows = text.read_numeric_matrix(spark, truth_path, "#", True)
    truth = rows.select(F.expr("row_number() over (order by line_no)").cast("long").alias("event_id"), at(1).alias("lat"), at(2).alias("lon"), at(3).alias("depth_km"))
    metrics = compare_catalogs(catalog, truth)
    names = ("events", "neighboring_pairs", "mean_horizontal_accuracy_km", "mean_depth_accuracy_km", "median_horizontal_accuracy_km", "median_depth_accuracy_km", "chamfer_distance_km", "mean_horizontal_precision_km", "mean_depth_precision_km")
    sinks.write_csv(f"{prefix}_metrics.csv", metrics.select(*names), "events")
    sinks.write_csv(f"{prefix}_event_errors.csv", event_errors(catalog, truth), "EventID")
    return metrics.first().asDict()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quakeweave")
    commands = p.add_subparsers(dest="command", required=True)
    relocate = commands.add_parser("relocate", help="run a relocation")
    relocate.add_argument("config", nargs="?", default="config.toml")
    relocate.add_argument("--build-tt-only", action="store_true", help="stop once travel times are there")
    relocate.add_argument("--force-rebuild-tt", action="store_true")
    build = commands.add_parser("build-travel-times", help="build the travel-time table")
    build.add_argument("config", nargs="?", default="config.toml")
    build.add_argument("--force", action="store_true")
    compare = commands.add_parser("compare", help="compare a relocated catalog with true locations")
    compare.add_argument("catalog")
    compare.add_argument("truth")
    compare.add_argument("prefix", nargs="?", default="comparison")
    a = p.parse_args(argv)
    if a.command == "compare":
        print(compare_files(session(), a.catalog, a.truth, a.prefix))
        return 0
    config = load_config(a.config)
    if a.command == "build-travel-times":
        pipeline.build_travel_times(session(), config, a.force)
        return 0
    if a.build_tt_only:
        config["run"]["build_travel_times_only"] = True
    pipeline.run(session(), config, a.force_rebuild_tt)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
