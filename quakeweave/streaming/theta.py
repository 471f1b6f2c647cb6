"""An addition beyond batch relocation: star observations of theta entries as they arrive.

Arriving entries are joined with the groups' reference entries, which are there already,
so no state is kept and each entry gives its observation at once.  Repeated entries give
repeated observations; the batch run's rule that the last entry counts needs all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.functions.robust import combined_sigma

ENTRY = "group_idx int, station string, phase string, event_id long, theta_s double, ref_id long, sigma double, degree long, has_sigma boolean, has_degree boolean"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Theta entries from Parquet files as they appear in a folder."""
    return spark.readStream.schema(ENTRY).parquet(folder)


def star_stream(entries: DataFrame, references: DataFrame, *, minimum_degree: int = 6, minimum_sigma: float = 0.002) -> DataFrame:
    """(i, j, dt, sigma, station, phase, group_idx) of each arriving entry whose reference is known."""
    r = references.select(F.col("group_idx").alias("rg"), F.col("event_id").alias("j"), F.col("theta_s").alias("rt"), F.col("sigma").alias("rs"))
    e = entries.filter((F.col("event_id") != F.col("ref_id")) & (~F.col("has_degree") | F.lit(minimum_degree <= 0) | (F.col("degree") >= minimum_degree)))
    rows = e.join(r, (F.col("group_idx") == F.col("rg")) & (F.col("ref_id") == F.col("j")))
    sigma = combined_sigma(F.col("sigma"), F.col("rs"), F.col("has_sigma"), minimum_sigma)
    return rows.select(F.col("event_id").alias("i"), "j", (F.col("theta_s") - F.col("rt")).alias("dt"), sigma.alias("sigma"), "station", "phase", "group_idx")
