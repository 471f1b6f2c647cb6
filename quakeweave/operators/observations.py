"""Theta groups and the two observation tables built from them.

A theta row is (group_idx, station, phase, event_id, theta_s, ref_id, sigma, degree,
has_sigma, has_degree).  An observation is (i, j, row_i, row_j, dt, sigma, station,
phase, group_idx), with i and j event ids and row_i, row_j their places in the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeweave.functions.robust import combined_sigma
from quakeweave.sources.storage import written

OBSERVATION = ("i", "j", "row_i", "row_j", "dt", "sigma", "station", "phase", "group_idx")


def grouped(theta: DataFrame, std: DataFrame | None = None) -> DataFrame:
    """Number the station-phase groups and attach uncertainties; a group without any has its flags false."""
    groups = theta.select("station", "phase").distinct()
    groups = groups.withColumn("group_idx", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("station", "phase")))  # a row per group
    if std is None:
        out = theta.withColumns({"sigma": F.lit(float("nan")), "degree": F.lit(0).cast("long"), "has": F.lit(False)})
    else:
        has = std.select("station", "phase").distinct().withColumn("has", F.lit(True))
        own = std.select("station", "phase", "event_id", F.col("sigma_s").alias("sigma"), F.col("degree").cast("long").alias("d"))
        out = theta.drop("degree").join(has, ["station", "phase"], "left").join(own, ["station", "phase", "event_id"], "left")
        out = out.withColumns({"sigma": F.coalesce("sigma", F.lit(float("nan"))), "degree": F.coalesce("d", F.lit(0)), "has": F.coalesce("has", F.lit(False))})
    out = out.join(groups, ["station", "phase"])
    return out.select("group_idx", "station", "phase", "event_id", "theta_s", "ref_id", "sigma", "degree", F.col("has").alias("has_sigma"), F.col("has").alias("has_degree"))


def _degree_ok(t: str, least: int) -> Column:
    return ~F.col(f"{t}.has_degree") | F.lit(least <= 0) | (F.col(f"{t}.degree") >= least)


def star_observations(
    theta: DataFrame, stations: DataFrame, catalog: DataFrame, *, minimum_degree: int = 6, minimum_sigma: float = 0.002, maximum_sigma: float = 0.0, minimum_per_event: int = 0
) -> DataFrame:
    """Each entry against its group's reference entry; both in the catalog, the station known."""
    known = theta.join(stations.select("station"), "station", "left_semi")
    rows = catalog.select("event_id", "row_idx")
    e = known.filter("event_id <> ref_id").alias("e")
    r = known.join(known.select("group_idx", F.col("ref_id").alias("event_id")).distinct(), ["group_idx", "event_id"], "left_semi").alias("r")  # references only: a few rows per group
    pairs = e.join(r, (F.col("e.group_idx") == F.col("r.group_idx")) & (F.col("e.ref_id") == F.col("r.event_id"))).filter(_degree_ok("e", minimum_degree))
    sigma = combined_sigma(F.col("e.sigma"), F.col("r.sigma"), F.col("e.has_sigma"), minimum_sigma)
    obs = pairs.select(
        F.col("e.event_id").alias("i"), F.col("r.event_id").alias("j"), (F.col("e.theta_s") - F.col("r.theta_s")).alias("dt"), sigma.alias("sigma"), F.col("e.station").alias("station"), F.col("e.phase").alias("phase"), F.col("e.group_idx").alias("group_idx")
    )
    obs = obs.join(rows.toDF("i", "row_i"), "i").join(rows.toDF("j", "row_j"), "j")
    if maximum_sigma > 0:
        obs = obs.filter(F.col("sigma") <= maximum_sigma)
    if minimum_per_event > 0:
        obs = obs.withColumn("n", F.count("*").over(Window.partitionBy("i"))).filter(F.col("n") >= minimum_per_event)
    return obs.select(*OBSERVATION)


def missing_stations(theta: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations of theta groups that the station table lacks."""
    return theta.select("station").distinct().join(stations, "station", "left_anti")


def dd_candidates(
    theta: DataFrame, stations: DataFrame, catalog: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, *, minimum_degree: int = 6, minimum_sigma: float = 0.002, maximum_sigma: float = 0.0, minimum_component: int = 0
) -> DataFrame:
    """For each edge and each group that holds both ends with one reference, their difference; the first end is the earlier catalog row."""
    known = theta.join(stations.select("station"), "station", "left_semi")
    rows = catalog.select("event_id", "row_idx")
    e = edges.select("i", "j").join(rows.toDF("i", "ri"), "i").join(rows.toDF("j", "rj"), "j")
    swap = F.col("ri") > F.col("rj")
    e = e.select(F.when(swap, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("j"), F.least("ri", "rj").alias("row_i"), F.greatest("ri", "rj").alias("row_j"))
    if minimum_component > 0 and nodes is not None:
        big = nodes.filter(F.col("comp_size") >= minimum_component).select("event_id")
        e = e.join(big.withColumnRenamed("event_id", "i"), "i", "left_semi").join(big.withColumnRenamed("event_id", "j"), "j", "left_semi")
    a, b = known.alias("a"), known.alias("b")
    both = e.alias("e").join(a, F.col("e.i") == F.col("a.event_id")).filter(_degree_ok("a", minimum_degree))
    both = both.join(b, (F.col("e.j") == F.col("b.event_id")) & (F.col("a.group_idx") == F.col("b.group_idx")) & (F.col("a.ref_id") == F.col("b.ref_id"))).filter(_degree_ok("b", minimum_degree))
    sigma = combined_sigma(F.col("a.sigma"), F.col("b.sigma"), F.col("a.has_sigma"), minimum_sigma)
    obs = both.select("e.i", "e.j", "e.row_i", "e.row_j", (F.col("a.theta_s") - F.col("b.theta_s")).alias("dt"), sigma.alias("sigma"), "a.station", "a.phase", "a.group_idx")
    return obs.filter(F.col("sigma") <= maximum_sigma) if maximum_sigma > 0 else obs


def minimum_pair_support(obs: DataFrame, least: int) -> DataFrame:
    """Observations of pairs that have that many."""
    if least <= 1:
        return obs
    n = F.count("*").over(Window.partitionBy(F.least("i", "j"), F.greatest("i", "j")))
    return obs.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def _ends(obs: DataFrame) -> DataFrame:
    return obs.select(F.explode(F.array("i", "j")).alias("event_id"))


def event_counts(obs: DataFrame) -> DataFrame:
    """(event_id, n): observations of each event, at either end."""
    return _ends(obs).groupBy("event_id").agg(F.count("*").alias("n"))


def event_activity(obs: DataFrame) -> DataFrame:
    return _ends(obs).distinct()


def peel_low_support(obs: DataFrame, least: int, rounds: int = 10) -> DataFrame:
    """Drop observations of events with too few, again and again, at most so many rounds."""
    if least <= 0:
        return obs
    obs = written(obs, "peel")
    before = obs.count()
    for _ in range(rounds):
        good = event_counts(obs).filter(F.col("n") >= least).select("event_id")
        obs = written(obs.join(good.withColumnRenamed("event_id", "i"), "i", "left_semi").join(good.withColumnRenamed("event_id", "j"), "j", "left_semi").select(*OBSERVATION), "peel")
        after = obs.count()
        if after in (0, before):
            break
        before = after
    return obs


def dd_observations(theta, stations, catalog, edges, nodes=None, *, minimum_pair: int = 6, minimum_event: int = 0, **options) -> DataFrame:
    """Double-difference observations after pair and event support filters."""
    obs = dd_candidates(theta, stations, catalog, edges, nodes, **options)
    return peel_low_support(minimum_pair_support(obs, minimum_pair), minimum_event)
