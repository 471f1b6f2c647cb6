"""Catalog-shaped views over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, phase, event_id, theta_s, ref_id, degree): the last entry of each event in its group."""
    e = _table(spark, sf_dir, "events").select(
        F.concat(F.lit("R"), (F.col("event_id") % 5).cast("string")).alias("station"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "P").otherwise("S").alias("phase"),
        "user_id", "event_id", "value",
    )
    g = e.groupBy("station", "phase", "user_id").agg(F.max_by("value", "event_id").alias("v"), F.count("*").alias("degree"))
    return g.select("station", "phase", (F.col("user_id") + 1).alias("event_id"), (F.col("v") / 1000).alias("theta_s"), (1 + F.col("user_id") % 4).alias("ref_id"), "degree")


def theta_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = theta(spark, sf_dir).filter((F.col("event_id") % 7 != 0) & ~((F.col("station") == "R4") & (F.col("phase") == "S")))
    return t.select("station", "phase", "event_id", (0.001 * (1 + F.col("degree") % 5)).alias("sigma_s"), "degree")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, x, y, z, t0) in metres and seconds."""
    top = _table(spark, sf_dir, "events").agg(F.max("user_id").alias("top"))
    e = _table(spark, sf_dir, "embeddings").join(F.broadcast(top), F.col("vec_id") <= F.col("top"))
    at = lambda k: F.element_at("embedding", k).cast("double")
    return e.select((F.col("vec_id") + 1).alias("event_id"), (20000 * at(1)).alias("x"), (20000 * at(2)).alias("y"), (5000 + 10000 * at(3)).alias("z"), F.lit(0.0).alias("t0"))


def catalog(spark: SparkSession, sf_dir: str, spread: float = 0.3, deep: float = 3.0) -> DataFrame:
    """(event_id, lat, lon, depth_km, row_idx, label); rows run against the ids, so that row order is not id order."""
    top = _table(spark, sf_dir, "events").agg(F.max("user_id").alias("top"))
    e = _table(spark, sf_dir, "embeddings").join(F.broadcast(top), F.col("vec_id") <= F.col("top"))
    at = lambda k: F.element_at("embedding", k).cast("double")
    return e.select(
        (F.col("vec_id") + 1).alias("event_id"), (35.7 + spread * at(1)).alias("lat"), (-117.6 + spread * at(2)).alias("lon"),
        (5 + deep * at(3)).alias("depth_km"), (F.col("top") + 1 - F.col("vec_id")).alias("row_idx"), "label",
    )


def catalog_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir, 0.06, 0.6)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_tight(spark, sf_dir).select("event_id", (F.col("lat") + 0.0005 * (F.col("label") - 5)).alias("lat"), "lon", (F.col("depth_km") + 0.05 * (F.col("label") - 5)).alias("depth_km"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return _table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), k.cast("string")).alias("station"), (35.5 + 0.1 * k).alias("lat"), (-117.9 + 0.1 * ((3 * k) % 5)).alias("lon"), (600.0 + 100.0 * k).alias("elev_m")
    )


def origin_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, year..second, increment): calendar numbers close to midnight and month ends."""
    o = _table(spark, sf_dir, "orders")
    d, even = F.col("o_orderdate"), F.col("o_orderkey") % 2 == 0
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.year(d).cast("double").alias("year"), F.month(d).cast("double").alias("month"), F.day(d).cast("double").alias("day"),
        F.when(even, 23.0).otherwise(0.0).alias("hour"), F.when(even, 59.0).otherwise(0.0).alias("minute"), F.when(even, 59.9).otherwise(0.1).alias("second"),
        ((F.col("o_orderkey") % 15 - 7) / 10.0).alias("increment"),
    )


#: The same views for DuckDB, to stand before a query.
SQL = """
theta AS (
  SELECT 'R' || (event_id % 5) AS station, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'P' ELSE 'S' END AS phase,
         user_id + 1 AS event_id, arg_max(value, events.event_id) / 1000 AS theta_s, 1 + user_id % 4 AS ref_id, count(*) AS degree
  FROM events GROUP BY 1, 2, user_id),
theta_std AS (
  SELECT station, phase, event_id, 0.001::DOUBLE * (1 + degree % 5) AS sigma_s, degree FROM theta
  WHERE event_id % 7 <> 0 AND NOT (station = 'R4' AND phase = 'S')),
flags AS (SELECT station, phase, dense_rank() OVER (ORDER BY station, phase) AS group_idx FROM (SELECT DISTINCT station, phase FROM theta)),
has AS (SELECT DISTINCT station, phase, true AS has_std FROM theta_std),
joined AS (
  SELECT f.group_idx, t.station, t.phase, t.event_id, t.theta_s, t.ref_id, s.sigma_s AS sigma, coalesce(s.degree, 0) AS degree,
         coalesce(h.has_std, false) AS has_sigma, coalesce(h.has_std, false) AS has_degree
  FROM theta t JOIN flags f USING (station, phase) LEFT JOIN has h USING (station, phase) LEFT JOIN theta_std s USING (station, phase, event_id)),
emb AS (
  SELECT vec_id, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3, label, (SELECT max(user_id) FROM events) AS top FROM embeddings),
points AS (
  SELECT vec_id + 1 AS event_id, 20000::DOUBLE * e1 AS x, 20000::DOUBLE * e2 AS y, 5000::DOUBLE + 10000::DOUBLE * e3 AS z, top + 1 - vec_id AS row_idx
  FROM emb WHERE vec_id <= top),
tight AS (
  SELECT vec_id + 1 AS event_id, 35.7::DOUBLE + 0.06::DOUBLE * e1 AS lat, -117.6::DOUBLE + 0.06::DOUBLE * e2 AS lon, 5::DOUBLE + 0.6::DOUBLE * e3 AS depth_km, label
  FROM emb WHERE vec_id <= top),
catalog AS (
  SELECT vec_id + 1 AS event_id, 35.7::DOUBLE + 0.3::DOUBLE * e1 AS lat, -117.6::DOUBLE + 0.3::DOUBLE * e2 AS lon, 5::DOUBLE + 3::DOUBLE * e3 AS depth_km, top + 1 - vec_id AS row_idx
  FROM emb WHERE vec_id <= top),
truth AS (SELECT event_id, lat + 0.0005::DOUBLE * (label - 5) AS lat, lon, depth_km + 0.05::DOUBLE * (label - 5) AS depth_km FROM tight),
stations AS (
  SELECT 'R' || r_regionkey AS station, 35.5::DOUBLE + 0.1::DOUBLE * r_regionkey AS lat, -117.9::DOUBLE + 0.1::DOUBLE * ((3 * r_regionkey) % 5) AS lon, 600::DOUBLE + 100::DOUBLE * r_regionkey AS elev_m
  FROM region)
"""
