"""Registered queries over the catalog-shaped views, with their SQL.

Reals are rounded to six digits on both sides, as engines differ in the last bits of
trigonometric functions and in the order of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.functions import calendar, geo, robust
from quakeweave.operators import bias, compare, constraints, graph, knn, observations, solver, traveltime, uncertainty
from quakeweave.plans import pipeline
from quakeweave.plans.config import default_config
from quakeweave.sources import views

DEGREE = 2
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH RECURSIVE") else f"WITH {views.SQL}" + ("," + sql if not sql.lstrip().upper().startswith("SELECT") else sql)
        return f

    return put


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _theta(spark: SparkSession, d: str) -> DataFrame:
    return observations.grouped(views.theta(spark, d), views.theta_std(spark, d))


def _star(spark: SparkSession, d: str) -> DataFrame:
    return observations.star_observations(_theta(spark, d), views.stations(spark, d), views.catalog(spark, d), minimum_degree=DEGREE)


def _candidates(spark: SparkSession, d: str, k: int = 20, mutual: bool = True) -> DataFrame:
    p, axes = graph.metric_points(views.points(spark, d))
    return knn.undirected(knn.nearest(p, p, k, axes), mutual)


def _dd(spark: SparkSession, d: str, degree: int = DEGREE, **options) -> DataFrame:
    return observations.dd_candidates(_theta(spark, d), views.stations(spark, d), views.catalog(spark, d), _candidates(spark, d), minimum_degree=degree, **options)


_SIGMA = "CASE WHEN {a}.has_sigma THEN sqrt(power(coalesce(abs({a}.sigma), 0.002::DOUBLE), 2) + power(coalesce(abs({b}.sigma), 0.002::DOUBLE), 2)) ELSE sqrt(2::DOUBLE) * 0.002::DOUBLE END"
_STAR = f"""
star AS (
  SELECT e.event_id AS i, r.event_id AS j, ci.row_idx AS row_i, cj.row_idx AS row_j, e.theta_s - r.theta_s AS dt, {_SIGMA.format(a="e", b="r")} AS sigma, e.station, e.phase, e.group_idx
  FROM joined e JOIN joined r ON e.group_idx = r.group_idx AND e.ref_id = r.event_id
  JOIN stations s ON s.station = e.station JOIN catalog ci ON ci.event_id = e.event_id JOIN catalog cj ON cj.event_id = r.event_id
  WHERE e.event_id <> e.ref_id AND (NOT e.has_degree OR e.degree >= {DEGREE}))
"""
_KNN = """
m AS (SELECT event_id, x, y, 0.5::DOUBLE * z AS z FROM points),
d AS (SELECT a.event_id AS source, b.event_id AS target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM m a JOIN m b ON a.event_id <> b.event_id),
nn AS (SELECT source, target, dist FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY dist, target) <= 20),
cand AS (SELECT least(source, target) AS i, greatest(source, target) AS j, min(dist) AS dist FROM nn GROUP BY 1, 2 HAVING count(*) = 2)
"""
_DD = f"""
edge AS (
  SELECT CASE WHEN a.row_idx < b.row_idx THEN c.i ELSE c.j END AS i, CASE WHEN a.row_idx < b.row_idx THEN c.j ELSE c.i END AS j, least(a.row_idx, b.row_idx) AS row_i, greatest(a.row_idx, b.row_idx) AS row_j
  FROM cand c JOIN catalog a ON a.event_id = c.i JOIN catalog b ON b.event_id = c.j),
dd AS (
  SELECT e.i, e.j, e.row_i, e.row_j, a.theta_s - b.theta_s AS dt, {_SIGMA.format(a="a", b="b")} AS sigma, a.station, a.phase, a.group_idx
  FROM edge e JOIN joined a ON a.event_id = e.i JOIN joined b ON b.event_id = e.j AND b.group_idx = a.group_idx AND b.ref_id = a.ref_id JOIN stations s ON s.station = a.station
  WHERE (NOT a.has_degree OR a.degree >= {DEGREE}) AND (NOT b.has_degree OR b.degree >= {DEGREE}))
"""
_OBS = "SELECT i, j, row_i, row_j, round(dt, 6) AS dt, round(sigma, 6) AS sigma, station, phase, group_idx FROM "


def _shown(obs: DataFrame) -> DataFrame:
    return obs.select("i", "j", "row_i", "row_j", r6("dt", "dt"), r6("sigma", "sigma"), "station", "phase", F.col("group_idx").cast("long").alias("group_idx"))


@query("SELECT group_idx, station, phase, event_id, round(theta_s, 6) AS theta_s, ref_id, round(sigma, 6) AS sigma, degree, has_sigma FROM joined")
def theta_groups(spark, d):
    t = _theta(spark, d)
    return t.select(F.col("group_idx").cast("long").alias("group_idx"), "station", "phase", "event_id", r6("theta_s", "theta_s"), "ref_id", F.when(~F.isnan("sigma"), F.round("sigma", 6)).alias("sigma"), "degree", "has_sigma")


@query(_STAR + _OBS + "star")
def star_observations(spark, d):
    return _shown(_star(spark, d))


@query(_STAR + ", c AS (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM star) " + _OBS + "c WHERE n >= 8")
def star_minimum_per_event(spark, d):
    return _shown(observations.star_observations(_theta(spark, d), views.stations(spark, d), views.catalog(spark, d), minimum_degree=DEGREE, minimum_per_event=8))


@query("SELECT DISTINCT t.station FROM theta t WHERE t.station NOT IN (SELECT station FROM stations WHERE station <> 'R2')")
def missing_stations(spark, d):
    return observations.missing_stations(views.theta(spark, d), views.stations(spark, d).filter("station <> 'R2'"))


@query(_STAR + ", w AS (SELECT *, CASE WHEN abs(dt / sigma) <= 1.345 THEN 1.0::DOUBLE ELSE 1.345::DOUBLE / abs(dt / sigma) END / (sigma * sigma) AS w FROM star) SELECT station, phase, count(*) AS n, round(sqrt(sum(w * dt * dt) / sum(w)), 6) AS rms FROM w GROUP BY 1, 2")
def star_weighted_rms(spark, d):
    return _star(spark, d).groupBy("station", "phase").agg(F.count("*").alias("n"), r6(robust.robust_rms(F.col("dt"), F.col("sigma"), 1.345), "rms"))


@query(_KNN + "SELECT source, target, round(dist, 6) AS dist FROM nn")
def knn_directed(spark, d):
    p, axes = graph.metric_points(views.points(spark, d))
    return knn.nearest(p, p, 20, axes).select("source", "target", r6("dist", "dist"))


@query(_KNN + "SELECT i, j, round(dist, 6) AS dist FROM cand")
def knn_mutual(spark, d):
    return _candidates(spark, d).select("i", "j", r6("dist", "dist"))


@query(_KNN + ", u AS (SELECT least(source, target) AS i, greatest(source, target) AS j, min(dist) AS dist FROM nn GROUP BY 1, 2) SELECT i, j, round(dist, 6) AS dist FROM u")
def knn_either(spark, d):
    return _candidates(spark, d, mutual=False).select("i", "j", r6("dist", "dist"))


@query(_KNN + ", rad AS (SELECT source, target, dist FROM d WHERE dist <= 3000 QUALIFY row_number() OVER (PARTITION BY source ORDER BY dist, target) <= 20) SELECT source, target, round(dist, 6) AS dist FROM rad")
def knn_radius(spark, d):
    p, axes = graph.metric_points(views.points(spark, d))
    return knn.nearest(p, p, 20, axes, 3000.0).select("source", "target", r6("dist", "dist"))


@query(_KNN + "," + _DD + _OBS + "dd")
def dd_candidates(spark, d):
    return _shown(_dd(spark, d))


@query(_KNN + "," + _DD.replace(f">= {DEGREE}", ">= 6") + ", s AS (SELECT *, count(*) OVER (PARTITION BY i, j) AS n FROM dd) " + _OBS + "s WHERE n >= 6")
def dd_pair_support(spark, d):
    return _shown(observations.minimum_pair_support(_dd(spark, d, degree=6), 6))


_PEEL = ", p0 AS (SELECT * FROM dd)" + "".join(f", n{k} AS (SELECT v, count(*) AS n FROM (SELECT i AS v FROM p{k} UNION ALL SELECT j FROM p{k}) GROUP BY v), p{k + 1} AS (SELECT p.* FROM p{k} p JOIN n{k} a ON a.v = p.i JOIN n{k} b ON b.v = p.j WHERE a.n >= 12 AND b.n >= 12)" for k in range(10))


@query(_KNN + "," + _DD + _PEEL + _OBS + "p10")
def dd_peeled(spark, d):
    return _shown(observations.peel_low_support(_dd(spark, d), 12))


@query(_STAR + "SELECT v AS event_id, count(*) AS n FROM (SELECT i AS v FROM star UNION ALL SELECT j FROM star) GROUP BY v")
def event_counts(spark, d):
    return observations.event_counts(_star(spark, d))


@query(_STAR + "SELECT DISTINCT v AS event_id FROM (SELECT i AS v FROM star UNION ALL SELECT j FROM star)")
def event_activity(spark, d):
    return observations.event_activity(_star(spark, d))


_COMP = """
WITH RECURSIVE """ + views.SQL + "," + _KNN.replace("<= 20", "<= 3") + """,
ce AS (SELECT a.row_idx AS u, b.row_idx AS v FROM cand c JOIN catalog a ON a.event_id = c.i JOIN catalog b ON b.event_id = c.j),
reach AS (SELECT row_idx AS u, row_idx AS v FROM catalog UNION SELECT r.u, x.v FROM reach r JOIN (SELECT u, v FROM ce UNION ALL SELECT v, u FROM ce) x ON x.u = r.v),
fi AS (SELECT u, min(v) AS f FROM reach GROUP BY u)
SELECT c.event_id, dense_rank() OVER (ORDER BY f) AS comp_id, count(*) OVER (PARTITION BY f) AS comp_size FROM fi JOIN catalog c ON c.row_idx = fi.u
"""


@query(_COMP)
def graph_components(spark, d):
    out = graph.graph_components(views.catalog(spark, d), _candidates(spark, d, 3))
    return out.select("event_id", F.col("comp_id").cast("long").alias("comp_id"), F.col("comp_size").cast("long").alias("comp_size"))


@query(_KNN + ", xy AS (SELECT c.i, c.j, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM cand c JOIN points a ON a.event_id = c.i JOIN points b ON b.event_id = c.j) SELECT i, j, round(sqrt(dx * dx + dy * dy + 0.25 * dz * dz), 6) AS d_metric, round(sqrt(dx * dx + dy * dy), 6) AS d_xy, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS d_xyz FROM xy")
def edge_distances(spark, d):
    return graph.edge_distances(_candidates(spark, d), views.points(spark, d)).select("i", "j", r6("d_metric", "d_metric"), r6("d_xy", "d_xy"), r6("d_xyz", "d_xyz"))


@query()
def greedy_capped_graph(spark, d):
    return graph.greedy_capped(_candidates(spark, d), 6, [F.col("dist"), F.col("i"), F.col("j")]).select("i", "j", r6("dist", "dist"))


_X = "6371000.0::DOUBLE * cos(radians(35.7::DOUBLE)) * atan2(sin(radians(lon) - radians(-117.7::DOUBLE)), cos(radians(lon) - radians(-117.7::DOUBLE)))"
_Y = "6371000.0::DOUBLE * (radians(lat) - radians(35.7::DOUBLE))"


@query(f"SELECT event_id, round({_X}, 5) AS x, round({_Y}, 5) AS y, round(depth_km * 1000.0::DOUBLE, 5) AS z FROM catalog")
def local_coordinates(spark, d):
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), 35.7, -117.7)
    return views.catalog(spark, d).select("event_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(geo.depth_to_internal(F.col("depth_km")), 5).alias("z"))


@query("SELECT round(avg(lat), 6) AS lat0, round(degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))), 6) AS lon0 FROM stations")
def reference_point(spark, d):
    return views.stations(spark, d).agg(r6(F.avg("lat"), "lat0"), r6(geo.circular_mean_longitude(F.col("lon")), "lon0"))


@query("SELECT event_id, station, round(6371000.0::DOUBLE * acos(least(1.0::DOUBLE, sin(radians(c.lat)) * sin(radians(s.lat)) + cos(radians(c.lat)) * cos(radians(s.lat)) * cos(radians(c.lon - s.lon)))), 1) AS metres FROM catalog c, stations s")
def station_distances(spark, d):
    s = views.stations(spark, d).select("station", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    delta = geo.great_circle_delta(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    return views.catalog(spark, d).crossJoin(F.broadcast(s)).select("event_id", "station", F.round(geo.EARTH_RADIUS_M * delta, 1).alias("metres"))


@query(f", xy AS (SELECT event_id, {_X} AS x, {_Y} AS y FROM catalog), sx AS (SELECT station, {_X} AS sx, {_Y} AS sy FROM stations) SELECT round(max(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))), 4) AS required_m FROM xy, sx".lstrip(", "))
def required_range(spark, d):
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), 35.7, -117.7)
    s = views.stations(spark, d).select(x.alias("sx"), y.alias("sy"))
    return views.catalog(spark, d).select(x.alias("x"), y.alias("y")).crossJoin(F.broadcast(s)).agg(F.round(F.max(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))), 4).alias("required_m"))


@query("""
t0 AS (SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS dt, CASE WHEN o_orderkey % 2 = 0 THEN 86399.9::DOUBLE ELSE 0.1::DOUBLE END AS s, (o_orderkey % 15 - 7) / 10.0::DOUBLE AS inc FROM orders),
t1 AS (SELECT order_id, dt, s + inc AS total, floor((s + inc) / 86400.0)::INT AS k FROM t0),
t2 AS (SELECT order_id, dt, k, round(total - k * 86400.0, 6) AS rest FROM t1),
t3 AS (SELECT order_id, dt + (k + CASE WHEN rest >= 86400.0 THEN 1 ELSE 0 END) AS nd, rest - CASE WHEN rest >= 86400.0 THEN 86400.0 ELSE 0 END AS rest FROM t2)
SELECT order_id, year(nd) AS year, month(nd) AS month, day(nd) AS day, floor(rest / 3600)::BIGINT AS hour, floor((rest - 3600 * floor(rest / 3600)) / 60)::BIGINT AS minute,
  round(rest - 3600 * floor(rest / 3600) - 60 * floor((rest - 3600 * floor(rest / 3600)) / 60), 4) AS second FROM t3
""")
def origin_increments(spark, d):
    o = views.origin_times(spark, d)
    m = calendar.moved_origin(*[F.col(c) for c in calendar.FIELDS], F.col("increment"))
    out = o.select("order_id", m.alias("m"))
    return out.select("order_id", *[F.col(f"m.{c}").cast("long").alias(c) for c in calendar.FIELDS[:5]], F.round("m.second", 4).alias("second"))


@query("SELECT phase, round(quantile_cont(theta_s, 0.25), 6) AS q25, round(median(theta_s), 6) AS q50, round(quantile_cont(theta_s, 0.9), 6) AS q90 FROM theta GROUP BY phase")
def theta_quantiles(spark, d):
    v = F.col("theta_s")
    return views.theta(spark, d).groupBy("phase").agg(r6(robust.quantile(v, 0.25), "q25"), r6(robust.median(v), "q50"), r6(robust.quantile(v, 0.9), "q90"))


@query()
def catalog_accuracy(spark, d):
    both = compare.matched(views.catalog_tight(spark, d), views.truth(spark, d))
    return compare.accuracy(both).select("event_id", r6("horizontal_km", "horizontal_km"), r6("depth_km", "depth_km"))


@query()
def catalog_event_errors(spark, d):
    return compare.event_errors(views.catalog_tight(spark, d), views.truth(spark, d))


@query()
def catalog_metrics(spark, d):
    return compare.compare_catalogs(views.catalog_tight(spark, d), views.truth(spark, d))


def _frame_stations(spark, d):
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), 35.7, -117.7)
    return views.stations(spark, d).select("station", x.alias("x_m"), y.alias("y_m"), (-F.col("elev_m")).alias("z_m"))


def _predicted(spark, d):
    return solver.weighted(solver.predicted(_star(spark, d), views.points(spark, d), _frame_stations(spark, d), traveltime.ConstantModel()), 0.002, 1.345)


_PRED = _STAR + f""",
st AS (SELECT station, {_X} AS sx, {_Y} AS sy, -elev_m AS sz FROM stations),
v AS (SELECT s.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sx, sy, sz, CASE WHEN phase = 'P' THEN 6000.0::DOUBLE ELSE 3464.0::DOUBLE END AS v
      FROM star s JOIN points a ON a.event_id = s.i JOIN points b ON b.event_id = s.j JOIN st ON st.station = s.station),
ra AS (SELECT *, sqrt((ax - sx) * (ax - sx) + (ay - sy) * (ay - sy) + (az - sz) * (az - sz)) AS da, sqrt((bx - sx) * (bx - sx) + (by_ - sy) * (by_ - sy) + (bz - sz) * (bz - sz)) AS db FROM v),
pr AS (SELECT *, da / v - db / v AS pred, dt - (da / v - db / v) AS r, greatest(sigma, 0.002::DOUBLE) AS sg FROM ra),
w AS (SELECT *, CASE WHEN abs(r / sg) <= 1.345 THEN 1.0::DOUBLE ELSE 1.345::DOUBLE / abs(r / sg) END / (sg * sg) AS w FROM pr)
"""


@query(_PRED + "SELECT i, j, station, phase, round(pred, 6) AS pred, round(r, 6) AS r, round(w, 3) AS w FROM w")
def predicted_residuals(spark, d):
    return _predicted(spark, d).select("i", "j", "station", "phase", r6("pred", "pred"), r6("r", "r"), F.round("w", 3).alias("w"))


@query(_PRED + """,
e AS (SELECT i AS ev, w, r, (ax - sx) / (v * da) AS gx, (ay - sy) / (v * da) AS gy, (az - sz) / (v * da) AS gz, 1.0::DOUBLE AS g FROM w
      UNION ALL SELECT j, w, r, -(bx - sx) / (v * db), -(by_ - sy) / (v * db), -(bz - sz) / (v * db), -1.0::DOUBLE FROM w)
SELECT ev AS event_id, round(sum(w * gx * gx), 6) AS xx, round(sum(w * gx * gz), 6) AS xz, round(sum(w * g * g), 3) AS tt, round(sum(w * r * gy), 3) AS ry, round(sum(w * r * g), 3) AS rt FROM e GROUP BY ev
""")
def normal_blocks(spark, d):
    b = solver.blocks(_predicted(spark, d)).filter("a = b")
    return b.select(F.col("a").alias("event_id"), r6("m00", "xx"), r6("m02", "xz"), F.round("m33", 3).alias("tt"), F.round("r1", 3).alias("ry"), F.round("r3", 3).alias("rt"))


@query(_PRED + "SELECT least(i, j) AS a, greatest(i, j) AS b, round(sum(-w * (ax - sx) / (v * da) * (bx - sx) / (v * db)), 6) AS xx, round(sum(-w), 3) AS tt FROM w GROUP BY 1, 2")
def pair_blocks(spark, d):
    b = solver.blocks(_predicted(spark, d)).filter("a <> b")
    return b.select("a", "b", r6("m00", "xx"), F.round("m33", 3).alias("tt"))


@query(_STAR + ", f AS (SELECT group_idx, dense_rank() OVER (ORDER BY group_idx) AS k FROM (SELECT DISTINCT group_idx FROM star)) SELECT k AS block, count(*) AS n, round(sum(dt), 5) AS total FROM star JOIN f USING (group_idx) GROUP BY k")
def bootstrap_blocks(spark, d):
    b = uncertainty.bootstrap_blocks(_star(spark, d))
    return b.groupBy(F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"), F.round(F.sum("dt"), 5).alias("total"))


@query(_STAR + ", f AS (SELECT station, dense_rank() OVER (ORDER BY g) AS k FROM (SELECT station, min(group_idx) AS g FROM star GROUP BY station)) SELECT s.i, s.j, s.station, s.phase FROM star s JOIN f USING (station), generate_series(1, k % 3) t")
def bootstrap_resample(spark, d):
    b = uncertainty.bootstrap_blocks(_star(spark, d), "station")
    counts = b.select("block").distinct().select("block", (F.col("block") % 3).alias("times")).filter("times > 0")
    return uncertainty.resampled(b, counts).select("i", "j", "station", "phase")


@query(_KNN + "," + _DD + "," + _STAR + """,
comp AS (SELECT event_id, 0 AS k FROM catalog),
deg AS (SELECT v, count(*) AS n FROM (SELECT i AS v FROM cand UNION ALL SELECT j FROM cand) GROUP BY v),
pd AS (SELECT v, count(*) AS n FROM (SELECT i AS v FROM (SELECT DISTINCT i, j FROM dd) UNION ALL SELECT j FROM (SELECT DISTINCT i, j FROM dd)) GROUP BY v),
sc AS (SELECT v, count(*) AS n FROM (SELECT i AS v FROM star UNION ALL SELECT j FROM star) GROUP BY v),
dc AS (SELECT v, count(*) AS n FROM (SELECT i AS v FROM dd UNION ALL SELECT j FROM dd) GROUP BY v)
SELECT c.event_id, coalesce(deg.n, 0) AS geometry_degree, coalesce(pd.n, 0) AS dd_pair_degree, coalesce(sc.n, 0) AS prelocation_observations, coalesce(dc.n, 0) AS dd_observations, CASE WHEN sc.n > 0 THEN 1 ELSE 0 END AS prelocation_used, CASE WHEN dc.n > 0 THEN 1 ELSE 0 END AS relocation_used
FROM catalog c LEFT JOIN deg ON deg.v = c.event_id LEFT JOIN pd ON pd.v = c.event_id LEFT JOIN sc ON sc.v = c.event_id LEFT JOIN dc ON dc.v = c.event_id
""")
def graph_metadata(spark, d):
    catalog, edges = views.catalog(spark, d), _candidates(spark, d)
    nodes = graph._degrees(catalog, edges).join(graph.graph_components(catalog, edges), "event_id")
    out = graph.graph_metadata(catalog, nodes, _star(spark, d), _dd(spark, d))
    return out.select(F.col("EventID").alias("event_id"), "geometry_degree", "dd_pair_degree", "prelocation_observations", "dd_observations", "prelocation_used", "relocation_used")


@query("SELECT event_id, round(CASE WHEN z < 4000.0 THEN 2 * 4500.0::DOUBLE - z ELSE z END, 6) AS z, z < 4000.0 AS violates FROM points")
def reflected_depths(spark, d):
    config = default_config()
    config["constraints"]["depth_bound"] |= {"enabled": True, "minimum_depth_km": 4.0, "mirror_plane": "manual", "mirror_depth_km": 4.5}
    state = views.points(spark, d)
    bad = constraints.violations(state, config).select("event_id", F.lit(True).alias("v"))
    out = state.withColumn("z", F.when(~constraints.feasible(F.col("z"), config), 2 * constraints.mirror_plane(views.stations(spark, d), config) - F.col("z")).otherwise(F.col("z")))
    return out.join(bad, "event_id", "left").select("event_id", r6("z", "z"), F.coalesce("v", F.lit(False)).alias("violates"))


@query(_STAR + """,
act AS (SELECT DISTINCT v FROM (SELECT i AS v FROM star UNION ALL SELECT j FROM star))
SELECT p.event_id, round(CASE WHEN act.v IS NULL THEN 0 ELSE 1.5::DOUBLE END, 6) AS dx_m, round(CASE WHEN act.v IS NULL THEN 0 ELSE -2.0::DOUBLE END, 6) AS dz_m, round(CASE WHEN act.v IS NULL THEN 0 ELSE 0.25::DOUBLE END, 6) AS dt0_s FROM points p LEFT JOIN act ON act.v = p.event_id
""")
def cumulative_shift(spark, d):
    before = views.points(spark, d)
    after = before.select("event_id", (F.col("x") + 1.5).alias("x"), "y", (F.col("z") - 2.0).alias("z"), F.lit(0.25).alias("t0"))
    active = observations.event_activity(_star(spark, d))
    return pipeline.cumulative_shift(None, before, after, active).select("event_id", r6("dx_m", "dx_m"), r6("dz_m", "dz_m"), r6("dt0_s", "dt0_s"))


@query("""
b AS (SELECT station, phase, event_id, theta_s - 0.001::DOUBLE * x AS theta_s FROM theta JOIN points USING (event_id) WHERE station = 'R1' AND phase = 'P')
SELECT t.station, t.phase, t.event_id, round(coalesce(b.theta_s, t.theta_s), 6) AS theta_s FROM theta t LEFT JOIN b ON b.station = t.station AND b.phase = t.phase AND b.event_id = t.event_id
""")
def bias_applied(spark, d):
    model = spark.createDataFrame([("R1", "P", 0.001, 0.0, 0.0)], "station string, phase string, ax double, ay double, az double")
    t = bias.apply_bias(views.theta(spark, d), model, views.points(spark, d))
    return t.select("station", "phase", "event_id", r6("theta_s", "theta_s"))


@query("""
s AS (SELECT t.event_id, t.theta_s AS v FROM theta t),
g AS (SELECT event_id, count(*) AS n_valid, median(v) AS c, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, var_samp(v) AS cov FROM s GROUP BY event_id)
SELECT event_id, n_valid, round(c, 9) AS center, round(lo, 9) AS lower, round(hi, 9) AS upper, round(cov, 6) AS cov FROM g
""")
def bootstrap_summary(spark, d):
    t = views.theta(spark, d)
    samples = t.select(F.dense_rank().over(Window.partitionBy("event_id").orderBy("station", "phase")).alias("replicate"), "event_id", F.col("theta_s").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    nominal = t.select("event_id").distinct().select("event_id", *[F.lit(0.0).alias(a) for a in "xyz"])
    out = uncertainty.bootstrap_summary(samples, nominal, nominal, 10, default_config()["uncertainty"]["bootstrap"])
    cov = F.when(~F.isnan("cov_xx_m2"), F.round("cov_xx_m2", 6))
    return out.select("event_id", "n_valid", F.round("center_dx_m", 9).alias("center"), F.round("lower_dx_m", 9).alias("lower"), F.round("upper_dx_m", 9).alias("upper"), cov.alias("cov"))


@query()
def relocation(spark, d):
    """Stage 1 over the star observations."""
    options = default_config()["prelocation"]
    state, _ = solver.relocate(views.points(spark, d), _frame_stations(spark, d), _star(spark, d), traveltime.ConstantModel(), options)
    return state


@query()
def theta_bias_scan(spark, d):
    options = default_config()["experimental"]["bias"]
    return bias.scan_theta_bias(_star(spark, d), views.points(spark, d), _frame_stations(spark, d), traveltime.ConstantModel(), options)


@query()
def graph_augmented(spark, d):
    config = default_config()["graph"]
    config = config | {"ensure_connected": True, "augmentation": config["augmentation"] | {"enabled": True}}
    edges, _ = graph.build_event_graph(views.points(spark, d), views.catalog(spark, d), config)
    return edges


@query()
def linearized_uncertainty(spark, d):
    options = default_config()
    return uncertainty.linearized(views.points(spark, d), _frame_stations(spark, d), _star(spark, d), traveltime.ConstantModel(), options["prelocation"], options["uncertainty"]["linearized"])
