"""Reference behaviour: configuration, sources, calendar, geometry, observations, graph, solver, uncertainty, a whole run."""

import math
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeweave.functions import calendar, geo
from quakeweave.operators import bias, compare, constraints, graph, knn, observations, solver, traveltime, uncertainty
from quakeweave.plans import catalogue, pipeline
from quakeweave.plans import config as cfg
from quakeweave.sources import sinks, text

DATA = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_defaults_are_valid_and_overrides_merge(tmp_path):
    cfg.validate(cfg.default_config())
    (tmp_path / "c.toml").write_text('[io]\ncatalog_file="a.txt"\n[graph]\nneighbors=7\nodd=1\n[travel_time]\ntype="constant"\n')
    with pytest.warns(UserWarning, match="graph.odd"):
        c = cfg.load_config(str(tmp_path / "c.toml"))
    assert c["io"]["catalog_file"] == str(tmp_path / "a.txt") and c["graph"]["neighbors"] == 7 and c["graph"]["maximum_degree"] == 30


@pytest.mark.parametrize(
    ("key", "value"),
    [
        ("catalog.origin_time_columns", [1, 2]), ("catalog.origin_time_columns", [1, 1, 2, 3, 4, 5]), ("catalog.origin_time_decimals", 13), ("graph.metric", "z"), ("graph.neighbors", 0), ("graph.depth_scale", 0.0), ("travel_time.type", "x"), ("travel_time.table_file", "a.bin"),
        ("lookup.depth_step_m", 0.0), ("lookup.station_depth_step_m", 1.0), ("gauge.mode", "x"), ("gauge.constraint_weight", 0.0), ("relocation.step_damping", 0.0), ("relocation.step_damping", 1.5), ("prelocation.linear_solver", "x"), ("run.prelocation", False),
        ("initialization.latitude", 91.0), ("constraints.depth_bound.event_ids", [1, 1]), ("constraints.depth_bound.reflected_prelocation_restart", True), ("uncertainty.bootstrap.confidence_level", 1.0), ("uncertainty.method", "x"), ("graph.augmentation.enabled", True), ("io.restart_shift_file", "x"),
    ],
)
def test_bad_configurations(key, value):
    c = cfg.default_config()
    *path, last = key.split(".")
    cfg.get(c, ".".join(path))[last] = value
    with pytest.raises(cfg.ConfigError):
        cfg.validate(c)


def test_origin_times(spark):
    def moved(values, inc, decimals=6):
        return tuple(one(spark, calendar.moved_origin(*[F.lit(float(v)) for v in values], F.lit(inc), decimals).alias("m"))["m"])

    assert moved((2024, 12, 31, 23, 59, 59.9), 0.2) == pytest.approx((2025, 1, 1, 0, 0, 0.1, True))
    assert moved((2025, 1, 1, 0, 0, 0.1), -0.2) == pytest.approx((2024, 12, 31, 23, 59, 59.9, True))
    assert moved((2024, 2, 28, 23, 59, 59.99), 0.02) == pytest.approx((2024, 2, 29, 0, 0, 0.01, True))
    assert moved((2024, 2, 30, 0, 0, 0), 1.0) == (2024, 2, 30, 0, 0, 0, False)
    assert moved((0, 0, 0, 0, 0, 0), 0.0) == (0, 0, 0, 0, 0, 0, True)
    assert moved((2024, 1, 1, 23, 59, 59.9999999), 0.0000002) == pytest.approx((2024, 1, 2, 0, 0, 0.0, True))


@pytest.mark.parametrize("value", [9007199254740991.0, 9007199254740992.0, 9007199254740994.0, 3.5, 0.0, -1.0, math.nan])
def test_event_ids(spark, value):
    get = lambda: one(spark, text.event_id(F.lit(value), "x").alias("e"))["e"]
    if value == 9007199254740991.0:
        assert get() == 9007199254740991
    else:
        with pytest.raises(Exception, match="2\\^53"):
            get()


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("lat lon\n# note\n2024,12,31,23,59,59.9 35.7 -117.6 5.0 1.2 20 % end\n2024 1 1 0 0 0 35.8 -117.5 6.0 1.0 10\n")
    rows = text.read_catalog(spark, str(tmp_path / "c.txt"), cfg.default_config()).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["event_id"], r["lat"], r["depth_km"], len(r["raw"])) for r in rows] == [(1, 20, 35.7, 5.0, 11), (2, 10, 35.8, 6.0, 11)]
    (tmp_path / "bad.txt").write_text("1 2 3\n4 x 6\n")
    with pytest.raises(Exception, match="non-numeric"):
        text.read_numeric_matrix(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "ragged.txt").write_text("1 2 3\n4 5\n")
    with pytest.raises(Exception, match="inconsistent"):
        text.read_numeric_matrix(spark, str(tmp_path / "ragged.txt")).collect()
    (tmp_path / "s.txt").write_text("A 35 -117 600\nXX B 35.1 -117.1 700 extra\n")
    assert [tuple(r) for r in text.read_stations(spark, str(tmp_path / "s.txt")).orderBy("station").collect()] == [("A", 35.0, -117.0, 600.0), ("B", 35.1, -117.1, 700.0)]
    for folder in ("theta", "std"):
        (tmp_path / folder).mkdir()
    (tmp_path / "theta/theta_A_B_p.txt").write_text("1 0.5 2\n1 0.7 2\n2 0 2\nnan 1 2\n3 nan 2\n")
    (tmp_path / "theta/theta_C_S.txt").write_text("5 0.1 5\n")
    (tmp_path / "std/std_theta_A_B_P.txt").write_text("1 0.01 2 9\n")
    got = text.load_theta_folder(spark, str(tmp_path / "theta"), str(tmp_path / "std")).orderBy("group_idx", "event_id").collect()
    assert [(r["group_idx"], r["station"], r["phase"], r["event_id"], r["theta_s"], r["degree"], r["has_sigma"]) for r in got] == [(1, "A_B", "P", 1, 0.7, 9, True), (1, "A_B", "P", 2, 0.0, 0, True), (2, "C", "S", 5, 0.1, 0, False)]
    (tmp_path / "vm.txt").write_text("0 4 2\n5 6 3\n5 7 4\n10 8 5\n")
    v = text.read_velocity_model(spark, str(tmp_path / "vm.txt"))
    assert traveltime.sample_layers(v["depth_m"], v["vp_ms"], np.array([-1e3, 0, 2500, 5000, 7500, 2e4])).tolist() == [4000, 4000, 5000, 7000, 7500, 8000]


def test_geometry(spark):
    frame = (35.5, -117.7)
    lat, lon = F.lit(35.61), F.lit(-117.55)
    x, y = geo.local_xy(lat, lon, *frame)
    back = one(spark, *[c.alias(n) for n, c in zip("ab", geo.local_ll(x, y, *frame), strict=True)])
    assert back["a"] == pytest.approx(35.61, abs=1e-12) and back["b"] == pytest.approx(-117.55, abs=1e-12)
    p = [F.lit(v) for v in (3000.0, -2000.0, 100.0, 500.0)]
    g = one(spark, geo.spherical_delta_gradient(*p, *frame).alias("g"))["g"]
    d = [one(spark, geo.spherical_delta(F.lit(3000.0 + h), F.lit(-2000.0 + k), p[2], p[3], *frame).alias("d"))["d"] for h, k in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    assert g["dx"] == pytest.approx((d[0] - d[1]) / 2, rel=1e-5) and g["dy"] == pytest.approx((d[2] - d[3]) / 2, rel=1e-5)
    km = lambda *v: one(spark, geo.wgs84_distance_km(*[F.lit(float(a)) for a in v]).alias("d"))["d"]
    assert km(0, 0, 0, 1) == pytest.approx(111.3194908, abs=1e-6) and km(10, 20, 10, 20) == 0 and km(-37.951033417, 144.424867889, -37.652821139, 143.926495528) == pytest.approx(54.972271, abs=1e-5)
    for kind in geo.VERTICAL:
        z = geo.depth_to_internal(F.lit(7.5), kind, 100.0)
        assert one(spark, geo.internal_to_depth(z, kind, 100.0).alias("d"))["d"] == pytest.approx(7.5)


def _theta(spark):
    rows = [(1, "A", "P", e, t, 20, 0.01, 10, True, True) for e, t in ((30, 0.5), (10, 0.3), (20, 0.0))]
    return spark.createDataFrame(rows, "group_idx int, station string, phase string, event_id long, theta_s double, ref_id long, sigma double, degree long, has_sigma boolean, has_degree boolean")


def test_observations_join_by_id(spark):
    catalog = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "row_idx long, event_id long")
    stations = spark.createDataFrame([("A",)], "station string")
    star = observations.star_observations(_theta(spark), stations, catalog).collect()
    assert {(r["row_i"], r["row_j"]) for r in star} == {(1, 3), (2, 3)} and all(r["sigma"] == pytest.approx(math.hypot(0.01, 0.01)) for r in star)
    edges = spark.createDataFrame([(30, 10, 1.0)], "i long, j long, dist double")
    dd = observations.dd_observations(_theta(spark), stations, catalog, edges, minimum_pair=1).collect()
    assert [(r["row_i"], r["row_j"], round(r["dt"], 9)) for r in dd] == [(1, 2, -0.2)]
    assert observations.star_observations(_theta(spark), stations, catalog, minimum_degree=11).isEmpty()


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(50, 0.01, (40, 3)), np.zeros((5, 3)), [[1e4, 0, 0]]])
    df = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    got = {}
    for r in knn.nearest(df, df, 4, ["x", "y", "z"]).collect():
        got.setdefault(r["source"], []).append((r["dist"], r["target"]))
    for i in range(len(p)):
        want = sorted((float(np.sqrt(((p[i] - p[j]) ** 2).sum())), j) for j in range(len(p)) if j != i)[:4]
        assert [t for _, t in sorted(got[i])] == [t for _, t in want]


def test_greedy_and_bridges_equal_one_pass(spark):
    rng = np.random.default_rng(4)
    pairs = sorted({tuple(sorted(rng.choice(25, 2, replace=False).tolist())) for _ in range(90)})
    edges = [(i, j, float(rng.integers(1, 20))) for i, j in pairs]
    want, degree = set(), np.zeros(25, int)
    order = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    for i, j, _ in order:
        if degree[i] < 3 and degree[j] < 3:
            want.add((i, j))
            degree[[i, j]] += 1
    df = spark.createDataFrame(edges, "i long, j long, dist double")
    got = graph.greedy_capped(df, 3, [F.col("dist"), F.col("i"), F.col("j")])
    assert {(r["i"], r["j"]) for r in got.collect()} == want
    few = df.filter("dist < 4")
    parent = list(range(25))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j, d in order:
        if d < 4:
            parent[root(i)] = root(j)
    forest = set()
    for i, j, _ in order:
        if root(i) != root(j):
            parent[root(i)] = root(j)
            forest.add((i, j))
    nodes = spark.range(25).select(F.col("id").alias("event_id"), (F.col("id") + 1).alias("row_idx"))
    assert {(r["i"], r["j"]) for r in graph.bridges(df, few, nodes).collect()} == forest


def test_eikonal():
    z, q = np.arange(-1000, 4001, 250.0), np.arange(0, 5001, 250.0)
    t, _, ok = traveltime.sweep(np.full(len(z), 5000.0), z, q, 8, "cartesian", 6371e3)
    assert ok and abs(t[8] - q / 5000).max() < 2e-7 and abs(t[:, 0] - abs(z - z[8]) / 5000).max() < 2e-7
    exact = np.hypot(z[:, None] - z[8], q[None, :]) / 5000
    assert (t >= exact - 1e-9).all() and (t - exact).max() < 0.06


def test_lookup_table(spark, tmp_path):
    options = cfg.default_config()["lookup"] | {"horizontal_step_m": 500.0, "depth_step_m": 500.0, "station_depth_step_m": 500.0}
    model = {"depth_m": [0.0, 20000.0], "vp_ms": [5000.0, 5000.0], "vs_ms": [3000.0, 3000.0], "sha256": "s"}
    axes = traveltime.lookup_grids(options | {"depth_margin_km": 1.0, "maximum_depth_km": 6.0}, 8000.0, (-600.0, -600.0), (2000.0, 5000.0), (0.0, 20000.0), "cartesian", 6371e3)
    traveltime.build_table(spark, str(tmp_path / "t.gstt"), options, model, axes, "cartesian", 6371e3, 6371e3)
    table = traveltime.load_table(spark, str(tmp_path / "t.gstt"), 0.0, 0.0)
    ok = lambda **k: traveltime.coverage(table, options, **({"requested": "auto", "sha256": "s", "earth_radius": 6371e3, "radius": 6371e3, "required": 8000.0, "station_z": (-600.0, -600.0), "event_z": (2000.0, 5000.0)} | k))
    assert ok() == (True, "serves the run") and not ok(sha256="x")[0] and not ok(required=1e6)[0] and not ok(requested="radial")[0]
    cell = [F.lit(v) for v in (3100.0, 1000.0, 3300.0, 0.0, 0.0, -600.0)]
    got = one(spark, table.expr(F.lit("P"), *cell).alias("t"))["t"]
    assert got["t"] == pytest.approx(math.sqrt(3100**2 + 1000**2 + 3900**2) / 5000, rel=0.08) and got["gx"] > 0 and got["gz"] > 0
    table.p = np.fromfunction(lambda i, j, k: 2 * i + 3 * j + 5 * k, table.p.shape).astype("f4")
    t, dq, dz = table.interpolate(table.p, np.array([250.0, 1e6]), np.array([table.z[0] + 250.0] * 2), np.array([table.zs[0]] * 2))
    assert t[0] == pytest.approx(2.5) and dq[0] == pytest.approx(2 / 500) and dz[0] == pytest.approx(3 / 500) and dq[1] == 0


def _synthetic(n=20, stations=8, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.uniform(-2000, 2000, (n, 4))
    truth[:, 2] += 8000
    truth[:, 3] = rng.normal(0, 0.05, n)
    truth[:, 3] -= truth[:, 3].mean()
    st = pd.DataFrame({"station": [f"S{k}" for k in range(stations)], "x_m": rng.uniform(-15e3, 15e3, stations), "y_m": rng.uniform(-15e3, 15e3, stations), "z_m": -800.0})
    rows = []
    for g, s in st.iterrows():
        for p, v in (("P", 6000.0), ("S", 3464.0)):
            t = np.sqrt(((truth[:, :3] - [s.x_m, s.y_m, s.z_m]) ** 2).sum(1)) / v + truth[:, 3]
            rows += [(i + 1, j + 1, i + 1, j + 1, t[i] - t[j], 0.002, s.station, p, 2 * g + (p == "S") + 1) for i in range(n) for j in range(i + 1, min(n, i + 6))]
    obs = pd.DataFrame(rows, columns=list(observations.OBSERVATION))
    start = truth + np.c_[rng.normal(0, 300, (n, 3)), rng.normal(0, 0.02, n)]
    return truth, st, obs, start


def _state(spark, v):
    return spark.createDataFrame(pd.DataFrame({"event_id": np.arange(1, len(v) + 1), **dict(zip(("x", "y", "z", "t0"), v.T, strict=True))}))


@pytest.fixture(scope="module")
def synthetic(spark):
    truth, st, obs, start = _synthetic()
    return truth, spark.createDataFrame(st), spark.createDataFrame(obs), start


OPTIONS = cfg.default_config()["relocation"] | {"max_outer_iterations": 12}


def test_relocation_recovers_truth(spark, synthetic):
    truth, st, obs, start = synthetic
    out, stats = solver.relocate(_state(spark, start), st, obs, traveltime.ConstantModel(), OPTIONS)
    v = out.orderBy("event_id").select("x", "y", "z", "t0").toPandas().to_numpy()
    error = v - truth
    assert abs(error[:, :3] - error[:, :3].mean(0)).max() < 15 and abs(v[:, 3].mean()) < 1e-12 and stats.rms_s[-1] < stats.rms_s[0] / 20


def test_bound_and_pins(spark, synthetic):
    truth, st, obs, start = synthetic
    start = start.copy()
    start[:, 2] = start[:, 2].clip(8000)
    bound = solver.Bound(np.ones(len(start), bool), 8000.0, 1.0)
    out, stats = solver.relocate(_state(spark, start), st, obs, traveltime.ConstantModel(), OPTIONS | {"max_outer_iterations": 4}, frozen={3: "xyz"}, bound=bound)
    v = out.orderBy("event_id").select("x", "y", "z", "t0").toPandas().to_numpy()
    assert (v[:, 2] >= 8000 - 1e-6).all() and stats.bound_hits and (v[2, :3] == start[2, :3]).all()


@pytest.mark.parametrize("kind", ["origin_time", "xyzt0", "xyzt0_scaled", "none"])
def test_blocks_equal_the_matrix(spark, synthetic, kind):
    truth, st, obs, start = synthetic
    state = _state(spark, start)
    ids = np.arange(1, len(start) + 1)
    gauge = solver.gauge_weights(kind, len(ids), 10.0, 5000.0)
    system, _ = solver.assembled(obs, state, st, traveltime.ConstantModel(), OPTIONS, ids, gauge)
    rows = solver.weighted(solver.predicted(obs, state, st, traveltime.ConstantModel()), 0.002, 1.345).toPandas()
    a = np.zeros((len(rows), len(ids), 4))
    k = np.arange(len(rows))
    for e, sign in (("i", 1), ("j", -1)):
        a[k, rows[e] - 1, :3] += sign * rows[[f"g{e}{d}" for d in "xyz"]].to_numpy()
        a[k, rows[e] - 1, 3] += sign
    a *= np.sqrt(rows["w"].to_numpy())[:, None, None]
    extra = []
    for p in range(4):
        g = np.zeros((len(ids), 4))
        g[:, p] = math.sqrt(gauge[p])
        extra.append(g.ravel())
    flat = np.concatenate([a.reshape(len(rows), -1), extra])
    v = np.random.default_rng(1).normal(size=(len(ids), 4))
    assert np.allclose(system.apply(v).ravel(), flat.T @ (flat @ v.ravel()) + system.damping * v.ravel(), rtol=1e-9)
    assert np.allclose(system.rhs.ravel(), a.reshape(len(rows), -1).T @ (np.sqrt(rows["w"]) * rows["r"]))
    active = np.ones_like(v, bool)
    rhs = system.apply(v)
    for how in ("block_jacobi", "diagonal", "none"):
        x, _, ok = solver.pcg(system.apply, rhs, system.preconditioner(active, how), 1e-10, 2000)
        assert ok and np.allclose(system.apply(x), rhs, rtol=1e-6, atol=1e-6 * abs(rhs).max())


def test_small_solves():
    m = np.array([[4.0, 1.0], [1.0, 3.0]])
    x, n, ok = solver.pcg(lambda v: m @ v, np.array([1.0, 2.0]), lambda r: r.copy(), 1e-12, 10)
    assert ok and n <= 2 and np.allclose(m @ x, [1, 2])
    x, _, _ = solver.direct(lambda v: (m @ v.ravel()).reshape(v.shape), np.array([[1.0, 2.0]]), np.array([[True, False]]))
    assert np.allclose(x, [[0.25, 0]])
    assert np.allclose(solver.limited(np.array([[3.0, 4.0, 0, 1.0]]), {"max_event_step_m": 1.0, "max_origin_step_s": 0.5}), [[0.6, 0.8, 0, 0.5]])


def test_constraints(spark):
    c = cfg.default_config()
    c["constraints"]["depth_bound"] |= {"enabled": True, "minimum_depth_km": -1.0, "reflected_prelocation_restart": True}
    st = spark.createDataFrame([(-800.0,), (-600.0,), (-1000.0,)], "z_m double")
    state = spark.createDataFrame([(1, 1000.0), (2, -1200.0)], "event_id long, z double")
    assert constraints.mirror_plane(st, c) == -800 and [r[0] for r in constraints.violations(state, c).select("event_id").collect()] == [2]
    out, moved = constraints.reflected(state, st, c)
    assert {r["event_id"]: r["z"] for r in out.collect()} == {1: 1000.0, 2: -400.0} and moved.count() == 1
    assert constraints.required_depths(state, st, c)[:2] == [-1000.0, -11000.0]
    with pytest.raises(ValueError, match="initial depths"):
        constraints.validate_state(state, c)
    c["constraints"]["depth_bound"] |= {"scope": "event_ids", "event_ids": [9]}
    with pytest.raises(ValueError, match="not in the catalog"):
        constraints.violations(state, c).collect()


def test_bootstrap_blocks_and_summary(spark):
    obs = spark.createDataFrame([(1, 2, 1, 2, 0.0, 1.0, s, p, g) for s, p, g in (("A", "P", 1), ("A", "P", 1), ("A", "S", 2), ("B", "P", 3))], list(observations.OBSERVATION))
    assert sorted(r["block"] for r in uncertainty.bootstrap_blocks(obs).collect()) == [1, 1, 2, 3] and sorted(r["block"] for r in uncertainty.bootstrap_blocks(obs, "station").collect()) == [1, 1, 1, 2]
    counts = spark.createDataFrame([(1, 2), (3, 1)], "block int, times int")
    assert uncertainty.resampled(uncertainty.bootstrap_blocks(obs), counts).count() == 5
    draws = uncertainty.draw_counts(spark, 7, 3, 1)
    assert [r[1] for r in draws.groupBy("replicate").agg(F.sum("times")).orderBy("replicate").collect()] == [7, 7, 7]
    nominal = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "event_id long, x double, y double, z double")
    samples = spark.createDataFrame([(k, 1, v, 2 * v, 3 * v, 0.0, False) for k, v in enumerate((-1.4142135623730951, 0.0, 1.4142135623730951))], "replicate int, event_id long, x double, y double, z double, t0 double, at_bound boolean")
    r = {x["event_id"]: x for x in uncertainty.bootstrap_summary(samples, nominal, nominal, 4, cfg.default_config()["uncertainty"]["bootstrap"]).collect()}
    assert [r[1][f"cov_{a}_m2"] for a in ("xx", "xy", "xz", "yy", "yz", "zz")] == pytest.approx([2, 4, 6, 8, 12, 18]) and r[1]["valid_fraction"] == 0.75 and math.isnan(r[2]["cov_xx_m2"])


def test_linearized_diagonal(spark, synthetic):
    truth, st, obs, start = synthetic
    out = uncertainty.linearized(_state(spark, truth), st, obs, traveltime.ConstantModel(), OPTIONS, {"probes": 30, "seed": 1, "inner_tolerance": 1e-8, "inner_max_iterations": 2000}, frozen={1: "z"}, at_bound={2})
    rows = {r["event_id"]: r for r in out.collect()}
    assert rows[1]["std_z_m"] == 0 and math.isnan(rows[2]["std_z_m"]) and all(r["std_x_m"] >= 0 for r in rows.values())


def test_bias_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1000, (200, 2))
    y = x @ [1e-5, -2e-5] + rng.normal(0, 1e-4, 200)
    y[:5] += 1
    assert np.allclose(bias.robust_fit(x, y, np.full(200, 1e-3), 1.345, 30), [1e-5, -2e-5], atol=2e-6)


def test_equal_catalogs_compare_to_zero(spark):
    c = spark.createDataFrame([(1, 35.40, -117.956, 4.0), (2, 35.401, -117.956, 4.5)], "event_id long, lat double, lon double, depth_km double")
    m = compare.compare_catalogs(c, c).first().asDict()
    assert m["events"] == 2 and m["neighboring_pairs"] == 1 and all(abs(v) < 1e-10 for k, v in m.items() if k.endswith("_km"))


def test_whole_run_and_restart(spark, tmp_path):
    rng, n = np.random.default_rng(1), 12
    st = [(f"ST{k}", 35.5 + rng.uniform(-0.1, 0.1), -117.6 + rng.uniform(-0.1, 0.1), 600.0) for k in range(5)]
    lat, lon, depth = 35.5 + rng.uniform(-0.01, 0.01, n), -117.6 + rng.uniform(-0.01, 0.01, n), 8 + rng.uniform(-1, 1, n)
    la0, lo0 = np.mean([s[1] for s in st]), np.mean([s[2] for s in st])
    xy = lambda a, b: (6371e3 * np.cos(np.radians(la0)) * np.radians(b - lo0), 6371e3 * np.radians(a - la0))
    x, y = xy(lat, lon)
    (tmp_path / "theta").mkdir()
    (tmp_path / "stations.txt").write_text("".join(f"{a} {b:.6f} {c:.6f} {e}\n" for a, b, c, e in st))
    for a, b, c, e in st:
        sx, sy = xy(b, c)
        for p, v in (("P", 6000.0), ("S", 3464.0)):
            t = np.sqrt((x - sx) ** 2 + (y - sy) ** 2 + (depth * 1000 + e) ** 2) / v
            (tmp_path / f"theta/theta_{a}_{p}.txt").write_text("".join(f"{i + 1} {t[i] - t[0]:.9f} 1\n" for i in range(n)))
    (tmp_path / "catalog.txt").write_text("".join(f"2024 12 31 23 59 10.0 {lat[i] + rng.normal(0, 0.002):.6f} {lon[i] + rng.normal(0, 0.002):.6f} {depth[i] + rng.normal(0, 0.3):.4f} 1.0 {i + 1}\n" for i in range(n)))
    short = "max_outer_iterations=4\n"
    base = f'[travel_time]\ntype="constant"\n[graph]\nneighbors=6\n[prelocation]\n{short}[relocation]\n{short}[io]\n'
    (tmp_path / "a.toml").write_text(base + 'output_dir="a"\n')
    first = pipeline.run(spark, cfg.load_config(str(tmp_path / "a.toml")))
    assert first.dd_stats.rms_s[-1] < first.pre_stats.rms_s[0] and len((tmp_path / "a/catalog_dd.txt").read_text().splitlines()) == n
    shift = {int(r.split()[4]): float(r.split()[3]) for r in (tmp_path / "a/catalog_dd_dxdydzt0.txt").read_text().splitlines()[1:]}
    out = [r.split() for r in (tmp_path / "a/catalog_dd.txt").read_text().splitlines()]
    assert all(float(r[5]) == pytest.approx(10 + shift[int(r[-1])], abs=1.1e-6) for r in out)
    (tmp_path / "b.toml").write_text(base.replace("[graph]", "[run]\nprelocation=false\n[graph]") + f'output_dir="b"\ncatalog_file="{tmp_path}/a/catalog_dd.txt"\nrestart_shift_file="{tmp_path}/a/catalog_dd_dxdydzt0.txt"\n')
    second = pipeline.run(spark, cfg.load_config(str(tmp_path / "b.toml")))
    t0 = {r["event_id"]: r["t0"] for r in second.prelocated.collect()}
    assert t0 == pytest.approx(shift, abs=1e-12)
    c = cfg.load_config(str(tmp_path / "a.toml"))
    c["run"]["overwrite"] = False
    with pytest.raises(FileExistsError):
        sinks.prepare_output(c)
    assert os.path.exists(tmp_path / "b/run_summary.toml")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalogue.QUERIES["theta_groups"](spark, DATA).count() == 150


def test_precision_by_blocks_equals_all_pairs(spark, monkeypatch):
    """Blocks of a few events, across the antimeridian and about a pole, with outputs near and far, against Vincenty's over all pairs."""
    monkeypatch.setattr(compare, "BLOCK", 7)
    rng, n = np.random.default_rng(3), 120
    tlat, tlon, tdepth = rng.normal(10, 0.012, n), 180 + rng.normal(0, 0.012, n), rng.normal(5, 1.2, n)
    tlat[80:] = 90 - np.abs(rng.normal(0, 0.01, 40))
    tlon[80:] = rng.uniform(-180, 180, 40)
    tlon = np.where(tlon > 180, tlon - 360, tlon)
    lat, lon, depth = np.clip(tlat + rng.normal(0, 0.02, n), -90, 90), tlon + rng.normal(0, 0.02, n), tdepth + rng.normal(0, 0.3, n)
    both = pd.DataFrame({"event_id": rng.permutation(n) + 1, "lat": lat, "lon": lon, "depth_km": depth, "tlat": tlat, "tlon": tlon, "tdepth": tdepth})
    out = {r["event_id"]: (r["horizontal_km"], r["depth_km"], r["neighbours"]) for r in compare.precision(spark.createDataFrame(both)).collect()}
    i, j = (~np.eye(n, dtype=bool)).nonzero()
    pairs = pd.DataFrame({"i": i, "j": j, **{f"{c}_{s}": both[c].to_numpy()[k] for c in both.columns for s, k in (("a", i), ("b", j))}})
    far = lambda p: geo.wgs84_distance_km(*[F.col(f"{p}{c}_{s}") for s in "ab" for c in ("lat", "lon")])
    pairs = spark.createDataFrame(pairs).withColumns({"th": far("t"), "oh": far("")}).toPandas()
    tv, ov = np.abs(pairs.tdepth_a - pairs.tdepth_b), np.abs(pairs.depth_km_a - pairs.depth_km_b)
    pairs["h"], pairs["v"] = (pairs.oh - pairs.th) ** 2, (ov - tv) ** 2
    pairs = pairs[(pairs.th < 2) & (tv < 2)]
    assert (np.abs(np.diff(np.sign(pairs[["tlon_a", "tlon_b"]]), axis=1)) > 0).any() and (pairs.oh > compare.SHORT_KM).any()
    want = pairs.groupby("event_id_a").agg(h=("h", "mean"), v=("v", "mean"), n=("h", "size"))
    assert set(out) == set(want.index)
    for e, (h, v, k) in out.items():
        assert k == want.n[e] and h == pytest.approx(math.sqrt(want.h[e]), abs=1e-7) and v == pytest.approx(math.sqrt(want.v[e]), abs=1e-9)


def test_event_errors_of_many_neighbours_end(spark):
    """All 1500 events of sf0.1 lie within a few kilometres: a million pairs, which took minutes as rows."""
    start = time.monotonic()
    n = catalogue.catalog_event_errors(spark, "/root/testdata/sf0.1").agg(F.count("*"), F.sum("truth_neighbor_count")).first()
    assert n[0] == 1500 and n[1] > 500_000 and time.monotonic() - start < 60


def test_metrics_of_many_neighbours_end(spark):
    """The same million pairs, whose number the row of metrics gives."""
    start = time.monotonic()
    m = catalogue.catalog_metrics(spark, "/root/testdata/sf0.1").first()
    assert m["events"] == 1500 and m["neighboring_pairs"] > 500_000 and time.monotonic() - start < 90
