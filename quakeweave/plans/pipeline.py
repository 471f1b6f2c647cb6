"""The relocation run: scans, seed, travel times, both stages, graph, uncertainty and sinks."""

from __future__ import annotations

import copy
import datetime
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.functions import geo
from quakeweave.operators import bias, constraints, graph, observations, solver, traveltime, uncertainty
from quakeweave.plans.config import get
from quakeweave.sources import sinks, text
from quakeweave.sources.storage import written


@dataclass
class Run:
    """What a run gives: DataFrames, statistics and the files written."""

    catalog: DataFrame
    stations: DataFrame
    model: object
    initial: DataFrame
    prelocated: DataFrame | None = None
    relocated: DataFrame | None = None
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    star: DataFrame | None = None
    dd: DataFrame | None = None
    pre_stats: solver.Stats | None = None
    dd_stats: solver.Stats | None = None
    output: str = ""
    extra: dict = field(default_factory=dict)


def reference_point(stations: DataFrame, catalog: DataFrame, config: dict) -> tuple[float, float]:
    mode = str(get(config, "coordinates.reference")).lower()
    if mode == "manual":
        lat0, lon0 = float(get(config, "coordinates.reference_latitude")), float(get(config, "coordinates.reference_longitude"))
    else:
        lat0, lon0 = (stations if mode == "stations_mean" else catalog).agg(F.avg("lat"), geo.circular_mean_longitude(F.col("lon"))).first()
    if abs(np.cos(np.radians(lat0))) <= 1e-10:
        raise ValueError("the coordinate reference is too close to a pole")
    return lat0, lon0


def attach_coordinates(stations: DataFrame, catalog: DataFrame, config: dict) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float, float]]:
    """(stations, catalog, state, frame): x, y and z in the local frame; the state is the catalog's with t0 = 0."""
    frame = (*reference_point(stations, catalog, config), float(get(config, "coordinates.earth_radius_m")))
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), *frame)
    up = -1.0 if str(get(config, "coordinates.station_vertical")).lower() == "depth_from_elevation" else 1.0
    stations = written(stations.withColumns({"x_m": x, "y_m": y, "z_m": up * F.col("elev_m")}), "stations")
    catalog = written(catalog.withColumns({"x": x, "y": y, "z": geo.depth_to_internal(F.col("depth_km"), *constraints.vertical(config))}), "catalog")
    return stations, catalog, catalog.select("event_id", "x", "y", "z", F.lit(0.0).alias("t0")), frame


def initialized(state: DataFrame, config: dict, frame: tuple[float, float, float]) -> DataFrame:
    """The configured seed: the catalog's, one centroid, or one given point; common seeds have t0 = 0."""
    mode = str(get(config, "initialization.mode")).lower()
    if mode == "catalog":
        return state
    if mode == "common_centroid":
        x, y, z = state.agg(F.avg("x"), F.avg("y"), F.avg("z")).first()
    else:
        o = config["initialization"]
        at = [F.lit(float(o["latitude"])), F.lit(float(o["longitude"]))]
        x, y = state.sparkSession.range(1).select(*geo.local_xy(*at, *frame)).first()
        z = constraints.internal(float(o["depth_km"]), config)
    return state.select("event_id", F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(0.0).alias("t0"))


def pinned_to_reference(state: DataFrame, config: dict, frame: tuple[float, float, float]) -> DataFrame:
    """Pinned events at their places in a trusted catalog, which must hold them."""
    path = get(config, "gauge.pin_reference_catalog")
    if not path:
        return state
    ids, fields = [int(i) for i in get(config, "gauge.pin_event_ids")], str(get(config, "gauge.pin_fields")).lower()
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), *frame)
    ref = text.read_catalog(state.sparkSession, path, config).filter(F.col("event_id").isin(ids))
    ref = ref.select("event_id", x.alias("rx"), y.alias("ry"), geo.depth_to_internal(F.col("depth_km"), *constraints.vertical(config)).alias("rz"))
    if ref.join(state, "event_id", "left_semi").count() != len(set(ids)):
        raise ValueError("a pinned event is missing from the reference or the working catalog")
    out = state.join(ref, "event_id", "left")
    return out.select("event_id", *[(F.coalesce(f"r{f}", f) if f in fields else F.col(f)).alias(f) for f in "xyz"], "t0")


def _range(df: DataFrame, column: str) -> tuple[float, float]:
    return tuple(map(float, df.agg(F.min(column), F.max(column)).first()))


def prepare_travel_time(spark: SparkSession, config: dict, stations: DataFrame, catalog: DataFrame, state: DataFrame, frame: tuple[float, float, float], force: bool = False):
    """A constant model, or a lookup table that is reused if it serves, else built if that is allowed."""
    o = config["travel_time"]
    requested = traveltime.geometry(str(o["geometry"]))
    build = traveltime.geometry(str(o["build_geometry"])) if requested == "auto" else requested
    given = float(o["earth_radius_m"])
    if str(o["type"]).lower() != "lookup":
        return traveltime.ConstantModel(build, float(o["vp_ms"]), float(o["vs_ms"]), given or frame[2], *frame)
    model = text.read_velocity_model(spark, o["velocity_model_file"])
    radius = given or (model["earth_radius_m"] if model["earth_radius_m"] > 0 else frame[2])
    depths, sz, ez = constraints.required_depths(state, stations, config), _range(stations, "z_m"), _range(state, "z")
    if not force:
        try:
            table = traveltime.load_table(spark, o["table_file"], frame[0], frame[1], bool(o["clamp_to_grid"]))
        except Exception as problem:  # none there, or one that was not finished
            table, why = None, str(problem).splitlines()[0]
            if not os.path.exists(o["table_file"]) and not o["auto_build"]:
                raise ValueError("there is no travel-time table and travel_time.auto_build is false") from problem
        else:
            required = traveltime.required_range(stations, catalog, state, table.geometry, frame, table.earth_radius_m)
            ok, why = traveltime.coverage(table, config["lookup"], requested, model["sha256"], radius, frame[2], required, sz, ez, depths)
            if ok:
                return table
        if os.path.exists(o["table_file"]) and not o["auto_rebuild"]:
            raise ValueError(f"the travel-time table does not serve ({why}) and travel_time.auto_rebuild is false")
    required = traveltime.required_range(stations, catalog, state, build, frame, radius)
    axes = traveltime.lookup_grids(config["lookup"], required, sz, ez, (min(model["depth_m"]), max(model["depth_m"])), build, radius, depths)
    traveltime.build_table(spark, o["table_file"], config["lookup"], model, axes, build, radius, frame[2])
    return traveltime.load_table(spark, o["table_file"], frame[0], frame[1], bool(o["clamp_to_grid"]))


def seeded(spark: SparkSession, config: dict, allow_free: bool = False):
    """(stations, catalog, catalog state, initial state, frame, previous shift)."""
    catalog = text.read_catalog(spark, get(config, "io.catalog_file"), config)
    stations = text.read_stations(spark, get(config, "io.stations_file"))
    stations, catalog, state, frame = attach_coordinates(stations, catalog, config)
    initial, previous = state, None
    if not get(config, "run.prelocation") and get(config, "io.restart_shift_file"):
        previous = written(text.read_catalog_shift(spark, get(config, "io.restart_shift_file"), catalog), "shift")
        initial = state.drop("t0").join(previous.select("event_id", F.col("dt0_s").alias("t0")), "event_id")
    initial = pinned_to_reference(initialized(initial, config, frame), config, frame)
    if get(config, "constraints.fixed_depth.enabled"):
        path = get(config, "constraints.fixed_depth.reference_catalog")
        initial = constraints.with_fixed_depths(initial, constraints.fixed_targets(initial, config, text.read_catalog(spark, path, config) if path else None))
    initial = written(initial.select("event_id", "x", "y", "z", "t0"), "initial")
    return stations, catalog, state, constraints.validate_state(initial, config, allow_free), frame, previous


def build_travel_times(spark: SparkSession, config: dict, force: bool = False):
    stations, catalog, _, initial, frame, _ = seeded(spark, config, True)
    return prepare_travel_time(spark, config, stations, catalog, initial, frame, force)


def cumulative_shift(previous: DataFrame | None, before: DataFrame, after: DataFrame, active: DataFrame) -> DataFrame:
    """(event_id, dx_m, dy_m, dz_m, dt0_s): active events add their move and take their t0, others keep what they had."""
    b = before.select("event_id", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    rows = after.join(b, "event_id").join(active.select("event_id", F.lit(True).alias("act")), "event_id", "left")
    if previous is None:
        rows = rows.withColumns({c: F.lit(0.0) for c in ("dx_m", "dy_m", "dz_m", "dt0_s")})
    else:
        rows = rows.join(previous, "event_id")
    act = F.coalesce("act", F.lit(False))
    moved = [F.when(act, F.col(f"d{c}_m") + F.col(c) - F.col(f"b{c}")).otherwise(F.col(f"d{c}_m")).alias(f"d{c}_m") for c in "xyz"]
    return rows.select("event_id", *moved, F.when(act, F.col("t0")).otherwise(F.col("dt0_s")).alias("dt0_s"))


def _bound(state: DataFrame, config: dict, enabled: bool = True) -> solver.Bound:
    rows = state.select("event_id", (constraints.bound_scope(state, config) if enabled else F.lit(False)).alias("s")).orderBy("event_id").collect()  # with the state's own vectors on the driver
    return solver.Bound(np.array([r["s"] for r in rows], bool), constraints.boundary(config), constraints.direction(config))


def _solve(state: DataFrame, stations: DataFrame, obs: DataFrame, model, config: dict, stage: str, bounded: bool = True):
    g = config["gauge"]
    return solver.relocate(
        state, stations, obs, model, config[stage], kind=solver.gauge_kind(config), weight=float(g["constraint_weight"]), velocity=float(g["reference_velocity_ms"]), frozen=constraints.frozen(state, config), bound=_bound(state, config, bounded)
    )


def _prelocation(run: Run, config: dict):
    """(state, statistics, pilot statistics, reflected events): Stage 1, with an unbounded pilot first where that is asked for."""
    none = run.initial.select("event_id").limit(0)
    if not get(config, "constraints.depth_bound.reflected_prelocation_restart"):
        return *_solve(run.initial, run.stations, run.star, run.model, config, "prelocation"), None, none
    model = copy.copy(run.model)
    if hasattr(model, "clamp"):
        model.clamp = False
    pilot, stats = _solve(run.initial, run.stations, run.star, model, config, "prelocation", bounded=False)
    if constraints.violations(pilot, config).isEmpty():
        return pilot, stats, None, none
    start, moved = constraints.reflected(pilot, run.stations, config)
    return *_solve(written(start, "reflected"), run.stations, run.star, run.model, config, "prelocation"), stats, written(moved, "moved")


def run(spark: SparkSession, config: dict, force_table: bool = False) -> Run:
    """The whole run; its files go to io.output_dir."""
    out = sinks.prepare_output(config)
    reflect = bool(get(config, "constraints.depth_bound.reflected_prelocation_restart"))
    stations, catalog, catalog_state, initial, frame, previous = seeded(spark, config, reflect)
    model = prepare_travel_time(spark, config, stations, catalog, initial, frame, force_table)
    r = Run(catalog, stations, model, initial, output=out)
    if get(config, "run.build_travel_times_only"):
        return r
    o, path = config["observations"], lambda name: os.path.join(out, name)
    theta = written(text.load_theta_folder(spark, get(config, "io.theta_dir"), get(config, "io.thetastd_dir")), "theta")
    if apply := get(config, "experimental.bias.apply_model_file"):
        theta = written(bias.apply_bias(theta, text.read_bias_model(spark, apply), catalog_state), "theta")
    shared = {"minimum_degree": int(o["minimum_theta_degree"]), "maximum_sigma": float(o["maximum_sigma_s"])}
    pilot, reflected_events = None, initial.select("event_id").limit(0)
    if get(config, "run.prelocation"):
        r.star = written(observations.star_observations(theta, stations, catalog, minimum_sigma=float(get(config, "prelocation.min_sigma_s")), minimum_per_event=int(o["minimum_star_observations_per_event"]), **shared), "star")
        r.prelocated, r.pre_stats, pilot, reflected_events = _prelocation(r, config)
        pre_active = observations.event_activity(r.star)
    else:
        r.star, r.prelocated, r.pre_stats, pre_active = observations.star_observations(theta, stations, catalog).limit(0), initial, solver.Stats(), catalog.select("event_id")
    pre_shift = written(cumulative_shift(previous, catalog_state, r.prelocated, pre_active), "shift")
    sinks.write_catalog(path("catalog_preloc.txt"), catalog, r.prelocated, config, frame, basis=previous, active=pre_active)
    sinks.write_shift(path("catalog_preloc_dxdydzt0.txt"), pre_shift, catalog)
    r.edges, r.nodes = (written(x, "graph") for x in graph.build_event_graph(r.prelocated, catalog, config["graph"]))
    r.dd = written(
        observations.dd_observations(
            theta, stations, catalog, r.edges, r.nodes, minimum_pair=int(o["minimum_observations_per_pair"]), minimum_event=int(o["minimum_observations_per_event"]), minimum_sigma=float(get(config, "relocation.min_sigma_s")), minimum_component=int(o["minimum_component_size"]), **shared
        ), "dd",
    )
    if r.dd.isEmpty():
        raise ValueError("there are no Stage-2 observations; relax the graph or support settings")
    r.relocated, r.dd_stats = _solve(r.prelocated, stations, r.dd, model, config, "relocation")
    dd_active = written(observations.event_activity(r.dd), "active")
    dd_shift = cumulative_shift(previous, catalog_state, r.relocated, dd_active.union(pre_active).distinct() if get(config, "run.prelocation") else dd_active)
    sinks.write_catalog(path("catalog_dd.txt"), catalog, r.relocated, config, frame, basis=previous, active=dd_active)
    sinks.write_shift(path("catalog_dd_dxdydzt0.txt"), dd_shift, catalog)
    if get(config, "output.write_filtered_catalogs"):
        sinks.write_catalog(path("catalog_preloc_filt.txt"), catalog, r.prelocated, config, frame, basis=previous, active=pre_active, only=pre_active)
        sinks.write_catalog(path("catalog_dd_filt.txt"), catalog, r.relocated, config, frame, basis=previous, active=dd_active, only=dd_active)
    if get(config, "output.write_graph_metadata"):
        meta = graph.graph_metadata(catalog, r.nodes, r.star, r.dd)
        sinks.write_csv(path("catalog_dd_graphmeta.csv"), meta, "EventID")
    stages = [("prelocation", r.pre_stats), ("relocation", r.dd_stats)]
    if get(config, "output.write_solver_history"):
        sinks.write_solver_history(path("solver_history.csv"), ([("prelocation_unconstrained_pilot", pilot)] if pilot else []) + stages)
    if get(config, "constraints.depth_bound.enabled") or get(config, "constraints.fixed_depth.enabled"):
        sinks.write_csv(path("depth_constraint_status.csv"), depth_status(r, config, reflected_events), "EventID")
    _uncertainty(r, config, dd_active, frame, path)
    if get(config, "experimental.bias.enabled"):
        options = config["experimental"]["bias"]
        star = r.star if get(config, "run.prelocation") else observations.star_observations(theta, stations, catalog, minimum_sigma=float(options["minimum_sigma_s"]), **shared)
        r.extra["bias"] = written(bias.scan_theta_bias(star, r.relocated, stations, model, options), "bias")
        sinks.write_csv(path("theta_bias_report.csv"), r.extra["bias"], "group_index")
    if get(config, "output.write_run_summary"):
        sinks.write_toml(path("run_summary.toml"), summary(r, config, theta))
    return r


def depth_status(r: Run, config: dict, reflected_events: DataFrame) -> DataFrame:
    """One row per event that a depth constraint holds for."""
    s = r.relocated
    bound, fixed = constraints.bound_scope(s, config), constraints.fixed_scope(s, config)
    km = lambda z: geo.internal_to_depth(z, *constraints.vertical(config))
    nan = float("nan")
    hits = lambda st: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in st.bound_hits.items() for x in kv]), F.col("event_id")), F.lit(0)) if st.bound_hits else F.lit(0)
    at = lambda st: F.col("event_id").isin(list(st.bound_active) or [0]).cast("int")
    rows = s.join(reflected_events.select("event_id", F.lit(1).alias("refl")), "event_id", "left").filter(bound | fixed)
    return rows.select(
        F.col("event_id").alias("EventID"), bound.cast("int").alias("bound_applies"), fixed.cast("int").alias("fixed_depth"), F.when(bound, float(get(config, "constraints.depth_bound.minimum_depth_km"))).otherwise(nan).alias("bound_depth_km"),
        F.when(fixed, km(F.col("z"))).otherwise(nan).alias("fixed_depth_km"), F.coalesce("refl", F.lit(0)).alias("reflected_prelocation"), hits(r.pre_stats).alias("bound_hits_prelocation"), at(r.pre_stats).alias("bound_active_prelocation"),
        hits(r.dd_stats).alias("bound_hits_relocation"), at(r.dd_stats).alias("bound_active_relocation"), km(F.col("z")).alias("final_depth_km"),
    )


def _uncertainty(r: Run, config: dict, active: DataFrame, frame, path) -> None:
    method = str(get(config, "uncertainty.method")).lower()
    g, spark = config["gauge"], r.catalog.sparkSession
    how = {"kind": solver.gauge_kind(config), "weight": float(g["constraint_weight"]), "velocity": float(g["reference_velocity_ms"]), "frozen": constraints.frozen(r.relocated, config)}
    if method in ("linearized", "both"):
        est = uncertainty.linearized(r.relocated, r.stations, r.dd, r.model, config["relocation"], config["uncertainty"]["linearized"], at_bound=r.dd_stats.bound_active, events=active, **how)
        r.extra["linearized"] = written(est, "linearized")
        sinks.write_table(path("linerrxyz.txt"), r.extra["linearized"], "event_id", ["EventID", *uncertainty.LINEAR[1:]])
    if method in ("bootstrap", "both"):
        o = config["uncertainty"]["bootstrap"]
        pins = [e for e, f in constraints.pin_fields(config).items() if {"x", "y", "z"} <= set(f)]
        pinned = spark.createDataFrame([(e,) for e in pins], "event_id long") if pins else None
        samples, log, counts = uncertainty.bootstrap(r.relocated, r.stations, r.dd, r.model, config["relocation"], o, active, pinned, bound=_bound(r.relocated, config), **how)
        n = int(o["replicates"])
        r.extra |= {"samples": samples, "replicates": log, "summary": written(uncertainty.bootstrap_summary(samples, r.relocated, active, n, o), "summary")}
        sinks.write_table(path("booterrxyz.txt"), r.extra["summary"], "event_id", ["EventID", *r.extra["summary"].columns[1:]])
        sinks.write_table(path("bootstrap_replicates.txt"), log, "replicate")
        blocks = counts.groupBy("block").pivot("replicate", list(range(1, n + 1))).agg(F.first("times")).na.fill(0)
        labels = uncertainty.bootstrap_blocks(r.dd, o["resampling_unit"]).groupBy("block").agg(F.min(F.concat("station", F.when(F.lit(o["resampling_unit"] == "station"), "").otherwise(F.concat(F.lit("_"), "phase")))).alias("label"))
        sinks.write_table(path("bootstrap_block_counts.txt"), labels.join(blocks, "block"), "block", ["block", "label", *[f"sample_{k:04d}" for k in range(1, n + 1)]])
        if get(config, "constraints.depth_bound.enabled"):
            sinks.write_table(path("bootstrap_depth_bound_status.txt"), uncertainty.bound_status(samples, active), "event_id")
        if o["write_samples"]:
            geographic = _geographic(samples, config, frame)
            nominal = _geographic(r.relocated.join(active, "event_id", "left_semi"), config, frame)
            for column, name in (("lon", "lon"), ("lat", "lat"), ("depth_km", "depth_km"), ("t0", "t0_s")):
                sinks.write_table(path(f"bootstrap_samples_{name}.txt"), uncertainty.sample_table(geographic, nominal, column, n), "event_id")
        if o["write_catalogs"]:
            for row in log.filter("converged = 1").collect():  # a row per replicate
                mine = samples.filter(F.col("replicate") == row["replicate"])
                sinks.write_catalog(path(f"bootstrap_catalogs/catalog_dd_filt_boot_{row['replicate']:04d}.txt"), r.catalog, mine, config, frame, only=mine)
        done = log.agg(F.sum("converged"), F.max("total_blocks")).first()
        about = {"method": "conditional_stage2_block_bootstrap", "resampling_unit": o["resampling_unit"], "blocks": done[1], "replicates": n, "converged_replicates": done[0], "seed": int(o["seed"]), "fixed_nominal_graph": True, "prelocation_resampled": False}
        sinks.write_toml(path("bootstrap_metadata.toml"), about | {k: o[k] for k in ("write_samples", "write_catalogs", "summary_method", "confidence_level", "standard_deviation_multiplier")} | {"depth_bound_enabled": bool(get(config, "constraints.depth_bound.enabled"))})


def _geographic(rows: DataFrame, config: dict, frame) -> DataFrame:
    lat, lon = geo.local_ll(F.col("x"), F.col("y"), *frame)
    return rows.withColumns({"lat": lat, "lon": lon, "depth_km": geo.internal_to_depth(F.col("z"), *constraints.vertical(config))})


def summary(r: Run, config: dict, theta: DataFrame) -> dict:
    stats = lambda s: {"iterations": len(s.rms_s), "converged": s.converged, "final_rms_s": s.rms_s[-1] if s.rms_s else float("nan")}
    return {
        "created_utc": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"),
        "counts": {"events": r.catalog.count(), "stations": r.stations.count(), "theta_groups": theta.select("group_idx").distinct().count(), "star_observations": r.star.count(), "dd_observations": r.dd.count(), "graph_edges": r.edges.count(), "components": r.nodes.select("comp_id").distinct().count()},
        "prelocation": stats(r.pre_stats), "relocation": stats(r.dd_stats), "travel_time": {"type": str(get(config, "travel_time.type")), "geometry": r.model.geometry}, "gauge": {"mode": str(get(config, "gauge.mode")), "kind": solver.gauge_kind(config)},
        "uncertainty": {"method": str(get(config, "uncertainty.method"))},
    }
