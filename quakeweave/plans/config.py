"""Configuration: defaults, TOML loading, path resolution and validation."""

from __future__ import annotations

import copy
import math
import os
import tomllib
import warnings

#: The configuration's sections, keys and defaults.
SOLVER = {
    "max_outer_iterations": 20, "min_outer_iterations": 3, "linear_solver": "pcg", "preconditioner": "block_jacobi", "inner_tolerance": 1e-5, "inner_max_iterations": 250, "huber_k": 1.345, "min_sigma_s": 0.002,
    "step_damping": 0.75, "damping_lambda": 1e-3, "stop_step_rms_m": 0.1, "stop_step_rms_s": 1e-4, "stop_rms_improvement_s": 1e-5, "stop_stall_iterations": 5, "max_event_step_m": 0.0, "max_origin_step_s": 0.0, "verbose": True,
}
DEFAULTS = {
    "io": {"catalog_file": "catalog.txt", "restart_shift_file": "", "stations_file": "stations.txt", "theta_dir": "theta", "thetastd_dir": "thetastd", "output_dir": "output"},
    "run": {"prelocation": True, "overwrite": True, "build_travel_times_only": False},
    "catalog": {"latitude_column": 7, "longitude_column": 8, "depth_column": 9, "event_id_column": -1, "origin_time_columns": [1, 2, 3, 4, 5, 6], "origin_time_decimals": 6},
    "initialization": {"mode": "catalog", "latitude": 0.0, "longitude": 0.0, "depth_km": 0.0},
    "coordinates": {"reference": "stations_mean", "reference_latitude": 0.0, "reference_longitude": 0.0, "earth_radius_m": 6371000.0, "station_vertical": "depth_from_elevation", "event_vertical": "positive_depth", "event_z0_m": 0.0},
    "travel_time": {"type": "lookup", "table_file": "lookuptable/travel_times.gstt", "velocity_model_file": "vm.txt", "geometry": "auto", "build_geometry": "cartesian", "auto_build": True, "auto_rebuild": True, "clamp_to_grid": True, "vp_ms": 6000.0, "vs_ms": 3464.0, "earth_radius_m": 0.0},
    "lookup": {"horizontal_step_m": 125.0, "depth_step_m": 50.0, "station_depth_step_m": 100.0, "maximum_distance_km": 0.0, "minimum_depth_km": 0.0, "maximum_depth_km": 0.0, "distance_margin_km": 1.0, "depth_margin_km": 50.0, "maximum_sweeps": 32, "sweep_tolerance_s": 1e-7, "threaded": False, "maximum_table_gib": 8.0, "allow_large_table": False},
    "prelocation": SOLVER,
    "relocation": SOLVER | {"max_outer_iterations": 60, "inner_tolerance": 1e-4, "inner_max_iterations": 300, "damping_lambda": 5e-4},
    "observations": {"minimum_theta_degree": 6, "maximum_sigma_s": 0.0, "minimum_observations_per_pair": 6, "minimum_observations_per_event": 0, "minimum_star_observations_per_event": 0, "minimum_component_size": 0},
    "gauge": {"mode": "zero_mean", "zero_mean": "origin_time", "constraint_weight": 10.0, "reference_velocity_ms": 5000.0, "pin_event_ids": [], "pin_fields": "xyz", "pin_reference_catalog": ""},
    "constraints": {
        "depth_bound": {"enabled": False, "minimum_depth_km": 0.0, "scope": "all", "event_ids": [], "reflected_prelocation_restart": False, "pilot_shallow_margin_km": 10.0, "mirror_plane": "stations_median", "mirror_depth_km": 0.0},
        "fixed_depth": {"enabled": False, "scope": "all", "event_ids": [], "depth_km": 0.0, "reference_catalog": ""},
    },
    "graph": {
        "neighbors": 20, "maximum_degree": 30, "metric": "xyz_scaled", "depth_scale": 0.5, "mutual": True, "maximum_distance_km": 0.0, "minimum_degree": 0, "ensure_connected": False, "maximum_bridge_distance_km": 0.0,
        "augmentation": {"enabled": False, "candidate_neighbors": 40, "add_edges": 0, "add_edges_per_event": 0.0, "maximum_added_per_event": 3, "power_iterations": 30},
    },
    "output": {"write_filtered_catalogs": True, "write_graph_metadata": True, "write_solver_history": True, "write_run_summary": True},
    "uncertainty": {
        "method": "none",
        "linearized": {"probes": 12, "seed": 24680, "inner_tolerance": 1e-3, "inner_max_iterations": 150},
        "bootstrap": {"replicates": 100, "resampling_unit": "station_phase", "seed": 12345, "summary_method": "percentile", "confidence_level": 0.95, "standard_deviation_multiplier": 2.0, "write_samples": True, "write_catalogs": False},
    },
    "experimental": {"bias": {"enabled": False, "apply_model_file": "", "fit_dimensions": "xy", "minimum_observations": 30, "huber_k": 1.345, "minimum_sigma_s": 0.002, "maximum_irls_iterations": 6, "minimum_improvement_fraction": 0.05}},
}
PATHS = (
    ("io", "catalog_file"), ("io", "restart_shift_file"), ("io", "stations_file"), ("io", "theta_dir"), ("io", "thetastd_dir"), ("io", "output_dir"), ("travel_time", "table_file"), ("travel_time", "velocity_model_file"),
    ("gauge", "pin_reference_catalog"), ("experimental", "bias", "apply_model_file"), ("constraints", "fixed_depth", "reference_catalog"),
)
CHOICES = {
    "travel_time.type": ("lookup", "constant", "constant_velocity", "constvel"), "travel_time.geometry": ("auto", "cartesian", "flat", "radial", "spherical"), "travel_time.build_geometry": ("cartesian", "flat", "radial", "spherical"),
    "graph.metric": ("xy", "xyz", "xyz_scaled"), "coordinates.reference": ("stations_mean", "catalog_mean", "manual"), "initialization.mode": ("catalog", "common_centroid", "common_manual"),
    "coordinates.station_vertical": ("depth_from_elevation", "elevation"), "coordinates.event_vertical": ("positive_depth", "negative_depth", "positive_depth_plus_z0"), "gauge.mode": ("zero_mean", "pin"),
    "constraints.depth_bound.scope": ("all", "event_ids"), "constraints.fixed_depth.scope": ("all", "event_ids"), "constraints.depth_bound.mirror_plane": ("stations_median", "manual"),
    "prelocation.linear_solver": ("pcg", "direct"), "relocation.linear_solver": ("pcg", "direct"), "prelocation.preconditioner": ("block_jacobi", "diagonal", "none"), "relocation.preconditioner": ("block_jacobi", "diagonal", "none"),
    "uncertainty.method": ("none", "linearized", "bootstrap", "both"), "uncertainty.bootstrap.resampling_unit": ("station_phase", "station"), "uncertainty.bootstrap.summary_method": ("percentile", "standard_deviation", "std", "2std"), "experimental.bias.fit_dimensions": ("xy", "xyz"),
}
#: (key, lowest, highest, whether the bounds are excluded)
RANGES = (
    ("catalog.origin_time_decimals", 0, 12, False), ("graph.neighbors", 1, math.inf, False), ("graph.depth_scale", 0, math.inf, True), ("initialization.latitude", -90, 90, False), ("initialization.longitude", -180, 180, False), ("initialization.depth_km", -math.inf, math.inf, True),
    ("coordinates.earth_radius_m", 0, math.inf, True), ("travel_time.earth_radius_m", 0, 1e300, False), ("lookup.horizontal_step_m", 0, math.inf, True), ("lookup.depth_step_m", 0, math.inf, True), ("lookup.station_depth_step_m", 0, math.inf, True),
    ("gauge.constraint_weight", 0, math.inf, True), ("constraints.depth_bound.minimum_depth_km", -math.inf, math.inf, True), ("constraints.fixed_depth.depth_km", -math.inf, math.inf, True), ("constraints.depth_bound.mirror_depth_km", -math.inf, math.inf, True), ("constraints.depth_bound.pilot_shallow_margin_km", 0, 1e300, False),
    ("graph.augmentation.candidate_neighbors", 1, math.inf, False), ("graph.augmentation.add_edges", 0, math.inf, False), ("graph.augmentation.add_edges_per_event", 0, 1e300, False), ("graph.augmentation.maximum_added_per_event", 1, math.inf, False), ("graph.augmentation.power_iterations", 1, math.inf, False),
    *((f"{s}.{k}", lo, hi, open_) for s in ("prelocation", "relocation") for k, lo, hi, open_ in (("damping_lambda", 0, 1e300, False), ("min_sigma_s", 0, math.inf, True))),
    ("uncertainty.linearized.probes", 1, math.inf, False), ("uncertainty.linearized.inner_tolerance", 0, math.inf, True), ("uncertainty.linearized.inner_max_iterations", 1, math.inf, False),
    ("uncertainty.bootstrap.replicates", 1, math.inf, False), ("uncertainty.bootstrap.confidence_level", 0, 1, True), ("uncertainty.bootstrap.standard_deviation_multiplier", 0, math.inf, True),
)


class ConfigError(ValueError):
    pass


def default_config() -> dict:
    return copy.deepcopy(DEFAULTS)


def get(config: dict, path: str, default=None):
    node = config
    for key in path.split("."):
        if not isinstance(node, dict) or key not in node:
            return default
        node = node[key]
    return node


def merged(base: dict, over: dict) -> dict:
    """base with over's values, section by section."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key] if isinstance(out.get(key), dict) else {}, value) if isinstance(value, dict) else value
    return out


def unknown_keys(given: dict, known: dict, prefix: str = "") -> list[str]:
    out = []
    for key, value in given.items():
        if key not in known:
            out.append(prefix + key)
        elif isinstance(value, dict) and isinstance(known[key], dict):
            out += unknown_keys(value, known[key], f"{prefix}{key}.")
    return out


def load_config(path: str) -> dict:
    """A TOML file over the defaults; relative paths are from the file's folder, unknown keys warned of."""
    if not os.path.isfile(path):
        raise ConfigError(f"configuration file not found: {path}")
    with open(path, "rb") as f:
        given = tomllib.load(f)
    for key in unknown_keys(given, DEFAULTS):
        warnings.warn(f"unknown configuration key: {key}", stacklevel=2)
    config = merged(DEFAULTS, given)
    base = os.path.dirname(os.path.abspath(path))
    for *sections, key in PATHS:
        node = get(config, ".".join(sections))
        if node[key] and not os.path.isabs(node[key]) and "://" not in node[key]:
            node[key] = os.path.normpath(os.path.join(base, node[key]))
    return validate(config)


def validate(config: dict) -> dict:
    """config, or a ConfigError that names what is wrong."""

    def need(ok: bool, said: str) -> None:
        if not ok:
            raise ConfigError(said)

    for key, choices in CHOICES.items():
        need(str(get(config, key)).lower() in choices, f"{key} must be one of {', '.join(choices)}")
    for key, lo, hi, open_ in RANGES:
        x = float(get(config, key))
        need(not math.isnan(x) and (lo < x < hi if open_ else lo <= x <= hi), f"{key} must lie {'strictly ' * open_}between {lo} and {hi}")
    columns = get(config, "catalog.origin_time_columns")
    need(isinstance(columns, list) and len(columns) in (0, 6), "catalog.origin_time_columns must be empty or six columns")
    need(all(type(c) is int and c for c in columns) and len(set(columns)) == len(columns), "catalog.origin_time_columns must be distinct nonzero integers")
    first, restart, only = bool(get(config, "run.prelocation")), get(config, "io.restart_shift_file"), bool(get(config, "run.build_travel_times_only"))
    need(first or only or bool(restart), "run.prelocation=false needs io.restart_shift_file")
    need(not (first and restart), "io.restart_shift_file is for run.prelocation=false alone")
    need(first or str(get(config, "initialization.mode")).lower() == "catalog", "a common initialization needs run.prelocation=true")
    need(str(get(config, "travel_time.type")).lower() != "lookup" or str(get(config, "travel_time.table_file")).lower().endswith(".gstt"), "travel_time.table_file must end in .gstt")
    need(float(get(config, "lookup.station_depth_step_m")) >= float(get(config, "lookup.depth_step_m")), "lookup.station_depth_step_m must be lookup.depth_step_m at least")
    for section in ("prelocation", "relocation"):
        need(0 < float(get(config, f"{section}.step_damping")) <= 1, f"{section}.step_damping must be in (0, 1]")
    for name in ("depth_bound", "fixed_depth"):
        c = get(config, f"constraints.{name}")
        ids = list(c["event_ids"])
        need(all(type(i) is int and i > 0 for i in ids) and len(set(ids)) == len(ids), f"constraints.{name}.event_ids must be distinct positive ids")
        if c["enabled"]:
            need((str(c["scope"]).lower() == "all") == (not ids), f"constraints.{name}.event_ids must be given for scope=event_ids and only then")
    bound = get(config, "constraints.depth_bound")
    need(not bound["reflected_prelocation_restart"] or (bound["enabled"] and first), "reflected_prelocation_restart needs the depth bound and run.prelocation")
    extra = get(config, "graph.augmentation")
    need(not extra["enabled"] or (int(extra["add_edges"]) > 0) != (float(extra["add_edges_per_event"]) > 0), "graph.augmentation needs exactly one of add_edges and add_edges_per_event")
    return config
