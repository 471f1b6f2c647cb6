"""Depth constraints: scopes, bounds, fixed depths, the mirror plane and reflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeweave.functions.geo import VERTICAL, depth_to_internal
from quakeweave.plans.config import get


def vertical(config: dict) -> tuple[str, float]:
    return str(get(config, "coordinates.event_vertical")).lower(), float(get(config, "coordinates.event_z0_m"))


def internal(depth_km: float, config: dict) -> float:
    name, z0 = vertical(config)
    sign, shifted = VERTICAL[name]
    return sign * depth_km * 1000.0 + (z0 if shifted else 0.0)


def direction(config: dict) -> float:
    """+1 where internal z grows with depth, else -1."""
    return -1.0 if vertical(config)[0] == "negative_depth" else 1.0


def in_scope(state: DataFrame, options: dict, label: str) -> Column:
    """Whether a constraint holds for event_id; listed events that the state lacks are an error."""
    if not options["enabled"]:
        return F.lit(False)
    if str(options["scope"]).lower() == "all":
        return F.lit(True)
    ids = [int(i) for i in options["event_ids"]]
    here = {r[0] for r in state.filter(F.col("event_id").isin(ids)).select("event_id").collect()}  # a configured list
    if missing := sorted(set(ids) - here):
        raise ValueError(f"{label} names events that are not in the catalog: {missing}")
    return F.col("event_id").isin(ids)


def bound_scope(state: DataFrame, config: dict) -> Column:
    return in_scope(state, get(config, "constraints.depth_bound"), "constraints.depth_bound")


def fixed_scope(state: DataFrame, config: dict) -> Column:
    return in_scope(state, get(config, "constraints.fixed_depth"), "constraints.fixed_depth")


def boundary(config: dict) -> float:
    return internal(float(get(config, "constraints.depth_bound.minimum_depth_km")), config)


def feasible(z: Column, config: dict, tolerance: float = 1e-6) -> Column:
    return direction(config) * (z - boundary(config)) >= -tolerance


def violations(state: DataFrame, config: dict) -> DataFrame:
    return state.filter(bound_scope(state, config) & ~feasible(F.col("z"), config))


def contacts(state: DataFrame, config: dict, tolerance: float = 1e-5) -> DataFrame:
    return state.filter(bound_scope(state, config) & (F.abs(F.col("z") - boundary(config)) <= tolerance))


def pin_fields(config: dict) -> dict[int, str]:
    """Fields, of x, y, z and t, that the gauge freezes, by event."""
    if str(get(config, "gauge.mode")).lower() != "pin":
        return {}
    ids = [int(i) for i in get(config, "gauge.pin_event_ids")]
    if not ids:
        raise ValueError("gauge.mode=pin needs gauge.pin_event_ids")
    named = str(get(config, "gauge.pin_fields")).lower()
    fields = "".join(f for f in "xyz" if f in named) + ("t" if "t0" in named or named == "t" else "")
    return dict.fromkeys(ids, fields)


def frozen(state: DataFrame, config: dict) -> dict[int, str]:
    """Fields that do not move, by event: pinned ones and fixed depths."""
    out = pin_fields(config)
    here = {r[0] for r in state.filter(F.col("event_id").isin(list(out) or [0])).select("event_id").collect()}
    if missing := sorted(set(out) - here):
        raise ValueError(f"pinned events are not in the catalog: {missing}")
    if get(config, "constraints.fixed_depth.enabled"):
        for r in state.filter(fixed_scope(state, config)).select("event_id").toLocalIterator():
            out[r[0]] = "".join(sorted(set(out.get(r[0], "")) | {"z"}))
    return out


def fixed_targets(state: DataFrame, config: dict, reference: DataFrame | None = None) -> DataFrame:
    """(event_id, target): internal z of events of fixed depth, from one depth or a reference catalog."""
    scope = state.filter(fixed_scope(state, config)).select("event_id")
    if reference is None:
        return scope.withColumn("target", F.lit(internal(float(get(config, "constraints.fixed_depth.depth_km")), config)))
    if not scope.join(reference, "event_id", "left_anti").isEmpty():
        raise ValueError("an event of fixed depth is not in constraints.fixed_depth.reference_catalog")
    return scope.join(reference.select("event_id", depth_to_internal(F.col("depth_km"), *vertical(config)).alias("target")), "event_id")


def with_fixed_depths(state: DataFrame, targets: DataFrame) -> DataFrame:
    return state.join(targets, "event_id", "left").withColumn("z", F.coalesce("target", "z")).drop("target")


def validate_state(state: DataFrame, config: dict, allow_free: bool = False) -> DataFrame:
    """state, or an error if a depth is constrained twice, or frozen or started outside the bound."""
    pinned = [e for e, f in pin_fields(config).items() if "z" in f]
    fixed = fixed_scope(state, config)
    held = F.col("event_id").isin(pinned or [0])
    if not state.filter(fixed & held).isEmpty():
        raise ValueError("a depth is both pinned by the gauge and fixed")
    bad = violations(state, config)
    if not bad.filter(fixed | held).isEmpty():
        raise ValueError("a frozen depth violates constraints.depth_bound")
    if not allow_free and not bad.isEmpty():
        raise ValueError("initial depths violate constraints.depth_bound")
    return state


def mirror_plane(stations: DataFrame, config: dict) -> float:
    if str(get(config, "constraints.depth_bound.mirror_plane")).lower() == "manual":
        return internal(float(get(config, "constraints.depth_bound.mirror_depth_km")), config)
    plane = stations.agg(F.percentile("z_m", 0.5)).first()[0]
    if plane is None:
        raise ValueError("a station-median mirror plane needs stations")
    return float(plane)


def required_depths(state: DataFrame, stations: DataFrame, config: dict) -> list[float]:
    """Depths beyond stations and events that a lookup table must hold."""
    options = get(config, "constraints.depth_bound")
    if not options["enabled"]:
        return []
    out = [boundary(config)]
    if options["reflected_prelocation_restart"]:
        lo, hi = state.agg(F.min("z"), F.max("z")).first()
        plane = mirror_plane(stations, config)
        out += [out[0] - direction(config) * 1000.0 * float(options["pilot_shallow_margin_km"]), 2.0 * plane - lo, 2.0 * plane - hi]
    return out


def reflected(state: DataFrame, stations: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(state with forbidden depths mirrored, the events mirrored); what is still forbidden then is an error."""
    moved = violations(state, config).select("event_id")
    wrong = bound_scope(state, config) & ~feasible(F.col("z"), config)
    out = state.withColumn("z", F.when(wrong, 2.0 * mirror_plane(stations, config) - F.col("z")).otherwise(F.col("z")))
    if not violations(out, config).isEmpty():
        raise ValueError("the mirror plane does not bring every event inside the depth bound; choose a deeper mirror_depth_km")
    return out, moved
