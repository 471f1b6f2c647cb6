"""Robust Gauss-Newton relocation.

Spark assembles, once per outer iteration, the weighted normal matrix: one 4x4 block
per event and one per pair of events that share observations, however many stations
and phases observe them.  The gauge rows are means over all events, so they are added
as rank-one terms and never stored.  If the blocks fit the driver (``DRIVER_BLOCKS``,
checked by a count) conjugate gradients run there in NumPy; beyond that they run as
joins and sums over the block table.

Parameters of an event are x, y, z and t0, in this order.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeweave.functions.robust import EPSILON, finite, huber_weight
from quakeweave.sources.storage import written

DRIVER_BLOCKS = 2_000_000
DIRECT_LIMIT = 4000


@dataclass
class Stats:
    rms_s: list[float] = field(default_factory=list)
    step_rms_m: list[float] = field(default_factory=list)
    step_rms_s: list[float] = field(default_factory=list)
    inner_iterations: list[int] = field(default_factory=list)
    converged: bool = False
    bound_hits: dict[int, int] = field(default_factory=dict)
    bound_active: set[int] = field(default_factory=set)


def gauge_kind(config: dict) -> str:
    """origin_time, xyzt0, xyzt0_scaled or none."""
    g = config["gauge"]
    mode = str(g["mode"]).lower()
    if mode == "zero_mean":
        kind = {"origin_time": "origin_time", "t0_only": "origin_time", "xyzt0": "xyzt0", "xyzt0_unscaled": "xyzt0", "t0_xyz": "xyzt0", "xyzt0_scaled": "xyzt0_scaled", "t0_xyz_scaled": "xyzt0_scaled"}.get(str(g["zero_mean"]).lower())
        if kind:
            return kind
        raise ValueError(f"unknown gauge.zero_mean: {g['zero_mean']}")
    if mode == "pin":
        return "none" if "t" in str(g["pin_fields"]).lower() else "origin_time"
    raise ValueError("gauge.mode must be zero_mean or pin")


def gauge_weights(kind: str, n: int, weight: float, velocity: float) -> np.ndarray:
    """What the gauge adds to every entry between two events' like parameters: 4 numbers."""
    time = weight / n**2
    space = {"xyzt0": time, "xyzt0_scaled": time / velocity**2}.get(kind, 0.0)
    return np.array([space, space, space, 0.0 if kind == "none" else time])


def predicted(obs: DataFrame, state: DataFrame, stations: DataFrame, model) -> DataFrame:
    """Observations with pred and the gradients gix..gjz; a time that is not finite is an error."""
    s = state.select("event_id", "x", "y", "z", "t0")
    st = F.broadcast(stations.select("station", "x_m", "y_m", "z_m"))
    rows = obs.join(s.toDF("i", "xi", "yi", "zi", "ti"), "i").join(s.toDF("j", "xj", "yj", "zj", "tj"), "j").join(st, "station")
    at = lambda e: model.expr(F.col("phase"), F.col(f"x{e}"), F.col(f"y{e}"), F.col(f"z{e}"), F.col("x_m"), F.col("y_m"), F.col("z_m"))
    rows = rows.withColumn("_a", at("i")).withColumn("_b", at("j"))
    pred = F.col("ti") - F.col("tj") + F.col("_a.t") - F.col("_b.t")
    pred = F.when(finite(pred), pred).otherwise(F.raise_error(F.lit("travel-time lookup returned a non-finite value")).cast("double"))
    return rows.select(*obs.columns, pred.alias("pred"), *[F.col(f"_{c}.g{d}").alias(f"g{e}{d}") for c, e in (("a", "i"), ("b", "j")) for d in "xyz"])


def weighted(rows: DataFrame, least_sigma: float, huber_k: float) -> DataFrame:
    """Rows of predicted() with residual r and weight w."""
    sigma = F.greatest("sigma", F.lit(least_sigma))
    return rows.withColumn("r", F.col("dt") - F.col("pred")).withColumn("w", huber_weight(F.col("r") / sigma, huber_k) / (sigma * sigma))


def _vector(e: str, sign: float = 1.0) -> list[Column]:
    return [sign * F.col(f"g{e}{d}") for d in "xyz"] + [F.lit(sign)]


BLOCK = [f"m{p}{q}" for p in range(4) for q in range(4)] + [f"r{p}" for p in range(4)] + ["wrr", "w"]


def blocks(rows: DataFrame) -> DataFrame:
    """(a, b, m00..m33, r0..r3, wrr, w): normal blocks, a = b with the right side, and a < b for pairs, from weighted() rows.

    wrr and w, of a pair, are the sums of w r r and w over its observations.  An observation is read once and
    gives its three blocks together.
    """
    w, r, zero = F.col("w"), F.col("r"), F.lit(0.0)
    vi, vj = _vector("i"), _vector("j", -1.0)
    flip = F.col("i") > F.col("j")
    first, second = [F.when(flip, y).otherwise(x) for x, y in zip(vi, vj, strict=True)], [F.when(flip, x).otherwise(y) for x, y in zip(vi, vj, strict=True)]

    def block(a: Column, b: Column, left: list[Column], right: list[Column], own: bool) -> Column:
        values = [w * x * y for x in left for y in right] + [w * r * x if own else zero for x in left] + ([zero, zero] if own else [w * r * r, w])
        return F.struct(a.alias("a"), b.alias("b"), *[v.alias(n) for v, n in zip(values, BLOCK, strict=True)])

    each = [block(F.col("i"), F.col("i"), vi, vi, True), block(F.col("j"), F.col("j"), vj, vj, True), block(F.least("i", "j"), F.greatest("i", "j"), first, second, False)]
    return rows.select(F.explode(F.array(*each)).alias("e")).select("e.*").groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in BLOCK])


class System:
    """Blocks on the driver, in NumPy: (n, 4) vectors, active masks, the gauge as rank-one terms."""

    def __init__(self, ids: np.ndarray, table, gauge: np.ndarray, damping: float):
        self.ids, self.gauge, self.damping, n = ids, gauge, damping, len(ids)
        a, b = np.searchsorted(ids, table["a"].to_numpy()), np.searchsorted(ids, table["b"].to_numpy())
        m = table[[f"m{p}{q}" for p in range(4) for q in range(4)]].to_numpy(float).reshape(-1, 4, 4)
        own = a == b
        self.diagonal, self.rhs = np.zeros((n, 4, 4)), np.zeros((n, 4))
        self.diagonal[a[own]], self.rhs[a[own]] = m[own], table[[f"r{p}" for p in range(4)]].to_numpy(float)[own]
        self.a, self.b, self.m = a[~own], b[~own], m[~own]

    def apply(self, v: np.ndarray) -> np.ndarray:
        """(A'A + damping) v, the gauge rows included."""
        out = np.einsum("npq,nq->np", self.diagonal, v) + self.damping * v + self.gauge * v.sum(0)
        np.add.at(out, self.a, np.einsum("npq,nq->np", self.m, v[self.b]))
        np.add.at(out, self.b, np.einsum("npq,np->nq", self.m, v[self.a]))
        return out

    def preconditioner(self, active: np.ndarray, kind: str):
        if kind == "none":
            return lambda r: r.copy()
        if kind == "diagonal":
            d = np.einsum("npp->np", self.diagonal) + self.damping
            inverse = np.where(active, 1.0 / np.maximum(d, EPSILON), 1.0)
            return lambda r: inverse * r
        m = self.diagonal + self.damping * np.eye(4)
        m = np.where(active[:, :, None] & active[:, None, :], m, 0.0) + np.eye(4) * ~active[:, :, None]
        inverse = np.linalg.inv(m)
        return lambda r: np.einsum("npq,nq->np", inverse, r)


class TableSystem(System):
    """The same over a block table that does not fit the driver; vectors of the events do."""

    def __init__(self, ids: np.ndarray, table: DataFrame, gauge: np.ndarray, damping: float):
        super().__init__(ids, table.filter("a = b").toPandas(), gauge, damping)
        self.table = table.filter("a <> b")

    def apply(self, v: np.ndarray) -> np.ndarray:
        import pandas as pd

        spark = self.table.sparkSession
        x = spark.createDataFrame(pd.DataFrame({"e": self.ids, **{f"v{p}": v[:, p] for p in range(4)}}))
        rows = self.table.join(x.toDF("b", "b0", "b1", "b2", "b3"), "b").join(x.toDF("a", "a0", "a1", "a2", "a3"), "a")
        by_a = [sum((F.col(f"m{p}{q}") * F.col(f"b{q}") for q in range(4)), F.lit(0.0)).alias(f"s{p}") for p in range(4)]
        by_b = [sum((F.col(f"m{p}{q}") * F.col(f"a{p}") for p in range(4)), F.lit(0.0)).alias(f"s{q}") for q in range(4)]
        got = rows.select(F.col("a").alias("e"), *by_a).union(rows.select(F.col("b"), *by_b)).groupBy("e").agg(*[F.sum(f"s{p}").alias(f"s{p}") for p in range(4)]).toPandas()
        out = np.einsum("npq,nq->np", self.diagonal, v) + self.damping * v + self.gauge * v.sum(0)
        out[np.searchsorted(self.ids, got["e"].to_numpy())] += got[[f"s{p}" for p in range(4)]].to_numpy()
        return out


def pcg(operator, rhs: np.ndarray, precondition, tolerance: float = 1e-5, most: int = 250) -> tuple[np.ndarray, int, bool]:
    """Preconditioned conjugate gradients: (solution, iterations, converged)."""
    x, r = np.zeros_like(rhs), rhs.copy()
    goal = tolerance * max(float(np.linalg.norm(rhs)), EPSILON)
    if np.linalg.norm(r) <= goal:
        return x, 0, True
    z = precondition(r)
    d, rz = z.copy(), float((r * z).sum())
    for k in range(1, most + 1):
        ad = operator(d)
        curve = float((d * ad).sum())
        if not (curve > 0 and np.isfinite(curve)):
            return x, k, False
        step = rz / curve
        x += step * d
        r -= step * ad
        if np.linalg.norm(r) <= goal:
            return x, k, True
        z = precondition(r)
        rz, before = float((r * z).sum()), rz
        d = z + rz / before * d
    return x, most, False


def direct(operator, rhs: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """Dense solution for the free parameters."""
    free = np.flatnonzero(active.ravel())
    if len(free) > DIRECT_LIMIT:
        raise ValueError(f"the direct solver takes {DIRECT_LIMIT} free parameters at most; use pcg")
    out = np.zeros(rhs.size)
    if len(free):
        columns = []
        for k in free:
            unit = np.zeros(rhs.size)
            unit[k] = 1.0
            columns.append(operator(unit.reshape(rhs.shape)).ravel()[free])
        m = np.array(columns)
        out[free] = np.linalg.solve(0.5 * (m + m.T), rhs.ravel()[free])
    return out.reshape(rhs.shape), 0, True


def reduced_update(system: System, rhs: np.ndarray, active: np.ndarray, fixed: np.ndarray, options: dict) -> tuple[np.ndarray, int, bool]:
    """The update of the active parameters around one that is fixed."""
    right = np.where(active, rhs - system.apply(fixed), 0.0)
    operator = lambda v: np.where(active, system.apply(np.where(active, v, 0.0)), v)
    if str(options["linear_solver"]).lower() == "direct":
        step, n, ok = direct(operator, right, active)
    else:
        step, n, ok = pcg(operator, right, system.preconditioner(active, str(options["preconditioner"]).lower()), float(options["inner_tolerance"]), int(options["inner_max_iterations"]))
    return fixed + step, n, ok


def limited(update: np.ndarray, options: dict) -> np.ndarray:
    """Steps cut to the largest allowed in space (by event) and in time."""
    space, time = float(options.get("max_event_step_m", 0.0)), float(options.get("max_origin_step_s", 0.0))
    if space > 0:
        length = np.sqrt((update[:, :3] ** 2).sum(1))
        update[:, :3] *= np.where(length > space, space / np.maximum(length, EPSILON), 1.0)[:, None]
    if time > 0:
        update[:, 3] = update[:, 3].clip(-time, time)
    return update


@dataclass
class Bound:
    """A lower bound of depth: scope mask, its internal z, and which way is deeper."""

    scope: np.ndarray
    z: float = 0.0
    direction: float = 1.0

    def feasible(self, z: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
        return self.direction * (z - self.z) >= -tolerance


def model_update(system: System, z: np.ndarray, rhs: np.ndarray, active: np.ndarray, bound: Bound, options: dict) -> tuple[np.ndarray, int, bool, np.ndarray, np.ndarray]:
    """(update, inner iterations, converged, engaged, in contact): solve, hold what would cross the bound at it, and solve again."""
    if (bound.scope & ~bound.feasible(z)).any():
        raise ValueError("a bounded relocation needs a feasible start")
    free, fixed, engaged, total, fine = active.copy(), np.zeros_like(rhs), np.zeros(len(z), bool), 0, True
    damping = float(options["step_damping"])
    for _ in range(int(bound.scope.sum()) + 1):
        raw, n, ok = reduced_update(system, rhs, free, fixed, options)
        total, fine = total + n, fine and ok
        update = np.where(active, limited(damping * raw, options), 0.0)
        crossing = bound.scope & active[:, 2] & ~bound.feasible(z + update[:, 2])
        if not crossing.any():
            contact = engaged & (np.abs(z + update[:, 2] - bound.z) <= 1e-5)
            return update, total, fine, engaged, contact
        new = crossing & ~engaged
        if not new.any():
            raise ValueError("the depth bound's active set found no feasible update")
        free[new, 2] = False
        fixed[new, 2] = (bound.z - z[new]) / damping
        engaged |= new
    raise ValueError("the depth bound's active set did not end")


def assembled(obs: DataFrame, state: DataFrame, stations: DataFrame, model, options: dict, ids: np.ndarray, gauge: np.ndarray) -> tuple[System, float]:
    """(system, robust RMS of the residuals) at a state: one Spark job."""
    rows = weighted(predicted(obs, state, stations, model), float(options["min_sigma_s"]), float(options["huber_k"]))
    table = written(blocks(rows), "blocks")
    wrr, w, n = table.agg(F.sum("wrr"), F.sum("w"), F.count("*")).first()
    damping = max(float(options["damping_lambda"]), 1e-8)
    small = n <= DRIVER_BLOCKS
    system = System(ids, table.toPandas(), gauge, damping) if small else TableSystem(ids, table, gauge, damping)
    return system, float(np.sqrt((wrr or 0.0) / max(w or 0.0, EPSILON)))


def relocate(state: DataFrame, stations: DataFrame, obs: DataFrame, model, options: dict, *, kind: str = "origin_time", weight: float = 10.0, velocity: float = 5000.0, frozen: dict[int, str] | None = None, bound: Bound | None = None) -> tuple[DataFrame, Stats]:
    """Solve for the states of all events: (state, statistics).

    frozen gives the fields ("x", "y", "z", "t") that do not move, by event.  bound's scope is by ascending event id.
    """
    spark, stats = state.sparkSession, Stats()
    frame = state.select("event_id", "x", "y", "z", "t0").orderBy("event_id").toPandas()  # four numbers an event
    ids, v = frame["event_id"].to_numpy(), frame[["x", "y", "z", "t0"]].to_numpy(float)
    bound = bound or Bound(np.zeros(len(ids), bool))
    if (bound.scope & ~bound.feasible(v[:, 2])).any():
        raise ValueError("a bounded relocation needs feasible depths")
    obs = written(obs, "observations")
    if obs.isEmpty():
        stats.converged = True
        return state, stats
    active = np.ones((len(ids), 4), bool)
    for event, fields in (frozen or {}).items():
        active[np.searchsorted(ids, event), ["xyzt".index(f) for f in fields]] = False
    gauge = gauge_weights(kind, len(ids), weight, velocity)
    stall = 0
    for k in range(1, int(options["max_outer_iterations"]) + 1):
        frame[["x", "y", "z", "t0"]] = v
        system, rms = assembled(obs, spark.createDataFrame(frame), stations, model, options, ids, gauge)
        rhs = np.where(active, system.rhs, 0.0)
        update, inner, ok, engaged, contact = model_update(system, v[:, 2], rhs, active, bound, options)
        if not ok:
            warnings.warn(f"the inner solve did not converge in outer iteration {k}", stacklevel=2)
        v = v + update
        v[contact, 2] = bound.z
        if kind == "origin_time":
            v[:, 3] -= v[:, 3].mean()
        for event in ids[engaged].tolist():
            stats.bound_hits[event] = stats.bound_hits.get(event, 0) + 1
        stats.bound_active = set(ids[contact].tolist())
        stats.rms_s.append(rms)
        stats.step_rms_m.append(float(np.sqrt((update[:, :3] ** 2).sum() / len(ids))))
        stats.step_rms_s.append(float(np.sqrt((update[:, 3] ** 2).mean())))
        stats.inner_iterations.append(inner)
        if k >= int(options["min_outer_iterations"]):
            if stats.step_rms_m[-1] <= float(options["stop_step_rms_m"]) and stats.step_rms_s[-1] <= float(options["stop_step_rms_s"]):
                stats.converged = True
                break
            if k > 1:
                stall = stall + 1 if abs(stats.rms_s[-2] - rms) <= float(options["stop_rms_improvement_s"]) else 0
                if 0 < int(options["stop_stall_iterations"]) <= stall:
                    stats.converged = True
                    break
    frame[["x", "y", "z", "t0"]] = v
    return written(spark.createDataFrame(frame), "state"), stats
