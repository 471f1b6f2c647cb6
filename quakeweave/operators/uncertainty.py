"""Uncertainty: randomized probes of the inverse normal matrix, and a block bootstrap of Stage 2."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeweave.operators.solver import Bound, assembled, gauge_weights, pcg, relocate
from quakeweave.sources.storage import written

AXES = ("x", "y", "z")
LINEAR = ("event_id", "std_x_m", "std_y_m", "std_z_m", "cov_xx_m2", "cov_xy_m2", "cov_xz_m2", "cov_yy_m2", "cov_yz_m2", "cov_zz_m2")


def signs(ids: np.ndarray, seed: int, probe: int, axis: int) -> np.ndarray:
    """+1 or -1 for each event, by a hash of event, seed, probe and axis."""
    salt = (seed * 1_000_003 + probe * 3 + axis) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(m)
    return np.where((h ^ (h >> np.uint64(31))) & np.uint64(1), 1.0, -1.0)


def linearized(state: DataFrame, stations: DataFrame, obs: DataFrame, model, solver: dict, options: dict, *, kind: str = "origin_time", weight: float = 10.0, velocity: float = 5000.0, frozen: dict[int, str] | None = None, at_bound: set[int] = frozenset(), events: DataFrame | None = None) -> DataFrame:
    """Standard deviations and covariances of x, y and z of each event (LINEAR).

    Frozen directions have variance 0, a depth at its bound NaN; an axis without a converged solve gives NaN.
    Probes are independent: each is a task over the blocks, which are sent to all behind the solver's size check.
    """
    spark = state.sparkSession
    ids = np.array([r[0] for r in state.select("event_id").orderBy("event_id").collect()])
    system, _ = assembled(obs, state, stations, model, solver, ids, gauge_weights(kind, len(ids), weight, velocity))
    active = np.ones((len(ids), 4), bool)
    for event, fields in (frozen or {}).items():
        active[np.searchsorted(ids, event), ["xyzt".index(f) for f in fields]] = False
    for event in at_bound:
        active[np.searchsorted(ids, event), 2] = False
    tolerance, most, seed, how = float(options["inner_tolerance"]), int(options["inner_max_iterations"]), int(options["seed"]), str(solver["preconditioner"]).lower()

    def solve(probe: int, axis: int) -> tuple[np.ndarray, bool]:
        s = signs(ids, seed, probe, axis)
        rhs = np.zeros((len(ids), 4))
        rhs[:, axis] = np.where(active[:, axis], s, 0.0)
        operator = lambda v: np.where(active, system.apply(np.where(active, v, 0.0)), v)
        x, _, ok = pcg(operator, rhs, system.preconditioner(active, how), tolerance, most)
        return x[:, :3] * s[:, None], ok

    total, good = np.zeros((len(ids), 3, 3)), np.zeros(3, int)
    probes = int(options["probes"])
    if hasattr(system, "table"):
        results = ((axis, *solve(p, axis)) for p in range(probes) for axis in range(3))
    else:
        sent = spark.sparkContext.broadcast((system, active))

        def work(batches):
            local, act = sent.value
            for batch in batches:
                for p, axis in zip(batch["probe"], batch["axis"], strict=True):
                    s = signs(local.ids, seed, p, axis)
                    rhs = np.zeros((len(local.ids), 4))
                    rhs[:, axis] = np.where(act[:, axis], s, 0.0)
                    x, _, ok = pcg(lambda v: np.where(act, local.apply(np.where(act, v, 0.0)), v), rhs, local.preconditioner(act, how), tolerance, most)
                    if ok:
                        y = x[:, :3] * s[:, None]
                        yield pd.DataFrame({"event_id": local.ids, "axis": axis, "x": y[:, 0], "y": y[:, 1], "z": y[:, 2]})

        jobs = spark.createDataFrame([(p, a) for p in range(probes) for a in range(3)], "probe int, axis int").repartition(3 * probes)
        sums = jobs.mapInPandas(work, "event_id long, axis int, x double, y double, z double").groupBy("event_id", "axis").agg(*[F.sum(a).alias(a) for a in AXES], F.count("*").alias("n")).toPandas()
        for axis, g in sums.groupby("axis"):
            total[np.searchsorted(ids, g["event_id"].to_numpy()), :, axis] = g[list(AXES)].to_numpy()
            good[axis] = int(g["n"].iloc[0])
        results = ()
    for axis, y, ok in results:
        if ok:
            total[:, :, axis] += y
            good[axis] += 1
    with np.errstate(invalid="ignore", divide="ignore"):
        raw = np.where(good > 0, total / good, np.nan)
    still = ~active[:, :3]
    raw[still] = 0.0
    raw.transpose(0, 2, 1)[still] = 0.0
    cov = np.full_like(raw, np.nan)
    ok = np.isfinite(raw).all((1, 2))
    if ok.any():
        values, vectors = np.linalg.eigh(0.5 * (raw[ok] + raw[ok].transpose(0, 2, 1)))
        cov[ok] = np.einsum("nij,nj,nkj->nik", vectors, values.clip(0), vectors)
    for event in at_bound:
        k = np.searchsorted(ids, event)
        cov[k, 2, :] = cov[k, :, 2] = np.nan
    std = np.sqrt(np.einsum("nii->ni", cov).clip(0))
    out = pd.DataFrame(dict(zip(LINEAR, (ids, *std.T, *(cov[:, p, q] for p in range(3) for q in range(p, 3))), strict=True)))
    frame = spark.createDataFrame(out)
    return frame if events is None else frame.join(events.select("event_id"), "event_id", "left_semi")


def bootstrap_blocks(obs: DataFrame, unit: str = "station_phase") -> DataFrame:
    """obs with block: its group's, or its station's, number by ascending group."""
    if unit not in ("station_phase", "station"):
        raise ValueError(f"unknown resampling unit: {unit}")
    key = ["group_idx"] if unit == "station_phase" else ["station"]
    groups = obs.groupBy(*key).agg(F.min("group_idx").alias("_first"))
    groups = groups.withColumn("block", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("_first"))).drop("_first")  # a row per group
    return obs.join(groups, key)


def draw_counts(spark, blocks: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, block, times): for each replicate as many draws, with replacement, as there are blocks."""
    draws = spark.range(blocks * replicates).select((F.floor(F.col("id") / blocks) + 1).cast("int").alias("replicate"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)) + 1).cast("int").alias("block"))
    return draws.groupBy("replicate", "block").agg(F.count("*").alias("times"))


def resampled(obs: DataFrame, counts: DataFrame) -> DataFrame:
    """obs (with block) repeated as often as its block was drawn; counts has block and times."""
    return obs.join(counts.select("block", "times"), "block").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_k", "times")


def bootstrap(nominal: DataFrame, stations: DataFrame, obs: DataFrame, model, solver: dict, options: dict, events: DataFrame, pinned: DataFrame | None = None, **relocation) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, replicates, counts): Stage 2 solved anew for each draw of blocks, graph and filters as they are.

    samples: replicate, event_id, x, y, z, t0, at_bound for events active in a converged replicate.
    """
    spark = nominal.sparkSession
    blocked = written(bootstrap_blocks(obs, str(options["resampling_unit"]).lower()), "blocks")
    blocks = blocked.agg(F.max("block")).first()[0]
    if blocks is None:
        raise ValueError("no groups to resample")
    counts = written(draw_counts(spark, blocks, int(options["replicates"]), int(options["seed"])), "draws")
    samples, log = None, []
    for k in range(1, int(options["replicates"]) + 1):
        mine = counts.filter(F.col("replicate") == k)
        drawn = written(resampled(blocked, mine).drop("block"), "resampled")
        active = drawn.select(F.explode(F.array("i", "j")).alias("event_id")).distinct()
        active = active if pinned is None else active.union(pinned.select("event_id")).distinct()
        active = active.join(events.select("event_id"), "event_id", "left_semi")
        state, stats = relocate(nominal, stations, drawn, model, {**solver, "verbose": False}, **relocation)
        sound = stats.converged and state.filter(" or ".join(f"isnan({c})" for c in ("x", "y", "z", "t0"))).isEmpty()
        log.append((k, int(sound), len(stats.rms_s), mine.count(), blocks, active.count()))
        if sound:
            rows = state.join(active, "event_id").select(F.lit(k).alias("replicate"), "event_id", "x", "y", "z", "t0", F.col("event_id").isin(list(stats.bound_active) or [0]).alias("at_bound"))
            samples = rows if samples is None else samples.unionByName(rows)
    if samples is None:
        samples = spark.createDataFrame([], "replicate int, event_id long, x double, y double, z double, t0 double, at_bound boolean")
    return written(samples, "samples"), spark.createDataFrame(log, "replicate int, converged int, iterations int, unique_blocks long, total_blocks int, active_filtered_events long"), counts


def _axis(c: Column, method: str, confidence: float, multiplier: float) -> list[Column]:
    if method == "percentile":
        tail = (1.0 - confidence) / 2.0
        return [F.percentile(c, 0.5), F.percentile(c, tail), F.percentile(c, 1.0 - tail)]
    return [F.avg(c), F.avg(c) - multiplier * F.stddev_samp(c), F.avg(c) + multiplier * F.stddev_samp(c)]


def bootstrap_summary(samples: DataFrame, nominal: DataFrame, events: DataFrame, replicates: int, options: dict) -> DataFrame:
    """One row per event: valid samples, center and bounds of each axis, covariances; NaN where there are too few."""
    method = "percentile" if str(options["summary_method"]).lower() == "percentile" else "standard_deviation"
    n = nominal.select("event_id", *[F.col(a).alias(f"n{a}") for a in AXES])
    d = samples.join(n, "event_id").select("event_id", *[(F.col(a) - F.col(f"n{a}")).alias(f"d{a}") for a in AXES])
    parts = [F.count("*").alias("n_valid")]
    for a in AXES:
        parts += [c.alias(f"{name}_d{a}_m") for name, c in zip(("center", "lower", "upper"), _axis(F.col(f"d{a}"), method, float(options["confidence_level"]), float(options["standard_deviation_multiplier"])), strict=True)]
    parts += [F.covar_samp(f"d{a}", f"d{b}").alias(f"cov_{a}{b}_m2") for k, a in enumerate(AXES) for b in AXES[k:]]
    out = events.select("event_id").join(d.groupBy("event_id").agg(*parts), "event_id", "left")
    rest = [c for c in out.columns if c not in ("event_id", "n_valid")]
    valid = F.coalesce("n_valid", F.lit(0))
    return out.select("event_id", valid.alias("n_valid"), (valid / replicates).alias("valid_fraction"), *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in rest])


def bound_status(samples: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, n_valid, n_bound_active, bound_active_fraction)."""
    g = samples.groupBy("event_id").agg(F.count("*").alias("n_valid"), F.count_if("at_bound").alias("n_bound_active"))
    out = events.select("event_id").join(g, "event_id", "left").na.fill(0)
    return out.withColumn("bound_active_fraction", F.when(F.col("n_valid") > 0, F.col("n_bound_active") / F.col("n_valid")).otherwise(float("nan")))


def sample_table(samples: DataFrame, nominal: DataFrame, column: str, replicates: int) -> DataFrame:
    """Wide: event_id, all_data and one column per replicate."""
    names = list(range(1, replicates + 1))
    wide = samples.groupBy("event_id").pivot("replicate", names).agg(F.first(column))
    out = nominal.select("event_id", F.col(column).alias("all_data")).join(wide, "event_id", "left")
    return out.select("event_id", "all_data", *[F.coalesce(F.col(str(k)), F.lit(float("nan"))).alias(f"sample_{k:04d}") for k in names])
