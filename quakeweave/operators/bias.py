"""Coherent theta bias: a robust linear fit of residuals per station and phase, and its application."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeweave.functions.robust import EPSILON
from quakeweave.operators.solver import predicted

REPORT = "group_index long, station string, phase string, nobs long, apply_bias int, ax_s_per_m double, ay_s_per_m double, az_s_per_m double, rms_before_s double, rms_after_s double, improvement_fraction double"



def _weights(r: np.ndarray, sigma: np.ndarray, k: float) -> np.ndarray:
    n = np.abs(r / sigma)
    return np.where(n <= k, 1.0, k / np.maximum(n, EPSILON)) / sigma**2


def weighted_rms(r: np.ndarray, sigma: np.ndarray, k: float) -> float:
    w = _weights(r, sigma, k)
    return float(np.sqrt((w * r * r).sum() / max(w.sum(), EPSILON)))


def robust_fit(x: np.ndarray, y: np.ndarray, sigma: np.ndarray, k: float = 1.345, rounds: int = 6) -> np.ndarray:
    """Iteratively reweighted least squares without intercept."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = _weights(y - x @ beta, sigma, k)
        new = np.linalg.solve((x * w[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), x.T @ (w * y))
        if np.linalg.norm(new - beta) <= 1e-12 * (1 + np.linalg.norm(beta)):
            return new
        beta = new
    return beta


def scan_theta_bias(star: DataFrame, state: DataFrame, stations: DataFrame, model, options: dict) -> DataFrame:
    """One report row per group with enough observations.

    A group is one station and phase: its fit takes as many rows as the station has events, one task each.
    """
    deep = str(options["fit_dimensions"]).lower() == "xyz"
    k, rounds, least = float(options["huber_k"]), int(options["maximum_irls_iterations"]), float(options["minimum_sigma_s"])
    enough, gain = int(options["minimum_observations"]), float(options["minimum_improvement_fraction"])
    s = state.select("event_id", "x", "y", "z")
    rows = predicted(star, state, stations, model).join(s.toDF("i", "ix", "iy", "iz"), "i").join(s.toDF("j", "jx", "jy", "jz"), "j")
    rows = rows.select("group_idx", "station", "phase", (F.col("dt") - F.col("pred")).alias("r"), F.greatest("sigma", F.lit(least)).alias("sigma"), *[(F.col(f"i{d}") - F.col(f"j{d}")).alias(f"d{d}") for d in "xyz"])

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < enough:
            return pd.DataFrame(columns=[c.split()[0] for c in REPORT.split(", ")])
        x = g[["dx", "dy", "dz"][: 3 if deep else 2]].to_numpy()
        r, sigma = g["r"].to_numpy(), g["sigma"].to_numpy()
        beta = robust_fit(x, r, sigma, k, rounds)
        before, after = weighted_rms(r, sigma, k), weighted_rms(r - x @ beta, sigma, k)
        better = (before - after) / before if before > 0 else 0.0
        a = np.append(beta, np.zeros(3 - len(beta)))
        return pd.DataFrame([[g["group_idx"].iloc[0], g["station"].iloc[0], g["phase"].iloc[0], len(g), int(better >= gain), *a, before, after, better]], columns=[c.split()[0] for c in REPORT.split(", ")])

    return rows.groupBy("group_idx").applyInPandas(fit, REPORT)


def apply_bias(theta: DataFrame, model: DataFrame, state: DataFrame) -> DataFrame:
    """theta less each group's fitted gradient at the event; groups without a model and unknown events stay."""
    s = state.select("event_id", "x", "y", "z")
    out = theta.join(F.broadcast(model), ["station", "phase"], "left").join(s, "event_id", "left")  # the model has a row per station and phase
    shift = F.col("ax") * F.col("x") + F.col("ay") * F.col("y") + F.col("az") * F.col("z")
    return out.withColumn("theta_s", F.col("theta_s") - F.coalesce(shift, F.lit(0.0))).select(*theta.columns)
