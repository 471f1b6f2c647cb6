"""Writers: Parquet as the store, and text in the catalogs' own formats.

A text file keeps a catalog's row order, so its rows are sorted and streamed to one
file through the driver, one partition at a time; Parquet copies are written in parallel.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeweave.functions.calendar import FIELDS, moved_origin
from quakeweave.functions.geo import internal_to_depth, local_ll
from quakeweave.sources.text import catalog_columns

OUTPUTS = ("catalog_preloc.txt", "catalog_dd.txt", "run_summary.toml")


def general(x: float, digits: int = 12) -> str:
    """%.<digits>g, with NaN and Inf spelt so."""
    return "NaN" if x != x else ("Inf" if x > 0 else "-Inf") if abs(x) == float("inf") else f"{x:.{digits}g}"


def write_lines(path: str, header: str | None, lines: Iterable[str]) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        if header:
            f.write(header + "\n")
        f.writelines(line + "\n" for line in lines)
    return path


def write_rows(path: str, df: DataFrame, order: str, form: Callable, separator: str = " ", names: list[str] | None = None, prefix: str = "") -> str:
    """One text line per row, in order."""
    header = prefix + separator.join(names or df.columns)
    return write_lines(path, header, (separator.join(form(r)) for r in df.orderBy(order).toLocalIterator()))


def _cells(r) -> list[str]:
    return [str(int(v)) if isinstance(v, bool | int) else general(v) if isinstance(v, float) else str(v) for v in r]


def prepare_output(config: dict) -> str:
    """The output folder; one that holds results already is an error unless run.overwrite."""
    out = config["io"]["output_dir"]
    os.makedirs(out, exist_ok=True)
    if not config["run"]["overwrite"] and any(os.path.exists(os.path.join(out, n)) for n in OUTPUTS):
        raise FileExistsError(f"{out} holds results and run.overwrite is false")
    return out


def catalog_with_state(catalog: DataFrame, state: DataFrame, config: dict, frame: tuple[float, float, float]) -> DataFrame:
    """catalog with lat, lon and depth_km of the state, and its t0."""
    lat, lon = local_ll(F.col("x"), F.col("y"), *frame)
    c = config["coordinates"]
    s = state.select("event_id", lat.alias("lat"), lon.alias("lon"), internal_to_depth(F.col("z"), str(c["event_vertical"]).lower(), float(c["event_z0_m"])).alias("depth_km"), "t0")
    return catalog.drop("lat", "lon", "depth_km").join(s, "event_id")


def relocated_rows(catalog: DataFrame, state: DataFrame, config: dict, frame: tuple[float, float, float], basis: DataFrame | None = None, active: DataFrame | None = None, only: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(row_idx, event_id, values, applied) in the catalog's columns, and where those stand.

    Origin times move by t0 less the basis, for active events; rows of only are kept.
    """
    width = catalog.select(F.size("raw")).first()[0]
    c = catalog_columns(config, width)
    rows = catalog_with_state(catalog, state, config, frame)
    rows = rows.withColumn("b", F.lit(0.0)) if basis is None else rows.join(basis.select("event_id", F.col("dt0_s").alias("b")), "event_id", "left").na.fill(0.0, ["b"])
    rows = rows.withColumn("a", F.lit(True)) if active is None else rows.join(active.select("event_id", F.lit(True).alias("a")), "event_id", "left").na.fill(False, ["a"])
    if only is not None:
        rows = rows.join(only.select("event_id"), "event_id", "left_semi")
    new = {c["latitude"]: F.col("lat"), c["longitude"]: F.col("lon"), c["depth"]: F.col("depth_km")}
    rows = rows.withColumn("applied", F.lit(True))
    if c["origin"]:
        move = F.when(F.col("a"), F.col("t0") - F.col("b")).otherwise(0.0)
        rows = rows.withColumn("m", moved_origin(*[F.element_at("raw", k) for k in c["origin"]], move, int(config["catalog"]["origin_time_decimals"])))
        new |= {k: F.col(f"m.{name}") for k, name in zip(c["origin"], FIELDS, strict=True)}
        rows = rows.withColumn("applied", F.col("m.applied"))
    values = F.array(*[new.get(k, F.element_at("raw", k)) for k in range(1, width + 1)])
    return rows.select("row_idx", "event_id", values.alias("values"), "applied"), c


def formatted(values: list[float], c: dict, decimals: int) -> list[str]:
    """A catalog row as text: a column's place and kind set its digits."""
    out = []
    for k, v in enumerate(values, 1):
        if k == c["event_id"] or k in c["origin"][:5] or (k <= 5 and k not in c["origin"] and abs(v - round(v)) < 1e-8):
            out.append(str(round(v)))
        elif c["origin"] and k == c["origin"][5]:
            out.append(f"{v:.{decimals}f}")
        elif k in (c["latitude"], c["longitude"]):
            out.append(f"{v:.6f}")
        elif k == c["depth"]:
            out.append(f"{v:.4f}")
        elif k == 10:
            out.append(f"{v:.3f}")
        else:
            out.append(general(v, 8))
    return out


def write_catalog(path: str, catalog: DataFrame, state: DataFrame, config: dict, frame: tuple[float, float, float], **options) -> str:
    rows, c = relocated_rows(catalog, state, config, frame, **options)
    decimals = int(config["catalog"]["origin_time_decimals"])
    return write_lines(path, None, (" ".join(formatted(r["values"], c, decimals)) for r in rows.orderBy("row_idx").toLocalIterator()))


def write_shift(path: str, shift: DataFrame, catalog: DataFrame) -> str:
    rows = shift.join(catalog.select("event_id", "row_idx"), "event_id").orderBy("row_idx")
    names = ("dx_m", "dy_m", "dz_m")
    return write_lines(path, "# dx_m dy_m dz_m dt0_s EventID", (" ".join([*(f"{r[n]:.6f}" for n in names), f"{r['dt0_s']:.12f}", str(r["event_id"])]) for r in rows.toLocalIterator()))


def write_csv(path: str, df: DataFrame, order: str) -> str:
    return write_rows(path, df, order, _cells, ",")


def write_table(path: str, df: DataFrame, order: str, names: list[str] | None = None) -> str:
    return write_rows(path, df, order, _cells, " ", names)


def write_solver_history(path: str, stages: list[tuple[str, object]]) -> str:
    lines = (f"{name},{k + 1},{general(s.rms_s[k])},{general(s.step_rms_m[k])},{general(s.step_rms_s[k])},{s.inner_iterations[k]}" for name, s in stages for k in range(len(s.rms_s)))
    return write_lines(path, "stage,outer_iteration,robust_rms_s,step_rms_m,step_rms_s,inner_iterations", lines)


def write_toml(path: str, values: dict) -> str:
    """Nested values as TOML, by key."""

    def cell(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list | tuple):
            return "[" + ", ".join(map(cell, v)) + "]"
        return str(v) if isinstance(v, int) else repr(float(v)).replace("inf", "inf") if isinstance(v, float) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    lines = [f"{k} = {cell(v)}" for k, v in sorted(values.items()) if not isinstance(v, dict)]
    for name, section in sorted((k, v) for k, v in values.items() if isinstance(v, dict)):
        lines += ["", f"[{name}]", *(f"{k} = {cell(v)}" for k, v in sorted(section.items()))]
    return write_lines(path, None, lines)
