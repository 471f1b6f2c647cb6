"""Text tables: numeric matrices, catalogs, stations, theta folders, shifts, velocity and bias models.

Files are read whole, one row each, and split in order, so that rows keep their place
and a file can be checked as a unit.  Parquet is the store for large data; these
readers are the way in.  What is invalid raises an error when the data is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.functions.robust import finite

TOO_LARGE = 9007199254740992.0


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _lines(files: DataFrame, comments: str = "#%") -> DataFrame:
    """(file, line_no, fields): the fields of lines that are not blank once comments are cut; commas part fields as spaces do."""
    lines = files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("line", f"[{comments}].*$", ""), r"[,\s]+", " "))
    return lines.withColumn("clean", clean).filter("clean <> ''").select("file", "line_no", F.split("clean", " ").alias("fields"))


def number(text: Column) -> Column:
    """A field as a double, null where it is none; NaN and Inf are numbers."""
    plain = F.lower(text)
    special = F.when(plain.isin("nan", "+nan", "-nan"), float("nan")).when(plain.isin("inf", "+inf", "infinity", "+infinity"), float("inf")).when(plain.isin("-inf", "-infinity"), float("-inf"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")).otherwise(special)


def numeric_rows(files: DataFrame, comments: str = "#%", skip_text: bool = False) -> DataFrame:
    """(file, line_no, v array<double>): the rows of rectangular numeric files.

    Text lines before the first numeric row are a header; after it they are an error, or skipped with skip_text.
    Rows of another width than the file's first are an error.
    """
    rows = _lines(files, comments).withColumn("v", F.transform("fields", number))
    rows = rows.withColumn("ok", ~F.exists("v", lambda x: x.isNull()))
    of_file = Window.partitionBy("file")
    rows = rows.withColumn("first", F.min(F.when(F.col("ok"), F.col("line_no"))).over(of_file))
    if skip_text:
        rows = rows.filter("ok")
    rows = rows.filter("line_no >= first").withColumn("width", F.min_by(F.size("v"), F.col("line_no")).over(of_file))
    said = F.concat(F.col("file"), F.lit(" line "), (F.col("line_no") + 1).cast("string"))
    bad = F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("non-numeric field in "), said))).when(F.size("v") != F.col("width"), F.raise_error(F.concat(F.lit("inconsistent column count in "), said)))
    return rows.select("file", "line_no", F.when(bad.isNull(), F.col("v")).alias("v"))


def read_numeric_matrix(spark: SparkSession, path: str, comments: str = "#%", skip_text: bool = False) -> DataFrame:
    rows = numeric_rows(_files(spark, path), comments, skip_text)
    if rows.limit(1).count() == 0:
        raise ValueError(f"no numeric rows in {path}")
    return rows


def event_id(x: Column, source: str) -> Column:
    """A positive whole number below 2^53 as a long; anything else is an error (2^53 itself may be a rounded neighbour)."""
    good = finite(x) & (x > 0) & (x == F.floor(x)) & (x < TOO_LARGE)
    return F.when(good, x.cast("long")).otherwise(F.raise_error(F.lit(f"{source}: event ids must be positive whole numbers below 2^53")).cast("long"))


def resolved(column: int, width: int, name: str) -> int:
    """Place from 1 of a column that may be counted from the end."""
    k = width + column + 1 if column < 0 else column
    if not 1 <= k <= width:
        raise ValueError(f"{name} column {column} is outside a table of {width} columns")
    return k


def catalog_columns(config: dict, width: int) -> dict:
    c = config["catalog"]
    named = {n: resolved(int(c[f"{n}_column"]), width, n) for n in ("latitude", "longitude", "depth", "event_id")}
    origin = list(c["origin_time_columns"])
    if len(origin) not in (0, 6):
        raise ValueError("catalog.origin_time_columns must be empty or year, month, day, hour, minute and second")
    named["origin"] = [resolved(int(k), width, "origin time") for k in origin]
    places = [v for k, v in named.items() if k != "origin"] + named["origin"]
    if len(set(places)) != len(places):
        raise ValueError("catalog columns must be distinct")
    return named


def read_catalog(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """(row_idx, event_id, lat, lon, depth_km, raw): a catalog with all its columns kept in raw."""
    rows = read_numeric_matrix(spark, path)
    width = rows.select(F.size("v")).first()[0]
    if width < 4:
        raise ValueError("a catalog needs four columns at least")
    c = catalog_columns(config, width)
    v = lambda name: F.element_at("v", c[name])
    within = lambda x, most, name: F.when(finite(x) & (F.abs(x) <= most), x).otherwise(F.raise_error(F.lit(f"invalid catalog {name}")).cast("double"))
    out = rows.select(
        F.row_number().over(Window.partitionBy("file").orderBy("line_no")).cast("long").alias("row_idx"), event_id(v("event_id"), path).alias("event_id"),
        within(v("latitude"), 90, "latitude").alias("lat"), within(v("longitude"), 180, "longitude").alias("lon"), within(v("depth"), 1e300, "depth").alias("depth_km"), F.col("v").alias("raw"),
    )
    if not out.groupBy("event_id").count().filter("count > 1").isEmpty():
        raise ValueError("catalog event ids are not unique")
    return out


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """(station, lat, lon, elev_m) from `STA lat lon elev` or `NET STA lat lon elev ...` lines."""
    rows = _lines(_files(spark, path))
    n = F.size("fields")
    at = lambda k: F.when(n == 4, F.get("fields", F.lit(k))).otherwise(F.get("fields", F.lit(k + 1)))
    bad = lambda what: F.raise_error(F.concat(F.lit(f"{what} at station line "), (F.col("line_no") + 1).cast("string")))

    def coordinate(k: int, most: float) -> Column:
        x = number(at(k))
        return F.when(n < 4, bad("fewer than four fields").cast("double")).when(x.isNull() | (F.abs(x) > most), bad("invalid coordinates").cast("double")).otherwise(x)

    out = rows.select(at(0).alias("station"), coordinate(1, 90).alias("lat"), coordinate(2, 180).alias("lon"), coordinate(3, float("inf")).alias("elev_m"))
    if out.limit(1).count() == 0:
        raise ValueError(f"no stations in {path}")
    if not out.groupBy("station").count().filter("count > 1").isEmpty():
        raise ValueError("station names must be unique")
    return out


def _station_phase(file: Column, prefix: str) -> tuple[Column, Column]:
    pattern = rf"(?i)^{prefix}(.+)_([^_]+)\.txt$"
    phase = F.upper(F.regexp_extract(file, pattern, 2))
    good = F.when(phase.isin("P", "S"), phase).otherwise(F.raise_error(F.concat(F.lit("phase must be P or S in "), file)))
    return F.regexp_extract(file, pattern, 1), good


def read_std_folder(spark: SparkSession, path: str) -> DataFrame:
    """(station, phase, event_id, sigma_s, degree, has_degree): uncertainties; files of one column have none."""
    rows = numeric_rows(_files(spark, path, "std_theta_*.txt")).filter((F.size("v") >= 2) & finite(F.element_at("v", 1)))
    station, phase = _station_phase(F.col("file"), "std_theta_")
    width = F.size("v")
    degree = F.when((width >= 4) & finite(F.get("v", F.lit(3))), F.rint(F.get("v", F.lit(3)))).otherwise(0).cast("long")
    rows = rows.select(station.alias("station"), phase.alias("phase"), "line_no", event_id(F.element_at("v", 1), path).alias("event_id"), F.element_at("v", 2).alias("sigma_s"), degree.alias("degree"), (width >= 4).alias("has_degree"))
    last = F.row_number().over(Window.partitionBy("station", "phase", "event_id").orderBy(F.col("line_no").desc()))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n", "line_no")


def load_theta_folder(spark: SparkSession, theta_dir: str, std_dir: str = "") -> DataFrame:
    """Theta groups, one per file, numbered by file name; of rows of one event the last counts.

    group_idx, station, phase, event_id, theta_s, ref_id, sigma, degree, has_sigma, has_degree.
    """
    rows = numeric_rows(_files(spark, theta_dir, "theta_*.txt"))
    rows = rows.withColumn("v", F.when(F.size("v") >= 3, F.col("v")).otherwise(F.raise_error(F.lit("theta files need three columns at least"))))
    rows = rows.filter(finite(F.element_at("v", 1)) & finite(F.element_at("v", 2)) & finite(F.element_at("v", 3)))
    station, phase = _station_phase(F.col("file"), "theta_")
    rows = rows.select("file", "line_no", station.alias("station"), phase.alias("phase"), event_id(F.element_at("v", 1), theta_dir).alias("event_id"), F.element_at("v", 2).alias("theta_s"), event_id(F.element_at("v", 3), theta_dir).alias("ref_id"))
    last = F.row_number().over(Window.partitionBy("file", "event_id").orderBy(F.col("line_no").desc()))
    rows = rows.withColumn("_n", last).filter("_n = 1")
    if rows.isEmpty():
        raise ValueError("theta files hold no finite entries")
    groups = rows.select("file").distinct().withColumn("group_idx", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("file")))  # a row per file
    rows = rows.join(groups, "file").select("group_idx", "station", "phase", "event_id", "theta_s", "ref_id")
    nan = F.lit(float("nan"))
    if not std_dir or not _exists(spark, std_dir):
        return rows.withColumns({"sigma": nan, "degree": F.lit(0).cast("long"), "has_sigma": F.lit(False), "has_degree": F.lit(False)})
    std = read_std_folder(spark, std_dir)
    flags = std.groupBy("station", "phase").agg(F.lit(True).alias("hs"), F.max("has_degree").alias("hd"))
    out = rows.join(flags, ["station", "phase"], "left").join(std.drop("has_degree"), ["station", "phase", "event_id"], "left")
    return out.select(
        "group_idx", "station", "phase", "event_id", "theta_s", "ref_id", F.coalesce("sigma_s", nan).alias("sigma"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("hs", F.lit(False)).alias("has_sigma"), F.coalesce("hd", F.lit(False)).alias("has_degree")
    )


def read_catalog_shift(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """(event_id, dx_m, dy_m, dz_m, dt0_s) of the catalog's events; the file may hold more, but not fewer."""
    rows = read_numeric_matrix(spark, path)
    good = (F.size("v") == 5) & F.forall("v", finite)
    v = F.when(good, F.col("v")).otherwise(F.raise_error(F.lit("a shift file has five finite columns: dx_m dy_m dz_m dt0_s EventID")))
    rows = rows.withColumn("v", v)
    names = ("dx_m", "dy_m", "dz_m", "dt0_s")
    out = rows.select(event_id(F.element_at("v", 5), path).alias("event_id"), *[F.element_at("v", k + 1).alias(n) for k, n in enumerate(names)])
    if not out.groupBy("event_id").count().filter("count > 1").isEmpty():
        raise ValueError("shift event ids are not unique")
    if not catalog.join(out, "event_id", "left_anti").isEmpty():
        raise ValueError("the shift file lacks events of the catalog")
    return out.join(catalog.select("event_id"), "event_id", "left_semi")


def read_velocity_model(spark: SparkSession, path: str) -> dict:
    """depth_m, vp_ms, vs_ms (lists by depth, repeated depths kept in order), earth_radius_m (NaN without radii) and sha256.

    Four columns are `depth radius Vp Vs` if the median of the second exceeds 1000, else `depth Vp Vs` and more.
    """
    rows = [r["v"] for r in read_numeric_matrix(spark, path).orderBy("line_no").collect()]  # a layer a row
    if len(rows[0]) < 3:
        raise ValueError("a velocity model needs depth, Vp and Vs")
    real = lambda x: x == x and abs(x) != float("inf")
    second = sorted(r[1] for r in rows if real(r[1]))
    radii = len(rows[0]) >= 4 and bool(second) and second[(len(second) + 1) // 2 - 1] > 1000.0
    p, s = (2, 3) if radii else (1, 2)
    rows = [r for r in rows if all(real(r[k]) for k in (0, p, s)) and r[p] > 0 and r[s] > 0 and (not radii or (real(r[1]) and r[1] > 0))]
    if len(rows) < 2:
        raise ValueError("a velocity model needs two valid layers")
    rows.sort(key=lambda r: r[0])
    radius = sum(r[0] + r[1] for r in rows) / len(rows) * 1000.0 if radii else float("nan")
    content = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return {"depth_m": [r[0] * 1000.0 for r in rows], "vp_ms": [r[p] * 1000.0 for r in rows], "vs_ms": [r[s] * 1000.0 for r in rows], "earth_radius_m": radius, "sha256": content}


def read_bias_model(spark: SparkSession, path: str) -> DataFrame:
    """(station, phase, ax, ay, az) of the groups whose bias is to be applied."""
    rows = spark.read.option("header", True).csv(path)
    return rows.filter(F.lower(F.trim("apply_bias")).isin("1", "true")).select(
        "station", F.when(F.upper("phase") == "P", "P").otherwise("S").alias("phase"), F.col("ax_s_per_m").cast("double").alias("ax"), F.col("ay_s_per_m").cast("double").alias("ay"), F.col("az_s_per_m").cast("double").alias("az")
    )

