"""Comparison of a relocated catalog with a truth: accuracy, neighbour precision, Chamfer distance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeweave.functions.geo import MEAN_RADIUS_KM, WGS84_A_M, WGS84_E2, ecef, enu_km, vincenty_km, wgs84_distance_km
from quakeweave.operators.knn import nearest
from quakeweave.sources.storage import written

NEAR_KM = 2.0
#: Events in a block, rows of a meeting worked on at a time, the longest chord from which a distance is taken, and how near the limit Vincenty's form decides.
BLOCK, STRIP, SHORT_KM, SLACK_KM = 1024, 32, 3.0, 1e-6
PLACES = ["lat", "lon", "depth_km", "tlat", "tlon", "tdepth"]
BLOCKS = ["block", *[f"lo{k}" for k in range(4)], *[f"hi{k}" for k in range(4)], "ids", "places"]


def matched(catalog: DataFrame, truth: DataFrame) -> DataFrame:
    """(event_id, lat, lon, depth_km, tlat, tlon, tdepth)."""
    t = truth.select("event_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), F.col("depth_km").alias("tdepth"))
    return catalog.select("event_id", "lat", "lon", "depth_km").join(t, "event_id")


def accuracy(both: DataFrame) -> DataFrame:
    """(event_id, horizontal_km, depth_km): errors of each event."""
    return both.select("event_id", wgs84_distance_km(F.col("tlat"), F.col("tlon"), F.col("lat"), F.col("lon")).alias("horizontal_km"), F.abs(F.col("depth_km") - F.col("tdepth")).alias("depth_km"))


def _surface(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Earth-centred kilometres of points on the ellipsoid, a row per axis."""
    phi, lam = np.radians(lat), np.radians(lon)
    prime = WGS84_A_M / np.sqrt(1.0 - WGS84_E2 * np.sin(phi) ** 2) / 1000.0
    return np.stack([prime * np.cos(phi) * np.cos(lam), prime * np.cos(phi) * np.sin(lam), prime * (1.0 - WGS84_E2) * np.sin(phi)])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between the columns of a and b."""
    return np.sqrt(sum((x[:, None] - y[None, :]) ** 2 for x, y in zip(a, b, strict=True)))


def _along(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, chord: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distances on the ellipsoid: by chords of up to SHORT_KM, and by Vincenty's form for longer ones, where of is true.

    Below SHORT_KM both agree to 1e-8 km, by which Vincenty's ends its rounds.
    """
    out = chord + chord * chord * chord * (1.0 / (24.0 * MEAN_RADIUS_KM**2))
    i, j = np.nonzero(of & (chord > SHORT_KM))
    out[i, j] = vincenty_km(at_a[0, i], at_a[1, i], at_b[0, j], at_b[1, j])
    return out


def _misfits(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool, near_km: float) -> list[tuple[np.ndarray, ...]]:
    """(event_id, sums of squared horizontal and depth misfits, neighbours) of either block's events; rows of a and b are PLACES."""
    (ta, tb), (oa, ob) = ([_surface(x[k], x[k + 1]) for x in (a, b)] for k in (3, 0))
    sums_a, sums_b = np.zeros((3, len(ids_a))), np.zeros((3, len(ids_b)))
    for k in range(0, len(ids_a), STRIP):
        s = slice(k, k + STRIP)
        true_v = np.abs(a[5, s, None] - b[5, None])
        chord = _apart(ta[:, s], tb)
        near = (true_v < near_km) & (chord < near_km + SLACK_KM) & (ids_a[s, None] != ids_b[None])
        if same:
            near &= np.arange(k, k + len(chord))[:, None] < np.arange(len(ids_b))[None]
        true_h = _along(ta[:, s], tb, a[3:5, s], b[3:5], chord, near)
        i, j = np.nonzero(near & (true_h > near_km - SLACK_KM))
        near[i, j] = vincenty_km(a[3, s][i], a[4, s][i], b[3, j], b[4, j]) < near_km
        h = _along(oa[:, s], ob, a[0:2, s], b[0:2], _apart(oa[:, s], ob), near) - true_h
        v = np.abs(a[2, s, None] - b[2, None]) - true_v
        for row, x in enumerate((np.where(near, h * h, 0.0), np.where(near, v * v, 0.0), near)):
            sums_a[row, s] += x.sum(axis=1)
            sums_b[row] += x.sum(axis=0)
    return [(ids, *sums) for ids, sums in ((ids_a, sums_a), (ids_b, sums_b))]


def _blocks(both: DataFrame, near_km: float) -> DataFrame:
    """(block, lo0.., hi0.., ids, places): events of near places in truth, BLOCK in a row, with the box that bounds them."""
    x, y, z = ecef(F.col("tlat"), F.col("tlon"), F.lit(0.0))
    axes = [x / 1000.0, y / 1000.0, z / 1000.0, F.col("tdepth")]
    p = both.select(F.col("event_id").cast("long").alias("event_id"), *[F.col(c).cast("double").alias(c) for c in PLACES]).dropna()
    p = p.withColumns({f"c{k}": F.floor(a / (near_km / 4.0)).cast("long") for k, a in enumerate(axes)})
    order = ["c0", "c1", "c2", "c3", "event_id"]

    def run(batches):
        n, rest = 0, None

        def rows(t, last):
            nonlocal n
            for k in range(0, len(t) if last else len(t) // BLOCK * BLOCK, BLOCK):
                ids, v = t.column("event_id").to_numpy()[k : k + BLOCK], np.stack([t.column(c).to_numpy()[k : k + BLOCK] for c in PLACES])
                box = np.vstack([_surface(v[3], v[4]), v[5:6]])
                ends = [pa.array([e]) for e in (*box.min(axis=1), *box.max(axis=1))]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | n]), *ends, pa.array([ids.tobytes()]), pa.array([v.tobytes()])], names=BLOCKS)
                n += 1

        for batch in batches:
            t = pa.table([batch.column(c) for c in ("event_id", *PLACES)], names=["event_id", *PLACES])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            yield from rows(t, False)
            rest = t.slice(len(t) // BLOCK * BLOCK)
        if rest is not None:
            yield from rows(rest, True)

    n = both.count()
    p = p.repartitionByRange(max(1, -(-n // (16 * BLOCK))), *order).sortWithinPartitions(*order).select("event_id", *PLACES)
    return p.mapInArrow(run, ", ".join([f"{BLOCKS[0]} long", *[f"{c} double" for c in BLOCKS[1:9]], f"{BLOCKS[9]} binary", f"{BLOCKS[10]} binary"]))


def precision(both: DataFrame, near_km: float = NEAR_KM) -> DataFrame:
    """(event_id, horizontal_km, depth_km, neighbours): root mean square misfit of each event's separations.

    Neighbours are events whose true separations are both below near_km.  Their number may go with the square of the
    events', so no row is made of a pair: blocks of events meet where their boxes are within near_km, and each
    meeting gives sums by event.
    """
    blocks = written(_blocks(both, near_km), "blocks")
    boxes, number, reach = blocks.select(*BLOCKS[:9]), blocks.count(), near_km + SLACK_KM
    within = [F.col("a.block") <= F.col("b.block")]
    within += [(F.col(f"a.lo{k}") <= F.col(f"b.hi{k}") + reach) & (F.col(f"b.lo{k}") <= F.col(f"a.hi{k}") + reach) for k in range(4)]
    swap = (F.col("a.block") + F.col("b.block")) % 2 == 1
    met = boxes.alias("a").join(boxes.alias("b"), reduce(lambda x, y: x & y, within))
    met = met.select(F.when(swap, F.col("b.block")).otherwise(F.col("a.block")).alias("a"), F.when(swap, F.col("a.block")).otherwise(F.col("b.block")).alias("b"))
    side = lambda s: blocks.select(F.col("block").alias(s), F.col("ids").alias(f"ids_{s}"), F.col("places").alias(f"places_{s}"))
    tiles = met.join(side("a"), "a").repartition(min(max(1, number), 2000), "b").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                ids = [np.frombuffer(t[f"ids_{s}"], np.int64) for s in "ab"]
                places = [np.frombuffer(t[f"places_{s}"]).reshape(len(PLACES), -1) for s in "ab"]
                for e, h, v, n in _misfits(*places, *ids, t["a"] == t["b"], near_km):
                    yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(h), pa.array(v), pa.array(n.astype(np.int64))], names=["event_id", "h", "v", "n"]).filter(pa.array(n > 0))

    sums = tiles.mapInArrow(run, "event_id long, h double, v double, n long").groupBy("event_id").agg(F.sum("h").alias("h"), F.sum("v").alias("v"), F.sum("n").alias("n"))
    return sums.select(F.col("event_id").cast(both.schema["event_id"].dataType).alias("event_id"), F.sqrt(F.col("h") / F.col("n")).alias("horizontal_km"), F.sqrt(F.col("v") / F.col("n")).alias("depth_km"), F.col("n").alias("neighbours"))


def chamfer(a: DataFrame, b: DataFrame) -> float:
    """Half the sum of the mean nearest distances of (event_id, x, y, z) both ways."""
    mean = lambda p, q: nearest(p, q, 1, ["x", "y", "z"], same=False).agg(F.avg("dist")).first()[0]
    return 0.5 * (mean(a, b) + mean(b, a))


def _enu(both: DataFrame, lat: str, lon: str, depth: str) -> DataFrame:
    e, n, d = enu_km(F.col(lat), F.col(lon), F.col(depth))
    return both.select("event_id", e.alias("x"), n.alias("y"), d.alias("z"))


def event_errors(catalog: DataFrame, truth: DataFrame) -> DataFrame:
    """EventID and its four errors and number of true neighbours."""
    return _errors(written(matched(catalog, truth), "matched"))


def _errors(both: DataFrame) -> DataFrame:
    a, p = accuracy(both), precision(both)
    return a.toDF("event_id", "ah", "ad").join(p, "event_id").select(
        F.col("event_id").alias("EventID"), F.col("ah").alias("horizontal_accuracy_error_km"), F.col("ad").alias("depth_accuracy_error_km"),
        F.col("horizontal_km").alias("horizontal_precision_error_km"), F.col("depth_km").alias("depth_precision_error_km"), F.col("neighbours").alias("truth_neighbor_count"),
    )


def compare_catalogs(catalog: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of metrics; an event without a true neighbour is an error, as is one absent from the truth."""
    both = written(matched(catalog, truth), "matched")
    if both.count() != catalog.count():
        raise ValueError("catalog ids must be rows of the truth, each once")
    errors = written(_errors(both), "errors")
    if errors.count() != both.count():
        raise ValueError("an event has no true neighbour within the limits")
    apart = chamfer(_enu(both, "lat", "lon", "depth_km"), _enu(both, "tlat", "tlon", "tdepth"))
    h, d = "horizontal_accuracy_error_km", "depth_accuracy_error_km"
    return errors.agg(
        F.count("*").alias("events"), (F.sum("truth_neighbor_count") / 2).cast("long").alias("neighboring_pairs"), F.avg(h).alias("mean_horizontal_accuracy_km"), F.avg(d).alias("mean_depth_accuracy_km"),
        F.percentile(h, 0.5).alias("median_horizontal_accuracy_km"), F.percentile(d, 0.5).alias("median_depth_accuracy_km"), F.lit(apart).alias("chamfer_distance_km"),
        F.avg("horizontal_precision_error_km").alias("mean_horizontal_precision_km"), F.avg("depth_precision_error_km").alias("mean_depth_precision_km"),
    )
