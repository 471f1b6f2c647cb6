"""Exact nearest-neighbour joins by grid cells that widen only around points that need it.

A query looks at the 3^d cells around its own.  It is done when its k-th neighbour is no
farther than one cell's width, which those cells contain whole; the queries left go on
with cells twice as wide.  The first width is the one at which the fullest cell holds a
few dozen points, so dense clusters never meet as wholes, and sparse outskirts, few by
nature, take the wider rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeweave.sources.storage import drop, written

FULLEST = 64


def _cell(axes: list[str], width: float) -> list[Column]:
    return [F.floor(F.col(a) / width).cast("long").alias(f"c{k}") for k, a in enumerate(axes)]


def _distance(a: str, b: str, axes: list[str]) -> Column:
    return F.sqrt(reduce(lambda s, x: s + x, [(F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) * (F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) for x in axes]))


def _extent(points: DataFrame, axes: list[str]) -> float:
    row = points.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    return max([float(row[a] or 0.0) for a in axes] + [1e-9])


def cell_width(points: DataFrame, axes: list[str], fullest: int = FULLEST) -> float:
    """The widest halving of the extent at which no cell holds more than fullest points (coincident points aside)."""
    width = _extent(points, axes)
    for _ in range(40):
        most = points.groupBy(*_cell(axes, width)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= fullest:
            break
        width /= 2 if most < 8 * fullest else 4
    return width


def nearest(queries: DataFrame, points: DataFrame, k: int, axes: list[str], radius: float = float("inf"), same: bool = True) -> DataFrame:
    """(source, target, dist): the k nearest points of each query within radius, ties by target.

    Both sides have event_id and the axes; with same, a query does not find itself.
    """
    extent = max(_extent(points, axes), _extent(queries, axes), 1e-9)
    width = cell_width(points, axes)
    span = queries.select("event_id", *axes).unionByName(points.select("event_id", *axes))
    extent = max(extent, _extent(span, axes))
    rest, found = written(queries.select("event_id", *axes), "queries"), None
    offsets = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    order = Window.partitionBy("source").orderBy("dist", "target")
    cells = [f"c{j}" for j in range(len(axes))]
    while True:
        last = width > extent or width >= radius
        q = rest.select("event_id", *axes, *_cell(axes, width))
        for c in cells:
            q = q.withColumn("_o", F.explode(offsets)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
        p = points.select("event_id", *axes, *_cell(axes, width))
        pairs = q.alias("q").join(p.alias("p"), [F.col(f"q.{c}") == F.col(f"p.{c}") for c in cells])
        if same:
            pairs = pairs.filter("q.event_id <> p.event_id")
        pairs = pairs.select(F.col("q.event_id").alias("source"), F.col("p.event_id").alias("target"), _distance("q", "p", axes).alias("dist"))
        if radius != float("inf"):
            pairs = pairs.filter(F.col("dist") <= radius)
        top = written(pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k), "nearest")
        if last:
            good, done = top, None
        else:
            done = top.groupBy("source").agg(F.max("_r").alias("n"), F.max("dist").alias("far")).filter((F.col("n") == k) & (F.col("far") <= width)).select("source")
            good = top.join(done, "source", "left_semi")
        good = good.select("source", "target", "dist")
        found = good if found is None else found.unionByName(good)
        if done is None:
            return found
        new = written(rest.join(done.withColumnRenamed("source", "event_id"), "event_id", "left_anti"), "queries")
        drop(rest)
        rest = new
        if rest.isEmpty():
            return found
        width *= 2


def undirected(directed: DataFrame, mutual: bool = True) -> DataFrame:
    """(i, j, dist) with i < j: pairs found from both ends, or from either at the least distance."""
    ends = directed.select(F.least("source", "target").alias("i"), F.greatest("source", "target").alias("j"), "dist")
    pairs = ends.groupBy("i", "j").agg(F.min("dist").alias("dist"), F.count("*").alias("n"))
    return (pairs.filter("n = 2") if mutual else pairs).select("i", "j", "dist")
