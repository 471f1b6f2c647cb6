"""The event graph: candidates, degree-capped selection, bridges, augmentation, components.

Edges are (i, j, dist, is_augmented) with i < j; nodes (event_id, degree, comp_id, comp_size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeweave.operators.components import components
from quakeweave.operators.knn import nearest, undirected
from quakeweave.sources.storage import written


def metric_points(state: DataFrame, metric: str = "xyz_scaled", depth_scale: float = 0.5) -> tuple[DataFrame, list[str]]:
    """(event_id, axes) of the metric: xy, xyz or xyz_scaled."""
    z = F.col("z") * (depth_scale if metric == "xyz_scaled" else 1.0)
    axes = ["mx", "my"] if metric == "xy" else ["mx", "my", "mz"]
    return state.select("event_id", F.col("x").alias("mx"), F.col("y").alias("my"), z.alias("mz")).select("event_id", *axes), axes


def greedy_capped(edges: DataFrame, cap: int, key: list[Column], limit: int | None = None) -> DataFrame:
    """Edges that one pass in the order of key would take while both ends are below cap, found in rounds.

    In a round an edge whose rank among its undecided fellows is within what is left of the cap at both ends is
    taken, whatever the edges before it do; edges at a full end are out.  The first undecided edge is always taken.
    """
    rest, taken = written(edges, "edges"), edges.limit(0)
    while not rest.isEmpty():
        used = taken.select(F.explode(F.array("i", "j")).alias("v")).groupBy("v").agg(F.count("*").alias("used"))
        left = lambda end: F.lit(cap) - F.coalesce(F.col(f"used_{end}"), F.lit(0))  # noqa: E731, B023
        rows = rest
        for end in ("i", "j"):
            rows = rows.join(used.toDF(end, f"used_{end}"), end, "left")
        rows = rows.filter((left("i") > 0) & (left("j") > 0))
        both = rows.withColumn("v", F.explode(F.array("i", "j"))).withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy(*key)))
        ranks = both.groupBy("i", "j").agg(F.max(F.when(F.col("v") == F.col("i"), F.col("_r"))).alias("ri"), F.max(F.when(F.col("v") == F.col("j"), F.col("_r"))).alias("rj"))
        rows = written(rows.join(ranks, ["i", "j"]).withColumn("_take", (F.col("ri") <= left("i")) & (F.col("rj") <= left("j"))), "edges")
        taken = written(taken.unionByName(rows.filter("_take").select(*edges.columns)), "taken")
        rest = rows.filter("not _take").select(*edges.columns)
    if limit is not None:
        taken = taken.orderBy(*key).limit(limit)
    return taken


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, comp_id, comp_size), lone nodes included; comp_id numbers components by their first catalog row.

    nodes has event_id and row_idx.
    """
    rows = nodes.select(F.col("event_id").alias("v"), "row_idx")
    e = edges.select("i", "j").join(rows.toDF("i", "u"), "i").join(rows.toDF("j", "v"), "j").select("u", "v")
    found = components(e).withColumnRenamed("node", "row_idx")
    out = nodes.select("event_id", "row_idx").join(found, "row_idx", "left").withColumn("first", F.coalesce("component", "row_idx"))
    sizes = out.groupBy("first").agg(F.count("*").alias("comp_size"))
    sizes = sizes.withColumn("comp_id", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("first")))  # a row per component
    return out.join(sizes, "first").select("event_id", "comp_id", "comp_size")


def bridges(candidates: DataFrame, selected: DataFrame, nodes: DataFrame, longest: float = 0.0) -> DataFrame:
    """The candidates that Kruskal's algorithm, started from selected, would add: Borůvka rounds by (dist, i, j), which is the same forest."""
    pool = candidates.filter(F.col("dist") <= longest) if longest > 0 else candidates
    pool = pool.select("i", "j", "dist").join(selected.select("i", "j"), ["i", "j"], "left_anti")
    added = pool.limit(0)
    while True:
        label = written(graph_components(nodes, selected.select("i", "j").union(added.select("i", "j"))).select("event_id", "comp_id"), "labels")
        cross = pool.join(label.toDF("i", "ci"), "i").join(label.toDF("j", "cj"), "j").filter("ci <> cj")
        both = cross.withColumn("c", F.explode(F.array("ci", "cj")))
        best = written(both.groupBy("c").agg(F.min(F.struct("dist", "i", "j")).alias("e")).select("e.i", "e.j", "e.dist").distinct(), "bridges")
        if best.isEmpty():
            return added
        added = written(added.unionByName(best), "bridges")


def fiedler(nodes: DataFrame, edges: DataFrame, rounds: int = 30, seed: int = 0) -> DataFrame:
    """(event_id, f): projected power iteration on the Laplacian, zero mean by component, unit norm; a hashed start.

    nodes has event_id, comp_id and degree.
    """
    top = nodes.agg(F.max("degree")).first()[0] or 0
    step = 0.9 / max(2.0, 2.0 * top)
    x = nodes.select("event_id", "comp_id", (F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(2_000_003)) / 1_000_001.5 - 1.0).alias("f"))

    def projected(v: DataFrame) -> DataFrame:
        v = v.withColumn("f", F.col("f") - F.avg("f").over(Window.partitionBy("comp_id")))
        norm = v.agg(F.sqrt(F.sum(F.col("f") * F.col("f")))).first()[0] or 0.0
        return v.withColumn("f", F.col("f") / norm) if norm > 0 else v

    both = edges.select("i", "j").union(edges.select(F.col("j"), F.col("i")))
    x = written(projected(x), "fiedler")
    for _ in range(rounds):
        neighbour = x.select(F.col("event_id").alias("j"), F.col("f").alias("g"))
        pull = both.join(neighbour, "j").groupBy("i").agg(F.sum("g").alias("s"), F.count("*").alias("n")).withColumnRenamed("i", "event_id")
        moved = x.join(pull, "event_id", "left").withColumn("f", F.col("f") - step * (F.coalesce("n", F.lit(0)) * F.col("f") - F.coalesce("s", F.lit(0.0))))
        x = written(projected(written(moved.select("event_id", "comp_id", "f"), "fiedler")), "fiedler")
    return x.select("event_id", "f")


def augmentation(broad: DataFrame, selected: DataFrame, nodes: DataFrame, target: int, cap: int = 3, rounds: int = 30) -> DataFrame:
    """Edges to add: between components by nearness, else by spectral distance over length; greedy below cap, the first target of them."""
    f = fiedler(nodes, selected, rounds)
    of = nodes.select("event_id", "comp_id").join(f, "event_id")
    pool = broad.join(selected.select("i", "j"), ["i", "j"], "left_anti")
    pool = pool.join(of.toDF("i", "ci", "fi"), "i").join(of.toDF("j", "cj", "fj"), "j")
    apart = F.pow(F.col("fi") - F.col("fj"), 2) / (1.0 + F.col("dist"))
    score = F.when(F.col("ci") != F.col("cj"), 1e12 / F.greatest(F.col("dist"), F.lit(1.0))).otherwise(apart)
    pool = pool.select("i", "j", "dist", score.alias("score"))
    return greedy_capped(pool, cap, [F.col("score").desc(), F.col("i"), F.col("j")], target).select("i", "j", "dist")


def build_event_graph(state: DataFrame, catalog: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a state (event_id, x, y, z) under the graph section of a configuration."""
    axes_points, axes = metric_points(state, str(config["metric"]).lower(), float(config["depth_scale"]))
    axes_points = written(axes_points, "points")
    n = axes_points.count()
    rows = catalog.select("event_id", "row_idx")
    if n <= 1:
        lone = rows.select("event_id", F.lit(0).cast("long").alias("degree"), F.col("row_idx").alias("comp_id"), F.lit(1).cast("long").alias("comp_size"))
        return state.select(F.col("event_id").alias("i"), F.col("event_id").alias("j"), F.lit(0.0).alias("dist"), F.lit(False).alias("is_augmented")).limit(0), lone
    k = min(int(config["neighbors"]), n - 1)
    radius = 1000.0 * float(config["maximum_distance_km"]) if float(config["maximum_distance_km"]) > 0 else float("inf")
    mutual, cap = bool(config["mutual"]), int(config["maximum_degree"])
    candidates = written(undirected(nearest(axes_points, axes_points, k, axes, radius), mutual), "candidates")
    if candidates.isEmpty():
        raise ValueError("the event graph has no edges; relax graph.mutual or graph.maximum_distance_km")
    # mutual neighbours are k at most, so a cap of k or more cannot bind; minimum_degree adds nothing, as what is not taken met a full end
    selected = candidates if cap <= 0 or (mutual and cap >= k) else greedy_capped(candidates, cap, [F.col("dist"), F.col("i"), F.col("j")])
    if config["ensure_connected"]:
        selected = written(selected.unionByName(bridges(candidates, selected, rows, 1000.0 * float(config["maximum_bridge_distance_km"]))), "connected")
    selected = selected.withColumn("is_augmented", F.lit(False))
    extra = config["augmentation"]
    if extra["enabled"]:
        ends = _degrees(rows, selected)
        base = ends.join(graph_components(rows, selected), "event_id")
        broad = undirected(nearest(axes_points, axes_points, min(int(extra["candidate_neighbors"]), n - 1), axes, radius), mutual)
        target = int(extra["add_edges"]) or -int(-0.5 * n * float(extra["add_edges_per_event"]) // 1)
        more = augmentation(broad, selected, base, target, int(extra["maximum_added_per_event"]), int(extra["power_iterations"]))
        selected = written(selected.unionByName(more.withColumn("is_augmented", F.lit(True))), "augmented")
    return selected, _degrees(rows, selected).join(graph_components(rows, selected), "event_id")


def _degrees(rows: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("i", "j")).alias("event_id")).groupBy("event_id").agg(F.count("*").alias("degree"))
    return rows.select("event_id").join(ends, "event_id", "left").select("event_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_distances(edges: DataFrame, state: DataFrame, metric: str = "xyz_scaled", depth_scale: float = 0.5) -> DataFrame:
    """(i, j, d_metric, d_xy, d_xyz)."""
    s = state.select("event_id", "x", "y", "z")
    p = edges.join(s.toDF("i", "xi", "yi", "zi"), "i").join(s.toDF("j", "xj", "yj", "zj"), "j")
    dx, dy, dz = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"), F.col("zi") - F.col("zj")
    xy = dx * dx + dy * dy
    scaled = {"xy": F.lit(0.0), "xyz": dz * dz}.get(metric, (depth_scale * dz) * (depth_scale * dz))
    return p.select("i", "j", F.sqrt(xy + scaled).alias("d_metric"), F.sqrt(xy).alias("d_xy"), F.sqrt(xy + dz * dz).alias("d_xyz"))


def graph_metadata(catalog: DataFrame, nodes: DataFrame, pre: DataFrame, dd: DataFrame) -> DataFrame:
    """One row per event: component, degrees, observation counts and whether either stage used it."""
    counts = lambda obs, name: obs.select(F.explode(F.array("i", "j")).alias("event_id")).groupBy("event_id").agg(F.count("*").alias(name))
    pairs = dd.select("i", "j").distinct()
    out = catalog.select("event_id").join(nodes, "event_id")
    for rows in (counts(pairs, "dd_pair_degree"), counts(pre, "prelocation_observations"), counts(dd, "dd_observations")):
        out = out.join(rows, "event_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        F.col("event_id").alias("EventID"), F.col("comp_id").alias("component_id"), F.col("comp_size").alias("component_size"), F.col("degree").alias("geometry_degree"), n("dd_pair_degree"), n("prelocation_observations"), n("dd_observations"),
        F.col("prelocation_observations").isNotNull().cast("int").alias("prelocation_used"), F.col("dd_observations").isNotNull().cast("int").alias("relocation_used"),
    )
