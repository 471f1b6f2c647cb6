"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a keyed random order and their words, laid end
to end, cut into blocks of ``block`` words.  Slot t of the schedule takes the van der
Corput point of t and maps it through the cumulative shares of the sources' targets;
the r-th slot of a source takes its block r, starting over when the blocks are used
up, until the source's target is met (the last slot is trimmed to it).  Sources are
so interleaved evenly over any stretch of the schedule, and no block is used more
than ``repeats`` times.

Ranks and running sums are made in two steps, within a chunk and over the chunks
before it, so that a source with a third of all rows is not summed in one task.

A null text has no words; a null source is one source, last in order.  Rows without
words are kept with nothing taken.  Equal rows are separate rows of equal standing.
An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.llm._common import NULL_ID, keyed, table, unkeyed, written

WEIGHTS, SHARE, REPEATS, BLOCK = (5, 2, 1), 1.5, 2, 256
WORD = r"[^\x20\x09-\x0D]+"
#: Documents to a bucket of a source's order, slots to a chunk of the schedule, cells of it for each source.
BUCKET, CHUNK, CELLS = 2000, 16384, 16
BITS = 44


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> with weight and target: one row per source, filled up to its cap in order of cap per weight."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("_left", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("_full", F.col("_level") * F.col("weight") >= F.col("_cap"))
        .withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
        .withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def _key():
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key")


def ordered(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(did, uid, source, _key, size, at, row): at is where the document starts in its source's order; row tells equal rows apart."""
    rows = keyed(docs, "source").select("did", "uid", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = written(rows, "sizes")
    buckets = rows.count() // BUCKET + 1
    rows = rows.withColumns({"_key": _key(), "_h": F.xxhash64("did", "uid", F.lit(seed))}).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = rows.groupBy("_key", "_b").agg(F.sum("size").alias("_s"))
    w = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_key", "_b").orderBy("_h", "did", "uid")
    rows = rows.withColumns({"_in": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.row_number().over(within)})
    return rows.join(sums, ["_key", "_b"]).select("did", "uid", "source", "_key", "size", (F.col("_before") + F.col("_in")).alias("at"), F.struct("_b", "_n").alias("row"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, _key, pass, block, start, length): which words of its source's order each slot takes."""
    spark = sources.sparkSession
    quota, size = F.floor("target").cast("long"), F.col("source_size")
    sources = sources.filter(quota > 0).select(_key(), size, quota.alias("quota"), F.ceil(size / block).cast("long").alias("blocks"))
    sources = sources.withColumn("need", F.expr(f"quota div source_size * blocks + cast(ceil((quota % source_size) / {block}.0D) as long)"))
    every = Window.partitionBy(F.lit(0))
    running = every.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.withColumns({"_hi": F.sum("need").over(running), "_all": F.sum("need").over(every)}).withColumn("_lo", F.col("_hi") - F.col("need"))
    total, least, kinds = sources.agg(F.sum("need"), F.min("need"), F.count("*")).first()
    total, least = total or 0, least or 1
    # so many more slots that every source's share of the points reaches its need (the points' discrepancy is at most log2(n)/3+1)
    slots = total + math.ceil(2 * (math.log2(total + 2) / 3 + 2) * total / least)
    cells = CELLS * kinds + 1
    cell = lambda x: F.floor(F.col(x) * cells / F.col("_all"))
    spans = sources.withColumn("_cell", F.explode(F.sequence(F.greatest(cell("_lo") - 1, F.lit(0)), F.least(cell("_hi") + 1, F.lit(cells)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * cells))
    hits = points.join(spans, "_cell").filter((F.col("_u") * F.col("_all") >= F.col("_lo")) & (F.col("_u") * F.col("_all") < F.col("_hi")))
    hits = hits.select("slot", F.floor(F.col("slot") / CHUNK).alias("_c"), "_key", "need", "quota", "blocks", "source_size")
    counts = hits.groupBy("_key", "_c").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_key").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_key", "_c", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    ranked = hits.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_c").orderBy("slot"))).join(counts, ["_key", "_c"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_n") - 1).filter(F.col("_rank") < F.col("need"))
    ranked = ranked.withColumns({"pass": F.expr("_rank div blocks"), "block": F.col("_rank") % F.col("blocks")}).withColumn("start", F.col("block") * block)
    left = F.col("quota") - F.col("pass") * F.col("source_size") - F.col("start")
    return ranked.select("slot", "_key", "pass", "block", "start", F.least(F.lit(block), F.col("source_size") - F.col("start"), left).alias("length"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per document and slot that takes words of it, and one without slot for a document of which none are taken.

    did, uid, row, source, size, source_size, target, slot, pass, from_word, n_words.
    """
    rows = written(ordered(docs, seed), "ordered")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sources, weights, share, repeats), "targets")
    slots = schedule(sources, block)
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    cut = cut.join(slots, ["_key", "block"], "left")
    lo, hi = F.greatest("at", "start"), F.least(F.col("at") + F.col("size"), F.col("start") + F.col("length"))
    taken = F.when(F.col("slot").isNotNull(), F.greatest(hi - lo, F.lit(0))).otherwise(F.lit(0)).alias("n_words")  # greatest() passes over nulls
    return cut.select("did", "uid", "row", "_key", "source", "size", F.when(taken > 0, F.col("slot")).alias("slot"), F.col("pass"), (lo - F.col("at")).alias("from_word"), taken).join(
        sources.select(_key(), "source_size", "target"), "_key", "left"
    )


def taken(mixed: DataFrame) -> DataFrame:
    """Rows of mix() by document: doc_id, size, source_size, target, taken."""
    by = mixed.groupBy("_key", "row", "did").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("n_words").alias("taken"), F.max("source").alias("source"))
    return by.select(unkeyed(), "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix holds them: a row for each pass that takes words of one, its text cut after the last word taken."""
    passes = mix(docs, **options).filter("n_words > 0").groupBy("_key", "row", "did", "uid", "pass").agg(F.sum("n_words").alias("_taken"), F.max("size").alias("_size"))
    # equal rows of a source share (did, uid): the n-th of them takes the n-th lot
    nth = Window.partitionBy("_key", "did", "uid", "pass").orderBy(F.col("_taken").desc())
    passes = passes.withColumn("_nth", F.row_number().over(nth)).select("_key", F.col("did").alias("_did"), F.col("uid").alias("_uid"), "_nth", "_taken", "_size")
    ids = docs.withColumns({"_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_uid": F.xxhash64("doc_id", "text"), "_key": _key()})
    ids = ids.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_did", "_uid").orderBy(*[F.col(c) for c in docs.columns])))
    out = ids.join(passes, ["_key", "_did", "_uid", "_nth"])
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_taken") < F.col("_size"), F.array_join(F.slice(pieces, 1, F.greatest(F.col("_taken").cast("int"), F.lit(1))), "")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents")))


QUERIES = {"op3_mix": op3_mix}
SQL: dict[str, str] = {}
