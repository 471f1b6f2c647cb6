"""Helpers shared by the training-data operators.

Row identity: an input row is known by ``(did, uid)``, its doc_id (null: the
largest long) and a 64-bit hash of doc_id and text, so that two rows that share a
doc_id stay apart and extra columns never clash with the operators' own names.
Rows equal in doc_id and text are one document to every operator that compares
documents, and each such row gets that document's result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.sources.storage import drop, shared_folder, written  # noqa: F401

#: What separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(did, uid, text, *more): the columns that operators work on."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64("doc_id", "text").alias("uid"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c) for c in more],
    )


def unkeyed(did: str = "did") -> Column:
    return F.when(F.col(did) != F.lit(NULL_ID), F.col(did)).alias("doc_id")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row, lambdas included."""
    return F.transform(F.array(value), body)[0]


#: Bits of the bitmap by which chosen() leaves rows out.
BITMAP = 1 << 23


def chosen(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts (did, uid, text) whose (did, uid) is in wanted, with wanted's other columns.

    Before the join rows go that a bitmap of the wanted rows' hashes rules out.  Its size is fixed, so it may be
    sent to all tasks; of few wanted rows it lets hardly any other pass, and however many they are the join is exact.
    """
    bit = F.pmod(F.xxhash64("did", "uid"), F.lit(BITMAP))
    marks = wanted.select(bit.alias("b")).select(F.floor(F.col("b") / 64).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[marks["w"].to_numpy(np.int64)] = marks["m"].to_numpy(np.int64)

    def run(batches):
        for batch in batches:
            b = batch.column("_b").to_numpy()
            yield batch.select(["did", "uid", "text"]).filter(pa.array((bitmap[b // 64] >> (b % 64)) & 1 == 1))

    return texts.select("did", "uid", "text", bit.alias("_b")).mapInArrow(run, "did long, uid long, text string").join(wanted, ["did", "uid"])
