"""Document fingerprints from closed syncmers over words.

A k-mer of k words is chosen when the least hash among its s-word substrings stands
at its first or last place.  Whether it is chosen depends on its own words alone, so
the same words give the same anchors in any text, whatever surrounds them.  anchors()
lists them with their places; a document's fingerprint is the sketch of the ``SKETCH``
least distinct anchor hashes, and two fingerprints' likeness is the share of the least
hashes of both together that stand in both, an estimate of the anchors' Jaccard
similarity.  Only DataFrame functions are used.

A text of fewer than k words has its whole sequence as its one anchor; a null, empty
or blank text has none, and an empty fingerprint.  Two empty fingerprints are alike
(1.0).  Rows equal in doc_id and text are one document in the order of documents and
each get its result; null doc_ids come last.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.llm._common import keyed, let, parts, table, unkeyed, words, written

K, S, SKETCH = 5, 2, 64


def _anchors(w: Column, k: int = K, s: int = S) -> Column:
    """array<struct<at, h>> of the chosen k-mers of words w."""

    def chosen(h: Column) -> Column:
        inner = F.transform(F.slice(h, 1, F.greatest(F.size(h) - s + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))

        def closed(m: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                last = F.get(m, i + (k - s))
                least = F.least(x, last, *[F.get(m, i + j) for j in range(1, k - s)])
                return F.when((least == x) | (least == last), F.struct(i.alias("at"), F.hash(x, F.get(m, i + s), *[F.get(h, i + j) for j in range(2 * s, k)]).alias("h")))

            return F.filter(F.transform(F.slice(m, 1, F.greatest(F.size(h) - k + 1, F.lit(0))), one), lambda x: x.isNotNull())

        whole = F.array(F.struct(F.lit(0).alias("at"), F.hash(h).alias("h")))
        return F.when(F.size(h) >= k, let(inner, closed)).when(F.size(h) > 0, whole).otherwise(F.slice(whole, 1, 0))

    return let(F.transform(w, lambda x: F.xxhash64(x)), chosen)


def sketch(text: Column, k: int = K, s: int = S, size: int = SKETCH) -> Column:
    """array<int>: the least distinct anchor hashes of a text, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(_anchors(words(text), k, s), lambda x: x["h"]))), 1, size)


def shown(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.right(F.hex(x), F.lit(8)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, at (first word, from 0), h: every closed syncmer of every text."""
    return docs.select("doc_id", F.explode(_anchors(words(F.col("text").cast("string")), k, s)).alias("a")).select("doc_id", "a.at", "a.h")


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SKETCH) -> DataFrame:
    """doc_id, n_chars, fingerprint."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), shown(sketch(text, k, s, size)).alias("fingerprint"))


def _followed(rows: DataFrame) -> DataFrame:
    """(did, uid) distinct -> with ndid, nuid, the next in order, after the last the first."""
    spark = rows.sparkSession
    ranged = written(rows.select("did", "uid").repartitionByRange(parts(spark), "did", "uid").withColumn("pid", F.spark_partition_id()), "order")
    firsts = ranged.groupBy("pid").agg(F.min(F.struct("did", "uid")).alias("first"))  # a row per partition
    everything = Window.partitionBy(F.lit(0))
    firsts = firsts.select("pid", F.coalesce(F.lead("first").over(everything.orderBy("pid")), F.min("first").over(everything)).alias("after"))
    inside = F.lead(F.struct("did", "uid")).over(Window.partitionBy("pid").orderBy("did", "uid"))
    out = ranged.withColumn("next", inside).join(firsts, "pid").withColumn("next", F.coalesce("next", "after"))
    return out.select("did", "uid", F.col("next.did").alias("ndid"), F.col("next.uid").alias("nuid"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = keyed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    all_rows = written(texts.select("did", "uid", F.length("text").alias("n"), sketch(F.col("text")).alias("fp")), "sketches")
    rows = all_rows.dropDuplicates(["did", "uid"])
    repeated = all_rows.count() > rows.count()
    order = written(_followed(rows).join(rows.select("did", "uid", "n"), ["did", "uid"]), "next")
    to_give = order.select(F.col("ndid").alias("did"), F.col("nuid").alias("uid"), F.col("did").alias("pdid"), F.col("uid").alias("puid"), F.expr("n div 2").cast("int").alias("take"))
    giving = to_give.join(rows.select("did", "uid", "fp"), ["did", "uid"]).join(texts, ["did", "uid"])
    given = giving.select(F.col("pdid").alias("did"), F.col("puid").alias("uid"), "take", F.expr("left(text, take)").alias("tail"), F.col("fp").alias("nfp"))
    if repeated:
        given = given.dropDuplicates(["did", "uid"])
    out = texts.join(given, ["did", "uid"]).join(rows.select("did", "uid", "n", "fp"), ["did", "uid"])
    out = out.withColumn("edited", F.concat(F.expr("left(text, n - take)"), F.col("tail")))
    out = out.select("did", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "nfp", sketch(F.col("edited")).alias("efp"))
    return out.select(
        unkeyed(), "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))


QUERIES = {"op7_syncmers": op7_syncmers}
SQL: dict[str, str] = {}
