import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quakeweave.llm import registry


def test_stages_over_odd_documents(spark, docs, tmp_path):
    df = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars")
    columns = df.columns
    kept = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, "")
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == columns
        if name == "near_duplicates":
            kept = df.count()
            assert df.select("doc_id").distinct().count() <= kept
    assert df.count() >= kept > 0 and {"doc_id", "sequence_id", "offset"} <= set(df.columns)


def test_stages_over_nothing(spark, empty):
    df = empty.select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        assert df.count() == 0


def test_every_operator_is_registered():
    queries, sql = registry.collected()
    assert sorted(int(q[2:].split("_")[0]) for q in queries) == list(range(1, 11))
    assert set(sql) <= set(queries)


@pytest.mark.parametrize("stages", [["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "pack"]])
def test_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == stages
