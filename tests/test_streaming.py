from quakeweave.streaming.theta import ENTRY, arriving, star_stream


def test_star_stream(spark, tmp_path):
    rows = [(1, "A", "P", e, t, 20, 0.01, 10, True, True) for e, t in ((30, 0.5), (10, 0.3), (20, 0.0))]
    entries = spark.createDataFrame(rows, ENTRY)
    entries.write.parquet(str(tmp_path / "in"))
    q = star_stream(arriving(spark, str(tmp_path / "in")), entries.filter("event_id = 20")).writeStream.format("memory").queryName("stars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["i"], r["j"], r["dt"]) for r in spark.sql("SELECT * FROM stars").collect()) == [(10, 20, 0.3), (30, 20, 0.5)]
