import datetime

from splitbench.streaming import ingest

SCHEMA = "sequence_id string, sequence string, release_date date, arrived timestamp"


def test_each_content_is_ingested_once(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = lambda *ids: [(i, s, d, day) for i, s, d in ids]
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    old, new = datetime.date(2019, 1, 1), datetime.date(2023, 1, 1)
    spark.createDataFrame(rows(("a", "ACGTT", old), ("b", "AACGT", new), ("c", "GGGTT", new)), SCHEMA).write.parquet(src)
    ingest.ingest(spark, src, SCHEMA, out, check, "2020-01-01").awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 2 and {r.partition for r in first.where("sequence_id = 'c'").collect()} == {"test"}
    spark.createDataFrame(rows(("d", "ACGTT", old), ("e", "TTTTA", None)), SCHEMA).write.mode("append").parquet(src)
    ingest.ingest(spark, src, SCHEMA, out, check, "2020-01-01").awaitTermination()
    assert {r.sequence_id: r.partition for r in spark.read.parquet(out).collect()}.get("e") == "excluded" and spark.read.parquet(out).count() == 3
