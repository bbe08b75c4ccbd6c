import datetime

from pyspark.sql import functions as F

from lodeframe.streaming.windows import read_stream, run_once, windowed


def _at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def test_stream_equals_batch_up_to_the_watermark(spark, tmp_path):
    rows = [(i, _at(i), "ab"[i % 2], float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, kind string, value double")
    for k in range(3):
        df.where((F.col("id") >= 40 * k) & (F.col("id") < 40 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    aggregates = [F.count("*").alias("n"), F.sum("value").alias("v")]
    stream = windowed(read_stream(spark, str(tmp_path / "in"), df.schema, 1), "ts", "10 minutes", ["kind"], aggregates, late="5 minutes")
    run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in windowed(df, "ts", "10 minutes", ["kind"], aggregates).collect()}
    assert got <= want and len(got) >= len(want) - 4


def test_sessions(spark):
    df = spark.createDataFrame([(_at(m), "u") for m in (0, 1, 2, 30, 31)], "ts timestamp, user string")
    got = sorted(r.n for r in windowed(df, "ts", "5 minutes", ["user"], [F.count("*").alias("n")], session=True).collect())
    assert got == [2, 3]
