import os
from datetime import datetime

from pyspark.sql import functions as F

from quillstone.streaming import feeds

SCHEMA = "event_id bigint, user_id bigint, event_type string, ts timestamp"


def at(h, m=0, d=1):
    return datetime(2024, 1, d, h, m)


def batches(spark, tmp_path, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").iterdir():  # the order in which the files arrive
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(df, tmp_path, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_windows_drop_late_rows(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    a = [(1, 1, "x", at(1)), (2, 1, "x", at(2))]
    b = [(3, 2, "x", at(12, d=3))]
    more = [(6, 2, "x", at(13, d=3))]  # the watermark that a batch leaves counts from the batch after the next
    late = [(4, 9, "x", at(3))]
    last = [(5, 9, "x", at(12, d=6))]
    got = run(feeds.windowed_counts(batches(spark, tmp_path, a, b, more, late, last), "ts", "event_type"), tmp_path, "append", "w")
    assert {(r[1], r[2], r[3]) for r in got} == {("x", 2, 1)}


def test_new_ids_once(spark, tmp_path):
    rows = [(1, 1, "x", at(1)), (1, 1, "x", at(1, 5)), (2, 1, "x", at(1))]
    got = run(feeds.new_ids(batches(spark, tmp_path, rows, rows), "event_id", "ts"), tmp_path, "append", "ids")
    assert sorted(r[0] for r in got) == [1, 2]


def test_sessions(spark, tmp_path):
    rows = [(1, 1, "x", at(1)), (2, 1, "x", at(1, 20)), (3, 1, "x", at(3)), (4, 2, "x", at(20))]
    got = run(feeds.session_counts(batches(spark, tmp_path, rows, [(5, 3, "x", at(20, d=3))]), "ts", "user_id"), tmp_path, "append", "s")
    assert sorted((r[2], r[3]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_upsert_keeps_the_latest(spark, tmp_path):
    keep = feeds.upsert(str(tmp_path / "u"), ["user_id"], ["ts", "event_id"])
    one = spark.createDataFrame([(1, 1, "a", at(1)), (2, 2, "b", at(1))], SCHEMA)
    two = spark.createDataFrame([(3, 1, "c", at(2)), (4, 2, "d", at(0))], SCHEMA)
    keep(one, 0), keep(two, 1), keep(two, 1)
    assert {(r.user_id, r.event_type) for r in spark.read.parquet(str(tmp_path / "u/1")).collect()} == {(1, "c"), (2, "b")}


def test_decisions_on_a_stream(spark, tmp_path):
    policy = spark.createDataFrame([("x", 0.5), ("y", None)], "event_type string, threshold double")
    s = batches(spark, tmp_path, [(1, 1, "x", at(1)), (2, 1, "y", at(1))]).withColumn("conf", F.lit(0.5))
    got = run(feeds.decide(s, policy, ["event_type"]).select("event_id", "answered"), tmp_path, "append", "d")
    assert sorted(got) == [(1, True), (2, False)]
