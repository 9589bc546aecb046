from datetime import datetime, timedelta

from tesserae.streaming import monitors


def written(spark, tmp_path, values):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=6 * i), 1, "ab"[i % 2], v, "{}") for i, v in enumerate(values)]
    for k in range(3):
        spark.createDataFrame(rows[k::3] if k == 0 else rows[k::3], monitors.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return rows


def test_accumulators_and_worklist(spark, tmp_path):
    rows = written(spark, tmp_path, [float(i) for i in range(30)])
    stream = monitors.events_stream(spark, f"{tmp_path}/events", 10)
    q = monitors.monthly(stream).writeStream.outputMode("complete").format("memory").queryName("monthly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r.total) for r in spark.table("monthly").collect()] == [(30, sum(r[4] for r in rows))]
    seen = []
    q = monitors.poll(monitors.events_stream(spark, f"{tmp_path}/events"), lambda df, k: seen.append(df.count()), f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert sum(seen) == 30 and len(seen) == 3
    q = monitors.accumulators(stream).writeStream.outputMode("append").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    final = spark.table("daily").collect()
    assert final and all(r.n == 2 for r in final)


def test_lasting_runs(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i), 1, "a", v, "{}") for i, v in enumerate([1.0, 5.0, 6.0, 7.0, 8.0, 0.0, 9.0, 9.0, 0.0])]
    spark.createDataFrame(rows, monitors.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/e")
    q = monitors.lasting_runs(monitors.events_stream(spark, f"{tmp_path}/e"), 4.0, 3).writeStream.outputMode("append").format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("runs").collect()
    assert [r.event_type for r in got] == ["a"] and datetime(1970, 1, 1) + timedelta(microseconds=got[0].since) == start + timedelta(hours=1)
