from framesieve.streaming.live import live_logs, live_sessions, live_statistics


def run(stream, name, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name)


def test_running_statistics(spark, tmp_path):
    schema = "frame int, x int, y int, v double"
    df = spark.createDataFrame([(f, x, 0, float(f + x)) for f in range(4) for x in range(2)], schema)
    df.write.parquet(str(tmp_path / "a"))
    rows = {r.x: r for r in run(live_statistics(spark.readStream.schema(schema).parquet(str(tmp_path / "a")), ["x", "y"]), "stats", "complete").collect()}
    assert rows[1].n == 4 and rows[1].mean == 2.5 and abs(rows[1].sigma - 1.2909944) < 1e-6


def test_sessions_and_logs(spark, tmp_path):
    df = spark.sql("SELECT 1 AS user, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) AS ts FROM VALUES (0), (60), (119), (500) AS t(m)")
    df.write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "b"))
    assert sorted(r.frames for r in run(live_sessions(stream, "user", "ts"), "sessions", "complete").collect()) == [1, 3]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("2024-01-02T03:04:05Z ERROR a: b\n")
    assert [(r.level, r.message) for r in run(live_logs(spark, str(tmp_path / "logs")), "logs", "append").collect()] == [("ERROR", "b")]
