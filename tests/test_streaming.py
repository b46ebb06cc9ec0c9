"""Append-mode streams over several arrivals with restarts: late rows, gaps, nulls, empty arrivals."""

from loomcount import streaming

SCHEMA = "ts string, who string"


def run(spark, at, arrivals, plan):
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).selectExpr("CAST(ts AS TIMESTAMP) AS ts", "who").coalesce(1).write.mode("append").parquet(f"{at}/in")
        s = plan(spark.readStream.schema("ts timestamp, who string").parquet(f"{at}/in"))
        s.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{at}/out"), spark.read.parquet(f"{at}/in")


def day(d, who, hour=12):
    return (f"2024-01-{d:02d} {hour:02d}:00:00", who)


def found(df):
    return sorted(tuple(str(x)[:10] if k in ("day", "born", "died") else x for k, x in r.asDict().items()) for r in df.collect())


def test_days_close_once_and_late_rows_are_counted_apart(spark, tmp_path):
    arrivals = [
        [day(1, "a"), day(1, "a"), day(2, None), (None, "a"), day(4, "a")],  # then the mark is the 3rd, 12:00
        [day(1, "a"), day(1, "new"), day(3, "a"), day(9, "b")],  # two late rows, and one that is older than the mark but of an open day
        [],
        [day(4, "a"), day(8, "b"), day(8, "b"), day(12, "b")],  # the mark is the 8th
    ]
    closed, arrived = run(spark, tmp_path, arrivals, lambda s: streaming.closed_counts(s, "ts", "who"))
    got = found(streaming.with_late(closed, arrived, "ts", "who").na.fill("-", ["who"]))
    assert got == [("2024-01-01", "a", 2, 1), ("2024-01-01", "new", 0, 1), ("2024-01-02", "-", 1, 0), ("2024-01-03", "a", 1, 0), ("2024-01-04", "a", 1, 1), ("2024-01-08", "b", 2, 0), ("2024-01-09", "b", 1, 0)]
    assert closed.count() == closed.select("day", "who").distinct().count()


def test_lives(spark, tmp_path):
    twice = lambda d, who: [day(d, who), day(d, who, 13)]
    arrivals = [
        [*twice(1, "a"), day(2, "a"), *twice(1, "b"), day(1, "c"), *twice(3, "a")],  # a goes on over one unsupported day, c is never supported
        [*twice(4, "b"), day(4, "b"), *twice(5, "a"), day(9, "d")],  # three days later: b lives again
        [day(1, "c"), day(20, "d")],  # late
    ]
    got, _ = run(spark, tmp_path, arrivals, lambda s: streaming.lives(s, "ts", "who", least=2, gap="2 days"))
    assert found(got) == [("a", "2024-01-01", "2024-01-05", 3, 2), ("b", "2024-01-01", "2024-01-01", 1, 2), ("b", "2024-01-04", "2024-01-04", 1, 3)]


def test_nothing_arrives(spark, tmp_path):
    closed, arrived = run(spark, tmp_path, [[]], lambda s: streaming.closed_counts(s, "ts", "who"))
    assert streaming.with_late(closed, arrived, "ts", "who").count() == 0
