"""Days from a stream of pulls: late rows, repeated pulls, days that are not over, restarts."""

from datetime import date, datetime, timedelta

from pyspark.sql import types as T

from pumpwise.streaming import daily
from pumpwise.streaming.ingest import landed

SCHEMA = T.StructType([
    T.StructField("station", T.StringType()), T.StructField("pull", T.IntegerType()), T.StructField("price", T.DoubleType()), T.StructField("at", T.TimestampType())
])
DAY = datetime(2026, 3, 1)


def pull(station, n, price, hours):
    return (station, n, price, None if hours is None else DAY + timedelta(hours=hours))


def test_days_are_final_once(spark, tmp_path):
    land, out, checkpoint = (str(tmp_path / x) for x in ("land", "out", "checkpoint"))

    def step(*rows):
        if rows:
            spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(land)
        daily.summarise_days(daily.landed_rows(spark, land, SCHEMA), ["station"], "at", ["station", "pull", "at"], out, checkpoint, late="1 day").awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("station string, day date, n bigint, low double, high double").parquet(out).collect())

    assert step(pull("a", 1, 1.0, 1), pull("a", 2, 3.0, 2), pull("a", 2, 3.0, 2), pull("b", 1, 5.0, 23), pull("a", 9, 9.0, None)) == []
    # The first day may still get rows until a row of the third has come.
    assert step(pull("a", 1, 1.0, 1), pull("a", 3, 2.0, 30)) == []
    assert step(pull("a", 4, 0.5, 8), pull("a", 5, 4.0, 49)) == [("a", date(2026, 3, 1), 3, 0.5, 3.0), ("b", date(2026, 3, 1), 1, 5.0, 5.0)]
    # Too late for the first day, in time for the second; a call without new files changes nothing.
    got = step(pull("b", 7, 0.1, 4), pull("b", 8, 6.0, 26), pull("b", 8, 6.0, 26), pull("a", 6, 1.0, 73))
    assert got == step()
    assert [r for r in got if r[1] == date(2026, 3, 2)] == [("a", date(2026, 3, 2), 1, 2.0, 2.0), ("b", date(2026, 3, 2), 1, 6.0, 6.0)]
    assert len(got) == 4


def test_batches_are_bounded_and_done_files_move(spark, tmp_path):
    land, done, out = tmp_path / "land", tmp_path / "done", tmp_path / "out"
    land.mkdir()
    for i in range(5):
        (land / f"{i}.json").write_text("[]")
    sizes = []
    stream = landed(spark, str(land), files_per_batch=2, archive=str(done))
    for _ in range(2):  # files are moved when the batch after theirs is planned
        stream.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(out)).trigger(availableNow=True).start().awaitTermination()
        (land / f"late{len(sizes)}.json").write_text("[]")
    assert sizes[:3] == [2, 2, 1] and sum(sizes) == 6
    assert len(list(done.rglob("*.json"))) >= 4
