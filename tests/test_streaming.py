from datetime import datetime, timedelta

from pinloom.streaming.pins import PINS, arrivals, new_pins, read_pins


def test_feed_is_deduplicated_and_counted(spark, tmp_path):
    t = datetime(2025, 3, 3)
    at = lambda h: t + timedelta(hours=h)
    rows = [(1, 1, 0, at(0), at(0)), (1, 1, 0, at(0), at(1)), (1, 2, 0, None, at(1)), (None, 2, 0, at(0), at(1)), (3, None, 0, at(0), at(1)), (2, 2, 0, at(0), at(30)), (5, 5, 0, at(0), None)]
    spark.createDataFrame(rows, PINS).coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = read_pins(spark, str(tmp_path / "feed"))
    for name, df, mode in (("seen", new_pins(feed), "append"), ("counted", arrivals(feed), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(tuple(r)[:2] for r in spark.table("seen").collect()) == [(1, 1), (1, 2), (2, 2)]
    assert sorted((r.begin.hour, r.rows, r.late) for r in spark.table("counted").collect()) == [(0, 1, 0), (1, 4, 0), (6, 1, 1)]
