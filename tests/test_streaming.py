import numpy as np

from lacuna.sources import codec
from lacuna.streaming.arrivals import arriving_points, running_stats


def test_files_that_arrive_are_counted_once(spark, tmp_path):
    def arrive(name, n):
        data = codec.write([(codec.Scan([codec.Field("cartesianX")], n, 0), [np.arange(n) * 1.0])])
        (tmp_path / "in" / f"{name}.e57").write_bytes(data)

    (tmp_path / "in").mkdir()
    arrive("a", 100)
    stats = running_stats(arriving_points(spark, str(tmp_path / "in"), ["cartesianX"]))
    query = stats.writeStream.outputMode("complete").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        arrive("b", 50)
        query.processAllAvailable()
        assert sorted((r.decoded, r.max_x) for r in spark.table("arrivals").collect()) == [(50, 49.0), (100, 99.0)]
    finally:
        query.stop()
