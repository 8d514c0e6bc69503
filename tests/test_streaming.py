from datetime import datetime, timedelta

from pyspark.sql import functions as F

from nodeloom.streaming import events as E


def test_stream_gives_the_batch_cells_of_final_windows(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i % 3, base + timedelta(hours=i), "ab"[i % 2], float(i)) for i in range(72)]
    df = spark.createDataFrame(rows, "node long, ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.streamed_cells(E.event_stream(spark, str(tmp_path / "in"), df.schema), "node", "ts", "kind", "value")
    E.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r["node"], r["start"], r["category"]): r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = df.where(F.col("ts") < base + timedelta(days=2)).groupBy("node", F.window("ts", "1 day").alias("w"), "kind").agg(F.sum("value").alias("v")).collect()
    assert got == {(r["node"], r["w"]["start"], r["kind"]): r["v"] for r in batch}
