"""The session-window form equals the batch form, as a table and as a stream."""

import random

from spanweave.operators import segment
from spanweave.streaming import blocks, timed


def series(spark):
    rnd = random.Random(4)
    rows = []
    for v in range(6):
        on = False
        for i in range(150):
            on = on if rnd.random() > 0.15 else not on
            rows.append((f"v{v}", i, on))
    return spark.createDataFrame(rows, "video string, frame long, dance boolean")


def read(df):
    return sorted((r.video, r.a, r.b, r.dance_samples, r.is_kept) for r in df.collect())


def test_table_form(spark):
    s = series(spark)
    assert read(blocks(timed(s))) == read(segment.blocks(s))


def test_stream_form(spark, tmp_path):
    s = timed(series(spark))
    for k in range(3):
        s.where(f"frame div 50 = {k}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    # a last sample of each series far behind lets the watermark pass all blocks
    s.where("frame = 0").withColumn("at", s["at"] + spark.sql("select interval 1 day as d").first().d).selectExpr("video", "frame + 100000 as frame", "false as dance", "at").write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = blocks(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert read(spark.table("found")) == read(segment.blocks(series(spark)))
