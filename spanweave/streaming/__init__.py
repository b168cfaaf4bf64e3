"""Blocks of an unbounded series (an extension: the batch engine sees whole series only).

The gap rule of blocks is a session window whose gap is the bridge plus one step, because the bridge counts missing
samples. Late samples count until the watermark has passed; a block is emitted once nothing can extend it any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import RULES, Rules


def timed(samples: DataFrame, r: Rules = RULES) -> DataFrame:
    """Adds event time `at`: the sample's second after the epoch."""
    return samples.withColumn("at", F.timestamp_micros((F.col("frame") * r.step * 1_000_000).cast("long")))


def blocks(samples: DataFrame, r: Rules = RULES, lateness: str = "60 seconds", flag: str = "dance") -> DataFrame:
    """samples: video, frame, at, flag; a stream or a table. A row for each block that is closed (of a table: all).

    One state for each open block, so state grows with the series that are open, not with their length.
    """
    gap = f"{int((r.bridge_s + r.step) * 1000)} milliseconds"
    # the condition names the event time, so it stays above the watermark, which all samples move
    on = samples.withWatermark("at", lateness).where(F.when(F.col(flag), F.col("at")).isNotNull())
    out = on.groupBy("video", F.session_window("at", gap).alias("open")).agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count(F.lit(1)).alias("dance_samples"))
    span = (F.col("b") - F.col("a") + 1) * r.step
    return out.select("video", "a", "b", "dance_samples", span.alias("dance_span_s"), F.greatest(F.lit(0.0), (F.col("a") - 1) * r.step).alias("clip_start_s"), ((F.col("b") + 1) * r.step).alias("clip_end_s"), (span >= r.min_span_s).alias("is_kept"))
