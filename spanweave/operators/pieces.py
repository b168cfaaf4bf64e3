"""Row-to-row rules over one very long series: the series is cut into pieces that overlap by the reach of the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_pieces(samples: DataFrame, rules: Callable[[DataFrame], DataFrame], reach: int, rows: int = 100_000) -> DataFrame:
    """The same rows as rules(samples), where rules' windows by video and frame look at most `reach` rows to each side.

    Samples are numbered within blocks of frames, the blocks' counts give each sample its place in the series, and a
    piece is `rows` places with `reach` more on both sides; no window ever holds a whole series. A series of few
    samples is one piece. Names that start with _piece are reserved. Frames differ within a series; a missing one comes first.
    """
    block = samples.withColumn("_piece_block", F.floor(F.col("frame") / rows))
    counts = block.groupBy(F.col("video").alias("_piece_video"), F.col("_piece_block").alias("_piece_number")).agg(F.count(F.lit(1)).alias("_piece_n"))
    earlier = Window.partitionBy("_piece_video").orderBy("_piece_number").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_piece_start", F.coalesce(F.sum("_piece_n").over(earlier), F.lit(0))).drop("_piece_n")
    place = F.row_number().over(Window.partitionBy("video", "_piece_block").orderBy("frame")) - 1
    numbered = block.withColumn("_piece_place", place).join(starts, F.col("video").eqNullSafe(F.col("_piece_video")) & F.col("_piece_block").eqNullSafe(F.col("_piece_number")))
    at = F.col("_piece_place") + F.col("_piece_start")
    piece = lambda c: F.floor(c / rows)
    spread = numbered.withColumns({"_piece_own": piece(at), "_piece": F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), piece(at - reach)), piece(at + reach)))})
    keyed = spread.withColumn("video", F.struct("video", "_piece")).select(*samples.columns, "_piece_own")
    return rules(keyed).where(F.col("_piece_own") == F.col("video._piece")).drop("_piece_own").withColumn("video", F.col("video.video"))
