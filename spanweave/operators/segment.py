"""Runs, gap-tolerant blocks and clip intervals from flags; candidates and merged intervals of the stepwise rules.

A greedy chain over runs depends on the run before alone, so one lag and a running sum number runs and blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..params import RULES, Rules


def islands(df: DataFrame, flag: str, bridge_samples: float = 0.0, key: str = "video", order: str = "frame") -> DataFrame:
    """The flagged rows with run_id and block_id (from 1): a run breaks where a sample is missing, a block where more than bridge_samples are."""
    w = Window.partitionBy(key).orderBy(order)
    on = df.where(F.col(flag)).withColumn("missing", F.col(order) - F.lag(order).over(w) - 1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    new = lambda limit: F.sum(F.when(F.col("missing").isNull() | (F.col("missing") > limit), 1).otherwise(0)).over(upto)
    return on.withColumns({"run_id": new(0), "block_id": new(bridge_samples)}).drop("missing")


def runs(df: DataFrame, flag: str = "dance", key: str = "video", order: str = "frame") -> DataFrame:
    return islands(df, flag, 0, key, order).groupBy(key, "run_id").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def clip_bounds(r: Rules = RULES, video_end: Column | None = None) -> dict[str, Column]:
    """One sample of padding on each side, not before 0 and, if the end is known, not after it."""
    end = (F.col("b") + 1) * r.step
    if video_end is not None:
        end = F.when(video_end > 0, F.least(video_end, end)).otherwise(end)
    return {"clip_start_s": F.greatest(F.lit(0.0), (F.col("a") - 1) * r.step), "clip_end_s": end}


def blocks(df: DataFrame, r: Rules = RULES, flag: str = "dance", videos: DataFrame | None = None) -> DataFrame:
    """A row for each block: first and last flagged sample, counts, parts, padded interval and whether it is long enough.

    videos: video, duration_s, if ends of series are known (null or 0: unknown).
    """
    on = islands(df, flag, r.bridge_s / r.step)
    parts = on.groupBy("video", "block_id", "run_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count(F.lit(1)).alias("n"))
    out = parts.groupBy("video", F.col("block_id").cast("long").alias("block")).agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("dance_samples"), F.count(F.lit(1)).alias("n_parts"), F.array_sort(F.collect_list(F.struct("a", "b"))).alias("parts"),
    )
    end = None
    if videos is not None:
        out, end = out.join(videos.select("video", "duration_s"), "video", "left"), F.col("duration_s")
    out = out.withColumns({"dance_span_s": (F.col("b") - F.col("a") + 1) * r.step, **clip_bounds(r, end)})
    kept = F.col("dance_span_s") >= r.min_span_s
    return out.withColumns({"clip_dur_s": F.col("clip_end_s") - F.col("clip_start_s"), "is_kept": kept, "kept": F.when(kept, P.KEPT_YES).otherwise(P.KEPT_NO)})


def clips(blocks_: DataFrame) -> DataFrame:
    """The kept blocks, numbered from 1 in each series."""
    return blocks_.where("is_kept").withColumn("clip", F.row_number().over(Window.partitionBy("video").orderBy("a")).cast("long"))


def candidates(df: DataFrame, r: Rules = RULES) -> DataFrame:
    """Stepwise candidates: gaps of one sample, two samples at least; means over all rows between first and last, in integer units."""
    found = islands(df, "dance", r.candidate_gap).groupBy("video", "block_id").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).where(F.col("end_frame") - F.col("start_frame") + 1 >= r.candidate_least)
    frames = found.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame")))
    whole = frames.join(df.select("video", "frame", "is_standing", "hand_pose", "hand_move", "m_e5", "confidence_e3"), ["video", "frame"])
    count = lambda c: F.sum(F.col(c).cast("long")).alias(f"sum_{c}")
    out = whole.groupBy("video", "start_frame", "end_frame").agg(F.count(F.lit(1)).alias("n"), *map(count, ("is_standing", "hand_pose", "hand_move", "m_e5", "confidence_e3")))
    pad = r.candidate_pad_s
    out = out.withColumns({"start_s": F.col("start_frame") * r.step - pad, "end_s": F.col("end_frame") * r.step + pad, "dur_s": F.col("n") * r.step})
    return out.withColumn("review", F.when(F.col("start_s") <= r.review_until_s, P.REVIEW_DANCE).otherwise(P.REVIEW_REJECTED))


def merge_intervals(df: DataFrame, gap_s: float, start: str = "start_s", end: str = "end_s", key: str = "video") -> DataFrame:
    """Numbers (block, from 1) intervals whose start lies at most gap_s behind the largest end before."""
    w = Window.partitionBy(key).orderBy(start, end)
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("opens", F.when(last.isNull() | (F.col(start) - last > gap_s), 1).otherwise(0))
    return marked.withColumn("block", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("opens")


def merged_candidates(cands: DataFrame, r: Rules = RULES) -> DataFrame:
    """Accepted candidates joined over gaps up to the merge gap; means are unweighted over the parts."""
    good = merge_intervals(cands.where(F.col("review") == P.REVIEW_DANCE), r.merge_gap_s)
    # per-part means are rounded to their stored places before they are averaged
    conf, motion = F.floor(F.col("sum_confidence_e3") / F.col("n") + 0.5), F.floor(F.col("sum_m_e5") / F.col("n") / 10 + 0.5)
    return good.groupBy("video", "block").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("parts"), F.sum(conf).alias("sum_conf_e3"), F.sum(motion).alias("sum_motion_e4")).withColumn("dur_s", F.col("end_s") - F.col("start_s"))

