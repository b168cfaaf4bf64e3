"""Intervals and samples: which samples lie in reviewed intervals, which clip and role a sample has.

A range join would compare each sample with all intervals of its series. Intervals lie on the sample grid, so they
are expanded to their frames instead and joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..params import RULES, Rules


def reviewed(samples: DataFrame, intervals: DataFrame, r: Rules = RULES) -> DataFrame:
    """Marks samples whose time lies in some interval (both ends included), and masks their flag."""
    first, last = F.greatest(F.lit(0.0), F.ceil(F.col("start_s") / r.step)), F.floor(F.col("end_s") / r.step)
    spans = intervals.select("video", first.cast("long").alias("fa"), last.cast("long").alias("fb")).where("fb >= fa")
    inside = spans.select("video", F.explode(F.sequence("fa", "fb")).alias("frame")).distinct().withColumn("reviewed", F.lit(True))
    out = samples.join(inside, ["video", "frame"], "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    out = out.withColumn("dance_auto", F.col("dance")).withColumn("dance", F.col("dance") & F.col("reviewed"))
    return out.withColumn("review", F.when(F.col("reviewed"), P.REVIEW_DANCE).otherwise(P.REVIEW_EXCLUDED))


def roles(samples: DataFrame, clips: DataFrame, r: Rules = RULES) -> DataFrame:
    """clip_id for the frames that a clip's half-open interval covers (0: none), and clip_role for those from its pad to its last flag."""
    cover = lambda c: F.rint(F.col(c) / r.step).cast("long")
    spans = clips.select("video", "clip", "a", "b", cover("clip_start_s").alias("fa"), cover("clip_end_s").alias("fb"))
    # a clip that is cut off by the end of its series may cover fewer frames than its flags do
    frames = spans.select("video", "clip", "a", "b", "fa", "fb", F.explode(F.sequence(F.least("fa", "a"), F.greatest(F.col("fb") - 1, F.col("b")))).alias("frame"))
    # neighbouring clips may share a padding frame: the later one takes it, but a role that is set stays
    own = frames.groupBy("video", "frame").agg(
        F.max(F.when((F.col("frame") >= F.col("fa")) & (F.col("frame") < F.col("fb")), F.col("clip"))).alias("clip_id"), F.max((F.col("frame") >= F.col("a")) & (F.col("frame") <= F.col("b"))).alias("inside"), F.max((F.col("frame") >= F.col("fa")) & (F.col("frame") < F.col("a"))).alias("before"),
    )
    out = samples.join(own, ["video", "frame"], "left")
    role = F.when(F.col("inside") & F.col("dance"), "dance").when(F.col("inside"), "bridge").when(F.col("before"), "pre_pad").otherwise("none")
    return out.withColumns({"clip_id": F.coalesce("clip_id", F.lit(0).cast("long")), "clip_role": role}).drop("inside", "before")


def merge_features(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps the left side's columns where both have a name."""
    twice = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.drop(*twice), keys, "left")
