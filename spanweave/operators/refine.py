"""Edges on a finer grid: around each edge of a block the first (last) pair of neighbouring true samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import RULES, Rules
from .classify import holds, pose_rule
from .signals import best_arms

WINDOW = 15
#: Elbows that are seen less than this have no angle.
ELBOW_SEEN = 0.3


def tasks(blocks: DataFrame, window: int = WINDOW) -> DataFrame:
    """video, block, edge (s, e), k, t: seconds around both edges of each block, none before 0."""
    edges = F.explode(F.array(F.struct(F.lit("s").alias("edge"), F.col("start_s").alias("at")), F.struct(F.lit("e").alias("edge"), F.col("end_s").alias("at"))))
    each = blocks.select("video", "block", edges.alias("x")).select("video", "block", "x.edge", "x.at", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("k"))
    return each.select("video", "block", "edge", F.col("k").cast("long").alias("k"), (F.col("at") + F.col("k")).alias("t")).where("t >= 0").distinct()


def gate(samples: DataFrame, r: Rules = RULES) -> DataFrame:
    """Adds gate: standing by the shoulders, and a strict hand pose. An elbow without an angle, or seen too little (columns v13 and v14, where there are any), counts as 999."""

    def elbow(angle: str, seen: str):
        defined = ~F.isnan(angle)
        return F.coalesce(F.when(defined & (F.col(seen) > ELBOW_SEEN) if seen in samples.columns else defined, F.col(angle)), F.lit(999.0))

    df = best_arms(samples).withColumn("elb_min", F.least(elbow("elb_l", "v13"), elbow("elb_r", "v14")))
    return df.withColumn("gate", holds((F.col("sh_y") < r.shoulder_y) & (F.col("sh_w") < r.shoulder_width)) & pose_rule(r.up, r.lateral, r.elbow, r.elbow_up, r.visible))


def at_times(times: DataFrame, samples: DataFrame, r: Rules = RULES) -> DataFrame:
    """times (video, t, ...) with the gate of the sample that covers t: the last one on the grid that does not lie behind it. Null without one."""
    grid = samples.select("video", F.col("frame").alias("at_frame"), "gate")
    return times.withColumn("at_frame", F.floor(F.col("t") / r.step)).join(grid, ["video", "at_frame"], "left").drop("at_frame")


def refine(blocks: DataFrame, gates: DataFrame) -> DataFrame:
    """gates: video, block, edge, k, t, gate (null: no sample, counts as false). Edges without a pair stay."""
    w = Window.partitionBy("video", "block", "edge").orderBy("k")
    on = F.coalesce("gate", F.lit(False))
    pairs = gates.withColumns({"opens": on & F.coalesce(F.lead(on).over(w), F.lit(False)), "closes": on & F.coalesce(F.lag(on).over(w), F.lit(False))})
    found = pairs.groupBy("video", "block").agg(F.min_by("t", F.when((F.col("edge") == "s") & F.col("opens"), F.col("k"))).alias("new_s"), F.max_by("t", F.when((F.col("edge") == "e") & F.col("closes"), F.col("k"))).alias("new_e"))
    out = blocks.join(found, ["video", "block"], "left")
    out = out.select("video", "block", F.col("start_s").alias("orig_start"), F.col("end_s").alias("orig_end"), F.coalesce("new_s", "start_s").alias("refined_start"), F.coalesce("new_e", "end_s").alias("refined_end"))
    return out.withColumn("dur_s", F.col("refined_end") - F.col("refined_start"))
