"""From features and signals to a flag for each sample: predicates, anchors, relaxed limits, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..params import RULES, Rules
from .signals import best_arms, by_frame, displacements, rolling_motion, wrist_displacement


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def stance(df: DataFrame, r: Rules = RULES) -> DataFrame:
    out = df.withColumns({"is_standing": holds((F.col("sh_y") < r.shoulder_y) & (F.col("sh_w") < r.shoulder_width)), "leg_vis": holds(F.col("vis_kne") > r.knee) | holds(F.col("vis_ank") > r.ankle)})
    return out.withColumn("stance_ok", F.col("is_standing") | F.col("leg_vis"))


def pose_rule(up: float, lateral: float, elbow: float, elbow_up: float, visible: float) -> Column:
    bent = ~F.isnan("elb_min") & (F.col("elb_min") < elbow) & (F.col("up_best") > elbow_up)
    return holds(((F.col("up_best") > up) | (F.col("lat_best") > lateral) | bent) & (F.col("wv_best") > visible))


def hands(df: DataFrame, r: Rules = RULES) -> DataFrame:
    """df: with best arms and d_wrist."""
    out = df.withColumns({
        "hand_pose": pose_rule(r.up, r.lateral, r.elbow, r.elbow_up, r.visible), "hand_pose_loose": pose_rule(r.loose_up, r.loose_lateral, r.loose_elbow, r.loose_elbow_up, r.loose_visible),
        "hand_move": holds(F.col("d_wrist") > r.wrist_move),
    })
    return out.withColumn("hand_dance", F.col("hand_pose") | F.col("hand_move"))


def labels(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "body_state": F.when(F.col("is_standing"), P.BODY_STANDING).when(F.col("leg_vis"), P.BODY_LEGS).otherwise(P.BODY_OTHER),
        "hand_state": F.when(F.col("hand_pose"), P.HAND_POSE).when(F.col("hand_pose_loose"), P.HAND_LOOSE).when(F.col("hand_move"), P.HAND_MOVE).otherwise(P.HAND_STILL),
    })


def anchors(df: DataFrame, r: Rules = RULES) -> DataFrame:
    """active, base, anchor and the neighbourhood of anchors. Anchors come from base flags only, so one window is enough."""
    out = df.withColumn("active", F.col("m_roll3_e5") > r.motion_e5)
    out = out.withColumn("base", F.col("stance_ok") & F.col("hand_dance") & F.col("active"))
    out = out.withColumn("anchor", F.col("base") & (F.col("m_roll3_e5") > r.motion_anchor_e5))
    return out.withColumn("near_anchor", F.max("anchor").over(by_frame().rowsBetween(-r.near, r.near)))


def relaxed(df: DataFrame, r: Rules = RULES) -> DataFrame:
    both = F.col("near_anchor") & F.col("leg_vis")
    limit = F.when(both, r.motion_leg_e5).when(F.col("near_anchor"), r.motion_near_e5).otherwise(r.motion_e5)
    level = F.when(both, P.RELAX_BOTH).when(F.col("near_anchor"), P.RELAX_NEAR).when(F.col("leg_vis"), P.RELAX_LEG).otherwise(P.RELAX_NONE)
    hand = F.col("hand_dance") | (F.col("near_anchor") & F.col("hand_pose_loose"))
    out = df.withColumns({"m_thr_e5": limit.cast("long"), "relax_level": level})
    out = out.withColumn("relax_ok", F.col("stance_ok") & hand & (F.col("m_roll3_e5") > F.col("m_thr_e5")))
    return out.withColumn("dance_raw", F.col("base") | F.col("relax_ok"))


def smooth(df: DataFrame, flag: str = "dance_raw") -> DataFrame:
    """dance: at least 0.34 of the sample and its neighbours; at the ends of a series of those that there are."""
    three = by_frame().rowsBetween(-1, 1)
    out = df.withColumns({"raw_sum": F.sum(F.col(flag).cast("long")).over(three), "raw_count": F.count(F.lit(1)).over(three)})
    return out.withColumn("dance", 100 * F.col("raw_sum") >= 34 * F.col("raw_count"))


def smooth_padded(df: DataFrame, flag: str = "dance_raw") -> DataFrame:
    """The stepwise variant: the ends are padded with zeros, so always a third each."""
    out = df.withColumn("raw_sum", F.sum(F.col(flag).cast("long")).over(by_frame().rowsBetween(-1, 1)))
    return out.withColumns({"raw_count": F.lit(3).cast("long"), "dance": F.col("raw_sum") >= 2})


def classify(samples: DataFrame, r: Rules = RULES) -> DataFrame:
    """All flags of the single-program rules."""
    df = hands(stance(wrist_displacement(best_arms(samples)), r), r)
    return smooth(relaxed(anchors(rolling_motion(labels(df)), r), r))


def reach(r: Rules = RULES) -> int:
    """How many rows to each side a flag depends on: smoothing, then the nearest anchors, then the motion (or the move) of these."""
    return 1 + r.near + 1


def classify_stepwise(samples: DataFrame, r: Rules = RULES) -> DataFrame:
    """The stepwise rules: shoulders only, no relaxed limits, zero-padded smoothing, and a confidence in thousandths."""
    skip = F.when(F.isnan("elb_l"), F.col("elb_r")).when(F.isnan("elb_r"), F.col("elb_l")).otherwise(F.least("elb_l", "elb_r"))
    df = best_arms(displacements(samples)).withColumn("elb_min", skip)
    df = rolling_motion(hands(stance(df, r), r)).withColumn("active", F.col("m_sum3") > r.motion_e5 * F.col("m_count3"))
    df = smooth_padded(df.withColumn("dance_raw", F.col("is_standing") & F.col("hand_dance") & F.col("active")))
    return df.withColumn("confidence_e3", confidence())


def confidence() -> Column:
    """Thousandths of 0.55 * smoothed + 0.25 * standing + 0.20 * hands, 0 without the flag. Thirds are rounded to thousandths first."""
    third = F.when(F.col("raw_sum") == 3, 1000).when(F.col("raw_sum") == 2, 667).when(F.col("raw_sum") == 1, 333).otherwise(0)
    total = F.floor((55 * third + 25_000 * F.col("is_standing").cast("int") + 20_000 * F.col("hand_dance").cast("int") + 50) / 100)
    return F.when(F.col("dance"), F.least(total, F.lit(1000).cast("long"))).otherwise(F.lit(0).cast("long"))
