"""Row-to-row signals. All windows are the same one, by video and frame, so Spark sorts and exchanges once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import distance


def by_frame() -> WindowSpec:
    return Window.partitionBy("video").orderBy("frame")


def best_arms(df: DataFrame) -> DataFrame:
    """The better of both arms; what is missing counts as out of reach. An undefined left angle stays undefined, a right one is passed over."""
    least = F.when(F.isnan("elb_l"), F.col("elb_l")).when(F.isnan("elb_r"), F.col("elb_l")).otherwise(F.least("elb_l", "elb_r"))
    return df.withColumns({
        "up_best": F.coalesce(F.greatest("up_l", "up_r"), F.lit(-9.0)), "lat_best": F.coalesce(F.greatest("lat_l", "lat_r"), F.lit(0.0)),
        "elb_min": F.coalesce(least, F.lit(999.0)), "wv_best": F.coalesce(F.greatest("wv_l", "wv_r"), F.lit(0.0)),
    })


def _moved(side: str) -> Column:
    x, y = f"x{side}", f"y{side}"
    return distance(F.col(x), F.col(y), F.lag(x).over(by_frame()), F.lag(y).over(by_frame()))


def wrist_displacement(df: DataFrame) -> DataFrame:
    """d_wrist: the larger move of both wrists over the torso; 0 where this or the sample before was not detected."""
    both = F.col("det") & F.coalesce(F.lag("det").over(by_frame()), F.lit(False))
    d = F.greatest(_moved("15"), _moved("16")) / F.greatest(F.col("torso"), F.lit(1e-4))
    return df.withColumn("d_wrist", F.when(both, d).otherwise(F.lit(0.0)))


def displacements(df: DataFrame) -> DataFrame:
    """The stepwise variant: null where a sample is missing or the torso is 0."""
    scale = F.nullif(F.col("torso"), F.lit(0.0))
    move = lambda x, y: distance(F.col(x), F.col(y), F.lag(x).over(by_frame()), F.lag(y).over(by_frame())) / scale
    out = df.withColumns({"d_sh": move("sh_x", "sh_y"), "d_hip": move("hip_x", "hip_y"), "d_wrist_l": move("x15", "y15"), "d_wrist_r": move("x16", "y16")})
    return out.withColumn("d_wrist", F.greatest("d_wrist_l", "d_wrist_r"))


def rolling_motion(df: DataFrame) -> DataFrame:
    """m_sum3, m_count3 over the sample and its neighbours, and their rounded mean m_roll3_e5."""
    three = by_frame().rowsBetween(-1, 1)
    out = df.withColumns({"m_sum3": F.sum("m_e5").over(three), "m_count3": F.count("m_e5").over(three)})
    return out.withColumn("m_roll3_e5", F.floor(F.col("m_sum3") / F.col("m_count3") + 0.5))


def array_motion(df: DataFrame, array: str, key: str, order: str, start: int = 1, length: int | None = None) -> DataFrame:
    """motion: mean absolute change of an array against the row before; 0 in the first row. start, length: a central crop."""
    w = Window.partitionBy(key).orderBy(order)
    part = F.slice(array, start, length) if length else F.col(array)
    now = F.transform(part, lambda v: v.cast("double"))
    before = F.lag(now).over(w)
    total = F.aggregate(F.zip_with(now, before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("motion", F.when(before.isNull(), F.lit(0.0)).otherwise(total / F.size(now)))


def is_triple(values: Column, limit: float) -> Column:
    """Whether an array shows one panel three times: its first two thirds and its last two thirds differ by less than limit on average."""
    third = F.floor(F.size(values) / 3).cast("int")
    apart = F.zip_with(F.slice(values, 1, 2 * third), F.slice(values, third + 1, 2 * third), lambda a, b: F.abs(a - b))
    return F.aggregate(apart, F.lit(0.0), lambda s, v: s + v) / F.size(apart) < limit


def middle_third(values: Column) -> Column:
    third = F.floor(F.size(values) / 3).cast("int")
    return F.slice(values, third + 1, third)
