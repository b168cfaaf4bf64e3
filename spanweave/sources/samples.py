"""Sample tables from the test tables: stand-ins for pose features, one row per (video, frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Invented affine stand-ins: column = base + (event_id * factor % 100) / divisor, null where nothing was detected.
STAND_INS = {
    "sh_x": (13, 0.3, 400), "sh_y": (53, 0.30, 500), "sh_w": (71, 0.15, 500), "hip_x": (11, 0.3, 400), "hip_y": (7, 0.5, 400), "torso": (47, 0.3, 400),
    "vis_kne": (37, 0.0, 100), "vis_ank": (41, -0.3, 100), "vis_hip": (33, 0.0, 100),
    "up_l": (29, -1.0, 100), "up_r": (27, -1.0, 100), "lat_l": (43, 0.0, 150), "lat_r": (49, 0.0, 150),
    "elb_l": (61, 60.0, 1), "elb_r": (59, 60.0, 1), "wv_l": (83, 0.2, 100), "wv_r": (79, 0.2, 100),
    "x15": (17, 0.2, 200), "y15": (19, 0.2, 200), "x16": (23, 0.5, 200), "y16": (31, 0.2, 200),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(events: DataFrame, step: float = 3.0) -> DataFrame:
    """video, frame, t, det, m_e5 and the features. The window's key keeps one name throughout, so one exchange serves all steps."""
    det = F.col("event_type") != "error"
    key = F.col("event_id")

    def feature(name: str) -> Column:
        k, base, den = STAND_INS[name]
        value = F.lit(base) + (key * k % 100) / F.lit(float(den))
        if name in ("elb_l", "elb_r"):  # an arm whose angle is undefined
            value = F.when(key % (17 if name == "elb_l" else 19) == 0, F.lit(float("nan"))).otherwise(value)
        return F.when(det, value).alias(name)

    w = Window.partitionBy("video").orderBy("ts", "event_id")
    rows = events.withColumnRenamed("user_id", "video")
    m = F.least(F.lit(40_000).cast("long"), 2 * F.round(F.col("value") * 100).cast("long"))
    frame = (F.row_number().over(w) - 1).cast("long")
    return rows.select("video", frame.alias("frame"), "event_id", det.alias("det"), F.coalesce(m, F.lit(0).cast("long")).alias("m_e5"), *map(feature, STAND_INS)).withColumn("t", F.col("frame") * step)


def landmarks(embeddings: DataFrame) -> DataFrame:
    """vec_id and points: 32 (x, y, v) of consecutive pairs of components; visibility is the absolute first component."""
    e = F.col("embedding")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(e[i * 2].cast("double").alias("x"), e[i * 2 + 1].cast("double").alias("y"), F.least(F.lit(1.0), F.abs(e[i].cast("double")) * 4).alias("v")))
    return embeddings.select("vec_id", "label", points.alias("points"))


def sample_grid(series: DataFrame, start: str, end: str, step_s: int, keys: list[str]) -> DataFrame:
    """Fixed-step grid: a row for each step from the first to the last second of each series (keys)."""
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(end) - F.col(start)) / step_s)))
    return series.select(*keys, F.col(start), ids.alias("frame")).select(*keys, "frame", (F.col(start) + F.col("frame") * step_s).alias("t"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; NaN is read as such, a byte-order mark is dropped."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV table with just these columns (no byte-order mark)."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
