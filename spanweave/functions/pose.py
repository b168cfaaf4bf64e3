"""Features of landmark arrays (points: array of x, y, v; ids of the 33-point body and 21-point hand models)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import angle, distance, mean, middle, point, span, torso

CORE = (11, 12, 23, 24)
TIPS = (4, 8, 12, 16, 20)
SIDES = {"l": (11, 13, 15), "r": (12, 14, 16)}


def person_score(points: Column, count: int) -> Column:
    """Mean visibility of shoulders and hips, less 0.35 of the distance of the mean x from the middle."""
    xs = F.aggregate(F.slice(points, 1, count), F.lit(0.0), lambda s, p: s + p["x"]) / float(count)
    return mean([points[i]["v"] for i in CORE]) - 0.35 * F.abs(xs - 0.5)


def pick_person(df: DataFrame, keys: list[str], person: str, count: int = 33) -> DataFrame:
    """The row of the person with the largest score; the first on a tie, none that scores -9 or less."""
    scored = df.withColumn("score", person_score(F.col("points"), count)).where("score > -9")
    best = F.max_by(F.struct(person, "points", "score"), F.struct(F.col("score"), -F.col(person)))
    return scored.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def arm_features(points: Column) -> dict[str, Column]:
    """Per side: wrist height and reach over the torso, arm length, visibility."""
    size, mid = torso(points), middle(points, 11, 12, "x")
    out = {}
    for side, (sh, el, wr) in SIDES.items():
        out[f"up_{side}"] = (points[sh]["y"] - points[wr]["y"]) / size
        out[f"lat_{side}"] = F.abs(points[wr]["x"] - mid) / size
        out[f"armlen_{side}"] = span(points, sh, wr) / size
        out[f"wv_{side}"] = F.least(*(points[i]["v"] for i in (sh, el, wr)))
    return out


def joint_angles(points: Column, visible: float = 0.4) -> dict[str, Column]:
    """Elbow angles, and knee angles where the knee is visible."""
    out = {f"elb_{side}": angle(points, *ids) for side, ids in SIDES.items()}
    for side, (hip, knee, ankle) in {"l": (23, 25, 27), "r": (24, 26, 28)}.items():
        out[f"knee_{side}"] = F.when(points[knee]["v"] > visible, angle(points, hip, knee, ankle))
    return out


def body_ratios(points: Column) -> dict[str, Column]:
    sh, hip, knee, ankle = (middle(points, i, i + 1, "y") for i in (11, 23, 25, 27))
    size = torso(points)
    return {
        "torso_up": hip - sh, "leg_ratio": F.abs(ankle - hip) / size, "ank_below_hip": (ankle - hip) / size, "hip_below_sh": (hip - sh) / size,
        "knee_below_hip": (knee - hip) / size, "vis_kne": F.least(points[25]["v"], points[26]["v"]), "vis_ank": F.least(points[27]["v"], points[28]["v"]), "vis_hip": F.least(points[23]["v"], points[24]["v"]),
    }


def reliable_extent(points: Column, visible: float = 0.5) -> dict[str, Column]:
    """Over the visible points: top, bottom and span in y, and their number; null without any."""
    ys = F.transform(F.filter(points, lambda p: p["v"] > visible), lambda p: p["y"])
    return {"vis_top": F.array_min(ys), "vis_bot": F.array_max(ys), "vis_span": F.array_max(ys) - F.array_min(ys), "n_rel": F.size(ys).cast("long")}


def hand_shape(points: Column) -> dict[str, Column]:
    palm_x, palm_y = (mean([points[i][axis] for i in (0, 5, 17)]) for axis in ("x", "y"))
    size = F.greatest(span(points, 0, 9), F.lit(1e-4))
    palm = mean([distance(*point(points, t), palm_x, palm_y) for t in TIPS]) / size
    spread = mean([span(points, a, b) for a, b in combinations(TIPS, 2)]) / size
    return {"palm_open": palm, "tip_spread": spread, "pinch": span(points, 4, 8) / size, "openness": 0.6 * palm + 0.4 * spread, "hand_size_px": size * 256}


def hand_window(x: Column, y: Column, size: Column, width: int, height: int, factor: float = 1.4, least: float = 0.11, most: float = 0.22, smallest: int = 24) -> dict[str, Column]:
    """Pixel box around a wrist, cut to the image; ok if both sides are long enough."""
    half = F.greatest(F.lit(least), F.least(F.lit(most), factor * size))
    cut = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n), F.floor(v * n))).cast("long")
    box = {"x0": cut(x - half, width), "x1": cut(x + half, width), "y0": cut(y - half, height), "y1": cut(y + half, height)}
    return box | {"ok": (box["x1"] - box["x0"] >= smallest) & (box["y1"] - box["y0"] >= smallest)}
