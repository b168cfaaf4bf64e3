"""Column expressions: geometry of points, time codes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point(points: Column, i: int) -> tuple[Column, Column]:
    return points[i]["x"], points[i]["y"]


def span(points: Column, i: int, j: int) -> Column:
    return distance(*point(points, i), *point(points, j))


def middle(points: Column, i: int, j: int, axis: str) -> Column:
    return (points[i][axis] + points[j][axis]) / 2


def torso(points: Column) -> Column:
    """Distance of the middles of shoulders and hips, never 0."""
    d = distance(middle(points, 11, 12, "x"), middle(points, 11, 12, "y"), middle(points, 23, 24, "x"), middle(points, 23, 24, "y"))
    return F.greatest(d, F.lit(1e-4))


def angle(points: Column, a: int, b: int, c: int, undefined: float = float("nan")) -> Column:
    """Degrees at b between a and c; `undefined` where an arm has no length."""
    (ax, ay), (bx, by), (cx, cy) = (point(points, i) for i in (a, b, c))
    n1, n2 = distance(ax, ay, bx, by), distance(cx, cy, bx, by)
    cosine = ((ax - bx) * (cx - bx) + (ay - by) * (cy - by)) / (n1 * n2)
    return F.when((n1 < 1e-6) | (n2 < 1e-6), F.lit(undefined)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def mean(cols: list[Column]) -> Column:
    """Mean in the given order (a fixed order of additions)."""
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / float(len(cols))


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.ss"""
    return F.format_string("%02d:%02d:%05.2f", F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), (seconds % 60).cast("double"))


def timecode_short(seconds: Column, separator: str = ":") -> Column:
    """HH:MM:SS without fractions; with another separator for file names."""
    form = separator.join(["%02d"] * 3)
    return F.format_string(form, F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), F.floor(seconds % 60).cast("long"))


def clip_name(number: Column, start: Column, end: Column) -> Column:
    return F.concat(F.format_string("dance_%02d", number.cast("long")), F.lit("_"), timecode_short(start, ""), F.lit("-"), timecode_short(end, ""), F.lit(".mp4"))


def parse_duration(text: Column) -> Column:
    """Seconds of `Duration: H:M:S.s` in a text; 0.0 where there is none."""
    part = lambda i: F.regexp_extract(text, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", i)
    return F.when(part(1) == "", F.lit(0.0)).otherwise(part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double"))


def filter_escape(text: Column) -> Column:
    """A path inside a filter string: forward slashes, escaped colons."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))
