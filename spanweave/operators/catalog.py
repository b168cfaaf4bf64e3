"""Catalogs of series: scan, pruning, what is done, output places without collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import SKIPPED_DIRECTORIES, SUFFIXES


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path of all files; only paths are read, no content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")


def split_path(path: Column) -> dict[str, Column]:
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return {"dir": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "base": base, "stem": F.regexp_replace(base, r"(.)\.[^.]*$", "$1")}


def scan(paths: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, skipped: tuple[str, ...] = SKIPPED_DIRECTORIES) -> DataFrame:
    """Paths with one of the suffixes, outside skipped and hidden directories, with dir, base, stem and sort keys."""
    parts = paths.select("path").distinct().withColumns(split_path(F.col("path")))
    lower = F.lower("base")
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | lower.endswith(s)
    steps = F.split(F.regexp_replace("dir", r"^[a-z]+:/*", ""), "/")
    hidden = F.exists(steps, lambda d: F.lower(d).isin(*skipped) | (d.startswith(".") & (d != "") & (d != ".") & (d != "..")))
    return parts.where(fits & ~hidden).withColumns({"dir_key": F.lower("dir"), "base_key": F.lower("base")})


def output_place(df: DataFrame, root: str | None = None) -> DataFrame:
    """outdir: beside the source, or below a root."""
    return df.withColumn("outdir", F.concat_ws("/", F.lit(root) if root is not None else F.col("dir"), "stem"))


def pending(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose outdir is not among those done; the place is part of the key, so an own root works too."""
    return df.join(done.select("outdir").distinct(), "outdir", "left_anti")


def outside(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows that do not lie below a directory with results: each directory above a path is looked up."""
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    inside = df.select("path", F.explode(above).alias("outdir")).join(done.select("outdir").distinct(), "outdir", "left_semi").select("path").distinct()
    return df.join(inside, "path", "left_anti")


def unique_places(df: DataFrame, order: list[str]) -> DataFrame:
    """Numbers what collides: place, place_2, place_3 and so on."""
    n = F.row_number().over(Window.partitionBy("outdir").orderBy(*order))
    return df.withColumn("n", n.cast("long")).withColumn("place", F.when(F.col("n") > 1, F.concat_ws("_", "outdir", F.col("n").cast("string"))).otherwise(F.col("outdir")))
