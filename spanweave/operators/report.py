"""Interval tables, summaries, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip_name, timecode, timecode_short
from ..params import RULES, Rules


def clip_table(clips: DataFrame, r: Rules = RULES) -> DataFrame:
    s, e = F.col("clip_start_s"), F.col("clip_end_s")
    return clips.select(
        "video", "clip", clip_name(F.col("clip"), s, e).alias("file"), timecode_short(s).alias("src_start"), timecode_short(e).alias("src_end"), s.alias("start_s"), e.alias("end_s"), "clip_dur_s",
        timecode(s).alias("start_tc"), timecode(e).alias("end_tc"), "dance_span_s", F.col("a").alias("first_dance_frame"), F.col("b").alias("last_dance_frame"),
    )


def offsets(table: DataFrame) -> DataFrame:
    """Where each clip starts and ends in the compilation of its series."""
    w = Window.partitionBy("video").orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("clip_dur_s").over(w), F.lit(0.0))
    return table.withColumns({"offset_s": before, "offset_end_s": before + F.col("clip_dur_s")}).withColumns({"offset_tc": timecode_short(F.col("offset_s")), "offset_end_tc": timecode_short(F.col("offset_end_s"))})


def manifest(table: DataFrame) -> DataFrame:
    """One text for each series: a comment line for each clip, then the list to join."""
    line = F.format_string("# %2d  %-30s  %s - %s  (%.1fs)", "clip", "file", "src_start", "src_end", "clip_dur_s")
    rows = table.select("video", F.struct("clip", line.alias("note"), F.format_string("file '%s'", "file").alias("entry")).alias("x"))
    all_ = F.array_sort(F.collect_list("x"))
    return rows.groupBy("video").agg(all_.alias("xs")).select("video", F.concat_ws("\n", F.col("xs.note"), F.array(F.lit("")), F.col("xs.entry")).alias("text"))


def commands(table: DataFrame) -> DataFrame:
    """What a media tool would be asked to do for each clip; running it is not part of the engine."""
    return table.select("video", "clip", F.format_string("-ss %.3f -t %.3f", "start_s", "clip_dur_s").alias("arguments"), "file")


def kpis(samples: DataFrame) -> DataFrame:
    flags = ["dance", "dance_raw", "base", "anchor", "leg_vis", "stance_ok", "is_standing", "hand_dance"]
    return samples.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f)).alias(f"n_{f}") for f in flags))


def run_summary(samples: DataFrame, blocks: DataFrame, r: Rules = RULES) -> DataFrame:
    """A row for each series: frames, flagged frames, blocks, clips, seconds."""
    a = samples.groupBy("video").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("dance").alias("n_dance_frames"))
    b = blocks.groupBy("video").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if("is_kept").alias("n_clips"), F.sum(F.when(F.col("is_kept"), F.col("clip_dur_s")).otherwise(0.0)).alias("total_clip_s"))
    out = a.join(b, "video", "left").fillna(0, ["n_blocks", "n_clips", "total_clip_s"])
    return out.withColumns({"step_s": F.lit(r.step), "bridge_s": F.lit(r.bridge_s), "min_dance_s": F.lit(r.min_span_s)})


def summary_json(summary: DataFrame) -> DataFrame:
    return summary.select("video", F.to_json(F.struct(*[c for c in summary.columns if c != "video"])).alias("json"))


SUMMARY = "step_s double, bridge_s double, min_dance_s double, n_frames long, n_dance_frames long, n_blocks long, n_clips long, total_clip_s double"


def read_summary(rows: DataFrame) -> DataFrame:
    """The summaries that summary_json() wrote; a text that is no summary gives nulls."""
    return rows.select("video", F.from_json("json", SUMMARY).alias("s")).select("video", "s.*")


def batch_rows(series: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each series of a batch: what it gave, whether it went well, and else why not. One failed series leaves the others as they are."""
    out = series.select("video").distinct().join(summary, "video", "left")
    ok = F.coalesce(F.col("n_frames") > 0, F.lit(False))
    return out.select("video", F.when(ok, F.col("n_clips")).otherwise(0).cast("long").alias("clips"), F.when(ok, F.col("total_clip_s")).otherwise(0.0).alias("seconds"), ok.cast("long").alias("ok"), F.when(~ok, F.lit("no samples")).alias("err"))


def batch_summary(summary: DataFrame) -> DataFrame:
    """Totals over all series; a series without frames counts as failed."""
    ok = F.col("n_frames") > 0
    return summary.agg(F.count(F.lit(1)).alias("series"), F.count_if(ok).alias("ok"), F.sum(F.when(ok, F.col("n_clips"))).alias("clips"), F.sum(F.when(ok, F.col("total_clip_s"))).alias("seconds"))


def picks(df: DataFrame, condition, most: int = 8, key: str = "video", order: str = "frame") -> DataFrame:
    """At most `most` evenly spaced rows of each series that fulfil a condition: every kth, k = max(1, n div most)."""
    w = Window.partitionBy(key)
    rows = df.where(condition).withColumns({"rn": F.row_number().over(w.orderBy(order)) - 1, "n": F.count(F.lit(1)).over(w)})
    every = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / most))
    return rows.where((F.col("rn") % every == 0) & (F.floor(F.col("rn") / every) < most)).withColumn("pick", F.floor(F.col("rn") / every)).drop("rn", "n")
