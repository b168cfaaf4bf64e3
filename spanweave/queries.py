"""Registered queries of the engine, and the same in DuckDB's SQL (oracle.py). Flags are 0 and 1, times are seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import pose
from .functions.columns import filter_escape, parse_duration, timecode, timecode_short
from .operators import attribute, catalog, classify, refine, report, segment, signals
from .operators.pieces import in_pieces
from .sources.samples import landmarks, read, sample_grid, samples


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return samples(read(spark, d, "events"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(_samples(spark, d))


def _stepwise(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify_stepwise(_samples(spark, d))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return landmarks(read(spark, d, "embeddings"))


def bits(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def e6(value: Column | str, name: str) -> Column:
    """A measure in millionths, so that last bits do not matter; null where undefined."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), F.floor(value * 1e6 + 0.5).cast("double")).alias(name)


def q_sample_grid(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("video")).agg(F.min(F.unix_timestamp("ts")).alias("first"), F.max(F.unix_timestamp("ts")).alias("last"))
    return sample_grid(e, "first", "last", 21_600, ["video"])


def q_arm_best(spark, d):
    df = signals.best_arms(_samples(spark, d))
    return df.select("video", "frame", e6("up_best", "up_best"), e6("lat_best", "lat_best"), e6("elb_min", "elb_min"), e6("wv_best", "wv_best"))


def q_stance_flags(spark, d):
    return classify.labels(_flags(spark, d)).select("video", "frame", *bits("is_standing", "leg_vis", "stance_ok"), "body_state")


def q_hand_flags(spark, d):
    return _flags(spark, d).select("video", "frame", *bits("hand_pose", "hand_pose_loose", "hand_move", "hand_dance"), "hand_state")


def q_wrist_displacement(spark, d):
    return _flags(spark, d).select("video", "frame", e6("d_wrist", "d_wrist"), *bits("hand_move"))


def q_displacements(spark, d):
    df = signals.displacements(_samples(spark, d))
    return df.select("video", "frame", *(e6(c, c) for c in ("d_sh", "d_hip", "d_wrist_l", "d_wrist_r", "d_wrist")))


def q_motion_roll3(spark, d):
    return signals.rolling_motion(_samples(spark, d)).select("video", "frame", "m_sum3", "m_count3", "m_roll3_e5")


def q_base_anchor_near(spark, d):
    return _flags(spark, d).select("video", "frame", *bits("active", "base", "anchor", "near_anchor"))


def q_relaxed_decision(spark, d):
    return _flags(spark, d).select("video", "frame", "m_thr_e5", "relax_level", *bits("relax_ok", "dance_raw"))


def q_flags_in_pieces(spark, d):
    flags = in_pieces(_samples(spark, d), classify.classify, classify.reach(), 20)
    return flags.select("video", "frame", "m_thr_e5", "relax_level", *bits("relax_ok", "dance_raw"))


def q_smooth_shrinking(spark, d):
    return _flags(spark, d).select("video", "frame", "raw_sum", "raw_count", *bits("dance"))


def q_smooth_zero_padded(spark, d):
    return _stepwise(spark, d).select("video", "frame", "raw_sum", *bits("dance"))


def q_dance_result(spark, d):
    flags = _flags(spark, d)
    out = attribute.roles(flags, segment.clips(segment.blocks(flags)))
    return out.select("video", "frame", "t", *bits("det", "leg_vis", "stance_ok", "is_standing", "hand_pose", "hand_pose_loose", "hand_move", "hand_dance", "active", "base", "anchor", "near_anchor", "relax_ok", "dance_raw", "dance"), "body_state", "hand_state", "relax_level", "m_e5", "m_roll3_e5", "m_thr_e5", "clip_id", "clip_role")


def q_runs(spark, d):
    return segment.runs(_flags(spark, d)).select("video", F.col("run_id").cast("long").alias("run_id"), "first", "last", "n")


def q_blocks(spark, d):
    return segment.blocks(_flags(spark, d)).select("video", "block", "a", "b", "dance_samples", "n_parts", "dance_span_s", "clip_start_s", "clip_end_s", "clip_dur_s", "kept")


def q_blocks_known_end(spark, d):
    s = _flags(spark, d)
    ends = s.groupBy("video").agg((F.count(F.lit(1)) * 3.0 - 4.5).alias("duration_s"))
    return segment.blocks(s, videos=ends).select("video", "block", "clip_start_s", "clip_end_s", "clip_dur_s", "kept")


def q_clips(spark, d):
    t = report.clip_table(segment.clips(segment.blocks(_flags(spark, d))))
    return t


def q_clip_roles(spark, d):
    s = _flags(spark, d)
    return attribute.roles(s, segment.clips(segment.blocks(s))).select("video", "frame", "clip_id", "clip_role")


def q_role_histogram(spark, d):
    return q_clip_roles(spark, d).groupBy("clip_role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("clip_id") > 0).alias("n_in_clip"))


def q_frames_per_clip(spark, d):
    return q_clip_roles(spark, d).where("clip_id > 0").groupBy("video", "clip_id").agg(F.count(F.lit(1)).alias("n"))


CANDIDATE = ["video", "start_frame", "end_frame", "n", "start_s", "end_s", "dur_s", "sum_is_standing", "sum_hand_pose", "sum_hand_move", "sum_m_e5", "sum_confidence_e3", "review"]


def q_candidates(spark, d):
    return segment.candidates(_stepwise(spark, d)).select(*CANDIDATE)


def q_merged_candidates(spark, d):
    return segment.merged_candidates(segment.candidates(_stepwise(spark, d)))


def q_review_overlay(spark, d):
    flags = _stepwise(spark, d)
    good = segment.candidates(flags).where("review = 'dance' and n >= 3")
    return attribute.reviewed(flags, good).select("video", "frame", *bits("dance_auto", "reviewed", "dance"), "review")


def q_reviewed_blocks(spark, d):
    flags = _stepwise(spark, d)
    good = segment.candidates(flags).where("review = 'dance' and n >= 3")
    return segment.blocks(attribute.reviewed(flags, good)).select("video", "block", "a", "b", "dance_samples", "n_parts", "kept")


def q_confidence(spark, d):
    return _stepwise(spark, d).select("video", "frame", "confidence_e3")


def q_refined_edges(spark, d):
    """Edges by the gate of the samples that cover each second around them."""
    blocks = segment.merged_candidates(segment.candidates(_stepwise(spark, d)))
    return refine.refine(blocks, refine.at_times(refine.tasks(blocks), refine.gate(_samples(spark, d))))


def q_refine_gate(spark, d):
    return refine.gate(_samples(spark, d)).select("video", "frame", *bits("gate"))


def q_compilation_offsets(spark, d):
    return report.offsets(q_clips(spark, d)).select("video", "clip", "file", "offset_s", "offset_end_s", "offset_tc", "offset_end_tc")


def q_manifest(spark, d):
    return report.manifest(q_clips(spark, d))


def q_commands(spark, d):
    return report.commands(q_clips(spark, d))


def q_run_summary(spark, d):
    s = _flags(spark, d)
    return report.run_summary(s, segment.blocks(s))


def q_kpis(spark, d):
    return report.kpis(_flags(spark, d))


def q_batch_summary(spark, d):
    return report.batch_summary(q_run_summary(spark, d))


def q_batch_rows(spark, d):
    """Every eleventh customer of the events has lost its samples."""
    series = read(spark, d, "events").select(F.col("user_id").alias("video"))
    return report.batch_rows(series, q_run_summary(spark, d).where("video % 11 != 3"))


def q_summary_round_trip(spark, d):
    return report.read_summary(report.summary_json(q_run_summary(spark, d)))


def q_triple_panels(spark, d):
    """Arrays of 64 values, of which some repeat their first third."""
    v = F.transform("embedding", lambda x: F.floor(x * 1000).cast("double"))
    first = F.slice(v, 1, 21)
    rows = read(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.concat(first, first, first)).otherwise(v).alias("v"))
    return rows.select("vec_id", signals.is_triple(F.col("v"), 12.0).cast("long").alias("triple"), F.size(signals.middle_third(F.col("v"))).cast("long").alias("width"))


def q_filter_escape(spark, d):
    return read(spark, d, "pages").select("page_id", filter_escape(F.concat(F.lit("C:\\data\\"), F.coalesce("url", F.lit("")))).alias("escaped"))


def q_catalog_outside(spark, d):
    """What does not lie below the directories of every fifth page, which hold results."""
    rows = catalog.scan(_paths(spark, d), (".html",))
    done = catalog.scan(_paths(spark, d).where("page_id % 5 = 0"), (".html",)).select(F.col("dir").alias("outdir"))
    return catalog.outside(rows, done).select("path", "dir")


def q_pick_samples(spark, d):
    return report.picks(_flags(spark, d), F.col("dance") & (F.col("m_e5") > 12_000)).select("video", "frame", "pick")


def q_pose_argmax(spark, d):
    people = _points(spark, d).withColumns({"frame": F.floor(F.col("vec_id") / 3), "person": F.col("vec_id") % 3})
    return pose.pick_person(people, ["frame"], "person", 32).select("frame", "person", e6("score", "score"))


def q_torso_arm_features(spark, d):
    p = F.col("points")
    cols = pose.arm_features(p) | pose.body_ratios(p)
    return _points(spark, d).select("vec_id", *(e6(c, n) for n, c in cols.items()))


def q_joint_angles(spark, d):
    cols = pose.joint_angles(F.col("points"))
    return _points(spark, d).select("vec_id", *(F.when(~F.isnan(c), F.floor(c * 1000 + 0.5).cast("double")).alias(n) for n, c in cols.items()))


def q_reliable_extent(spark, d):
    cols = pose.reliable_extent(F.col("points"))
    return _points(spark, d).select("vec_id", *(c.alias(n) if n == "n_rel" else e6(c, n) for n, c in cols.items()))


def _hands(spark, d):
    return _points(spark, d).select("vec_id", "label", *(c.alias(n) for n, c in pose.hand_shape(F.col("points")).items()))


def q_hand_shape(spark, d):
    return _hands(spark, d).select("vec_id", *(e6(n, n) for n in ("palm_open", "tip_spread", "pinch", "openness", "hand_size_px")))


def q_hand_shape_describe(spark, d):
    units = _hands(spark, d).select("label", F.floor(F.col("palm_open") * 1000 + 0.5).alias("v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return units.groupBy("label").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.floor(F.avg("v") * 1000 + 0.5).cast("long").alias("mean_e3"), F.floor(F.stddev_samp("v") * 1000 + 0.5).cast("long").alias("std_e3"))


def q_open_ratio(spark, d):
    return _hands(spark, d).groupBy("label").agg(F.count_if(F.col("openness") > 0.85).alias("n_open"), F.count(F.lit(1)).alias("n"))


def q_hand_window(spark, d):
    s = _samples(spark, d).where("det")
    return s.select("video", "frame", *(c.cast("long").alias(n) for n, c in pose.hand_window(F.col("x15"), F.col("y15"), F.col("torso") / 4, 640, 360, smallest=48).items()))


def q_array_motion(spark, d):
    out = signals.array_motion(read(spark, d, "embeddings"), "embedding", "label", "vec_id")
    return out.select("vec_id", e6("motion", "motion"))


def q_array_motion_crop(spark, d):
    out = signals.array_motion(read(spark, d, "embeddings"), "embedding", "label", "vec_id", 17, 32)
    return out.select("vec_id", e6("motion", "motion"))


def q_merge_pose_motion(spark, d):
    s = _samples(spark, d).select("video", "frame", "t", "det")
    m = signals.rolling_motion(_samples(spark, d)).where("frame % 5 != 3").select("video", "frame", "t", "m_e5", "m_roll3_e5")
    return attribute.merge_features(s, m, ["video", "frame"]).select("video", "frame", "t", *bits("det"), F.col("m_e5").cast("double").alias("m_e5"), F.col("m_roll3_e5").cast("double").alias("m_roll3_e5"))


def _paths(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))


def q_catalog_scan(spark, d):
    rows = catalog.scan(_paths(spark, d), (".html",))
    w = Window.partitionBy("dir_key").orderBy("base_key", "path")
    return catalog.output_place(rows).select("path", "dir", "stem", "outdir", F.row_number().over(w).cast("long").alias("place_in_dir"))


def q_catalog_pending(spark, d):
    rows = catalog.output_place(catalog.scan(_paths(spark, d), (".html",)))
    done = catalog.output_place(catalog.scan(_paths(spark, d).where("page_id % 5 = 0"), (".html",)))
    return catalog.pending(rows, done).select("path", "outdir")


def q_output_names(spark, d):
    rows = _paths(spark, d).withColumns(catalog.split_path(F.col("path")))
    rows = catalog.output_place(rows.withColumn("stem", F.substring("stem", 1, 1)), "out")
    return catalog.unique_places(rows, ["page_id"]).select("page_id", "place")


def q_timecodes(spark, d):
    t = F.col("t") + F.col("event_id") % 4 * 0.25 + 3500.0
    s = _samples(spark, d).withColumn("s", t)
    return s.select("video", "frame", timecode(F.col("s")).alias("tc"), timecode_short(F.col("s")).alias("short"), timecode_short(F.col("s"), "").alias("compact"))


def q_parse_duration(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("no length")).otherwise(F.concat(F.lit("  Duration: "), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("event_id") % 59).cast("string"), 2, "0"), F.lit(".50, start")))
    return read(spark, d, "events").select("event_id", parse_duration(text).alias("seconds"))


def q_order_sessions(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("video"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long").alias("day"), F.lit(True).alias("on")).distinct()
    return segment.islands(o, "on", 60, "video", "day").groupBy("video", F.col("block_id").cast("long").alias("block")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n"))


def q_supplier_islands(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("video"), F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long").alias("day"), F.lit(True).alias("on")).distinct()
    return segment.islands(li, "on", 3, "video", "day").groupBy("video", F.col("block_id").cast("long").alias("block")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("n_parts"))


def queries() -> dict:
    return {n[2:]: f for n, f in globals().items() if n.startswith("q_")}


