"""Golden rows, a sequential restatement of the rules, edges of windows and intervals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanweave import params as P
from spanweave.functions.columns import clip_name, filter_escape, parse_duration, timecode, timecode_short
from spanweave.operators import attribute, catalog, classify, refine, report, segment
from spanweave.operators.pieces import in_pieces
from spanweave.plans import detect, stepwise
from spanweave.sources.samples import read_table, write_table

FIELDS = "video string, frame long, t double, det boolean, m_e5 long, sh_x double, sh_y double, sh_w double, hip_x double, hip_y double, torso double, vis_kne double, vis_ank double, vis_hip double, up_l double, up_r double, lat_l double, lat_r double, elb_l double, elb_r double, wv_l double, wv_r double, x15 double, y15 double, x16 double, y16 double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def row(video, i, m, **over):
    base = dict(video=video, frame=i, t=i * 3.0, det=True, m_e5=m, sh_x=0.5, sh_y=0.35, sh_w=0.15, hip_x=0.5, hip_y=0.6, torso=0.4, vis_kne=0.0, vis_ank=0.0, vis_hip=0.0, up_l=0.2, up_r=0.1, lat_l=0.3, lat_r=0.3, elb_l=90.0, elb_r=90.0, wv_l=0.9, wv_r=0.9, x15=0.40 + 0.004 * i, y15=0.3, x16=0.6, y16=0.3)
    return tuple((base | over)[n] for n in NAMES)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def golden(spark, legs):
    return frame_of(spark, [row("v", i, 25_000 if i < 5 else 8_000, **(dict(vis_kne=0.8, vis_ank=0.4) if legs and i >= 5 else {})) for i in range(11)])


@pytest.mark.parametrize("legs", [False, True])
def test_golden_rows(spark, legs):
    got = {r.frame: r for r in classify.classify(golden(spark, legs)).collect()}
    assert [got[i].m_roll3_e5 for i in range(11)] == [25000] * 4 + [19333, 13667] + [8000] * 5
    assert [got[i].base for i in range(11)] == [True] * 6 + [False] * 5
    assert [got[i].anchor for i in range(11)] == [True] * 6 + [False] * 5
    assert [got[i].near_anchor for i in range(11)] == [True] * 8 + [False] * 3
    assert [got[i].m_thr_e5 for i in range(11)] == ([7500] * 5 + [7000] * 3 if legs else [7500] * 8) + [9000] * 3
    assert [got[i].dance_raw for i in range(11)] == [True] * 8 + [False] * 3
    assert got[6].leg_vis == legs and got[6].relax_level == (P.RELAX_BOTH if legs else P.RELAX_NEAR)


@pytest.mark.parametrize(("end", "want"), [(None, 27.0), (33.0, 27.0), (22.0, 22.0), (0.0, 27.0)])
def test_golden_clip(spark, end, want):
    videos = spark.createDataFrame([("v", end)], "video string, duration_s double")
    plan = detect(golden(spark, False), videos=videos)
    # frames 0..7 are raised to 8 by smoothing only if two of three are set: 7 and 8 share one
    (b,) = plan["blocks"].collect()
    assert (b.a, b.b, b.dance_span_s, b.kept, b.clip_start_s) == (0, 7, 24.0, P.KEPT_YES, 0.0)
    assert b.clip_end_s == min(want, 24.0)
    assert {r.frame: r.clip_role for r in plan["result"].collect()} == {i: "dance" if i <= 7 else "none" for i in range(11)}
    (s,) = plan["summary"].collect()
    assert (s.n_frames, s.n_dance_frames, s.n_blocks, s.n_clips) == (11, 8, 1, 1)


def loop(rows, r=P.RULES):
    """The rules once more, one row after another."""
    rows = [dict(zip(NAMES, x, strict=True)) for x in rows]
    n, out = len(rows), []
    some = lambda *v: [x for x in v if x is not None]
    for i, x in enumerate(rows):
        up, lat, wv = max(some(x["up_l"], x["up_r"]), default=-9), max(some(x["lat_l"], x["lat_r"]), default=0), max(some(x["wv_l"], x["wv_r"]), default=0)
        el, er = x["elb_l"], x["elb_r"]
        elb = 999 if el is None else min(el, er)
        stand = x["sh_y"] is not None and x["sh_y"] < r.shoulder_y and x["sh_w"] < r.shoulder_width
        leg = (x["vis_kne"] or 0) > r.knee or (x["vis_ank"] or -1) > r.ankle
        pose = (up > r.up or lat > r.lateral or (elb < r.elbow and up > r.elbow_up)) and wv > r.visible
        loose = (up > r.loose_up or lat > r.loose_lateral or (elb < r.loose_elbow and up > r.loose_elbow_up)) and wv > r.loose_visible
        move = 0.0
        if i and x["det"] and rows[i - 1]["det"]:
            p = rows[i - 1]
            move = max(math.dist((x[a], x[b]), (p[a], p[b])) for a, b in (("x15", "y15"), ("x16", "y16"))) / max(x["torso"], 1e-4)
        near = [rows[j]["m_e5"] for j in range(max(0, i - 1), min(n, i + 2))]
        roll = math.floor(sum(near) / len(near) + 0.5)
        hand = pose or move > r.wrist_move
        base = (stand or leg) and hand and roll > r.motion_e5
        out.append(dict(stance=stand or leg, leg=leg, hand=hand, loose=loose, roll=roll, base=base, anchor=base and roll > r.motion_anchor_e5))
    for i, x in enumerate(out):
        near = any(y["anchor"] for y in out[max(0, i - r.near) : i + r.near + 1])
        limit = r.motion_leg_e5 if near and x["leg"] else r.motion_near_e5 if near else r.motion_e5
        x["raw"] = x["base"] or (x["stance"] and (x["hand"] or near and x["loose"]) and x["roll"] > limit)
    for i, x in enumerate(out):
        part = [y["raw"] for y in out[max(0, i - 1) : i + 2]]
        x["dance"] = sum(part) / len(part) >= 0.34
    blocks = []
    for i, x in enumerate(out):
        if x["dance"]:
            if blocks and (i - blocks[-1][1] - 1) * r.step <= r.bridge_s:
                blocks[-1][1] = i
            else:
                blocks.append([i, i])
    return out, blocks


def noisy(video, n, seed):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        if rnd.random() < 0.1:
            rows.append(row(video, i, rnd.randint(0, 30_000), det=False, **{k: None for k in NAMES[5:]}))
        else:
            nan = lambda: float("nan") if rnd.random() < 0.1 else rnd.uniform(60, 160)
            rows.append(row(video, i, rnd.choice([0, 7_200, 8_000, 9_000, 9_002, 20_000]) if rnd.random() < 0.9 else rnd.randint(0, 30_000), sh_y=rnd.uniform(0.3, 0.5), sh_w=rnd.uniform(0.1, 0.33), vis_kne=rnd.random(), vis_ank=rnd.random() / 2, up_l=rnd.uniform(-1, 0), up_r=rnd.uniform(-1, 0), lat_l=rnd.random() * 0.6, lat_r=rnd.random() * 0.6, elb_l=nan(), elb_r=rnd.uniform(60, 160), wv_l=rnd.random(), wv_r=rnd.random(), x15=rnd.random(), y15=rnd.random()))
    return rows


def test_windows_equal_loop(spark):
    series = {f"v{k}": noisy(f"v{k}", n, k) for k, n in enumerate([0, 1, 2, 3, 40, 200, 333])}
    flags = classify.classify(frame_of(spark, [x for rows in series.values() for x in rows])).cache()
    got = {(r.video, r.frame): r for r in flags.collect()}
    found = {}
    for b in segment.blocks(flags).collect():
        found.setdefault(b.video, []).append([b.a, b.b])
    for v, rows in series.items():
        out, blocks = loop(rows)
        for i, x in enumerate(out):
            g = got[v, i]
            assert (g.base, g.anchor, g.dance_raw, g.dance, g.m_roll3_e5) == (x["base"], x["anchor"], x["raw"], x["dance"], x["roll"]), (v, i)
        assert sorted(found.get(v, [])) == blocks
    wider = {(r.video, r.frame) for r in classify.classify(frame_of(spark, [x for rows in series.values() for x in rows]), P.RULES.with_thresholds(0.06, 0.05)).where("dance_raw").collect()}
    assert {k for k, r in got.items() if r.dance_raw} <= wider


@pytest.mark.parametrize("rows", [2, 7, 1000])
def test_pieces_equal_whole(spark, rows):
    """Pieces shorter than the reach, pieces with borders at gaps, and one piece only."""
    df = frame_of(spark, noisy("a", 90, 5) + noisy("b", 3, 6) + [row(None, i, 20_000) for i in range(9)])
    for rules in (classify.classify, classify.classify_stepwise):
        whole, cut = rules(df), in_pieces(df, rules, classify.reach(), rows)
        assert cut.columns == whole.columns and cut.schema["video"].dataType == whole.schema["video"].dataType
        assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))
    assert in_pieces(df.limit(0), classify.classify, classify.reach(), rows).isEmpty()


def test_plan_in_pieces_and_stage(spark, tmp_path):
    df = frame_of(spark, noisy("a", 90, 5) + noisy("b", 40, 6))
    whole, cut = detect(df), detect(df, piece=10, stage=f"file://{tmp_path}/flags")
    for name, table in whole.items():
        assert sorted(map(repr, cut[name].collect())) == sorted(map(repr, table.collect())), name
    files = cut["result"].inputFiles()
    assert files and all(f.startswith(f"file://{tmp_path}/flags/") for f in files)


def flagged(spark, on, n):
    return spark.createDataFrame([("v", i, i in on) for i in range(n)], "video string, frame long, dance boolean")


@pytest.mark.parametrize(("on", "want"), [(set(), []), (set(range(9)), [(0, 8, 1)]), ({0, 10}, [(0, 10, 2)]), ({0, 11}, [(0, 0, 1), (11, 11, 1)]), (set(range(5, 13)), [(5, 12, 1)])])
def test_blocks(spark, on, want):
    got = sorted((b.a, b.b, b.n_parts) for b in segment.blocks(flagged(spark, on, 30)).collect())
    assert got == want
    kept = [(b.a, b.b) for b in segment.blocks(flagged(spark, on, 30)).where("is_kept").collect()]
    assert kept == [(a, b) for a, b, _ in want if b - a + 1 >= 8]


@pytest.mark.parametrize(("raw", "shrinking", "padded"), [([1], [1], [0]), ([1, 0], [1, 1], [0, 0]), ([1, 0, 0], [1, 0, 0], [0, 0, 0]), ([0, 1, 0], [1, 0, 1], [0, 0, 0]), ([1, 1, 0, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1])])
def test_smoothing(spark, raw, shrinking, padded):
    df = spark.createDataFrame([("v", i, bool(x)) for i, x in enumerate(raw)], "video string, frame long, dance_raw boolean")
    read = lambda d: [int(r.dance) for r in d.orderBy("frame").collect()]
    assert read(classify.smooth(df)) == shrinking
    assert read(classify.smooth_padded(df)) == padded


def test_roles(spark):
    on = set(range(4, 10)) | set(range(12, 16))
    f = flagged(spark, on, 30)
    got = attribute.roles(f, segment.clips(segment.blocks(f))).orderBy("frame").collect()
    assert [r.clip_role for r in got] == ["none"] * 3 + ["pre_pad"] + ["dance"] * 6 + ["bridge"] * 2 + ["dance"] * 4 + ["none"] * 14
    assert [r.clip_id for r in got] == [0] * 3 + [1] * 13 + [0] * 14


def test_stepwise_and_review(spark):
    plan = stepwise(frame_of(spark, noisy("v", 300, 5)))
    assert plan["result"].count() == 300
    assert plan["result"].where("dance and not reviewed").isEmpty()
    cuts = plan["candidates"].orderBy("start_frame").collect()
    assert all(b.start_frame - a.end_frame > 2 for a, b in zip(cuts, cuts[1:], strict=False))


def test_review_ends_are_inside(spark):
    f = flagged(spark, {1, 2, 3, 4}, 6)
    spans = spark.createDataFrame([("v", 6.0, 9.0)], "video string, start_s double, end_s double")
    assert [r.frame for r in attribute.reviewed(f, spans).where("dance").orderBy("frame").collect()] == [2, 3]


def test_refine(spark):
    b = spark.createDataFrame([("v", 1, 10.0, 20.0)], "video string, block long, start_s double, end_s double")
    t = refine.tasks(b)
    assert t.count() == 26 + 31
    gates = t.withColumn("gate", F.when(F.col("k") != 3, ((F.col("edge") == "s") & F.col("k").isin(-4, 1, 2)) | ((F.col("edge") == "e") & F.col("k").isin(-3, -2, 9))))
    (r,) = refine.refine(b, gates).collect()
    assert (r.refined_start, r.refined_end) == (11.0, 18.0)
    (r,) = refine.refine(b, t.withColumn("gate", F.lit(None).cast("boolean"))).collect()
    assert (r.refined_start, r.refined_end) == (10.0, 20.0)


def test_texts(spark):
    df = spark.createDataFrame([(12.0, 21.0, "x Duration: 01:02:03.50, y", "C:\\a.ttf"), (3599.999, 0.0, "none", "a")], "s double, e double, t string, p string")
    got = df.select(timecode(F.col("s")).alias("tc"), timecode_short(F.col("s")).alias("short"), clip_name(F.lit(1), F.col("s"), F.col("e")).alias("name"), parse_duration(F.col("t")).alias("d"), filter_escape(F.col("p")).alias("p")).collect()
    assert tuple(got[0]) == ("00:00:12.00", "00:00:12", "dance_01_000012-000021.mp4", 3723.5, "C\\:/a.ttf")
    assert (got[1].tc, got[1].short, got[1].d) == ("00:59:60.00", "00:59:59", 0.0)


def test_catalog(spark, tmp_path):
    for f in ("clipA.mp4", "clipB.MKV", "readme.txt", "sub/clipC.mov", "clips/x.mp4", ".hid/y.mp4"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    assert catalog.scan(catalog.list_files(spark, str(tmp_path))).count() == 2
    deep = catalog.output_place(catalog.scan(catalog.list_files(spark, str(tmp_path), True)))
    assert sorted(r.stem for r in deep.collect()) == ["clipA", "clipB", "clipC"]
    done = deep.where("stem = 'clipA'").select("outdir")
    assert sorted(r.stem for r in catalog.pending(deep, done).collect()) == ["clipB", "clipC"]
    assert catalog.pending(deep, deep).isEmpty()
    sub = deep.where("stem = 'clipC'").select(F.col("dir").alias("outdir"))
    assert sorted(r.stem for r in catalog.outside(deep, sub).collect()) == ["clipA", "clipB"]
    twice = spark.createDataFrame([("o/a", 1), ("o/a", 2), ("o/b", 3), ("o/a", 4)], "outdir string, id int")
    assert [r.place for r in catalog.unique_places(twice, ["id"]).orderBy("id").collect()] == ["o/a", "o/a_2", "o/b", "o/a_3"]


def test_tables_and_overrides(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "x")], "frame long, v double, s string")
    write_table(df.withColumn("more", F.lit(1)), str(tmp_path / "t"), ["frame", "v", "s"])
    back = sorted(read_table(spark, str(tmp_path / "t"), "frame long, v double, s string").collect())
    assert math.isnan(back[0].v) and tuple(back[1]) == (2, 0.5, "x")
    assert P.RULES.with_thresholds("0.08", -1).motion_near_e5 == 8000 and P.RULES.with_thresholds("0.08", -1).motion_leg_e5 == 0
    assert P.RULES.with_thresholds("bad", 0.05) == P.RULES and P.RULES.with_thresholds() == P.RULES


def test_manifest(spark):
    plan = detect(golden(spark, False))
    (m,) = report.manifest(plan["clips"]).collect()
    assert m.text.splitlines()[0].startswith("#  1  dance_01_000000-000024.mp4") and m.text.splitlines()[-1] == "file 'dance_01_000000-000024.mp4'"
    (o,) = plan["clips"].collect()
    assert (o.offset_s, o.offset_end_s) == (0.0, 24.0)
    assert report.summary_json(plan["summary"]).first().json.startswith("{")
