"""The registered queries once more, as DuckDB SQL over the same tables: what the DataFrame plans are checked against."""

from __future__ import annotations

from itertools import combinations

from .params import RULES as R
from .sources.samples import STAND_INS


def _features() -> str:
    out = []
    for name, (k, base, den) in STAND_INS.items():
        value = f"{base!r}::double + (event_id * {k} % 100) / {float(den)!r}::double"
        if name in ("elb_l", "elb_r"):
            value = f"case when event_id % {17 if name == 'elb_l' else 19} = 0 then 'nan'::double else {value} end"
        out.append(f"case when event_type <> 'error' then {value} end as {name}")
    return ",\n  ".join(out)


def _pose(up: float, lat: float, elb: float, elb_up: float, vis: float) -> str:
    return f"coalesce((up_best > {up}::double or lat_best > {lat}::double or (not isnan(elb_min) and elb_min < {elb}::double and up_best > {elb_up}::double)) and wv_best > {vis}::double, false)"


W = "over (partition by video order by frame)"
W3 = "over (partition by video order by frame rows between 1 preceding and 1 following)"
UP = "rows between unbounded preceding and current row"
DIST = "sqrt(({0} - lag({0}) {w}) * ({0} - lag({0}) {w}) + ({1} - lag({1}) {w}) * ({1} - lag({1}) {w}))"


def _move(x: str, y: str) -> str:
    return DIST.format(x, y, w=W)


#: Common steps, from events to blocks, for both sets of rules.
CHAIN = f"""
samples as (select user_id as video, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, event_id, event_type <> 'error' as det,
  coalesce(least(40000, 2 * round(value * 100)::bigint), 0) as m_e5,
  {_features()} from events),
timed as (select *, frame * 3.0::double as t from samples),
moved as (select *, {_move('x15', 'y15')} as mv15, {_move('x16', 'y16')} as mv16, {_move('sh_x', 'sh_y')} as mvsh, {_move('hip_x', 'hip_y')} as mvhip,
  det and coalesce(lag(det) {W}, false) as both_det, sum(m_e5) {W3} as m_sum3, count(m_e5) {W3} as m_count3 from timed),
best as (select *, coalesce(greatest(up_l, up_r), -9.0::double) as up_best, coalesce(greatest(lat_l, lat_r), 0.0::double) as lat_best, coalesce(greatest(wv_l, wv_r), 0.0::double) as wv_best,
  coalesce(case when isnan(elb_l) then elb_l when isnan(elb_r) then elb_l else least(elb_l, elb_r) end, 999.0::double) as elb_min,
  case when isnan(elb_l) then elb_r when isnan(elb_r) then elb_l else least(elb_l, elb_r) end as elb_skip,
  case when both_det then greatest(mv15, mv16) / greatest(torso, 1e-4) else 0.0::double end as d_wrist,
  greatest(mv15 / nullif(torso, 0.0), mv16 / nullif(torso, 0.0)) as d_wrist_step, mv15 / nullif(torso, 0.0) as d_wrist_l, mv16 / nullif(torso, 0.0) as d_wrist_r, mvsh / nullif(torso, 0.0) as d_sh, mvhip / nullif(torso, 0.0) as d_hip,
  floor(m_sum3 / m_count3::double + 0.5)::bigint as m_roll3_e5 from moved),
flags0 as (select *, coalesce(sh_y < {R.shoulder_y}::double and sh_w < {R.shoulder_width}::double, false) as is_standing, coalesce(vis_kne > {R.knee}::double, false) or coalesce(vis_ank > {R.ankle}::double, false) as leg_vis,
  {_pose(R.up, R.lateral, R.elbow, R.elbow_up, R.visible)} as hand_pose, {_pose(R.loose_up, R.loose_lateral, R.loose_elbow, R.loose_elbow_up, R.loose_visible)} as hand_pose_loose,
  d_wrist > {R.wrist_move}::double as hand_move, m_roll3_e5 > {R.motion_e5} as active from best),
flags1 as (select *, is_standing or leg_vis as stance_ok, hand_pose or hand_move as hand_dance,
  case when is_standing then '站立' when leg_vis then '露腿' else '非站立' end as body_state, case when hand_pose then '舞蹈姿态' when hand_pose_loose then '放宽姿态' when hand_move then '手部运动' else '静止' end as hand_state from flags0),
flags2 as (select *, stance_ok and hand_dance and active as base from flags1),
flags3 as (select *, base and m_roll3_e5 > {R.motion_anchor_e5} as anchor from flags2),
flags4 as (select *, max(anchor::int) over (partition by video order by frame rows between 2 preceding and 2 following) = 1 as near_anchor from flags3),
flags5 as (select *, case when near_anchor and leg_vis then {R.motion_leg_e5} when near_anchor then {R.motion_near_e5} else {R.motion_e5} end::bigint as m_thr_e5,
  case when near_anchor and leg_vis then '露腿+舞蹈邻域' when near_anchor then '舞蹈邻域' when leg_vis then '露腿' else '无' end as relax_level from flags4),
flags6 as (select *, stance_ok and (hand_dance or (near_anchor and hand_pose_loose)) and m_roll3_e5 > m_thr_e5 as relax_ok from flags5),
flags7 as (select *, base or relax_ok as dance_raw from flags6),
flags8 as (select *, sum(dance_raw::int) {W3}::bigint as raw_sum, count(*) {W3} as raw_count from flags7),
flags as (select *, 100 * raw_sum >= 34 * raw_count as dance from flags8),
step0 as (select * exclude (elb_min, d_wrist, hand_pose, hand_move, hand_dance, active), coalesce((up_best > {R.up}::double or lat_best > {R.lateral}::double or (not coalesce(isnan(elb_skip), true) and elb_skip < {R.elbow}::double and up_best > {R.elbow_up}::double)) and wv_best > {R.visible}::double, false) as hand_pose,
  coalesce(d_wrist_step > {R.wrist_move}::double, false) as hand_move, m_sum3 > {R.motion_e5} * m_count3 as active from flags1),
step1 as (select *, hand_pose or hand_move as hand_dance from step0),
step2 as (select *, sum((is_standing and hand_dance and active)::int) {W3}::bigint as raw_sum from step1),
stepwise as (select *, raw_sum >= 2 as dance, case when raw_sum >= 2 then least(1000, floor((55 * [0, 333, 667, 1000][raw_sum + 1] + 25000 * is_standing::int + 20000 * hand_dance::int + 50) / 100))::bigint else 0 end as confidence_e3 from step2)
"""


def islands(source: str, limit: float, name: str, order: str = "frame") -> str:
    return f"""{name}_gap as (select video, {order}, {order} - lag({order}) over (partition by video order by {order}) - 1 as missing from {source}),
{name} as (select *, sum(case when missing is null or missing > 0 then 1 else 0 end) over (partition by video order by {order} {UP})::bigint as run_id,
  sum(case when missing is null or missing > {limit} then 1 else 0 end) over (partition by video order by {order} {UP})::bigint as block_id from {name}_gap)"""


def blocks(source: str, end: str = "(b + 1) * 3.0::double", extra: str = "") -> str:
    return f"""{islands(f"(select * from {source} where dance)", 9, 'isl')},
parts as (select video, block_id, run_id, min(frame) as a, max(frame) as b, count(*) as n from isl group by all),
grouped as (select video, block_id as block, min(a) as a, max(b) as b, sum(n)::bigint as dance_samples, count(*) as n_parts from parts group by video, block_id),
bounded as (select grouped.*, (b - a + 1) * 3.0::double as dance_span_s, greatest(0.0::double, (a - 1) * 3.0::double) as clip_start_s, {end} as clip_end_s from grouped {extra}),
blocks as (select *, clip_end_s - clip_start_s as clip_dur_s, dance_span_s >= 24 as is_kept, case when dance_span_s >= 24 then '是' else '否' end as kept from bounded),
clips as (select *, row_number() over (partition by video order by a) as clip from blocks where is_kept)"""


def hms(s: str, form: str = "%02d:%02d:%05.2f", last: str | None = None) -> str:
    return f"printf('{form}', floor({s} / 3600)::bigint, floor({s} % 3600 / 60)::bigint, {last or f'({s} % 60)::double'})"


def short(s: str, sep: str = ":") -> str:
    return hms(s, sep.join(["%02d"] * 3), f"floor({s} % 60)::bigint")


CLIP_TABLE = f"""clip_table as (select video, clip, printf('dance_%02d', clip) || '_' || {short('clip_start_s', '')} || '-' || {short('clip_end_s', '')} || '.mp4' as file,
  {short('clip_start_s')} as src_start, {short('clip_end_s')} as src_end, clip_start_s as start_s, clip_end_s as end_s, clip_dur_s, {hms('clip_start_s')} as start_tc, {hms('clip_end_s')} as end_tc, dance_span_s, a as first_dance_frame, b as last_dance_frame from clips)"""
SPANS = """spans as (select *, round_even(clip_start_s / 3, 0)::bigint as fa, round_even(clip_end_s / 3, 0)::bigint as fb from clips)"""
ROLES = """role_rows as (select f.*, coalesce((select max(clip) from spans s where s.video = f.video and f.frame >= s.fa and f.frame < s.fb), 0) as clip_id,
  case when exists (select 1 from spans s where s.video = f.video and f.frame between s.a and s.b) then case when dance then 'dance' else 'bridge' end
       when exists (select 1 from spans s where s.video = f.video and f.frame >= s.fa and f.frame < s.a) then 'pre_pad' else 'none' end as clip_role from flags f)"""
CANDIDATES = f"""{islands("(select * from stepwise where dance)", 1, 'ci')},
found as (select video, min(frame) as start_frame, max(frame) as end_frame from ci group by video, block_id having max(frame) - min(frame) + 1 >= 2),
candidates as (select f.video, start_frame, end_frame, count(*) as n, sum(is_standing::int)::bigint as sum_is_standing, sum(hand_pose::int)::bigint as sum_hand_pose, sum(hand_move::int)::bigint as sum_hand_move, sum(m_e5)::bigint as sum_m_e5, sum(confidence_e3)::bigint as sum_confidence_e3,
  start_frame * 3.0::double - 1.5 as start_s, end_frame * 3.0::double + 1.5 as end_s, count(*) * 3.0::double as dur_s, case when start_frame * 3.0::double - 1.5 <= 5700 then 'dance' else 'rejected:seated' end as review
  from found f join stepwise s on f.video = s.video and s.frame between start_frame and end_frame group by f.video, start_frame, end_frame)"""
MERGED = f"""{CANDIDATES},
mi as (select *, max(end_s) over (partition by video order by start_s, end_s rows between unbounded preceding and 1 preceding) as last_end from candidates where review = 'dance'),
mb as (select *, sum(case when last_end is null or start_s - last_end > 15 then 1 else 0 end) over (partition by video order by start_s, end_s {UP})::bigint as block from mi),
merged as (select video, block, min(start_s) as start_s, max(end_s) as end_s, count(*) as parts, sum(floor(sum_confidence_e3 / n::double + 0.5))::bigint as sum_conf_e3, sum(floor(sum_m_e5 / n::double / 10 + 0.5))::bigint as sum_motion_e4, max(end_s) - min(start_s) as dur_s from mb group by video, block)"""
REVIEW = f"""{CANDIDATES},
rev0 as (select s.*, exists (select 1 from candidates c where c.video = s.video and c.review = 'dance' and c.n >= 3 and s.t between c.start_s and c.end_s) as reviewed from stepwise s),
rev as (select * exclude (dance), dance as dance_auto, dance and reviewed as dance from rev0)"""


def chain(select: str, *more: str) -> str:
    return "with " + ",\n".join([CHAIN, *more]) + "\n" + select


def bits(*names: str) -> str:
    return ", ".join(f"{n}::bigint as {n}" for n in names)


def e6(value: str, name: str) -> str:
    return f"case when not isnan({value}) then floor(({value}) * 1e6 + 0.5) end as {name}"


# Landmark arrays: point i is (components 2i and 2i + 1), DuckDB's lists count from 1.
def px(i: int) -> str:
    return f"e[{2 * i + 1}]"


def py(i: int) -> str:
    return f"e[{2 * i + 2}]"


def pv(i: int) -> str:
    return f"least(1.0::double, abs(e[{i + 1}]) * 4)"


EMB = "emb as (select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings)"


def dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def span(i: int, j: int) -> str:
    return dist(px(i), py(i), px(j), py(j))


def mid(i: int, j: int, f) -> str:
    return f"(({f(i)} + {f(j)}) / 2)"


TORSO = f"greatest({dist(mid(11, 12, px), mid(11, 12, py), mid(23, 24, px), mid(23, 24, py))}, 1e-4)"


def angle(a: int, b: int, c: int) -> str:
    n1, n2 = span(a, b), span(c, b)
    cosine = f"((({px(a)} - {px(b)}) * ({px(c)} - {px(b)}) + ({py(a)} - {py(b)}) * ({py(c)} - {py(b)})) / ({n1} * {n2}))"
    return f"case when {n1} < 1e-6 or {n2} < 1e-6 then 'nan'::double else degrees(acos(greatest(-1.0::double, least(1.0::double, {cosine})))) end"


def _arms() -> str:
    out = []
    for s, (sh, el, wr) in {"l": (11, 13, 15), "r": (12, 14, 16)}.items():
        out += [e6(f"({py(sh)} - {py(wr)}) / {TORSO}", f"up_{s}"), e6(f"abs({px(wr)} - {mid(11, 12, px)}) / {TORSO}", f"lat_{s}"), e6(f"{span(sh, wr)} / {TORSO}", f"armlen_{s}"), e6(f"least({pv(sh)}, {pv(el)}, {pv(wr)})", f"wv_{s}")]
    sh, hip, knee, ankle = (mid(i, i + 1, py) for i in (11, 23, 25, 27))
    out += [e6(f"{hip} - {sh}", "torso_up"), e6(f"abs({ankle} - {hip}) / {TORSO}", "leg_ratio"), e6(f"({ankle} - {hip}) / {TORSO}", "ank_below_hip"), e6(f"({hip} - {sh}) / {TORSO}", "hip_below_sh"), e6(f"({knee} - {hip}) / {TORSO}", "knee_below_hip")]
    return ", ".join([*out, *(e6(f"least({pv(i)}, {pv(i + 1)})", n) for n, i in (("vis_kne", 25), ("vis_ank", 27), ("vis_hip", 23)))])


def _angles() -> str:
    e3 = lambda v, n, c="true": f"case when {c} and not isnan({v}) then floor(({v}) * 1000 + 0.5) end as {n}"
    return ", ".join([e3(angle(11, 13, 15), "elb_l"), e3(angle(12, 14, 16), "elb_r"), e3(angle(23, 25, 27), "knee_l", f"{pv(25)} > 0.4::double"), e3(angle(24, 26, 28), "knee_r", f"{pv(26)} > 0.4::double")])


TIPS = (4, 8, 12, 16, 20)
_palm = [f"(({f(0)} + {f(5)} + {f(17)}) / 3.0::double)" for f in (px, py)]
_size = f"greatest({span(0, 9)}, 1e-4)"
HANDS = f"""{EMB}, h0 as (select vec_id, label, {_size} as hs, ({' + '.join(dist(px(t), py(t), *_palm) for t in TIPS)}) / 5.0::double / {_size} as palm_open,
  ({' + '.join(span(a, b) for a, b in combinations(TIPS, 2))}) / 10.0::double / {_size} as tip_spread, {span(4, 8)} / {_size} as pinch from emb),
hand as (select *, 0.6::double * palm_open + 0.4::double * tip_spread as openness, hs * 256 as hand_size_px from h0)"""
SCORE = f"(({pv(11)} + {pv(12)} + {pv(23)} + {pv(24)}) / 4.0::double - 0.35::double * abs(list_reduce([0.0::double, {', '.join(px(i) for i in range(32))}], lambda a, b: a + b) / 32.0::double - 0.5))"
EXTENT = f"list_filter([{', '.join(f'{{y: {py(i)}, v: {pv(i)}}}' for i in range(32))}], lambda p: p.v > 0.5::double)"
PATHS = "paths as (select page_id, regexp_replace(url, '[?#].*$', '') as path from pages)"
CATALOG = f"""{PATHS}, cat0 as (select distinct path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '([^/]*)$', 1) as base from paths{{where}}),
cat as (select *, regexp_replace(base, '(.)\\.[^.]*$', '\\1') as stem from cat0 where ends_with(lower(base), '.html')
  and not list_bool_or(list_transform(string_split(regexp_replace(dir, '^[a-z]+:/*', ''), '/'), lambda d: lower(d) in ('frames', 'clips', '_internal', 'logs', '__pycache__', '.build', 'output') or starts_with(d, '.') and d not in ('.', '..'))))"""


def motion(a: int, n: int) -> str:
    return f"""with emb as (select vec_id, label, list_slice(list_transform(embedding, lambda v: v::double), {a}, {a + n - 1}) as e from embeddings),
was as (select vec_id, e, lag(e) over (partition by label order by vec_id) as p from emb),
m as (select vec_id, case when p is null then 0.0::double else list_reduce(list_concat([0.0::double], list_transform(list_zip(e, p), lambda z: abs(z[1] - z[2]))), lambda x, y: x + y) / len(e) end as motion from was)
select vec_id, {e6('motion', 'motion')} from m"""


def gap_days(table: str, key: str, date: str, limit: int, more: str = "") -> str:
    return f"""with src as (select distinct {key} as video, date_diff('day', date '1990-01-01', {date}::date) as day from {table}), {islands('src', limit, 'isl', 'day')}
select video, block_id as block, min(day) as first, max(day) as last, count(*) as n{more} from isl group by video, block_id"""


WINDOW = "greatest(0, least({n}, floor(({v}) * {n})))::bigint"
_half = "greatest(0.11::double, least(0.22::double, 1.4::double * (torso / 4)))"
_box = {f"{a}{i}": WINDOW.format(n=n, v=f"{c} {'-' if i == 0 else '+'} {_half}") for a, c, n in (("x", "x15", 640), ("y", "y15", 360)) for i in (0, 1)}

OFFSETS = "offs as (select *, coalesce(sum(clip_dur_s) over (partition by video order by clip rows between unbounded preceding and 1 preceding), 0.0::double) as offset_s from clip_table)"
SUMMARY = """summary as (select f.video, n_frames, n_dance_frames, coalesce(n_blocks, 0) as n_blocks, coalesce(n_clips, 0) as n_clips, coalesce(total_clip_s, 0.0::double) as total_clip_s, 3.0::double as step_s, 27.0::double as bridge_s, 24.0::double as min_dance_s
  from (select video, count(*) as n_frames, count_if(dance)::bigint as n_dance_frames from flags group by video) f left join (select video, count(*) as n_blocks, count_if(is_kept)::bigint as n_clips, sum(case when is_kept then clip_dur_s else 0.0::double end) as total_clip_s from blocks group by video) b on f.video = b.video)"""
#: The gate has its own elbow rule: an undefined angle is passed over.
GATED = f"""elbows as (select * exclude (elb_min), least(case when isnan(elb_l) then 999.0::double else coalesce(elb_l, 999.0::double) end, case when isnan(elb_r) then 999.0::double else coalesce(elb_r, 999.0::double) end) as elb_min from best),
gated as (select video, frame, coalesce(sh_y < {R.shoulder_y}::double and sh_w < {R.shoulder_width}::double, false) and {_pose(R.up, R.lateral, R.elbow, R.elbow_up, R.visible)} as gate from elbows)"""
REFINE = f"""{MERGED}, {GATED},
tasks as (select video, block, edge, k, base_t + k as t from (select video, block, 's' as edge, start_s as base_t from merged union all select video, block, 'e', end_s from merged), (select unnest(range(-15, 16)) as k) where base_t + k >= 0),
gates as (select tasks.*, coalesce(gated.gate, false) as g from tasks left join gated on tasks.video = gated.video and floor(t / 3.0::double) = gated.frame),
pairs as (select *, g and coalesce(lead(g) over w, false) as opens, g and coalesce(lag(g) over w, false) as closes from gates window w as (partition by video, block, edge order by k)),
edges as (select video, block, min_by(t, k) filter (edge = 's' and opens) as new_s, max_by(t, k) filter (edge = 'e' and closes) as new_e from pairs group by video, block)"""

SQL: dict[str, str] = {
    "sample_grid": "select user_id as video, frame, f + frame * 21600 as t from (select user_id, f, unnest(range(0, (l - f) // 21600 + 1)) as frame from (select user_id, min(floor(epoch(ts)))::bigint as f, max(floor(epoch(ts)))::bigint as l from events group by user_id))",
    "arm_best": chain(f"select video, frame, {e6('up_best', 'up_best')}, {e6('lat_best', 'lat_best')}, {e6('elb_min', 'elb_min')}, {e6('wv_best', 'wv_best')} from best"),
    "stance_flags": chain(f"select video, frame, {bits('is_standing', 'leg_vis', 'stance_ok')}, body_state from flags"),
    "hand_flags": chain(f"select video, frame, {bits('hand_pose', 'hand_pose_loose', 'hand_move', 'hand_dance')}, hand_state from flags"),
    "wrist_displacement": chain(f"select video, frame, {e6('d_wrist', 'd_wrist')}, {bits('hand_move')} from flags"),
    "displacements": chain("select video, frame, " + ", ".join(e6(c, n) for c, n in (("d_sh", "d_sh"), ("d_hip", "d_hip"), ("d_wrist_l", "d_wrist_l"), ("d_wrist_r", "d_wrist_r"), ("d_wrist_step", "d_wrist"))) + " from best"),
    "motion_roll3": chain("select video, frame, m_sum3::bigint as m_sum3, m_count3, m_roll3_e5 from best"),
    "base_anchor_near": chain(f"select video, frame, {bits('active', 'base', 'anchor', 'near_anchor')} from flags"),
    "relaxed_decision": chain(f"select video, frame, m_thr_e5, relax_level, {bits('relax_ok', 'dance_raw')} from flags"),
    "flags_in_pieces": chain(f"select video, frame, m_thr_e5, relax_level, {bits('relax_ok', 'dance_raw')} from flags"),
    "smooth_shrinking": chain(f"select video, frame, raw_sum, raw_count, {bits('dance')} from flags"),
    "smooth_zero_padded": chain(f"select video, frame, raw_sum, {bits('dance')} from stepwise"),
    "dance_result": chain("select video, frame, t, " + bits("det", "leg_vis", "stance_ok", "is_standing", "hand_pose", "hand_pose_loose", "hand_move", "hand_dance", "active", "base", "anchor", "near_anchor", "relax_ok", "dance_raw", "dance") + ", body_state, hand_state, relax_level, m_e5, m_roll3_e5, m_thr_e5, clip_id, clip_role from role_rows", blocks("flags"), SPANS, ROLES),
    "runs": chain("select video, run_id, min(frame) as first, max(frame) as last, count(*) as n from isl group by video, run_id", blocks("flags")),
    "blocks": chain("select video, block, a, b, dance_samples, n_parts, dance_span_s, clip_start_s, clip_end_s, clip_dur_s, kept from blocks", blocks("flags")),
    "blocks_known_end": chain("select video, block, clip_start_s, clip_end_s, clip_dur_s, kept from blocks", blocks("flags", "case when d > 0 then least(d, (b + 1) * 3.0::double) else (b + 1) * 3.0::double end", "join (select video as v, count(*) * 3.0::double - 4.5 as d from flags group by video) on video = v")),
    "clips": chain("select * from clip_table", blocks("flags"), CLIP_TABLE),
    "clip_roles": chain("select video, frame, clip_id, clip_role from role_rows", blocks("flags"), SPANS, ROLES),
    "role_histogram": chain("select clip_role, count(*) as n, count_if(clip_id > 0)::bigint as n_in_clip from role_rows group by clip_role", blocks("flags"), SPANS, ROLES),
    "frames_per_clip": chain("select video, clip_id, count(*) as n from role_rows where clip_id > 0 group by video, clip_id", blocks("flags"), SPANS, ROLES),
    "candidates": chain("select * from candidates", CANDIDATES),
    "merged_candidates": chain("select * from merged", MERGED),
    "review_overlay": chain(f"select video, frame, {bits('dance_auto', 'reviewed', 'dance')}, case when reviewed then 'dance' else 'excluded:seated' end as review from rev", REVIEW),
    "reviewed_blocks": chain("select video, block, a, b, dance_samples, n_parts, kept from blocks", REVIEW, blocks("rev")),
    "confidence": chain("select video, frame, confidence_e3 from stepwise"),
    "refined_edges": chain("select m.video, m.block, start_s as orig_start, end_s as orig_end, coalesce(new_s, start_s) as refined_start, coalesce(new_e, end_s) as refined_end, coalesce(new_e, end_s) - coalesce(new_s, start_s) as dur_s from merged m left join edges e on m.video = e.video and m.block = e.block", REFINE),
    "refine_gate": chain("select video, frame, gate::bigint as gate from gated", GATED),
    "batch_rows": chain("select v.video, coalesce(s.n_clips, 0)::bigint as clips, coalesce(s.total_clip_s, 0.0::double) as seconds, (coalesce(s.n_frames, 0) > 0)::bigint as ok, case when coalesce(s.n_frames, 0) = 0 then 'no samples' end as err from (select distinct user_id as video from events) v left join (select * from summary where video % 11 <> 3) s on v.video = s.video", blocks("flags"), SUMMARY),
    "summary_round_trip": chain("select * from summary", blocks("flags"), SUMMARY),
    "triple_panels": "with e as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1000)) as w from embeddings), f as (select vec_id, case when vec_id % 4 = 0 then w[1:21] || w[1:21] || w[1:21] else w end as v from e) select vec_id, (list_avg(list_transform(range(1, 2 * (len(v) // 3) + 1), lambda i: abs(v[i] - v[i + len(v) // 3]))) < 12)::bigint as triple, len(v) // 3 as width from f",
    "filter_escape": "select page_id, replace(replace('C:\\data\\' || coalesce(url, ''), '\\', '/'), ':', '\\:') as escaped from pages",
    "catalog_outside": f"with {CATALOG.format(where='')}, done as (select distinct dir as d from ({'with ' + CATALOG.format(where=' where page_id % 5 = 0')} select * from cat)) select path, dir from cat where not exists (select 1 from done where dir = d or starts_with(dir, d || '/'))",
    "compilation_offsets": chain(f"select video, clip, file, offset_s, offset_s + clip_dur_s as offset_end_s, {short('offset_s')} as offset_tc, {short('(offset_s + clip_dur_s)')} as offset_end_tc from offs", blocks("flags"), CLIP_TABLE, OFFSETS),
    "manifest": chain("select video, string_agg(printf('# %2d  %-30s  %s - %s  (%.1fs)', clip, file, src_start, src_end, clip_dur_s), chr(10) order by clip) || chr(10) || chr(10) || string_agg('file ''' || file || '''', chr(10) order by clip) as text from clip_table group by video", blocks("flags"), CLIP_TABLE),
    "commands": chain("select video, clip, printf('-ss %.3f -t %.3f', start_s, clip_dur_s) as arguments, file from clip_table", blocks("flags"), CLIP_TABLE),
    "run_summary": chain("select * from summary", blocks("flags"), SUMMARY),
    "kpis": chain("select count(*) as n, " + ", ".join(f"count_if({f})::bigint as n_{f}" for f in ("dance", "dance_raw", "base", "anchor", "leg_vis", "stance_ok", "is_standing", "hand_dance")) + " from flags"),
    "batch_summary": chain("select count(*) as series, count_if(n_frames > 0)::bigint as ok, sum(n_clips)::bigint as clips, sum(total_clip_s) as seconds from summary", blocks("flags"), SUMMARY),
    "pick_samples": chain("select video, frame, rn // every as pick from (select video, frame, rn, greatest(1, n // 8) as every from (select video, frame, row_number() over (partition by video order by frame) - 1 as rn, count(*) over (partition by video) as n from flags where dance and m_e5 > 12000)) where rn % every = 0 and rn // every < 8"),
    "pose_argmax": f"with {EMB}, sc as (select vec_id // 3 as frame, vec_id % 3 as person, {SCORE} as score from emb) select frame, person, {e6('score', 'score')} from (select *, row_number() over (partition by frame order by score desc, person) as k from sc where score > -9) where k = 1",
    "torso_arm_features": f"with {EMB} select vec_id, {_arms()} from emb",
    "joint_angles": f"with {EMB} select vec_id, {_angles()} from emb",
    "reliable_extent": f"with {EMB}, v as (select vec_id, list_transform({EXTENT}, lambda p: p.y) as ys from emb) select vec_id, {e6('list_min(ys)', 'vis_top')}, {e6('list_max(ys)', 'vis_bot')}, {e6('list_max(ys) - list_min(ys)', 'vis_span')}, len(ys) as n_rel from v",
    "hand_shape": f"with {HANDS} select vec_id, " + ", ".join(e6(n, n) for n in ("palm_open", "tip_spread", "pinch", "openness", "hand_size_px")) + " from hand",
    "hand_shape_describe": f"with {HANDS}, u as (select label, floor(palm_open * 1000 + 0.5)::bigint as v from hand) select label, count(v) as n, sum(v)::bigint as total, min(v) as least, max(v) as most, quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as q50, quantile_cont(v, 0.75) as q75, floor(avg(v) * 1000 + 0.5)::bigint as mean_e3, floor(stddev_samp(v) * 1000 + 0.5)::bigint as std_e3 from u group by label",
    "open_ratio": f"with {HANDS} select label, count_if(openness > 0.85::double)::bigint as n_open, count(*) as n from hand group by label",
    "hand_window": chain("select video, frame, " + ", ".join(f"{v} as {n}" for n, v in _box.items()) + f", ({_box['x1']} - {_box['x0']} >= 48 and {_box['y1']} - {_box['y0']} >= 48)::bigint as ok from samples where det"),
    "array_motion": motion(1, 64),
    "array_motion_crop": motion(17, 32),
    "merge_pose_motion": chain("select s.video, s.frame, s.t, s.det::bigint as det, m.m_e5::double as m_e5, m.m_roll3_e5::double as m_roll3_e5 from timed s left join (select * from best where frame % 5 <> 3) m on s.video = m.video and s.frame = m.frame"),
    "catalog_scan": f"with {CATALOG.format(where='')} select path, dir, stem, dir || '/' || stem as outdir, row_number() over (partition by lower(dir) order by lower(base), path) as place_in_dir from cat",
    "catalog_pending": f"with {CATALOG.format(where='')}, done as (select distinct dir || '/' || stem as outdir from ({'with ' + CATALOG.format(where=' where page_id % 5 = 0')} select * from cat)) select path, dir || '/' || stem as outdir from cat where dir || '/' || stem not in (select outdir from done)",
    "output_names": f"with {PATHS}, o as (select page_id, 'out/' || substr(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), 1, 1) as outdir from paths), n as (select *, row_number() over (partition by outdir order by page_id) as k from o) select page_id, case when k > 1 then outdir || '_' || k else outdir end as place from n",
    "timecodes": chain(f"select video, frame, {hms('s')} as tc, {short('s')} as short, {short('s', '')} as compact from (select *, t + event_id % 4 * 0.25::double + 3500.0::double as s from timed)"),
    "parse_duration": "select event_id, case when event_id % 7 = 0 then 0.0::double else (event_id % 24) * 3600.0::double + (event_id % 60) * 60.0::double + (event_id % 59) + 0.5::double end as seconds from events",
    "order_sessions": gap_days("orders", "o_custkey", "o_orderdate", 60),
    "supplier_islands": gap_days("lineitem", "l_suppkey", "l_shipdate", 3, ", count(distinct run_id) as n_parts"),
}
