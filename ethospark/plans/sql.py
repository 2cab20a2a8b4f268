"""The registered queries as SQL for an independent engine, on the same tables."""

from __future__ import annotations

from .views import BOXES, DOMAIN, GREY, LABELS, METADATA, OBS

ENTERED = """
ent as (select *, coalesce(prev <> behaviour, false) as entered from (select *, lag(behaviour) over (partition by video_filename, track_id order by frame, row_no) as prev from obs))"""
TRACKS = f"""{OBS},{ENTERED},{METADATA},
tr0 as (select video_filename, track_id, count(*) as n, min(frame) as f0, max(frame) as f1, arg_min(x, (frame, row_no)) as x, arg_min(y, (frame, row_no)) as y,
  {", ".join(f"count(*) filter (behaviour = '{b}') as n_{b}, count(*) filter (behaviour = '{b}' and entered) as t_{b}" for b in DOMAIN)} from ent group by 1, 2),
tr1 as (select tr0.*, n / greatest(max(f1) over (partition by tr0.video_filename), 1) as presence, coalesce(group_id, '') as group_id,
  coalesce(nullif(group_type, ''), split_part(tr0.video_filename, '_', 5)) as group_type, coalesce(list_contains(excluded, track_id), false) as manual,
  x < 288 or x > 1632 or y < 162 or y > 918 as border from tr0 left join meta using (video_filename)),
tr as (select *, presence < 0.045 as short from tr1)"""
KIND = "case when manual or short then 'stranger' else 'group_member' end"
REASON = "case when manual then 'manual_exclude' when short and border then 'short_presence+border_entry' when short then 'short_presence' else '' end"


def top(prefix: str) -> str:
    rows = ", ".join(f"{{'v': -{prefix}_{b}, 'b': '{b}'}}" for b in DOMAIN)
    return f"list_min([{rows}]).b"


def tc(frame: str, fps: str = "30") -> str:
    s = f"(({frame}) // {fps})"
    return f"concat(case when {s} < 6000 then lpad(({s} // 60)::varchar, 2, '0') else ({s} // 60)::varchar end, ':', lpad(({s} % 60)::varchar, 2, '0'))"


def overlap(a: str, b: str) -> str:
    w = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = f"least(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1), ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1))"
    return f"case when {area} > 0 then ({w} * {h})::double / {area} else 0.0::double end"


def dist(a: str, b: str) -> str:
    c = lambda t, p: f"floor(({t}.{p}1 + {t}.{p}2) / 2)"
    return f"sqrt(({c(a, 'x')} - {c(b, 'x')}) ** 2 + ({c(a, 'y')} - {c(b, 'y')}) ** 2)"


def lagged(k: int) -> str:
    return f"coalesce(lag(px, {k}) over w, first_value(px) over w)"


def join(c: str) -> str:
    return f"array_to_string({c}, ',')"


def absdiff(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))"


SEQ = f"""{GREY}, seq as (select video, frame, px, {", ".join(absdiff("px", lagged(k)) + f" as d{k - 1}" for k in (1, 2, 3))} from grey window w as (partition by video order by frame))"""
PIXELS = "(greatest(0, least({2}, trunc({0})::int)) if {3} else trunc({0})::int)"


def plane(d: str, m: float) -> str:
    return join(f"list_transform(list_zip(px, {d}), lambda z: greatest(0, least(255, round_even(z[1] * 0.7::double + z[2] * {m}::double - 5.0::double, 0)::int)))")


def cut(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: greatest(0, z[1] - z[2]))"


def pixel(v: str, size: int) -> str:
    return f"greatest(0, least(trunc({v})::int, {size - 1}))"


def exp_sql() -> str:
    blend = lambda m, w, v: f"list_transform(list_zip({m}, g.px), lambda z: greatest(0, least(255, round_even({w}::double * z[1] + {v}::double * z[2], 0)::int)))"
    return f"""with recursive {GREY}, o as (select *, row_number() over (partition by video order by frame) as i from grey),
r as (select video, i, frame, px as last, px as ea, px as eb, {absdiff("px", "px")} as d0, {absdiff("px", "px")} as d1, {absdiff("px", "px")} as d2 from o where i = 1
 union all select g.video, g.i, g.frame, g.px, {blend("r.ea", 0.5, 0.5)}, {blend("r.eb", 0.8, 1.0 - 0.8)}, {absdiff("g.px", "r.last")}, {absdiff("g.px", "r.ea")}, {absdiff("g.px", "r.eb")}
 from r join o g on g.video = r.video and g.i = r.i + 1)
select video, frame, {join("d0")} as d0, {join("d1")} as d1, {join("d2")} as d2 from r"""


ORDER_VIDEOS = "ov as (select concat('v', o_orderkey) as video, o_orderkey % 41 as n_frames from orders), pool as (select video, unnest(range(9, n_frames - 2)) as frame from ov where n_frames - 3 >= 9)"
TRK = f"""{BOXES}, here as (select video, frame, det, floor((x1 + x2) / 2)::bigint as x, floor((y1 + y2) / 2)::bigint as y from boxes),
m as (select t.frame, t.det as track, h.det, sqrt((t.x - h.x) ** 2 + (t.y - h.y) ** 2) as distance from here t join here h using (video, frame) where t.det % 3 = 0 and h.det % 3 <> 0)"""
NAMED = "select distinct stream, split, basename from labels1"

SQL: dict[str, str] = {
    "tracking_rows_behavior": f"with {OBS} select video_filename, behaviour, count(*) as n, min(frame) as first_frame, max(frame) as last_frame from obs group by 1, 2",
    "behavior_frames_long": f"with {OBS} select video_filename, track_id, behaviour, count(*) as frames, count(*) / 30.0::double as seconds, 100 * count(*) / sum(count(*)) over (partition by video_filename, track_id) as pct from obs group by 1, 2, 3",
    "behavior_transitions": f"with {OBS},{ENTERED} select video_filename, track_id, behaviour, count(*) as transitions from ent where entered group by 1, 2, 3",
    "activity_budget_individual": f"""with {TRACKS} select video_filename, group_id, group_type, track_id, {KIND} as individual_type, short and not manual as auto_flagged, n as n_frames_present,
  n / 30.0::double as duration_s, presence as presence_ratio, {", ".join(f"n_{b} / 30.0::double as behavior_{b}_s, t_{b} as behavior_{b}_n, 100 * n_{b} / n as behavior_{b}_pct" for b in DOMAIN)},
  {top("n")} as dominant_behavior_time, {top("t")} as dominant_behavior_count from tr""",
    "dominant_behavior": f"with {TRACKS} select video_filename, track_id, {top('n')} as dominant_behavior_time, {top('t')} as dominant_behavior_count from tr",
    "stranger_flags": f"with {TRACKS} select video_filename, track_id, presence, border as border_entry, manual as manual_exclude, short and not manual as auto_flagged, {REASON} as flag_reason, {KIND} as individual_type from tr",
    "activity_budget_suspects": f"""with {TRACKS} select video_filename, group_id, group_type, track_id, {REASON} as flag_reason, presence as presence_ratio, f0 as first_seen_frame, f1 as last_seen_frame,
  {tc("f0")} as first_seen_timecode, {tc("f1")} as last_seen_timecode, border as border_entry, short and not manual as auto_flagged, manual as manual_exclude from tr where manual or short""",
    "member_stranger_tally": f"with {TRACKS} select video_filename, count(*) filter (not (manual or short)) as members, count(*) filter (manual or short) as strangers from tr group by 1",
    "analysis_window_budget": f"with {OBS} select video_filename, track_id, behaviour, count(*) as frames, 100 * count(*) / sum(count(*)) over (partition by video_filename, track_id) as pct from obs where frame <= 600 group by 1, 2, 3",
    "group_type_from_name": "with n as (select p_partkey, string_split(concat(replace(p_name, ' ', '_'), '_', p_brand, '_x_', p_type), '_') as f from part) select p_partkey, coalesce(nullif(f[4], ''), 'unknown') as group_type, coalesce(nullif(f[10], ''), 'unknown') as missing_type from n",
    "metadata_override_join": f"with {OBS},{METADATA} select c.video_filename, coalesce(group_id, '') as group_id, coalesce(nullif(group_type, ''), split_part(c.video_filename, '_', 5)) as group_type, coalesce(len(excluded), 0)::bigint as n_excluded from (select distinct video_filename from obs) c left join meta using (video_filename)",
    "video_extension_priority": """with f as (select concat('clip', s_suppkey % 17) as stem, ['.mkv', '.avi', '.mp4', '.MP4', '.mov'][s_suppkey % 5 + 1] as ext, s_suppkey % 2 as tree from supplier),
b as (select stem, first(concat(stem, ext) order by tree, list_position(['.MP4', '.mp4', '.avi', '.mov', '.mkv'], ext)) as name from f group by 1)
select s.stem, coalesce(b.name, s.stem) as video_filename from (select concat('clip', i) as stem from range(20) t(i)) s left join b using (stem)""",
    "frame_timecode": f"select o_orderkey, {tc('o_orderkey * 37')} as timecode, '00:00' as no_rate from orders",
    "box_norm_to_pixel": f"""with {LABELS} select line_no, {", ".join(f"{pixel(f'({c} {s} {w} / 2) * {z}', z)} as {n}, trunc(({c} {s} {w} / 2) * {z})::int as free_{n}" for n, c, s, w, z in (("x1", "xc", "-", "bw", 640), ("y1", "yc", "-", "bh", 480), ("x2", "xc", "+", "bw", 640), ("y2", "yc", "+", "bh", 480)))} from labels1""",
    "box_pixel_to_norm": f"with {BOXES} select det, (x1 + x2) / 2 / 640 as xc, (y1 + y2) / 2 / 480 as yc, abs(x2 - x1) / 640 as bw, abs(y2 - y1) / 480 as bh from boxes",
    "box_overlap_pairs": f"with {BOXES}, p as (select a.frame, a.det as a_det, b.det as b_det, {overlap('a', 'b')} as overlap from boxes a join boxes b on a.video = b.video and a.frame = b.frame and a.det < b.det) select * from p where overlap > 0",
    "merge_candidate_pairs": f"with {BOXES} select a.frame, a.det as a_det, b.det as b_det from boxes a join boxes b on a.video = b.video and a.frame = b.frame and a.det < b.det where {dist('a', 'b')} < 12 or {overlap('a', 'b')} > 0.6",
    "nms_keep": f"""with recursive {BOXES}, o as (select *, row_number() over (partition by video, frame order by conf desc, det) as i from boxes),
r as (select video, frame, 1::bigint as i, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det': det, 'conf': conf}}] as kept from o where i = 1
 union all select r.video, r.frame, o.i, case when len(list_filter(r.kept, lambda k: {overlap("k", "o")} > 0.4)) > 0 then r.kept else list_append(r.kept, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'det': o.det, 'conf': o.conf}}) end
 from r join o on o.video = r.video and o.frame = r.frame and o.i = r.i + 1),
l as (select video, frame, unnest(arg_max(kept, i)) as k from r group by 1, 2) select frame, k.det as det, k.conf as conf from l""",
    "cost_matrix": f"with {TRK} select frame, track, det, distance from m",
    "nearest_track": f"with {TRK}, b as (select frame, det, min({{'d': distance, 't': track}}) as b from m group by 1, 2) select h.frame, h.det, case when b.d < 9 then b.t else -1 end as track, case when b.d < 9 then b.d end as distance from here h left join b using (frame, det) where h.det % 3 <> 0",
    "topmost_box": f"with {BOXES} select video, frame, max(det) as det from boxes where 100 between x1 and x2 and 100 between y1 and y2 group by 1, 2",
    "drawn_boxes": f"with {BOXES}, c as (select det, greatest(0, least(x1, 109)) as x1, greatest(0, least(y1, 109)) as y1, greatest(0, least(x2, 109)) as x2, greatest(0, least(y2, 109)) as y2 from boxes) select * from c where x2 - x1 > 5 and y2 - y1 > 5",
    "canvas_transform": f"with {BOXES} select det, greatest(0, least(trunc(x1 / 1.5::double)::int, 69)) as vx, trunc(x1 * 1.5::double)::int as cx, round_even(det / 500 * 333, 0)::bigint as tick, 100 * 2 * det / 1000 as percent from boxes",
    "frame_pool": f"with {ORDER_VIDEOS} select video, frame from pool",
    "unannotated_pool": f"with {ORDER_VIDEOS} select video, frame from pool where not exists (select 1 from labels where concat('v', doc_id) = pool.video and doc_id % 30 = pool.frame)",
    "annotated_frames_map": "with k as (select concat('clip_', doc_id // 50) as label, doc_id as frame from labels where doc_id % 11 <> 0) select label, count(distinct frame) as n, array_to_string(list_sort(list(distinct frame)), ',') as frames from k group by 1",
    "next_annotated_wrap": "with k as (select distinct concat('clip_', doc_id // 50) as label, doc_id as frame from labels) select label, frame, coalesce(lead(frame) over w, min(frame) over (partition by label)) as next_frame, coalesce(lag(frame) over w, max(frame) over (partition by label)) as previous_frame from k window w as (partition by label order by frame)",
    "basename_parse": "select p_partkey, case when p_partkey % 7 <> 0 then replace(p_name, ' ', '_') end as label, case when p_partkey % 7 <> 0 then p_size::bigint else -1 end as frame from part",
    "crop_name_parse": "with n as (select p_partkey, concat('a_b', p_partkey % 3, '_', p_partkey, '_', p_partkey % 19 - 4, case when p_partkey % 5 = 0 then '' else concat('_', p_partkey % 23) end) as s from part), r as (select p_partkey, regexp_extract(s, '^(.+)_([0-9]+)_(-?[0-9]+)_(-?[0-9]+)$', ['label', 'f', 'x', 'y']) as g from n) select p_partkey, nullif(g.label, '') as label, coalesce(nullif(g.f, '')::bigint, -99) as frame, coalesce(nullif(g.x, '')::bigint, -99) as x1, coalesce(nullif(g.y, '')::bigint, -99) as y1 from r",
    "crop_link_tolerance": f"""with {BOXES}, c as (select det * 2 + 1 as crop, video, frame, (x1 + det % 5 - 2)::int as x1, (y1 + det % 7 - 3)::int as y1, concat('s', det) as secondary from boxes),
h as (select c.crop, c.secondary, b.det as box, b.x1 - c.x1 as dx, b.y1 - c.y1 as dy from c join boxes b on b.video = c.video and b.frame = c.frame and abs(b.x1 - c.x1) <= 2 and abs(b.y1 - c.y1) <= 2),
k as (select *, dx = 0 and dy = 0 as exact, row_number() over (partition by crop order by case when dx = 0 and dy = 0 then 0 else 1 end, dx, dy, box) as i, bool_or(dx = 0 and dy = 0) over (partition by crop) as any_exact from h),
z as (select box, arg_max(secondary, crop) as secondary from k where exact or (i = 1 and not any_exact) group by 1) select boxes.det as box, secondary from boxes left join z on z.box = boxes.det""",
    "image_label_mask_join": "select d.doc_id::varchar as basename, l.doc_id is not null as has_label, coalesce(l.toxic = 1, false) as has_mask from documents d left join labels l using (doc_id)",
    "annotation_listing": f"with {LABELS} select basename, first(stream order by case stream when 'static' then 0 else 2 end + case split when 'val' then 1 else 0 end) as stream, first(split order by case stream when 'static' then 0 else 2 end + case split when 'val' then 1 else 0 end) as split from labels1 group by 1",
    "video_for_item_prefix": """with v as (select concat('/in/', s_name, '.mp4') as path, lower(s_name) as stem from supplier),
i as (select distinct case when s_suppkey % 2 = 0 then upper(s_name) else substr(s_name, 1, length(s_name) - 1) end as label from supplier)
select i.label, (select v.path from v where starts_with(v.stem, lower(i.label)) order by case when v.stem = lower(i.label) then 0 else 1 end, v.path limit 1) as path from i""",
    "frame_alignment": f"""with {GREY}, f as (select video, row_number() over (partition by video order by frame) as frame, px from grey),
w as (select concat(video, '_', frame) as item, video, frame + 1 - frame % 3 as named, px from f),
s as (select w.item, w.named, f.frame, list_sum({absdiff("w.px", "f.px")})::double / len(f.px) as score from w join f on f.video = w.video and abs(f.frame - w.named) <= 1)
select item, named, frame, score from s qualify row_number() over (partition by item order by score, frame) = 1""",
    "class_distribution": f"with {LABELS} select stream, cls, count(*) as boxes, 100 * count(*) / sum(count(*)) over (partition by stream) as pct, 100 * count(*) / sum(count(*)) over (partition by stream) < 10 as low from labels1 where not contains(basename, '_aug_') group by 1, 2",
    "dataset_tallies_rollup": f"with {LABELS}, n as ({NAMED}) select stream, split, count(*) filter (not contains(basename, '_aug_')) as originals, count(*) filter (contains(basename, '_aug_')) as augmented, count(distinct case when not contains(basename, '_aug_') then basename end) as unique_originals from n group by rollup (stream, split)",
    "augmentation_type_counts": f"with {LABELS}, n as ({NAMED}) select string_split(basename, '_aug_')[-1] as augmentation, count(*) as files from n where contains(basename, '_aug_') group by 1",
    "last_epoch_metrics_f1": """with l as (select l_orderkey as run, count(*) as epochs, arg_max({'n': l_linenumber, 'd': l_discount, 't': l_tax}, l_linenumber::bigint * 10000000000 + l_partkey * 10000 + l_suppkey) as r from lineitem group by 1),
m as (select run, epochs, case when r.n % 2 = 0 then r.t else r.d end as precision, r.t as recall from l) select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0::double end as f1 from m""",
    "segment_dsl_explode": """select p_partkey, 0::bigint as segment, case when p_partkey % 3 = 1 then 'discrete' else 'range' end as kind, case when p_partkey % 3 = 2 then 0 else p_size end::double as lo,
  case p_partkey % 3 when 0 then p_size + p_partkey % 4 when 1 then p_size else 0 end::double as hi from part
union all select p_partkey, 1, 'discrete', (p_partkey % 9)::double, (p_partkey % 9)::double from part where p_partkey % 3 = 0""",
    "class_and_colour_lists": "select p_partkey, case when p_partkey % 3 = 0 then concat('a', p_size, '|b|c') else '' end as classes, case p_partkey % 3 when 0 then concat('3,2,', p_size, ';', p_size, ',8,7') when 1 then concat(p_size, ',9,9') else '' end as colours, p_partkey % 3 = 0 as populated from part",
    "label_flip": f"with {LABELS} select 'flip_h' as parameter, line_no, 1 - xc as xc, yc from labels1 union all select 'flip_v', line_no, xc, 1 - yc from labels1",
    "target_class_filter": f"with {LABELS} select basename from labels1 group by 1 having bool_or(cls in (2, 5)) union all select concat('bare_', i) from range(3) t(i)",
    "seq_frame_diff": f"with {SEQ} select video, frame, {join('d0')} as d0, {join('d1')} as d1, {join('d2')} as d2 from seq",
    "exp_frame_diff": exp_sql(),
    "false_color_plain": f"with {SEQ} select video, frame, {plane('d0', 4.0)} as blue, {plane('d1', 3.0)} as green, {plane('d2', 2.0)} as red from seq",
    "false_color_chromatic": f"with {SEQ} select video, frame, {plane(cut('d0', 'd1'), 4.0)} as blue, {plane(cut('d1', 'd0'), 3.0)} as green, {plane(cut('d2', 'd1'), 2.0)} as red from seq",
    "frame_skip_sample": f"with {OBS} select video_filename, frame, track_id from obs where frame >= 2 and (frame - 2) % 3 = 0",
    "window_ending_at": f"with {OBS}, t as (select video_filename as video, frame as target from obs) select t.video, t.target, o.frame, o.row_no from t join obs o on o.video_filename = t.video and o.frame between greatest(0, t.target - 8) and t.target and (t.target - o.frame) % 2 = 0",
    "rolling_fps": "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as recent from events",
    "mask_fill": f"with {GREY} select video, frame, {join('list_transform(px, lambda v, i: case when (i - 1) % 8 between frame % 5 and frame % 5 + 2 and (i - 1) // 8 between 1 and 4 then 128 else v end)')} as px from grey",
    "padded_crop": f"with {GREY}, q as (select *, frame % 8 - 2 as l, frame % 3 - 2 as t from grey) select video, frame, {join('list_transform(range(16), lambda i: case when l + i % 4 between 0 and 7 and t + i // 4 between 0 and 7 then px[(t + i // 4) * 8 + l + i % 4 + 1] else 0 end)')} as px from q",
    "delete_set_exact": "with k as (select s_suppkey as i from supplier where s_suppkey in (select p_partkey from part)) select 'label' as kind, concat('v_', i) as name from k union all select 'crop', concat('v_', i, '_4_', i % 9) from k",
    "delete_set_prefix": "select 'label' as kind, concat('v_', s_suppkey) as name from supplier where s_suppkey in (select p_partkey from part) union all select 'crop', c from (select concat('v_', p_partkey, '_4_', p_partkey % 9) as c from part) where exists (select 1 from supplier where starts_with(c, concat('v_', s_suppkey)))",
    "backup_ordinal": "select min(n) as ordinal from range(1, 27) t(n) where n not in (select n_nationkey from nation where n_nationkey <> 4)",
    "model_directories": "with n as (select concat(case when n_nationkey % 2 = 0 then 'model_' else 'annot_' end, lower(n_name), case when n_nationkey % 3 = 0 then '_backup2' else '' end) as name from nation) select name from n where starts_with(name, 'model_') and not regexp_matches(name, '_backup[0-9]+$')",
    "hotkey_conflicts": "select lower(n_name[1]) as hotkey, count(*) as uses from nation group by 1 having count(*) > 1 or lower(n_name[1]) in ('u', 'g')",
    "settings_diff": "select n_name as key, n_regionkey::varchar as old, case when n_nationkey <> 3 then (n_regionkey + n_nationkey % 2)::varchar end as new from nation where n_nationkey = 3 or n_nationkey % 2 = 1",
    "case_insensitive_class_sort": "with c as (select case when p_size % 2 = 0 then lower(p_type) else p_type end as name, min(p_partkey) as idx from part group by 1) select name, idx, row_number() over (order by lower(name), idx) - 1 as position from c",
    "window_length_rule": "with c as (select p_partkey, greatest((p_size % 11)::double / 10, (p_partkey % 11)::double / 10) as t from part) select p_partkey, (case when t > 0.9::double then 45 when t > 0.8::double then 20 when t > 0.7::double then 15 when t > 0.5::double then 10 when t > 0.2::double then 5 else 4 end * 3)::bigint as frames, 4::bigint as sequential from c",
    "label_tally_first_bad": "with c as (select conv_id, turn, conv_id % 5 as bad, bool_or(turn = conv_id % 5) over (partition by conv_id order by turn) as cutoff from conversations) select conv_id as basename, count(*) as lines, sum(turn)::bigint as total from c where not cutoff group by 1",
    "log_text_predicates": "select p_partkey, p_partkey % 3 <> 2 as progress, case p_partkey % 3 when 0 then concat('  ', p_size, '/50 x') when 1 then concat(p_size, '% | x') else p_name end as plain from part",
    "detection_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hours then 0 else 1 end as b from events), k as (select user_id, ts, sum(b) over (partition by user_id order by ts) as s from g) select user_id, count(*) as n, epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as ended_us from k group by user_id, s",
    "conversation_role_transitions": "with e as (select conv_id, role, lag(role) over (partition by conv_id order by turn) as p from conversations), t as (select conv_id, role, count(*) as n from e where p <> role group by 1, 2) select role as behaviour, sum(n)::bigint as transitions, count(*) as conversations from t group by 1",
    "rebuild_items": f"""with {LABELS}, c as (select concat('clip', n_nationkey % 4) as label, min(case when n_nationkey % 2 = 0 then '0.mp4' else '1.AVI' end) as e from nation group by 1)
select distinct k.label, basename, split, stream, split_part(basename, '_', 2)::bigint as frame, concat('/clips/', k.label, e[2:]) as path from (select *, split_part(basename, '_', 1) as label from labels1 where not contains(basename, '_aug_')) k join c on c.label = k.label""",
    "videos_with_annotations": f"with {LABELS} select concat('clip', s_suppkey) as stem, concat('/in/', s_name) as path from supplier where concat('clip', s_suppkey) in (select split_part(basename, '_', 1) from labels1 where not contains(basename, '_aug_'))",
    "union_by_normalised_path": "select concat('/in/a/clip', p_partkey, '.mp4') as path, 'clips' as source, p_partkey from part union all select concat('/in/b/clip', p_partkey, '.mp4'), 'more', p_partkey from part where p_partkey % 2 = 1",
    "joint_class_domain": "with c as (select case when n_nationkey % 3 = 0 then 'motion' else 'static' end as stream, n_name as name, n_nationkey as k from nation) select stream, name, row_number() over (partition by stream order by k) - 1 as position, row_number() over (order by stream desc, k) - 1 as id from c",
    "newest_run": "select concat('/runs/train', o_orderkey) as path from orders order by o_orderdate desc, concat('/runs/train', o_orderkey) desc limit 1",
    "sorted_basenames": f"with {LABELS} select distinct basename from labels1",
    "clamped_steps": "select o_orderkey, " + ", ".join(f"greatest(0, least(o_orderkey % 100 + {k}, 89)) as by_{n}" for k, n in ((-10, "back10"), (-1, "back1"), (1, "on1"), (10, "on10"))) + " from orders",
    "masks_of_either_stream": "select doc_id::varchar as basename, case when quality = 1 then 0 else 10 end as x1 from labels where quality = 1 or toxic = 1",
    "augmented_file_counts": f"with {LABELS} select stream as kind, count(distinct basename) as files from labels1 where contains(basename, '_aug_') group by 1",
    "label_files_by_stream": f"with {BOXES}, c as (select concat(video, '_', frame) as basename, det, cls::int as k from boxes) select case when k < 6 then 'static' else 'motion' end as stream, basename, count(*) as lines, string_agg((case when k < 6 then k else k - 6 end)::varchar, ',' order by det) as classes from c group by 1, 2",
}


def merge_sql(dominant: str) -> str:
    """The greedy merge as a recursive query: a frame's detections in order, each against the list of merged ones."""
    mine = "o.source = m.source and o.conf > m.conf or o.source <> m.source and "
    wins = "o.conf > m.conf" if dominant == "confidence" else f"({mine} o.source = '{dominant}')"
    new = lambda cls, conf: "{" + ", ".join(f"'{c}': o.{c}" for c in ("x1", "y1", "x2", "y2", "cls", "conf", "source")) + f", 'combined_cls': {cls}, 'combined_conf': {conf}" + "}"
    alone = new("''", "0.0::double")
    near = f"{dist('m', 'o')} < 12 or {overlap('m', 'o')} > 0.6"
    return f"""with recursive {BOXES}, o as (select *, row_number() over (partition by video, frame order by case source when 'static' then 0 else 1 end, det) as i from boxes),
r as (select video, frame, i, [{alone}] as kept from o where i = 1
 union all select video, frame, i, case when hit = 0 then list_append(kept, own) else list_transform(kept, lambda m, j: case when j = hit and won[j] then then_[j] else m end) end
 from (select o.video, o.frame, o.i, r.kept, {alone} as own, coalesce(list_position(list_transform(r.kept, lambda m: {near}), true), 0) as hit,
  list_transform(r.kept, lambda m: {wins}) as won, list_transform(r.kept, lambda m: {new("m.cls", "m.conf")}) as then_
  from r join o on o.video = r.video and o.frame = r.frame and o.i = r.i + 1)),
l as (select video, frame, arg_max(kept, i) as kept from r group by 1, 2), k as (select video, frame, unnest(kept) as m, unnest(range(len(kept))) as det from l)
select video, frame, det, {", ".join(f"m.{c} as {c}" for c in ("x1", "y1", "x2", "y2", "cls", "conf", "source", "combined_cls", "combined_conf"))},
 {", ".join(f"case when m.source = '{k}' then m.{c} else m.combined_{c} end as primary_{k}_{n}" for k in ("static", "motion") for c, n in (("cls", "class"), ("conf", "conf")))} from k"""


GAP = "21600000000"
SQL |= {
    "recording_frames": f"""
with e as (select event_id, user_id as video, epoch_us(ts) as us, event_type = 'purchase' as det from events),
d as (select distinct video, us from e where det),
u as (select video, us, us as seen, null::bigint as shown from d union all select video, us, null, us from e),
w as (select *, max(seen) over b as last_seen, max(shown) over b as last_shown from u window b as (partition by video order by us range between unbounded preceding and 1 preceding)),
n as (select video, us, sum(case when last_seen is null or last_shown > last_seen + {GAP} then 1 else 0 end) over (partition by video order by us) as recording from w where seen is not null),
s as (select video, recording, min(us) as started_us, max(us) + {GAP} as stopped_us from n group by 1, 2)
select e.event_id, e.video, s.recording::bigint as recording, s.started_us, s.stopped_us from e join s on s.video = e.video and e.us between s.started_us and s.stopped_us""",
    "resized_frames": f"""with {GREY},
p as (select video, frame, px, i // 4 as y, i % 4 as x from grey, range(64) t(i)),
q as (select *, greatest(0, least(7, (y + 0.5::double) * 0.5 - 0.5)) as v, greatest(0, least(7, (x + 0.5::double) * 2 - 0.5)) as u from p),
r as (select *, floor(v)::int as a, floor(u)::int as b, v - floor(v) as fy, u - floor(u) as fx from q),
s as (select *, px[a * 8 + b + 1] * (1 - fx) + px[a * 8 + least(7, b + 1) + 1] * fx as top, px[least(7, a + 1) * 8 + b + 1] * (1 - fx) + px[least(7, a + 1) * 8 + least(7, b + 1) + 1] * fx as low from r)
select video, frame, string_agg(floor(top * (1 - fy) + low * fy + 0.5)::int::varchar, ',' order by y, x) as px from s group by 1, 2""",
    "rebuilt_windows": f"""with {GREY},
s as (select t.video, t.frame, list(w.px order by w.frame) as s from grey t join grey w on w.video = t.video and w.frame between t.frame - 6 and t.frame and (t.frame - w.frame) % 2 = 0 where t.frame % 3 = 0 group by 1, 2)
select video, frame, {", ".join(f"{join(absdiff('s[-1]', f's[greatest(1, len(s) - {k})]'))} as d{k - 1}" for k in (1, 2, 3))} from s""",
    "zoomed_crops": f"""with {GREY},
c as (select *, greatest(0, frame % 8 - 2) as l, greatest(0, frame % 5 - 2) as t, least(8, frame % 8 + 2) as r, least(8, frame % 5 + 2) as b from grey),
p as (select *, i // 4 as y, i % 4 as x from c, range(16) g(i)),
q as (select *, greatest(0, least(b - t - 1, (y + 0.5::double) * (b - t) / 4 - 0.5)) as v, greatest(0, least(r - l - 1, (x + 0.5::double) * (r - l) / 4 - 0.5)) as u from p),
n as (select *, floor(v)::int as a, floor(u)::int as o, least(b - t - 1, floor(v)::int + 1) as a1, least(r - l - 1, floor(u)::int + 1) as o1 from q),
s as (select *, px[(t + a) * 8 + l + o + 1] * (1 - (u - o)) + px[(t + a) * 8 + l + o1 + 1] * (u - o) as top, px[(t + a1) * 8 + l + o + 1] * (1 - (u - o)) + px[(t + a1) * 8 + l + o1 + 1] * (u - o) as low from n)
select video, frame, string_agg(floor(top * (1 - (v - a)) + low * (v - a) + 0.5)::int::varchar, ',' order by y, x) as px from s group by 1, 2""",
    "tracks_within_gate": f"with {TRK} select frame, det, count(*) as tracks, sum(track)::bigint as track_sum from m where distance < 9 group by 1, 2",
}

SQL |= {f"merge_detections_{kind}": merge_sql(kind) for kind in ("confidence", "static", "motion")}
