"""SQL for the queries of ``heldout``: the faults of all trials as one CASE per channel."""

from __future__ import annotations

import math

from ..functions.contracts import ACCEL, GT_CONTEXT, GYRO, RAW
from ..functions.faults import FAULTS
from ..operators.inject import DROPOUT_PERIOD, DURATION, HARD_CLIP, JITTER, LAG_ROWS, LEAKAGE, NEEDS_SPEED, NEEDS_TURN, ROTATION_DEG, SEVERITY, TARGET, noise_table, warp_table
from . import heldout
from .oracle import ANN, CONTEXT, EVENTS, KEYS, LENIENT, TEL, TIMELINE, adaptive_of, baseline_of, interpolated, r, rr, scale_of, strict_of, timeline_of

TRIED = ", ".join(f"('{k}', {DURATION[k]}, '{TARGET[k]}')" for k in heldout.TRIED)
_SPEED, _UP, _TURN = "coalesce(gt_speed_mps > 0.263, false)", "coalesce(abs(gt_vertical_speed_mps) > 0.05, false)", "coalesce(abs(gt_yaw_rate_rps) > 0.114, false)"


def by(column: str, values: dict) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in values.items()) + " END"


def placements() -> str:
    """CTEs up to ``places``: greedy choice among quiet starts, per sequence and fault."""
    stretched = ", ".join(f"c.{c} * {k} AS {c}" for c, k in heldout.STRETCH.items())
    rounds, picks = [], []
    for k in range(1, heldout.PLACEMENTS + 1):
        rounds.append(f"p{k} AS (SELECT sequence_name, kind, {k} AS placement_index, start_index FROM (SELECT *, row_number() OVER (PARTITION BY sequence_name, kind ORDER BY region_max, baseline, start_index) AS i FROM q{k - 1}) WHERE i = 1)")
        rounds.append(f"q{k} AS (SELECT q.* FROM q{k - 1} q JOIN p{k} p USING (sequence_name, kind) WHERE abs(q.start_index - p.start_index) >= 500)")
        picks.append(f"SELECT * FROM p{k}")
    return f"""{TIMELINE}, {baseline_of()}, {adaptive_of(5.0)},
clean AS (SELECT t.*, active AS alert_active FROM timeline t JOIN st USING (sequence_name, window_end_idx)),
{CONTEXT}, ontel AS ({interpolated("(SELECT DISTINCT sequence_name, timestamp_ns FROM tel)", "ctx", GT_CONTEXT, False)}),
mv AS (SELECT tel.sequence_name, timestep_index, {stretched} FROM tel JOIN ontel c USING (sequence_name, timestamp_ns)),
len AS (SELECT sequence_name, count(*) AS n FROM tel GROUP BY 1),
kd(kind, d, grp) AS (VALUES {TRIED}),
cs AS (SELECT sequence_name, d, unnest(range(150, greatest(150, n - d - 151) + 1, 5)) AS start_index FROM len, (SELECT DISTINCT d FROM kd)),
qs AS (SELECT c.sequence_name, c.d, start_index, max(score) AS region_max, coalesce(median(score) FILTER (WHERE window_end_idx < start_index), median(score)) AS baseline
       FROM cs c JOIN clean a ON a.sequence_name = c.sequence_name AND window_end_idx >= start_index - 150 AND window_start_idx <= start_index + c.d + 150 GROUP BY ALL HAVING NOT bool_or(alert_active)),
q0 AS (SELECT qs.*, kind FROM qs JOIN kd USING (d) JOIN mv ON mv.sequence_name = qs.sequence_name AND mv.timestep_index = start_index
       WHERE ({_SPEED} OR {_UP} OR {_TURN}) AND CASE WHEN kind IN ({", ".join(map(repr, NEEDS_SPEED))}) THEN {_SPEED} OR {_UP} WHEN kind IN ({", ".join(map(repr, (*NEEDS_TURN, 'sensor_lag', 'gyro_accel_inconsistency')))}) THEN {_SPEED} OR {_TURN} ELSE true END),
{", ".join(rounds)},
places AS ({" UNION ALL ".join(picks)})"""


def injection_cells(rows: str, noise: str) -> str:
    """CTEs up to ``inj``: ``rows`` of trials with their faults written in.

    ``rows``: trial, seq, kind, severity, start_index, step, k, m, inside, low, part; ``noise`` joins the draws.
    Scales are in ``gyro``, ``accel`` and ``mixed``, the rows of the sequences in ``tel``.
    """
    period = by("severity", DROPOUT_PERIOD)
    dropout = f"CASE WHEN {period} IS NULL THEN greatest(0, start_index - 1) WHEN k % ({period})::INT = 0 THEN step WHEN (k // ({period})::INT) % 2 = 1 THEN start_index + ({period})::INT * (k // ({period})::INT) WHEN k // ({period})::INT >= 1 THEN start_index + ({period})::INT * (k // ({period})::INT - 1) ELSE greatest(0, start_index - 1) END"
    source = f"CASE WHEN NOT inside THEN step WHEN kind LIKE '%_freeze' THEN start_index WHEN kind = 'packet_dropout' THEN {dropout} WHEN kind = 'sensor_lag' THEN greatest(0, step - ({by('severity', LAG_ROWS)})::INT) WHEN kind = 'timestamp_jitter' THEN start_index + low ELSE step END"
    factor, turn = by("severity", SEVERITY), by("severity", {s: math.radians(x) for s, x in ROTATION_DEG.items()})

    def cell(c: str) -> str:
        group = "gyro" if c in GYRO else "accel" if c in ACCEL else None
        cases = {"packet_dropout": f"s.{c}", "timestamp_jitter": f"s.{c} + (u.{c} - s.{c}) * part"}
        if group:
            cases |= {f"{group}_freeze": f"s.{c}", f"{group}_bias_drift": f"x.{c} + {factor} * {group}.scale * CASE WHEN m > 1 THEN k / greatest(m - 1, 1) ELSE 0.0 END", "noise_burst": f"x.{c} + {factor} * mixed.scale * n_{c}"}
        if group == "gyro":
            cases["gyro_bias_step"] = f"x.{c} + {factor} * gyro.scale"
        if group == "accel":
            i = ACCEL.index(c)
            limit = f"{by('severity', HARD_CLIP)} * accel.scale"
            cases |= {"sensor_lag": f"s.{c}", "clipping": f"greatest(-({factor} * accel.scale), least({factor} * accel.scale, x.{c}))", "hard_clipping": f"greatest(-({limit}), least({limit}, x.{c}))", "cross_axis_leakage": f"x.{c} + {by('severity', LEAKAGE)} * x.{ACCEL[(i + 1) % 3]}"}
            a, b = f"x.{ACCEL[0]}", f"x.{ACCEL[1]}"
            if i < 2:
                cases["gyro_accel_inconsistency"] = f"{a} * cos({turn}) - {b} * sin({turn})" if i == 0 else f"{a} * sin({turn}) + {b} * cos({turn})"
            else:
                cases |= {"impact_pulse": f"x.{c} + {factor} * accel.scale * (0.5 - 0.5 * cos(2 * pi() * (k + 1) / (m + 1)))", "vibration_burst": f"x.{c} + {factor} * accel.scale * sin(4 * pi() * k / greatest(m - 1, 1))"}
        if c == GYRO[2]:
            cases["angular_rate_burst"] = f"x.{c} + {factor} * gyro.scale * sin(2 * pi() * k / greatest(m - 1, 1))"
        return f"CASE WHEN NOT inside THEN x.{c} " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE x.{c} END AS {c}"

    channels = ", ".join(cell(c) if c in GYRO + ACCEL else f"CASE WHEN inside AND kind = 'packet_dropout' THEN s.{c} WHEN inside AND kind = 'timestamp_jitter' THEN s.{c} + (u.{c} - s.{c}) * part ELSE x.{c} END AS {c}" for c in RAW)
    return f"""rd AS (SELECT *, {source} AS source FROM {rows}),
inj AS (SELECT trial AS sequence_name, x.timestamp_ns, step AS timestep_index, {channels}
       FROM rd JOIN tel x ON x.sequence_name = seq AND x.timestep_index = step JOIN tel s ON s.sequence_name = seq AND s.timestep_index = source LEFT JOIN tel u ON u.sequence_name = seq AND u.timestep_index = source + 1
       {noise} JOIN gyro ON gyro.sequence_name = seq JOIN accel ON accel.sequence_name = seq JOIN mixed ON mixed.sequence_name = seq)"""


def trials() -> str:
    """CTEs up to ``strict``: all trials, injected, scored and judged."""
    seeds = range(1, heldout.PLACEMENTS + 1)
    warps = ", ".join(f"('{s}', {p}, {i}, {low}, {part!r}::DOUBLE)" for s in JITTER for p in seeds for i, low, part in warp_table(s, heldout.SEED + p, DURATION["timestamp_jitter"]))
    noise = ", ".join("(" + ", ".join([str(p), str(i), *(f"{float(x)!r}::DOUBLE" for x in row)]) + ")" for p in seeds for i, row in enumerate(noise_table(heldout.SEED + p, DURATION["noise_burst"])))
    return f"""{placements()},
tr AS (SELECT sequence_name AS seq, kind AS anomaly_type, placement_index, severity, grp AS target_group, start_index, least(n - 1, start_index + d - 1) AS end_index, sequence_name || '#' || kind || '/' || placement_index || '/' || severity AS sequence_name, 1 AS event_order
       FROM places JOIN kd USING (kind) JOIN len USING (sequence_name), (VALUES ('small'), ('medium'), ('large')) v(severity)),
{scale_of(GYRO, "gyro")}, {scale_of(ACCEL, "accel")}, {scale_of(ACCEL + GYRO, "mixed")},
wp(severity, placement_index, k, low, part) AS (VALUES {warps}),
ns(np, nk, {", ".join(f"n_{c}" for c in ACCEL + GYRO)}) AS (VALUES {noise}),
sg AS (SELECT tr.sequence_name AS trial, seq, anomaly_type AS kind, severity, placement_index, start_index, timestep_index AS step, timestep_index - start_index AS k, end_index - start_index + 1 AS m, timestep_index BETWEEN start_index AND end_index AS inside
       FROM tr JOIN tel ON tel.sequence_name = seq AND timestep_index BETWEEN start_index - 450 AND end_index + 450),
ws AS (SELECT sg.*, low, part FROM sg LEFT JOIN wp USING (severity, placement_index, k)),
{injection_cells("ws", "LEFT JOIN ns ON np = placement_index AND nk = k")},
{timeline_of("inj", "t_")}, {baseline_of("t_")}, {adaptive_of(5.0, "t_")},
t_ann AS (SELECT t.*, active AS alert_active, onset AS alert_onset FROM t_timeline t JOIN t_st USING (sequence_name, window_end_idx)),
{strict_of("tr", "t_ann", 25)}"""


ROUNDED = ["time_to_detect_s", "baseline_score", "during_max_score", "during_median_score", "post_median_score", "score_lift_abs", "score_lift_ratio"]
COUNTS = ["pre_event_alert_onset_count", "pre_event_alert_active_count", "outside_event_alert_onset_count", "outside_event_alert_active_count"]


def _half(c: str, name: str) -> str:
    return r(f"quantile_cont({c}, 0.5)", name)


def _summary() -> str:
    delay = "CASE WHEN event_detected_strict > 0 AND time_to_detect_s < 'inf'::DOUBLE THEN time_to_detect_s END"
    return f"""WITH RECURSIVE {trials()} SELECT anomaly_type, severity, count(*) AS trial_count, sum(preexisting_alert::INT)::BIGINT AS contaminated_trial_count, {r("avg(event_detected_strict)", "strict_detection_rate")},
        {r(f"coalesce(quantile_cont({delay}, 0.5), 'inf'::DOUBLE)", "median_time_to_detect_s")}, {r("avg(group_attribution_correct)", "group_attribution_top1")},
        {_half("outside_event_alert_onset_count", "median_outside_event_alert_onset_count")}, {_half("outside_event_alert_active_count", "median_outside_event_alert_active_count")},
        {r("avg((outside_event_alert_onset_count > 0)::DOUBLE)", "trial_false_positive_onset_rate")}, {r("avg((outside_event_alert_active_count > 0)::DOUBLE)", "trial_false_positive_active_rate")},
        {_half("score_lift_abs", "median_score_lift_abs")}, {_half("score_lift_ratio", "median_score_lift_ratio")} FROM strict GROUP BY 1, 2"""


def demo() -> str:
    """CTEs up to ``f3``: the demo's faults in turn, each on what the one before has left."""
    frozen = ", ".join(f"CASE WHEN g.timestep_index BETWEEN g.s2 AND g.s2 + 39 THEN z.{c} ELSE g.{c} END AS {c}" for c in ACCEL)
    drift = ", ".join(f"CASE WHEN timestep_index BETWEEN s1 AND s1 + 74 THEN {c} + 3.0 * gyro.scale * (timestep_index - s1) / 74.0 ELSE {c} END AS {c}" for c in GYRO)
    clipped = ", ".join(f"CASE WHEN timestep_index BETWEEN s3 AND s3 + 19 THEN greatest(-3.0 * acc2.scale, least(3.0 * acc2.scale, {c})) ELSE {c} END AS {c}" for c in ACCEL)
    return f"""dl AS (SELECT sequence_name, count(*) AS n FROM tel GROUP BY 1 HAVING count(*) - 1 > 250),
dp(k, kind, grp, d) AS (VALUES (1, 'gyro_bias_drift', 'gyro', 75), (2, 'accel_freeze', 'accel', 40), (3, 'clipping', 'accel', 20)),
dv AS (SELECT sequence_name, k AS event_order, kind AS anomaly_type, grp AS anomaly_group, least(greatest(200, floor(200 + (n - 51 - 200) * (k / 4.0::DOUBLE))), greatest(200, n - 51 - d))::BIGINT AS start_index, d FROM dl, dp),
at3 AS (SELECT sequence_name, max(start_index) FILTER (WHERE event_order = 1) AS s1, max(start_index) FILTER (WHERE event_order = 2) AS s2, max(start_index) FILTER (WHERE event_order = 3) AS s3 FROM dv GROUP BY 1),
{scale_of(GYRO, "gyro")},
f1 AS (SELECT tel.* REPLACE ({drift}), s1, s2, s3 FROM tel JOIN at3 USING (sequence_name) JOIN gyro USING (sequence_name)),
f2 AS (SELECT g.* REPLACE ({frozen}) FROM f1 g JOIN f1 z ON z.sequence_name = g.sequence_name AND z.timestep_index = g.s2),
{scale_of(ACCEL, "acc2").replace("FROM tel", "FROM f2", 1)},
f3 AS (SELECT f2.* REPLACE ({clipped}) FROM f2 JOIN acc2 USING (sequence_name)),
{timeline_of("f3", "d_")}"""


def _replay() -> str:
    def mode(name: str, source: str, event: str) -> str:
        return f"""SELECT '{name}' AS replay_mode, t.sequence_name, t.window_start_idx, t.window_end_idx, t.timestamp_ns, {rr(["time_s", "score", "quaternion_score", "gyro_score", "accel_score"])}, top_group, {r("th", "threshold")},
            coalesce(sum((score > th)::INT) OVER (PARTITION BY t.sequence_name ORDER BY t.window_end_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2, false) AS alert_active, {event} FROM {source} t JOIN th USING (sequence_name)"""

    last = "arg_max({}, event_order)"
    hits = f"hit AS (SELECT t.sequence_name, window_start_idx, {last.format('anomaly_type')} AS kind, {last.format('anomaly_group')} AS grp FROM d_timeline t JOIN dv ON dv.sequence_name = t.sequence_name AND window_end_idx >= start_index AND window_start_idx <= start_index + d - 1 GROUP BY 1, 2)"
    demo_rows = mode("demo", "d_timeline", "kind IS NOT NULL AS anomaly_active, coalesce(kind, '') AS anomaly_type, coalesce(grp, '') AS target_group") + " LEFT JOIN hit ON hit.sequence_name = t.sequence_name AND hit.window_start_idx = t.window_start_idx"
    return f"""WITH {TIMELINE}, {demo()}, th AS (SELECT sequence_name, quantile_cont(score, 0.99) AS th FROM timeline GROUP BY 1), {hits}
    {mode("clean", "timeline", "false AS anomaly_active, '' AS anomaly_type, '' AS target_group")} UNION ALL {demo_rows}"""


def _catalog() -> str:
    made = lambda kind, tier: tier != "planned" and kind in DURATION
    rows = ", ".join(f"('{k}', '{tier}', '{group}', '{method}', {DURATION[k] if made(k, tier) else 'NULL'}, {(k in NEEDS_SPEED + NEEDS_TURN) if made(k, tier) else 'NULL'})" for k, tier, group, method in FAULTS)
    return f"""WITH {ANN}, {EVENTS}, {LENIENT}, e AS (SELECT anomaly_type, count(*) AS event_count, {r("avg(event_detected)", "event_detection_rate")} FROM lenient GROUP BY 1)
    SELECT c.*, coalesce(event_count, 0) AS event_count, event_detection_rate FROM (VALUES {rows}) c(anomaly_type, tier, target_group, injection_method, duration_rows, needs_motion) LEFT JOIN e USING (anomaly_type)"""


def oracle_sql() -> dict[str, str]:
    burden = f"""WITH RECURSIVE {TIMELINE}, {baseline_of()}, {adaptive_of(5.0)} SELECT sequence_name, count(*) AS window_count, sum(positive::INT)::BIGINT AS positive_count, sum(active::INT)::BIGINT AS alert_active_count, sum(onset::INT)::BIGINT AS alert_onset_count,
        {r("avg(positive::INT)", "positive_rate")}, {r("avg(active::INT)", "alert_active_rate")}, 'adaptive' AS threshold_mode FROM st GROUP BY 1"""
    return {
        "heldout_candidates": f"WITH RECURSIVE {placements()} SELECT sequence_name, kind AS anomaly_type, placement_index, start_index FROM places",
        "heldout_smoke": f"WITH RECURSIVE {trials()} SELECT sequence_name, event_order, anomaly_type, severity, target_group, start_index, end_index, preexisting_alert, {', '.join(COUNTS)}, event_detected_strict, alert_trigger_group, group_attribution_correct, {rr(ROUNDED)} FROM strict",
        "heldout_smoke_summary": _summary(),
        "heldout_clean_burden": burden,
        "anomaly_catalog": _catalog(),
        "replay_timeline": _replay(),
    }
