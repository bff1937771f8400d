"""The queries again, as SQL for DuckDB over the same tables."""

from __future__ import annotations

import math

from ..functions.contracts import ACCEL, DERIVED, GT_CONTEXT, GT_POSITION, GT_QUATERNION, GYRO, QUATERNION, RAW
from ..functions.faults import FAULTS
from ..operators.inject import DURATION, HARD_CLIP, LAG_ROWS, LEAKAGE, ROTATION_DEG, SEVERITY, TARGET, noise_table, warp_table
from ..operators.resample import fir_weights

GRID = 600 * 1_000_000_000
W = "PARTITION BY sequence_name ORDER BY timestamp_ns"
UP_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def rr(names: list[str]) -> str:
    return ", ".join(r(n, n) for n in names)


def square(n: str) -> str:
    return f"({n})*({n})"


def length(names: list[str]) -> str:
    return "sqrt(" + " + ".join(square(n) for n in names) + ")"


def _cells(names: list[str], first: int, over: str = "") -> str:
    return ", ".join(f"v[{first + i + 1}]::DOUBLE{over} AS {n}" for i, n in enumerate(names))


def _unit(first: int) -> str:
    return "sqrt(" + " + ".join(square(f"v[{first + i + 1}]::DOUBLE") for i in range(4)) + ")"


EV = "ev AS (SELECT event_type AS sequence_name, epoch_ns(ts) AS timestamp_ns, event_id, user_id, value, props FROM events)"
TEL = f"""{EV},
n AS (SELECT count(*) AS n FROM embeddings),
j AS (SELECT sequence_name, timestamp_ns, event_id, embedding AS v FROM ev CROSS JOIN n JOIN embeddings ON vec_id = event_id % n.n),
tel AS (SELECT sequence_name, timestamp_ns, event_id, row_number() OVER (PARTITION BY sequence_name ORDER BY timestamp_ns, event_id) - 1 AS timestep_index,
        {_cells(QUATERNION, 0, "/" + _unit(0))}, {_cells(GYRO + ACCEL, 4)} FROM j),
gt AS (SELECT sequence_name, timestamp_ns, event_id, {_cells(GT_POSITION, 10)}, {_cells(GT_QUATERNION, 13, "/" + _unit(13))} FROM j WHERE event_id % 4 = 0)"""
KEYS = "sequence_name, timestamp_ns, timestep_index"


def derived(source: str, name: str) -> str:
    """CTE ``name``: rows of ``source`` with derived features."""
    def rate(columns):
        parts = " + ".join(square(f"({c} - lag({c}) OVER w) / dt") for c in columns)
        return f"coalesce(sqrt({parts}), 0.0)"

    return f"""{name}0 AS (SELECT *, {length(GYRO)} AS gyro_norm, {length(ACCEL)} AS accel_norm,
        CASE WHEN timestamp_ns > lag(timestamp_ns) OVER ({W}) THEN (timestamp_ns - lag(timestamp_ns) OVER ({W})) / 1e9 END AS dt FROM {source}),
{name} AS (SELECT *, {rate(GYRO)} AS angular_accel_norm, {rate(ACCEL)} AS jerk_norm,
        sqrt(avg(gyro_norm*gyro_norm) OVER ({W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) AS gyro_rms_local,
        sqrt(avg(accel_norm*accel_norm) OVER ({W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) AS accel_rms_local
        FROM {name}0 WINDOW w AS ({W}))"""


def windows_of(source: str, size: int, stride: int) -> str:
    return f"""SELECT sequence_name, {size}::BIGINT AS window_size, {stride}::BIGINT AS stride, timestep_index AS start_row, timestep_index + {size - 1} AS end_row,
        timestamp_ns AS start_timestamp_ns, end_ns AS end_timestamp_ns
        FROM (SELECT *, lead(timestamp_ns, {size - 1}) OVER ({W}) AS end_ns FROM {source}) WHERE timestep_index % {stride} = 0 AND end_ns IS NOT NULL"""


GROUPS = {"quaternion": QUATERNION, "gyro": GYRO, "accel": ACCEL}


def top_mean(name: str) -> str:
    return f"list_sum(list_slice(list_reverse_sort({name}), 1, 8)) / 8"


def _residual(c: str) -> str:
    return f"coalesce(pow({c} - avg({c}) OVER ({W} ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), 2), 0.0) AS r_{c}"


def _mean(names: list[str]) -> str:
    return "(" + " + ".join(f"r_{n}" for n in names) + f") / {len(names)}"


_AHEAD = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND 149 FOLLOWING)"


def timeline_of(source: str, name: str = "") -> str:
    """CTEs up to ``<name>timeline``: the score timeline of ``source``."""
    return f"""{name}res AS (SELECT {KEYS}, {", ".join(map(_residual, RAW))} FROM {source}),
{name}err AS (SELECT {KEYS}, {_mean(RAW)} AS e, {", ".join(f"{_mean(g)} AS e_{n}" for n, g in GROUPS.items())} FROM {name}res),
{name}win AS (SELECT *, min(timestamp_ns) OVER (PARTITION BY sequence_name) AS t0, lead(timestamp_ns, 149) OVER ({W}) AS end_ns, list(e) {_AHEAD} AS l, {", ".join(f"list(e_{n}) {_AHEAD} AS l_{n}" for n in GROUPS)} FROM {name}err),
{name}scored AS (SELECT sequence_name, timestep_index AS window_start_idx, timestep_index + 149 AS window_end_idx, end_ns AS timestamp_ns, (end_ns - t0) / 1e9 AS time_s,
        {top_mean("l")} AS score, {", ".join(f"{top_mean(f'l_{n}')} AS {n}_score" for n in GROUPS)} FROM {name}win WHERE timestep_index % 5 = 0 AND end_ns IS NOT NULL),
{name}timeline AS (SELECT *, CASE WHEN quaternion_score >= gyro_score AND quaternion_score >= accel_score THEN 'quaternion' WHEN gyro_score >= accel_score THEN 'gyro' ELSE 'accel' END AS top_group FROM {name}scored)"""


TIMELINE = f"""{TEL},
{timeline_of("tel")}"""
IDX = "PARTITION BY sequence_name ORDER BY window_end_idx"


def alerts(percent: float = 0.9, name: str = "ann") -> str:
    return f"""{name}0 AS (SELECT *, (SELECT quantile_cont(score, {percent}) FROM timeline) AS threshold FROM timeline),
{name}1 AS (SELECT *, score > threshold AS positive FROM {name}0),
{name}2 AS (SELECT *, sum(positive::INT) OVER ({IDX} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS alert_active FROM {name}1),
{name} AS (SELECT *, alert_active AND NOT lag(alert_active, 1, false) OVER ({IDX}) AS alert_onset FROM {name}2)"""


ANN = f"{TIMELINE}, {alerts()}"
SEGMENTS = f"""seg AS (SELECT sequence_name, segment_id, min(window_end_idx) AS start_idx, max(window_end_idx) AS end_idx, min(time_s) AS start_time_s, max(time_s) AS end_time_s,
        count(*) AS row_count, count(*) * 5 / 50.0 AS duration_s, arg_min(top_group, window_end_idx) AS trigger_group, max(score) AS peak_score
        FROM (SELECT *, sum(alert_onset::BIGINT) OVER ({IDX} {UP_TO_HERE})::BIGINT AS segment_id FROM ann) WHERE alert_active GROUP BY ALL)"""
EVENTS = """lens AS (SELECT event_type AS sequence_name, count(*) AS n FROM events GROUP BY 1),
inj AS (SELECT sequence_name, k AS event_order, CASE k WHEN 1 THEN 'gyro_bias_step' ELSE 'accel_freeze' END AS anomaly_type, 'medium' AS severity,
        CASE k WHEN 1 THEN 'gyro' ELSE 'accel' END AS target_group, n * k // 3 AS start_index, n * k // 3 + 49 AS end_index FROM lens, (VALUES (1), (2)) t(k))"""


def interpolated(grid: str, source: str, columns: list[str], clamp: bool) -> str:
    """SELECT of ``source`` values on the times of ``grid``."""
    def cell(c):
        lerp = f"a.{c} + (b.{c} - a.{c}) * p"
        return f"coalesce({lerp}, a.{c}, b.{c}) AS {c}" if clamp else f"CASE WHEN a.timestamp_ns IS NOT NULL AND b.timestamp_ns IS NOT NULL THEN {lerp} END AS {c}"

    part = "CASE WHEN a.timestamp_ns = b.timestamp_ns THEN 0.0 ELSE (g.timestamp_ns - a.timestamp_ns) / (b.timestamp_ns - a.timestamp_ns) END"
    first = ", ".join(cell(c).replace(" * p", f" * ({part})") for c in columns)
    return f"""SELECT g.sequence_name, g.timestamp_ns, {first}
        FROM {grid} g ASOF LEFT JOIN {source} a ON g.sequence_name = a.sequence_name AND g.timestamp_ns >= a.timestamp_ns
        ASOF LEFT JOIN {source} b ON g.sequence_name = b.sequence_name AND g.timestamp_ns <= b.timestamp_ns"""


GRID_CTE = f"grid AS (SELECT sequence_name, unnest(range(a, b + 1, {GRID})) AS timestamp_ns FROM (SELECT sequence_name, min(timestamp_ns) AS a, max(timestamp_ns) AS b FROM tel GROUP BY 1))"
_PI = "pi()"
CONTEXT = f"""gy AS (SELECT *, atan2(2.0 * (q_w_b_w * q_w_b_z + q_w_b_x * q_w_b_y), 1.0 - 2.0 * (q_w_b_y * q_w_b_y + q_w_b_z * q_w_b_z)) AS y0,
        CASE WHEN timestamp_ns > lag(timestamp_ns) OVER ({W}) THEN (timestamp_ns - lag(timestamp_ns) OVER ({W})) / 1e9 END AS dt FROM gt),
gd AS (SELECT *, y0 - lag(y0) OVER ({W}) AS dy FROM gy),
gf AS (SELECT *, CASE WHEN dy IS NULL OR abs(dy) < {_PI} THEN 0.0 ELSE (dy + {_PI}) - 2 * {_PI} * floor((dy + {_PI}) / (2 * {_PI})) - {_PI} - dy END AS fold FROM gd),
gu AS (SELECT *, y0 + sum(fold) OVER ({W} {UP_TO_HERE}) AS yaw FROM gf),
gv AS (SELECT *, {", ".join(f"({c} - lag({c}) OVER ({W})) / dt AS v{i}" for i, c in enumerate(GT_POSITION))} FROM gu),
ctx AS (SELECT sequence_name, timestamp_ns, {length(["v0", "v1", "v2"])} AS gt_speed_mps, {length(["v0", "v1"])} AS gt_horizontal_speed_mps, abs(v2) AS gt_vertical_speed_mps,
        yaw AS gt_yaw_rad, (yaw - lag(yaw) OVER ({W})) / dt AS gt_yaw_rate_rps FROM gv)"""


def repaired(source: str, name: str) -> str:
    dot = " + ".join(f"{c} * lag({c}) OVER ({W})" for c in QUATERNION)
    return f"""{name}0 AS (SELECT *, {dot} AS dot FROM {source}),
{name}1 AS (SELECT *, count(*) FILTER (WHERE coalesce(dot = 0, true)) OVER ({W} {UP_TO_HERE}) AS part FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN count(*) FILTER (WHERE dot < 0) OVER (PARTITION BY sequence_name, part ORDER BY timestamp_ns {UP_TO_HERE}) % 2 = 1 THEN -1.0 ELSE 1.0 END AS sign FROM {name}1),
{name} AS (SELECT * REPLACE ({", ".join(f"{c} * sign AS {c}" for c in QUATERNION)}) FROM {name}2)"""


FEATURES = f"""{TEL}, {GRID_CTE}, {CONTEXT}, {repaired("tel", "rep")},
onto AS ({interpolated("grid", "rep", RAW, True)}),
unit AS (SELECT * REPLACE ({", ".join(f"{c} / {length(QUATERNION)} AS {c}" for c in QUATERNION)}) FROM onto),
num AS (SELECT *, row_number() OVER ({W}) - 1 AS timestep_index FROM unit),
{derived("num", "der")},
gtg AS ({interpolated("grid", "ctx", GT_CONTEXT, False)}),
ft AS (SELECT {", ".join(["der.sequence_name", "der.timestamp_ns", "timestep_index", *RAW, *DERIVED, *GT_CONTEXT])} FROM der JOIN gtg USING (sequence_name, timestamp_ns))"""
FOLDS = """names AS (SELECT list(s ORDER BY s) AS names FROM (SELECT DISTINCT event_type AS s FROM events)),
folds AS (SELECT 'fold_' || i AS fold_name, list_filter(names, lambda s: s <> names[i]) AS train, names[i] AS validation FROM (SELECT names, unnest(range(1, len(names) + 1)) AS i FROM names))"""


def long(source: str, columns: list[str], name: str, extra: str = "sequence_name") -> str:
    return f"{name} AS (SELECT {extra}, unnest([{', '.join(repr(c) for c in columns)}]) AS column_name, unnest([{', '.join(columns)}]) AS value FROM {source})"


def fitted(mode: str, by: str) -> str:
    center, scale = ("avg(value)", "stddev_pop(value)") if mode == "zscore" else ("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")
    return f"SELECT {by} column_name, {r(center, 'center')}, {r(f'CASE WHEN abs({scale}) <= 1e-12 THEN 1.0 ELSE {scale} END', 'scale')} FROM lg GROUP BY {by} column_name"


FOLD_ROWS = "sides AS (SELECT fold_name, unnest(train) AS sequence_name FROM folds), ftel AS (SELECT fold_name, tel.* FROM tel JOIN sides USING (sequence_name))"
FOLD_WIN = f"""idx AS ({windows_of("tel", 150, 50)}),
fw AS (SELECT fold_name, sequence_name, 'train' AS split_name FROM (SELECT fold_name, unnest(train) AS sequence_name FROM folds) UNION ALL SELECT fold_name, validation, 'validation' FROM folds),
fidx AS (SELECT * FROM fw JOIN idx USING (sequence_name))"""
ALL_FEATURES = RAW + DERIVED + GT_CONTEXT
STATS = f"""{long("ft", ALL_FEATURES, "lf").replace("AS column_name", "AS feature_name")},
spans AS (SELECT sequence_name, (max(timestamp_ns) - min(timestamp_ns)) / 1e9 AS duration_s FROM ft GROUP BY 1),
stats AS (SELECT sequence_name, feature_name, count(*) AS row_count, any_value(duration_s) AS duration_s, avg((value IS NULL)::DOUBLE) AS missing_rate, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min,
        quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, max(value) AS max FROM lf JOIN spans USING (sequence_name) GROUP BY 1, 2)"""
DRIFT = f"""{FOLDS}, {STATS},
fs AS (SELECT fold_name, unnest(train) AS sequence_name, 'train' AS side FROM folds UNION ALL SELECT fold_name, validation, 'validation' FROM folds),
pooled AS (SELECT fold_name, feature_name, side, avg(value) AS m, stddev_pop(value) AS s, avg((value IS NULL)::DOUBLE) AS missing FROM fs JOIN lf USING (sequence_name) GROUP BY ALL),
drift AS (SELECT fold_name, feature_name, t.m AS train_mean, v.m AS validation_mean, abs(t.m - v.m) / greatest(t.s, 1e-12) AS standardized_mean_difference, t.missing AS train_missing_rate, v.missing AS validation_missing_rate
        FROM (SELECT * FROM pooled WHERE side = 'train') t JOIN (SELECT * FROM pooled WHERE side = 'validation') v USING (fold_name, feature_name))"""
SIG_KEYS = ["gyro_norm_mean", "gyro_norm_std", "gyro_norm_p95", "accel_norm_mean", "accel_norm_std", "accel_norm_p95", "dynamic_accel_mean", "dynamic_accel_std", "dynamic_accel_p95", "gyro_delta_std", "accel_delta_std"]


def _sig(name: str, c: str) -> str:
    return f"avg({c}) AS {name}_mean, coalesce(stddev_pop({c}), 0.0) AS {name}_std, quantile_disc({c}, 0.95) AS {name}_p95"


SIGNATURE = f"""{TEL},
sa AS (SELECT sequence_name, timestamp_ns, {length(GYRO)} AS g, {length(ACCEL)} AS a FROM tel),
sb AS (SELECT *, g - lag(g) OVER ({W}) AS dg, a - lag(a) OVER ({W}) AS da, abs(a - (SELECT median(a) FROM sa x WHERE x.sequence_name = sa.sequence_name)) AS d FROM sa),
sig AS (SELECT sequence_name, {_sig("gyro_norm", "g")}, {_sig("accel_norm", "a")}, {_sig("dynamic_accel", "d")}, coalesce(stddev_pop(dg), 0.0) AS gyro_delta_std, coalesce(stddev_pop(da), 0.0) AS accel_delta_std FROM sb GROUP BY 1)"""
ZSCORES = f"""{SIGNATURE}, {long("sig", SIG_KEYS, "sl").replace("AS column_name", "AS key")},
zv AS (SELECT sequence_name, key, (value - avg(value) OVER k) / CASE WHEN stddev_pop(value) OVER k = 0 THEN 1.0 ELSE stddev_pop(value) OVER k END AS z FROM sl WINDOW k AS (PARTITION BY key)),
cand AS (SELECT min(sequence_name) AS c FROM zv)"""


def scale_of(columns: list[str], name: str) -> str:
    return f"""{name}l AS (SELECT sequence_name, unnest([{", ".join(columns)}]) AS x FROM tel),
{name}m AS (SELECT sequence_name, median(x) AS m FROM {name}l GROUP BY 1),
{name} AS (SELECT sequence_name, CASE WHEN median(abs(x - m)) <= 1e-6 THEN 1.0 ELSE median(abs(x - m)) END AS scale FROM {name}l JOIN {name}m USING (sequence_name) GROUP BY 1)"""


def injection(kind: str, severity: str = "medium", start: int = 100, seed: int = 7) -> str:
    """The fault written into a span of every sequence."""
    rows, factor = DURATION[kind], SEVERITY[severity]
    last = "max(timestep_index) OVER (PARTITION BY sequence_name)"
    head = f"""{TEL}, tl AS (SELECT *, least({last}, {start + rows - 1}) AS e FROM tel), t AS (SELECT *, timestep_index - {start} AS k, e - {start} + 1 AS m, timestep_index BETWEEN {start} AND e AS inside FROM tl)"""
    group = {"gyro": GYRO, "accel": ACCEL}.get(TARGET[kind], ACCEL + GYRO)
    amount, joins, ctes = f"{factor} * scale", "", ""

    def with_scale(columns):
        nonlocal joins, ctes
        ctes += ", " + scale_of(columns, "sc")
        joins += " JOIN sc USING (sequence_name)"

    def source(index: str):
        nonlocal joins
        joins += f" JOIN tel s ON s.sequence_name = t.sequence_name AND s.timestep_index = ({index})"

    change: dict[str, str] = {}
    if kind == "gyro_bias_step":
        with_scale(GYRO)
        change = {c: f"t.{c} + {amount}" for c in GYRO}
    elif kind.endswith("_bias_drift"):
        with_scale(group)
        change = {c: f"t.{c} + {amount} * CASE WHEN m > 1 THEN k / greatest(m - 1, 1) ELSE 0.0 END" for c in group}
    elif kind.endswith("_freeze"):
        source(str(start))
        change = {c: f"s.{c}" for c in group}
    elif kind == "noise_burst":
        with_scale(ACCEL + GYRO)
        values = ", ".join("(" + ", ".join([str(start + i), *(repr(float(x)) + "::DOUBLE" for x in row)]) + ")" for i, row in enumerate(noise_table(seed, rows)))
        joins += f" LEFT JOIN (VALUES {values}) z(i, {', '.join(f'n{q}' for q in range(6))}) ON z.i = t.timestep_index"
        change = {c: f"t.{c} + {amount} * n{q}" for q, c in enumerate(ACCEL + GYRO)}
    elif kind in ("clipping", "hard_clipping"):
        with_scale(ACCEL)
        most = amount if kind == "clipping" else f"{HARD_CLIP[severity]} * scale"
        change = {c: f"greatest(-({most}), least({most}, t.{c}))" for c in ACCEL}
    elif kind == "packet_dropout":
        source(f"CASE WHEN NOT inside OR k % 2 = 0 THEN t.timestep_index WHEN (k // 2) % 2 = 1 THEN {start} + 2 * (k // 2) WHEN k // 2 >= 1 THEN {start} + 2 * (k // 2 - 1) ELSE {start - 1} END")
        change = {c: f"s.{c}" for c in RAW}
    elif kind == "sensor_lag":
        source(f"CASE WHEN inside THEN greatest(0, t.timestep_index - {LAG_ROWS[severity]}) ELSE t.timestep_index END")
        change = {c: f"s.{c}" for c in ACCEL}
    elif kind == "timestamp_jitter":
        values = ", ".join(f"({start + i}, {start + low}, {part!r}::DOUBLE)" for i, low, part in warp_table(severity, seed, rows))
        joins = f" LEFT JOIN (VALUES {values}) z(i, low, part) ON z.i = t.timestep_index LEFT JOIN tel s ON s.sequence_name = t.sequence_name AND s.timestep_index = low LEFT JOIN tel u ON u.sequence_name = t.sequence_name AND u.timestep_index = low + 1"
        change = {c: f"s.{c} + (u.{c} - s.{c}) * part" for c in RAW}
    elif kind == "cross_axis_leakage":
        change = {c: f"t.{c} + {LEAKAGE[severity]} * t.{o}" for c, o in zip(ACCEL, ACCEL[1:] + ACCEL[:1], strict=True)}
    elif kind == "gyro_accel_inconsistency":
        turn, (x, y) = math.radians(ROTATION_DEG[severity]), ACCEL[:2]
        change = {x: f"t.{x} * {math.cos(turn)!r}::DOUBLE - t.{y} * {math.sin(turn)!r}::DOUBLE", y: f"t.{x} * {math.sin(turn)!r}::DOUBLE + t.{y} * {math.cos(turn)!r}::DOUBLE"}
    else:
        with_scale(group)
        wave = {"impact_pulse": "0.5 - 0.5 * cos(2 * pi() * (k + 1) / (m + 1))", "vibration_burst": "sin(4 * pi() * k / greatest(m - 1, 1))", "angular_rate_burst": "sin(2 * pi() * k / greatest(m - 1, 1))"}[kind]
        change = {group[2]: f"t.{group[2]} + {amount} * ({wave})"}
    cells = ", ".join(r(f"CASE WHEN inside THEN {change[c]} ELSE t.{c} END" if c in change else f"t.{c}", c) for c in RAW)
    return f"WITH {head}{ctes} SELECT t.sequence_name, t.timestamp_ns, t.timestep_index, {cells} FROM t{joins}"


DRIVE = """dr AS (SELECT o_orderstatus AS run, substr(o_orderpriority, 1, 1) AS phase, o_orderkey::DOUBLE AS t, o_totalprice / 1000 AS x, (o_custkey % 100) / 10.0::DOUBLE AS y,
        (o_orderkey % 7 - 3) / 10.0::DOUBLE AS vx, (o_custkey % 5 - 2) / 10.0::DOUBLE AS vy, (o_orderkey % 63) / 10.0::DOUBLE - 3.1::DOUBLE AS yaw, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 0.25 END AS cmd_speed FROM orders)"""
RAW_EVENTS = f"{EV}, raw AS (SELECT sequence_name, timestamp_ns, event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE value::VARCHAR END AS value, CASE WHEN event_id % 11 <> 0 THEN props END AS props FROM ev)"
TIMES = """ts0 AS (SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY sequence_name ORDER BY event_id) AS d FROM ev),
tsum AS (SELECT sequence_name, count(*) AS row_count, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, median(d) FILTER (WHERE d > 0) AS m, count(*) FILTER (WHERE d = 0) AS duplicate_count, count(*) FILTER (WHERE d < 0) AS non_monotonic_count FROM ts0 GROUP BY 1)"""


def missing(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT sequence_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR {c}::VARCHAR = '') AS missing FROM raw GROUP BY 1" for c in columns)


def nulls(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT sequence_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS violations FROM {source} GROUP BY 1" for c in columns)


def validation() -> str:
    total = lambda source, columns: f"SELECT sequence_name, sum(violations)::BIGINT AS violations FROM ({nulls(source, columns)}) GROUP BY 1"
    steps = lambda source: f"SELECT sequence_name, count(*) FILTER (WHERE d <= 0) AS violations FROM (SELECT sequence_name, timestamp_ns - lag(timestamp_ns) OVER ({W}) AS d FROM {source}) GROUP BY 1"
    dot = " + ".join(f"{c} * lag({c}) OVER ({W})" for c in GT_QUATERNION)
    parts = {"imu_null": total("tel", RAW), "gt_null": total("gt", GT_POSITION + GT_QUATERNION), "imu_order": steps("tel"), "gt_order": steps("gt"), "gt_quaternion": f"SELECT sequence_name, count(*) FILTER (WHERE d < 0) AS violations FROM (SELECT sequence_name, {dot} AS d FROM gt) GROUP BY 1"}
    return f"WITH {TEL} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, sequence_name, violations FROM ({q})" for n, q in parts.items())


def fir() -> str:
    weights = fir_weights(8, 0.1)

    def cell(c):
        parts = []
        for i, t in zip(range(-8, 9), weights, strict=True):
            near = f"coalesce({'lag' if i < 0 else 'lead'}({c}, {abs(i)}) OVER ({W}), {'first' if i < 0 else 'last'}_value({c}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" if i else c
            parts.append(f"{near} * {t!r}::DOUBLE")
        return r(" + ".join(parts), c)

    return f"WITH {TEL} SELECT {KEYS}, {', '.join(map(cell, GYRO + ACCEL))} FROM tel"


LENIENT = """first_hit AS (SELECT i.sequence_name, event_order, min(window_end_idx) AS i, arg_min(top_group, window_end_idx) AS g FROM inj i JOIN ann a ON a.sequence_name = i.sequence_name AND alert_active AND window_end_idx >= start_index GROUP BY ALL),
lenient AS (SELECT sequence_name, event_order, anomaly_type, severity, target_group, coalesce((i <= end_index + 50)::DOUBLE, 0.0) AS event_detected,
        coalesce(greatest(0.0, (i - start_index) / 50.0), 'inf'::DOUBLE) AS time_to_detect_s, coalesce(g, '') AS top_group_prediction, CASE WHEN g IS NOT NULL THEN (g = target_group)::DOUBLE END AS group_attribution_correct
        FROM inj LEFT JOIN first_hit USING (sequence_name, event_order))"""
_PRE = "window_end_idx >= greatest(0, start_index - 50) AND window_end_idx < start_index"
_DUR = "window_end_idx >= start_index AND window_start_idx <= end_index"
_POST = "window_start_idx > end_index AND window_start_idx <= end_index + 50"


def strict_of(events: str, annotated: str, grace: int = 50) -> str:
    """CTEs up to ``strict``: events judged against an annotated timeline."""
    inside = f"window_end_idx >= start_index AND window_end_idx <= end_index + {grace}"
    outside = f"(window_end_idx < start_index OR window_start_idx > end_index + {grace})"
    return f"""st0 AS (SELECT i.sequence_name, event_order, anomaly_type, severity, target_group, start_index, end_index,
        count(*) FILTER (WHERE {_PRE} AND alert_onset) AS pre_event_alert_onset_count, count(*) FILTER (WHERE {_PRE} AND alert_active) AS pre_event_alert_active_count,
        count(*) FILTER (WHERE {outside} AND alert_onset) AS outside_event_alert_onset_count, count(*) FILTER (WHERE {outside} AND alert_active) AS outside_event_alert_active_count,
        min(window_end_idx) FILTER (WHERE {inside} AND alert_onset) AS fi, arg_min(top_group, window_end_idx) FILTER (WHERE {inside} AND alert_onset) AS fg,
        median(score) FILTER (WHERE {_PRE}) AS baseline_score, max(score) FILTER (WHERE {_DUR}) AS during_max_score, median(score) FILTER (WHERE {_DUR}) AS during_median_score, median(score) FILTER (WHERE {_POST}) AS post_median_score
        FROM {events} i LEFT JOIN {annotated} a ON a.sequence_name = i.sequence_name GROUP BY ALL),
strict AS (SELECT sequence_name, event_order, anomaly_type, severity, target_group, start_index, end_index, pre_event_alert_active_count > 0 AS preexisting_alert, pre_event_alert_onset_count, pre_event_alert_active_count,
        outside_event_alert_onset_count, outside_event_alert_active_count, (fi IS NOT NULL AND pre_event_alert_active_count = 0)::DOUBLE AS event_detected_strict,
        CASE WHEN fi IS NOT NULL AND pre_event_alert_active_count = 0 THEN greatest(0.0, (fi - start_index) / 50.0) ELSE 'inf'::DOUBLE END AS time_to_detect_s, coalesce(fg, '') AS alert_trigger_group,
        CASE WHEN fi IS NOT NULL AND pre_event_alert_active_count = 0 AND target_group IN ('quaternion', 'gyro', 'accel') THEN (fg = target_group)::DOUBLE END AS group_attribution_correct, baseline_score, during_max_score, during_median_score, post_median_score,
        during_max_score - baseline_score AS score_lift_abs, CASE WHEN abs(baseline_score) > 1e-12 THEN during_max_score / baseline_score END AS score_lift_ratio FROM st0)"""


STRICT = strict_of("inj", "ann")
QUIET = f"""{TIMELINE}, {alerts(0.97)}, lens AS (SELECT event_type AS sequence_name, count(*) AS n FROM events GROUP BY 1),
cs AS (SELECT sequence_name, unnest(range(150, greatest(150, n - 191) + 1, 25)) AS start_index FROM lens),
quiet AS (SELECT c.sequence_name, start_index, max(score) AS region_max_score, coalesce(median(score) FILTER (WHERE window_end_idx < start_index), median(score)) AS baseline_score
        FROM cs c JOIN ann a ON a.sequence_name = c.sequence_name AND window_end_idx >= start_index - 150 AND window_start_idx <= start_index + 190 GROUP BY ALL HAVING NOT bool_or(alert_active))"""
def baseline_of(name: str = "") -> str:
    """CTEs up to ``<name>ab``: trailing median and distance of ``<name>timeline``."""
    return f"""{name}ab0 AS (SELECT *, row_number() OVER ({IDX}) AS rn, list(score) OVER ({IDX} ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING) AS past FROM {name}timeline),
{name}ab1 AS (SELECT *, list_aggregate(past, 'median') AS m FROM {name}ab0),
{name}ab AS (SELECT * EXCLUDE (past, m), coalesce(m, score) AS trailing_median, CASE WHEN len(past) > 0 THEN list_aggregate(list_transform(past, lambda x: abs(x - m)), 'median') ELSE 0.0 END AS trailing_mad FROM {name}ab1)"""


ADAPT = f"""{TIMELINE},
{baseline_of()}"""
_SCALE = "greatest(1.4826 * trailing_mad, 1e-6, 0.05 * greatest(abs(trailing_median), 1e-6))"


def adaptive_of(z: float, name: str = "") -> str:
    """CTEs up to ``<name>st``: the adaptive state after each row of ``<name>ab``; needs WITH RECURSIVE."""
    positive = lambda b, s: f"((t.score - {b}) / {s} > {z} AND t.score > {b})"
    ts = _SCALE.replace("trailing", "t.trailing")
    base, scale = "CASE WHEN p.active THEN p.baseline ELSE t.trailing_median END", f"CASE WHEN p.active THEN p.scale ELSE {ts} END"
    pos = positive(f"({base})", f"({scale})")
    return f"""{name}st AS (SELECT t.sequence_name, t.rn, t.window_end_idx, t.score, t.trailing_median AS baseline, {ts} AS scale, false AS positive, 0 AS run, false AS active, false AS onset FROM {name}ab t WHERE rn = 1
        UNION ALL SELECT t.sequence_name, t.rn, t.window_end_idx, t.score, {base}, {scale}, {pos}, CASE WHEN {pos} THEN p.run + 1 ELSE 0 END, {pos} AND p.run + 1 >= 2, ({pos} AND p.run + 1 >= 2) AND NOT p.active
        FROM {name}st p JOIN {name}ab t ON t.sequence_name = p.sequence_name AND t.rn = p.rn + 1)"""


def adaptive(z: float) -> str:
    return f"""WITH RECURSIVE {ADAPT},
{adaptive_of(z)}
SELECT sequence_name, window_end_idx, {rr(["baseline", "scale"])}, {r("(score - baseline) / scale", "normalized_score")}, positive, active AS alert_active, onset AS alert_onset FROM st"""


def nms(rounds: int = 3, gap: int = 300) -> str:
    ctes, picks = [QUIET, "q0 AS (SELECT * FROM quiet)"], []
    for k in range(1, rounds + 1):
        ctes.append(f"p{k} AS (SELECT sequence_name, {k} AS choice, start_index, region_max_score, baseline_score FROM (SELECT *, row_number() OVER (PARTITION BY sequence_name ORDER BY region_max_score, baseline_score, start_index) AS n FROM q{k - 1}) WHERE n = 1)")
        ctes.append(f"q{k} AS (SELECT q.* FROM q{k - 1} q JOIN p{k} p USING (sequence_name) WHERE abs(q.start_index - p.start_index) >= {gap})")
        picks.append(f"SELECT * FROM p{k}")
    return f"WITH {', '.join(ctes)} SELECT sequence_name, choice, start_index, {rr(['region_max_score', 'baseline_score'])} FROM ({' UNION ALL '.join(picks)})"


ODOM = f"""WITH {TEL}, ty AS (SELECT *, atan2(2.0 * (q_w * q_z + q_x * q_y), 1.0 - 2.0 * (q_y * q_y + q_z * q_z)) + pi() AS yaw FROM tel)
SELECT {KEYS}, 0.0::DOUBLE AS q_x, 0.0::DOUBLE AS q_y, {r("sin(yaw / 2)", "q_z")}, {r("cos(yaw / 2)", "q_w")}, {r("-lin_acc_x", "vx")}, {r("-lin_acc_y", "vy")}, {r("lin_acc_z", "vz")} FROM ty"""
PHASES = f"""WITH {DRIVE}, ends AS (SELECT phase, arg_min(x, t) AS x0, arg_max(x, t) AS x1, arg_min(y, t) AS y0, arg_max(y, t) AS y1, arg_min(yaw, t) AS w0, arg_max(yaw, t) AS w1, greatest(max(t) - min(t), 1e-9) AS dur, count(*) AS c FROM dr GROUP BY 1 HAVING count(*) >= 3),
e2 AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS disp FROM ends),
st AS (SELECT *, lag(x) OVER p AS px, lag(y) OVER p AS py, t - lag(t) OVER p AS dt FROM dr WINDOW p AS (PARTITION BY phase ORDER BY t)),
sp AS (SELECT *, CASE WHEN dt > 1e-9 THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) / dt END AS speed FROM st)
SELECT phase, count(*) AS sample_count, {r("any_value(dur)", "duration_s")}, {r("any_value(disp)", "displacement_m")}, {r("any_value(disp / dur)", "chord_speed_mps")}, {r("coalesce(avg(speed), 0.0)", "pose_speed_mean_mps")},
        {r("coalesce(quantile_cont(speed, 0.5), 0.0)", "pose_speed_p50_mps")}, {r("coalesce(quantile_cont(speed, 0.95), 0.0)", "pose_speed_p95_mps")}, {r("avg(-vx)", "twist_visual_speed_mean_mps")}, {r("avg(sqrt(vx * vx + vy * vy))", "twist_norm_speed_mean_mps")},
        {r("max(CASE WHEN disp > 1e-9 THEN abs((-(x - x0) * (y1 - y0) + (y - y0) * (x1 - x0)) / disp) ELSE 0.0 END)", "max_abs_lateral_deviation_m")}, {r("any_value(degrees(w1 - w0))", "yaw_change_deg")}
FROM sp JOIN e2 USING (phase) GROUP BY 1"""


def _moved(name: str, condition: str) -> str:
    at = lambda f, c: f"{f}({c}, t) FILTER (WHERE {condition})"
    dx, dy = (f"({at('arg_max', c)} - {at('arg_min', c)})" for c in "xy")
    return r(f"CASE WHEN count(*) FILTER (WHERE {condition}) >= 2 THEN sqrt({dx} * {dx} + {dy} * {dy}) ELSE 0.0 END", f"{name}_displacement_m")


_MOVING, _NORM = "abs(cmd_speed) > 1e-6", "sqrt(vx * vx + vy * vy)"


def oracle_sql() -> dict[str, str]:
    tel = f"WITH {TEL}"
    out = {
        "telemetry_base": f"{tel} SELECT {KEYS}, event_id, {rr(RAW)} FROM tel",
        "derived_features": f"{tel}, {derived('tel', 'der')} SELECT {KEYS}, {rr(DERIVED)} FROM der",
        "window_index": f"{tel} {windows_of('tel', 150, 50)} UNION ALL {windows_of('tel', 150, 5)}",
        "window_scores": f"WITH {TIMELINE} SELECT sequence_name, window_start_idx, window_end_idx, timestamp_ns, {rr(['time_s', 'score'])} FROM timeline",
        "group_scores": f"WITH {TIMELINE} SELECT sequence_name, window_start_idx, {rr([f'{g}_score' for g in GROUPS])}, top_group FROM timeline",
        "score_threshold": f"WITH {TIMELINE} " + " UNION ALL ".join(f"SELECT sequence_name, {r(f'quantile_cont(score, {p / 100})', 'threshold')}, {p}::DOUBLE AS percent FROM timeline GROUP BY 1" for p in (50.0, 90.0, 99.0)),
        "alert_timeline": f"WITH {ANN} SELECT sequence_name, window_start_idx, window_end_idx, {rr(['score', 'threshold'])}, positive, alert_active, alert_onset FROM ann",
        "alert_segments": f"WITH {ANN}, {SEGMENTS} SELECT sequence_name, segment_id, start_idx, end_idx, {rr(['start_time_s', 'end_time_s'])}, row_count, {r('duration_s', 'duration_s')}, trigger_group, {r('peak_score', 'peak_score')} FROM seg",
        "timestamp_summary": f"WITH {EV}, {TIMES} SELECT sequence_name, row_count, first_ns, last_ns, {r('(last_ns - first_ns) / 1e9', 'duration_s')}, {r('m / 1e9', 'median_step_s')}, {r('1e9 / m', 'rate_hz')}, duplicate_count, non_monotonic_count FROM tsum",
        "missing_counts": f"WITH {RAW_EVENTS} {missing(['value', 'props'])}",
        "csv_profile": f"WITH {RAW_EVENTS}, {TIMES}, mi AS ({missing(['value', 'props'])}) SELECT sequence_name, any_value(row_count) AS row_count, {r('any_value((last_ns - first_ns) / 1e9)', 'duration_s')}, {r('any_value(1e9 / m)', 'rate_hz')}, sum(missing)::BIGINT AS missing_total, max(missing) AS missing_most, 2 AS column_count, 'ok' AS status FROM mi JOIN tsum USING (sequence_name) GROUP BY 1",
        "platform_hints": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ugv' WHEN 1 THEN 'legrobot' WHEN 2 THEN 'rc' ELSE 'unknown' END AS platform FROM customer",
        "raw_manifest": """WITH f AS (SELECT 'run_' || s_nationkey AS sequence_name, ['imu_data.csv', 'run_gt.zip', 'run_folder.zip', 'calibration.yaml', 'notes.txt'][s_suppkey % 5 + 1] AS file FROM supplier),
            h AS (SELECT sequence_name, bool_or(file = 'imu_data.csv') AS a, bool_or(file = 'run_gt.zip') AS b, bool_or(file = 'run_folder.zip') AS c, bool_or(file = 'calibration.yaml') AS d, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM f GROUP BY 1)
            SELECT 'run_' || n_nationkey AS sequence_name, coalesce(a, false) AS has_imu_csv, coalesce(b, false) AS has_gt_zip, coalesce(c, false) AS has_folder_zip, coalesce(d, false) AS has_calibration, coalesce(files, '') AS files FROM nation LEFT JOIN h ON h.sequence_name = 'run_' || n_nationkey""",
        "listing_parse": "SELECT 'prefix' AS kind, n_name AS name FROM nation UNION ALL SELECT 'file', replace(r_name, ' ', '_') || '.csv' FROM region",
        "manifest_upsert": "SELECT 'run_' || n_nationkey AS sequence_name, 1 AS version FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 10 FROM region) UNION ALL SELECT 'run_' || (r_regionkey * 10), 2 FROM region",
        "overlap_trim": f"""{tel}, i AS (SELECT sequence_name, min(timestamp_ns) AS a, max(timestamp_ns) AS b, count(*) AS c FROM tel GROUP BY 1), g AS (SELECT sequence_name, min(timestamp_ns) AS a, max(timestamp_ns) AS b, count(*) AS c FROM gt GROUP BY 1),
            o AS (SELECT i.sequence_name, greatest(i.a, g.a) AS s, least(i.b, g.b) AS e, i.c AS ic, g.c AS gc FROM i JOIN g USING (sequence_name))
            SELECT sequence_name, s AS overlap_start_ns, e AS overlap_end_ns, ic AS imu_rows_before, (SELECT count(*) FROM tel WHERE tel.sequence_name = o.sequence_name AND timestamp_ns BETWEEN s AND e) AS imu_rows_after, gc AS gt_rows_before, (SELECT count(*) FROM gt WHERE gt.sequence_name = o.sequence_name AND timestamp_ns BETWEEN s AND e) AS gt_rows_after FROM o""",
        "order_violations": f"WITH {EV}, {TIMES} SELECT sequence_name, duplicate_count + non_monotonic_count AS violations FROM tsum",
        "null_violations": f"{tel}, h AS (SELECT * REPLACE ({', '.join(f'CASE WHEN event_id % {m} <> 0 THEN {c} END AS {c}' for c, m in zip(ACCEL, (5, 7, 11), strict=True))}) FROM tel) {nulls('h', RAW)}",
        "quaternion_sign_repair": f"{tel}, fl AS (SELECT * REPLACE ({', '.join(f'{c} * CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE 1.0 END AS {c}' for c in QUATERNION)}) FROM tel), {repaired('fl', 'rep')} SELECT {KEYS}, {rr(QUATERNION)} FROM rep",
        "quaternion_norm_check": f"{tel}, b AS (SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN q_w * 1.01 ELSE q_w END AS q_w) FROM tel) SELECT sequence_name, count(*) AS row_count, count(*) FILTER (WHERE abs({length(QUATERNION)} - 1.0) > 1e-4 + 1e-5) AS violations FROM b GROUP BY 1",
        "clean_validation": validation(),
        "uniform_grid": f"{tel}, {GRID_CTE} SELECT * FROM grid",
        "interp_imu": f"{tel}, {GRID_CTE}, o AS ({interpolated('grid', 'tel', GYRO + ACCEL, True)}) SELECT sequence_name, timestamp_ns, {rr(GYRO + ACCEL)} FROM o",
        "gt_context_native": f"{tel}, {CONTEXT} SELECT sequence_name, timestamp_ns, {rr(GT_CONTEXT)} FROM ctx",
        "gt_context_aligned": f"{tel}, {GRID_CTE}, {CONTEXT}, o AS ({interpolated('grid', 'ctx', GT_CONTEXT, False)}) SELECT sequence_name, timestamp_ns, {rr(GT_CONTEXT)} FROM o",
        "yaw_unwrap_simple": f"WITH {DRIVE}, d AS (SELECT run, t, yaw, yaw - lag(yaw) OVER (PARTITION BY run ORDER BY t) AS d FROM dr) SELECT run, {r('t', 'timestamp_ns')}, {r('yaw', 'yaw')}, {r('yaw + sum(CASE WHEN d > pi() THEN -2 * pi() WHEN d < -pi() THEN 2 * pi() ELSE 0.0 END) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'yaw_unwrapped')} FROM d",
        "source_rate": f"{tel} SELECT sequence_name, {r('1e9 / median(d) * 1e6', 'source_rate_uhz')} FROM (SELECT sequence_name, timestamp_ns - lag(timestamp_ns) OVER ({W}) AS d FROM tel) GROUP BY 1",
        "feature_table": f"WITH {FEATURES} SELECT {KEYS}, {rr(ALL_FEATURES)} FROM ft",
        "lowpass_fir": fir(),
        "loso_folds": f"WITH {FOLDS} SELECT fold_name, array_to_string(train, ',') AS train, validation, feature_set, mode FROM folds, (VALUES ('raw'), ('raw_plus_derived')) a(feature_set), (VALUES ('zscore'), ('robust')) b(mode)",
        "normalizer_zscore": f"{tel}, {FOLDS}, {FOLD_ROWS}, {long('ftel', RAW, 'lg', 'fold_name')} {fitted('zscore', 'fold_name,')}",
        "normalizer_robust": f"{tel}, {FOLDS}, {FOLD_ROWS}, {long('ftel', RAW, 'lg', 'fold_name')} {fitted('robust', 'fold_name,')}",
        "normalizer_full_dev": f"{tel}, {long('tel', RAW, 'lg', 'event_id')} " + " UNION ALL ".join(f"SELECT *, '{m}' AS mode FROM ({fitted(m, '')})" for m in ("zscore", "robust")),
        "normalized_windows": f"{tel}, idx AS ({windows_of('tel', 150, 50)}), z AS (SELECT sequence_name, timestep_index, (q_x - (SELECT avg(q_x) FROM tel)) / (SELECT stddev_pop(q_x) FROM tel) AS a, (lin_acc_z - (SELECT avg(lin_acc_z) FROM tel)) / (SELECT stddev_pop(lin_acc_z) FROM tel) AS b FROM tel) SELECT idx.sequence_name, start_row, count(*) AS row_count, {r('sum(a)', 'sum_q_x')}, {r('sum(b)', 'sum_lin_acc_z')} FROM idx JOIN z ON z.sequence_name = idx.sequence_name AND timestep_index BETWEEN start_row AND end_row GROUP BY ALL",
        "window_dedup": f"{tel}, {FOLDS}, {FOLD_WIN} SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY sequence_name, start_row, end_row ORDER BY fold_name DESC) AS n FROM fidx WHERE split_name = 'train') WHERE n = 1",
        "tail_split": f"{tel}, idx AS ({windows_of('tel', 150, 50)}), k AS (SELECT *, row_number() OVER (ORDER BY sequence_name, start_row) AS i, count(*) OVER () AS c FROM idx) SELECT * EXCLUDE (i, c), CASE WHEN i > c - greatest(1, c // 10) THEN 'validation' ELSE 'train' END AS split_name FROM k",
        "window_index_validation": f"""{tel}, idx AS ({windows_of("tel", 150, 50)}), b AS (SELECT * REPLACE (CASE WHEN start_row % 100 = 0 THEN start_timestamp_ns + 1 ELSE start_timestamp_ns END AS start_timestamp_ns, CASE WHEN start_row % 150 = 0 THEN end_row + 100000 ELSE end_row END AS end_row) FROM idx),
            x AS (SELECT b.*, s.timestamp_ns AS st, e.timestamp_ns AS et FROM b LEFT JOIN tel s ON s.sequence_name = b.sequence_name AND s.timestep_index = start_row LEFT JOIN tel e ON e.sequence_name = b.sequence_name AND e.timestep_index = end_row)
            SELECT 'bounds' AS rule, count(*) FILTER (WHERE start_row < 0 OR end_row < start_row) AS violations FROM x UNION ALL SELECT 'size', count(*) FILTER (WHERE end_row - start_row + 1 <> window_size) FROM x
            UNION ALL SELECT 'start_time', count(*) FILTER (WHERE st IS NULL OR st <> start_timestamp_ns) FROM x UNION ALL SELECT 'end_time', count(*) FILTER (WHERE et IS NULL OR et <> end_timestamp_ns) FROM x""",
        "sequence_feature_stats": f"WITH {FEATURES}, {STATS} SELECT sequence_name, feature_name, row_count, {rr(['duration_s', 'missing_rate', 'mean', 'std', 'min', 'p01', 'p50', 'p99', 'max'])} FROM stats",
        "fold_window_counts": f"{tel}, {FOLDS}, {FOLD_WIN} SELECT fold_name, split_name, stride, count(*) AS window_count FROM fidx GROUP BY ALL",
        "feature_drift": f"WITH {FEATURES}, {DRIFT} SELECT fold_name, feature_name, {rr(['train_mean', 'validation_mean', 'standardized_mean_difference', 'train_missing_rate', 'validation_missing_rate'])} FROM drift",
        "top_drift": f"WITH {FEATURES}, {DRIFT}, k AS (SELECT row_number() OVER (ORDER BY round(standardized_mean_difference, 6) DESC, fold_name, feature_name) AS drift_rank, * FROM drift) SELECT drift_rank, fold_name, feature_name, {r('standardized_mean_difference', 'standardized_mean_difference')} FROM k WHERE drift_rank <= 5",
        "qa_summary": f"""WITH {FEATURES}, {DRIFT}, s AS (SELECT (SELECT max(missing_rate) FROM stats WHERE feature_name NOT LIKE 'gt_%') AS a, (SELECT max(missing_rate) FROM stats WHERE feature_name LIKE 'gt_%') AS b, (SELECT max(standardized_mean_difference) FROM drift WHERE feature_name NOT LIKE 'gt_%') AS c)
            SELECT {r("a", "max_model_missing_rate")}, {r("b", "max_gt_missing_rate")}, {r("c", "max_standardized_mean_difference")}, CASE WHEN a > 0 THEN 'fix_before_modeling' WHEN b > 0.10 OR c > 5 THEN 'proceed_with_caveats' ELSE 'proceed' END AS recommendation FROM s""",
        "signature_manifest": f"""WITH {SIGNATURE}, {TIMES.replace("FROM ev", "FROM tel")}, ms AS (SELECT sequence_name, '{{"read_lin_acc_x":' || count(*) FILTER (WHERE event_id % 5 = 0) || ',"read_lin_acc_y":' || count(*) FILTER (WHERE event_id % 7 = 0) || '}}' AS missing FROM tel GROUP BY 1)
            SELECT sequence_name, row_count, first_ns, last_ns, {r('(last_ns - first_ns) / 1e9', 'duration_s')}, {r('m / 1e9', 'median_step_s')}, {r('1e9 / m', 'rate_hz')}, duplicate_count, non_monotonic_count, missing, {rr(SIG_KEYS)} FROM tsum JOIN ms USING (sequence_name) JOIN sig USING (sequence_name)""",
        "motion_signature": f"WITH {SIGNATURE} SELECT sequence_name, {rr(SIG_KEYS)} FROM sig",
        "zscore_vectors": f"WITH {ZSCORES} SELECT sequence_name, key, {r('z', 'z')} FROM zv",
        "cohort_decision": f"""WITH {ZSCORES}, ref AS (SELECT * FROM zv WHERE sequence_name <> (SELECT c FROM cand)), tot AS (SELECT key, sum(z) AS s, count(*) AS n FROM ref GROUP BY 1),
            own AS (SELECT sequence_name, sqrt(sum(pow(z - (s - z) / (n - 1), 2))) AS d FROM ref JOIN tot USING (key) GROUP BY 1), cd AS (SELECT sqrt(sum(pow(z - s / n, 2))) AS d FROM zv JOIN tot USING (key) WHERE sequence_name = (SELECT c FROM cand))
            SELECT (SELECT c FROM cand) AS candidate, {r("cd.d", "candidate_distance")}, {r("(SELECT max(d) FROM own)", "max_reference_distance")}, CASE WHEN cd.d <= (SELECT max(d) FROM own) THEN 'merge' ELSE 'separate' END AS recommendation FROM cd""",
        "nearest_neighbours": f"WITH {ZSCORES}, me AS (SELECT key, z AS o FROM zv WHERE sequence_name = (SELECT c FROM cand)), d AS (SELECT sequence_name, sqrt(sum(pow(z - o, 2))) AS distance FROM zv JOIN me USING (key) WHERE sequence_name <> (SELECT c FROM cand) GROUP BY 1) SELECT sequence_name, {r('distance', 'distance')}, row_number() OVER (ORDER BY distance, sequence_name) AS neighbour_rank FROM d",
        "robust_scale": f"{tel}, {scale_of(GYRO, 'sg')}, {scale_of(ACCEL, 'sx')} SELECT sequence_name, {r('scale', 'scale')}, 'gyro' AS group_name FROM sg UNION ALL SELECT sequence_name, {r('scale', 'scale')}, 'accel' FROM sx",
        "motion_gate": f"""{tel}, {CONTEXT}, g AS (SELECT sequence_name, timestamp_ns, coalesce(gt_speed_mps * 1000 > 0.263, false) AS s, coalesce(abs(gt_vertical_speed_mps * 300) > 0.05, false) AS v, coalesce(abs(gt_yaw_rate_rps * 300) > 0.114, false) AS y FROM ctx)
            SELECT sequence_name, timestamp_ns, s OR v OR y AS gyro_bias_step, (s OR v OR y) AND (s OR v) AS impact_pulse, (s OR v OR y) AND (s OR y) AS angular_rate_burst, (s OR v OR y) AND (s OR y) AS sensor_lag FROM g""",
        "demo_schedule": """WITH l AS (SELECT event_type AS sequence_name, count(*) AS n FROM events GROUP BY 1), p(k, t, g, d) AS (VALUES (1, 'gyro_bias_drift', 'gyro', 75), (2, 'accel_freeze', 'accel', 40), (3, 'clipping', 'accel', 20)),
            x AS (SELECT *, least(greatest(150, floor(150 + (n - 51 - 150) * (k / 4))::BIGINT), greatest(150, n - 51 - d)) AS s FROM l, p WHERE n - 1 > 200)
            SELECT sequence_name, k AS event_order, t AS anomaly_type, 'medium' AS severity, g AS target_group, s AS start_index, s + d - 1 AS end_index FROM x""",
        "clean_summary": f"""WITH {ANN}, {SEGMENTS}, l AS (SELECT event_type AS sequence_name, count(*) AS n FROM events GROUP BY 1), b AS (SELECT sequence_name, any_value(threshold) AS threshold, avg(alert_active::DOUBLE) AS ar, sum(alert_onset::BIGINT) AS s FROM ann GROUP BY 1), m AS (SELECT sequence_name, median(duration_s) AS m FROM seg GROUP BY 1)
            SELECT sequence_name, {r("threshold", "threshold")}, {r("ar", "clean_alert_rate")}, {r("s / greatest(n / 50.0 / 60.0, 1e-6)", "clean_alerts_per_min")}, {r("coalesce(m, 0.0)", "clean_median_alert_duration_s")} FROM b JOIN l USING (sequence_name) LEFT JOIN m USING (sequence_name)""",
        "clean_burden": f"WITH {ANN} SELECT sequence_name, count(*) AS window_count, sum(positive::BIGINT)::BIGINT AS positive_count, sum(alert_active::BIGINT)::BIGINT AS alert_active_count, sum(alert_onset::BIGINT)::BIGINT AS alert_onset_count, {r('avg(positive::DOUBLE)', 'positive_rate')}, {r('avg(alert_active::DOUBLE)', 'alert_active_rate')}, 'global' AS threshold_mode FROM ann GROUP BY 1",
        "event_eval_lenient": f"WITH {ANN}, {EVENTS}, {LENIENT} SELECT sequence_name, event_order, anomaly_type, severity, target_group, {rr(['event_detected', 'time_to_detect_s'])}, top_group_prediction, {r('group_attribution_correct', 'group_attribution_correct')} FROM lenient",
        "event_eval_strict": f"WITH {ANN}, {EVENTS}, {STRICT} SELECT * REPLACE ({', '.join(r(c, c) for c in ['event_detected_strict', 'time_to_detect_s', 'group_attribution_correct', 'baseline_score', 'during_max_score', 'during_median_score', 'post_median_score', 'score_lift_abs', 'score_lift_ratio'])}) FROM strict",
        "timeline_events": f"""WITH {TIMELINE}, {EVENTS}, h AS (SELECT t.sequence_name, window_start_idx, arg_max(anomaly_type, event_order) AS a, arg_max(severity, event_order) AS s, arg_max(target_group, event_order) AS g FROM timeline t JOIN inj i ON i.sequence_name = t.sequence_name AND window_end_idx >= start_index AND window_start_idx <= end_index GROUP BY ALL)
            SELECT sequence_name, window_start_idx, a IS NOT NULL AS anomaly_active, coalesce(a, '') AS anomaly_type, coalesce(s, '') AS severity, coalesce(g, '') AS anomaly_group FROM timeline LEFT JOIN h USING (sequence_name, window_start_idx)""",
        "quiet_segments": f"WITH {QUIET} SELECT sequence_name, start_index, {rr(['region_max_score', 'baseline_score'])} FROM quiet",
        "quiet_segments_nms": nms(),
        "trial_summary": f"""WITH {ANN}, {EVENTS}, {STRICT} SELECT anomaly_type, severity, count(*) AS trial_count, sum(preexisting_alert::BIGINT)::BIGINT AS contaminated_trial_count, {r("avg(event_detected_strict)", "strict_detection_rate")}, {r("coalesce(median(time_to_detect_s) FILTER (WHERE event_detected_strict > 0), 'inf'::DOUBLE)", "median_time_to_detect_s")},
            {r("avg(group_attribution_correct)", "group_attribution_top1")}, {r("median(outside_event_alert_onset_count)", "median_outside_event_alert_onset_count")}, {r("median(outside_event_alert_active_count)", "median_outside_event_alert_active_count")}, {r("avg((outside_event_alert_onset_count > 0)::DOUBLE)", "trial_false_positive_onset_rate")},
            {r("avg((outside_event_alert_active_count > 0)::DOUBLE)", "trial_false_positive_active_rate")}, {r("median(score_lift_abs)", "median_score_lift_abs")}, {r("median(score_lift_ratio)", "median_score_lift_ratio")} FROM strict GROUP BY 1, 2""",
        "injected_summary": f"""WITH {ANN}, {EVENTS}, {LENIENT} SELECT anomaly_type, {r("coalesce(avg(event_detected), 0.0)", "event_detection_rate")}, {r("coalesce(median(time_to_detect_s) FILTER (WHERE event_detected > 0), 'inf'::DOUBLE)", "median_time_to_detect_s")},
            {r("coalesce(quantile_cont(time_to_detect_s, 0.9) FILTER (WHERE event_detected > 0), 'inf'::DOUBLE)", "p90_time_to_detect_s")}, {r("coalesce(avg(group_attribution_correct), 0.0)", "group_attribution_top1")}, 0.0::DOUBLE AS channel_top3_hit_rate FROM lenient GROUP BY 1""",
        "experiment_ids": "SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'lstm-raw-zscore-bs64-lr3e-04-seed' ELSE 'tcn-raw-zscore-bs64-lr1e-03-seed' END || (s_suppkey % 10) AS experiment_id FROM supplier",
        "normalizer_validation": "SELECT * FROM (VALUES ('fold_1', 'mode'), ('fold_2', 'columns')) t(fold_name, rule)",
        "feature_dataset_manifest": f"""{tel}, {GRID_CTE} SELECT sequence_name, 'tables/build=1/folder=' || sequence_name AS table_path, count(*) AS row_count, {GRID}::BIGINT AS step_ns, min(timestamp_ns) AS timestamp_start_ns, max(timestamp_ns) AS timestamp_end_ns FROM grid GROUP BY 1""",
        "normalized_by_fold": f"""{tel}, {FOLDS}, fit AS ({" UNION ALL ".join(f"SELECT fold_name, '{m}' AS mode, " + ", ".join(f"{c} AS c_{k}, CASE WHEN abs({s}) <= 1e-12 THEN 1.0 ELSE {s} END AS s_{k}" for k, c, s in ((k, *((f"avg({n})", f"stddev_pop({n})") if m == "zscore" else (f"quantile_cont({n}, 0.5)", f"(quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25))"))) for k, n in enumerate(RAW))) + " FROM folds JOIN tel ON sequence_name <> validation GROUP BY 1" for m in ("zscore", "robust"))})
            SELECT fold_name, 'raw' AS feature_set, mode, {KEYS}, {", ".join(r(f"({n} - c_{k}) / s_{k}", n) for k, n in enumerate(RAW))} FROM fit JOIN folds USING (fold_name) JOIN tel ON sequence_name = validation""",
        "artifact_matrix": "SELECT 'fold_3' AS fold_name, feature_set, 'robust' AS mode FROM (VALUES ('raw'), ('raw_plus_derived')) t(feature_set)",
        "leaderboard": f"""WITH x AS (SELECT l_suppkey AS experiment_id, {r("avg(1 - l_discount)", "event_detection_rate")}, {r("coalesce(median(l_quantity / 10) FILTER (WHERE l_linenumber < 4), 'inf'::DOUBLE)", "median_time_to_detect_s")}, {r("avg(l_tax)", "clean_alerts_per_min")}, {r("avg(l_quantity / 50)", "group_attribution_top1")} FROM lineitem GROUP BY 1)
            SELECT *, row_number() OVER (ORDER BY event_detection_rate DESC, median_time_to_detect_s, clean_alerts_per_min, group_attribution_top1 DESC, experiment_id) AS overall_rank FROM x""",
        "adaptive_baseline": f"WITH {ADAPT} SELECT sequence_name, window_end_idx, {rr(['score', 'trailing_median', 'trailing_mad'])} FROM ab",
        "adaptive_alerts": adaptive(2.0),
        "odom_normalize": ODOM,
        "phase_speed_metrics": PHASES,
        "speed_fit": f"WITH {DRIVE} SELECT phase, {r('regr_slope(y, x)', 'slope')}, {r('regr_intercept(y, x)', 'intercept')}, {r('regr_r2(y, x)', 'r2')}, {r('sum(x * y) / sum(x * x)', 'slope_through_origin')}, count(*) AS point_count FROM dr GROUP BY 1",
        "drive_summary": f"""WITH {DRIVE} SELECT run, count(*) AS row_count, {_moved("moving", _MOVING)}, {_moved("straight", "phase = '1'")}, {_moved("arc", "phase = '2'")}, {r(f"coalesce(avg(-vx) FILTER (WHERE {_MOVING}), 0.0)", "moving_visual_speed_mean_mps")},
            {r(f"coalesce(quantile_cont({_NORM}, 0.95) FILTER (WHERE {_MOVING}), 0.0)", "moving_norm_speed_p95_mps")}, {r(f"coalesce(avg({_NORM}) FILTER (WHERE phase = '5'), 0.0)", "final_stop_norm_mean_mps")} FROM dr GROUP BY 1""",
        "asof_clock": f"WITH {EV}, l AS (SELECT sequence_name, timestamp_ns, event_id FROM ev WHERE event_id % 3 <> 0), c AS (SELECT sequence_name, timestamp_ns, event_id AS clock_id, value AS clock_value FROM ev WHERE event_id % 3 = 0) SELECT l.sequence_name, l.timestamp_ns, event_id, clock_id, {r('clock_value', 'clock_value')} FROM l ASOF LEFT JOIN c ON l.sequence_name = c.sequence_name AND l.timestamp_ns >= c.timestamp_ns",
        "phase_labels": f"WITH {DRIVE} SELECT run, CASE WHEN t < 0 THEN NULL WHEN t < 1000 THEN 'start' WHEN t < 8000 THEN 'middle' ELSE 'end' END AS phase_name, count(*) AS row_count, {r('min(t)', 'first_t')} FROM dr GROUP BY 1, 2",
        "stream_tumbling": f"WITH {EV} SELECT sequence_name AS event_type, count(*) AS n, {r('sum(value)', 'total')}, timestamp_ns // 86400000000000 * 86400000000 AS window_start_us FROM ev GROUP BY ALL",
        "stream_sliding": f"WITH {EV}, x AS (SELECT sequence_name, value, timestamp_ns // 86400000000000 - k AS day FROM ev, (VALUES (0), (1)) t(k)) SELECT sequence_name AS event_type, count(*) AS n, {r('sum(value)', 'total')}, day * 86400000000 AS window_start_us FROM x GROUP BY sequence_name, day",
        "stream_sessions": f"""WITH {EV}, o AS (SELECT user_id, timestamp_ns // 1000 AS t, CASE WHEN timestamp_ns // 1000 - lag(timestamp_ns // 1000) OVER (PARTITION BY user_id ORDER BY timestamp_ns) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM ev),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t {UP_TO_HERE}) AS k FROM o) SELECT user_id, count(*) AS n, min(t) AS window_start_us FROM s GROUP BY user_id, k""",
        "stream_odom": ODOM,
        "stream_alerts": f"""WITH {TIMELINE}, a AS (SELECT sequence_name, window_end_idx, score, sum((score > 0.163)::INT) OVER ({IDX} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS alert_active FROM timeline)
            SELECT sequence_name, window_end_idx, {r("score", "score")}, alert_active, alert_active AND NOT lag(alert_active, 1, false) OVER ({IDX}) AS alert_onset FROM a""",
    }
    out["stream_adaptive"] = f"SELECT sequence_name, window_end_idx, alert_active, alert_onset FROM ({adaptive(2.0)})"
    from . import experiments_oracle, heldout_oracle, live_oracle  # which build on this module

    return out | {f"inject_{kind}": injection(kind) for kind in DURATION} | live_oracle.oracle_sql() | heldout_oracle.oracle_sql() | experiments_oracle.oracle_sql()


