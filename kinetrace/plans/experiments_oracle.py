"""SQL for the queries of ``experiments``.

The projector to the components above a variance is (1 + sign(C - variance)) / 2, and
the sign of a matrix comes from multiplications alone: X becomes (3 X - X^3) / 2 again and again.
"""

from __future__ import annotations

import random

from ..functions.contracts import ACCEL, GYRO, RAW
from ..operators.inject import DURATION, TARGET, noise_table, warp_table
from . import experiments
from .heldout_oracle import injection_cells
from .oracle import FOLDS, IDX, TEL, r, rr, scale_of, timeline_of

N, ROUNDS = len(RAW), 90


def times(a: str, b: str) -> str:
    return f"list_transform(range({N * N}), lambda i: list_sum(list_transform(range({N}), lambda j: {a}[(i // {N}) * {N} + j + 1] * {b}[j * {N} + i % {N} + 1])))"


def projectors(rows: str, key: str, least: float) -> str:
    """CTEs up to ``model`` (key, mean, scale, p): from ``rows`` with a key; needs WITH RECURSIVE."""
    mean, scale = (", ".join(f"{f}({c})" for c in RAW) for f in ("avg", "stddev_pop"))
    cells = ", ".join(f"covar_pop({a}, {b})" for a in RAW for b in RAW)
    one = f"CASE WHEN i // {N} = i % {N} THEN 1.0 ELSE 0.0 END"
    return f"""mo AS (SELECT {key}, [{mean}] AS mean, list_transform([{scale}], lambda s: CASE WHEN s <= 1e-12 THEN 1.0 ELSE s END) AS scale, [{cells}] AS cv FROM {rows} GROUP BY {key}),
    co AS (SELECT {key}, mean, scale, list_transform(range({N * N}), lambda i: cv[i + 1] / scale[i // {N} + 1] / scale[i % {N} + 1] - {least} * {one}) AS x, list_transform(range({N * N}), lambda i: cv[i + 1] / scale[i // {N} + 1] / scale[i % {N} + 1]) AS c FROM mo),
    sg AS (SELECT {key}, 0 AS it, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) AS x FROM co
           UNION ALL SELECT {key}, it + 1, list_transform(range({N * N}), lambda i: 1.5 * x[i + 1] - 0.5 * x3[i + 1]) FROM (SELECT {key}, it, x, {times("x2", "x")} AS x3 FROM (SELECT {key}, it, x, {times("x", "x")} AS x2 FROM sg WHERE it < {ROUNDS}))),
    model AS (SELECT {key}, mean, scale, c, list_transform(range({N * N}), lambda i: (sg.x[i + 1] + {one}) / 2) AS p FROM sg JOIN co USING ({key}) WHERE it = {ROUNDS})"""


def residuals(source: str, join: str, name: str) -> str:
    """CTEs up to ``<name>res``: what the timeline is made of, from rows joined with ``model``."""
    z = ", ".join(f"({c} - mean[{k + 1}]) / scale[{k + 1}] AS z{k}" for k, c in enumerate(RAW))
    back = lambda k: " + ".join(f"p[{k * N + j + 1}] * z{j}" for j in range(N))
    return f"""{name}z AS (SELECT t.sequence_name, timestamp_ns, timestep_index, p, {z} FROM {source} t JOIN model ON {join}),
    {name}res AS (SELECT sequence_name, timestamp_ns, timestep_index, {", ".join(f"(z{k} - ({back(k)})) * (z{k} - ({back(k)})) AS r_{c}" for k, c in enumerate(RAW))} FROM {name}z)"""


def scored(source: str, join: str, name: str = "") -> str:
    """CTEs up to ``<name>timeline`` by the models' residuals."""
    whole = timeline_of("none", name)
    return f"{residuals(source, join, name)},\n{whole[whole.index(f'{name}err AS'):]}"


FOLD_ROWS = "ftel AS (SELECT fold_name, validation, tel.* FROM folds JOIN tel ON tel.sequence_name <> validation)"


def fold_models(least: float) -> str:
    return f"""{TEL}, {FOLDS}, {FOLD_ROWS}, {projectors("ftel", "validation", least)}"""


def faults() -> str:
    """CTEs up to ``inj``: whole sequences, each fault once, under the names of its trial."""
    listed = ", ".join(f"({i}, '{k}', {d}, '{TARGET[k]}')" for i, (k, d) in enumerate(DURATION.items(), 1))
    place = {k: i for i, k in enumerate(DURATION, 1)}
    warps = ", ".join(f"({i}, {low}, {part!r}::DOUBLE)" for i, low, part in warp_table(experiments.SEVERITY, experiments.SEED + place["timestamp_jitter"], DURATION["timestamp_jitter"]))
    noise = ", ".join("(" + ", ".join([str(i), *(f"{float(x)!r}::DOUBLE" for x in row)]) + ")" for i, row in enumerate(noise_table(experiments.SEED + place["noise_burst"], DURATION["noise_burst"])))
    return f"""len AS (SELECT sequence_name, count(*) AS n FROM tel GROUP BY 1 HAVING count(*) >= 150),
    kd(placement_index, kind, d, grp) AS (VALUES {listed}),
    ev0 AS (SELECT sequence_name AS seq, sequence_name || '#' || kind AS sequence_name, kind, grp, greatest(0, least(n - d - 1, 160)) AS start_index, n, d FROM len, kd),
    tr AS (SELECT *, least(n - 1, start_index + d - 1) AS end_index FROM ev0),
    {scale_of(GYRO, "gyro")}, {scale_of(ACCEL, "accel")}, {scale_of(ACCEL + GYRO, "mixed")},
    wp(wk, low, part) AS (VALUES {warps}), ns(nk, {", ".join(f"n_{c}" for c in ACCEL + GYRO)}) AS (VALUES {noise}),
    rw AS (SELECT tr.sequence_name AS trial, seq, kind, '{experiments.SEVERITY}' AS severity, start_index, timestep_index AS step, timestep_index - start_index AS k, end_index - start_index + 1 AS m, timestep_index BETWEEN start_index AND end_index AS inside FROM tr JOIN tel ON tel.sequence_name = seq),
    ws AS (SELECT rw.*, low, part FROM rw LEFT JOIN wp ON wk = k),
    {injection_cells("ws", "LEFT JOIN ns ON nk = k")}"""


def evaluation(least: float) -> str:
    """CTEs up to ``lenient`` and ``cs``: faults judged and clean alerts summed up, per validation sequence."""
    return f"""{fold_models(least)}, {scored("tel", "validation = t.sequence_name")},
    th AS (SELECT sequence_name, quantile_cont(score, 0.99) AS threshold FROM timeline GROUP BY 1),
    cl0 AS (SELECT *, sum((score > threshold)::INT) OVER ({IDX} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS alert_active FROM timeline JOIN th USING (sequence_name)),
    cl AS (SELECT *, coalesce(alert_active, false) AS active, coalesce(alert_active, false) AND NOT lag(coalesce(alert_active, false), 1, false) OVER ({IDX}) AS onset FROM cl0),
    sgm AS (SELECT sequence_name, count(*) * 5 / 50.0::DOUBLE AS dur FROM (SELECT sequence_name, active, sum(onset::INT) OVER ({IDX} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM cl) WHERE active GROUP BY sequence_name, id),
    rows_ AS (SELECT sequence_name, count(*) AS n FROM tel GROUP BY 1),
    cs AS (SELECT sequence_name, any_value(threshold) AS threshold, avg(active::INT) AS clean_alert_rate, sum(onset::INT) / greatest(any_value(n) / 50.0::DOUBLE / 60.0, 1e-6) AS clean_alerts_per_min FROM cl JOIN rows_ USING (sequence_name) GROUP BY 1),
    {faults()}, {scored("inj", "validation = split_part(t.sequence_name, '#', 1)", "t_")},
    ta AS (SELECT t.*, sum((score > threshold)::INT) OVER (PARTITION BY t.sequence_name ORDER BY window_end_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS alert_active FROM t_timeline t JOIN th ON th.sequence_name = split_part(t.sequence_name, '#', 1)),
    fh AS (SELECT tr.sequence_name, min(window_end_idx) AS i, arg_min(top_group, window_end_idx) AS g FROM tr JOIN ta ON ta.sequence_name = tr.sequence_name AND alert_active AND window_end_idx >= start_index GROUP BY 1),
    lenient AS (SELECT seq AS validation, kind AS anomaly_type, '{experiments.SEVERITY}' AS severity, grp AS target_group, coalesce((i <= end_index + 50)::DOUBLE, 0.0) AS event_detected, coalesce(greatest(0.0, (i - start_index) / 50.0), 'inf'::DOUBLE) AS time_to_detect_s,
        coalesce(g, '') AS top_group_prediction, CASE WHEN g IS NOT NULL AND grp IN ('quaternion', 'gyro', 'accel') THEN (g = grp)::DOUBLE END AS group_attribution_correct FROM tr LEFT JOIN fh USING (sequence_name)),
    su AS (SELECT validation, avg(event_detected) AS event_detection_rate, coalesce(quantile_cont(delay, 0.5), 'inf'::DOUBLE) AS median_time_to_detect_s, coalesce(quantile_cont(delay, 0.9), 'inf'::DOUBLE) AS p90_time_to_detect_s, coalesce(avg(group_attribution_correct), 0.0) AS group_attribution_top1
           FROM (SELECT *, CASE WHEN event_detected > 0 THEN time_to_detect_s END AS delay FROM lenient) GROUP BY 1),
    result AS (SELECT fold_name, folds.validation, threshold, clean_alert_rate, clean_alerts_per_min, coalesce((SELECT median(dur) FROM sgm WHERE sgm.sequence_name = folds.validation), 0.0) AS clean_median_alert_duration_s,
        event_detection_rate, median_time_to_detect_s, p90_time_to_detect_s, group_attribution_top1, 0.0::DOUBLE AS channel_top3_hit_rate FROM folds JOIN cs ON cs.sequence_name = folds.validation JOIN su ON su.validation = folds.validation)"""


RESULT = ["threshold", "clean_alert_rate", "clean_alerts_per_min", "clean_median_alert_duration_s", "event_detection_rate", "median_time_to_detect_s", "p90_time_to_detect_s", "group_attribution_top1", "channel_top3_hit_rate"]


def _search() -> str:
    """Each setting in a subquery of its own; ranked by the rounded means of its folds."""
    parts = []
    for least in experiments.SEARCHED:
        parts.append(f"""SELECT 'pca-raw-zscore-{least}' AS experiment_id, {r("avg(event_detection_rate)", "event_detection_rate")}, {r("coalesce(quantile_cont(CASE WHEN median_time_to_detect_s < 'inf'::DOUBLE THEN median_time_to_detect_s END, 0.5), 'inf'::DOUBLE)", "median_time_to_detect_s")},
            {r("avg(clean_alerts_per_min)", "clean_alerts_per_min")}, {r("avg(group_attribution_top1)", "group_attribution_top1")} FROM (WITH RECURSIVE {evaluation(least)} SELECT * FROM result)""")
    union = " UNION ALL ".join(parts)
    return f"SELECT *, row_number() OVER (ORDER BY event_detection_rate DESC, median_time_to_detect_s, clean_alerts_per_min, group_attribution_top1 DESC, experiment_id) AS overall_rank FROM ({union})"


def _trials() -> str:
    """The drawn settings as values."""
    settings = [{}]
    for name, values in experiments.GRID.items():
        settings = [s | {name: v} for s in settings for v in values]
    rng = random.Random(7)
    rng.shuffle(settings)
    settings = settings[:16] + [rng.choice(settings) for _ in range(max(0, 16 - len(settings)))]
    rows = ", ".join("(" + ", ".join([str(k), *(f"'{v}'" for v in s.values())]) + ")" for k, s in enumerate(settings, 1))
    return f"WITH {FOLDS} SELECT fold_name, validation, t.* FROM folds, (VALUES {rows}) t(trial, {', '.join(experiments.GRID)}) WHERE fold_name IN ('fold_2', 'fold_4')"


def oracle_sql() -> dict[str, str]:
    whole = f"""{TEL}, every AS (SELECT 1 AS one, * FROM tel), {projectors("every", "one", 1.0)}, {scored("tel", "one = 1")}"""
    kept = f"list_sum(list_transform(range({N}), lambda i: p[i * {N + 1} + 1]))"
    share = f"list_sum(list_transform(range({N * N}), lambda i: p[i + 1] * c[i + 1])) / list_sum(list_transform(range({N}), lambda i: c[i * {N + 1} + 1]))"
    return {
        "pca_reconstruct": f"WITH RECURSIVE {whole} SELECT sequence_name, window_start_idx, {r('score', 'score')}, top_group FROM timeline",
        "fold_training": f"WITH RECURSIVE {fold_models(1.0)} SELECT fold_name, validation, round({kept})::INT AS kept, {r(share, 'explained')} FROM model JOIN folds USING (validation)",
        "experiment_breakdown": f"WITH RECURSIVE {evaluation(1.0)} SELECT validation, anomaly_type, severity, target_group, event_detected, {r('time_to_detect_s', 'time_to_detect_s')}, top_group_prediction, group_attribution_correct FROM lenient",
        "experiment_evaluation": f"WITH RECURSIVE {evaluation(1.0)} SELECT fold_name, validation, {rr(RESULT)} FROM result",
        "model_search": _search(),
        "search_trials": _trials(),
    }
