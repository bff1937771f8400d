"""SQL for the queries of ``live``."""

from __future__ import annotations

from ..operators.drive import HOLD_MS, TICK_LOG, TICK_MS, VISUAL_MPS_PER_RAW
from . import live
from .oracle import DRIVE, TIMELINE, r, rr


def integrals(source: str, key: str, time: str) -> str:
    """CTEs ``seg`` and ``fold``: rows of ``source`` (desired, error, dt) with the integral since the last stop."""
    return f"""part AS (SELECT *, count(*) FILTER (WHERE abs(desired) < 0.001) OVER (PARTITION BY {key} ORDER BY {time} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM {source}),
    seg AS (SELECT *, row_number() OVER (PARTITION BY {key}, part ORDER BY {time}) AS nth FROM part),
    fold AS (SELECT {key}, part, nth, {time}, CASE WHEN abs(desired) < 0.001 THEN 0.0 ELSE greatest(-1.0, least(1.0, error * dt)) END AS integral FROM seg WHERE nth = 1
             UNION ALL SELECT s.{key}, s.part, s.nth, s.{time}, greatest(-1.0, least(1.0, f.integral + s.error * s.dt)) FROM fold f JOIN seg s ON s.{key} = f.{key} AND s.part = f.part AND s.nth = f.nth + 1),
    ctl AS (SELECT s.*, f.integral, desired / {VISUAL_MPS_PER_RAW!r}::DOUBLE AS forward, 0.6 * error + 0.15 * f.integral AS back, abs(desired) < 0.001 AS stopped FROM seg s JOIN fold f USING ({key}, {time}))"""


_RAW = {"raw_speed": "CASE WHEN stopped THEN 0.0 ELSE -greatest(-2.0, least(2.0, forward + back)) END", "raw_steer": "greatest(-0.6, least(0.6, steering))", "raw_acceleration": "-greatest(-3.0, least(3.0, accelerating))"}


def _shim() -> str:
    return f"""WITH RECURSIVE {DRIVE},
    a AS (SELECT run, t, coalesce(greatest(t - lag(t) OVER (PARTITION BY run ORDER BY t), 1e-6), 1e-6) AS dt, -vx AS actual, (t - 10 * floor(t / 10)) / 15 > 0.5 AS stale, cmd_speed, yaw, x FROM dr),
    b AS (SELECT *, CASE WHEN stale THEN 0.0 ELSE cmd_speed END AS desired, CASE WHEN stale THEN 0.0 ELSE yaw END AS steering, CASE WHEN stale THEN 0.0 ELSE x::DOUBLE END AS accelerating, CASE WHEN stale THEN 0.0 ELSE cmd_speed END - actual AS error FROM a),
    {integrals("b", "run", "t")}
    SELECT run, t, {", ".join(r(v, n) for n, v in _RAW.items())} FROM ctl"""


def _command_log() -> str:
    logged = {"desired_speed": "desired", "actual_visual_speed": "actual", "speed_error": "error", "desired_steer": "steering", "desired_acceleration": "accelerating", "feedforward_raw_speed": "CASE WHEN stopped THEN 0.0 ELSE forward END", "feedback_raw_speed": "CASE WHEN stopped THEN 0.0 ELSE back END", **_RAW}
    return f"""WITH RECURSIVE rec AS (SELECT o_orderstatus AS run, o_orderkey * 20 + 86400000 AS at_ms, o_orderkey % 4 = 0 AS command, CASE WHEN o_orderkey % 32 = 0 THEN 0.0 ELSE (o_custkey % 5 + 1) / 10.0::DOUBLE END AS speed,
        (o_orderkey % 63) / 10.0::DOUBLE - 3.1::DOUBLE AS steer, (o_custkey % 100) / 10.0::DOUBLE - 5.0 AS acceleration, (o_orderkey % 7 - 3) / 10.0::DOUBLE AS vx FROM orders),
    grid AS (SELECT run, unnest(range(a, b + {HOLD_MS} + 1, {TICK_MS})) AS tick_ms FROM (SELECT run, min(at_ms) AS a, max(at_ms) AS b FROM rec GROUP BY 1)),
    heard AS (SELECT g.* FROM grid g ASOF JOIN rec ON rec.run = g.run AND g.tick_ms >= rec.at_ms WHERE g.tick_ms - rec.at_ms <= {HOLD_MS}),
    a AS (SELECT h.run, tick_ms, c.at_ms AS cmd_ms, c.speed, c.steer, c.acceleration, -coalesce(o.vx, 0.0) AS actual FROM heard h
          ASOF LEFT JOIN (SELECT * FROM rec WHERE command) c ON c.run = h.run AND h.tick_ms >= c.at_ms ASOF LEFT JOIN (SELECT * FROM rec WHERE NOT command) o ON o.run = h.run AND h.tick_ms >= o.at_ms),
    z AS (SELECT *, (tick_ms - cmd_ms) / 1000 AS age, coalesce((tick_ms - cmd_ms) / 1000 > 0.5, true) AS stale, coalesce(greatest((tick_ms - lag(tick_ms) OVER (PARTITION BY run ORDER BY tick_ms)) / 1000, 1e-6), 1e-6) AS dt FROM a),
    b AS (SELECT *, CASE WHEN stale THEN 0.0 ELSE speed END AS desired, CASE WHEN stale THEN 0.0 ELSE steer END AS steering, CASE WHEN stale THEN 0.0 ELSE acceleration END AS accelerating, CASE WHEN stale THEN 0.0 ELSE speed END - actual AS error FROM z),
    {integrals("b", "run", "tick_ms")}
    SELECT run, tick_ms, {", ".join(r(logged[n], n) for n in TICK_LOG)}, {r("age", "command_age_s")} FROM ctl"""


def _phases() -> str:
    """Phases as rows, met by their start and end."""
    plan, begin = [], 0.0
    for name, seconds, command in live.DRIVE_PLAN:
        plan.append((name, begin, begin + seconds * live.STRETCH, command))
        begin += seconds * live.STRETCH
    first, last = plan[0], plan[-1]
    values = [(n, a, b, c) for n, a, b, c in plan] + [("done", begin, 1e300, last[3])]
    rows = ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c['speed']!r}::DOUBLE, {c['steer']!r}::DOUBLE, {c['lift']!r}::DOUBLE)" for n, a, b, c in values)
    return f"""WITH {DRIVE},
    g AS (SELECT run, t, t % 9 <> 0 AS ready, count(*) FILTER (WHERE t % 9 = 0) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM dr),
    s AS (SELECT *, min(t) OVER (PARTITION BY run, island) AS since FROM g WHERE ready),
    o AS (SELECT run, min(t) AS opened FROM s WHERE t - since >= {live.READY_S} GROUP BY 1),
    p(name, a, b, speed, steer, lift) AS (VALUES {rows})
    SELECT dr.run, t, {r("x", "x")}, {r("y", "y")}, coalesce(name, 'startup') AS phase_name, coalesce(speed, {first[3]['speed']}) + 0.0 AS cmd_speed, coalesce(steer, {first[3]['steer']}) + 0.0 AS cmd_steer, coalesce(lift, {first[3]['lift']}) + 0.0 AS cmd_lift, opened + a AS phase_start
    FROM dr LEFT JOIN o USING (run) LEFT JOIN p ON t - opened >= a AND t - opened < b"""


def _playhead() -> str:
    """Nearest by comparing with the neighbours on both sides."""
    speeds = ", ".join(f"({s})" for s in live.PLAYHEAD_SPEEDS)
    return f"""WITH {TIMELINE},
    span AS (SELECT sequence_name, min(time_s) AS a, max(time_s) AS b FROM timeline GROUP BY 1),
    tk AS (SELECT sequence_name, speed, unnest(range(0, ceil((b - a) / ({live.PLAYHEAD_S} * speed))::BIGINT + 1)) AS tick, a, b FROM span, (VALUES {speeds}) v(speed)),
    hd AS (SELECT sequence_name, speed, tick, least(b, a + {live.PLAYHEAD_S} * speed * tick) AS pos FROM tk),
    one AS (SELECT * FROM timeline QUALIFY row_number() OVER (PARTITION BY sequence_name, time_s ORDER BY window_end_idx) = 1),
    nb AS (SELECT h.*, p.time_s AS pt, q.time_s AS qt FROM hd h ASOF LEFT JOIN one p ON p.sequence_name = h.sequence_name AND h.pos >= p.time_s ASOF LEFT JOIN one q ON q.sequence_name = h.sequence_name AND h.pos <= q.time_s),
    c AS (SELECT *, CASE WHEN pt IS NULL OR abs(qt - pos) < abs(pt - pos) THEN qt ELSE pt END AS hit FROM nb)
    SELECT sequence_name, speed, tick, {r("pos", chr(34) + "at" + chr(34))}, {r("hit", "time_s")}, window_end_idx, {r("score", "score")}, top_group FROM c JOIN one USING (sequence_name) WHERE one.time_s = hit"""


def oracle_sql() -> dict[str, str]:
    shim, log = _shim(), _command_log()
    return {"pi_shim": shim, "stream_pi_shim": shim, "command_log": log, "stream_command_state": log, "phase_schedule": _phases(), "playhead_rows": _playhead()}
