"""Events against alerts, quiet places for injection, summaries and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contracts import GROUPS, RATE_HZ, SCORE_STRIDE, SEQUENCE, WINDOW
from ..sources.scratch import materialize
from . import blocks
from .score import INDEX, alert_segments

START = "window_start_idx"
#: Rows of a block, on which ranges of rows and windows meet.
BLOCK = 512
#: Rows at least of a piece of a table that is added up by itself.
PIECE_ROWS = 100_000
#: Results of folds that an experiment's mean is taken of.
AVERAGED = ["event_detection_rate", "clean_alerts_per_min", "group_attribution_top1"]


def overlapping(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Spans (rows ``a`` to ``b`` of a sequence) with the windows that overlap them, each pair once.

    They meet on blocks of rows, so work grows with the rows that spans cover and
    not with spans times windows of a sequence; a pair counts in the first block
    that both touch.
    """
    first = lambda c: F.floor(F.col(c) / BLOCK)
    spans = spans.withColumn("block", F.explode(F.sequence(first("a"), first("b"))))
    windows = windows.withColumn("block", F.explode(F.sequence(first(START), first(INDEX))))
    near = spans.join(windows, [SEQUENCE, "block"]).where((F.col(INDEX) >= F.col("a")) & (F.col(START) <= F.col("b")))
    return near.where(F.col("block") == F.greatest(first("a"), first(START))).drop("block")


def clean_summary(annotated: DataFrame, rows: DataFrame, stride: int = SCORE_STRIDE) -> DataFrame:
    """Alert rate, alerts a minute and median alert length of each sequence."""
    base = annotated.groupBy(SEQUENCE).agg(F.first("threshold").alias("threshold"), F.avg(F.col("alert_active").cast("double")).alias("clean_alert_rate"), F.sum(F.col("alert_onset").cast("long")).alias("segments"))
    length = rows.groupBy(SEQUENCE).agg(F.count(F.lit(1)).alias("n"))
    lasted = alert_segments(annotated, stride).groupBy(SEQUENCE).agg(F.percentile("duration_s", 0.5).alias("m"))
    minutes = F.greatest(F.col("n") / RATE_HZ / 60.0, F.lit(1e-6))
    return base.join(length, SEQUENCE).join(lasted, SEQUENCE, "left").select(SEQUENCE, "threshold", "clean_alert_rate", (F.col("segments") / minutes).alias("clean_alerts_per_min"), F.coalesce("m", F.lit(0.0)).alias("clean_median_alert_duration_s"))


def clean_burden(annotated: DataFrame, mode: str) -> DataFrame:
    """Counts and rates of positive and alerting windows."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return annotated.groupBy(SEQUENCE).agg(
        F.count(F.lit(1)).alias("window_count"),
        count("positive").alias("positive_count"),
        count("alert_active").alias("alert_active_count"),
        count("alert_onset").alias("alert_onset_count"),
        rate("positive").alias("positive_rate"),
        rate("alert_active").alias("alert_active_rate"),
        F.lit(mode).alias("threshold_mode"),
    )


def next_alerts(annotated: DataFrame, events: DataFrame) -> DataFrame:
    """(sequence, event_order, i, g): the first alerting window that ends at or after each event's start.

    Both are sorted together once: going backwards, the last alert met is the next one in time.
    """
    alerts = annotated.where("alert_active").select(SEQUENCE, F.col(INDEX).cast("long").alias("at"), F.lit(None).cast("string").alias("event_order"), F.struct(F.col(INDEX).alias("i"), F.col("top_group").alias("g")).alias("hit"))
    asked = events.select(SEQUENCE, F.col("start_index").cast("long").alias("at"), F.col("event_order").cast("string").alias("event_order"), F.lit(None).cast(alerts.schema["hit"].dataType).alias("hit"))
    backwards = Window.partitionBy(SEQUENCE).orderBy(F.desc("at"), F.col("event_order").isNotNull())
    met = alerts.unionByName(asked).withColumn("next", F.last("hit", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
    return met.where("event_order is not null").select(SEQUENCE, F.col("event_order").cast(events.schema["event_order"].dataType).alias("event_order"), F.col("next.i").alias("i"), F.col("next.g").alias("g"))


def judge_leniently(events: DataFrame, first: DataFrame, grace: int) -> DataFrame:
    """Events by their first alerts (sequence, event_order, i, g)."""
    df = events.join(first, [SEQUENCE, "event_order"], "left")
    known = F.col("target_group").isin(list(GROUPS)) & F.col("g").isNotNull()
    return df.select(
        SEQUENCE,
        "event_order",
        "anomaly_type",
        "severity",
        "target_group",
        F.coalesce((F.col("i") <= F.col("end_index") + grace).cast("double"), F.lit(0.0)).alias("event_detected"),
        F.coalesce(F.greatest(F.lit(0.0), (F.col("i") - F.col("start_index")) / RATE_HZ), F.lit(float("inf"))).alias("time_to_detect_s"),
        F.coalesce("g", F.lit("")).alias("top_group_prediction"),
        F.when(known, (F.col("g") == F.col("target_group")).cast("double")).alias("group_attribution_correct"),
    )


def event_eval_lenient(annotated: DataFrame, events: DataFrame, grace_s: float = 1.0) -> DataFrame:
    """First alerting window at or after an event's start; an alert that goes on counts."""
    return judge_leniently(events, next_alerts(annotated, events), int(grace_s * RATE_HZ))


def event_eval_strict(annotated: DataFrame, events: DataFrame, grace_s: float = 1.0, quiet_s: float = 1.0) -> DataFrame:
    """A new onset inside the event, none going on in the second before; scores around it.

    Windows near an event meet it on blocks of rows; what lies outside of it is
    the sequence's total less what lies inside.
    """
    grace, quiet = int(grace_s * RATE_HZ), int(quiet_s * RATE_HZ)
    keys = [SEQUENCE, "event_order", "anomaly_type", "severity", "target_group", "start_index", "end_index"]
    start, end, i, s = F.col("start_index"), F.col("end_index"), F.col(INDEX), F.col(START)
    pre = (i >= F.greatest(F.lit(0), start - quiet)) & (i < start)
    inside = (i >= start) & (i <= end + grace)
    during = (i >= start) & (s <= end)
    post = (s > end) & (s <= end + quiet)
    within = (i >= start) & (s <= end + grace)
    onset, active = F.col("alert_onset"), F.col("alert_active")
    totals = annotated.groupBy(SEQUENCE).agg(F.count_if(onset).alias("onsets"), F.count_if(active).alias("actives"))
    spans = events.select(*keys, F.greatest(F.lit(0), start - quiet).alias("a"), (end + max(grace, quiet)).alias("b"))
    near = overlapping(spans, annotated.select(SEQUENCE, START, INDEX, "score", "alert_active", "alert_onset", "top_group"))
    near = near.groupBy(*keys).agg(
        F.count_if(pre & onset).alias("pre_event_alert_onset_count"),
        F.count_if(pre & active).alias("pre_event_alert_active_count"),
        F.count_if(within & onset).alias("onsets_within"),
        F.count_if(within & active).alias("actives_within"),
        F.min(F.when(inside & onset, F.struct(i.alias("i"), F.col("top_group").alias("g")))).alias("first"),
        F.percentile(F.when(pre, F.col("score")), 0.5).alias("baseline_score"),
        F.max(F.when(during, F.col("score"))).alias("during_max_score"),
        F.percentile(F.when(during, F.col("score")), 0.5).alias("during_median_score"),
        F.percentile(F.when(post, F.col("score")), 0.5).alias("post_median_score"),
    )
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    df = events.select(*keys).join(near, keys, "left").join(totals, SEQUENCE, "left")
    df = df.withColumns({
        **{c: count(c) for c in ("pre_event_alert_onset_count", "pre_event_alert_active_count")},
        "outside_event_alert_onset_count": count("onsets") - count("onsets_within"),
        "outside_event_alert_active_count": count("actives") - count("actives_within"),
    })
    before = F.col("pre_event_alert_active_count") > 0
    detected = F.col("first").isNotNull() & ~before
    delay = F.greatest(F.lit(0.0), (F.col("first.i") - start) / RATE_HZ)
    return df.select(
        *keys,
        before.alias("preexisting_alert"),
        "pre_event_alert_onset_count",
        "pre_event_alert_active_count",
        "outside_event_alert_onset_count",
        "outside_event_alert_active_count",
        detected.cast("double").alias("event_detected_strict"),
        F.when(detected, delay).otherwise(float("inf")).alias("time_to_detect_s"),
        F.coalesce("first.g", F.lit("")).alias("alert_trigger_group"),
        F.when(detected & F.col("target_group").isin(list(GROUPS)), (F.col("first.g") == F.col("target_group")).cast("double")).alias("group_attribution_correct"),
        "baseline_score",
        "during_max_score",
        "during_median_score",
        "post_median_score",
        (F.col("during_max_score") - F.col("baseline_score")).alias("score_lift_abs"),
        F.when(F.abs("baseline_score") > 1e-12, F.col("during_max_score") / F.col("baseline_score")).alias("score_lift_ratio"),
    )


def timeline_events(timeline: DataFrame, events: DataFrame) -> DataFrame:
    """Mark windows that overlap an event; of several the last one counts."""
    spans = events.select(SEQUENCE, "event_order", "anomaly_type", "severity", F.col("target_group").alias("anomaly_group"), F.col("start_index").alias("a"), F.col("end_index").alias("b"))
    hits = overlapping(spans, timeline.select(SEQUENCE, START, INDEX))
    last = hits.groupBy(SEQUENCE, START).agg(F.max_by(F.struct("anomaly_type", "severity", "anomaly_group"), "event_order").alias("e"))
    df = timeline.join(last, [SEQUENCE, START], "left")
    return df.select(*timeline.columns, F.col("e").isNotNull().alias("anomaly_active"), *(F.coalesce(f"e.{c}", F.lit("")).alias(c) for c in ("anomaly_type", "severity", "anomaly_group")))


def _median(scores: Column) -> Column:
    """Median of an array; null for an empty one."""
    ordered = F.sort_array(scores)
    return (F.get(ordered, F.floor((F.size(scores) - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.size(scores) / 2).cast("int"))) / 2


def quiet_surroundings(annotated: DataFrame, lengths: DataFrame, durations: list[int], stride: int, pre: int = 150, post: int = 150, size: int = WINDOW) -> DataFrame:
    """(sequence, start_index, d<duration>...): for each duration null or what is known of a start without alerts around it.

    A start's surroundings are a range of window starts: windows of ``size`` rows that overlap
    [start - pre, start + duration + post].  Starts and windows are sorted together once, in parts of a
    sequence, and each start looks at its frame: nothing is joined, and all durations take the same pass.
    """
    last = F.greatest(F.lit(pre), F.col("n") - min(durations) - post - 1)
    starts = lengths.select(SEQUENCE, "n", F.explode(F.sequence(F.lit(pre).cast("long"), last.cast("long"), F.lit(stride).cast("long"))).alias("at"))
    both = annotated.select(SEQUENCE, F.col(START).cast("long").alias("at"), "score", "alert_active").unionByName(starts, allowMissingColumns=True)
    before = pre + size - 1
    w = Window.partitionBy(SEQUENCE, blocks.PART).orderBy("at")
    seen = {"past": F.collect_list("score").over(w.rangeBetween(-before, -size))}
    for d in durations:
        around = w.rangeBetween(-before, d + post)
        seen |= {f"alert{d}": F.bool_or("alert_active").over(around), f"max{d}": F.max("score").over(around), f"all{d}": F.collect_list("score").over(around)}
    met = blocks.own(blocks.with_halo(both, "at", before, max(durations) + post).withColumns(seen)).where("n is not null")

    def found(d: int) -> Column:
        usable = (F.col("at") <= F.greatest(F.lit(pre), F.col("n") - d - post - 1)) & ~F.col(f"alert{d}")
        return F.when(usable, F.struct(F.col(f"max{d}").alias("region_max_score"), F.coalesce(_median(F.col("past")), _median(F.col(f"all{d}"))).alias("baseline_score"))).alias(f"d{d}")

    return met.select(SEQUENCE, F.col("at").alias("start_index"), *map(found, durations))


def quiet_segments(annotated: DataFrame, lengths: DataFrame, duration: int, stride: int, pre: int = 150, post: int = 150) -> DataFrame:
    """Starts whose surroundings hold no alert, with peak and baseline score."""
    found = quiet_surroundings(annotated, lengths, [duration], stride, pre, post)
    return found.where(F.col(f"d{duration}").isNotNull()).select(SEQUENCE, "start_index", f"d{duration}.*")


def spaced_out(candidates: DataFrame, count: int, gap: int = 500, keys: list[str] | None = None) -> DataFrame:
    """The best candidates of each key that keep their distance, in order of choice.

    Greedy choice is sequential; ``count`` rounds each take the best candidate
    that is left for every key and drop those near it.  The choice of a round, a row a key, is written,
    so that no round works out those before again; ``candidates`` are read in each and should be stored.
    """
    keys = keys or [SEQUENCE]
    left, chosen = candidates, None
    for n in range(count):
        best = left.groupBy(*keys).agg(F.min(F.struct("region_max_score", "baseline_score", "start_index")).alias("b"))
        picked = best.select(*keys, F.lit(n + 1).alias("choice"), F.col("b.start_index").alias("start_index"), F.col("b.region_max_score").alias("region_max_score"), F.col("b.baseline_score").alias("baseline_score"))
        picked = materialize(picked, "picked")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        near = picked.select(*keys, F.col("start_index").alias("taken"))
        left = left.join(near, keys, "left").where(F.coalesce(F.abs(F.col("start_index") - F.col("taken")) >= gap, F.lit(True))).drop("taken")
    return chosen


def _finite_delay(detected: str):
    return F.when((F.col(detected) > 0) & (F.col("time_to_detect_s") < float("inf")), F.col("time_to_detect_s"))


def injected_summary(breakdown: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Detection rate, median and 90th percentile of delays, attribution."""
    delay = _finite_delay("event_detected")
    return breakdown.groupBy(*(by or [])).agg(
        F.coalesce(F.avg("event_detected"), F.lit(0.0)).alias("event_detection_rate"),
        F.coalesce(F.percentile(delay, 0.5), F.lit(float("inf"))).alias("median_time_to_detect_s"),
        F.coalesce(F.percentile(delay, 0.9), F.lit(float("inf"))).alias("p90_time_to_detect_s"),
        F.coalesce(F.avg("group_attribution_correct"), F.lit(0.0)).alias("group_attribution_top1"),
        F.lit(0.0).alias("channel_top3_hit_rate"),
    )


def trial_summary(trials: DataFrame) -> DataFrame:
    """Strict trials by type and severity."""
    half = lambda c: F.percentile(c, 0.5)
    return trials.groupBy("anomaly_type", "severity").agg(
        F.count(F.lit(1)).alias("trial_count"),
        F.sum(F.col("preexisting_alert").cast("long")).alias("contaminated_trial_count"),
        F.avg("event_detected_strict").alias("strict_detection_rate"),
        F.coalesce(half(_finite_delay("event_detected_strict")), F.lit(float("inf"))).alias("median_time_to_detect_s"),
        F.avg("group_attribution_correct").alias("group_attribution_top1"),
        half("outside_event_alert_onset_count").alias("median_outside_event_alert_onset_count"),
        half("outside_event_alert_active_count").alias("median_outside_event_alert_active_count"),
        F.avg((F.col("outside_event_alert_onset_count") > 0).cast("double")).alias("trial_false_positive_onset_rate"),
        F.avg((F.col("outside_event_alert_active_count") > 0).cast("double")).alias("trial_false_positive_active_rate"),
        half("score_lift_abs").alias("median_score_lift_abs"),
        half("score_lift_ratio").alias("median_score_lift_ratio"),
    )


def experiment_means(folds: DataFrame, stored: list[str] | None = None, digits: int = 6, pieces: list[str] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Fold results averaged by experiment; the delay is the median of finite ones.

    Sums of doubles depend on the order of adding, which may decide to what an
    average is rounded.  With ``stored``, the columns that tell the order of rows,
    experiments with an average so near to a tie at ``digits`` are added up in
    that order, one row after the other: the table decides, not how it is split.
    With ``pieces``, the columns that tell in which pieces rows are stored, rows are added up
    within each piece and pieces then; those that begin within the same ``piece_rows`` rows of the table are one.
    """
    finite = F.when(F.col("median_time_to_detect_s") < float("inf"), F.col("median_time_to_detect_s"))
    delay = F.coalesce(F.percentile(finite, 0.5), F.lit(float("inf"))).alias("median_time_to_detect_s")
    rate, alerts, top = (F.avg(c).alias(c) for c in AVERAGED)
    means = folds.groupBy("experiment_id")
    if stored is None:
        return means.agg(rate, delay, alerts, top)
    sizes = [m for c in AVERAGED for m in (F.avg(F.abs(c)).alias(f"size_{c}"), F.count(c).alias(f"n_{c}"))]
    means = materialize(means.agg(rate, delay, alerts, top, *sizes), "experiment-means")
    unsure = reduce(Column.__or__, (_order_decides(c, digits) for c in AVERAGED))
    chosen = means.where(unsure).select(F.col("experiment_id").alias("chosen"))
    rows = folds.join(chosen, F.col("experiment_id").eqNullSafe(F.col("chosen")), "left_semi")
    if pieces:
        # A row a piece: few.
        ahead = F.coalesce(F.sum("_n").over(Window.orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbers = folds.groupBy(*pieces).agg(F.count(F.lit(1)).alias("_n")).select(*pieces, F.floor(ahead / piece_rows).alias("_piece"))
        rows, stored = _added_up(rows.join(F.broadcast(numbers), pieces), ["experiment_id", "_piece"], stored), ["_piece"]
    again = _added_up(rows, ["experiment_id"], stored).select(F.col("experiment_id").alias("chosen"), *(F.col(c).alias(f"sum_{c}") for c in AVERAGED))
    both = means.join(materialize(again, "experiments-on-ties"), F.col("experiment_id").eqNullSafe(F.col("chosen")), "left")
    return both.select("experiment_id", *(F.coalesce(F.try_divide(f"sum_{c}", f"n_{c}"), F.col(c)).alias(c) if c in AVERAGED else F.col(c) for c in means.columns[1:5]))


def _added_up(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Sums of what is averaged by ``keys``, one row after the other."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*keys, *order, *(F.sum(c).over(so_far).alias(c) for c in AVERAGED))
    return sums.groupBy(*keys).agg(*(F.max_by(c, F.struct(*order)).alias(c) for c in AVERAGED))


def _order_decides(c: str, digits: int) -> Column:
    """Whether sums in two orders, at most 2n units of the last place of all sizes apart, may be rounded to two averages."""
    apart = (2 * F.col(f"n_{c}") + 8) * F.col(f"size_{c}") * 2.0**-53
    to_tie = F.abs(F.pmod(F.col(c) * 10.0**digits, F.lit(1.0)) - 0.5)
    return F.coalesce(~F.isnan(to_tie) & (to_tie <= apart * 10.0**digits), F.lit(False))


def leaderboard(experiments: DataFrame) -> DataFrame:
    """Rank by detection, delay, alerts a minute, attribution; experiments are few."""
    last = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(float("inf")))
    w = Window.orderBy(F.desc(last("event_detection_rate")), last("median_time_to_detect_s"), last("clean_alerts_per_min"), F.desc(last("group_attribution_top1")), "experiment_id")
    return experiments.withColumn("overall_rank", F.row_number().over(w))
