"""Adaptive alerts: a baseline that freezes while an alert lasts.

The state (last alert, frozen baseline and scale, run of positives) feeds back
into what follows, so it is carried through each sequence's rows in time; the
medians are worked out before, by window functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.contracts import ADAPTIVE_Z, LEAST_SCALE, SCALE_RATIO, SEQUENCE
from .score import INDEX, adaptive_baseline

ADDED = "baseline double, scale double, normalized_score double, positive boolean, alert_active boolean, alert_onset boolean"
NAMES = [part.split()[0] for part in ADDED.split(", ")]


class AlertState:
    """Takes one row after the other."""

    def __init__(self, k: int, z: float = ADAPTIVE_Z, ratio: float = SCALE_RATIO, least: float = LEAST_SCALE):
        self.k, self.z, self.ratio, self.least = k, z, ratio, least
        self.active, self.baseline, self.scale, self.run = False, 0.0, 1.0, 0

    def step(self, score: float, median: float, mad: float) -> tuple[float, float, float, bool, bool, bool]:
        was = self.active
        if not was:
            self.baseline = median
            self.scale = max(1.4826 * mad, self.least, self.ratio * max(abs(median), self.least))
        normal = (score - self.baseline) / self.scale
        positive = bool(normal > self.z and score > self.baseline)
        self.run = self.run + 1 if positive else 0
        self.active = self.run >= self.k
        return self.baseline, self.scale, normal, positive, self.active, self.active and not was


def adaptive_alerts(timeline: DataFrame, k: int = 2, **settings) -> DataFrame:
    """Annotate a score timeline; each sequence is one fold over its windows, which pass through a task in batches."""
    prepared = adaptive_baseline(timeline)

    def run(frames):
        name, state = None, None
        for pdf in frames:
            rows = []
            for sequence, *reading in zip(pdf[SEQUENCE], pdf["score"], pdf["trailing_median"], pdf["trailing_mad"], strict=True):
                if state is None or sequence != name:
                    name, state = sequence, AlertState(k, **settings)
                rows.append(state.step(*reading))
            yield pd.concat([pdf, pd.DataFrame(rows, columns=NAMES, index=pdf.index)], axis=1)

    schema = ", ".join([f"`{n}` {t}" for n, t in prepared.dtypes]) + ", " + ADDED
    return prepared.repartition(SEQUENCE).sortWithinPartitions(SEQUENCE, INDEX).mapInPandas(run, schema)
