"""Severity levels. A value on a boundary takes the milder level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (warn, danger) of each measure.
RETRY_PERCENT = (5, 15)
ROAM_GAP_MS = (50, 100)
RTT_MS = (30, 80)
LOSS_PERCENT = (1, 5)
RSSI_DBM = (-65, -75)
MCS = (6, 3)
SLOW_STATION_MS, SLOW_CAPTURE_MS = 150, 100


def above(x: Column, levels: tuple[float, float]) -> Column:
    """good, warn, danger of measures that are worse when higher."""
    return F.when(x.isNull(), "unknown").when(x > levels[1], "danger").when(x > levels[0], "warn").otherwise("good")


def below(x: Column, levels: tuple[float, float]) -> Column:
    """good, warn, danger of measures that are worse when lower."""
    return F.when(x.isNull(), "unknown").when(x < levels[1], "danger").when(x < levels[0], "warn").otherwise("good")
