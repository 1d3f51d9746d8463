"""Channels and bands of centre frequencies, in MHz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(mhz: Column) -> Column:
    """Channel number; null outside the three bands."""
    step = lambda base: F.floor((mhz - base) / 5).cast("int")
    return (
        F.when(mhz.between(2412, 2472), step(2407))
        .when(mhz == 2484, 14)
        .when(mhz.between(5150, 5895), step(5000))
        .when(mhz == 5935, 2)
        .when(mhz.between(5955, 7115), step(5950))
    )


def band(mhz: Column) -> Column:
    """2.4GHz, 5GHz, 6GHz or null."""
    return F.when(mhz.between(2400, 2500), "2.4GHz").when(mhz.between(5150, 5895), "5GHz").when((mhz == 5935) | mhz.between(5955, 7125), "6GHz")
