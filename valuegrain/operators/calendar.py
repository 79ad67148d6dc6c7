"""Date features: purchase calendar, activity thresholds and holiday proximity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuegrain.functions.bins import flag
from valuegrain.functions.lookups import season

# Fixed holiday dates (month, day).
HOLIDAYS = {
    "new_year": (1, 1),
    "valentines": (2, 14),
    "mothers_day": (5, 12),
    "fathers_day": (6, 16),
    "independence_day": (7, 4),
    "labor_day": (9, 2),
    "halloween": (10, 31),
    "thanksgiving": (11, 28),
    "black_friday": (11, 29),
    "cyber_monday": (12, 2),
    "christmas": (12, 25),
    "boxing_day": (12, 26),
}
MAJOR_HOLIDAYS = ("black_friday", "cyber_monday", "christmas")
UNKNOWN_GAP = 180


def temporal_columns(available: Iterable[str]) -> list[dict[str, Column]]:
    available = set(available)
    out: dict[str, Column] = {}
    for side in ("first", "last"):
        name = f"{side}_purchase_date"
        if name not in available:
            continue
        day = F.col(name)
        out[f"{side}_purchase_dow"] = F.weekday(day)
        out[f"{side}_purchase_month"] = F.month(day)
        out[f"{side}_purchase_quarter"] = F.quarter(day)
        out[f"{side}_purchase_is_weekend"] = flag(F.weekday(day) >= 5)
        if side == "first":
            out["first_purchase_season"] = season(day)
    if "days_since_last_purchase" in available:
        idle = F.col("days_since_last_purchase")
        for days in (7, 30, 90):
            out[f"purchased_last_{days}d"] = flag(idle <= days)
        out["inactive_180d"] = flag(idle > 180)
    return [out]


def holiday_columns(available: Iterable[str]) -> list[dict[str, Column]]:
    """Days from the first purchase to each holiday, and flags for purchases near one.

    A holiday already passed counts as 365 days later whatever the year. "Near"
    covers the holiday and the fourteen days after it.
    """
    if "first_purchase_date" not in set(available):
        return []
    day = F.col("first_purchase_date")
    out: dict[str, Column] = {}
    for name, (month, number) in HOLIDAYS.items():
        holiday = F.make_date(F.year(day), F.lit(month), F.lit(number))
        ahead = F.datediff(holiday, day)
        out[f"days_to_{name}"] = (
            F.when(ahead >= 0, ahead).when(ahead < 0, ahead + 365).otherwise(UNKNOWN_GAP)
        )
        out[f"near_{name}"] = flag(ahead.between(-14, 0))
    summary = {
        "days_to_major_holiday": F.least(*[F.col(f"days_to_{h}") for h in MAJOR_HOLIDAYS]),
        "is_peak_season": flag(F.month(day).isin(11, 12)),
        "near_any_holiday": F.greatest(*[F.col(f"near_{h}") for h in HOLIDAYS]),
    }
    return [out, summary]
