"""Scalar column helpers; all JVM-side built-ins, no Python UDFs."""

from tierline.functions.exprs import (
    epoch_us, hours_between, days_between, safe_ratio, hash_fraction,
    round_double, lit_date, lit_ts, json_int, trunc_ntz, wallclock_instant,
    instant_wallclock,
)

__all__ = [
    "epoch_us", "hours_between", "days_between", "safe_ratio", "hash_fraction",
    "round_double", "lit_date", "lit_ts", "json_int", "trunc_ntz",
    "wallclock_instant", "instant_wallclock",
]
