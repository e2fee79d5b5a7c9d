"""Column expressions: value cleaning, units, calendar labels and file-name parsing."""

from gridverify.functions.calendar import CYCLE_STEPS, cycle_step, period_label, season
from gridverify.functions.names import member_id
from gridverify.functions.values import (
    clean,
    in_half_open,
    kelvin_to_celsius,
    scaled,
    to_celsius,
)

__all__ = [
    "CYCLE_STEPS",
    "clean",
    "cycle_step",
    "in_half_open",
    "kelvin_to_celsius",
    "member_id",
    "period_label",
    "scaled",
    "season",
    "to_celsius",
]
