"""Roll cycles: UTC-midnight-anchored intervals of whole minutes that divide a day."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_UNIT_MINUTES = {"m": 1, "h": 60, "d": 1440}
MINUTE_US = 60_000_000


@dataclass(frozen=True, order=True)
class RollCycle:
    """A cycle of 1 to 1440 minutes that divides 24 hours."""

    minutes: int

    def __post_init__(self):
        if not isinstance(self.minutes, int) or not 1 <= self.minutes <= 1440 or 1440 % self.minutes:
            raise ValueError(f"a roll cycle is a whole number of minutes that divides 24 hours, not {self.minutes!r}")

    @classmethod
    def parse(cls, text: str) -> RollCycle:
        """From '30m', '4h' or '1d'."""
        m = re.fullmatch(r"(\d{1,4})([mhd])", text or "")
        if not m:
            raise ValueError(f"not a roll cycle: {text!r}")
        return cls(int(m[1]) * _UNIT_MINUTES[m[2]])

    @property
    def micros(self) -> int:
        return self.minutes * MINUTE_US

    def floor(self, us: int) -> int:
        """Start of the interval that holds the instant (epoch microseconds; before 1970 too)."""
        return us // self.micros * self.micros

    def end(self, us: int) -> int:
        """First instant after that interval."""
        return self.floor(us) + self.micros

    def floor_column(self, us: Column) -> Column:
        return us - F.pmod(us, F.lit(self.micros))

    def end_column(self, us: Column) -> Column:
        return self.floor_column(us) + F.lit(self.micros)
