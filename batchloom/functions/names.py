"""Names, order and packed ids of segments.

Fixed values: a daily segment is named ``<day>.<sequence>.seg``, as in ``20260728.0.seg``; a shorter cycle's
``<day>.<hour and minute>.<minutes>m.<sequence>.seg``, as in ``20260728.0400.240m.0.seg``. The day has 8 digits, the hour
and minute 4, the cycle 1 to 6, the sequence 1 to 9. The packed id keeps the order of names: minutes since 1970 in bits
31-62, cycle minutes in bits 15-30, sequence in bits 0-14.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

from ..errors import FormatError

SUFFIX = ".seg"
MAX_SEQ, MAX_CYCLE = (1 << 15) - 1, (1 << 16) - 1
_EPOCH = date(1970, 1, 1)
_LAST_MINUTE = ((date(9999, 12, 31) - _EPOCH).days + 1) * 1440 - 1


@dataclass(frozen=True, order=True)
class SegmentName:
    """Ordered by start of the interval, cycle, sequence."""

    start_minute: int
    cycle: int
    seq: int

    @classmethod
    def parse(cls, text: str) -> SegmentName:
        parts = text.removesuffix(SUFFIX).split(".") if text.endswith(SUFFIX) else []
        if len(parts) == 2:  # a day's segment
            parts[1:1] = ["0000", "1440m"]
        if len(parts) != 4 or not parts[2].endswith("m"):
            raise FormatError(f"not a segment name: {text!r}")
        day, clock, cycle, seq = parts[0], parts[1], parts[2][:-1], parts[3]
        for part, least, most in ((day, 8, 8), (clock, 4, 4), (cycle, 1, 6), (seq, 1, 9)):
            if not (part.isascii() and part.isdigit() and least <= len(part) <= most):
                raise FormatError(f"not a segment name: {text!r}")
        try:
            start = datetime(int(day[:4]), int(day[4:6]), int(day[6:]), int(clock[:2]), int(clock[2:]))
        except ValueError as e:
            raise FormatError(f"segment name {text!r}: {e}") from None
        return cls((start.date() - _EPOCH).days * 1440 + start.hour * 60 + start.minute, int(cycle), int(seq))

    def __str__(self) -> str:
        day = (_EPOCH + timedelta(minutes=self.start_minute)).strftime("%Y%m%d")
        if self.cycle == 1440:
            return f"{day}.{self.seq}{SUFFIX}"
        minute = self.start_minute % 1440
        return f"{day}.{minute // 60:02d}{minute % 60:02d}.{self.cycle}m.{self.seq}{SUFFIX}"

    @property
    def id(self) -> int:
        """The packed id; FormatError if a part is out of range."""
        if not (0 <= self.start_minute <= _LAST_MINUTE and 1 <= self.cycle <= MAX_CYCLE and 0 <= self.seq <= MAX_SEQ):
            raise FormatError(f"segment {self.start_minute}/{self.cycle}/{self.seq} has no packed id")
        return self.start_minute << 31 | self.cycle << 15 | self.seq

    @classmethod
    def from_id(cls, packed: int) -> SegmentName:
        name = cls(packed >> 31, packed >> 15 & MAX_CYCLE, packed & MAX_SEQ)
        if packed <= 0 or not 1 <= name.cycle or name.start_minute > _LAST_MINUTE:
            raise FormatError(f"not a packed segment id: {packed}")
        return name

    @property
    def end_minute(self) -> int:
        return self.start_minute + self.cycle

    @property
    def day(self) -> date:
        return _EPOCH + timedelta(minutes=self.start_minute)


def is_detached(name: SegmentName, watermark: int | None) -> bool:
    """Whether a segment lies at or below the detach watermark; one without an id never does."""
    try:
        return watermark is not None and name.id <= watermark
    except FormatError:
        return False


def id_column(start_minute: Column, cycle: Column, seq: Column) -> Column:
    """The packed id, null where a part is out of range."""
    fits = start_minute.between(0, _LAST_MINUTE) & cycle.between(1, MAX_CYCLE) & seq.between(0, MAX_SEQ)
    packed = F.shiftleft(start_minute.cast("bigint"), 31).bitwiseOR(F.shiftleft(cycle.cast("bigint"), 15)).bitwiseOR(seq.cast("bigint"))
    return F.when(fits, packed)


def id_parts(packed: Column) -> tuple[Column, Column, Column]:
    """(start minute, cycle, sequence) of a packed id."""
    return F.shiftright(packed, 31), F.shiftright(packed, 15).bitwiseAND(F.lit(MAX_CYCLE)), packed.bitwiseAND(F.lit(MAX_SEQ))


def name_column(start_minute: Column, cycle: Column, seq: Column) -> Column:
    day = F.date_format(F.date_from_unix_date(F.floor(start_minute / 1440).cast("int")), "yyyyMMdd")
    minute = F.pmod(start_minute, F.lit(1440))
    short = F.format_string("%s.%02d%02d.%dm.%d" + SUFFIX, day, F.floor(minute / 60), F.pmod(minute, F.lit(60)), cycle, seq)
    return F.when(cycle == 1440, F.format_string("%s.%d" + SUFFIX, day, seq)).otherwise(short)


def name_parts(name: Column) -> tuple[Column, Column, Column]:
    """(start minute, cycle, sequence) of a segment name, all null where it is none."""
    fields = F.split(F.substring_index(name, SUFFIX, 1), "\\.")
    short = F.size(fields) == 4
    take = lambda i, least, most: _digits(F.get(fields, F.lit(i)), least, most)
    cycle = F.when(F.endswith(F.get(fields, F.lit(2)), F.lit("m")), _digits(F.rtrim(F.get(fields, F.lit(2)), F.lit("m")), 1, 6))
    day = F.unix_date(F.try_to_date(take(0, 8, 8), "yyyyMMdd")).cast("bigint")
    clock = F.when(short, take(1, 4, 4)).otherwise("0000")
    hour, minute = F.substring(clock, 1, 2).cast("int"), F.substring(clock, 3, 2).cast("int")
    start = day * 1440 + F.when((hour < 24) & (minute < 60), hour * 60 + minute)
    cycle = F.when(short, cycle).otherwise("1440").cast("int")
    seq = F.when(short, take(3, 1, 9)).otherwise(take(1, 1, 9)).cast("bigint")
    known = F.endswith(name, F.lit(SUFFIX)) & F.size(fields).isin(2, 4) & start.isNotNull() & cycle.isNotNull() & seq.isNotNull()
    return F.when(known, start).alias("start_minute"), F.when(known, cycle).alias("cycle"), F.when(known, seq).alias("seq")


def _digits(part: Column, least: int, most: int) -> Column:
    """``part`` if it has only digits and so many of them, else null."""
    return F.when(F.length(part).between(least, most) & (F.translate(part, "0123456789", "") == ""), part)
