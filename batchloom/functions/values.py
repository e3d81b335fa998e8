"""Value-level helpers as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

LENGTH_MASK = (1 << 63) - 1
PAGE = 4096


def row_count(length: Column) -> Column:
    """Rows of a catalog length word, whose sign bit says that the batch is in progress."""
    return length.bitwiseAND(F.lit(LENGTH_MASK))


def in_progress(length: Column) -> Column:
    return length < 0


def length_word(rows: Column, sealed: Column) -> Column:
    return F.when(sealed, rows.cast("bigint")).otherwise(rows.cast("bigint").bitwiseOR(F.lit(-(1 << 63))))


def align(n: Column, unit: int) -> Column:
    """The next multiple of ``unit``."""
    return (F.floor((n + F.lit(unit - 1)) / F.lit(unit)) * F.lit(unit)).cast("bigint")


def bitmap_bytes(rows: Column) -> Column:
    return F.floor((rows + F.lit(7)) / F.lit(8)).cast("bigint")


def overlaps(low: Column, high: Column, range_low: Column | int, range_high: Column | int) -> Column:
    """Whether two closed ranges meet; null if a bound is."""
    return (low <= range_high) & (high >= range_low)


def scaled_price(px: Column) -> Column:
    """A price in units of 1e-4 as a double."""
    return px / F.lit(10000.0).cast("double")


def unsigned(value: Column, bits: int) -> Column:
    """The unsigned reading of a signed integer of 8, 16, 32 or 64 bits, in a type that holds it."""
    if bits == 64:
        wide = value.cast("decimal(20,0)")
        return F.when(value < 0, wide + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
    return F.pmod(value.cast("bigint"), F.lit(1 << bits))


def decimal_from_halves(low: Column, high: Column, scale: int) -> Column:
    """DECIMAL(38, scale) of the 128-bit number high * 2**64 + unsigned(low); null beyond 38 digits."""
    wide = F.try_multiply(high.cast("decimal(19,0)"), F.lit(Decimal(1 << 64)).cast("decimal(20,0)"))
    whole = F.try_add(wide.cast("decimal(38,0)"), unsigned(low, 64))
    # The point is set in the digits, as a division would round.
    digits = F.lpad(F.abs(whole).cast("string"), 39, "0")
    sign = F.when(whole < 0, "-").otherwise("")
    return F.concat(sign, F.substring(digits, 1, 39 - scale), F.lit("."), F.substring(digits, 40 - scale, scale)).try_cast(f"decimal(38,{scale})")


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(value))


def quoted(value: Column) -> Column:
    """Text in double quotes, quotes inside doubled."""
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
