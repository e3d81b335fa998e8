"""Table specifications: a strictly validated schema with operational metadata, its identity and its sizes.

A specification is an Arrow schema whose metadata carries the keys below. It is validated as a whole: every problem is
collected and reported at once.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T

from ..errors import SpecError, StateError, UnsupportedType
from ..functions.values import PAGE

PREFIX = "batchloom."
TABLE_KEYS = {"table", "schema_version", "batch_rows", "time_column", "stats_column"}
COLUMN_KEYS = {"varlen_bytes", "sort_key", "family", "ref"}
DEFAULT_BATCH_ROWS = 65_536
DEFAULT_FAMILY = "base"
BOOL, FIXED, VARLEN = "BOOL_BITMAP", "FIXED", "VARLEN"


def physical_kind(kind: pa.DataType) -> tuple[str, int]:
    """(kind, bytes per element or 0) of an accepted type; UnsupportedType otherwise."""
    t = pa.types
    if t.is_boolean(kind):
        return BOOL, 0
    if t.is_integer(kind) or t.is_float32(kind) or t.is_float64(kind) or t.is_date32(kind):
        return FIXED, kind.bit_width // 8
    if t.is_decimal128(kind):
        return FIXED, 16
    if (t.is_time64(kind) and kind.unit == "ns") or (t.is_timestamp(kind) and kind.unit in ("ns", "us")):
        return FIXED, 8
    if t.is_fixed_size_binary(kind) and kind.byte_width >= 1:
        return FIXED, kind.byte_width
    if t.is_string(kind) or t.is_binary(kind):
        return VARLEN, 0
    raise UnsupportedType(f"type {kind} is outside the accepted profile")


def spark_type(kind: pa.DataType) -> T.DataType:
    """The Spark type that stores an accepted Arrow type without loss.

    Unsigned integers widen by one step; nanosecond times and timestamps are BIGINT counts.
    """
    physical_kind(kind)
    t = pa.types
    if t.is_decimal128(kind):
        return T.DecimalType(kind.precision, kind.scale)
    if t.is_timestamp(kind):
        return T.LongType() if kind.unit == "ns" else T.TimestampType() if kind.tz else T.TimestampNTZType()
    if t.is_time64(kind):
        return T.LongType()
    if t.is_fixed_size_binary(kind) or t.is_binary(kind):
        return T.BinaryType()
    plain = {"bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "date32[day]": T.DateType(), "string": T.StringType()}
    return plain[str(kind)]


@dataclass(frozen=True)
class Column:
    name: str
    type: pa.DataType
    kind: str
    width: int
    varlen_bytes: int | None = None
    sort_key: int | None = None
    family: str = DEFAULT_FAMILY
    ref: str | None = None


@dataclass(frozen=True)
class TableSpec:
    table: str
    schema_version: int
    time_column: str
    columns: tuple[Column, ...]
    batch_rows: int = DEFAULT_BATCH_ROWS
    stats_column: str | None = None
    extra: tuple[tuple[str, str], ...] = field(default=())

    @classmethod
    def load(cls, schema: pa.Schema) -> TableSpec:
        """Parse and validate; SpecError with every problem found."""
        errors: list[str] = []
        meta = _text(schema.metadata)
        own = {k[len(PREFIX) :]: v for k, v in meta.items() if k.startswith(PREFIX)}
        errors += [f"unknown metadata key {PREFIX}{k}" for k in sorted(own.keys() - TABLE_KEYS)]
        seen: set[str] = set()
        for name in schema.names:
            if name in seen:
                errors.append(f"duplicate column name {name!r}")
            seen.add(name)
        table = own.get("table", "")
        if not table.strip():
            errors.append(f"{PREFIX}table is required")
        version = _whole(own, "schema_version", errors, required=True)
        rows = _whole(own, "batch_rows", errors) if "batch_rows" in own else DEFAULT_BATCH_ROWS
        if rows is not None and rows <= 0:
            errors.append(f"{PREFIX}batch_rows must be positive")
        columns, ordinals = [], {}
        for f in schema:
            columns.append(_column(f, errors, ordinals))
        by_name = {f.name: f.type for f in schema}
        time = own.get("time_column")
        if not time:
            errors.append(f"{PREFIX}time_column is required")
        elif time not in by_name:
            errors.append(f"{PREFIX}time_column names no column: {time!r}")
        elif not pa.types.is_timestamp(by_name[time]):
            errors.append(f"{PREFIX}time_column {time!r} must be a Timestamp")
        stats = own.get("stats_column")
        if stats is not None and stats not in by_name:
            errors.append(f"{PREFIX}stats_column names no column: {stats!r}")
        elif stats is not None and not pa.types.is_integer(by_name[stats]):
            errors.append(f"{PREFIX}stats_column {stats!r} must be a fixed-width integer")
        if errors:
            raise SpecError(errors)
        extra = tuple(sorted((k, v) for k, v in meta.items() if not k.startswith(PREFIX)))
        return cls(table, version, time, tuple(columns), rows, stats, extra)

    @classmethod
    def from_arrow(cls, serialised: bytes) -> TableSpec:
        """From an Arrow schema in IPC form; SpecError for what is none."""
        try:
            schema = pa.ipc.read_schema(pa.py_buffer(serialised))
        except (pa.ArrowInvalid, OSError) as e:
            raise SpecError([f"not an Arrow schema: {e}"]) from None
        return cls.load(schema)

    @classmethod
    def from_json(cls, text: str) -> TableSpec:
        raw = json.loads(text)
        columns = tuple(Column(**(c | {"type": _type_from(c["type"])})) for c in raw.pop("columns"))
        return cls(columns=columns, extra=tuple(map(tuple, raw.pop("extra"))), **raw)

    def to_json(self) -> str:
        """Canonical form: the same for any order of metadata keys."""
        raw = {k: getattr(self, k) for k in ("table", "schema_version", "time_column", "batch_rows", "stats_column", "extra")}
        raw["columns"] = [vars(c) | {"type": str(c.type)} for c in self.columns]
        return json.dumps(raw, sort_keys=True, separators=(",", ":"))

    @property
    def sha256(self) -> str:
        """Identity of the schema: two tables scan together only if it agrees."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type), True, {k: v for k, v in (("arrow", str(c.type)), ("varlen_bytes", c.varlen_bytes), ("sort_key", c.sort_key), ("family", c.family), ("ref", c.ref)) if v is not None}) for c in self.columns])

    @property
    def sort_columns(self) -> list[str]:
        """Columns by sort key, else the time column alone."""
        keyed = sorted((c.sort_key, c.name) for c in self.columns if c.sort_key is not None)
        return [name for _, name in keyed] or [self.time_column]

    @property
    def budgets(self) -> dict[str, int]:
        return {c.name: c.varlen_bytes for c in self.columns if c.kind == VARLEN}

    @property
    def families(self) -> list[str]:
        return list(dict.fromkeys(c.family for c in self.columns))

    def require_one_family(self) -> None:
        """Writers hold the columns of one family; several may be declared but not written."""
        if len(self.families) > 1:
            raise StateError(f"a writer takes one column family, not {self.families}")

    def batch_layout(self) -> list[dict]:
        """Offsets of each column's buffers in one fixed-capacity batch, all aligned to 64 bytes; a sizing aid."""
        at, out = 0, []
        bits = -(-self.batch_rows // 8)

        def place(size: int) -> int:
            nonlocal at
            start = -(-at // 64) * 64
            at = start + size
            return start

        for c in self.columns:
            row = {"column": c.name, "validity": place(bits), "offsets": None}
            if c.kind == VARLEN:
                row["offsets"] = place(4 * (self.batch_rows + 1))
            row["capacity"] = bits if c.kind == BOOL else c.varlen_bytes if c.kind == VARLEN else c.width * self.batch_rows
            row["data"] = place(row["capacity"])
            out.append(row)
        return out

    @property
    def batch_bytes(self) -> int:
        """Bytes of one batch at capacity, in whole pages."""
        last = self.batch_layout()[-1]
        return -(-(last["data"] + last["capacity"]) // PAGE) * PAGE


    def segment_regions(self, max_batches: int) -> dict[str, tuple[int, int]]:
        """(offset, bytes) of what a segment of ``max_batches`` full batches would take uncompressed: a page of header, the
        specification, a catalog of 64 bytes a batch, and the batches, each on a page of its own; a sizing aid."""
        at, out = 0, {}
        for name, size in (("header", PAGE), ("spec", len(self.to_json().encode())), ("catalog", 64 * max_batches), ("data", self.batch_bytes * max_batches)):
            out[name] = (at, size)
            at += -(-size // PAGE) * PAGE
        return out


def _text(metadata: dict | None) -> dict[str, str]:
    return {k.decode(): v.decode() for k, v in (metadata or {}).items()}


def _whole(own: dict[str, str], key: str, errors: list[str], required: bool = False, label: str = "") -> int | None:
    if key not in own:
        if required:
            errors.append(f"{PREFIX}{key} is required{label}")
        return None
    try:
        return int(own[key])
    except ValueError:
        errors.append(f"{PREFIX}{key}{label} is not an integer: {own[key]!r}")
        return None


def _column(f: pa.Field, errors: list[str], ordinals: dict[int, str]) -> Column:
    at = f" on column {f.name!r}"
    own = {k[len(PREFIX) :]: v for k, v in _text(f.metadata).items() if k.startswith(PREFIX)}
    errors += [f"unknown metadata key {PREFIX}{k}{at}" for k in sorted(own.keys() - COLUMN_KEYS)]
    try:
        kind, width = physical_kind(f.type)
    except UnsupportedType as e:
        errors.append(f"{e}{at}")
        kind, width = FIXED, 0
    budget = _whole(own, "varlen_bytes", errors, label=at)
    if kind == VARLEN and "varlen_bytes" not in own:
        errors.append(f"{PREFIX}varlen_bytes is required{at}")
    elif kind != VARLEN and "varlen_bytes" in own:
        errors.append(f"{PREFIX}varlen_bytes is only valid on Utf8/Binary, not{at}")
    elif budget is not None and budget <= 0:
        errors.append(f"{PREFIX}varlen_bytes must be positive{at}")
    ordinal = _whole(own, "sort_key", errors, label=at)
    if ordinal is not None:
        if ordinal < 0:
            errors.append(f"{PREFIX}sort_key must not be negative{at}")
        elif ordinal in ordinals:
            errors.append(f"duplicate {PREFIX}sort_key {ordinal}{at}, already on {ordinals[ordinal]!r}")
        ordinals.setdefault(ordinal, f.name)
    if "ref" in own and not pa.types.is_int32(f.type):
        errors.append(f"{PREFIX}ref is only valid on signed Int32, not{at}")
    return Column(f.name, f.type, kind, width, budget, ordinal, own.get("family", DEFAULT_FAMILY), own.get("ref"))


def _type_from(text: str) -> pa.DataType:
    import re

    if m := re.fullmatch(r"decimal128\((\d+), (-?\d+)\)", text):
        return pa.decimal128(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"fixed_size_binary\[(\d+)\]", text):
        return pa.binary(int(m[1]))
    if m := re.fullmatch(r"timestamp\[(\w+)(?:, tz=(.+))?\]", text):
        return pa.timestamp(m[1], m[2])
    if text == "time64[ns]":
        return pa.time64("ns")
    return pa.type_for_alias({"date32[day]": "date32"}.get(text, text))


def column(name: str, kind: pa.DataType, **metadata: object) -> pa.Field:
    """An Arrow field with the library's metadata keys."""
    return pa.field(name, kind, True, {PREFIX + k: str(v) for k, v in metadata.items()} or None)


def schema(columns: list[pa.Field], **metadata: object) -> pa.Schema:
    """An Arrow schema with the library's metadata keys."""
    return pa.schema(columns, {PREFIX + k: str(v) for k, v in metadata.items()})


def quotes_spec(batch_rows: int = DEFAULT_BATCH_ROWS) -> TableSpec:
    """Top-of-book quotes; prices in units of 1e-4."""
    ts, px = pa.timestamp("us", "UTC"), pa.int64()
    return TableSpec.load(schema([column("ts", ts, sort_key=1), column("sym", pa.string(), varlen_bytes=batch_rows * 8, sort_key=0), column("bid_px", px), column("ask_px", px), column("bid_sz", pa.int32()), column("ask_sz", pa.int32()), column("venue", pa.string(), varlen_bytes=batch_rows * 8)], table="quotes", schema_version=1, batch_rows=batch_rows, time_column="ts", stats_column="bid_px"))


def trades_spec(batch_rows: int = DEFAULT_BATCH_ROWS) -> TableSpec:
    """Executions; prices in units of 1e-4."""
    ts, px = pa.timestamp("us", "UTC"), pa.int64()
    return TableSpec.load(schema([column("ts", ts, sort_key=1), column("sym", pa.string(), varlen_bytes=batch_rows * 8, sort_key=0), column("px", px), column("sz", pa.int32()), column("side", pa.string(), varlen_bytes=batch_rows), column("trade_id", px), column("venue", pa.string(), varlen_bytes=batch_rows * 8)], table="trades", schema_version=1, batch_rows=batch_rows, time_column="ts", stats_column="px"))
