"""What identifies a series, and how an order column becomes a number."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A site longer than this many rows is cut into chunks that separate tasks can work on.
ROWS_PER_CHUNK = 1_000_000
# No table is cut into more chunks than this (plus one per cut site): a chunk then has at least
# total/MAX_CHUNKS rows, about what a shuffle partition of a job that size holds anyway.
MAX_CHUNKS = 40_000


@dataclass(frozen=True)
class SeriesSpec:
    """Key columns, order column and tie-break columns of a table of series."""

    site: tuple[str, ...]
    ts: str
    tiebreak: tuple[str, ...] = ()
    rows_per_chunk: int = ROWS_PER_CHUNK
    # a layout already planned for the table, see ``layout.settled``
    layout: Any = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        for name in ("site", "tiebreak"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, (value,))

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.site, self.ts, *self.tiebreak)

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ts, *self.tiebreak)

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.site, *extra).orderBy(*self.order)

    def but(self, **changes) -> "SeriesSpec":
        return replace(self, **{"layout": None, **changes})


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, without touching the session time zone
    when the column has none."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(
            f"cast(cast(cast(`{name}` - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
            " as decimal(18, 6)) * 1000000 as bigint)"
        )
    return F.unix_micros(F.col(name))


def order_number(df: DataFrame, name: str) -> Column:
    """A number that sorts like the order column."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(df, name)
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("bigint")
    if isinstance(kind, T.NumericType):
        return F.col(name)
    raise TypeError(f"order column {name} must be a time or a number, not {kind.simpleString()}")


# Text is told apart by so many leading bytes, as numbers of six bytes each.
TEXT_NUMBERS, TEXT_BYTES = 4, 6


def text_numbers(name: str) -> list[Column]:
    """Numbers that sort like the text as far as its first TEXT_NUMBERS * TEXT_BYTES bytes go."""
    digits = F.hex(F.col(name).cast("binary"))
    width = 2 * TEXT_BYTES
    parts = [F.rpad(F.substring(digits, 1 + i * width, width), width, "0") for i in range(TEXT_NUMBERS)]
    return [F.conv(part, 16, 10).cast("bigint") for part in parts]


def order_numbers(df: DataFrame, spec: SeriesSpec) -> list[Column]:
    """Numbers for the order column and the tie-breaks, up to the first that has no such order."""
    out = [order_number(df, spec.ts)]
    for name in spec.tiebreak:
        if isinstance(df.schema[name].dataType, T.StringType):
            out += text_numbers(name)
            continue
        try:
            out.append(order_number(df, name))
        except TypeError:
            break
    return out
