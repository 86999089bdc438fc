"""Small value helpers shared by the operators: text, time, bytes, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def utc_instant(ntz: Column) -> Column:
    """Timestamp without zone, read as UTC wall clock, as an instant in any session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ntz).cast("timestamp")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with microseconds and Z; used only where records leave Spark."""
    return F.date_format(
        F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    )


def byte_view(data: Column) -> Column:
    """Binary as text with exactly one character per byte, so that offsets are byte offsets."""
    return F.decode(data, "ISO-8859-1")


def decode_replace(data: Column) -> Column:
    """UTF-8 text, bad sequences shown as U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def decode_ignore(data: Column) -> Column:
    """UTF-8 text, bad sequences left out."""
    return F.replace(decode_replace(data), F.lit("�"), F.lit(""))


def big_endian(data: Column, start: int, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes at the 1-based offset ``start``."""
    return F.conv(F.hex(F.substring(data, start, width)), 16, 10).cast("bigint")


def big_endian_bytes(value: Column, width: int) -> Column:
    """Inverse of :func:`big_endian`."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def preview(text: Column, length: int = 200) -> Column:
    return F.substring(text, 1, length)


def clean_body(body: Column) -> Column:
    """Body without whitespace at either end; null stays null."""
    return F.regexp_replace(body, r"^\s+|\s+$", "")
