"""The message frame: a zero byte, the writer's schema id in four big-endian bytes, the payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the frame format.
MAGIC = b"\x00"
HEADER_BYTES = 5


def has_magic(value: Column) -> Column:
    return F.substring(value, 1, 1) == F.lit(MAGIC)


def has_header(value: Column) -> Column:
    return F.length(value) >= HEADER_BYTES


def schema_id(value: Column) -> Column:
    """Id in the header, its four bytes read as a signed number; null if the header is short."""
    number = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint")
    return F.when(has_header(value), F.when(number >= 2**31, number - 2**32).otherwise(number).cast("int"))


def payload(value: Column) -> Column:
    return F.when(has_header(value), F.substring(value, HEADER_BYTES + 1, 2**31 - 1))


def frame(schema_id: Column, payload: Column) -> Column:
    """A message under the low four bytes of ``schema_id``, which are the whole id of any 32-bit number."""
    low = F.right(F.lpad(F.hex(schema_id), 16, "0"), F.lit(8))
    return F.concat(F.lit(MAGIC), F.unhex(low), payload)
