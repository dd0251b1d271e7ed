"""Flat record schemas (Avro JSON) seen as Spark columns."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Avro primitive -> Spark type of its stored form, and of its logical form.
PHYSICAL = {
    "string": "string", "bytes": "binary", "boolean": "boolean",
    "int": "int", "long": "bigint", "float": "float", "double": "double",
}
LOGICAL = {"timestamp-millis": "timestamp", "timestamp-micros": "timestamp", "date": "date"}

_ABSENT = object()


@dataclass(frozen=True)
class Field:
    name: str
    branches: tuple[str, ...]  # primitive names; more than one for a union, "null" included
    logical: str | None
    default: Any = _ABSENT

    @property
    def is_union(self) -> bool:
        return len(self.branches) > 1

    @property
    def nullable(self) -> bool:
        return "null" in self.branches

    @property
    def primitive(self) -> str:
        return next(b for b in self.branches if b != "null")

    @property
    def has_default(self) -> bool:
        return self.default is not _ABSENT

    @property
    def physical(self) -> str:
        return PHYSICAL[self.primitive]

    def to_logical(self, stored: Column) -> Column:
        if self.logical == "timestamp-millis":
            return F.timestamp_millis(stored)
        if self.logical == "timestamp-micros":
            return F.timestamp_micros(stored)
        if self.logical == "date":
            return F.date_from_unix_date(stored)
        return stored

    def to_stored(self, value: Column) -> Column:
        if self.logical == "timestamp-millis":
            return F.unix_millis(value)
        if self.logical == "timestamp-micros":
            return F.unix_micros(value)
        if self.logical == "date":
            return F.unix_date(value)
        return value.cast(self.physical)


def record_fields(schema: str) -> list[Field]:
    """Fields of a flat record: primitives, logical times and unions of null with one of those."""
    parsed = json.loads(schema)
    if not isinstance(parsed, dict) or parsed.get("type") != "record":
        raise ValueError("expected a record schema")
    fields = []
    for f in parsed["fields"]:
        options = f["type"] if isinstance(f["type"], list) else [f["type"]]
        logical = next((o.get("logicalType") for o in options if isinstance(o, dict)), None)
        names = tuple(o["type"] if isinstance(o, dict) else o for o in options)
        values = [n for n in names if n != "null"]
        if len(values) != 1 or values[0] not in PHYSICAL or len(names) > 2:
            raise ValueError(f"field {f['name']!r} has a type outside flat records: {f['type']!r}")
        fields.append(Field(f["name"], names, logical if logical in LOGICAL else None, f.get("default", _ABSENT)))
    return fields


def stored_struct(fields: list[Field]) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.physical}" for f in fields) + ">"
