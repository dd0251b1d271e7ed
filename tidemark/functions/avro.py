"""Binary record payloads as Arrow column functions, for clusters without the spark-avro package.

Both directions handle a whole Arrow batch at a time: one cursor per row moves through the fields with
numpy, so the cost per row is a handful of vector operations and no Python loop over rows.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf

from tidemark.functions.records import Field, record_fields, stored_struct

_ARROW = {
    "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(),
    "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(),
}
_FIXED_WIDTH = {"double": np.dtype("<f8"), "float": np.dtype("<f4")}


class _Cursor:
    """Positions inside many byte slices of one buffer; a row that runs out of bytes turns bad."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.at, self.end = data, start.copy(), end
        self.ok = np.ones(len(start), dtype=bool)

    def byte(self, rows: np.ndarray) -> np.ndarray:
        rows &= self.ok
        short = rows & (self.at >= self.end)
        self.ok[short] = False
        rows &= ~short
        out = np.zeros(len(rows), dtype=np.uint8)
        out[rows] = self.data[self.at[rows]]
        self.at[rows] += 1
        return out

    def whole_number(self, rows: np.ndarray) -> np.ndarray:
        """Variable-length zig-zag integers, at most ten bytes."""
        bits = np.zeros(len(rows), dtype=np.uint64)
        more = rows & self.ok
        for shift in range(0, 70, 7):
            b = self.byte(more)  # clears rows that ran out
            bits |= (b & 0x7F).astype(np.uint64) << np.uint64(shift)
            more = more & (b >= 0x80)
            if not more.any():
                break
        self.ok[more] = False
        return (bits >> np.uint64(1)).astype(np.int64) ^ -(bits & np.uint64(1)).astype(np.int64)

    def slices(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the next ``length`` bytes; zero length for rows without a value."""
        rows = rows & self.ok
        bad = rows & ((length < 0) | (length > self.end - self.at))
        self.ok[bad] = False
        length = np.where(rows & ~bad, length, 0)
        start = self.at.copy()
        self.at += length
        return start, length

    def gather(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all slices back to back, and their offsets."""
        offsets = np.concatenate(([0], np.cumsum(length)))
        source = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        return self.data[source], offsets.astype(np.int32)


def _read_field(cur: _Cursor, field: Field) -> pa.Array:
    n = len(cur.at)
    rows = np.ones(n, dtype=bool)
    if field.is_union:
        branch = cur.whole_number(rows)
        cur.ok &= (branch >= 0) & (branch < len(field.branches))
        if field.nullable:
            rows = branch != field.branches.index("null")
    kind = field.physical
    if kind in ("string", "binary"):
        start, length = cur.slices(rows, cur.whole_number(rows))
        data, offsets = cur.gather(start, length)
        values = pa.BinaryArray.from_buffers(
            _ARROW[kind], n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        )
    elif kind in ("int", "bigint"):
        values = pa.array(cur.whole_number(rows).astype(_ARROW[kind].to_pandas_dtype()))
    elif kind == "boolean":
        values = pa.array(cur.byte(rows.copy()) == 1)
    else:
        dtype = _FIXED_WIDTH[kind]
        start, length = cur.slices(rows, np.full(n, dtype.itemsize))
        numbers = np.zeros(n, dtype=dtype)
        got = length == dtype.itemsize
        numbers[got] = cur.gather(start, length)[0].view(dtype)
        values = pa.array(numbers)
    return values if rows.all() else pc.if_else(pa.array(rows), values, pa.scalar(None, values.type))


def _promoted(values: pa.Array, kind: pa.DataType, ok: np.ndarray) -> pa.Array:
    """Written values as the reader's type; a value that does not fit makes its record unreadable, not the batch."""
    if values.type == kind:
        return values
    if pa.types.is_integer(kind) and pa.types.is_integer(values.type):
        ends = np.iinfo(kind.to_pandas_dtype())
        fits = pc.and_(pc.greater_equal(values, pa.scalar(ends.min, pa.int64())), pc.less_equal(values, pa.scalar(ends.max, pa.int64())))
        ok &= fits.fill_null(True).to_numpy(zero_copy_only=False)
        return pc.if_else(fits, values, pa.scalar(None, values.type)).cast(kind)
    if pa.types.is_floating(kind) and (pa.types.is_integer(values.type) or pa.types.is_floating(values.type)):
        return values.cast(kind, safe=False)
    try:
        return values.cast(kind)
    except pa.ArrowInvalid:
        ok &= values.is_null().to_numpy(zero_copy_only=False)
        return pa.nulls(len(values), kind)


def _read_records(data: np.ndarray, start: np.ndarray, end: np.ndarray, writer: list[Field],
                  reader: list[Field]) -> pa.StructArray:
    """Written records as reader fields; a record that does not parse becomes null."""
    cur = _Cursor(data, start, end)
    read = {f.name: _read_field(cur, f) for f in writer}
    columns = []
    for f in reader:
        kind = _ARROW[f.physical]
        if f.name in read:
            columns.append(_promoted(read[f.name], kind, cur.ok))
        elif f.has_default:
            columns.append(pa.array([f.default] * len(start), kind))
        else:
            cur.ok[:] = False  # the reader needs a field this writer never had
            columns.append(pa.nulls(len(start), kind))
    return pa.StructArray.from_arrays(columns, names=[f.name for f in reader], mask=pa.array(~cur.ok))


def avro_decoder(writers: Mapping[int, str], reader: str):
    """Column function ``(schema_id, payload) -> struct`` of the reader's stored fields."""
    reader_fields = record_fields(reader)
    writer_fields = {i: record_fields(s) for i, s in writers.items()}
    struct_type = pa.struct([(f.name, _ARROW[f.physical]) for f in reader_fields])

    @arrow_udf(stored_struct(reader_fields))
    def decode(schema_id: pa.Array, payload: pa.Array) -> pa.Array:
        payload = payload.cast(pa.binary())
        _, offsets, data = payload.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[payload.offset:payload.offset + len(payload) + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        present = payload.is_valid().to_numpy(zero_copy_only=False)
        ids = schema_id.fill_null(-1).to_numpy(zero_copy_only=False)
        parts, placed = [], []
        for writer_id, fields in writer_fields.items():
            rows = np.flatnonzero(present & (ids == writer_id))
            if len(rows):
                parts.append(_read_records(data, at[rows], at[rows + 1], fields, reader_fields))
                placed.append(rows)
        done = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        where = np.full(len(payload), len(done))
        where[done] = np.arange(len(done))
        return pa.concat_arrays([*parts, pa.nulls(1, struct_type)]).take(pa.array(where))

    return decode


def _number_bytes(numbers: np.ndarray) -> pa.Array:
    """Zig-zag variable-length form of each integer."""
    signed = numbers.astype(np.int64)
    bits = (signed.astype(np.uint64) << np.uint64(1)) ^ (signed >> 63).astype(np.uint64)
    groups = (bits[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))) & np.uint64(0x7F)
    used = np.maximum(1, 10 - np.argmax(groups[:, ::-1] != 0, axis=1))
    used[bits == 0] = 1
    column = np.arange(10)
    body = (groups | np.where(column < used[:, None] - 1, 0x80, 0).astype(np.uint64)).astype(np.uint8)
    offsets = np.concatenate(([0], np.cumsum(used))).astype(np.int32)
    flat = np.ascontiguousarray(body[column < used[:, None]])
    return pa.BinaryArray.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _write_field(values: pa.Array, field: Field) -> list[pa.Array]:
    n = len(values)
    kind = field.physical
    filled = values if values.null_count == 0 else values.fill_null(pa.scalar(_ZERO[kind], values.type))
    if kind in ("string", "binary"):
        raw = filled.cast(pa.binary())
        body = [_number_bytes(pc.binary_length(raw).to_numpy(zero_copy_only=False)), raw]
    elif kind in ("int", "bigint"):
        body = [_number_bytes(filled.to_numpy(zero_copy_only=False))]
    elif kind == "boolean":
        body = [pc.if_else(filled, pa.scalar(b"\x01"), pa.scalar(b"\x00"))]
    else:
        dtype = _FIXED_WIDTH[kind]
        flat = np.ascontiguousarray(filled.to_numpy(zero_copy_only=False).astype(dtype)).view(np.uint8)
        offsets = (np.arange(n + 1) * dtype.itemsize).astype(np.int32)
        body = [pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])]
    if not field.is_union:
        return body if values.null_count == 0 else [pc.if_else(values.is_valid(), p, pa.scalar(None, pa.binary())) for p in body]
    tag = _number_bytes(np.array([field.branches.index(field.primitive)]))[0].as_py()
    if not field.nullable:
        return [pa.array([tag] * n, pa.binary()), *body]
    null_tag = _number_bytes(np.array([field.branches.index("null")]))[0].as_py()
    valid = values.is_valid()
    return [
        pc.if_else(valid, pa.scalar(tag), pa.scalar(null_tag)),
        *[pc.if_else(valid, part, pa.scalar(b"")) for part in body],
    ]


_ZERO = {"string": "", "binary": b"", "boolean": False, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0}


def avro_encoder(schema: str):
    """Column function ``(stored fields in schema order) -> payload``; null if a required field is null."""
    fields = record_fields(schema)

    @arrow_udf("binary")
    def encode(record: pa.Array) -> pa.Array:
        parts = [part for f in fields for part in _write_field(record.field(f.name), f)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b""))

    return encode
