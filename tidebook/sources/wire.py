"""The wire format of a stream: one Arrow record batch per bin in an exact schema, and a JSON header without 64-bit numbers."""

from __future__ import annotations

import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"int64": pa.int64(), "int32": pa.int32(), "int8": pa.int8(), "float64": pa.float64(), "float32": pa.float32(), "bool": pa.bool_(), "string": pa.string()}


def encode(bin_rows: DataFrame, fields: list[tuple[str, str, str]]) -> bytes:
    """Arrow IPC bytes of one bin's rows, with the fields in their order and types. A bin is as small as its lattice is wide."""
    schema = pa.schema([(name, TYPES[kind]) for name, kind, _ in fields])
    table = bin_rows.select(*schema.names).toArrow().cast(schema)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def decode(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(io.BytesIO(data)).read_all()


def header(values: dict, longs: set[str]) -> str:
    """JSON of a bin's header; columns of 64-bit integers go as text, which other languages read without loss."""
    return json.dumps({k: str(v) if k in longs and v is not None else v for k, v in values.items()})
