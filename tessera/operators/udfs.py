"""User functions of one to ten arguments that take and return messages, enums, bytes or native values."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.columns import enum_from_name, enum_to_name, message_to_public, message_to_raw
from tessera.operators.wire import struct_from_wire, wire_from_struct
from tessera.options import DEFAULT, SchemaOptions
from tessera.plans.descriptors import EnumType, MessageType, ProtoSchema
from tessera.plans.schema import raw_type

Kind = MessageType | EnumType | T.DataType | str
_MOST = 10


def _native(kind: T.DataType | str) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else T.DataType.fromDDL(kind)


def _to_python(kind: Kind) -> Callable[[pa.Array], list]:
    if not isinstance(kind, MessageType):
        return lambda a: a.to_pylist()
    file_set, name = kind.schema.file_set, kind.full_name

    def messages(a: pa.Array) -> list:
        own = MessageType(ProtoSchema(file_set), name).message_class
        shadow = MessageType(ProtoSchema(file_set), name).shadow_class
        return [None if b is None else own.FromString(b) for b in wire_from_struct(a, shadow).to_pylist()]

    return messages


def _from_python(kind: Kind) -> tuple[T.DataType, Callable[[list], pa.Array]]:
    if isinstance(kind, EnumType):
        return T.IntegerType(), lambda values: pa.array(values, pa.int32())
    if not isinstance(kind, MessageType):
        native = _native(kind)
        arrow = to_arrow_type(native)
        return native, lambda values: pa.array(values, arrow)
    file_set, name = kind.schema.file_set, kind.full_name
    raw = raw_type(kind.descriptor)
    arrow = to_arrow_type(raw)

    def structs(values: list) -> pa.Array:
        shadow = MessageType(ProtoSchema(file_set), name).shadow_class
        return struct_from_wire(pa.array([None if m is None else m.SerializeToString() for m in values], pa.binary()), shadow, arrow)

    return raw, structs


def proto_udf(function: Callable, returns: Kind, *arguments: Kind, options: SchemaOptions = DEFAULT) -> Callable[..., Column]:
    """A column factory for ``function``, called per row in Arrow batches.

    A kind is a message type, an enum type (numbers in Python, names in columns) or a
    Spark type.  Null arguments come as None, and None gives null.
    """
    if not 1 <= len(arguments) <= _MOST:
        raise ValueError(f"one to {_MOST} arguments, not {len(arguments)}")

    @lru_cache(maxsize=1)
    def made() -> Callable[..., Column]:  # types written as text need a session to be read
        readers = [_to_python(k) for k in arguments]
        kind, write = _from_python(returns)

        def call(*columns: pa.Array) -> pa.Array:
            rows = zip(*(read(c) for read, c in zip(readers, columns, strict=True)), strict=True)
            return write([function(*row) for row in rows])

        return F.arrow_udf(call, kind)

    def factory(*columns: Column | str) -> Column:
        if len(columns) != len(arguments):
            raise TypeError(f"{len(arguments)} columns are needed, not {len(columns)}")
        given = []
        for c, k in zip(columns, arguments, strict=True):
            c = F.col(c) if isinstance(c, str) else c
            if isinstance(k, MessageType):
                c = message_to_raw(c, k.descriptor, options)
            elif isinstance(k, EnumType):
                c = enum_from_name(c, k.descriptor)
            else:
                c = c.cast(_native(k))
            given.append(c)
        out = made()(*given)
        if isinstance(returns, MessageType):
            return message_to_public(out, returns.descriptor, options).alias("message")
        return (enum_to_name(out, returns.descriptor) if isinstance(returns, EnumType) else out).alias("value")

    return factory
