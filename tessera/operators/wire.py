"""Wire bytes to raw structs and back, in Arrow batches.

This is the only place where rows pass through Python.  Messages are taken apart
field by field into Arrow columns; names, wrappers, timestamps and the like are left
to column functions, which Catalyst sees through.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from google.protobuf.descriptor import Descriptor, FieldDescriptor
from google.protobuf.message import Message
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.columns import message_to_public, message_to_raw
from tessera.operators.wireread import Odd, struct_of
from tessera.operators.wirewrite import wire_of
from tessera.options import DEFAULT, SchemaOptions
from tessera.plans.descriptors import MessageType, ProtoSchema, is_map, is_repeated, is_required
from tessera.plans.schema import raw_type, unknown_fields

_K = FieldDescriptor
_SIGNED = {_K.CPPTYPE_UINT32: np.dtype("<u4"), _K.CPPTYPE_UINT64: np.dtype("<u8")}
_MASK = {_K.CPPTYPE_UINT32: (1 << 32) - 1, _K.CPPTYPE_UINT64: (1 << 64) - 1}


@lru_cache(maxsize=256)
def _arrow_type(file_set: bytes, full_name: str, fields: tuple[str, ...] | None) -> pa.StructType:
    return to_arrow_type(raw_type(MessageType(ProtoSchema(file_set), full_name).descriptor, fields))


def _array(values: list, fd: FieldDescriptor, kind: pa.DataType) -> pa.Array:
    """Unsigned numbers keep their width and wrap to signed ones."""
    unsigned = _SIGNED.get(fd.cpp_type)
    if unsigned is None:
        return pa.array(values, kind)
    return pa.array(values, pa.from_numpy_dtype(unsigned)).view(kind)


def messages_to_struct(messages: list[Message | None], cls: type[Message], kind: pa.StructType) -> pa.StructArray:
    """One raw struct per message; the fields are those of ``kind``.

    Unset fields that have presence are null, others hold their default.
    """
    blank = cls()
    missing = [m is None for m in messages]
    full = [blank if m is None else m for m in messages] if any(missing) else messages
    if not kind.num_fields:
        return pa.array([None if x else {} for x in missing], kind)
    by_name = cls.DESCRIPTOR.fields_by_name
    children = [_field(full, by_name[f.name], f.type) for f in kind]
    return pa.StructArray.from_arrays(children, fields=list(kind), mask=pa.array(missing, pa.bool_()))


def _class(fd: FieldDescriptor) -> type[Message]:
    from google.protobuf import message_factory

    return message_factory.GetMessageClass(fd.message_type)


def _field(messages: list[Message], fd: FieldDescriptor, kind: pa.DataType) -> pa.Array:
    name = fd.name
    if is_map(fd):
        entries = [getattr(m, name) for m in messages]
        value = fd.message_type.fields_by_name["value"]
        keys = _array([k for e in entries for k in e], fd.message_type.fields_by_name["key"], kind.key_type)
        items = [e[k] for e in entries for k in e]
        values = messages_to_struct(items, _class(value), kind.item_type) if value.message_type is not None else _array(items, value, kind.item_type)
        return pa.MapArray.from_arrays(_offsets(entries), keys, values, type=kind)
    if is_repeated(fd):
        lists = [getattr(m, name) for m in messages]
        flat = list(chain.from_iterable(lists))
        values = messages_to_struct(flat, _class(fd), kind.value_type) if fd.message_type is not None else _array(flat, fd, kind.value_type)
        return pa.ListArray.from_arrays(_offsets(lists), values, type=kind)
    if fd.message_type is not None:
        return messages_to_struct([getattr(m, name) if m.HasField(name) else None for m in messages], _class(fd), kind)
    if fd.has_presence and not is_required(fd):
        return _array([getattr(m, name) if m.HasField(name) else None for m in messages], fd, kind)
    return _array([getattr(m, name) for m in messages], fd, kind)


def _offsets(lists: list) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int32))).astype(np.int32))


def struct_from_wire(raw: pa.Array, cls: type[Message], kind: pa.StructType) -> pa.StructArray:
    """One raw struct per message of a binary array; fields that ``kind`` lacks are skipped."""
    try:
        return struct_of(raw, cls.DESCRIPTOR, kind)
    except Odd:
        return messages_to_struct([None if b is None else cls.FromString(b) for b in raw.to_pylist()], cls, kind)


def wire_from_struct(structs: pa.StructArray, cls: type[Message]) -> pa.Array:
    """Wire bytes of each raw struct, null for null."""
    try:
        return wire_of(structs, cls.DESCRIPTOR)
    except Odd:
        return pa.array([None if m is None else m.SerializeToString(deterministic=True) for m in struct_to_messages(structs, cls)], pa.binary())


def struct_to_messages(array: pa.StructArray, cls: type[Message]) -> list[Message | None]:
    """One message per struct, None for null.  Null fields stay unset."""
    out = [cls() if valid else None for valid in array.is_valid().to_pylist()]
    for i in range(array.type.num_fields):
        _fill(out, cls.DESCRIPTOR.fields_by_name[array.type.field(i).name], array.field(i))
    return out


def _fill(messages: list[Message | None], fd: FieldDescriptor, column: pa.Array) -> None:
    name, mask = fd.name, _MASK.get(fd.cpp_type)
    if is_map(fd):
        value = fd.message_type.fields_by_name["value"]
        key_mask, value_mask = _MASK.get(fd.message_type.fields_by_name["key"].cpp_type), _MASK.get(value.cpp_type)
        starts, keys = column.offsets.to_pylist(), column.keys.to_pylist()
        nested = value.message_type is not None
        items = struct_to_messages(column.items, _class(value)) if nested else column.items.to_pylist()
        for n, (m, valid) in enumerate(zip(messages, column.is_valid().to_pylist(), strict=True)):
            if m is None or not valid:
                continue
            held = getattr(m, name)
            for i in range(starts[n], starts[n + 1]):
                key = keys[i] & key_mask if key_mask else keys[i]
                if nested:
                    held[key].MergeFrom(items[i]) if items[i] is not None else held[key]
                elif items[i] is not None:
                    held[key] = items[i] & value_mask if value_mask else items[i]
                else:
                    held[key] = type(held[key])()
    elif is_repeated(fd):
        if fd.message_type is not None:
            starts = column.offsets.to_pylist()
            items = struct_to_messages(column.values, _class(fd))
            for n, (m, valid) in enumerate(zip(messages, column.is_valid().to_pylist(), strict=True)):
                if m is not None and valid:
                    getattr(m, name).extend(items[starts[n] : starts[n + 1]])
        else:
            for m, values in zip(messages, column.to_pylist(), strict=True):
                if m is not None and values:
                    getattr(m, name).extend([v & mask for v in values] if mask else values)
    elif fd.message_type is not None:
        for m, inner in zip(messages, struct_to_messages(column, _class(fd)), strict=True):
            if m is not None and inner is not None:
                held = getattr(m, name)
                held.SetInParent()
                held.MergeFrom(inner)
    else:
        for m, v in zip(messages, column.to_pylist(), strict=True):
            if m is not None and v is not None:
                setattr(m, name, v & mask if mask else v)


def raw_from_bytes(data: Column, message: MessageType, fields: tuple[str, ...] | None = None, once: bool = False) -> Column:
    """``once`` keeps Spark from copying the call into filters and into what reads the column."""
    if fields is not None and (unknown := unknown_fields(message.descriptor, fields)):
        raise ValueError(f"{message.full_name} has no field {', '.join(unknown)}")
    file_set, name = message.schema.file_set, message.full_name
    kind = raw_type(message.descriptor, fields)

    def parse(raw: pa.Array) -> pa.Array:
        return struct_from_wire(raw, MessageType(ProtoSchema(file_set), name).shadow_class, _arrow_type(file_set, name, fields))

    call = F.arrow_udf(parse, kind)
    return (call.asNondeterministic() if once else call)(data)


def bytes_from_raw(raw: Column, message: MessageType) -> Column:
    file_set, name = message.schema.file_set, message.full_name

    def serialize(structs: pa.Array) -> pa.Array:
        cls = MessageType(ProtoSchema(file_set), name).shadow_class
        return wire_from_struct(structs, cls)

    return F.arrow_udf(serialize, "binary")(raw)


def from_proto(data: Column, message: MessageType, options: SchemaOptions = DEFAULT, fields: tuple[str, ...] | None = None) -> Column:
    """The message column of a column of wire bytes; null bytes give null.

    ``fields`` (proto names, also of inner messages: "items.id") restricts what is taken
    out of the messages.  Bytes that are no such message fail the query.
    """
    # named, as Spark can't make up a name for every expression with lambdas inside
    return message_to_public(raw_from_bytes(data, message, fields), message.descriptor, options, fields).alias("message")


def to_proto(column: Column, message: MessageType, options: SchemaOptions = DEFAULT) -> Column:
    """Wire bytes of a message column (with all fields, by name); null gives null, null fields stay unset.

    A null required field, or a null in an array, fails the query.
    """
    return bytes_from_raw(message_to_raw(column, message.descriptor, options), message).alias("value")
