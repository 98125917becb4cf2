"""Spark types of message types.

:func:`schema_for` gives the declared contract (required and repeated fields are not
null).  Columns that this library makes have :func:`as_nullable` of it, as what is
computed may be null for all that Spark knows.
"""

from __future__ import annotations

from google.protobuf.descriptor import Descriptor, FieldDescriptor
from pyspark.sql import types as T

from tessera.options import DEFAULT, SchemaOptions
from tessera.plans.descriptors import MessageType, enum_of, is_map, is_repeated, is_required

MAX_DEPTH = 64
_K = FieldDescriptor
SCALAR_TYPES: dict[int, T.DataType] = {
    _K.CPPTYPE_INT32: T.IntegerType(),
    _K.CPPTYPE_UINT32: T.IntegerType(),
    _K.CPPTYPE_INT64: T.LongType(),
    _K.CPPTYPE_UINT64: T.LongType(),
    _K.CPPTYPE_FLOAT: T.FloatType(),
    _K.CPPTYPE_DOUBLE: T.DoubleType(),
    _K.CPPTYPE_BOOL: T.BooleanType(),
}


class RecursiveMessageError(ValueError):
    """A message type contains itself, so it has no finite schema."""


def schema_for(message: MessageType | Descriptor, options: SchemaOptions = DEFAULT) -> T.DataType:
    """The declared type: a struct, or what stands for it if the message is a wrapper or has an encoder."""
    descriptor = message.descriptor if isinstance(message, MessageType) else message
    return _message(descriptor, options, ())


def _message(descriptor: Descriptor, options: SchemaOptions, above: tuple[str, ...]) -> T.DataType:
    custom = options.custom_type(descriptor.full_name)
    if custom is not None:
        return custom
    if descriptor.full_name in above or len(above) >= MAX_DEPTH:
        raise RecursiveMessageError(" > ".join((*above, descriptor.full_name)))
    inside = (*above, descriptor.full_name)
    return T.StructType([_struct_field(fd, options, inside) for fd in descriptor.fields])


def singular_type(fd: FieldDescriptor, options: SchemaOptions = DEFAULT, above: tuple[str, ...] = ()) -> T.DataType:
    if fd.message_type is not None:
        return _message(fd.message_type, options, above)
    if enum_of(fd) is not None:
        return T.StringType()
    if fd.cpp_type == _K.CPPTYPE_STRING:
        return T.BinaryType() if fd.type == _K.TYPE_BYTES else T.StringType()
    return SCALAR_TYPES[fd.cpp_type]


def data_type_for(fd: FieldDescriptor, options: SchemaOptions = DEFAULT, above: tuple[str, ...] = ()) -> T.DataType:
    if is_map(fd):
        key, value = fd.message_type.fields_by_name["key"], fd.message_type.fields_by_name["value"]
        return T.MapType(singular_type(key, options, above), singular_type(value, options, above))
    if is_repeated(fd):
        return T.ArrayType(singular_type(fd, options, above), containsNull=False)
    return singular_type(fd, options, above)


def struct_field_for(fd: FieldDescriptor, options: SchemaOptions = DEFAULT) -> T.StructField:
    return _struct_field(fd, options, ())


def _struct_field(fd: FieldDescriptor, options: SchemaOptions, above: tuple[str, ...]) -> T.StructField:
    return T.StructField(options.column_naming(fd), data_type_for(fd, options, above), not is_required(fd) and not is_repeated(fd))


def as_nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, as_nullable(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(as_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(as_nullable(kind.keyType), as_nullable(kind.valueType), True)
    return kind


def is_chosen(fields: tuple[str, ...] | None, name: str) -> bool:
    return fields is None or any(f == name or f.startswith(f"{name}.") for f in fields)


def chosen_within(fields: tuple[str, ...] | None, name: str) -> tuple[str, ...] | None:
    """What ``fields`` ("items.id") takes out of the messages of field ``name``; None: all."""
    if fields is None or name in fields:
        return None
    return tuple(f.removeprefix(f"{name}.") for f in fields if f.startswith(f"{name}."))


def unknown_fields(descriptor: Descriptor, fields: tuple[str, ...]) -> list[str]:
    out = []
    for path in fields:
        name, _, rest = path.partition(".")
        fd = descriptor.fields_by_name.get(name)
        if fd is None or (rest and (fd.message_type is None or is_map(fd) or unknown_fields(fd.message_type, (rest,)))):
            out.append(path)
    return sorted(set(out))


def raw_type(descriptor: Descriptor, fields: tuple[str, ...] | None = None, above: tuple[str, ...] = ()) -> T.StructType:
    """The struct that workers read and write: enums are numbers, no option applied."""
    if descriptor.full_name in above or len(above) >= MAX_DEPTH:
        raise RecursiveMessageError(" > ".join((*above, descriptor.full_name)))
    inside = (*above, descriptor.full_name)

    def singular(fd: FieldDescriptor) -> T.DataType:
        if fd.message_type is not None:
            return raw_type(fd.message_type, chosen_within(fields, fd.name) if fd.containing_type is descriptor else None, inside)
        return T.IntegerType() if enum_of(fd) is not None else singular_type(fd)

    def kind(fd: FieldDescriptor) -> T.DataType:
        if is_map(fd):
            return T.MapType(singular(fd.message_type.fields_by_name["key"]), singular(fd.message_type.fields_by_name["value"]))
        return T.ArrayType(singular(fd)) if is_repeated(fd) else singular(fd)

    return T.StructType([T.StructField(fd.name, kind(fd)) for fd in descriptor.fields if is_chosen(fields, fd.name)])
