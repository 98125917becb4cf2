"""Column functions between raw structs and what users see.  All are Catalyst expressions."""

from __future__ import annotations

from itertools import chain

from google.protobuf.descriptor import Descriptor, EnumDescriptor, FieldDescriptor
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.options import DEFAULT, MessageEncoder, SchemaOptions
from tessera.plans.descriptors import enum_of, is_map, is_repeated
from tessera.plans.schema import as_nullable, chosen_within, data_type_for, is_chosen, schema_for


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def enum_to_name(number: Column, enum: EnumDescriptor) -> Column:
    """The value's name (the first of aliases), or its number in decimal where the enum has no such value."""
    names: dict[int, str] = {}
    for v in enum.values:
        names.setdefault(v.number, v.name)
    return F.coalesce(F.try_element_at(_literal_map(names), number), number.cast("string"))


def enum_from_name(name: Column, enum: EnumDescriptor) -> Column:
    """The number of a name, or of a 32-bit integer in decimal; anything else raises an error."""
    numbers = _literal_map({v.name: v.number for v in enum.values})
    wrong = F.raise_error(F.concat(F.lit("Unexpected value: "), name, F.lit(f" for enum {enum.full_name}"))).cast("int")
    parsed = F.when(name.rlike("^[+-]?[0-9]+$"), name.try_cast("int"))
    return F.when(name.isNotNull(), F.coalesce(F.try_element_at(numbers, name), parsed, wrong))


def timestamp_from_struct(ts: Column) -> Column:
    """Microseconds; what is finer is cut off."""
    micros = ts["seconds"] * 1_000_000 + F.call_function("div", ts["nanos"], F.lit(1000))
    return F.when(ts.isNotNull(), F.timestamp_micros(micros))


def struct_from_timestamp(ts: Column) -> Column:
    """Whole seconds rounded down and nanoseconds of 0 to 999,999,999, also before 1970."""
    micros = F.unix_micros(ts)
    part = F.pmod(micros, F.lit(1_000_000).cast("long"))
    seconds = F.call_function("div", micros - part, F.lit(1_000_000).cast("long"))
    return F.when(ts.isNotNull(), F.struct(seconds.alias("seconds"), (part * 1000).cast("int").alias("nanos")))


TIMESTAMP_ENCODER = MessageEncoder("google.protobuf.Timestamp", T.TimestampType(), timestamp_from_struct, struct_from_timestamp)


def wrap(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("value")))


def whole_or_null(*parts: Column, names: tuple[str, ...]) -> Column:
    """A struct of ``parts``, null as a whole where any of them is."""
    there = parts[0].isNotNull()
    for p in parts[1:]:
        there = there & p.isNotNull()
    return F.when(there, F.struct(*(p.alias(n) for p, n in zip(parts, names, strict=True))))


def _plain(descriptor: Descriptor, options: SchemaOptions, raw: bool, above: tuple[str, ...] = ()) -> bool:
    """Whether a message looks the same raw and to users, so that its struct can stay as it is."""
    if options.custom_type(descriptor.full_name) is not None or descriptor.full_name in above:
        return False
    for fd in descriptor.fields:
        if options.column_naming(fd) != fd.name or enum_of(fd) is not None or (raw and is_repeated(fd)):
            return False
        inner = fd.message_type.fields_by_name["value"] if is_map(fd) else fd
        if enum_of(inner) is not None or (inner.message_type is not None and not _plain(inner.message_type, options, raw, (*above, descriptor.full_name))):
            return False
    return True


def message_to_public(raw: Column, descriptor: Descriptor, options: SchemaOptions = DEFAULT, fields: tuple[str, ...] | None = None) -> Column:
    """A raw struct as users see it: enum names, unpacked wrappers, encoders' columns, column names."""
    name = descriptor.full_name
    if fields is not None and options.custom_type(name) is not None:
        raise ValueError(f"{name} is one column; no fields can be taken out of it")
    if name in options.message_encoders:
        return options.message_encoders[name].to_col(raw)
    if options.is_unpacked_wrapper(name):
        return raw["value"]
    if fields is None and _plain(descriptor, options, False):
        return raw
    parts = [_field_to_public(raw[fd.name], fd, options, chosen_within(fields, fd.name)).alias(options.column_naming(fd)) for fd in descriptor.fields if is_chosen(fields, fd.name)]
    return F.when(raw.isNotNull(), F.struct(*parts)) if parts else raw


def _field_to_public(raw: Column, fd: FieldDescriptor, options: SchemaOptions, fields: tuple[str, ...] | None = None) -> Column:
    def single(c: Column, of: FieldDescriptor) -> Column:
        if of.message_type is not None:
            return message_to_public(c, of.message_type, options, fields)
        enum = enum_of(of)
        return c if enum is None else enum_to_name(c, enum)

    inner = fd.message_type.fields_by_name["value"] if is_map(fd) else fd
    if enum_of(inner) is None and (inner.message_type is None or _plain(inner.message_type, options, False)):
        return raw
    if is_map(fd):
        return F.transform_values(raw, lambda k, v: single(v, inner))
    return F.transform(raw, lambda v: single(v, fd)) if is_repeated(fd) else single(raw, fd)


def message_to_raw(public: Column, descriptor: Descriptor, options: SchemaOptions = DEFAULT) -> Column:
    """The raw struct of a message column; null arrays and maps become empty ones."""
    name = descriptor.full_name
    if name in options.message_encoders:
        return options.message_encoders[name].from_col(public)
    if options.is_unpacked_wrapper(name):
        return wrap(public)
    if _plain(descriptor, options, True):
        return public
    parts = [_field_to_raw(public[options.column_naming(fd)], fd, options).alias(fd.name) for fd in descriptor.fields]
    return F.when(public.isNotNull(), F.struct(*parts)) if parts else public


def _field_to_raw(public: Column, fd: FieldDescriptor, options: SchemaOptions) -> Column:
    def single(c: Column, of: FieldDescriptor) -> Column:
        if of.message_type is not None:
            return message_to_raw(c, of.message_type, options)
        enum = enum_of(of)
        return c if enum is None else enum_from_name(c, enum)

    kind = as_nullable(data_type_for(fd, options))
    if is_map(fd):
        inner = fd.message_type.fields_by_name["value"]
        held = F.coalesce(public, F.create_map().cast(kind))
        return F.transform_values(held, lambda k, v: single(v, inner)) if enum_of(inner) is not None or inner.message_type is not None else held
    if is_repeated(fd):
        held = F.coalesce(public, F.array().cast(kind))
        return F.transform(held, lambda v: single(v, fd)) if enum_of(fd) is not None or fd.message_type is not None else held
    return single(public, fd)


def fill_repeated(public: Column, kind: T.DataType, declared: T.DataType) -> Column:
    """``public`` with null arrays and maps, at any depth where ``declared`` forbids null, made empty."""
    if isinstance(kind, T.StructType):
        if not _has_repeated(declared):
            return public
        parts = []
        for f, d in zip(kind, declared, strict=True):
            inner = fill_repeated(public[f.name], f.dataType, d.dataType)
            if not d.nullable and isinstance(f.dataType, T.ArrayType):
                inner = F.coalesce(inner, F.array().cast(f.dataType))
            elif not d.nullable and isinstance(f.dataType, T.MapType):
                inner = F.coalesce(inner, F.create_map().cast(f.dataType))
            parts.append(inner.alias(f.name))
        return F.when(public.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType) and _has_repeated(declared.elementType):
        return F.transform(public, lambda v: fill_repeated(v, kind.elementType, declared.elementType))
    if isinstance(kind, T.MapType) and _has_repeated(declared.valueType):
        return F.transform_values(public, lambda k, v: fill_repeated(v, kind.valueType, declared.valueType))
    return public


def _has_repeated(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(isinstance(f.dataType, (T.ArrayType, T.MapType)) or _has_repeated(f.dataType) for f in kind)
    return isinstance(kind, (T.ArrayType, T.MapType))


def message_schema(descriptor: Descriptor, options: SchemaOptions = DEFAULT) -> T.DataType:
    """The type of a message column that this library makes."""
    return as_nullable(schema_for(descriptor, options))
