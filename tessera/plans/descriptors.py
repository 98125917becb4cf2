"""Message types: descriptors, and the shadow types that raw columns are read with.

In a shadow every enum field is an int32.  The bytes are the same, but numbers that
the enum does not name keep their place, even in proto2, where a parser would move
them to unknown fields.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from google.protobuf import any_pb2, descriptor_pb2, descriptor_pool, duration_pb2, empty_pb2, field_mask_pb2, message_factory, struct_pb2, timestamp_pb2, wrappers_pb2
from google.protobuf.descriptor import Descriptor, EnumDescriptor, FieldDescriptor
from google.protobuf.message import Message

from tessera.plans.proto_text import parse, resolve

_WELL_KNOWN = [m.DESCRIPTOR.serialized_pb for m in (any_pb2, duration_pb2, empty_pb2, field_mask_pb2, struct_pb2, timestamp_pb2, wrappers_pb2)]
_F = descriptor_pb2.FieldDescriptorProto


def is_map(fd: FieldDescriptor) -> bool:
    return fd.message_type is not None and fd.message_type.GetOptions().map_entry


def is_repeated(fd: FieldDescriptor) -> bool:
    return bool(fd.is_repeated)


def is_required(fd: FieldDescriptor) -> bool:
    return bool(fd.is_required)


class ProtoSchema:
    """A set of .proto files.  It travels to workers as bytes; pools are built once in each process."""

    def __init__(self, file_set: bytes):
        self.file_set = file_set

    @classmethod
    def from_files(cls, files: Iterable[descriptor_pb2.FileDescriptorProto]) -> ProtoSchema:
        return cls(descriptor_pb2.FileDescriptorSet(file=files).SerializeToString(deterministic=True))

    @classmethod
    def from_text(cls, **sources: str) -> ProtoSchema:
        """From .proto sources, as ``from_text(people="syntax = ...")`` for ``people.proto``; imports come before importers."""
        files = [parse(text, f"{name}.proto") for name, text in sources.items()]
        resolve(files, [descriptor_pb2.FileDescriptorProto.FromString(raw) for raw in _WELL_KNOWN])
        return cls.from_files(files)

    @classmethod
    def from_modules(cls, *modules) -> ProtoSchema:
        """From generated ``_pb2`` modules and all that they import."""
        files: dict[str, descriptor_pb2.FileDescriptorProto] = {}

        def add(fd) -> None:
            if fd.name not in files:
                for other in fd.dependencies:
                    add(other)
                files[fd.name] = descriptor_pb2.FileDescriptorProto.FromString(fd.serialized_pb)

        for module in modules:
            add(module.DESCRIPTOR)
        return cls.from_files(files.values())

    def __eq__(self, other) -> bool:
        return isinstance(other, ProtoSchema) and self.file_set == other.file_set

    def __hash__(self) -> int:
        return hash(self.file_set)

    def message(self, name: str) -> MessageType:
        return MessageType(self, name)

    def enum(self, name: str) -> EnumType:
        return EnumType(self, name)


class MessageType:
    """One message type of a schema, by full name."""

    def __init__(self, schema: ProtoSchema, full_name: str):
        self.schema, self.full_name = schema, full_name
        _pool(schema.file_set, False).FindMessageTypeByName(full_name)  # an unknown name fails here

    @property
    def descriptor(self) -> Descriptor:
        return _pool(self.schema.file_set, False).FindMessageTypeByName(self.full_name)

    @property
    def message_class(self) -> type[Message]:
        return _message_class(self.schema.file_set, self.full_name, False)

    @property
    def shadow_class(self) -> type[Message]:
        return _message_class(self.schema.file_set, self.full_name, True)

    def __call__(self, **fields) -> Message:
        return self.message_class(**fields)


class EnumType:
    """One enum type of a schema, by full name."""

    def __init__(self, schema: ProtoSchema, full_name: str):
        self.schema, self.full_name = schema, full_name

    @property
    def descriptor(self) -> EnumDescriptor:
        return _pool(self.schema.file_set, False).FindEnumTypeByName(self.full_name)


@lru_cache(maxsize=64)
def _message_class(file_set: bytes, name: str, shadow: bool) -> type[Message]:
    return message_factory.GetMessageClass(_pool(file_set, shadow).FindMessageTypeByName(name))


def enum_of(fd: FieldDescriptor) -> EnumDescriptor | None:
    """A field's enum, also where the runtime only takes the field as a number (see :func:`_pool`)."""
    if fd.enum_type is not None:
        return fd.enum_type
    name = _NUMBERED.get((id(fd.file.pool), fd.full_name))
    return fd.file.pool.FindEnumTypeByName(name) if name else None


#: By pool and field: enums of map values that stand as int32 in the pool.
_NUMBERED: dict[tuple[int, str], str] = {}
_POOLS: dict[tuple[bytes, bool], descriptor_pool.DescriptorPool] = {}


def _pool(file_set: bytes, shadow: bool) -> descriptor_pool.DescriptorPool:
    """The pool of a schema.

    The runtime refuses maps to a proto2 enum whose first number isn't 0; such
    values are int32 in its pool, and :func:`enum_of` knows better.
    """
    if (file_set, shadow) in _POOLS:
        return _POOLS[file_set, shadow]
    pool = descriptor_pool.DescriptorPool()
    for raw in _WELL_KNOWN:
        pool.AddSerializedFile(raw)
    files = [f for f in descriptor_pb2.FileDescriptorSet.FromString(file_set).file if f.name not in _KNOWN_FILES]
    enums: dict[str, tuple[str, descriptor_pb2.EnumDescriptorProto]] = {}
    for f in files:
        scope = f".{f.package}" if f.package else ""
        enums.update({f"{scope}.{e.name}": (f.syntax, e) for e in f.enum_type})
        for message in f.message_type:
            _nested_enums(message, scope, f.syntax, enums)
    for f in files:
        scope = f".{f.package}" if f.package else ""
        for message in f.message_type:
            _retype(message, scope, enums, shadow, pool)
        pool.AddSerializedFile(f.SerializeToString())
    _POOLS[file_set, shadow] = pool
    return pool


_KNOWN_FILES = {descriptor_pb2.FileDescriptorProto.FromString(raw).name for raw in _WELL_KNOWN}


def _nested_enums(message: descriptor_pb2.DescriptorProto, scope: str, syntax: str, enums: dict) -> None:
    name = f"{scope}.{message.name}"
    enums.update({f"{name}.{e.name}": (syntax, e) for e in message.enum_type})
    for nested in message.nested_type:
        _nested_enums(nested, name, syntax, enums)


def _retype(message: descriptor_pb2.DescriptorProto, scope: str, enums: dict, every: bool, pool: descriptor_pool.DescriptorPool) -> None:
    name = f"{scope}.{message.name}"
    for field in message.field:
        if field.type != _F.TYPE_ENUM or field.type_name not in enums:
            continue
        syntax, enum = enums[field.type_name]
        refused = message.options.map_entry and syntax != "proto3" and enum.value[0].number != 0
        if not every and not refused:
            continue
        if not every:
            _NUMBERED[id(pool), f"{name}.{field.name}"[1:]] = field.type_name[1:]
        if field.default_value:
            field.default_value = str(next(v.number for v in enum.value if v.name == field.default_value))
        field.type = _F.TYPE_INT32
        field.ClearField("type_name")
    for nested in message.nested_type:
        _retype(nested, name, enums, every, pool)
