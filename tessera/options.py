"""Options that change how messages map to columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from google.protobuf.descriptor import FieldDescriptor
from pyspark.sql import Column
from pyspark.sql import types as T

ColumnNaming = Callable[[FieldDescriptor], str]


def proto_names(fd: FieldDescriptor) -> str:
    return fd.name


def camel_names(fd: FieldDescriptor) -> str:
    """lowerCamelCase: a letter after an underscore or a digit is a capital, underscores go."""
    out, up = "", False
    for c in fd.name:
        if c == "_":
            up = True
        elif c.isdigit():
            out, up = out + c, True
        else:
            out, up = out + (c.upper() if up else c), False
    return out[:1].lower() + out[1:]


@dataclass(frozen=True)
class MessageEncoder:
    """Puts a column of ``data_type`` in place of a message type's struct, wherever that occurs.

    ``to_col`` makes the column from the message's struct (proto names, before any
    option), ``from_col`` makes the struct from the column.
    """

    full_name: str
    data_type: T.DataType
    to_col: Callable[[Column], Column]
    from_col: Callable[[Column], Column]

    @classmethod
    def from_injection(cls, full_name: str, data_type: T.DataType, to_col: Callable[[Column], Column], from_col: Callable[[Column], Column]) -> MessageEncoder:
        return cls(full_name, data_type, to_col, from_col)


# The primitive wrappers and the types that they unwrap to.
WRAPPER_TYPES = {
    "google.protobuf.DoubleValue": T.DoubleType(),
    "google.protobuf.BoolValue": T.BooleanType(),
    "google.protobuf.BytesValue": T.BinaryType(),
    "google.protobuf.Int32Value": T.IntegerType(),
    "google.protobuf.Int64Value": T.LongType(),
    "google.protobuf.StringValue": T.StringType(),
    "google.protobuf.FloatValue": T.FloatType(),
    "google.protobuf.UInt32Value": T.IntegerType(),
    "google.protobuf.UInt64Value": T.LongType(),
}


@dataclass(frozen=True)
class SchemaOptions:
    column_naming: ColumnNaming = proto_names
    retain_primitive_wrappers: bool = False
    message_encoders: Mapping[str, MessageEncoder] = field(default_factory=dict)

    def with_camel_names(self) -> SchemaOptions:
        return replace(self, column_naming=camel_names)

    def with_proto_names(self) -> SchemaOptions:
        return replace(self, column_naming=proto_names)

    def with_column_naming(self, naming: ColumnNaming) -> SchemaOptions:
        return replace(self, column_naming=naming)

    def with_retained_primitive_wrappers(self) -> SchemaOptions:
        return replace(self, retain_primitive_wrappers=True)

    def with_primitive_wrappers(self) -> SchemaOptions:
        warnings.warn("wrappers are unpacked by default", DeprecationWarning, stacklevel=2)
        return replace(self, retain_primitive_wrappers=False)

    def with_message_encoders(self, encoders: Iterable[MessageEncoder]) -> SchemaOptions:
        return replace(self, message_encoders={e.full_name: e for e in encoders})

    def add_message_encoder(self, encoder: MessageEncoder) -> SchemaOptions:
        return replace(self, message_encoders={**self.message_encoders, encoder.full_name: encoder})

    def with_spark_timestamps(self) -> SchemaOptions:
        from tessera.functions.columns import TIMESTAMP_ENCODER

        return self.add_message_encoder(TIMESTAMP_ENCODER)

    def is_unpacked_wrapper(self, full_name: str) -> bool:
        return full_name in WRAPPER_TYPES and not self.retain_primitive_wrappers

    def custom_type(self, full_name: str) -> T.DataType | None:
        """The type in place of a message's struct: a message encoder's, else an unpacked wrapper's."""
        if full_name in self.message_encoders:
            return self.message_encoders[full_name].data_type
        return WRAPPER_TYPES[full_name] if self.is_unpacked_wrapper(full_name) else None


DEFAULT = SchemaOptions()
