"""Messages, bytes and files as data frames, and data frames as messages."""

from __future__ import annotations

from collections.abc import Iterable

from google.protobuf.message import Message
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import fill_repeated, message_schema, message_to_public
from tessera.operators import udfs, wire
from tessera.options import DEFAULT, SchemaOptions
from tessera.plans.descriptors import MessageType
from tessera.plans.schema import as_nullable, schema_for

_BYTES = T.StructType([T.StructField("value", T.BinaryType())])


class ProtoSQL:
    """All operations under one set of options."""

    def __init__(self, options: SchemaOptions = DEFAULT):
        self.options = options

    def schema_for(self, message: MessageType) -> T.DataType:
        return schema_for(message, self.options)

    def from_proto(self, data: Column, message: MessageType, fields: tuple[str, ...] | None = None) -> Column:
        return wire.from_proto(data, message, self.options, fields)

    def to_proto(self, column: Column, message: MessageType) -> Column:
        return wire.to_proto(column, message, self.options)

    def udf(self, function, returns, *arguments):
        return udfs.proto_udf(function, returns, *arguments, options=self.options)

    def create_dataframe(self, spark: SparkSession, messages: Iterable[Message | None], message: MessageType) -> DataFrame:
        """Messages that the driver holds; they travel as bytes and are taken apart by the executors."""
        rows = [(None if m is None else m.SerializeToString(),) for m in messages]
        return self.decode(spark.createDataFrame(rows, _BYTES), message)

    def to_dataframe(self, rdd: RDD, message: MessageType, spark: SparkSession | None = None) -> DataFrame:
        """An RDD of messages (or their bytes), in its own partitions."""
        spark = spark or SparkSession.active()
        rows = rdd.map(lambda m: (bytes(m) if isinstance(m, (bytes, bytearray)) else m.SerializeToString(),))
        return self.decode(spark.createDataFrame(rows, _BYTES), message)

    def decode(self, df: DataFrame, message: MessageType, column: str = "value", fields: tuple[str, ...] | None = None) -> DataFrame:
        """A frame of wire bytes, also a streaming one, as the message's columns; others are left out.

        Each message is read once, whatever filters and generators follow.
        A message whose column is no struct (an unpacked wrapper, or one with an
        encoder) gives one column, ``value``.
        """
        raw = df.select(wire.raw_from_bytes(F.col(column), message, fields, once=True).alias("raw"))
        decoded = raw.select(message_to_public(F.col("raw"), message.descriptor, self.options, fields).alias("value"))
        return decoded.select("value.*") if isinstance(decoded.schema["value"].dataType, T.StructType) and decoded.schema["value"].dataType.fields else decoded

    def encode(self, df: DataFrame, message: MessageType, name: str = "value") -> DataFrame:
        """A frame with the message's columns, by name, as one column of wire bytes."""
        return self.as_message(df, message).select(self.to_proto(F.struct("*"), message).alias(name))

    def as_message(self, df: DataFrame, message: MessageType) -> DataFrame:
        """``df`` with just the message's columns: found by name at every level, in any order.

        Extra columns are dropped, also inside structs in arrays and maps; a missing
        one is an error.  Null arrays and maps become empty ones.
        """
        declared = self.schema_for(message)
        if not isinstance(declared, T.StructType):
            raise ValueError(f"{message.full_name} is one column of {declared.simpleString()}, not a row")
        wanted = as_nullable(declared)
        if missing := _missing(wanted, df.schema, ""):
            raise ValueError(f"{message.full_name} needs columns that are not there: {', '.join(missing)}")
        if as_nullable(df.select(*(F.col(f"`{f.name}`") for f in wanted)).schema) == wanted:  # `to` makes arrays of structs anew, even so
            fitted = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))
        else:
            fitted = df.to(wanted)
        columns = []
        for f, d in zip(wanted, declared, strict=True):
            filled = fill_repeated(F.col(f"`{f.name}`"), f.dataType, d.dataType)
            if not d.nullable and isinstance(f.dataType, (T.ArrayType, T.MapType)):
                empty = F.array() if isinstance(f.dataType, T.ArrayType) else F.create_map()
                filled = F.coalesce(filled, empty.cast(f.dataType))
            columns.append(filled.alias(f.name))
        return fitted.select(*columns)

    def collect_messages(self, df: DataFrame, message: MessageType) -> list[Message]:
        """The rows of a frame as messages, on the driver."""
        cls = message.message_class
        return [cls.FromString(bytes(r[0])) for r in self.encode(df, message).collect()]

    def read_json(self, spark: SparkSession, path: str, message: MessageType) -> DataFrame:
        """JSON files read with the message's schema; absent keys are null, absent arrays and maps empty."""
        return self.as_message(spark.read.schema(message_schema(message.descriptor, self.options)).json(path), message)

    def read_parquet(self, spark: SparkSession, path: str, message: MessageType) -> DataFrame:
        return self.as_message(spark.read.parquet(path), message)


def _missing(wanted: T.DataType, found: T.DataType, at: str) -> list[str]:
    if isinstance(wanted, T.StructType) and isinstance(found, T.StructType):
        there = {f.name.lower(): f.dataType for f in found}
        out = []
        for f in wanted:
            name = f"{at}{f.name}"
            out += _missing(f.dataType, there[f.name.lower()], f"{name}.") if f.name.lower() in there else [name]
        return out
    if isinstance(wanted, T.ArrayType) and isinstance(found, T.ArrayType):
        return _missing(wanted.elementType, found.elementType, at)
    if isinstance(wanted, T.MapType) and isinstance(found, T.MapType):
        return _missing(wanted.valueType, found.valueType, at)
    return []


def parquet_safe(kind: T.DataType) -> T.DataType | None:
    """``kind`` without what Parquet can't hold, structs that have no fields; None if nothing is left."""
    if isinstance(kind, T.StructType):
        kept = [T.StructField(f.name, k, f.nullable) for f in kind if (k := parquet_safe(f.dataType)) is not None]
        return T.StructType(kept) if kept else None
    if isinstance(kind, T.ArrayType):
        inner = parquet_safe(kind.elementType)
        return None if inner is None else T.ArrayType(inner, kind.containsNull)
    if isinstance(kind, T.MapType):
        inner = parquet_safe(kind.valueType)
        return None if inner is None else T.MapType(kind.keyType, inner, kind.valueContainsNull)
    return kind


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``df``; columns and fields of empty structs, which Parquet refuses, are left out."""
    df.to(as_nullable(parquet_safe(df.schema))).write.mode(mode).parquet(path)


default = ProtoSQL()
with_spark_timestamps = ProtoSQL(DEFAULT.with_spark_timestamps())
with_retained_primitive_wrappers = ProtoSQL(DEFAULT.with_retained_primitive_wrappers())


def with_primitive_wrappers() -> ProtoSQL:
    """The default, under its former name."""
    return ProtoSQL(DEFAULT.with_primitive_wrappers())


def to_dataframe(rdd: RDD, message: MessageType, spark: SparkSession | None = None) -> DataFrame:
    return default.to_dataframe(rdd, message, spark)
