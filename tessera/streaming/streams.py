"""Streams of wire bytes.  The codecs keep no state, so they run in any streaming query as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.options import DEFAULT, SchemaOptions
from tessera.plans.descriptors import MessageType
from tessera.sources.frames import ProtoSQL


def decode_stream(stream: DataFrame, message: MessageType, column: str = "value", options: SchemaOptions = DEFAULT) -> DataFrame:
    """The stream with ``column`` taken apart into the message's columns, beside its other columns.

    A message whose column is no struct stays one column, ``value``.
    """
    others = [c for c in stream.columns if c != column]
    decoded = stream.select(*others, ProtoSQL(options).from_proto(F.col(column), message).alias("_message"))
    kind = decoded.schema["_message"].dataType
    return decoded.select(*others, "_message.*") if isinstance(kind, T.StructType) and kind.fields else decoded.withColumnRenamed("_message", "value")


def encode_stream(stream: DataFrame, message: MessageType, options: SchemaOptions = DEFAULT) -> DataFrame:
    """The stream as one column of wire bytes, ``value``, as a message queue takes it."""
    return ProtoSQL(options).encode(stream, message)
