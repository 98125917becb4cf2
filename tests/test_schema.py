from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tessera.options import DEFAULT, WRAPPER_TYPES, MessageEncoder, SchemaOptions, camel_names
from tessera.plans.descriptors import ProtoSchema
from tessera.plans.schema import RecursiveMessageError, as_nullable, schema_for, struct_field_for
from tests.protos import _GAUGE, ALL, GAUGES, HARBOR, TIDES


def test_scalars_and_nullability():
    required = schema_for(GAUGES.message("gauges2.Strict"))
    assert required.fieldNames() == list(_GAUGE)
    assert [f.dataType.simpleString() for f in required] == ["int", "bigint", "int", "bigint", "double", "float", "boolean", "string", "binary"]
    assert not any(f.nullable for f in required)
    assert all(f.nullable for f in schema_for(GAUGES.message("gauges2.Loose")))
    assert all(f.nullable for f in schema_for(GAUGES.message("gauges3.Plain")))


def test_nested_repeated_and_enum():
    vessel = schema_for(HARBOR.message("harbor.Vessel"))
    assert vessel.simpleString() == (
        "struct<registry:bigint,callsign:string,tanks:array<int>,waters:string,engine:struct<power:float,fuel:string>,"
        "calls:array<struct<pier:int,depth:double,mooring:string>>,flags:array<string>,ballast:struct<>,seal:binary>"
    )
    assert vessel["flags"] == T.StructField("flags", T.ArrayType(T.StringType(), False), False)


def test_maps():
    assert schema_for(HARBOR.message("harbor.Ledger"))["dues"] == T.StructField("dues", T.MapType(T.StringType(), T.DoubleType(), True), False)
    assert schema_for(ALL.message("all2.Maps"))["m_enum"].dataType.simpleString() == "map<int,string>"


def test_wrappers_and_names():
    message = TIDES.message("tides.Reading")
    assert schema_for(message).simpleString() == "struct<water_height:double,station:string,counts:array<bigint>,alarms:array<boolean>>"
    kept = schema_for(message, DEFAULT.with_retained_primitive_wrappers())
    assert kept.simpleString() == "struct<water_height:struct<value:double>,station:struct<value:string>,counts:array<struct<value:bigint>>,alarms:array<struct<value:boolean>>>"
    assert schema_for(message, DEFAULT.with_camel_names()).fieldNames() == ["waterHeight", "station", "counts", "alarms"]
    assert schema_for(message, DEFAULT.with_camel_names().with_proto_names()).fieldNames()[0] == "water_height"
    assert schema_for(message, DEFAULT.with_column_naming(lambda fd: fd.name.upper())).fieldNames()[0] == "WATER_HEIGHT"
    assert len(WRAPPER_TYPES) == 9


def test_top_level_wrapper_is_a_scalar():
    from google.protobuf import wrappers_pb2

    schema = ProtoSchema.from_modules(wrappers_pb2)
    assert schema_for(schema.message("google.protobuf.UInt64Value")) == T.LongType()
    assert schema_for(schema.message("google.protobuf.UInt64Value"), DEFAULT.with_retained_primitive_wrappers()).simpleString() == "struct<value:bigint>"


def test_timestamps_and_encoders():
    mark = TIDES.message("tides.Mark")
    assert schema_for(mark).simpleString() == "struct<seen_at:struct<seconds:bigint,nanos:int>>"
    assert schema_for(mark, DEFAULT.with_spark_timestamps()).simpleString() == "struct<seen_at:timestamp>"
    encoder = MessageEncoder("tides.Mark", T.LongType(), lambda c: c, lambda c: c)
    assert schema_for(TIDES.message("tides.Logbook"), DEFAULT.with_message_encoders([encoder])).simpleString() == "struct<marks:map<string,bigint>>"
    assert schema_for(mark, DEFAULT.add_message_encoder(encoder)) == T.LongType()


def test_recursion_is_an_error():
    with pytest.raises(RecursiveMessageError, match="harbor.Chain > harbor.Chain"):
        schema_for(HARBOR.message("harbor.Chain"))


def test_deprecated_alias():
    with pytest.warns(DeprecationWarning):
        assert SchemaOptions().with_primitive_wrappers() == DEFAULT


def test_as_nullable_and_fields():
    loose = as_nullable(schema_for(HARBOR.message("harbor.Vessel")))
    assert loose["flags"] == T.StructField("flags", T.ArrayType(T.StringType(), True), True)
    fd = HARBOR.message("harbor.Vessel").descriptor.fields_by_name["tanks"]
    assert struct_field_for(fd) == T.StructField("tanks", T.ArrayType(T.IntegerType(), False), False)
    assert camel_names(TIDES.message("tides.Mark").descriptor.fields[0]) == "seenAt"


def test_unknown_names():
    with pytest.raises(KeyError):
        HARBOR.message("harbor.Nothing")
    with pytest.raises(ValueError, match="unknown type Gone"):
        ProtoSchema.from_text(bad='syntax = "proto3"; message A { Gone g = 1; }')
    with pytest.raises(ValueError, match="expected"):
        ProtoSchema.from_text(bad='syntax = "proto3"; message A { int32 g 1; }')


def test_schema_travels_as_bytes():
    import pickle

    again = pickle.loads(pickle.dumps(HARBOR))
    assert again == HARBOR and schema_for(again.message("harbor.Parcel")) == schema_for(HARBOR.message("harbor.Parcel"))
