from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pytest
from google.protobuf.message import EncodeError, Message
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.columns import enum_from_name, enum_to_name, struct_from_timestamp, timestamp_from_struct, whole_or_null
from tessera.operators.wire import _arrow_type, from_proto, messages_to_struct, struct_from_wire, struct_to_messages, to_proto, wire_from_struct
from tessera.operators.wireread import Odd, struct_of
from tessera.operators.wirewrite import wire_of
from tessera.options import DEFAULT
from tessera.plans.schema import as_nullable, schema_for
from tests.protos import _GAUGE, _KINDS, ALL, GAUGES, HARBOR, TIDES

OPTIONS = {"default": DEFAULT, "wrappers kept": DEFAULT.with_retained_primitive_wrappers(), "camel": DEFAULT.with_camel_names()}


def frame(spark, messages):
    return spark.createDataFrame([(None if m is None else m.SerializeToString(),) for m in messages], "b binary")


def round_trip(spark, messages: list[Message], message, options=DEFAULT) -> None:
    df = frame(spark, messages).select(from_proto(F.col("b"), message, options).alias("m"))
    assert df.schema["m"].dataType == as_nullable(schema_for(message, options))
    back = df.select(to_proto(F.col("m"), message, options)).collect()
    assert [message.message_class.FromString(bytes(r[0])) for r in back] == messages


_INT = {"32": st.integers(-(2**31), 2**31 - 1), "64": st.integers(-(2**63), 2**63 - 1), "u32": st.integers(0, 2**32 - 1), "u64": st.integers(0, 2**64 - 1)}
VALUES = {
    "double": st.floats(allow_nan=False), "float": st.floats(width=32, allow_nan=False), "bool": st.booleans(), "bytes": st.binary(max_size=8),
    "string": st.text(st.characters(exclude_categories=["Cs"]), max_size=8),
} | {k: _INT[("u" if k.startswith(("u", "fixed")) else "") + k[-2:]] for k in _KINDS if k[-2:] in ("32", "64")}
quick = settings(max_examples=4, deadline=None, phases=[Phase.generate], database=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("name", ["all2.Scalars", "all3.Scalars"])
@quick
@given(data=st.data())
def test_scalars(spark, name, data):
    message = ALL.message(name)

    def one() -> Message:
        m = message()
        for k in _KINDS:
            if data.draw(st.booleans()):
                setattr(m, f"o_{k}", data.draw(VALUES[k]))
            getattr(m, f"r_{k}").extend(data.draw(st.lists(VALUES[k], max_size=3)))
            if name == "all2.Scalars":
                setattr(m, f"q_{k}", data.draw(VALUES[k]))
        return m

    round_trip(spark, [one() for _ in range(4)], message)


@pytest.mark.parametrize("name", ["all2.Maps", "all3.Maps"])
@quick
@given(data=st.data())
def test_maps(spark, name, data):
    message = ALL.message(name)

    def one() -> Message:
        m = message()
        for k in _KINDS:
            for key, value in data.draw(st.dictionaries(_INT["32"], VALUES[k], max_size=2)).items():
                getattr(m, f"m_{k}")[key] = value
        m.by_name["x"] = data.draw(_INT["32"])
        m.m_enum[3] = 4
        m.m_message[7].c = data.draw(st.binary(max_size=3))
        m.m_message[8].below.add(a="q", e=5)
        return m

    round_trip(spark, [one() for _ in range(3)] + [message()], message)


@pytest.mark.parametrize("package", ["all2", "all3"])
@pytest.mark.parametrize("options", list(OPTIONS))
def test_enums_oneofs_nesting_and_well_known_types(spark, package, options):
    message = ALL.message(f"{package}.Rest")
    rows = [message() for _ in range(6)]
    rows[0].e, rows[0].number = 2, 2**32 - 1
    rows[0].es.extend([1, -1, 2])
    rows[0].packed.extend([4, 5])
    rows[1].nested.below.add(a="deep", e=4)
    rows[1].levels.add(c=b"\x00\xff").below.add()
    rows[2].text = ""
    rows[3].raw = b""
    rows[3].at.seconds, rows[3].at.nanos = -5, 7
    rows[3].spans.add(seconds=1, nanos=-1)
    rows[4].any.Pack(ALL.message(f"{package}.Level")(c=b"in"))
    rows[4].kind = 5
    rows[5].level.SetInParent()
    round_trip(spark, rows, message, OPTIONS[options])


def test_unrecognized_enum_numbers_keep_their_places(spark):
    message = ALL.message("all2.Rest")
    raw = message.shadow_class(e=15, es=[1, 15, -1], packed=[99, 4]).SerializeToString(deterministic=True)
    df = spark.createDataFrame([(raw,)], "b binary").select("b", from_proto(F.col("b"), message).alias("m"))
    got = df.select("m.e", "m.es", "m.packed", to_proto(F.col("m"), message).alias("again"), "b").first()
    assert (got["e"], got["es"], got["packed"], got["again"]) == ("15", ["FOO", "15", "NEG"], ["99", "FOREIGN_FOO"], got["b"])


def test_enum_columns(spark):
    waters = HARBOR.enum("harbor.Waters").descriptor
    df = spark.createDataFrame([("COASTAL",), ("7",), ("+15",), (None,)], "s string")
    assert [r[0] for r in df.select(enum_to_name(enum_from_name(F.col("s"), waters), waters)).collect()] == ["COASTAL", "OCEAN", "15", None]
    for wrong in ("ocean", " 5 ", "99999999999", ""):
        with pytest.raises(Exception, match="Unexpected value: .* for enum harbor.Waters"):
            spark.createDataFrame([(wrong,)], "s string").select(enum_from_name(F.col("s"), waters)).collect()


def test_defaults_and_presence(spark):
    zeros = dict(zip(_GAUGE, [0, 0, 0, 0, 0.0, 0.0, False, "", b""], strict=True))
    read = lambda message, *rows: [r.asDict() for r in frame(spark, list(rows)).select(from_proto(F.col("b"), message).alias("m")).select("m.*").collect()]
    plain, loose, strict, known = (GAUGES.message(m) for m in ("gauges3.Plain", "gauges2.Loose", "gauges2.Strict", "gauges3.Known"))
    assert read(plain, plain()) == [zeros]
    assert read(loose, loose()) == [dict.fromkeys(_GAUGE)]
    assert read(strict, strict(**zeros)) == [zeros]
    assert read(known, known(), known(maybe=0)) == [{"always": 0, "maybe": None}, {"always": 0, "maybe": 0}]


def test_null_required_field_fails_and_null_scalar_is_default(spark):
    message = GAUGES.message("gauges2.Strict")
    kind = as_nullable(schema_for(message)).simpleString()
    empty = spark.range(1).select(F.from_json(F.lit("{}"), kind).alias("m"))
    with pytest.raises(Exception, match="EncodeError|missing required"):
        empty.select(to_proto(F.col("m"), message)).collect()
    message = GAUGES.message("gauges3.Plain")
    assert spark.range(1).select(F.from_json(F.lit("{}"), as_nullable(schema_for(message)).simpleString()).alias("m")).select(to_proto(F.col("m"), message)).first()[0] == b""
    assert EncodeError


def test_null_messages_and_columns(spark):
    message = HARBOR.message("harbor.Vessel")
    df = frame(spark, [None, message(callsign="x")]).select(from_proto(F.col("b"), message).alias("m"))
    assert [r[0] is None for r in df.collect()] == [True, False]
    assert [r[0] for r in df.select(to_proto(F.col("m"), message)).collect()] == [None, message(callsign="x").SerializeToString()]
    kind = as_nullable(schema_for(message)).simpleString().replace("ballast:struct<>,", "")
    holes = spark.range(1).select(F.from_json(F.lit('{"callsign":"n","calls":[null,{"pier":4}]}'), kind).alias("m"))
    assert holes.select("m.flags").first()[0] is None


def test_present_wrapper_of_zero(spark):
    message = TIDES.message("tides.Reading")
    zero = message()
    zero.water_height.value = 0
    got = frame(spark, [zero, message()]).select(from_proto(F.col("b"), message).alias("m")).select("m.water_height").collect()
    assert [r[0] for r in got] == [0, None]


def test_chosen_fields(spark):
    message = HARBOR.message("harbor.Vessel")
    df = frame(spark, [message(callsign="x", registry=3, waters=7)]).select(from_proto(F.col("b"), message, fields=("registry", "waters")).alias("m"))
    assert df.select("m.*").first().asDict() == {"registry": 3, "waters": "OCEAN"}
    with pytest.raises(ValueError, match="no field height"):
        from_proto(F.col("b"), message, fields=("height",))


def test_bytes_that_are_no_message_fail(spark):
    with pytest.raises(Exception, match="DecodeError|parsing"):
        spark.createDataFrame([(b"\xff\xff\xff",)], "b binary").select(from_proto(F.col("b"), HARBOR.message("harbor.Vessel"))).collect()


def test_timestamps(spark):
    stamp, both = TIDES.message("tides.Mark"), DEFAULT.with_spark_timestamps()
    fine = stamp()
    fine.seen_at.seconds, fine.seen_at.nanos = 4, 5006
    df = frame(spark, [fine]).select(from_proto(F.col("b"), stamp, both).alias("m"))
    assert df.select("m.seen_at").first()[0] == dt.datetime(1970, 1, 1, 0, 0, 4, 5)
    back = stamp.message_class.FromString(bytes(df.select(to_proto(F.col("m"), stamp, both)).first()[0]))
    assert (back.seen_at.seconds, back.seen_at.nanos) == (4, 5000)
    micros = spark.createDataFrame([(-1,), (0,), (-1_000_000,), (1_500_000,), (None,)], "us long")
    made = micros.select("us", struct_from_timestamp(F.timestamp_micros("us")).alias("t"))
    rows = made.select("us", "t", F.unix_micros(timestamp_from_struct(F.col("t"))).alias("again")).collect()
    assert [r["t"] and tuple(r["t"]) for r in rows] == [(-1, 999_999_000), (0, 0), (-1, 0), (1, 500_000_000), None]
    assert [r["us"] for r in rows] == [r["again"] for r in rows]
    stamps = TIDES.message("tides.Logbook")
    held = stamps()
    held.marks["k"].seen_at.seconds = 9
    held.marks["none"].SetInParent()
    got = frame(spark, [held]).select(from_proto(F.col("b"), stamps, both).alias("m")).select("m.marks").first()[0]
    assert got["k"]["seen_at"] == dt.datetime(1970, 1, 1, 0, 0, 9) and got["none"]["seen_at"] is None


def test_null_tuple(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert [r[0] and tuple(r[0]) for r in df.select(whole_or_null(F.col("n"), F.col("s"), names=("n", "s"))).collect()] == [(1, "a"), None]


def test_datetimes():
    from google.protobuf.timestamp_pb2 import Timestamp

    from tessera.functions.times import datetime_of, timestamp_of

    for moment in (dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(2024, 2, 29, 1, 2, 3, 4)):
        made = timestamp_of(moment)
        assert datetime_of(made) == moment.replace(tzinfo=dt.timezone.utc) and 0 <= made.nanos < 10**9
    assert datetime_of(Timestamp(seconds=1, nanos=1999)).microsecond == 1


def _same(raw, message, fields=None):
    """What numpy reads is what the runtime reads."""
    cls = message.shadow_class
    kind = _arrow_type(message.schema.file_set, message.full_name, fields)
    array = pa.array(raw, pa.binary())
    plain = messages_to_struct([None if b is None else cls.FromString(b) for b in raw], cls, kind)
    as_map = lambda v: dict(sorted(v)) if isinstance(v, list) and v and isinstance(v[0], tuple) else v
    loose = lambda rows: [r and {k: as_map(v) for k, v in r.items()} for r in rows]
    assert repr(loose(struct_of(array, cls.DESCRIPTOR, kind).to_pylist())) == repr(loose(plain.to_pylist()))
    assert repr(loose(struct_from_wire(array.slice(1), cls, kind).to_pylist())) == repr(loose(plain.to_pylist()[1:]))
    if fields is None:
        written = [m and m.SerializeToString(deterministic=True) for m in struct_to_messages(plain, cls)]
        assert [x or None for x in wire_from_struct(plain, cls).to_pylist()] == [x or None for x in written]
        assert [x or None for x in wire_from_struct(plain.slice(1), cls).to_pylist()] == [x or None for x in written[1:]]
        assert [x or None for x in wire_of(plain.slice(2), cls.DESCRIPTOR).to_pylist()] == [x or None for x in written[2:]]


@pytest.mark.parametrize("name", ["all2.Scalars", "all3.Scalars"])
@settings(quick, max_examples=25)
@given(data=st.data())
def test_numpy_reads_scalars_as_the_runtime(name, data):
    message = ALL.message(name)

    def one():
        m = message()
        for k in _KINDS:
            if data.draw(st.booleans()):
                setattr(m, f"o_{k}", data.draw(VALUES[k]))
            getattr(m, f"r_{k}").extend(data.draw(st.lists(VALUES[k], max_size=3)))
            if name == "all2.Scalars":
                setattr(m, f"q_{k}", data.draw(VALUES[k]))
        return m.SerializeToString()

    raw = [one(), None, one(), one() + one(), one()]  # the fourth has fields twice
    _same(raw, message)
    _same(raw, message, ("o_string", "r_sint64", "o_bool"))


def test_numpy_reads_the_rest_as_the_runtime():
    rest, level = ALL.message("all2.Rest"), ALL.message("all2.Level")
    rows = [rest(number=5, text="later"), rest(text="only"), rest(nested=level(c=b"x")), rest(e=-1, es=[1, -1, 2], packed=[4, 5]), rest(levels=[level(c=b"1"), level()]), rest()]
    raw = [m.SerializeToString() for m in rows]
    raw += [raw[1] + raw[0], raw[0] + raw[1], b"\xfa\x3f\x03abc" + raw[3], b"\x18\x04\x18\x05" + raw[4], None, b""]
    _same(raw, rest)
    _same(raw, rest, ("text",))
    maps = ALL.message("all3.Maps")
    some = [maps(by_name={"a": 1, "b": -2}), maps(m_bytes={0: b""}), maps(m_double={1: 2.5}, m_string={3: ""}), maps(m_sint64={-1: -5}, m_bool={2: False}), maps()]
    some[4].m_message[4].SetInParent()
    some[3].m_message[0].below.add(a="q", e=5)
    _same([m.SerializeToString() for m in some], maps)
    kind = _arrow_type(rest.schema.file_set, rest.full_name, None)
    part = rest(level=level(c=b"x")).SerializeToString()
    for odd in (part + part, b"\x0b\x0c", b"\x08", b"\x80" * 11, b"\x12\x05a"):
        with pytest.raises(Odd):
            struct_of(pa.array([odd], pa.binary()), rest.shadow_class.DESCRIPTOR, kind)
    assert struct_from_wire(pa.array([part + rest(level=level(below=[{"a": "y"}])).SerializeToString()]), rest.shadow_class, kind).to_pylist()[0]["level"] == {"c": b"x", "below": [{"a": "y", "e": None}]}
