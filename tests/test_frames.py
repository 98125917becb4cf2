from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import udfs, wire
from tessera.operators.udfs import proto_udf
from tessera.options import DEFAULT
from tessera.queries import repeated_items_explode
from tessera.sources import frames
from tessera.sources.frames import ProtoSQL, default, parquet_safe, write_parquet
from tessera.streaming.streams import decode_stream, encode_stream
from tessera.tables import SHOP
from tests.protos import CARGO, HARBOR, TIDES

VESSEL = HARBOR.message("harbor.Vessel")


def tug():
    v = VESSEL(callsign="TUG 9", registry=4711, waters=3, seal=b"\x10\x00\xfe", tanks=[7, 2**32 - 1])
    v.calls.add(mooring="north quay", depth=6.5)
    v.engine.fuel = 2
    return v


def test_create_filter_and_collect(spark):
    df = default.create_dataframe(spark, [tug(), VESSEL(callsign="FERRY", registry=8, waters=7)], VESSEL)
    assert df.where(F.col("registry") > 100).count() == 1 and df.where(F.col("waters") == "OCEAN").count() == 1
    assert df.select(F.sha1("seal"), F.get("calls", 0)["mooring"], F.get("calls", 5)).first()[1:] == ("north quay", None)
    assert default.collect_messages(df, VESSEL)[0] == tug()
    assert default.create_dataframe(spark, [], VESSEL).count() == 0


def test_rdd(spark):
    raw = spark.sparkContext.parallelize([tug().SerializeToString()] * 3, 2)
    assert frames.to_dataframe(raw, VESSEL, spark).select("callsign").distinct().first()[0] == "TUG 9"


def test_as_message_goes_by_name(spark):
    kind = "season int, crates array<struct<label:string,stamp:struct<by:string,code:string>,insured:boolean,weight:int>>"
    wide = spark.createDataFrame([(1, [("tea", ("office", "Q7"), True, 40)]), (2, None)], kind)
    manifest = CARGO.message("cargo.Manifest")
    full, none = default.as_message(wide, manifest).collect()
    assert full.asDict(recursive=True) == {"crates": [{"weight": 40, "stamp": {"code": "Q7"}, "label": "tea"}]} and none["crates"] == []
    with pytest.raises(ValueError, match="crates"):
        default.as_message(spark.range(1), manifest)
    with pytest.raises(ValueError, match="crates.label"):
        default.as_message(wide.selectExpr("transform(crates, c -> named_struct('weight', c.weight, 'stamp', c.stamp)) crates"), manifest)


def test_parquet_and_empty_structs(spark, tmp_path):
    df = default.create_dataframe(spark, [tug()], VESSEL)
    write_parquet(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert "ballast" not in back.columns and back.select("calls").first()[0][0]["depth"] == 6.5
    assert parquet_safe(df.schema).fieldNames() == back.columns
    assert default.collect_messages(back.withColumn("ballast", F.lit(None).cast(df.schema["ballast"].dataType)), VESSEL) == [tug()]


def test_json_null_repeated(spark, tmp_path):
    rows = [{"flags": ["blue", "peter"]}, {"flags": []}, {"flags": None}, {}]
    (tmp_path / "x.json").write_text("\n".join(json.dumps(r | {"registry": i}) for i, r in enumerate(rows)))
    got = default.read_json(spark, str(tmp_path), VESSEL).orderBy("registry")
    assert [r["flags"] for r in got.collect()] == [["blue", "peter"], [], [], []]


def test_udfs(spark):
    df = default.create_dataframe(spark, [tug(), None], VESSEL).select(F.struct("*").alias("v"))
    renamed = proto_udf(lambda v, n: None if v is None else VESSEL(callsign=v.callsign, registry=v.registry + n), VESSEL, VESSEL, "int")
    assert [r[0] for r in df.select(renamed("v", F.lit(1)).alias("w")).select("w.registry").collect()][0] == 4712
    other = proto_udf(lambda w: None if w is None else 10 - w, HARBOR.enum("harbor.Waters"), HARBOR.enum("harbor.Waters"))
    waters = spark.createDataFrame([("COASTAL",), ("OCEAN",), (None,)], "w string")
    assert [r[0] for r in waters.select(other("w")).collect()] == ["OCEAN", "COASTAL", None]
    parcel = HARBOR.message("harbor.Parcel")
    parse = proto_udf(lambda b: parcel.message_class.FromString(b), parcel, "binary")
    raw = parcel(stamp=b"\x00", weight=12).SerializeToString()
    assert tuple(spark.createDataFrame([(raw,)], "b binary").select(parse("b").alias("p")).select("p.*").first()) == (12, b"\x00")
    with pytest.raises(ValueError):
        proto_udf(lambda: 1, "int")
    with pytest.raises(ValueError):
        proto_udf(lambda *x: 1, "int", *["int"] * 11)
    with pytest.raises(TypeError):
        other("w", "w")


def test_instances(spark):
    message = TIDES.message("tides.Reading")
    m = message(counts=[{"value": 4}], alarms=[{"value": True}])
    m.water_height.value = 1.5
    camel = ProtoSQL(DEFAULT.with_camel_names()).create_dataframe(spark, [m, message()], message)
    assert camel.columns[0] == "waterHeight" and [tuple(r) for r in camel.collect()] == [(1.5, None, [4], [True]), (None, None, [], [])]
    kept = frames.with_retained_primitive_wrappers.create_dataframe(spark, [m], message)
    assert kept.select("water_height.value", F.get("counts", 0)["value"]).first()[:] == (1.5, 4)
    assert frames.with_retained_primitive_wrappers.collect_messages(kept, message) == [m]
    with pytest.warns(DeprecationWarning):
        assert frames.with_primitive_wrappers().options == DEFAULT


def test_shown(spark, capsys):
    df = default.create_dataframe(spark, [tug()], VESSEL).select("callsign", "waters")
    df.show()
    df.printSchema()
    out = capsys.readouterr().out
    assert "TUG 9" in out and "COASTAL" in out and "|-- waters: string" in out


def test_outer_columns_stay_beside_a_message(spark):
    df = default.create_dataframe(spark, [tug()], VESSEL).select(F.struct("*").alias("v"), F.lit("dock").alias("place"))
    assert df.select("v.*", "place").first()["callsign"] == "TUG 9"


def _run(frame, name):
    frame.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(60)
    return frame.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, VESSEL(callsign=f"v{i}", registry=i).SerializeToString()) for i in range(10)], "k int, value binary")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(r["k"] for r in _run(decode_stream(stream, VESSEL).where("registry >= 5").drop("ballast"), "vessels_out")) == [5, 6, 7, 8, 9]
    again = encode_stream(decode_stream(stream, VESSEL).drop("k"), VESSEL)
    assert sorted(bytes(r[0]) for r in _run(again, "bytes_out")) == sorted(bytes(r["value"]) for r in rows.collect())


def test_streams_of_scalars(spark, tmp_path):
    from google.protobuf import wrappers_pb2

    from tessera.plans.descriptors import ProtoSchema

    whole = ProtoSchema.from_modules(wrappers_pb2).message("google.protobuf.Int64Value")
    rows = spark.createDataFrame([(i, whole(value=10 * i).SerializeToString()) for i in range(3)], "k int, value binary")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, _run(decode_stream(stream, whole), "scalars_out"))) == [(0, 0), (1, 10), (2, 20)]


def test_messages_are_read_once(spark, tmp_path):
    """Neither a filter nor a generator on what was decoded has the bytes read again."""
    df = default.decode(spark.createDataFrame([(tug().SerializeToString(),)], "value binary"), VESSEL)
    for read in (df.where("registry > 2").select("callsign"), df.select(F.explode("calls").alias("c")), df.where("callsign = 'x'").groupBy("registry").count()):
        assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_repeated_items_are_read_and_named_once(spark, sf_dir):
    plan = repeated_items_explode(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "size(" not in plan


def test_frames_that_fit_are_not_rebuilt(spark):
    df = default.create_dataframe(spark, [tug()], VESSEL)
    kind = df.schema["calls"].dataType
    whole = df.drop("calls").crossJoin(spark.range(1).select(F.array(F.from_json(F.lit('{"mooring":"m"}'), kind.elementType)).alias("calls")))
    for rows in (df, whole):
        again = default.as_message(rows.withColumn("more", F.lit(1)), VESSEL)
        assert again.columns == df.columns and again.schema["calls"].dataType == kind
        assert again.collect() == rows.select(*df.columns).collect()
        assert "transform(" not in again._jdf.queryExecution().optimizedPlan().toString()


def test_chosen_fields_of_inner_messages(spark):
    order = SHOP.message("shop.Order")
    df = spark.createDataFrame([(order(o_orderkey=1, items=[{"l_partkey": 5, "l_returnflag": 9, "l_quantity": 2.0}, {}]).SerializeToString(),), (order().SerializeToString(),), (None,)], "value binary")
    got = default.decode(df, order, fields=("items.l_partkey", "items.l_returnflag", "o_orderkey", "items.l_shipdate.nanos"))
    assert [r.asDict(True) for r in got.collect()] == [
        {"o_orderkey": 1, "items": [{"l_partkey": 5, "l_returnflag": "9", "l_shipdate": None}, {"l_partkey": 0, "l_returnflag": "UNKNOWN_FLAG", "l_shipdate": None}]},
        {"o_orderkey": 0, "items": []},
        {"o_orderkey": None, "items": None},
    ]
    for wrong in ("items.gone", "o_orderkey.x", "gone.x"):
        with pytest.raises(ValueError, match="has no field"):
            default.decode(df, order, fields=(wrong,))
    with pytest.raises(ValueError, match="one column"):
        ProtoSQL(DEFAULT.with_spark_timestamps()).decode(df, order, fields=("items.l_shipdate.nanos",))


def test_messages_of_user_functions_pass_as_whole_batches(monkeypatch):
    """As wire bytes that numpy reads and writes, not field by field in Python."""

    def slow(*_):
        raise AssertionError("row by row")

    (kind, write), read = udfs._from_python(VESSEL), udfs._to_python(VESSEL)
    messages = [tug(), None, VESSEL()]
    plain = wire.messages_to_struct([m and VESSEL.shadow_class.FromString(m.SerializeToString()) for m in messages], VESSEL.shadow_class, to_arrow_type(kind))
    for name in ("struct_to_messages", "messages_to_struct"):
        monkeypatch.setattr(wire, name, slow)
    structs = write(messages)
    assert structs.to_pylist() == plain.to_pylist()
    assert read(structs) == messages
    assert read(structs.slice(1)) == messages[1:]
