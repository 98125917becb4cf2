"""The driver's queries, one or more for each operation, and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import whole_or_null
from tessera.functions.times import datetime_of, timestamp_of
from tessera.operators.udfs import proto_udf
from tessera.operators.wire import from_proto, to_proto
from tessera.options import DEFAULT, MessageEncoder
from tessera.plans.schema import as_nullable, schema_for
from tessera.sources.frames import ProtoSQL, default, with_spark_timestamps, write_parquet
from tessera.tables import SHOP

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TIMES = DEFAULT.with_spark_timestamps()


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share; it goes when the driver ends."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared:
        one = master == "local" or master.startswith("local[")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-") if one else spark.conf.get("spark.sql.warehouse.dir") + "/tessera-scratch"
    path = f"{shared.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        return


def _no_items() -> Column:
    return F.array().cast(as_nullable(schema_for(SHOP.message("shop.LineItem"), TIMES)).simpleString().join(["array<", ">"])).alias("items")


def order_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as wire bytes."""
    rows = _table(spark, sf_dir, "orders").select("*", _no_items())
    return with_spark_timestamps.encode(rows, SHOP.message("shop.Order"))


def lineitem_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spark_timestamps.encode(_table(spark, sf_dir, "lineitem"), SHOP.message("shop.LineItem"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = with_spark_timestamps.decode(order_bytes(spark, sf_dir), SHOP.message("shop.Order"), fields=("o_orderstatus", "o_orderpriority"))
    return orders.where(F.col("o_orderstatus") == "F").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")(flagship)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def proto_roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spark_timestamps.decode(order_bytes(spark, sf_dir), SHOP.message("shop.Order")).drop("items")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2")
def proto_roundtrip_lineitem_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spark_timestamps.decode(lineitem_bytes(spark, sf_dir), SHOP.message("shop.LineItem"), fields=("l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("lines"), F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def enum_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spark_timestamps.decode(order_bytes(spark, sf_dir), SHOP.message("shop.Order"), fields=("o_orderstatus", "o_totalprice"))
    return rows.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN '15' END AS state,
    CASE WHEN o_orderstatus = 'P' THEN '15' ELSE 'OPEN' END AS first, '15' AS middle FROM orders""")
def enum_unknown_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed enum: names, and numbers that it doesn't name, written and read back in their places."""
    name = F.expr("CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN '2' WHEN 'P' THEN '15' END")
    first = F.when(F.col("o_orderstatus") == "P", "15").otherwise("OPEN")
    jobs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("state"), F.array(first, F.lit("15"), F.lit("DONE")).alias("history"))
    read = default.decode(default.encode(jobs, SHOP.message("closed.Job")), SHOP.message("closed.Job"))
    return read.select(F.col("id").alias("o_orderkey"), "state", F.get("history", 0).alias("first"), F.get("history", 1).alias("middle"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return t.select(
        "event_id", "ts", "event_type", F.when(kind != "error", F.col("value")).alias("value"), F.from_json("props", "map<string,bigint>").alias("props"),
        F.when(kind == "click", F.col("user_id")).alias("click_user"), F.when(kind == "purchase", F.col("value")).alias("purchase_value"),
        F.when(~kind.isin("click", "purchase"), kind).alias("other"),
    )


def event_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spark_timestamps.encode(_events(spark, sf_dir), SHOP.message("shop.Event"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, CAST((epoch_us(ts) % 1000000) * 1000 AS INTEGER) AS nanos FROM events")
def timestamp_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = default.decode(event_bytes(spark, sf_dir), SHOP.message("shop.Event"), fields=("event_id", "ts"))
    return read.select("event_id", "ts.seconds", "ts.nanos")


@query("SELECT event_id, ts FROM events")
def timestamp_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spark_timestamps.decode(event_bytes(spark, sf_dir), SHOP.message("shop.Event"), fields=("event_id", "ts"))


def embedding_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.nullif("label", F.lit(0)).alias("label"))
    return default.encode(rows, SHOP.message("shop.Embedding"))


@query("SELECT vec_id, nullif(label, 0) AS label FROM embeddings")
def wrapper_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default.decode(embedding_bytes(spark, sf_dir), SHOP.message("shop.Embedding"), fields=("vec_id", "label"))


@query("SELECT vec_id, label <> 0 AS present, nullif(label, 0) AS label FROM embeddings")
def wrapper_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ProtoSQL(DEFAULT.with_retained_primitive_wrappers())
    read = kept.decode(embedding_bytes(spark, sf_dir), SHOP.message("shop.Embedding"), fields=("vec_id", "label"))
    return read.select("vec_id", F.col("label").isNotNull().alias("present"), F.col("label.value").alias("label"))


def order_with_items_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = [f.name for f in schema_for(SHOP.message("shop.LineItem"), TIMES)]
    lines = _table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    items = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(*item)).alias("items"))
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return with_spark_timestamps.encode(orders.join(items, "o_orderkey"), SHOP.message("shop.Order"))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def repeated_items_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer, as a plain explode has Spark ask for the sizes of the arrays too, and so makes all items twice."""
    read = with_spark_timestamps.decode(order_with_items_bytes(spark, sf_dir), SHOP.message("shop.Order"), fields=("items.l_returnflag", "items.l_partkey"))
    return read.select(F.explode_outer("items").alias("i")).where("i IS NOT NULL").groupBy("i.l_returnflag").agg(F.count("*").alias("n"), F.sum("i.l_partkey").alias("parts"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(list_sum([floor(CAST(x AS DOUBLE) * 1000) for x in embedding]) AS BIGINT) AS total FROM embeddings")
def repeated_scalar_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = default.decode(embedding_bytes(spark, sf_dir), SHOP.message("shop.Embedding"), fields=("vec_id", "embedding"))
    total = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 1000))
    return read.select("vec_id", F.size("embedding").alias("n"), total.alias("total"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def map_field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = default.decode(event_bytes(spark, sf_dir), SHOP.message("shop.Event"), fields=("event_id", "props"))
    return read.select("event_id", F.try_element_at("props", F.lit("k")).alias("k"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN user_id END AS click_user, CASE WHEN event_type = 'purchase' THEN value END AS purchase_value,
    CASE WHEN event_type NOT IN ('click', 'purchase') THEN event_type END AS other, CASE WHEN event_type <> 'error' THEN value END AS value FROM events""")
def oneof_event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default.decode(event_bytes(spark, sf_dir), SHOP.message("shop.Event"), fields=("event_id", "click_user", "purchase_value", "other", "value"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey, n_name, n_regionkey, 'type.googleapis.com/shop.Nation' AS type_url FROM nation")
def any_payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, envelope = SHOP.message("shop.Nation"), SHOP.message("shop.Envelope")
    payload = default.to_proto(F.struct("n_nationkey", "n_name", "n_regionkey"), nation)
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.struct(F.lit("type.googleapis.com/shop.Nation").alias("type_url"), payload.alias("value")).alias("action"))
    read = default.decode(default.encode(rows, envelope), envelope)
    return read.select("id", "action.type_url", default.from_proto(F.col("action.value"), nation).alias("n")).select("id", "type_url", "n.*")


def customer_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_k"), F.struct("n_nationkey", "n_name", "n_regionkey").alias("nation"))
    rows = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("_k"))
    return default.encode(rows, SHOP.message("shop.Customer"))


@query("SELECT c_custkey, n_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def nested_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default.decode(customer_bytes(spark, sf_dir), SHOP.message("shop.Customer")).select("c_custkey", "nation.*")


@query("SELECT vec_id, embedding[1] AS first, CAST(NULL AS FLOAT) AS far FROM embeddings")
def array_first_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = default.decode(embedding_bytes(spark, sf_dir), SHOP.message("shop.Embedding"), fields=("vec_id", "embedding"))
    return read.select("vec_id", F.get("embedding", 0).alias("first"), F.get("embedding", 100_000).alias("far"))


@query("SELECT c_custkey, c_name, n_nationkey, n_name, n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey")
def schema_evolution_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with more columns, also inside the struct, and in another order."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_k"), F.struct(F.lit("old").alias("gone"), "n_regionkey", "n_name", "n_nationkey").alias("nation"))
    rows = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("_k")).select("nation", "c_acctbal", "c_mktsegment", "c_name", "c_custkey")
    path = _scratch(spark)
    write_parquet(rows, path)
    return default.read_parquet(spark, path, SHOP.message("shop.Customer")).select("c_custkey", "c_name", "nation.*", "c_acctbal")


@query("SELECT vec_id, CASE WHEN label <> 0 THEN vec_id END AS a, CASE WHEN label <> 0 THEN label END AS b, label <> 0 AS whole FROM embeddings")
def null_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = default.decode(embedding_bytes(spark, sf_dir), SHOP.message("shop.Embedding"), fields=("vec_id", "label"))
    pair = read.select("vec_id", whole_or_null(F.col("vec_id"), F.col("label"), names=("a", "b")).alias("t"))
    return pair.select("vec_id", "t.a", "t.b", F.col("t").isNotNull().alias("whole"))


@query("SELECT doc_id, sha1(text) AS digest, octet_length(encode(text)) AS size FROM documents")
def bytes_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = SHOP.message("shop.Document")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"), "lang")
    read = default.decode(default.encode(rows, message), message, fields=("doc_id", "body"))
    return read.select("doc_id", F.sha1("body").alias("digest"), F.octet_length("body").cast("long").alias("size"))


@query("SELECT o_orderkey AS oOrderkey, o_orderstatus AS oOrderstatus, o_orderpriority AS oOrderpriority FROM orders")
def camel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ProtoSQL(DEFAULT.with_camel_names()).decode(order_bytes(spark, sf_dir), SHOP.message("shop.Order"), fields=("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("""SELECT * FROM (VALUES ('event_id', 'bigint', true), ('ts', 'struct<seconds:bigint,nanos:int>', true), ('event_type', 'string', true), ('value', 'double', true),
    ('props', 'map<string,bigint>', false), ('click_user', 'bigint', true), ('purchase_value', 'double', true), ('other', 'string', true)) AS t(field, type, nullable)""")
def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [(f.name, f.dataType.simpleString(), f.nullable) for f in schema_for(SHOP.message("shop.Event"))]
    return spark.createDataFrame(fields, "field string, type string, nullable boolean")


MONEY = MessageEncoder.from_injection(
    "shop.Money", T.LongType(), lambda m: m["units"] * 100 + m["cents"], lambda c: F.when(c.isNotNull(), F.struct(F.call_function("div", c, F.lit(100)).alias("units"), (c % 100).cast("int").alias("cents")))
)


@query("SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS price FROM orders")
def custom_encoder_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = ProtoSQL(DEFAULT.add_message_encoder(MONEY))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 100).alias("price"))
    return money.decode(money.encode(rows, SHOP.message("shop.Priced")), SHOP.message("shop.Priced"))


@query("""SELECT o_orderkey AS id, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS INTEGER) AS narrow, -o_orderkey AS wide
    FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS u FROM orders)""")
def unsigned_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    signed = F.when(u >= 2147483648, u - 4294967296).otherwise(u).cast("int")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), signed.alias("narrow"), (-F.col("o_orderkey")).alias("wide"))
    return default.decode(default.encode(rows, SHOP.message("shop.Counter")), SHOP.message("shop.Counter"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE CAST(len(embedding) AS INTEGER) END AS n, label FROM embeddings")
def json_schema_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON read with the message's schema: an absent or null array is an empty one."""
    kept = F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))
    path = _scratch(spark)
    _table(spark, sf_dir, "embeddings").select("vec_id", kept.alias("embedding"), "label").write.json(path)
    return default.read_json(spark, path, SHOP.message("shop.Embedding")).select("vec_id", F.size("embedding").alias("n"), "label")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def rdd_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = SHOP.message("shop.Nation")
    raw = default.encode(_table(spark, sf_dir, "nation"), nation).rdd.map(lambda r: bytes(r[0]))
    return default.to_dataframe(raw, nation, spark)


@query("SELECT r_regionkey AS n_nationkey, r_name AS n_name, 7 AS n_regionkey FROM region")
def local_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message objects of the driver; the table of regions has five rows, whatever the scale."""
    nation = SHOP.message("shop.Nation")
    regions = _table(spark, sf_dir, "region").collect()
    return default.create_dataframe(spark, [nation(n_nationkey=r["r_regionkey"], n_name=r["r_name"], n_regionkey=7) for r in regions], nation)


_UDF_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _arity(n: int) -> None:
    names = [_UDF_COLUMNS[i % len(_UDF_COLUMNS)] for i in range(n)]
    call = proto_udf(lambda *xs: sum((i + 1) * x for i, x in enumerate(xs)), "bigint", *["bigint"] * n)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", call(*names).alias("v"))

    run.__name__ = f"udf_arity_{n}"
    total = " + ".join(f"{i + 1} * {c}" for i, c in enumerate(names))
    query(f"SELECT l_orderkey, l_linenumber, CAST({total} AS BIGINT) AS v FROM lineitem")(run)


for _n in range(1, 11):
    _arity(_n)


@query("SELECT c_custkey, upper(n_name) AS n_name, n_regionkey + 1 AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def udf_message_to_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = SHOP.message("shop.Nation")
    raised = proto_udf(lambda n: nation(n_nationkey=n.n_nationkey, n_name=n.n_name.upper(), n_regionkey=n.n_regionkey + 1), nation, nation)
    read = default.decode(customer_bytes(spark, sf_dir), SHOP.message("shop.Customer"))
    return read.select("c_custkey", raised("nation").alias("n")).select("c_custkey", "n.n_name", "n.n_regionkey")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE '4' END AS next FROM orders")
def udf_enum_to_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = SHOP.enum("shop.Order.Status")
    following = proto_udf(lambda n: n + 1, status, status)
    return _table(spark, sf_dir, "orders").select("o_orderkey", following("o_orderstatus").alias("next"))


@query("SELECT n_nationkey, n_name FROM nation")
def udf_bytes_to_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = SHOP.message("shop.Nation")
    parse = proto_udf(lambda b: nation.message_class.FromString(b), nation, "binary")
    return default.encode(_table(spark, sf_dir, "nation"), nation).select(parse("value").alias("n")).select("n.n_nationkey", "n.n_name")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default.decode(customer_bytes(spark, sf_dir), SHOP.message("shop.Customer"))


@query("SELECT c_custkey AS C1, c_name AS C2, n_nationkey AS C1n, n_name AS C2n, c_acctbal AS C4 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def numbered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named by the fields' numbers, written and read."""
    numbered = ProtoSQL(DEFAULT.with_column_naming(lambda fd: f"C{fd.number}"))
    customer = SHOP.message("shop.Customer")
    rows = numbered.decode(customer_bytes(spark, sf_dir), customer)
    again = numbered.decode(numbered.encode(rows, customer), customer)
    return again.select("C1", "C2", F.col("C3.C1").alias("C1n"), F.col("C3.C2").alias("C2n"), "C4")


@query("SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS price FROM orders")
def replaced_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of encoders put in place of another."""
    money = ProtoSQL(DEFAULT.with_spark_timestamps().with_message_encoders([MONEY]))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 100).alias("price"))
    return money.decode(money.encode(rows, SHOP.message("shop.Priced")), SHOP.message("shop.Priced"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_inferred_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON whose schema Spark infers, fitted to the message by name."""
    path = _scratch(spark)
    _table(spark, sf_dir, "nation").select("n_regionkey", F.lit("more").alias("extra"), "n_name", "n_nationkey").write.json(path)
    return default.as_message(spark.read.json(path), SHOP.message("shop.Nation"))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def parquet_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    rows = _customers(spark, sf_dir)
    write_parquet(rows, path)
    write_parquet(rows.where("c_acctbal > 0"), path, "overwrite")
    return default.read_parquet(spark, path, SHOP.message("shop.Customer")).select("c_custkey", "c_name", "nation.n_name")


@query("SELECT c_custkey, lower(n_name) AS n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def saved_after_message_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that a user function made of messages, saved twice in the session's own format and loaded."""
    nation = SHOP.message("shop.Nation")
    lowered = proto_udf(lambda n: nation(n_nationkey=n.n_nationkey, n_name=n.n_name.lower(), n_regionkey=n.n_regionkey), nation, nation)
    path = _scratch(spark)
    rows = _customers(spark, sf_dir).withColumn("lowered", lowered("nation"))
    for _ in range(2):
        rows.write.mode("overwrite").save(path)
    return spark.read.load(path).select("c_custkey", "lowered.n_name", "lowered.n_regionkey")


@query("SELECT n_nationkey, n_name || ': ' || n_regionkey AS line FROM nation")
def collected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the driver collects as messages; the table of nations has 25, whatever the scale."""
    nation = SHOP.message("shop.Nation")
    read = default.decode(default.encode(_table(spark, sf_dir, "nation"), nation), nation)
    lines = [(m.n_nationkey, f"{m.n_name}: {m.n_regionkey}") for m in default.collect_messages(read, nation)]
    return spark.createDataFrame(lines, "n_nationkey int, line string")


@query("SELECT event_id, ts + INTERVAL 90 MINUTE AS later FROM events")
def datetime_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamp messages as datetimes inside a user function."""
    event = SHOP.message("shop.Event")

    def later(e):
        out = event(event_id=e.event_id)
        out.ts.CopyFrom(timestamp_of(datetime_of(e.ts) + timedelta(minutes=90), type(out.ts)))
        return out

    read = with_spark_timestamps.decode(event_bytes(spark, sf_dir), event)
    moved = read.select(with_spark_timestamps.udf(later, event, event)(F.struct("*")).alias("e"))
    return moved.select("e.event_id", F.col("e.ts").alias("later"))


_MIXED = [("nation", "n_nationkey"), ("c_custkey", "c_custkey"), ("raw", "octet_length(encode(c_name))"), ("status", "2"), ("n_name", "length(n_name)")]


def _mixed(n: int) -> None:
    names = [_MIXED[i % len(_MIXED)][0] for i in range(n)]
    kinds = {"nation": SHOP.message("shop.Nation"), "c_custkey": "bigint", "raw": "binary", "status": SHOP.enum("shop.Order.Status"), "n_name": "string"}
    plain = lambda x: x if isinstance(x, int) else len(x) if isinstance(x, (bytes, str)) else x.n_nationkey
    call = proto_udf(lambda *xs: sum((i + 1) * plain(x) for i, x in enumerate(xs)), "bigint", *(kinds[c] for c in names))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _customers(spark, sf_dir).select("c_custkey", "nation", "nation.n_name", F.encode("c_name", "UTF-8").alias("raw"), F.lit("O").alias("status"))
        return rows.select("c_custkey", call(*names).alias("v"))

    run.__name__ = f"udf_mixed_{n}"
    total = " + ".join(f"{i + 1} * {_MIXED[i % len(_MIXED)][1]}" for i in range(n))
    query(f"SELECT c_custkey, CAST({total} AS BIGINT) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey")(run)


for _n in range(2, 11):
    _mixed(_n)


__all__ = ["ORACLE", "QUERIES", "flagship", "from_proto", "to_proto"]
