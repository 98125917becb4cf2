"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a temporary folder takes
    its place if driver and executors are one process, as in tests; on a cluster, a
    folder in the warehouse does, which is shared too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-scratch"
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN_DIR[app]


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; nothing is left to tell
            return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`staged` wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables written after the first ``since``, but for ``kept``; nothing may read them any more."""
    stay = {df.staged_path for df in kept}
    gone = [path for _, path in _WRITTEN[since:] if path not in stay]
    _WRITTEN[since:] = [w for w in _WRITTEN[since:] if w[1] in stay]
    for path in gone:
        remove(spark, path)


def written() -> int:
    """Number of tables that :func:`staged` wrote and that still count, for :func:`forget`."""
    return len(_WRITTEN)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and a table that two later steps use is computed once.  ``df.staged_path``
    of the result is its place, for :func:`remove`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the JVM collects its garbage, which a driver with little to do
    may not for long; between large steps the files of the last would stay.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clash_free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = name
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out.append(free)
    return out


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) that depends on ``parts`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / F.lit(float(1 << 53))
