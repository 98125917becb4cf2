"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

Each table rotates a vector pseudo-randomly (signs, Hadamard transform, thrice) and
takes its nearest signed axes, two rotations to a bucket.  A vector is at home in one
bucket and probes three more, where its second-nearest axes lead.  Pairs that meet
are verified in double precision, and a pair counts only where it meets first, so
links are counted exactly though it meets in several tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import shuffle_width, staged, table
from tessera.llm.components import Forest, connected_components

LEAST_COSINE = 0.93
#: Members of a bucket's block; a larger bucket is cut into blocks of about so many, however many these are.
BLOCK_ROWS = 256
#: Bytes of vectors that a task reads, about.
TASK_BYTES = 16_000_000
_SMALL = 48


def tables_for(dim: int) -> int:
    """Tables that find more than 99.5 % of pairs at LEAST_COSINE: more for longer vectors, whose buckets are finer."""
    return 8 + 2 * max(0, (max(1, dim) - 1).bit_length() - 7)


@lru_cache(maxsize=16)
def _signs(dim: int, tables: int, seed: int) -> np.ndarray:
    wide = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), size=(tables, 2, 3, wide))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Walsh-Hadamard matrix, scaled to keep lengths."""
    n, wide = x.shape
    h = 1
    while h < wide:
        y = x.reshape(n, wide // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, wide)
        h *= 2
    return x / np.sqrt(wide)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bucket_codes(x: np.ndarray, tables: int | None, seed: int) -> np.ndarray:
    """Of unit vectors: (vectors, tables, 4), the home bucket first, then those probed."""
    tables = tables or tables_for(x.shape[1])
    signs = _signs(x.shape[1], tables, seed)
    wide = signs.shape[-1]
    padded = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    out = np.empty((len(x), tables, 4), dtype=np.int64)
    for t in range(tables):
        near = []
        for s in signs[t]:
            y = padded
            for flips in s:
                y = hadamard(y * flips)
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(np.abs(y), two, axis=1)
            two = np.where((size[:, :1] >= size[:, 1:]), two, two[:, ::-1])
            near.append(2 * two + (np.take_along_axis(y, two, axis=1) > 0))
        for n, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            out[:, t, n] = near[0][:, a] * 2 * wide + near[1][:, b]
    return out


def comparable(embedding: Column, label: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _coded(classes: DataFrame, tables: int | None, seed: int) -> DataFrame:
    """(sig, label, dim, table, bucket, home) of every class: its home bucket and three probed ones in each table."""
    schema = T.StructType([T.StructField(n, k) for n, k in (("sig", T.LongType()), ("label", T.LongType()), ("dim", T.IntegerType()), ("table", T.IntegerType()), ("bucket", T.LongType()), ("home", T.BooleanType()))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                rows = batch.column(2).to_pylist()
                dims = np.array([len(r) for r in rows])
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    codes = bucket_codes(unit(np.array([rows[i] for i in at], dtype=np.float64)), tables, seed)
                    n = codes.shape[1]
                    every = pa.array(np.repeat(at, 4 * n))
                    columns = [batch.column(0).take(every), batch.column(1).take(every), pa.array(np.full(len(every), dim, np.int32)), pa.array(np.tile(np.repeat(np.arange(n, dtype=np.int32), 4), len(at)))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(codes.reshape(-1)), pa.array(np.tile(np.arange(4) == 0, n * len(at)))], names=schema.names)

    return classes.select("sig", "label", "embedding").mapInArrow(coded, schema)


def _packed(classes: DataFrame, wire: str) -> DataFrame:
    """(sig, copies, vector) of every class, the vector as bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, dtype=wire).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["sig", "copies", "vector"])

    return classes.select("sig", "copies", "embedding").mapInArrow(packed, "sig long, copies long, vector binary")


def _candidate_pairs(group: np.ndarray, home: np.ndarray, cross: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, one of them at home, that may reach ``least``; ``group`` is sorted.

    Where ``cross`` is not negative, only rows that differ in it pair up.
    """
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    size = np.diff(cuts)
    small = np.repeat(size <= _SMALL, size)
    for d in range(1, _SMALL):
        a = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(group) > d else np.zeros(0, int)
        if not len(a):
            break
        b = a + d
        keep = (home[a] | home[b]) & ((cross[a] < 0) | (cross[a] != cross[b]))
        for k in range(0, int(keep.sum()), 100_000):
            yield a[keep][k : k + 100_000], b[keep][k : k + 100_000]
    for lo, n in zip(cuts[:-1][size > _SMALL], size[size > _SMALL], strict=True):
        for i in range(lo, lo + n, 1024):
            for j in range(i, lo + n, 1024):
                ri, rj = slice(i, min(i + 1024, lo + n)), slice(j, min(j + 1024, lo + n))
                a, b = np.nonzero(x[ri] @ x[rj].T >= least - 1e-9)
                a, b = a + i, b + j
                keep = (a < b) & (home[a] | home[b]) & ((cross[a] < 0) | (cross[a] != cross[b]))
                yield a[keep], b[keep]


def linked(classes: DataFrame, least: float = LEAST_COSINE, tables: int | None = None, seed: int = 10, wire: str = "<f8") -> DataFrame:
    """(sig, to, n): partial counts of linked vectors, and links enough to connect all that are linked.

    ``classes``: label (long), sig, copies, embedding.  Vectors are hashed once; codes
    alone tell which buckets hold a pair, one of it at home, and only to these do
    vectors go.  A bucket with many members is cut into blocks, and every pair of its
    blocks is compared in some task.
    """
    spark = classes.sparkSession
    key = ["label", "dim", "table", "bucket"]
    codes = staged(_coded(classes, tables, seed), "codes")
    counted = codes.groupBy(*key).agg(F.count("*").alias("_m"), F.max("home").alias("_home")).where((F.col("_m") > 1) & F.col("_home"))
    counted = counted.select(*key, F.ceil(F.col("_m") / BLOCK_ROWS).cast("int").alias("_k"))
    rows = codes.join(counted, key)
    rows = rows.withColumn("_i", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("_k")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = rows.withColumn("i", F.least("_i", "_j")).withColumn("j", F.greatest("_i", "_j")).withColumn("cross", F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("_i")))
    rows = staged(rows.drop("_k", "_i", "_j"), "met")
    size = rows.agg(F.sum(F.col("dim").cast("long") * int(wire[-1]))).first()[0] or 0
    tasks = max(4 * shuffle_width(spark), size // TASK_BYTES)
    rows = rows.join(_packed(classes, wire), "sig").withColumn("task", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(tasks)))

    def compared(part: pa.Table) -> pa.Table:
        columns = [part.column(c).to_numpy().astype(np.int64) for c in (*key, "i", "j")]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        group = np.cumsum(np.concatenate(([0], np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))))
        home, cross, sig, copies = (part.column(c).to_numpy()[order] for c in ("home", "cross", "sig", "copies"))
        cross = cross.astype(np.int64)
        raw = part.column("vector").to_pylist()
        got_a, got_b, out_sig, out_to, out_n = [], [], [], [], []
        for dim in np.unique(columns[1]):
            rows_of = np.flatnonzero(columns[1] == dim)
            lo, hi = int(rows_of[0]), int(rows_of[-1]) + 1
            if not (columns[1][lo:hi] == dim).all():  # labels come first in the order
                runs = np.split(rows_of, np.flatnonzero(np.diff(rows_of) > 1) + 1)
            else:
                runs = [rows_of]
            for run in runs:
                lo, hi = int(run[0]), int(run[-1]) + 1
                x = unit(np.frombuffer(b"".join([raw[i] for i in order[lo:hi]]), dtype=wire).reshape(hi - lo, dim).astype(np.float64))
                found_a, found_b = [], []
                for a, b in _candidate_pairs(group[lo:hi], home[lo:hi], cross[lo:hi], x, least):
                    close = np.einsum("ij,ij->i", x[a], x[b]) >= least
                    found_a.append(a[close])
                    found_b.append(b[close])
                a, b = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_a, found_b))
                if not len(a):
                    continue
                who = np.unique(np.concatenate((a, b)))
                codes = bucket_codes(x[who], tables, seed)
                pa_, pb_ = np.searchsorted(who, a), np.searchsorted(who, b)
                for k in range(0, len(a), 50_000):
                    ca, cb = codes[pa_[k : k + 50_000]], codes[pb_[k : k + 50_000]]
                    ia, ib = a[k : k + 50_000] + lo, b[k : k + 50_000] + lo
                    a_home, b_home = (ca[:, :, :1] == cb).any(axis=2), (cb[:, :, :1] == ca).any(axis=2)
                    meet = a_home | b_home
                    here = columns[2][ia]
                    every = np.arange(len(ia))
                    # of two buckets of the table where they meet first, it is the home of the smaller that counts
                    a_small = sig[ia] < sig[ib]
                    both = a_home[every, here] & b_home[every, here]
                    home_a, home_b = ca[every, here, 0], cb[every, here, 0]
                    at = np.where(both, np.where(a_small, home_a, home_b), np.where(a_home[every, here], home_a, home_b))
                    first = (meet.argmax(axis=1) == here) & (at == columns[3][ia])
                    got_a.append(ia[first])
                    got_b.append(ib[first])
        if got_a:
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            ids, ends = np.unique(np.concatenate((sig[a], sig[b])), return_inverse=True)
            ea, eb = ends[: len(a)], ends[len(a) :]
            n = np.zeros(len(ids), dtype=np.int64)
            np.add.at(n, ea, copies[b])
            np.add.at(n, eb, copies[a])
            forest = Forest(len(ids))
            for i, j in np.unique(np.stack((ea, eb), axis=1), axis=0).tolist():
                forest.join(i, j)
            out_sig, out_n, out_to = ids, n, ids[[forest.root(i) for i in range(len(ids))]]
        return pa.table({"sig": pa.array(out_sig, pa.int64()), "to": pa.array(out_to, pa.int64()), "n": pa.array(out_n, pa.int64())})

    return rows.groupBy("task").applyInArrow(compared, "sig long, to long, n long")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, tables: int | None = None, seed: int = 10) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors of one label (of any type; labels are told apart by a 64-bit hash) and
    length link at a cosine of ``least`` or more.  A null label or vector, one of
    zeros, and one with null or non-finite components link with nothing.  Equal
    vectors are one class, compared once and counted as often as they occur.  Of pairs
    at 0.93, ``tables_for`` misses less than 1 in 200, of closer ones fewer; ``tables``
    sets another number.  Extra columns are left out; no rows give no rows.
    """
    kind = vectors.schema["embedding"].dataType
    wire = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    label = F.col("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(label.isNotNull(), F.xxhash64(label)).alias("label"), "embedding")
    rows = rows.withColumn("ok", comparable(F.col("embedding"), F.col("label")))
    rows = rows.withColumn("sig", F.when(F.col("ok"), F.xxhash64("label", "embedding")))
    classes = rows.where("ok").groupBy("sig").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = staged(classes, "vectors")
    links = staged(linked(classes, least, tables, seed, wire), "links")
    roots = connected_components(links.select(F.col("sig").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("sig").agg(F.sum("n").alias("n"))
    per = classes.select("sig", "copies", "first_id").join(counts, "sig", "left").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    per = staged(per.select("sig", "first_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "sig").alias("root")), "counted")
    least_id = per.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = per.join(least_id, "root").select(F.col("sig").alias("_sig"), "n_links", "component_id")
    out = rows.select("vec_id", "sig").join(final, F.col("sig") == F.col("_sig"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
