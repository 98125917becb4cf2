"""Best-two-fit packing of tokenized documents into fixed-length sequences.

How a bin is filled depends on lengths alone, and there are at most ``capacity``
lengths.  So the packing is planned over the table of lengths and their counts
(bounded by the capacity, whatever the corpus): a bin is filled greedily, its
smallest document gives way to two that fill the widened gap more tightly, and
the bin repeats until one of its lengths runs out.  Documents then take the
planned places by their rank within their length, found in two distributed steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import staged, table
from tessera.llm.wordids import WordIds

CAPACITY = 2048
SEPARATOR = 0
#: Ranks are counted within buckets of about so many pieces.
BUCKET_ROWS = 256
_TEXTS = 256

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Each document's ids and a separator, cut only where longer than ``capacity``.

    A null or empty text gives one piece of the separator alone.  Rows count one
    by one, repeated or not; a null doc_id stays null.  ``with_ids`` adds
    ``ids`` (array of int), what a sequence is written from.
    """
    schema = T.StructType(PIECES.fields + ([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []))
    end = np.array([separator], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer_path)
        for whole in batches:
            for k in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(k, _TEXTS)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for doc_id, raw in zip(batch.column(0).to_pylist(), words.batch([t or b"" for t in texts]), strict=True):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        doc.append(doc_id)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, dtype="<i4"))
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-two-fit over lengths and their counts: (lengths of a bin, times it repeats).

    The same bins as filling one at a time would give: a bin's choices depend on
    which lengths are left, and these stay the same until one of the bin's own
    lengths has too few left for another such bin.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[list[int], int]] = []

    def largest(most: int) -> int:
        there = np.flatnonzero(left[: most + 1])
        return int(there[-1]) if len(there) else 0

    while n := largest(capacity):
        content, gap = [], capacity
        while n:
            content.append(n)
            left[n] -= 1
            gap -= n
            n = largest(gap) if gap else 0
        if gap:  # the smallest gives way to two that together fill more
            small = content[-1]
            room = gap + small
            there = np.flatnonzero(left[: room + 1])
            partner = np.searchsorted(there, room - there, side="right") - 1
            fits = (partner >= 0) & (there + there[partner] > small) & ((there[partner] != there) | (left[there] > 1))
            if fits.any():
                total = np.where(fits, there + there[partner], 0)
                k = int(total.argmax())
                left[small] += 1
                content[-1:] = sorted((int(there[k]), int(there[partner[k]])), reverse=True)
                for n in content[-2:]:
                    left[n] -= 1
        kinds, each = np.unique(content, return_counts=True)
        again = int((left[kinds] // each).min())
        left[kinds] -= each * again
        out.append((content, again + 1))
    return out


def places(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, times, first sequence, offset) of each place in the plan."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for content, times in plan:
        offset = 0
        for n in content:
            out.append((n, taken.get(n, 0), times, sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must be a table, as it is read twice.

    Only the counts of lengths (at most ``capacity``) come to the driver, and only
    the planned places, whose number depends on lengths and not on rows, go back.  A rank
    is the rows in earlier buckets of its length and the place in its own bucket.
    ``order`` names columns that settle ranks, so that reruns agree; rows alike in
    all of them are alike.  A table without rows gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    made = places(plan_bins(counts, capacity))
    buckets = F.array(*(F.lit(1 + counts.get(n, 0) // BUCKET_ROWS) for n in range(capacity + 1)))
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.get(buckets, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = bucketed.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = bucketed.withColumn("_rank", rank).join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    schema = T.StructType(ranked.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_lookup(made), schema).select(*pieces.columns, "sequence_id", "offset")


def _lookup(made: list[tuple[int, int, int, int, int]]):
    """The function that turns a length and a rank within it into a place."""
    big = 1 << 44
    spots = np.array(sorted((n * big + first, first, sequence, offset) for n, first, _, sequence, offset in made), dtype=np.int64)

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
            spot = spots[np.searchsorted(spots[:, 0], length * big + rank, side="right") - 1]
            columns = [*batch.columns, pa.array(spot[:, 2] + rank - spot[:, 1]), pa.array(spot[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    return where


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of a packing whose pieces carry ``ids``: sequence_id, ids, n_pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), F.count("*").alias("n_pieces"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
