"""Toxicity scores from a factorization machine over hashed terms.

Terms are byte 5-grams of the lower-cased text in which all that is not a letter
or digit became one space, so they hold short words whole and the starts, middles
and ends of longer ones.  Of their hashes, those that tell the labels apart are
kept, be it in all rows or only in rows that hold another such term; the machine
weighs each and, by products of factors, each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import staged, table

HASH_BITS = 20
FACTORS = 8
#: Terms of the machine, by how well each alone tells the labels apart.
TERMS = 1024
#: Standard deviations that a term's rates under the two labels must differ by.
LEAST_Z = 3.3
#: Terms that tell the labels apart only beside an anchor, at most, and the standard deviations they must differ by there.
PAIR_TERMS = 256
PAIR_Z = 4.5
#: Anchors: the strongest terms that seldom occur in the same rows, with enough rows of either label.
ANCHORS = 8
ANCHOR_ROWS = 10
#: Labelled rows that a model is fitted on, at most, taken in the order of a hash of doc_id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
_BLOCK = 1 << 17  # bytes of text that are hashed at once
_SPACE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def _normal(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").lower().encode().translate(_SPACE).split()) + b"     "


def _term_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    gram = b[:-4]
    for i in range(1, 5):
        gram = (gram << np.uint64(8)) | b[i : len(b) - 4 + i]
    return (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def document_terms(texts: list[str | None], keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its distinct terms), in order, of whole texts.

    ``keep`` turns a hash into a term's number, or -1 to leave it out.  Short texts
    are hashed together, long ones in overlapping blocks.
    """
    group: list[bytes] = []
    first = size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        if not group:
            return
        h = _term_hashes(b"".join(group) + b"    ")
        sizes = np.array([len(g) for g in group])
        owner = np.repeat(np.arange(len(group), dtype=np.int64), sizes)
        inside = np.ones(len(h), dtype=bool)  # not those that reach into the next text
        inside[(np.cumsum(sizes)[:, None] - np.arange(1, 5)).reshape(-1)] = False
        h, owner = h[inside], owner[inside]
        if keep is not None:
            h = keep[h]
            there = np.flatnonzero(h >= 0)
            h, owner = h[there], owner[there]
        pairs = np.unique(owner << 32 | h)
        cuts = np.searchsorted(pairs, np.arange(len(group) + 1, dtype=np.int64) << 32)
        for i in range(len(group)):
            yield first + i, (pairs[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF).astype(np.int32)

    for n, text in enumerate(texts):
        raw = _normal(text)
        if len(raw) > _BLOCK:
            yield from flush()
            seen = []
            for at in range(0, len(raw) - 4, _BLOCK):
                h = _term_hashes(raw[at : at + _BLOCK + 4])
                h = np.unique(h if keep is None else keep[h])
                seen.append(h[h >= 0])
            yield n, np.unique(np.concatenate(seen))
            group, first, size = [], n + 1, 0
            continue
        group.append(raw)
        size += len(raw)
        if size > _BLOCK:
            yield from flush()
            group, first, size = [], n + 1, 0
    yield from flush()


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs of <v_i, v_j>) over a text's terms."""

    slots: np.ndarray  # by hash: the term's number, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        v = self.factors[terms]
        s = v.sum(axis=0)
        z = self.bias + self.weights[terms].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, steps: int = 2400, rate: float = 0.1, decay: float = 2e-4, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """About ``steps`` of AdaGrad on the log loss; ``x`` is 0/1 of rows by terms."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    prior = (y.sum() + 1) / (n + 2)
    b, w, v = float(np.log(prior / (1 - prior))), np.zeros(d), rng.normal(0, 0.02, (d, factors))
    gb, gw, gv = 1e-6, np.full(d, 1e-6), np.full((d, factors), 1e-6)
    for _ in range(max(1, -(-steps // -(-n // 256)))):
        order = rng.permutation(n)
        for k in range(0, n, 256):
            rows = order[k : k + 256]
            xb = x[rows].astype(np.float64)
            s = xb @ v
            z = b + xb @ w + 0.5 * ((s * s).sum(1) - xb @ (v * v).sum(1))
            e = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[rows]) / len(rows)
            dw = xb.T @ e + decay * w
            dv = xb.T @ (e[:, None] * s) - (xb.T @ e)[:, None] * v + decay * v
            gw += dw * dw
            gv += dv * dv
            gb += e.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.2 * rate * dv / np.sqrt(gv)
            b -= rate * e.sum() / np.sqrt(gb)
    return b, w, v


def _difference(n0: Column | int, n1: Column | int) -> tuple[Column, Column]:
    """(share of rows with a term, standard deviations between its rates under the labels) of columns n0, n1 out of ``n0``, ``n1`` rows."""
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    p = (a + b) / (n0 + n1 + 1)
    return p, F.abs(F.try_divide(a / (n1 + 0.5) - b / (n0 + 0.5), F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))))


def _anchors(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Columns of ``x``, the strongest first, that share at most half of their rows with any before them."""
    chosen: list[int] = []
    for j in range(x.shape[1]):
        rows = x[:, j].astype(bool)
        if min(np.count_nonzero(rows & (y == c)) for c in (0, 1)) < ANCHOR_ROWS:
            continue
        if all(2 * np.count_nonzero(rows & (x[:, k] > 0)) <= np.count_nonzero(rows | (x[:, k] > 0)) for k in chosen):
            chosen.append(j)
        if len(chosen) == ANCHORS:
            break
    return chosen


def _beside(rows: DataFrame, anchors: list[tuple[int, int, int]], slots: np.ndarray, limit: int) -> list[int]:
    """Terms without a slot that tell the labels apart among the rows of an anchor (hash, its rows of label 0 and of 1)."""
    number = np.full(1 << HASH_BITS, -1, dtype=np.int8)
    number[[h for h, _, _ in anchors]] = np.arange(len(anchors))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in _slices(batches):
            y = batch.column(0).to_numpy()
            for i, found in document_terms(batch.column(1).to_pylist()):
                at = number[found]
                at = at[at >= 0].astype(np.int64)
                if len(at):
                    new = found[slots[found] < 0].astype(np.int64)
                    held.append(((at[:, None] << HASH_BITS | new) << 1 | int(y[i])).reshape(-1))
            if sum(map(len, held)) > 1 << 19:
                yield told()
        if held:
            yield told()

    key = F.col("key")
    per = (
        rows.mapInArrow(counted, "key long, n long")
        .groupBy(F.shiftright(key, HASH_BITS + 1).cast("int").alias("anchor"), F.shiftright(key, 1).bitwiseAND((1 << HASH_BITS) - 1).alias("term"))
        .agg(*(F.sum(F.when(key.bitwiseAND(1) == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
        .where("n0 + n1 >= 3")
    )
    totals = [F.array(*(F.lit(float(a[c])) for a in anchors))[F.col("anchor")] for c in (1, 2)]
    p, z = _difference(*totals)
    best = per.where(p < 0.95).where(z >= PAIR_Z).groupBy("term").agg(F.max(z).alias("z")).orderBy(F.desc("z"), "term").limit(limit)
    return [r["term"] for r in best.collect()]


def _matrix(rows: DataFrame, slots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 of rows by terms, and labels."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [t for _, t in document_terms(batch.column(1).to_pylist(), slots)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "terms"])

    got = rows.mapInArrow(kept, "y int, terms array<int>").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    x = np.zeros((len(y), width), dtype=np.uint8)
    for chunk_at, chunk in _chunks(got.column("terms")):
        owner = np.repeat(np.arange(len(chunk)) + chunk_at, np.diff(chunk.offsets.to_numpy()))
        x[owner, chunk.flatten().to_numpy()] = 1
    return x, y


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS, terms: int = TERMS, pair_terms: int = PAIR_TERMS) -> FactorizationMachine | None:
    """Learn ``label`` (0 or 1) from ``labels`` (doc_id, label) and the texts of ``docs``.

    The machine's terms are at most ``terms`` that tell the labels apart in all rows,
    and at most ``pair_terms`` more that do so in rows with one of a few strong terms,
    such as a group's name that counts only beside an insult.

    At most ``fit_rows`` labelled doc_ids are used, a sample that depends on doc_id
    alone; a doc_id labelled more than once counts as 1 if any of its labels is, and
    any label but 0 counts as 1.  A doc_id with several texts gives one row, that of
    the text with the smallest hash, so no more than ``fit_rows`` rows reach the
    driver.  Null labels, doc_ids and labels without a document are left out; a null
    text counts as empty.  None if there is no row of one of the classes.
    """
    marked = F.max(F.when(F.col(label) != 0, 1).otherwise(0))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(marked.alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = held.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("y", "text")
    rows = staged(rows.repartition(32), "fit")  # bounded by fit_rows, and read three times

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
        for batch in _slices(batches):
            y = batch.column(0).to_numpy()
            for i, found in document_terms(batch.column(1).to_pylist()):
                n[y[i], found] += 1
        there = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(n[c, there]) for c in (0, 1))], names=["term", "n0", "n1"])

    n0, n1 = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n0 or not n1:
        return None
    per = rows.mapInArrow(counted, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p, z = _difference(n0, n1)
    best = per.where("n0 + n1 >= 3").where(p < 0.95).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(terms).collect()
    slots = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    slots[[r["term"] for r in best]] = np.arange(len(best))
    x, y = _matrix(rows, slots, len(best))
    anchors = [(best[j]["term"], best[j]["n0"], best[j]["n1"]) for j in _anchors(x, y)] if pair_terms else []
    if anchors and (more := _beside(rows, anchors, slots, pair_terms)):
        slots[more] = np.arange(len(best), len(best) + len(more))
        x, y = _matrix(rows, slots, len(best) + len(more))
    signs = np.packbits(x, axis=1)
    order = sorted(range(len(y)), key=lambda i: (y[i], signs[i].tobytes()))  # rows come in any order, and sums depend on it
    return FactorizationMachine(slots, *train(x[order], y[order]))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _chunks(column: pa.ChunkedArray) -> Iterator[tuple[int, pa.ListArray]]:
    at = 0
    for chunk in column.chunks:
        yield at, chunk
        at += len(chunk)


def score(docs: DataFrame, model: FactorizationMachine | None, *carried: str) -> DataFrame:
    """``carried`` columns and ``score`` for every row; a null text counts as empty.  Without a model, 0.

    Rows of equal text have equal scores, repeated or not; no rows give no rows.
    """
    if model is None:
        return docs.select(*carried, F.lit(0.0).alias("score"))
    kept = docs.select(*carried)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    sent = kept if "text" in carried else docs.select(*carried, "text")
    at = sent.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            values = [model.score(terms) for _, terms in document_terms(batch.column(at).to_pylist(), model.slots)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(values, pa.float64())], names=schema.names)

    return sent.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str) -> FactorizationMachine | None:
    """The model of the tables in ``sf_dir``, fitted without the held-out rows."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return fit(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null doc_id stays null and is not held out."""
    out = score(table(spark, sf_dir, "documents"), fitted(spark, sf_dir), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
