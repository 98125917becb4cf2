from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def level(sizes, weights, cap):
    """Targets by raising the level until all is given out."""
    target, full = {}, set()
    while True:
        left = sum(sizes) - sum(cap * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        if not open_:
            return [cap * s for s in sizes]
        share = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * share > cap * sizes[i]]
        if not over:
            target = {i: weights[i] * share for i in open_}
            return [target.get(i, cap * sizes[i]) for i in range(len(sizes))]
        full |= set(over)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_draws(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["Z", "a", "ä", "b", "😀", None]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300 if i % 6 < 3 else 12))), names[i % 6]) for i in range(600)]
    docs = table(spark, rows)
    sized = mixing.staged(mixing.sized_documents(docs), "t")
    targets = mixing.staged(mixing.source_targets(sized, block_words=64), "t")
    got = targets.orderBy("src").collect()
    assert [r["source"] for r in got] == ["Z", "a", "b", "ä", "😀", None]
    assert np.allclose([r["target"] for r in got], level([r["source_size"] for r in got], [5, 2, 1, 5, 2, 1], 3))
    draws = mixing.mix(sized, targets, 8, block_words=64).cache()
    taken = {r["source"]: r["n"] for r in draws.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    assert all(taken.get(r["source"], 0) == round(r["target"]) for r in got)
    per = draws.groupBy("doc_id", "epoch", "block").count()
    assert per.where("count > 1").count() == 0
    assert draws.where("words > 64 or start + words > size or epoch >= 3").count() == 0
    assert draws.groupBy("shard").agg(F.max("place") + 1 - F.count("*")).where(F.col(draws.groupBy("shard").agg(F.max("place") + 1 - F.count("*")).columns[1]) != 0).count() == 0
    sizes = [r["n"] for r in draws.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 8
    again = mixing.mix(sized, targets, 8, block_words=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, draws.collect()))


def test_hypergeometric_law(spark):
    u = spark.range(20_000).selectExpr("shiftrightunsigned(xxhash64(id), 11) / 9007199254740992d AS u")
    for total, marked, drawn in ((100, 30, 40), (10, 10, 4), (7, 0, 3), (5, 3, 5), (10**9, 4 * 10**8, 5 * 10**8)):
        few = u if total < 1000 else u.limit(20)
        x = np.array([r[0] for r in few.selectExpr(mixing.hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", "u")).collect()], dtype=float)
        mean = drawn * marked / total
        sd = np.sqrt(mean * (1 - marked / total) * (total - drawn) / max(total - 1, 1))
        assert abs(x.mean() - mean) <= 4 * sd / np.sqrt(len(x)) + 1e-9
        assert x.min() >= max(0, drawn - (total - marked)) and x.max() <= min(drawn, marked)
    counts = np.bincount([r[0] for r in u.selectExpr(mixing.hypergeometric("6L", "3L", "3L", "u")).collect()], minlength=4) / 20_000
    assert np.allclose(counts, np.array([1, 9, 9, 1]) / 20, atol=0.015)


def test_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 1), (2, 0), (3, 137)], "src int, quota long")
    rows = mixing.split_quotas(quotas, 16, 3).collect()
    sizes = np.zeros(16)
    for src, quota in ((0, 1000), (1, 1), (2, 0), (3, 137)):
        own = sorted((r["shard"], r["lo"], r["hi"]) for r in rows if r["src"] == src)
        ends = [0, *(hi for _, _, hi in own)]
        assert [lo for _, lo, _ in own] == ends[:-1] and ends[-1] == quota and all(hi > lo for _, lo, hi in own)
        for shard, lo, hi in own:
            sizes[shard] += hi - lo
    assert sizes.max() - sizes.min() <= 4
    with pytest.raises(ValueError):
        mixing.split_quotas(quotas, 12, 3)


def test_draws_equal_brute_force(spark):
    """The shards and places from the blocks' own order, by counting."""
    rng = np.random.default_rng(5)
    docs = table(spark, [(int(i) if i % 7 else None, " ".join(["w"] * int(rng.integers(0, 200))), f"s{i % 3}") for i in range(400)])
    sized = mixing.staged(mixing.sized_documents(docs), "t")
    targets = mixing.staged(mixing.source_targets(sized, block_words=50), "t")
    rows = mixing.mix(sized, targets, 8, block_words=50).collect()
    key = ("size", "hash", "copy", "block")
    hashed = spark.createDataFrame([(n, -1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in key), r["epoch"]) for n, r in enumerate(rows)], "n int, doc long, size long, hash long, copy int, block int, epoch long")
    first = mixing.unit_hash(F.lit(20), F.lit(1), F.col("doc"), *(F.col(c) for c in key))
    u = dict(hashed.select("n", mixing.unit_hash(F.lit(20), first, F.col("epoch"))).collect())
    src = {r["source"]: r["src"] for r in targets.collect()}
    quotas = Counter(src[r["source"]] for r in rows)
    stretches = mixing.split_quotas(spark.createDataFrame(sorted(quotas.items()), "src int, quota long"), 8, 20).collect()
    for s in src:
        order = sorted((n for n, r in enumerate(rows) if r["source"] == s), key=lambda n: u[n])
        for rank, n in enumerate(order):
            assert [x["shard"] for x in stretches if x["src"] == src[s] and x["lo"] <= rank < x["hi"]] == [rows[n]["shard"]]


def test_repeated_rows(spark):
    import time

    docs = spark.range(10_000).selectExpr("if(id < 5000, 7L, null) doc_id", "'a b c' text", "'s' source")
    began = time.time()
    out = mixing.mixed_documents(docs)
    assert out.count() == 10_000 and time.time() - began < 60


def test_edges(spark, documents, no_documents, edge_rows):
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    words = sum(len((t or "").encode().split()) for _, t, *_ in edge_rows)
    assert abs(out.select(F.sum(mixing.n_words(F.col("text")))).first()[0] - words) <= 5
    assert mixing.mixed_documents(no_documents).count() == 0


def test_query(spark, sf_dir):
    rows = mixing.op6_mixing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {d["doc_id"]: len((d["text"] or "").encode().split()) for d in docs}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == round(own[0]["target"]) and sum(r["size"] for r in own) == own[0]["source_size"]


def test_query_returns_the_draws(spark, sf_dir):
    rows = mixing.op6_mixing(spark, sf_dir).collect()
    assert all(sum(d["words"] for d in r["draws"]) == r["taken"] for r in rows)
    shards = {}
    for r in rows:
        for d in r["draws"]:
            shards.setdefault(d["shard"], []).append(d["place"])
    assert len(shards) == 64 and all(sorted(p) == list(range(len(p))) for p in shards.values())


def test_mixed_rows_stand_by_shard_and_place(spark):
    docs = table(spark, [(i, f"w{i} x y", f"s{i % 3}") for i in range(400)])
    sized = mixing.sized_documents(docs)
    shards = {}
    for r in mixing.mix(sized, mixing.source_targets(sized), 64).orderBy("shard", "place").collect():
        shards.setdefault(r["shard"], []).append(r["doc_id"])
    got = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    inside = Counter(pair for s in shards.values() for pair in zip(s, s[1:], strict=False))
    assert not inside - Counter(zip(got, got[1:], strict=False)) and len(got) == sum(map(len, shards.values()))
