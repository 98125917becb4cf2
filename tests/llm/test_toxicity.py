from __future__ import annotations

import random

import numpy as np

from tessera.llm import toxicity


def sample(n, seed):
    """An insult is toxic only beside a group's name; either alone is not."""
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "amet", "velit", "magna", "quis", "nulla"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        text += ["blockheads"] * insult + ["martians"] * group
        rng.shuffle(text)
        rows.append((i + seed * 100_000, " ".join(text), int(insult and group)))
    return rows


def test_learns_the_pair(spark):
    rows, fresh = sample(1500, 1), sample(400, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string, y int"), model, "doc_id").collect()}
    assert np.mean([got[d] == bool(y) for d, _, y in fresh]) > 0.95
    again = toxicity.fit(df.select("doc_id", "text").repartition(3), df.select("doc_id", "toxic").repartition(5))
    assert np.allclose(again.weights, model.weights) and again.bias == model.bias


def test_a_term_that_counts_only_beside_others_is_learned(spark):
    """One insult is toxic beside a group's name, another without it, so the name alone tells nothing."""

    def crossed(n, seed):
        rng = random.Random(seed)
        rows = []
        for i in range(n):
            text = [rng.choice(["lorem", "ipsum", "dolor", "amet", "velit", "magna"]) for _ in range(rng.randint(5, 30))]
            one, other, group = (rng.random() < 0.4 for _ in range(3))
            text += ["blockheads"] * one + ["numskulls"] * other + ["martians"] * group
            rng.shuffle(text)
            rows.append((i + seed * 100_000, " ".join(text), int(one if group else other)))
        return rows

    rows, fresh = crossed(1500, 1), crossed(400, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    name = toxicity._term_hashes(b"martians")
    alone = toxicity.fit(df, df.select("doc_id", "toxic"), pair_terms=0)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert (alone.slots[name] < 0).all() and (model.slots[name] >= 0).all()
    got = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string, y int"), model, "doc_id").collect()}
    assert np.mean([got[d] == bool(y) for d, _, y in fresh]) > 0.95


def test_scores_equal_the_formula():
    rng = np.random.default_rng(0)
    m = toxicity.FactorizationMachine(np.zeros(1), -1.0, rng.normal(size=6), rng.normal(size=(6, 3)))
    terms = np.array([0, 2, 5])
    z = m.bias + m.weights[terms].sum() + sum(m.factors[i] @ m.factors[j] for i in terms for j in terms if i < j)
    assert np.isclose(m.score(terms), 1 / (1 + np.exp(-z)))


def test_blocks_do_not_change_terms(monkeypatch):
    texts = ["Some Text, here!", None, "", "x" * 900, "a b c " * 400]
    whole = [t.tolist() for _, t in toxicity.document_terms(texts)]
    monkeypatch.setattr(toxicity, "_BLOCK", 64)
    assert [t.tolist() for _, t in toxicity.document_terms(texts)] == whole
    keep = np.where(np.arange(1 << toxicity.HASH_BITS) % 2, np.arange(1 << toxicity.HASH_BITS), -1).astype(np.int32)
    assert [t.tolist() for _, t in toxicity.document_terms(texts, keep)] == [[x for x in t if x % 2] for t in whole]


def test_edges(spark, documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, None), (None, 1), (8, 1), (8, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    rows = toxicity.score(documents, model, "doc_id", "text").collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.fit(documents, labels.where("false")) is None and toxicity.fit(no_documents, labels) is None
    assert {r["score"] for r in toxicity.score(documents, None, "doc_id").collect()} == {0.0}
    assert toxicity.score(no_documents, model, "doc_id").count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, sf_dir).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.9
    assert not any(r["predicted"] for r in rows if labels[r["doc_id"]] == 0)


def test_labels_of_any_number_and_repeated_ids(spark):
    rows = sample(300, 3)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(rows[0][0], f"other {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 5 * y) for d, _, y in rows], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    toxicity.train = lambda x, y, **k: seen.append((len(x), sorted(set(y)))) or train(x, y, steps=10)
    try:
        toxicity.fit(docs, labels, fit_rows=200)
    finally:
        toxicity.train = train
    assert seen == [(200, [0.0, 1.0])]


def test_training_follows_the_gradient():
    rng = np.random.default_rng(1)
    x = (rng.random((40, 6)) < 0.4).astype(np.uint8)
    y = (x[:, 0] & x[:, 1]).astype(float)
    b, w, v = toxicity.train(x, y, steps=3000, decay=0.0)

    def loss(b, w, v):
        z = np.array([b + w @ r + sum(v[i] @ v[j] for i in range(6) for j in range(i) if r[i] and r[j]) for r in x.astype(float)])
        return np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z))))

    here, step = loss(b, w, v), 1e-4
    for bump in range(6):
        d = np.zeros(6)
        d[bump] = step
        assert abs(loss(b, w + d, v) - here) / step < 0.01
    assert here < 0.1
