from __future__ import annotations

import random

import corpus_pipeline
from tessera.llm import jaccard, packing, secrets, toxicity
from tessera.llm.components import connected_components


def test_stages_in_turn(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        seen.append((name, before, docs))
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    (_, first, clean), (_, _, single), (_, _, masked), (_, _, mixed), (_, _, packed) = seen
    rows = {r["doc_id"]: r["text"] for r in first.collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    model = toxicity.fit(first, corpus_pipeline.table(spark, sf_dir, "labels").where(~toxicity.held_out(jaccard.F.col("doc_id"))))
    scores = dict(zip(rows, (model.score(t) for _, t in toxicity.document_terms(list(rows.values()), model.slots)), strict=True))
    assert kept == {d for d, s in scores.items() if s < toxicity.THRESHOLD}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(clean, 5, 80, 100).collect()}
    assert {r["doc_id"] for r in single.collect()} == {d for d, c in groups.items() if d == c}
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"]) and secrets.ASSIGN and not __import__("re").search(secrets.LONG_RUNS["hex"], r["text"])
    words = sum(len(r["text"].encode().split()) for r in masked.collect())
    assert abs(sum(len(r["text"].encode().split()) for r in mixed.collect()) - words) < 20
    assert packed.where(f"length > {packing.CAPACITY}").count() == 0
    assert [s for s, *_ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secret_scans", "mixing", "best_fit_packing"]


def test_components_equal_brute_force(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randint(300, 700), rng.randint(300, 700)) for _ in range(250)] + [(900, 900), (-5, 901), (-5, 901)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == {x: root(x) for x in up}
    assert connected_components(df.where("false")).count() == 0


def test_all_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
