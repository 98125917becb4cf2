from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tessera.llm import chat

KIND = "tree long, node long, parent long, score double, role string, text string"


def test_escapes_are_reversible(spark):
    texts = ["a\\n<|x", "\\", "<\\|", "<|\\<\\\\|\\n\n\\\n", "\\\\n", "\\n", "", "<|im_end|>\n<|im_start|>assistant\n", "<<||"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", chat.unescaped(chat.escaped(F.col("s"))), chat.unescaped_role(chat.escaped_role(F.col("s"))), chat.escaped(F.col("s"))).collect():
        assert r[0] == r[1] == r[2] and "<|" not in r[3]


def paths(messages):
    up = {(t, n): (p, s) for t, n, p, s, *_ in messages}
    up = {k: (p if (k[0], p) in up else None, s) for k, (p, s) in up.items()}
    parents = {(t, p) for (t, _), (p, _) in up.items() if p is not None}
    out = {}
    for tree, node in up:
        if (tree, node) in parents:
            continue
        path, at, seen = [], node, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = up[tree, at][0]
        if at is None:
            out.setdefault(tree, []).append((-sum(up[tree, n][1] for n in path), node, path[::-1]))
    return {(t, i + 1): p for t, found in out.items() for i, (_, _, p) in enumerate(sorted(found))}


def test_branches_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(t, n, rng.choice([None, *range(max(0, n - 4), n)]) if n else None, float(rng.randint(0, 5)), "user", f"{n}") for t in range(6) for n in range(rng.choice([1, 5, 60]))]
    rows += [(100, 1, 2, 1.0, "u", "cycle"), (100, 2, 1, 1.0, "u", "cycle"), (100, 3, 2, 1.0, "u", "hangs on it"), (101, 5, 77, 1.0, "u", "parent missing"), (101, 6, None, None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    got: dict = {}
    for r in chat.branch_paths(df, None).orderBy("position").collect():
        got.setdefault((r["tree"], r["branch"]), []).append(r["node"])
    assert got == paths([(t, n, p, s or 0.0) for t, n, p, s, *_ in rows])
    best = chat.format_trees(df, 1)
    assert best.count() == len({t for t, _ in got})


def test_read_back(spark):
    rows = [(1, 1, None, 0.0, "user", "q<|im_end|>"), (1, 2, 1, 0.0, "assistant", "a\n\\"), (1, 3, 2, 0.0, None, None), (1, 4, 3, 0.0, "assistant", "😀é")]
    done = chat.format_trees(spark.createDataFrame(rows, KIND)).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [tuple(t) for t in done["turns"]] == [("user", "q<|im_end|>"), ("assistant", "a\n\\"), ("", ""), ("assistant", "😀é")]
    assert done["loss"] == "a\n\\😀é" and done["n_turns"] == 4


def test_edges_of_linear_trees(spark):
    rows = [(1, None, "user", "first"), (1, 2, None, None), (1, 2, None, None), (None, 1, "user", "lost"), (2, 0, "assistant", "x" * 100_000)]
    done = chat.format_trees(chat.linear_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r["tree"]: r["n_turns"] for r in done.collect()} == {"1": 3, "2": 1, "": 1}
    assert chat.format_trees(chat.linear_trees(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_query_on_odd_rows_equals_sql(spark, monkeypatch):
    rows = [(None, 1, "user", "lost", 7), (None, 0, "assistant", "x", 7), (-1, 0, "user", "own", 7), (3, None, None, None, 7), (3, 1, "assistant", "<|\\", 7), (3, 1, "assistant", "<|\\", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int").withColumn("tree", F.lit("clash"))
    monkeypatch.setattr(chat, "table", lambda *_: df)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    wanted = con.sql(chat.OP4_SQL)
    got = chat.op4_chat_formatting(spark, "").select(*wanted.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, wanted.fetchall()))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    wanted = con.sql(chat.OP4_SQL)
    got = chat.op4_chat_formatting(spark, sf_dir).select(*wanted.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted.fetchall())
