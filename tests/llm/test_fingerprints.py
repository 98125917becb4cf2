from __future__ import annotations

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints


def test_edited_texts_and_equal_fingerprints(spark, edge_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 1)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("é b cc 日 😀 dd".split()) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["same text here"] * 3
    docs = [(rng.randint(-(10**6), 10**6) * 2 + i % 2, t) for i, t in enumerate(texts)]
    docs = list({d: t for d, t in docs}.items())
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("entries", F.lit("clash"))
    got = {r["doc_id"]: r for r in run(spark, df, monkeypatch).collect()}
    order = sorted(docs, reverse=True)
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert (r["near_edited"] == 1) >= (edited == t) and (r["near_next"] == 1) >= (after == t)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_text: dict = {}
    for d, t in docs:
        by_text.setdefault(t, set()).add(got[d]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def run(spark, df, monkeypatch):
    monkeypatch.setattr(fingerprints, "table", lambda *_: df)
    return fingerprints.op7_fingerprints(spark, "")


def test_edges(spark, documents, no_documents, monkeypatch):
    assert run(spark, documents, monkeypatch).count() == documents.count()
    assert run(spark, no_documents, monkeypatch).count() == 0
    one = run(spark, spark.createDataFrame([(5, "alone here")], "doc_id long, text string"), monkeypatch).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()


_M = (1 << 64) - 1


def xx(*values, seed=42):
    """Spark's xxhash64: each value's hash seeds the next, nulls are skipped."""
    for kind, v in values:
        if v is not None:
            raw = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def token_list(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("([\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", text or "")) if w]
    few = len(words) < 8
    return [g for w in words for g in ([w[i : i + 3] for i in range(len(w) - 2)] if (few or len(w) > 24) and len(w) > 3 else [w])]


def brute(text, k=2, picked=2, bits=6):
    """The entries, by dictionaries over whole hashes."""
    h = [signed(xx(("s", t))) for t in token_list(text)]
    n = max(len(h) - k + 1, min(len(h), 1))
    grams = [signed(xx(*(("q", x) for x in h[i : i + k]))) for i in range(n)]
    seen: dict = {}
    bins: dict = {}
    for at, g in enumerate(grams):
        o = seen[g] = seen.get(g, -1) + 1
        v = xx(("q", g), ("i", o))
        bins.setdefault(v >> (64 - bits), []).append((signed(v), at))
    out = []
    for b, held in bins.items():
        first = sorted(sorted(held)[:picked], key=lambda x: x[1])
        value = xx(*(("q", (v & _M) >> 31) for v, _ in first))
        out.append(b * 65536 + (value & 0xFFFF))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["", "a", "a b", "one", "x" * 3000, "日本語 テキスト", "a a a a a a a a a a a a", None]
    texts += [" ".join(rng.choice(["a", "bc", "dé", "日", "w" * 30 + str(i % 7)]) + str(rng.randint(0, 30)) for i in range(rng.randint(0, 500))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fingerprints.order_minhash(F.col("t")).alias("e"))
    for r in df.collect():
        assert sorted(r["e"]) == brute(texts[r["i"]]), texts[r["i"]]


def test_order_holds_in_texts_of_any_length(spark):
    n = 1_200_000
    words = [f"{i:x}" for i in range(n)]
    moved = words[n // 2 :] + words[: n // 2]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(moved)), (2, " ".join([*words[: n // 3], "edit", *words[n // 3 :]]))], "i int, t string")
    got = {r["i"]: set(r["e"]) for r in df.select("i", fingerprints.order_minhash(F.col("t")).alias("e")).collect()}
    assert len(got[0] & got[2]) >= 63 and 15 < len(got[0] & got[1]) < 50


def test_one_letter_in_a_long_word(spark):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(5000))
    other = "".join(rng.sample(word, len(word)))
    rows = [(word, word[:2500] + "!" + word[2501:], word[:2500] + word[2501:], other)]
    like = lambda c: fingerprints.likeness(fingerprints.order_minhash(F.col("a")), fingerprints.order_minhash(F.col(c)))
    changed, cut, unlike = spark.createDataFrame(rows, "a string, b string, c string, d string").select(like("b"), like("c"), like("d")).first()
    assert changed > 0.9 and cut > 0.9 and unlike < 0.1


def test_ids_at_both_ends_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    top = (1 << 63) - 1
    docs = [(top, "a"), (-top - 1, "b"), (0, "c"), (top - 1, "d"), (None, "e")] + [(7, f"t{i}") for i in range(200)] + [(8, "u"), (6, "v")] + [(-5, f"s{i % 9}") for i in range(100)]
    rows = run(spark, spark.createDataFrame(docs, "doc_id long, text string"), monkeypatch).collect()
    order = sorted(docs, key=lambda r: (-(r[0] if r[0] is not None else -top - 1), signed(xx(("s", r[1]))), r[1]))
    wanted = sorted((str(d), hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in rows) == wanted


def test_order_and_repeats_count(spark):
    a = " ".join(f"w{i}" for i in range(400))
    swapped = " ".join(f"w{i}" for i in [*range(200, 400), *range(200)])
    repeated = f"{a} {a}"
    near = " ".join(f"w{i}" if i != 77 else "edit" for i in range(400))
    df = spark.createDataFrame([(a, swapped, repeated, near)], "a string, s string, r string, n string")
    like = lambda x, y: fingerprints.likeness(fingerprints.order_minhash(F.col(x)), fingerprints.order_minhash(F.col(y)))
    same, moved, twice, edited = df.select(like("a", "a"), like("a", "s"), like("a", "r"), like("a", "n")).first()
    assert same == 1.0 and 0.3 < moved < 0.85 and twice < 0.6 and 0.85 < edited < 1.0


def test_likeness_follows_the_share_kept(spark):
    rng = random.Random(1)
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(600)]
    rows = [(share, " ".join(base), " ".join(base[: int(600 * share)] + [f"u{rng.randint(0, 10**6)}" for _ in range(600 - int(600 * share))])) for share in (0.0, 0.5, 0.8, 0.95, 1.0)]
    df = spark.createDataFrame(rows, "share double, a string, b string")
    got = [r[0] for r in df.orderBy("share").select(fingerprints.likeness(fingerprints.order_minhash(F.col("a")), fingerprints.order_minhash(F.col("b")))).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 1
