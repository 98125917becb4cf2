from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, wordids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_ids_of_words_are_ids_of_texts(whole, monkeypatch):
    monkeypatch.setattr(wordids, "CACHE_BYTES", 3000)  # generations change on the way
    rng = np.random.default_rng(5)
    signs = list("aé'S.<|>endoftx ́ʼİ²1\xa0Σ日\n\t\x1c") + ["don't", " it's", "<|endoftext|>", "<|startoftext|>", " Ab,", "K", "ﬁ"]
    texts = ["", " ", "ΑΣ Σίσυφος ŉ ǰ ẞ"] + ["".join(rng.choice(signs, 60)) for _ in range(800)]
    words = wordids.WordIds(PATH)
    for k in range(0, len(texts), 50):
        for text, raw in zip(texts[k : k + 50], words.batch([t.encode() for t in texts[k : k + 50]]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_every_plain_letter_among_signs(whole):
    # lower-casing takes some of these letters out of the plain range, where they are letters all the same
    letters = [chr(c) for c in range(33, 0x250)]
    texts = [f"{form} {form}\v\f{form}" for c in letters for form in (c, f"a{c}1", f"1{c}B,", f",{c}{c}.{c}é")] + ["  ", "\x00 \x1f", "Ɓ" * 300]
    found = wordids.WordIds(PATH).batch([t.encode() for t in texts])
    assert [np.frombuffer(raw, "<u4").tolist() for raw in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert wordids.WordIds(PATH).batch([]) == [] and wordids.WordIds(PATH).batch([b"", b" "]) == [b"", b""]


def test_words_alike_but_for_case_and_signs_are_held_once():
    words = wordids.WordIds(PATH)
    signs = [f"{a}{b}" for a in ".,;:!?()" for b in ".,;:!?()"]
    words.batch([" ".join(f"{word}{sign}" for sign in signs for word in ("word", "Word", "WORD", "wOrd")).encode()])
    assert words.held <= (len(signs) + 1) * (wordids._ENTRY + 6 * 4)


def test_plan_fills_bins():
    rng = np.random.default_rng(1)
    counts: dict[int, int] = {}
    for n in np.minimum(2048, rng.lognormal(6.2, 1.2, 5000).astype(int) + 1).tolist():
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan_bins(counts)
    held: dict[int, int] = {}
    for content, times in plan:
        assert sum(content) <= 2048
        for n in content:
            held[n] = held.get(n, 0) + times
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert held == counts and sum(t for _, t in plan) <= least * 1.01 + 1
    assert packing.plan_bins({}) == [] and packing.plan_bins({2048: 3}) == [([2048], 3)]
    with pytest.raises(ValueError):
        packing.plan_bins({0: 1})


def test_two_fit_beats_greedy():
    # greedy puts 6 and 3 into ten; 2 and 2 fill the gap that 3 leaves
    plan = packing.plan_bins({6: 1, 3: 1, 2: 2}, capacity=10)
    assert plan[0] == ([6, 2, 2], 1) and plan[1] == ([3], 1)


def check(rows, docs, whole, capacity):
    wanted = []
    for d, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted += [(d, p, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for p, a in enumerate(range(0, len(ids), capacity))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("bucket", [1, 256])
def test_edges(spark, documents, no_documents, whole, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check(packing.pack_documents(documents, PATH, 64).collect(), docs, whole, 64)
    assert packing.pack_documents(no_documents, PATH).count() == 0


def test_query_and_sequences(spark, sf_dir, whole):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op9_best_fit_packing(spark, sf_dir).collect()
    assert check(rows, docs, whole, 2048) <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1
    small = spark.createDataFrame(docs[:20], "doc_id long, text string")
    packed = packing.pack(packing.staged(packing.token_pieces(small, PATH, 512, with_ids=True), "t"), 512)
    made = packing.sequences(packed).collect()
    assert sum(len(s["ids"]) for s in made) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs[:20])
