from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import tokencounts
from tessera.llm.tokencounts import attribute, encode, encoder, line_sections, token_counts, token_spans

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(starts, ends, lo, hi, rule):
    n, crossing = 0.0, 0
    for a, b in zip(starts, ends, strict=True):
        inside = max(0, min(b, hi) - max(a, lo))
        n += {"first": lo <= a < hi, "middle": lo <= (a + b - 1) // 2 < hi, "share": inside / (b - a)}[rule]
        crossing += 0 < inside < b - a
    return n, crossing


@pytest.mark.parametrize("rule", ["first", "middle", "share"])
def test_rules_equal_brute_force(rule):
    text = "Some words here.\n\nAnother líne; números 12345\nend"
    starts, ends = token_spans(text, PATH)
    rng = np.random.default_rng(3)
    lo = rng.integers(0, len(text), 40)
    hi = np.minimum(lo + rng.integers(0, 20, 40), len(text))
    got = attribute(starts, ends, lo, hi, rule)
    for i in range(40):
        n, crossing = brute(starts, ends, lo[i], hi[i], rule)
        assert got[0][i] == pytest.approx(n if hi[i] > lo[i] else 0) and got[1][i] == crossing
    a, b = line_sections(text)
    assert attribute(starts, ends, a, b, rule)[0].sum() == pytest.approx(len(starts))


def test_edges(spark, documents, no_documents):
    rows = token_counts(documents, PATH).collect()
    texts = documents.select("doc_id", "text").collect()
    total = sum(len(encoder(PATH)[0].encode(t["text"] or "", disallowed_special=())) for t in texts)
    assert sum(r["n_tokens"] for r in rows) == total and len(rows) >= len(texts)
    assert token_counts(no_documents, PATH).count() == 0


def test_fields(spark):
    df = spark.sql("select 1L doc_id, 'name: Ann\nage: 3' text, array(struct(6 as start, 9 as end), struct(15 as start, 99 as end)) parts union all select 2L, 'x', null")
    got = {(r["doc_id"], r["section"]): (r["start"], r["end"], r["n_tokens"]) for r in token_counts(df, PATH, "share", "parts").collect()}
    assert got[1, 0][:2] == (6, 9) and got[1, 1][:2] == (15, 16) and len(got) == 2
    with pytest.raises(ValueError):
        token_counts(df, PATH, "half")


def test_long_blank_runs(monkeypatch):
    encoding, _ = encoder(PATH)
    for run in (" ", "\n", " \n", "\t \u3000", "\x85"):
        for text in (f"a{run * 4000}", f"{run * 4000}b c", f"é{run * 3000} b{run * 3000}\n1{run * 20}!", run * 5000):
            with monkeypatch.context() as m:
                m.setattr(tokencounts, "_LONG_BLANK", tokencounts.re.compile(f"[{tokencounts._SPACES}]{{100,}}"))
                assert encode(encoding, text).tolist() == encoding.encode(text, disallowed_special=())
    starts, ends = token_spans("x" + " " * 10_000_000 + "y", PATH)
    assert ends[-1] == 10_000_002 and (starts[1:] == ends[:-1]).all()


def test_lines():
    for text in ("", "\n", "a", "a\n", "a\n\nb", "é\n😀"):
        lo, hi = line_sections(text)
        assert [text[a:b] for a, b in zip(lo, hi, strict=True)] == (text.splitlines(keepends=True) or [""])


def test_null_sections_and_many_lines(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "_ROWS", 3)
    df = spark.createDataFrame([(1, "one two", [None, (0, 3), (None, 3), (2, None)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = token_counts(df, PATH, "first", "parts").orderBy("section").collect()
    assert [(r["start"], r["end"], r["n_tokens"]) for r in got] == [(0, 0, 0), (0, 3, 1), (0, 0, 0), (0, 0, 0)]
    many = spark.createDataFrame([(i, "a\n" * i) for i in range(12)], "doc_id long, text string")
    rows = token_counts(many, PATH).collect()
    assert sorted((r["doc_id"], r["section"]) for r in rows) == sorted((i, k) for i in range(12) for k in range(max(1, i)))
