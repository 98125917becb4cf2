from __future__ import annotations

import random

import pytest

EDGES = [None, "", "   ", "one", "ONE", "one two", "tie tie tie tie", "日本語 テキスト é 😀", "w " * 30_000, "x" * 200_000]


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls in any column, empty and very long texts, and repeats."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(EDGES)]
    return [*rows, rows[5], rows[5], (None, "no id here", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def documents(spark, edge_rows):
    """The edge rows as a table with extra columns whose names operators might use inside."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(edge_rows, kind)
    return df.selectExpr("*", "'x' as strong", "'x' as weak", "1 as size", "'y' as sig", "0 as score", "'z' as _range", "7 as copy")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def near_texts():
    """Groups of near copies with a few words changed, cut short, or equal."""
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        base = [rng.choice("the of and to in a is on by re".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice("xyz") + str(rng.randint(0, 9))
            texts.append(" ".join(words[: -rng.randint(1, 3)] if words and rng.random() < 0.2 else words))
    rng.shuffle(texts)
    return texts
