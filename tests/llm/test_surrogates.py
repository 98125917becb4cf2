from __future__ import annotations

from tessera.llm import surrogates

KEY = b"test key"
TEXTS = [
    "Dear Mr John Smith and Mrs. Anna Smith, call (212) 555-0147 or 212-555-0147, +49 30 1234 5678. Frau Müller, HERR MÜLLER; господин Иван Петров, госпожа Петрова",
    "A@B.CO a@b.co 4111 1111 1111 1111 4111-1111-1111-1111 192.168.0.7 DE89 3704 0044 0532 0130 00 123-45-6789",
    "nothing private: 12 apples, version 1.2, 3-4 weeks, The Mr. of x", "again a@b.co", "x" * 300_000 + " a@b.co",
]


def replaced(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in surrogates.replace_private(df, key).collect()}


def test_formats_coreference_and_distinctness(spark):
    got = replaced(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        before, after = surrogates.mentions(text), surrogates.mentions(got[i]["text"])
        assert [m[2] for m in after] == [m[2] for m in before]
        assert not {m[3] for m in before} & {m[3] for m in after}
    pairs = {}
    for i, text in enumerate(TEXTS):
        for (_, _, k, e), (_, _, _, s) in zip(surrogates.mentions(text), surrogates.mentions(got[i]["text"]), strict=True):
            assert pairs.setdefault((k, e), s) == s
    assert len({(k, s) for (k, _), s in pairs.items()}) == len(pairs)
    assert got[2]["text"] == TEXTS[2] and got[2]["n_entities"] == 0
    card = next(m for m in surrogates.mentions(got[1]["text"]) if m[2] == "card")
    assert surrogates._luhn(card[3]) == 0 and card[3][0] == "4"
    assert "192.168." in got[1]["text"] and got[4]["text"].startswith("x" * 300_000)


def test_key_decides(spark):
    assert replaced(spark, TEXTS) == replaced(spark, TEXTS)
    assert replaced(spark, TEXTS)[3]["text"] != replaced(spark, TEXTS, b"other")[3]["text"]


def test_collisions_are_settled(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "open_surrogate", lambda key, kind, entity, attempt: f"s{(sum(map(ord, entity)) * (attempt + 1)) % (40 * 10**attempt)}")
    entities = spark.createDataFrame([("email", f"e{i}") for i in range(30)] + [("email", "s3"), ("given-m", "a"), ("given-f", "a")], "kind string, entity string")
    rows = surrogates.assign(entities, KEY).collect()
    mail = [r["plain"] for r in rows if r["kind"] == "email"]
    assert len(rows) == 33 and len(set(mail)) == len(mail) == 31 and "s3" not in mail
    assert len({r["plain"] for r in rows if r["kind"].startswith("given")}) == 2


def test_shifts_are_permutations_that_move_all():
    for n in (2, 3, 10, 256, 1000):
        for by in (1, 2):
            got = [surrogates.shifted(KEY, "space", n, x, by) for x in range(n)]
            assert sorted(got) == list(range(n)) and all(by % n == 0 or g != x for x, g in enumerate(got))
    assert [surrogates.shifted(KEY, "a", 1000, x, 1) for x in range(9)] != [surrogates.shifted(b"k", "a", 1000, x, 1) for x in range(9)]


def test_a_full_space_ends(spark):
    ips = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    entities = spark.createDataFrame([("ip", x) for x in ips] + [("ip", "8.8.8.8"), ("ssn", "123456789")], "kind string, entity string")
    got = {r["entity"]: r["plain"] for r in surrogates.assign(entities, KEY).collect()}
    assert len(got) == len(set(got.values())) == len(ips) + 2 and all(k != v for k, v in got.items())
    assert all(got[x].startswith("192.168.") for x in ips) and not got["8.8.8.8"].startswith(("192.168.", "10.", "127."))


def test_many_names_have_distinct_words(spark):
    entities = spark.createDataFrame([("given-m", f"name{i}") for i in range(3000)] + [("family", f"word{i}") for i in range(3000)], "kind string, entity string")
    rows = surrogates.assign(entities, KEY).collect()
    assert len(rows) == 6000 and len({(r["kind"], r["plain"]) for r in rows}) == 6000


def test_people_are_resolved_in_their_document(spark):
    texts = [
        "Mr Alex Miller wrote. Dr Alex Miller agreed. Later Miller left, and Alex Miller's dog; MILLER signed. Prof. Kim Stone met Mrs Kim Stone.",
        "The Miller left. Alex too. Dear Ms Jane Doe, Ms Jane Roe",
        "x" * 90 + "@example.org and john" + ".a" * 40 + "@b.co",
    ]
    kinds = [(t[a:b], k, e) for t in texts for a, b, k, e in surrogates.mentions(t)]
    assert kinds[:14] == [
        ("Alex", "given-m", "alex"), ("Miller", "family", "miller"), ("Alex", "given-m", "alex"), ("Miller", "family", "miller"), ("Miller", "family", "miller"),
        ("Alex", "given-m", "alex"), ("Miller", "family", "miller"), ("MILLER", "family", "miller"), ("Kim", "given-f", "kim"), ("Stone", "family", "stone"),
        ("Kim", "given-f", "kim"), ("Stone", "family", "stone"), ("Jane", "given-f", "jane"), ("Doe", "family", "doe"),
    ]
    assert [k for _, k, _ in kinds[16:]] == ["email", "email"]
    got = replaced(spark, texts)
    assert "Miller" not in got[0]["text"] and "MILLER" not in got[0]["text"] and got[1]["text"].startswith("The Miller left. Alex too. Dear Ms ")
    words = got[0]["text"].replace(".", "").split()
    assert words[1:3] == words[5:7] and words[9] == words[2].replace("'s", "") and f"{words[1]} {words[2]}'s dog" in got[0]["text"]


def test_every_mention_may_hold():
    import re

    assert all(re.search(surrogates.MAY_HOLD, t) for t in TEXTS if surrogates.mentions(t))


def test_edges(spark, documents, no_documents):
    rows = surrogates.replace_private(documents, KEY).collect()
    assert sorted(map(repr, (r["text"] for r in rows))) == sorted(map(repr, (r["text"] for r in documents.collect())))
    assert surrogates.replace_private(no_documents, KEY).count() == 0
