"""Surrogates for private data: keyed, type-consistent, distinct and coreferent.

Mentions of e-mail addresses, telephone and card numbers, IP addresses, account
numbers and titled names are found, and in a document with titled names their words
again wherever they stand without a title; what a mention stands for is its entity
(digits without separators, an address in lower case, one word of a name, given
names with the gender that the document tells).  Each entity of the corpus gets one
replacement of its kind.  Numbers and addresses of a fixed format are shifted along
a keyed permutation of all that have this format, so that no two meet; words are
drawn by a keyed hash from spaces that grow with each attempt.  A few checks see to
it that no replacement is itself an entity; each mention is then written in its own
format.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged, table

# Titles by the gender they tell, and given names by script and gender.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа"),
    "": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "m"): ("Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Noel", "Oscar", "Paul"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим"),
    ("cyrillic", "f"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Лидия", "Мария", "Нина"),
}
_SYLLABLES = {"latin": ("ba", "den", "fol", "gar", "hin", "kel", "lor", "mas", "nev", "pol", "ras", "sun", "tor", "vel", "wen", "zam"), "cyrillic": ("ба", "вел", "гор", "дан", "кол", "лен", "мир", "нов", "пол", "руд", "сав", "тар")}
_GENDER = {name.casefold(): gender for (_, gender), names in GIVEN.items() for name in names}

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]{1,40}"
_TITLE = "|".join(sorted({re.escape(x) for titles in TITLES.values() for t in titles for x in (t, t.upper())}, key=lambda t: (-len(t), t)))
KINDS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]++@[\w-]{1,63}(?:\.[\w-]{1,63})+"),
    "account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?!\w|[.-][0-9])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+])(?:\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}|(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4})(?!\w)"),
    "name": re.compile(rf"(?<!\w)({_TITLE})(\.?[ \t]+)({_NAME}(?:[ \t]+{_NAME}){{0,2}})"),
}
#: Holds for every text in which a mention can be found.
MAY_HOLD = f"[@0-9]|(?=[{''.join(sorted({t[0] for t in _TITLE.split('|')}))}])(?:{_TITLE})"  # one look at a letter rules most places out

#: The setting of the session that names the key.
KEY_SETTING = "spark.tessera.surrogates.key"
_MENTION = "array<struct<start:int,end:int,kind:string,entity:string>>"


def _plain(kind: str, text: str) -> str:
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind.startswith(("given", "family")):
        return text.casefold()
    return re.sub(r"[^0-9A-Z]", "", text)


#: What may follow a name's word in its mention and isn't part of it.
_OWN = re.compile("['’]s$", re.IGNORECASE)
_WORD = re.compile(rf"(?<!\w){_NAME}(?![\w])")


def _name_words(m: re.Match) -> list[tuple[int, int, str]]:
    """Start, end and text of the words of a titled name, without a possessive's ending."""
    return [(m.start(3) + w.start(), m.start(3) + w.start() + len(bare), bare) for w in re.finditer(r"\S+", m[3]) if len(bare := _OWN.sub("", w[0])) > 1]


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity), in order; where finds overlap, the first holds, then the longest.

    A given name's gender is that of a title before it anywhere in the text, else of
    the list of given names; names that only titles without a gender stand before
    have none.  Words of titled names are found again without a title, capitalised as
    they were or in capitals throughout.  A word that is both keeps to its first use.
    """
    found, known, titled = [], {}, []
    for kind, pattern in KINDS.items():
        for m in pattern.finditer(text):
            if kind != "name":
                found.append((m.start(), -m.end(), [(m.start(), m.end(), kind)]))
                continue
            gender = next(g for g, titles in TITLES.items() if m[1].casefold() in map(str.casefold, titles))
            words = _name_words(m)
            if not words:
                continue
            titled.append((m.start(), -m.end(), words))
            for _, _, word in words[:-1]:
                if gender or word.casefold() not in known:
                    known.setdefault(word.casefold(), gender)
                    known[word.casefold()] = known[word.casefold()] or gender
    if titled:
        roles: dict[str, str] = {}  # of each word, as it stands or in capitals
        for start, end, words in titled:
            parts = []
            for a, b, word in words:
                plain = word.casefold()
                kind = "family" if a == words[-1][0] else f"given-{known[plain] or _GENDER.get(plain, '')}"
                parts.append((a, b, kind))
                for form in (word, word.upper(), word.capitalize()):
                    roles.setdefault(form, kind)
            found.append((start, end, parts))
        for m in _WORD.finditer(text):
            word = _OWN.sub("", m[0])
            if word in roles:
                found.append((m.start(), -m.start() - len(word), [(m.start(), m.start() + len(word), roles[word])]))
    out, at = [], 0
    for start, end, parts in sorted(found):
        if start >= at:
            out += [(a, b, kind, _plain(kind, text[a:b])) for a, b, kind in parts]
            at = -end
    return out


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


class Draw:
    """Numbers that depend on a key and what is replaced, and nothing else."""

    def __init__(self, key: bytes, *what: object):
        self.seed = hmac.new(key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest()
        self.pool, self.n = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.n += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
        self.pool, out = divmod(self.pool, n)
        return out

    def like(self, text: str) -> str:
        """Letters and digits for letters and digits of the same kind and script."""
        return "".join(self._like(c) for c in text)

    def _like(self, c: str) -> str:
        for first, last in ("az", "AZ", "09", "ая", "АЯ", "αω", "ΑΩ"):
            if first <= c <= last:
                out = chr(ord(first) + self.below(ord(last) - ord(first) + 1))
                return "σ" if out == "ς" else "Σ" if out == "\u03a2" else out
        return self._like("a") if c.isalpha() else c


def _rounds(key: bytes, space: str, half: int, x: int, order: range) -> int:
    left, right = x >> half, x & ((1 << half) - 1)
    for i in order:
        if order.step < 0:
            left, right = right, left
        mixed = hashlib.blake2b(f"{space}\x1f{i}\x1f{right}".encode(), key=hashlib.sha256(key).digest(), digest_size=16).digest()
        left ^= int.from_bytes(mixed, "big") & ((1 << half) - 1)
        if order.step > 0:
            left, right = right, left
    return left << half | right


def permuted(key: bytes, space: str, n: int, x: int, back: bool = False) -> int:
    """A keyed permutation of 0..n-1, or its inverse: a Feistel network, walked until it is back in the range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    while True:
        x = _rounds(key, space, half, x, range(7, -1, -1) if back else range(8))
        if x < n:
            return x


def shifted(key: bytes, space: str, n: int, x: int, by: int) -> int:
    """``x`` moved on along the permutation's order: for each ``by`` not divisible by ``n`` a permutation that moves all."""
    return permuted(key, space, n, (permuted(key, space, n, x) + by) % n, True)


def _ip_class(ip: str) -> str:
    """The part of an address that its surrogate keeps, or the class of addresses that it stays in."""
    a, b, *_ = map(int, ip.split("."))
    if a in (10, 127):
        return f"{a}."
    if (a, b) == (192, 168) or (a == 172 and 16 <= b < 32) or (a, b) == (169, 254):
        return f"{a}.{b}."
    return "public" if 1 <= a <= 223 else "reserved"


def _pattern_number(text: str) -> tuple[int, int]:
    """The number of a text of capitals and digits among those of its pattern, and how many there are."""
    x, n = 0, 1
    for c in text:
        size, at = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 65)
        x, n = x * size + at, n * size
    return x, n


def _pattern_text(pattern: str, x: int) -> str:
    out = []
    for c in reversed(pattern):
        size, first = (10, 48) if c.isdigit() else (26, 65)
        x, at = divmod(x, size)
        out.append(chr(first + at))
    return "".join(reversed(out))


def _kept(kind: str, entity: str) -> int:
    """Leading signs that a number keeps: a card's or telephone number's first digit, an account's country."""
    return {"card": 1, "phone": 1, "account": 2}.get(kind, 0)


def fixed_surrogate(key: bytes, kind: str, entity: str, attempt: int) -> tuple[str, str]:
    """(space, replacement) for kinds of fixed formats; for each attempt, no two entities have the same."""
    by = attempt + 1
    if kind == "ip":
        cls = _ip_class(entity)
        head = "" if cls in ("public", "reserved") else cls
        tail = [int(x) for x in entity.split(".")][head.count(".") :]
        x, n = int.from_bytes(bytes(tail), "big"), 256 ** len(tail)
        while True:
            x = shifted(key, f"ip {cls}", n, x, by)
            out = head + ".".join(map(str, x.to_bytes(len(tail), "big")))
            if _ip_class(out) == cls:
                return f"ip {cls}", out
    keep = _kept(kind, entity)
    head, body = entity[:keep], entity[keep:]
    shape = "".join("9" if c.isdigit() else "A" for c in body)
    if kind != "card":
        space = f"{kind} {head} {shape}"
        x, n = _pattern_number(body)
        return space, head + _pattern_text(shape, shifted(key, space, n, x, by))
    # the last digit checks the others: it stays as far from the right one as it was
    right = lambda digits: next(c for c in "0123456789" if _luhn(digits + c) == 0)
    off = (int(entity[-1]) - int(right(entity[:-1]))) % 10
    space = f"card {head} {shape} {off}"
    x, n = _pattern_number(body[:-1])
    digits = head + _pattern_text(shape[:-1], shifted(key, space, n, x, by))
    return space, digits + str((int(right(digits)) + off) % 10)


#: Kinds whose replacements are drawn from spaces that grow.
OPEN = ("email", "given", "family")
ATTEMPTS = 7


def open_surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The replacement of an address or a name's word, in the same plain form, at its n-th attempt."""
    draw = Draw(key, kind, entity, attempt)
    script = "cyrillic" if re.search("[а-яё]", entity) else "latin"
    word = lambda n: "".join(_SYLLABLES[script][draw.below(len(_SYLLABLES[script]))] for _ in range(n))
    if kind == "email":
        local, _, domain = entity.partition("@")
        *labels, top = domain.split(".")
        more = "".join(str(draw.below(10)) for _ in range(4 * attempt))
        return f"{draw.like(local)}{more}@{'.'.join([draw.like(x) for x in labels] + [top])}"
    if kind.startswith("given"):
        pool = GIVEN[script, kind[6:] or "mf"[draw.below(2)]]
        names = [pool[draw.below(len(pool))] for _ in range(min(attempt, 2) + 1)]
        return "-".join([*names, *([word(3 * attempt - 3)] if attempt > 1 else [])]).casefold()
    out = word(2 + 3 * attempt)
    return out + {"ва": "ова", "на": "ина"}.get(entity[-2:], "ов") if script == "cyrillic" else out


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> tuple[str, str]:
    """(space, replacement): entities of different spaces never have the same; of an open kind, the space is empty."""
    if kind.startswith(OPEN):
        return "", open_surrogate(key, kind, entity, attempt)
    return fixed_surrogate(key, kind, entity, attempt)


def written(mention: str, kind: str, plain: str) -> str:
    """``plain`` in the format of ``mention``: its separators, or its case."""
    if kind in ("card", "phone", "ssn", "account"):
        signs = iter(plain)
        return "".join(next(signs) if re.match("[0-9A-Z]", c) else c for c in mention)
    if kind in ("email", "ip"):
        return plain.upper() if mention.isupper() else plain
    return plain.upper() if mention.isupper() and len(mention) > 1 else "-".join(p[:1].upper() + p[1:] for p in plain.split("-"))


def find_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, mentions of the rows of ``docs`` (doc_id, text) that have any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [[{"start": a, "end": b, "kind": k, "entity": e} for a, b, k, e in mentions(t)] for t in batch.column(2).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(each, kind)], names=["doc_id", "text_hash", "mentions"])

    some = docs.where(F.col("text").rlike(MAY_HOLD)).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return some.mapInArrow(found, f"doc_id long, text_hash long, mentions {_MENTION}").where(F.size("mentions") > 0)


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, plain): a replacement for each distinct entity, no two of a kind alike.

    At each of ATTEMPTS, entities whose replacement is some entity of the corpus, or
    one that is held already or that a smaller entity draws, go on to the next; only
    these are read again.  Replacements of fixed formats never meet at one attempt,
    and the spaces of names and addresses grow by some thousands each time, so few
    are left at the second.  A space of fixed format that is too full, with entities
    left after the last, has too few values that are not entities: all its entities
    then take the first attempt's, which are distinct and none its own entity's, though
    another's.  Names and addresses left after the last raise an error.
    """

    def drawn(attempt: int) -> Callable:
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [surrogate(key, k, e, attempt) for k, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["kind", "entity", "space", "plain"])

        return draw

    schema = "kind string, entity string, space string, plain string"
    family = F.substring_index("kind", "-", 1)  # given names of either gender share their space
    entities = staged(entities.select("kind", "entity").distinct(), "entities")
    taken = entities.select(family.alias("_family"), F.col("entity").alias("plain")).distinct()
    left, held = entities, []
    for attempt in range(ATTEMPTS):
        now = staged(left.mapInArrow(drawn(attempt), schema).withColumn("_family", family), "drawn")
        for other in (taken, *(h.select("_family", "plain") for h in held)):
            now = now.join(other.withColumn("_t", F.lit(True)), ["_family", "plain"], "left").withColumn("_free", F.col("_t").isNull() & F.col("_free") if "_free" in now.columns else F.col("_t").isNull()).drop("_t")
        first = now.where("_free").groupBy("_family", "plain").agg(F.min(F.struct("kind", "entity")).alias("_first"))
        judged = now.join(first, ["_family", "plain"], "left").withColumn("_held", F.col("_free") & F.col("_first").eqNullSafe(F.struct("kind", "entity")))
        judged = staged(judged.select("kind", "entity", "space", "plain", "_family", "_held"), "judged")
        held.append(judged.where("_held").drop("_held"))
        left = judged.where("not _held")
        if left.isEmpty():
            break
        if attempt + 1 == ATTEMPTS:
            if not left.where("space = ''").isEmpty():
                raise ValueError("names or addresses are left without a replacement")
            full = left.select("space").distinct()
            held = [h.join(full, "space", "left_anti") for h in held]
            again = entities.mapInArrow(drawn(0), schema).join(full, "space").withColumn("_family", family)
            return reduce(DataFrame.unionByName, [*held, again]).select("kind", "entity", "plain")
        left = left.select("kind", "entity")
    return reduce(DataFrame.unionByName, held).select("kind", "entity", "plain")


def replace_private(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities (distinct ones in the text), for every row of ``docs``.

    A null text stays null, and texts without mentions stay as they are.  Rows of one
    text have one result, repeated or not; a null doc_id stays null, and extra columns
    are left out.  Texts that can hold mentions are joined with their replacements;
    others aren't moved.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = staged(find_mentions(rows), "mentions")
    each = found.select("doc_id", "text_hash", F.explode("mentions").alias("m")).distinct()
    each = each.select("doc_id", "text_hash", "m.*")
    mapping = assign(each.select("kind", "entity"), key)
    ready = each.join(mapping, ["kind", "entity"]).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end", "kind", "entity", "plain")).alias("_swap"))
    ready = ready.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_d"), F.col("text_hash").alias("_h"), "_swap")

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, swaps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out, at = [], 0
                for s in sorted(swaps or [], key=lambda s: s["start"]):
                    out += [text[at : s["start"]], written(text[s["start"] : s["end"]], s["kind"], s["plain"])]
                    at = s["end"]
                texts.append("".join([*out, text[at:]]))
                counts.append(len({(s["kind"], s["entity"]) for s in swaps or []}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_entities"])

    may = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    on = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    changed = rows.where(may).join(ready, on, "left").select("doc_id", "text", "_swap").mapInArrow(swapped, "doc_id long, text string, n_entities long")
    return rows.where(~may).withColumn("n_entities", F.lit(0).cast("long")).unionByName(changed)


def configured_key(spark: SparkSession) -> bytes:
    """The key, from the session's KEY_SETTING; where that is unset, a fresh one, whose surrogates hold for one run."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities of every document."""
    return replace_private(table(spark, sf_dir, "documents"), configured_key(spark))
