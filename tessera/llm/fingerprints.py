"""Order MinHash fingerprints of documents, in DataFrame and SQL functions.

A text's tokens give k-mers, numbered by occurrence so that repeats count.  The
hashes of numbered k-mers fall into bins by their leading bits (one permutation
serves all bins); of each bin the smallest few are put back in text order and
hashed as a tuple.  Entries so depend on which k-mers a text has and on the order
they stand in, which is what edits change.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrays import let
from tessera.llm.common import staged, table

#: Scripts written without spaces, whose characters are tokens one by one.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
SPACE = r"[\x20\x09-\x0D]+"
#: Words longer than this, and all words of texts of fewer than FEW, are told apart by their runs of GRAM characters.
LONG_WORD = 24
FEW = 8
GRAM = 3
KMER = 2
BIN_BITS = 6
PICKED = 2
_VALUE_BITS = 16
#: Leading bits of a numbered k-mer's hash that entries are made of, and that no place takes.
_OWN_BITS = 33
#: Rows that a range of doc_ids should have, and the ranges that are told apart by frequency.
RANGE_ROWS = 500
RANGES = 128
_LEAST = -(1 << 63)


def tokens(text: Column) -> Column:
    """The words of ``text``, long ones (and few ones) as the overlapping runs of GRAM characters in them."""
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    grams = lambda w: F.when(F.char_length(w) > GRAM, F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))).otherwise(F.array(w))

    def split(words: Column) -> Column:
        few = F.size(words) < FEW
        long = F.exists(words, lambda w: F.char_length(w) > LONG_WORD)
        return F.when(few | long, F.flatten(F.transform(words, lambda w: F.when(few | (F.char_length(w) > LONG_WORD), grams(w)).otherwise(F.array(w))))).otherwise(words)

    return let(F.filter(F.split(spaced, SPACE, -1), lambda t: t != ""), split)


def order_minhash(text: Column, k: int = KMER, bin_bits: int = BIN_BITS, picked: int = PICKED) -> Column:
    """Array of ints, one for each bin that has k-mers: bin * 65536 + 16 bits of its tuple's hash.

    A null text counts as empty and has no entries; a text of fewer than ``k``
    tokens has one k-mer of all of them.  Hashes and places share a long, so that
    arrays of plain numbers are sorted: places have as many bits as the text's
    length asks for, hashes the rest, of which entries use the leading 33.  Of equal
    hashes the one that stands first is picked.
    """
    bits = lambda a: F.least(F.lit(64 - _OWN_BITS), F.length(F.bin(F.size(a).cast("long"))))

    def kmers(h: Column) -> Column:
        n = F.greatest(F.size(h) - (k - 1), F.least(F.size(h), F.lit(1)))
        return F.transform(F.slice(h, 1, n), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))

    def entries(grams: Column) -> Column:
        return let(F.call_function("shiftleft", F.lit(1).cast("long"), bits(grams)) - 1, lambda mask: of_masked(grams, mask))

    def of_masked(grams: Column, mask: Column) -> Column:
        pack = lambda h, at: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(at.bitwiseAND(mask))
        whole = lambda x: F.get(grams, x.bitwiseAND(mask).cast("int"))  # noqa: E731  the k-mer at a place

        def numbered(a: Column) -> Column:
            """Equal k-mers stand together in ``a``: a k-mer's number is its place in its run."""
            own = F.bitwise_not(mask)
            starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x.bitwiseAND(own) != F.get(a, i - 1).bitwiseAND(own)), i)), lambda i: i.isNotNull())
            runs = let(starts, lambda s: F.transform(s, lambda x, j: F.sequence(F.lit(0), F.coalesce(F.get(s, j + 1), F.size(a)) - x - 1)))
            return F.zip_with(a, F.flatten(runs), lambda x, o: pack(F.xxhash64(whole(x), o), x))

        def smallest(b: Column) -> Column:
            """The picked of each bin, as structs that sort by bin and place."""
            own_bin = lambda x: F.shiftrightunsigned(x, 64 - bin_bits)
            kept = F.filter(b, lambda x, i: (i < picked) | (own_bin(F.get(b, i - picked)) != own_bin(x)))
            return F.sort_array(F.transform(kept, lambda x: F.struct(own_bin(x).cast("int").alias("bin"), x.bitwiseAND(mask).alias("at"), F.shiftrightunsigned(x, 64 - _OWN_BITS).alias("h"))))

        packed = F.transform(grams, lambda x, i: pack(x, i.cast("long")))
        return let(let(let(F.sort_array(packed), lambda a: F.sort_array(numbered(a))), smallest), tuples)

    def tuples(c: Column) -> Column:
        same = lambda x, y: F.when(y["bin"] == x["bin"], y["h"])

        def entry(x: Column, i: Column) -> Column:
            value = F.xxhash64(x["h"], *(same(x, F.get(c, i + j)) for j in range(1, picked)))
            packed = x["bin"] * (1 << _VALUE_BITS) + value.bitwiseAND((1 << _VALUE_BITS) - 1).cast("int")
            return F.when((i == 0) | (F.get(c, i - 1)["bin"] != x["bin"]), packed)

        return F.filter(F.transform(c, entry), lambda e: e.isNotNull())

    hashes = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t))
    return let(let(hashes, kmers), entries)


def likeness(a: Column, b: Column) -> Column:
    """Equal entries of the bins that either has, in 0..1; 1 where both have none."""
    bins = lambda e: F.transform(e, lambda x: F.shiftright(x, _VALUE_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(entries: Column) -> Column:
    """Six hexadecimal digits for each entry."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))), "")


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
    """``derive(docs)`` with next_<c> for each column: of the row that follows in descending doc_id.

    ``docs`` has doc_id and text, and ``derive`` adds columns row by row.  The first
    row follows the last; a null doc_id counts as the smallest long, and rows of one
    doc_id stand in the order of a hash of their texts, then of the texts.  Rows are
    shuffled once, by ranges of doc_id: RANGES of about equal frequency, each cut
    evenly as far as its rows ask for; a doc_id that fills several of them alone is
    cut by that hash.  What a range's last row needs, the first of the next range,
    is found in two levels (in each of the RANGES, then among their firsts) and
    looked up by doc_id and hash.
    """
    at, turned = F.coalesce(F.col("doc_id"), F.lit(_LEAST)), F.bitwise_not(F.xxhash64("text"))  # both descend
    quantiles = [i / RANGES for i in range(1, RANGES)]
    n, least, most, found = docs.select(at.alias("at")).agg(F.count("*"), F.min("at"), F.max("at"), F.percentile_approx("at", quantiles, 10_000)).first()
    cuts = sorted({least or 0, *(found or [])})
    ends = [*cuts[1:], most or 0]
    parts = 1 + n // (RANGE_ROWS * len(cuts))
    hot = {c: times * (1 + n // (RANGE_ROWS * RANGES)) for c, times in Counter(found or []).items() if times > 1}
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    low, widths = longs(cuts), F.array(*(F.lit(float(max(1, b - a + 1))) for a, b in zip(cuts, ends, strict=True)))
    coarse = F.size(F.filter(low, lambda c: c <= at)) - 1
    share = lambda x, most: F.least(F.floor(x * most), most - 1).cast("long")
    inside_id = share(turned.cast("double") / F.lit(2.0**64) + 0.5, F.coalesce(F.get(longs(hot.values()), F.array_position(longs(hot), at).cast("int") - 1), F.lit(1)).cast("long")) if hot else F.lit(0).cast("long")
    fine = let(coarse, lambda i: share((at.cast("double") - F.get(low, i).cast("double")) / F.get(widths, i), F.lit(parts).cast("long")))
    # a hot doc_id has a place of its own between those of smaller and of larger ones
    above = F.when(at > F.array_max(F.filter(longs(hot), lambda h: h <= at)), 1).otherwise(0) if hot else F.lit(0)
    hot_at = F.array_max(F.filter(longs(hot), lambda h: h <= at)) if hot else F.lit(None).cast("long")
    # one plain column, so that the join below finds rows where the window has put them
    key = F.concat_ws(":", coarse, fine, F.coalesce(hot_at, F.lit(_LEAST)), above, inside_id)
    ranged = lambda df: df.withColumn("_range", key)
    place = F.struct(at.alias("at"), turned.alias("turned"))
    inside = Window.partitionBy("_range").orderBy(at.desc(), turned.desc(), F.col("text"))
    # one lead for each column: a struct would be built, and its text moved twice, before the shuffle
    rows = ranged(derive(docs)).select("*", *(F.lead(c).over(inside).alias(f"next_{c}") for c in columns), F.lead(F.lit(True)).over(inside).alias("_inside"))
    tops = ranged(docs.select("doc_id", "text")).groupBy("_range").agg(F.max(place).alias("_top"), F.min(coarse).alias("_part"))
    tops = staged(tops, "tops")
    # of each of the RANGES, the first row of all; the last of it is followed by the first of the one below
    firsts_of = tops.groupBy(F.col("_part").alias("_i")).agg(F.max("_top").alias("_first"))  # RANGES rows at most
    below = Window.partitionBy(F.lit(0)).orderBy(F.desc("_i"))
    all_of = Window.partitionBy(F.lit(0))
    after = firsts_of.select("_i", F.coalesce(F.lead("_first").over(below), F.max("_first").over(all_of)).alias("_after"))
    downward = Window.partitionBy("_part").orderBy(F.desc("_top"))
    following = tops.withColumn("_lead", F.lead("_top").over(downward)).join(after, F.col("_part") == F.col("_i"))
    following = staged(following.select(F.col("_range").alias("_from"), F.coalesce("_lead", "_after").alias("_to")), "ranges")
    firsts = docs.join(following, (at == F.col("_to.at")) & (turned == F.col("_to.turned"))).groupBy("_from").agg(F.min("text").alias("text"))
    firsts = derive(firsts.withColumn("doc_id", F.lit(None).cast("long"))).select("_from", *(F.col(c).alias(f"_first_{c}") for c in columns))
    # rows lie by _range already, so they stay where they are, and each range has one first
    joined = rows.join(firsts, F.col("_range") == F.col("_from"), "left")
    kept = [c for c in rows.columns if c not in ("_range", "_inside", *(f"next_{c}" for c in columns))]
    return joined.select(*kept, *(F.when(F.col("_inside"), F.col(f"next_{c}")).otherwise(F.col(f"_first_{c}")).alias(f"next_{c}") for c in columns))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty; two texts without words have a likeness of 1.  A
    single document is its own next one; rows of one doc_id or of none stand as
    :func:`with_next` says.  No rows give no rows.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    paired = with_next(docs, lambda d: d.withColumn("entries", order_minhash(F.col("text"))), "text", "entries").withColumn("edited", F.concat(F.substring("text", 1, n - half), F.substring("next_text", F.lit(1), half)))
    paired = paired.withColumn("edited_entries", order_minhash(F.col("edited")))
    return paired.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("entries")).alias("fingerprint"), as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
