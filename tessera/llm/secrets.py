"""Secret scans with multipart credential linking, in DataFrame and SQL functions.

Three strong kinds of span are found in every text.  Weak kinds (a login name, an
opaque token, an endpoint, an assigned value or access id too short to be strong) are
parts of a credential that mean little alone: an interval join with the scopes of all
parts, strong or weak, reports a weak one only where a part that complements it stands
in the same scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrays import cut, greatest, let, segments, sums
from tessera.llm.common import clash_free, staged, table

# The strong kinds, in order, with the group whose length counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
STRONG = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
# A run that fails is dropped whole, so for kinds that are one run only the long ones need be looked for.
LONG_RUNS = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

#: Schemes of endpoints end within 64 signs, as long runs of letters would else take the square of their length.
#: Weak kinds: pattern, the kinds of which one must be in scope, and the group that must be shorter than so much.
WEAK = (
    ("login", r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", ("assign", "access", "hex", "opaque", "short_assign"), 0, 0),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?!AKIA)(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", ("access", "login", "endpoint", "short_access"), 0, 0),
    ("endpoint", r"[A-Za-z][A-Za-z0-9+.-]{0,63}+://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])", ("assign", "access", "hex", "opaque", "short_assign"), 0, 0),
    ("short_assign", ASSIGN, ("access", "login", "endpoint", "short_access"), 2, 12),
    ("short_access", ACCESS, ("assign", "hex", "opaque", "short_assign"), 0, 18),
)
#: What a text with a match must hold, where that is found faster.
SIGNS = {
    "login": r"""[:=]\x20*["']?[A-Za-z0-9@._-]{3}""", "opaque": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}",
    "endpoint": r"://|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]", "short_assign": r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
}
ORDER = [k[0] for k in (*STRONG, *WEAK)]
#: Code points before and after a part that its scope reaches, within its paragraph; without a reach, the whole paragraph.
REACH = 200
#: Scopes that are whole paragraphs are cut into bins of so many code points.
PARAGRAPH_BIN = 4096

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0, below: int = 0) -> Column:
    """Leftmost non-overlapping matches as sorted structs (start, kind, end), in code points.

    What stands between matches comes from a split at the same pattern, so lengths
    summed up give places.  ``group`` is looked at in each match by itself; patterns
    with one need nothing from outside a match.  Texts without a match pay for one search.
    """
    number = F.lit(ORDER.index(kind))

    def placed(found: Column) -> Column:
        lengths = F.slice(F.zip_with(F.split(text, pattern, -1), found, lambda b, m: F.char_length(b) + F.coalesce(F.char_length(m), F.lit(0))), 1, F.size(found))
        return let(sums(lengths), lambda ends: F.zip_with(found, ends, lambda m, e: F.struct((e - F.char_length(m)).alias("start"), number.alias("kind"), e.alias("end"), m.alias("m"))))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if below or (least and kind not in LONG_RUNS):
        size = lambda s: F.char_length(F.regexp_extract(s["m"], pattern, group) if group else s["m"])
        spans = F.filter(spans, lambda s: size(s) < below if below else size(s) >= least)
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(SIGNS.get(kind, pattern)), bare).otherwise(F.array().cast(_SPAN))


def strong_spans(text: Column) -> Column:
    return F.concat(*(matches(text, kind, LONG_RUNS.get(kind, pattern), group, least) for kind, pattern, group, least in STRONG))


def _of(spans: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*(ORDER.index(k) for k in kinds)))


def weak_spans(text: Column) -> Column:
    return F.concat(*(matches(text, kind, pattern, group, below=below) for kind, pattern, _, group, below in WEAK))


def linkable(strong: str, weak: str) -> Column:
    """The weak spans whose complement stands somewhere in the same text; no other can be linked."""
    has = lambda needs: (F.size(_of(strong, needs)) > 0) | (F.size(_of(weak, needs)) > 0)
    return F.concat(*(F.when(has(needs), _of(weak, (kind,))).otherwise(F.array().cast(_SPAN)) for kind, _, needs, *_ in WEAK))


def scopes(text: Column, spans: Column, reach: int | None) -> Column:
    """For each of ``spans``: kind, start, end, and lo..hi, its paragraph, or what of it lies within ``reach``.

    No part holds a line feed, so each stands in one paragraph.  Parts and ends of
    paragraphs are put in one order, in which running counts tell each part its own.
    """
    gap = 2  # code points between paragraphs
    breaks = lambda text: sums(F.transform(F.split(text, "\n\n", -1), lambda p: F.char_length(p) + gap))  # noqa: E731  past each paragraph and its break

    def scoped(ends: Column) -> Column:
        # an end of a paragraph stands before all that starts there
        marks = F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: F.struct(e.alias("start"), F.lit(-1).alias("kind"), e.alias("end")))
        return let(F.sort_array(F.concat(marks, spans)), lambda all_: let(sums(F.transform(all_, lambda s: (s["kind"] < 0).cast("int"))), lambda at: F.filter(F.zip_with(all_, at, lambda s, n: one(s, n, ends)), lambda s: s["kind"] >= 0)))

    def one(s: Column, n: Column, ends: Column) -> Column:
        lo, hi = F.when(n > 0, F.get(ends, n - 1)).otherwise(0), F.get(ends, n) - gap
        if reach:
            lo, hi = F.greatest(lo, s["start"] - reach), F.least(hi, s["end"] + reach)
        return F.struct(s["kind"].alias("kind"), lo.alias("lo"), hi.alias("hi"), s["start"].alias("start"), s["end"].alias("end"))

    return let(breaks(F.coalesce(text, F.lit(""))), scoped)


def find_parts(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """doc_id, text_hash, strong (sorted spans), weak (spans), scopes of both.

    A null text counts as empty.  Weak parts are looked for in every text; those
    that no part of the text could complement are left out, as are extra columns of ``docs``.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("strong", F.sort_array(strong_spans(F.col("text")))).withColumn("weak", weak_spans(F.col("text")))
    out = base.withColumn("weak", linkable("strong", "weak"))
    out = out.withColumn("scopes", F.when(F.size("weak") > 0, scopes(F.col("text"), F.concat("strong", "weak"), reach)))
    return out.select("doc_id", F.xxhash64("text").alias("text_hash"), "strong", "weak", "scopes")


def link_parts(parts: DataFrame, reach: int | None = REACH) -> DataFrame:
    """doc_id, text_hash, added: the weak spans that overlap the scope of a complement.

    Two weak parts must stand apart, so that a token in an address or a login's own
    value is no complement; only a short assignment may be in an address.  Scopes and
    spans are cut into bins of twice the reach, so the join has equal keys and no bin
    holds more than fits in its length.  Parts of a kind with the same scope, as all in
    a paragraph have, go as one, with their first end and last start.  ``parts`` is read twice.
    """
    width = 2 * reach if reach else PARAGRAPH_BIN
    some = parts.where(F.size("weak") > 0).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    key = ["doc_id", "text_hash"]
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor((F.greatest(hi, lo + 1) - 1) / width)))
    left = some.select(*key, F.explode("weak").alias("w")).withColumn("bin", bins(F.col("w.start"), F.col("w.end")))
    right = some.select(*key, F.inline("scopes")).groupBy(*key, "kind", "lo", "hi").agg(F.min("end").alias("first_end"), F.max("start").alias("last_start"))
    right = right.select(*key, F.struct("kind", "lo", "hi", "first_end", "last_start").alias("s")).withColumn("bin", bins(F.col("s.lo"), F.col("s.hi")))
    right = right.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("bin").alias("_b"), "s")
    complements = [(F.col("w.kind") == ORDER.index(kind)) & F.col("s.kind").isin(*(ORDER.index(k) for k in needs)) for kind, _, needs, *_ in WEAK]
    inside = [(F.col("w.kind") == ORDER.index(a)) & (F.col("s.kind") == ORDER.index(b)) for a, b in (("endpoint", "short_assign"), ("short_assign", "endpoint"))]
    apart = (F.col("s.kind") < len(STRONG)) | (F.col("s.first_end") <= F.col("w.start")) | (F.col("s.last_start") >= F.col("w.end")) | inside[0] | inside[1]
    meets = (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_t")) & (F.col("bin") == F.col("_b"))
    meets &= (F.col("w.start") < F.col("s.hi")) & (F.col("w.end") > F.col("s.lo")) & reduce(lambda a, b: a | b, complements) & apart
    linked = left.join(right, meets, "left_semi")
    return linked.groupBy(*key).agg(F.collect_set("w").alias("added"))


def scan(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """One row per document: doc_id, text_hash, strong and added spans (start, kind number in ORDER, end)."""
    parts = staged(find_parts(docs, reach), "parts")
    added = link_parts(parts, reach).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "added")
    on = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("_d")) & (F.col("text_hash") == F.col("_t"))
    out = parts.join(added, on, "left")
    return out.select("doc_id", "text_hash", "strong", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in order, joined by commas."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def mask(text: Column, spans: Column, sign: str = "[{}]") -> Column:
    """``text`` with each span replaced by its kind's sign; spans that overlap become one, named by the first."""
    names = F.array(*(F.lit(sign.format(k.upper())) for k in ORDER))

    def masked(ordered: Column) -> Column:
        return let(greatest(F.transform(ordered, lambda s: s["end"])), lambda ends: let(segments(text), lambda pieces: whole(ordered, ends, pieces)))

    def whole(ordered: Column, ends: Column, pieces: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        kept = lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(pieces, before(i), s["start"]), F.get(names, s["kind"]))).otherwise("")
        return F.concat(F.array_join(F.transform(ordered, kept), ""), cut(pieces, F.element_at(ends, -1), F.char_length(text)))

    return F.when(F.size(spans) > 0, let(F.sort_array(spans), masked)).otherwise(text)


def redact(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """``docs`` with every strong and every linked weak span of ``text`` replaced by its kind's sign.

    Patterns are run once: rows are written aside with their spans.  Texts without a
    weak part that some other part of them could complement are then done in place;
    only the rest are joined with their links.  A null text stays null, a text
    without spans as it is; repeated rows are each masked, and a null doc_id is a
    doc_id like others.  Extra columns stay, whatever their names.
    """
    strong, weak = clash_free(docs, "_strong", "_weak")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(_SPAN)
    found = docs.withColumn(strong, F.sort_array(strong_spans(text))).withColumn(weak, weak_spans(text))
    found = staged(found.withColumn(weak, linkable(strong, weak)), "spans")
    done = found.where(F.size(weak) == 0).withColumn("text", mask(F.col("text"), F.col(strong))).select(*docs.columns)
    rest = found.where(F.size(weak) > 0)
    parts = rest.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col(weak).alias("weak"),
        scopes(F.col("text"), F.concat(strong, weak), reach).alias("scopes"),
    )
    added = link_parts(parts, reach).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("added").alias("_added"))
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("_d")) & (F.xxhash64("text") == F.col("_t"))
    linked = rest.join(added, on, "left").withColumn("text", mask(F.col("text"), F.concat(F.col(strong), F.coalesce("_added", none))))
    return done.unionByName(linked.select(*docs.columns))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    A null text counts as empty, and a text without spans has the hash of nothing.
    Rows of equal doc_id and text have equal results; a null doc_id stays null.
    """
    found = scan(table(spark, sf_dir, "documents"), reach=None)
    counts = [F.size(_of("strong", (k,))).cast("long").alias(f"n_{k}") for k, *_ in STRONG]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.concat("strong", "added")).alias("spans"), F.size("added").cast("long").alias("n_linked")
    )
