"""Token counts of sections, from one encoding of each whole document.

Every document is encoded once with a byte-level vocabulary, whose tokens' byte
lengths give each token's span of characters.  An interval join of token spans
with section spans then counts: both are sorted, so it is a binary search.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table

RULES = ("first", "middle", "share")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("section", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("n_tokens", T.DoubleType()),
        T.StructField("n_crossing", T.LongType()),
    ]
)
#: Sections that are sent on together, about.
_ROWS = 100_000
_ENCODERS: dict[str, tuple] = {}
# White space as the vocabulary's pattern sees it, in runs too long for the pattern's own stack.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_BLANK = re.compile(f"[{_SPACES}]{{50000,}}")


def encoder(path: str):
    """The encoding of a rank file, and each id's length in bytes; loaded once in a worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODERS[path]


def encode(encoding, text: str) -> np.ndarray:
    """Ids of a whole text.  Long runs of white space are encoded apart, each as the piece that the pattern makes of it.

    The pattern takes such a run as one piece but for its last character, which
    stands before a word or alone; at the end of a text it takes all of it.
    """
    parts, at = [], 0
    for run in _LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        parts.append(np.array(encoding._encode_single_piece(text[run.start() : end]), dtype=np.uint32))
        at = end
    last = encoding.encode_to_numpy(text[at:], disallowed_special=())
    return np.concatenate([*parts, last]) if parts else last


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which tokens start and end.  A token that holds part of a character counts it whole."""
    encoding, lengths = encoder(path)
    ends = np.cumsum(lengths[encode(encoding, text)])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    begun = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
    return begun[starts] - 1, begun[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each section [lo, hi): its tokens by ``rule``, and how many cross its bounds.

    ``first``: a token belongs where its first character is.  ``middle``: where its
    middle character is (of two, the former).  ``share``: to each section in
    proportion to the characters there.  Sections that tile a text share out its
    tokens exactly; others may overlap, nest or leave gaps.
    """
    if rule == "share":
        size = np.concatenate(([0.0], np.cumsum(np.ones(len(starts)))))

        def mass(x: np.ndarray) -> np.ndarray:
            i = np.searchsorted(ends, x, side="right")  # tokens that end by x
            j = np.minimum(i, max(len(starts) - 1, 0))
            part = np.clip((x - starts[j]) / (ends[j] - starts[j]), 0, 1) if len(starts) else np.zeros(len(x))
            return size[i] + np.where(i < len(starts), part, 0)

        n = mass(hi) - mass(lo)
    else:
        at = starts if rule == "first" else (starts + ends - 1) // 2
        n = (np.searchsorted(at, hi) - np.searchsorted(at, lo)).astype(float)
    empty = hi <= lo
    touching = np.searchsorted(starts, hi) - np.searchsorted(ends, lo, side="right")
    inside = np.maximum(0, np.searchsorted(ends, hi, side="right") - np.searchsorted(starts, lo))
    return np.where(empty, 0, n), np.where(empty, 0, np.maximum(0, touching - inside)).astype(np.int64)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feeds; they tile the text, and an empty text is one empty line."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 10) + 1
    cuts = ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))
    return np.concatenate(([0], cuts[:-1])), cuts


def token_counts(docs: DataFrame, vocabulary_path: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens (by ``rule``), n_crossing.

    ``sections`` names a column of array<struct<start, end>> in code points; without
    it, lines are the sections.  A null text counts as empty, a null array as no
    sections, a null section or one with a null bound as an empty one at 0; ends
    beyond the text are cut to it.  Rows count one by one, repeated or not, a null
    doc_id stays null, and other columns are left out.  No rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                given = batch.column(2).to_pylist() if sections else None
                out: list[list[np.ndarray]] = [[] for _ in SCHEMA]
                rows = 0
                for n, text in enumerate(batch.column(1).to_pylist()):
                    text = text or ""
                    if given is None:
                        lo, hi = line_sections(text)
                    else:
                        bounds = [(s["start"], s["end"]) if s and None not in (s["start"], s["end"]) else (0, 0) for s in given[n] or []]
                        lo, hi = np.clip(np.array(bounds, dtype=np.int64).reshape(-1, 2).T, 0, len(text))
                    found, crossing = attribute(*token_spans(text, vocabulary_path), lo, hi, rule)
                    for column, values in zip(out, (np.full(len(lo), n), np.arange(len(lo)), lo, hi, found, crossing), strict=True):
                        column.append(values)
                    rows += len(lo)
                    if rows > _ROWS:
                        yield counted(batch.column(0), out)
                        out, rows = [[] for _ in SCHEMA], 0
                yield counted(batch.column(0), out)

    def counted(doc_ids: pa.Array, out: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        ids = doc_ids.take(pa.array(columns[0].astype(np.int64)))
        rest = [pa.array(c.astype(t), pa.from_numpy_dtype(t)) for c, t in zip(columns[1:], (np.int32, np.int64, np.int64, np.float64, np.int64), strict=True)]
        return pa.RecordBatch.from_arrays([ids, *rest], names=SCHEMA.names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if sections:
        columns.append(F.expr(f"transform({sections}, s -> named_struct('start', cast(s.start as bigint), 'end', cast(s.end as bigint)))").alias("sections"))
    return docs.select(*columns).mapInArrow(count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token that crosses a line's end belongs where it starts."""
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))
