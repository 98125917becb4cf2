"""Expressions over arrays whose work is about proportional to the array's length.

What a lambda's body names is evaluated again for every element, so whatever takes
a whole text or array is bound first with :func:`let`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running pass takes at once; its own arrays grow to no more.
CHUNK = 64
#: Code points of a text's segments.
SEGMENT = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(values: Column, width: int) -> Column:
    n = F.size(values)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda c: F.slice(values, c * width + 1, F.lit(width)))


def running(values: Column, op: Callable[[Column, Column], Column], first: Column) -> Column:
    """Each element joined by ``op``, which is associative, with ``first`` and all elements before it.

    Chunks are run through one by one, then the chunks' ends, so the copying that
    growing arrays cost stays within a chunk.
    """
    kind = F.array(first)
    nothing = F.slice(kind, 1, 0)
    inside = lambda chunk: F.aggregate(chunk, nothing, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.try_element_at(acc, F.lit(-1)), x)))))

    def joined(parts: Column) -> Column:
        heads = F.aggregate(parts, kind, lambda acc, p: F.concat(acc, F.array(op(F.element_at(acc, -1), F.element_at(p, -1)))))
        return let(heads, lambda h: F.flatten(F.transform(parts, lambda p, i: let(F.get(h, i), lambda b: F.transform(p, lambda x: op(b, x))))))

    return let(values, lambda v: let(F.transform(_chunks(v, CHUNK), inside), joined))


def sums(values: Column) -> Column:
    """Running sums of ints."""
    return running(values, lambda a, b: a + b, F.lit(0))


def greatest(values: Column, least: int = 0) -> Column:
    """Running maxima of ints of ``least`` or more."""
    return running(values, lambda a, b: F.greatest(a, b), F.lit(least))


def segments(text: Column) -> Column:
    """``text`` in pieces of SEGMENT code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start..end of the text that :func:`segments` made ``pieces`` of, without a walk from its beginning."""
    low = F.floor(start / SEGMENT).cast("int")
    some = F.array_join(F.slice(pieces, low + 1, F.floor(end / SEGMENT).cast("int") - low + 1), "")
    return F.when(end > start, F.substring(some, start - low * SEGMENT + 1, end - start)).otherwise("")
