"""Wire bytes taken apart with numpy, a field of all messages of a batch at a time.

Each step reads one tag and what follows it from every message that has bytes left,
and notes where the wanted fields' contents lie; columns are then made of these.
What is rare is left to the runtime by raising :class:`Odd`: groups, messages given
in several parts, missing required fields, repeated map keys, and all that is wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from google.protobuf.descriptor import Descriptor, FieldDescriptor

from tessera.plans.descriptors import is_map, is_repeated, is_required

_K = FieldDescriptor
_PAD = 32
_FIXED = {_K.TYPE_FIXED32: "<i4", _K.TYPE_SFIXED32: "<i4", _K.TYPE_FLOAT: "<f4", _K.TYPE_FIXED64: "<i8", _K.TYPE_SFIXED64: "<i8", _K.TYPE_DOUBLE: "<f8"}
_LONG = (_K.TYPE_STRING, _K.TYPE_BYTES, _K.TYPE_MESSAGE)
# A field's contents as found: step, wire type, rows, where they start (or the number itself), where they end.
Found = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


class Odd(Exception):
    """Something that the runtime has to look at."""


def struct_of(raw: pa.Array, descriptor: Descriptor, kind: pa.StructType) -> pa.StructArray:
    """One raw struct of ``kind`` for each message of a binary array, as ``wire.messages_to_struct`` makes it."""
    n = len(raw)
    if not n or not kind.num_fields:
        raise Odd
    wide = np.dtype("<i8" if pa.types.is_large_binary(raw.type) else "<i4")
    offsets = np.frombuffer(raw.buffers()[1], dtype=wide)[raw.offset : raw.offset + n + 1].astype(np.int64)
    held = raw.buffers()[2]
    data = np.zeros(int(offsets[-1] - offsets[0]) + _PAD, dtype=np.uint8)
    if held is not None:
        data[:-_PAD] = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    missing = raw.is_null().to_numpy(zero_copy_only=False)
    return _struct(data, offsets[:-1], np.where(missing, offsets[:-1], offsets[1:]), descriptor, kind, missing)


def _varints(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers at ``at``, and where they end."""
    byte = data[at]
    value, at = (byte & 0x7F).astype(np.uint64), at + 1
    rows, shift = np.flatnonzero(byte >= 128), 7
    while len(rows):
        if shift > 63:
            raise Odd
        byte = data[at[rows]]
        value[rows] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
        at[rows] += 1
        rows, shift = rows[byte >= 128], shift + 7
    if (at > stop).any():
        raise Odd
    return value, at


def _scan(data: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: set[int]) -> dict[int, list[Found]]:
    out: dict[int, list[Found]] = {n: [] for n in wanted}
    live = np.flatnonzero(start < end)
    at, stop, step = start[live], end[live], 0
    while len(live):
        tags, at = _varints(data, at, stop)
        for tag in tags[:1] if (tags == tags[0]).all() else np.unique(tags):
            some = slice(None) if len(tags) == 1 or (tags == tag).all() else np.flatnonzero(tags == tag)
            number, wire = int(tag) >> 3, int(tag) & 7
            what, limit = at[some].copy(), stop[some]
            if wire == 0:
                what, past = _varints(data, what, limit)
            elif wire == 2:
                size, what = _varints(data, what, limit)
                if (size > len(data)).any():
                    raise Odd
                past = what + size.astype(np.int64)
            elif wire in (1, 5):
                past = what + (8 if wire == 1 else 4)
            else:
                raise Odd
            if not number or (past > limit).any():
                raise Odd
            at[some] = past
            if number in out:
                out[number].append((step, wire, live[some], what, past))
        going = at < stop
        if not going.all():
            live, at, stop = live[going], at[going], stop[going]
        step += 1
    return out


def _gathered(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans, one after another, and where each starts among them."""
    sizes = hi - lo
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    if offsets[-1] >= 1 << 31:
        raise Odd
    return data[np.repeat(lo - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def _numbers(data: np.ndarray, what: np.ndarray, fd: FieldDescriptor) -> np.ndarray:
    """Values of what :func:`_scan` found: numbers, or places of fixed ones."""
    if fd.type in _FIXED:
        kind = np.dtype(_FIXED[fd.type])
        return np.ascontiguousarray(data[what[:, None] + np.arange(kind.itemsize)]).view(kind).reshape(-1)
    if fd.type == _K.TYPE_BOOL:
        return what != 0
    if fd.type == _K.TYPE_SINT64:
        return ((what >> np.uint64(1)) ^ (np.uint64(0) - (what & np.uint64(1)))).view(np.int64)
    if fd.type in (_K.TYPE_INT64, _K.TYPE_UINT64):
        return what.view(np.int64)
    low = (what & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    if fd.type == _K.TYPE_SINT32:
        low = (low >> np.uint32(1)) ^ (np.uint32(0) - (low & np.uint32(1)))
    return low.view(np.int32)


def _wire_of(fd: FieldDescriptor) -> int:
    return 2 if fd.type in _LONG else 0 if fd.type not in _FIXED else 5 if _FIXED[fd.type][-1] == "4" else 1


def _unpacked(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, fd: FieldDescriptor) -> tuple[np.ndarray, np.ndarray]:
    """Values of packed spans, and the span that each is in."""
    raw, offsets = _gathered(data, lo, hi)
    if fd.type in _FIXED:
        kind = np.dtype(_FIXED[fd.type])
        if ((hi - lo) % kind.itemsize).any():
            raise Odd
        return raw.view(kind), np.repeat(np.arange(len(lo)), (hi - lo) // kind.itemsize)
    ends = np.flatnonzero(raw < 128)
    if (raw[offsets[1:][hi > lo] - 1] >= 128).any():
        raise Odd
    starts = np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1))
    sizes = ends - starts + 1
    if (sizes > 10).any():
        raise Odd
    value = np.zeros(len(ends), dtype=np.uint64)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        value[some] |= (raw[starts[some] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return _numbers(data, value, fd), np.searchsorted(offsets, starts, side="right") - 1


def _bytes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: pa.DataType, there: np.ndarray | None) -> pa.Array:
    raw, offsets = _gathered(data, lo, hi)
    if pa.types.is_string(kind) and (raw >= 128).any():
        some = raw[offsets[:-1][hi > lo]]
        if ((some & 0xC0) == 0x80).any():
            raise Odd
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:
            raise Odd from None
    valid = None if there is None else pa.array(there).buffers()[1]
    return pa.Array.from_buffers(kind, len(lo), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def _values(data: np.ndarray, fd: FieldDescriptor, kind: pa.DataType, lo: np.ndarray, hi: np.ndarray, values: np.ndarray | None, there: np.ndarray | None) -> pa.Array:
    """An array of a field's single values; ``there`` tells which are not null."""
    if fd.message_type is not None:
        return _struct(data, lo, hi, fd.message_type, kind, np.zeros(len(lo), bool) if there is None else ~there)
    if values is None:
        return _bytes(data, lo, hi, kind, there)
    return pa.array(values, kind, mask=None if there is None else ~there)


def _single(data: np.ndarray, n: int, fd: FieldDescriptor, found: list[Found]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """lo, hi, values, and the step that each row's last one came at (-1: none)."""
    last = np.full(n, -1, dtype=np.int64)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    values = None if fd.type in _LONG else np.zeros(n, dtype=_numbers(data, np.zeros(0, np.int64 if fd.type in _FIXED else np.uint64), fd).dtype)
    for step, wire, rows, what, past in found:
        if wire != _wire_of(fd):
            continue
        if fd.message_type is not None and (last[rows] >= 0).any():
            raise Odd  # parts to be merged
        last[rows] = step
        if values is None:
            lo[rows], hi[rows] = what, past
        else:
            values[rows] = _numbers(data, what, fd)
    return lo, hi, values, last


def _many(data: np.ndarray, n: int, fd: FieldDescriptor, found: list[Found]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """lo, hi, values of all elements in their rows' order, and the offsets of the rows."""
    rows, steps, parts = [], [], []
    for step, wire, at, what, past in found:
        if wire == _wire_of(fd):
            parts.append((what, past) if fd.type in _LONG else (_numbers(data, what, fd),))
            rows.append(at)
        elif wire == 2 and fd.type not in _LONG:
            values, span = _unpacked(data, what, past, fd)
            parts.append((values,))
            rows.append(at[span])
        else:
            continue
        steps.append(np.full(len(rows[-1]), step))
    if not parts:
        none = np.zeros(0, np.int64)
        values = None if fd.type in _LONG else _numbers(data, np.zeros(0, np.int64 if fd.type in _FIXED else np.uint64), fd)
        return none, none, values, np.zeros(n + 1, np.int32)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    row = np.concatenate(rows)
    if len(parts) > 1:
        order = np.lexsort((np.concatenate(steps), row))
        columns = [c[order] for c in columns]
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return (*columns, None, offsets) if fd.type in _LONG else (columns[0], columns[0], columns[0], offsets)


def _column(data: np.ndarray, n: int, fd: FieldDescriptor, kind: pa.DataType, found: dict[int, list[Found]]) -> pa.Array:
    mine = found[fd.number]
    if is_map(fd):
        lo, hi, _, offsets = _many(data, n, fd, mine)
        entry = fd.message_type
        inner = _scan(data, lo, hi, {1, 2})
        sides = []
        for name, side in (("key", kind.key_type), ("value", kind.item_type)):
            part = entry.fields_by_name[name]
            a, b, values, _ = _single(data, len(lo), part, inner[part.number])
            sides.append(_values(data, part, side, a, b, values, None))
        several = np.flatnonzero(np.diff(offsets) > 1)
        if len(several):
            keys = sides[0].to_pylist()
            if any(len(set(keys[offsets[r] : offsets[r + 1]])) < offsets[r + 1] - offsets[r] for r in several.tolist()):
                raise Odd
        return pa.MapArray.from_arrays(pa.array(offsets), *sides, type=kind)
    if is_repeated(fd):
        lo, hi, values, offsets = _many(data, n, fd, mine)
        return pa.ListArray.from_arrays(pa.array(offsets), _values(data, fd, kind.value_type, lo, hi, values, None), type=kind)
    lo, hi, values, last = _single(data, n, fd, mine)
    if fd.containing_oneof is not None:
        for other in fd.containing_oneof.fields:
            if other.number != fd.number:
                last = np.where(_single(data, n, other, found[other.number])[3] > last, -1, last)
    present = fd.message_type is not None or (fd.has_presence and not is_required(fd))
    return _values(data, fd, kind, lo, hi, values, last >= 0 if present else None)


def _struct(data: np.ndarray, start: np.ndarray, end: np.ndarray, descriptor: Descriptor, kind: pa.StructType, missing: np.ndarray) -> pa.StructArray:
    if not kind.num_fields:
        return pa.array([None if x else {} for x in missing.tolist()], kind)
    n = len(start)
    fields = [descriptor.fields_by_name[f.name] for f in kind]
    needed = {fd.number for fd in descriptor.fields if is_required(fd)}
    wanted = needed | {other.number for fd in fields for other in (fd.containing_oneof.fields if fd.containing_oneof is not None else (fd,))}
    end = np.where(missing, start, end)
    found = _scan(data, start, end, wanted)
    for fd in descriptor.fields:
        if fd.number in needed and (missing | (_single(data, n, fd, found[fd.number])[3] >= 0)).sum() < n:
            raise Odd
    columns = [_column(data, n, fd, f.type, found) for fd, f in zip(fields, kind, strict=True)]
    return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array(missing))
