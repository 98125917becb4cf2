"""Raw structs put into wire bytes with numpy, a field of all messages of a batch at a time.

Each field gives the bytes that it adds to each message; these pieces are then laid
side by side, in the order of the fields' numbers, as the runtime writes them.  What
is rare is left to the runtime by raising :class:`Odd`: maps of several entries, two
members of one oneof, nulls in arrays, null required fields.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from google.protobuf.descriptor import Descriptor, FieldDescriptor

from tessera.operators.wireread import _FIXED, _LONG, Odd, _wire_of
from tessera.plans.descriptors import is_map, is_repeated, is_required

_K = FieldDescriptor
Pieces = tuple[np.ndarray, np.ndarray]  # all bytes one after another, and how many each row has


def wire_of(structs: pa.StructArray, descriptor: Descriptor) -> pa.Array:
    """Wire bytes of each struct, null for null, as the runtime's deterministic ones."""
    valid = structs.is_valid().to_numpy(zero_copy_only=False)
    some = structs if valid.all() else structs.filter(pa.array(valid))
    raw, sizes = _messages(some, descriptor)
    lengths = np.zeros(len(structs), np.int64)
    lengths[valid] = sizes
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    if offsets[-1] >= 1 << 31:
        raise Odd
    return pa.Array.from_buffers(pa.binary(), len(structs), [None if valid.all() else pa.array(valid).buffers()[1], pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def _beside(*pieces: Pieces) -> Pieces:
    """The pieces of each row, one after another."""
    sizes = np.sum([p[1] for p in pieces], axis=0, dtype=np.int64) if pieces else np.zeros(0, np.int64)
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    for raw, each in pieces:
        if len(raw):
            if len(raw) == len(each) * each[0] and (each == each[0]).all():
                out[(at[:, None] + np.arange(each[0])).reshape(-1)] = raw
            else:
                out[np.repeat(at - (np.cumsum(each) - each), each) + np.arange(len(raw))] = raw
        at += each
    return out, sizes


def _varints(values: np.ndarray) -> Pieces:
    sizes = np.ones(len(values), np.int64)
    top = int(values.max(initial=0))
    for k in range(1, 10):
        if top >> (7 * k):
            sizes += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(sizes)
    raw = np.empty(int(sizes.sum()), dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        more = np.where(sizes[some] > k + 1, 0x80, 0).astype(np.uint8)
        raw[(ends - sizes)[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return raw, sizes


def _tag(fd: FieldDescriptor, n: int, wire: int | None = None) -> Pieces:
    raw, _ = _varints(np.array([fd.number << 3 | (_wire_of(fd) if wire is None else wire)], dtype=np.uint64))
    return np.tile(raw, n), np.full(n, len(raw), np.int64)


def _number_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _numbers(values: np.ndarray, fd: FieldDescriptor) -> Pieces:
    if fd.type in _FIXED:
        kind = np.dtype(_FIXED[fd.type])
        return np.ascontiguousarray(values.astype(kind)).view(np.uint8), np.full(len(values), kind.itemsize, np.int64)
    if fd.type in (_K.TYPE_SINT32, _K.TYPE_SINT64):
        wide = values.astype(np.int64)
        return _varints(((wide << 1) ^ (wide >> 63)).view(np.uint64))
    if fd.type == _K.TYPE_UINT32:
        return _varints(values.astype(np.int32).view(np.uint32).astype(np.uint64))
    return _varints(values.astype(np.int64).view(np.uint64))


def _plain_bytes(column: pa.Array) -> Pieces:
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if held is None else np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, np.diff(offsets)


def _sized(pieces: Pieces) -> Pieces:
    return _beside(_varints(pieces[1].astype(np.uint64)), pieces)


def _contents(column: pa.Array, fd: FieldDescriptor) -> Pieces:
    """What follows the tag of each value; ``column`` has no nulls."""
    if fd.message_type is not None:
        return _sized(_messages(column, fd.message_type))
    if fd.type in _LONG:
        return _sized(_plain_bytes(column))
    return _numbers(_number_array(column), fd)


def _elements(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The child array's places of all rows that are not null, one after another, and how many each row has."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(offsets), 0)
    at = np.cumsum(sizes) - sizes
    return np.repeat(offsets[:-1] - at, sizes) + np.arange(int(sizes.sum())), sizes


def _taken(child: pa.Array, places: np.ndarray) -> pa.Array:
    if len(places) and places[-1] - places[0] + 1 == len(places) and (np.diff(places) == 1).all():
        return child.slice(int(places[0]), len(places))
    return child.take(pa.array(places))


def _by_row(pieces: Pieces, sizes: np.ndarray) -> Pieces:
    """Pieces of elements as those of the rows that have ``sizes`` elements each."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(pieces[1])))
    upto = np.cumsum(sizes)
    return pieces[0], ends[upto] - ends[upto - sizes]


def _entry_side(column: pa.Array, fd: FieldDescriptor) -> Pieces:
    """A key or value of map entries, always written; a null value is the default."""
    if column.null_count:
        if fd.message_type is not None:
            raise Odd
        column = column.fill_null("" if fd.type == _K.TYPE_STRING else b"" if fd.type == _K.TYPE_BYTES else False if fd.type == _K.TYPE_BOOL else 0)
    return _beside(_tag(fd, len(column)), _contents(column, fd))


def _field(column: pa.Array, fd: FieldDescriptor) -> Pieces:
    n = len(column)
    if is_map(fd):
        places, sizes = _elements(column)
        if (sizes > 1).any():
            raise Odd  # entries stand in the order of their keys
        key, value = (fd.message_type.fields_by_name[x] for x in ("key", "value"))
        entries = _sized(_beside(_entry_side(_taken(column.keys, places), key), _entry_side(_taken(column.items, places), value)))
        return _by_row(_beside(_tag(fd, len(places)), entries), sizes)
    if is_repeated(fd):
        places, sizes = _elements(column)
        child = _taken(column.values, places)
        if child.null_count:
            raise Odd
        if not fd.is_packed:
            return _by_row(_beside(_tag(fd, len(places)), _contents(child, fd)), sizes)
        raw, each = _by_row(_contents(child, fd), sizes)
        return _spread(_beside(_tag(fd, int((sizes > 0).sum()), 2), _sized((raw, each[sizes > 0]))), sizes > 0)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if is_required(fd) and not there.all():
        raise Odd
    if not fd.has_presence:  # the default isn't written
        if fd.type in _LONG:
            there &= np.diff(_offsets_of(column)) > 0
        else:
            values = _number_array(column.fill_null(False if fd.type == _K.TYPE_BOOL else 0))
            there &= values.view(f"<u{values.itemsize}") != 0 if values.dtype.kind == "f" else values != 0
    some = column if there.all() else column.filter(pa.array(there))
    return _spread(_beside(_tag(fd, len(some)), _contents(some, fd)), there)


def _offsets_of(column: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, wide)


def _spread(pieces: Pieces, there: np.ndarray) -> Pieces:
    """Pieces of the rows that are ``there``, as those of all rows."""
    sizes = np.zeros(len(there), np.int64)
    sizes[there] = pieces[1]
    return pieces[0], sizes


def _messages(structs: pa.StructArray, descriptor: Descriptor) -> Pieces:
    """``structs`` has no nulls."""
    if structs.null_count:
        raise Odd
    if not structs.type.num_fields or not len(structs):
        return np.zeros(0, np.uint8), np.zeros(len(structs), np.int64)
    given = {structs.type.field(i).name: structs.field(i) for i in range(structs.type.num_fields)}
    fields = sorted((descriptor.fields_by_name[name] for name in given), key=lambda fd: fd.number)
    if any(is_required(fd) and fd.name not in given for fd in descriptor.fields):
        raise Odd
    for choice in descriptor.oneofs:
        members = [given[fd.name].is_valid().to_numpy(zero_copy_only=False) for fd in choice.fields if fd.name in given]
        if len(members) > 1 and (np.sum(members, axis=0) > 1).any():
            raise Odd
    return _beside(*(_field(given[fd.name], fd) for fd in fields))
