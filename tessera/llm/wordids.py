"""Exact ids of a white-space-dropping word BPE, with a cache of runs.

The tokenizer's pieces never span ASCII white space, so a text's ids are the ids
of its words, one after another, and a plain word's those of its runs of letters,
numbers and signs.  Words and runs repeat: a batch's distinct words are split into
runs in Arrow, and each distinct run is encoded by ``tokenizers`` once in a worker
and then looked up.
"""

from __future__ import annotations

import gc
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of runs and ids in each of the two generations that a worker keeps.
CACHE_BYTES = 70_000_000
_ENTRY = 150  # of a dict entry and two bytes objects, roughly

# Words of code points below _PLAIN, but for the excepted ones, fall into runs by a
# plain rule: letters, one number, or anything else.  Apostrophes start contractions
# and "<|" special tokens; two of the others are white space, one lower-cases to two.
_PLAIN = "\u0250"
_EXCEPT = "[^\\x{0}-\\x{24f}]|['\\x{85}\\x{a0}\\x{130}]|<\\|"
_LETTERS, _NUMBERS = ("".join(re.escape(c) for c in map(chr, range(ord(_PLAIN))) if unicodedata.category(c)[0] == kind) for kind in "LN")
_NO_LETTERS = f"([{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+)"


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells bytes: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def _joined(parts: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Neighbouring values as one, from each end to the next."""
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[ends] if len(parts) else np.zeros(len(ends), dtype=np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at), data])


def _listed(values: pa.LargeStringArray) -> list[bytes]:
    return values.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


_WORKERS: dict[str, WordIds] = {}


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tok.model)  # for runs that are already normal and split
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spell = _byte_letters() | {32: " "}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.runs: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _age(self) -> None:
        """Start a new generation; runs that occur again move up from the older one, others go with it."""
        self.older, self.runs, self.held = self.runs, {b"": b""}, 0

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def _encode_runs(self, runs: list[bytes]) -> None:
        """Each run is one piece, whose last id alone ends a word."""
        for k in range(0, len(runs), 2000):
            part = runs[k : k + 2000]
            spelled = b" ".join(part).decode("latin-1").translate(self.spell)
            ids = np.array(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            assert len(cuts) == len(part) and cuts[-1] == len(ids), "a run is not one piece"
            raw, at = ids.tobytes(), 0
            for run, cut in zip(part, (cuts * 4).tolist(), strict=True):
                self.runs[run] = raw[at:cut]
                at = cut

    def _learn(self, missing: list[bytes], whole: set[bytes]) -> None:
        """Encode runs; those in ``whole`` are words that the plain rule doesn't split."""
        self._encode_runs([r for r in missing if r not in whole])
        others = [r for r in missing if r in whole]
        for k in range(0, len(others), 20_000):
            part = others[k : k + 20_000]
            found = self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.runs.update(zip(part, (np.array(e.ids, dtype="<u4").tobytes() for e in found), strict=True))

    def _ids(self, runs: list[bytes], whole: set[bytes]) -> list[bytes]:
        """The ids of distinct runs."""
        found = list(map(self.runs.get, runs))
        missing = [r for r, ids in zip(runs, found, strict=True) if ids is None]
        if not missing:
            return found
        self.held += sum(_ENTRY + 6 * len(r) for r in missing)
        if self.older:
            again = {r: ids for r in missing if (ids := self.older.get(r)) is not None}
            self.runs.update(again)
            missing = [r for r in missing if r not in again]
        self._learn(missing, whole)
        return [self.runs[r] if ids is None else ids for r, ids in zip(runs, found, strict=True)]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """For each text (UTF-8), its ids as little-endian unsigned 32-bit numbers."""
        if self.held > CACHE_BYTES:
            self._age()
        gc.disable()  # nothing here is cyclic, and a collection would walk the whole cache
        try:
            return self._batch(texts)
        finally:
            gc.enable()

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = split.values.dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, _EXCEPT)
        plain, others = coded.dictionary.filter(pc.invert(odd)), coded.dictionary.filter(odd)
        at = np.empty(len(odd), dtype=np.int64)  # where a word is among the plain ones and then the others
        at[np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(odd))
        parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.replace_substring_regex(plain, _NO_LETTERS, r" \1 ")))
        runs = pa.concat_arrays([parts.values, others]).dictionary_encode()
        ends = np.concatenate([parts.offsets.to_numpy(), len(parts.values) + np.arange(1, len(others) + 1)])
        known = self._ids(_listed(runs.dictionary), set(_listed(others)))
        words = _joined(pa.array(known, pa.large_binary()).take(runs.indices), ends)
        found = _joined(words.take(pa.array(at[coded.indices.to_numpy()])), split.offsets.to_numpy())
        return found.to_pylist()
