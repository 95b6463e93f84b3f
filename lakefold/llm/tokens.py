"""Token ids of Arrow text columns with the tokenizers library, each distinct piece encoded once.

Both supported pre-tokenizers end every pre-token at white space, so the ids of a text are the ids of
its units (a word, with the white space before it where the tokenizer keeps that, or the marks after a word) put
together.  The
units of a batch are found and counted as arrays; the library encodes only those that this worker has
not met yet.  The memo is a cache of bounded size: emptying it never changes a result.  Texts with
non-ASCII white space or with a special token's string are given to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import BLANKS, LOWER, buffers, slices, span_hashes

MEMO_UNITS = 1_000_000

#: Unicode white space beyond ASCII (fixed values), and the start of special tokens.
_WHOLE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|<\|"

_encoders: dict[tuple, UnitEncoder] = {}


_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _after_letter(data: np.ndarray) -> np.ndarray:
    """For each byte but the first: an ASCII mark right after a letter or digit, where every pre-token ends.

    Beyond ASCII only the letters U+00C0 .. U+00FF are looked at; other characters never end a unit.
    """
    letter = _LETTER_OR_DIGIT[data[:-1]]
    if len(data) > 2:
        letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    return letter & _MARK[data[1:]]


class UnitEncoder:
    """Encoder of one tokenizer file.

    ``keeps_blanks`` tells whether white space belongs to the ids, ``lower`` whether the tokenizer puts texts in
    lower case.
    """

    def __init__(self, path: str, keeps_blanks: bool, lower: bool = False, memo_units: int = MEMO_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_blanks, self.lower = Tokenizer.from_file(path), keeps_blanks, lower
        self.memo_units = memo_units
        self.token_bytes: np.ndarray | None = None
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    @classmethod
    def of(cls, path: str, keeps_blanks: bool, lower: bool = False, memo_units: int = MEMO_UNITS) -> UnitEncoder:
        """The worker's encoder for ``path``."""
        key = (path, keeps_blanks, lower, memo_units)
        if key not in _encoders:
            _encoders[key] = cls(*key)
        return _encoders[key]

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of many units from one text, and how many each has; None if the ids can't be told apart."""
        if self.keeps_blanks:  # units that begin with a blank: the text's bytes are tiled by its tokens
            ids = np.array(self._library([b"".join(units).decode("utf-8")])[0], np.uint32)
            if self.token_bytes is None:
                vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
                self.token_bytes = np.zeros(max(vocabulary.values()) + 2, np.int64)
                for token, i in vocabulary.items():
                    self.token_bytes[i] = len(token)  # a byte-level token has a character for each byte
            ends = np.cumsum(self.token_bytes[np.minimum(ids, len(self.token_bytes) - 1)])
            borders = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
            last = np.searchsorted(ends, borders)
            if not len(ends) or last[-1] >= len(ends) or (ends[last] != borders).any():
                return None
            return ids, np.diff(last, prepend=-1)
        # units without blanks: a control character stands between them
        mark = self._library(["\x01"])[0]
        if len(mark) != 1:
            return None
        ids = np.array(self._library([" \x01 ".join(u.decode("utf-8") for u in units)])[0], np.uint32)
        marks = np.flatnonzero(ids == mark[0])
        if len(marks) != len(units) - 1:
            return None
        return ids[ids != mark[0]], np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _learn(self, units: list[bytes]) -> None:
        """Add ``units``, none of which is known; those that can share a text do."""
        if self.keeps_blanks:
            together = [u for u in units if BLANKS[u[0]]]
            alone = [u for u in units if not BLANKS[u[0]]]
        else:
            together = [u for u in units if b"\x01" not in u]
            alone = [u for u in units if b"\x01" in u]
        for at in range(0, len(together), 20_000):
            part = together[at : at + 20_000]
            found = self._joined(part)
            if found is None:
                alone += part
            else:
                self._add(part, *found)
        if alone:
            ids = self._library([u.decode("utf-8") for u in alone])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(alone, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths)

    def _add(self, units: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        total, have = len(ids), len(self.places)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while have + len(units) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.pool[self.used : self.used + total] = ids
        self.starts[have + 1 : have + 1 + len(units)] = self.used + np.cumsum(lengths)
        self.used += total
        self.places.update(zip(units, range(have, have + len(units))))

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each unit, and the first unit of each row."""
        blank = BLANKS[data]
        begins = blank.copy() if self.keeps_blanks else ~blank
        begins[1:] &= begins[1:] != begins[:-1]
        begins[1:] |= _after_letter(data)
        rows = offsets[:-1][offsets[:-1] < len(data)]
        if self.keeps_blanks:
            begins[rows] = True
            starts = np.flatnonzero(begins)
            return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)
        begins[rows] = ~blank[rows]
        starts = np.flatnonzero(begins)
        stops = np.append(np.flatnonzero(blank), len(data))  # a unit ends at a blank, at the next unit or with its row
        ends = np.minimum(stops[np.searchsorted(stops, starts)], np.append(starts[1:], len(data)))
        return starts, np.minimum(ends, offsets[np.searchsorted(offsets, starts, side="right")]), np.searchsorted(starts, offsets)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = LOWER[data] if self.lower else data
        starts, ends, first = self._spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, at, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(self.places) + len(units) > self.memo_units:
            self._forget()
        known = list(map(self.places.get, units))
        unknown = [u for u, k in zip(units, known) if k is None]
        if unknown:
            self._learn(unknown)
            known = list(map(self.places.get, units))
        place = np.array(known, np.int64)[which]
        begin = self.starts[place]
        length = self.starts[place + 1] - begin
        done = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat((begin - done[:-1]).astype(np.int32), length) + np.arange(done[-1], dtype=np.int32)]
        return ids, done[first]

    def encode(self, column: pa.Array, end: int | None = None):
        """Per slice of rows: ``(row, last row, ids, offsets)``; ``end`` is appended to every row."""
        data, offsets = buffers(column)
        whole = pc.fill_null(pc.match_substring_regex(column, _WHOLE), False).to_numpy(zero_copy_only=False)
        for row, last in slices(offsets):
            part, local = data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            if whole[row:last].any():
                pieces, sizes = [], []
                for r in range(row, last):  # odd texts go whole, the others of the slice as units
                    if whole[r]:
                        ids = np.array(self._library([column[r].as_py()])[0], np.uint32)
                    else:
                        ids, _ = self._slice(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))
                    pieces.append(ids)
                    sizes.append(len(ids))
                ids, bounds = np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])
            else:
                ids, bounds = self._slice(part, local)
            if end is not None:
                bounds = bounds + np.arange(len(bounds))
                full = np.full(bounds[-1], end, np.uint32)
                inside = np.ones(len(full), bool)
                inside[bounds[1:] - 1] = False
                full[inside] = ids
                ids = full
            yield row, last, ids, bounds
