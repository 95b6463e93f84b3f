"""Token counts by a compiled transducer.

A subword vocabulary with merge priorities (BPE, byte fallback) becomes a deterministic transducer over
characters.  A state holds, for each place where a piece that could still grow has begun, the node of the
vocabulary's trie reached from there, the last token before that place and the token count there relative to
the count now.  Reading a character advances the nodes; of the pieces that end here exactly one is compatible
with the token before it, which gives the last token of the longer prefix and the number of tokens by which
the count changes: the annotation of the transition.  Two tokens are compatible if merging their characters
gives just these two.  A pair of neighbouring characters that no piece contains is a hard border: the state
then forgets what came before.  States and transitions are compiled when first needed and kept by the worker.

Texts are cut into chunks of equal length that run through the transition table in step, as array lanes.  Each
chunk starts from a guessed state; its map sends the guess to an exit state and a count.  The scan over chunks
then feeds every chunk the exit state of the one before and repeats only the steps until the state meets the
one of the first run – from there the map does not depend on its entry – and goes on where an exit state
changed, so the composition is exact for any text.

Defined results: a null text counts as empty; an empty text has no tokens; very long texts are more chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import buffers, slices

_BREAK = 0x110000  # stands before each text
_MAX_STATES = 300_000  # a worker that needs more starts its tables anew

_compiled: dict[str, Transducer] = {}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        at += 1
        if data[at - 1] < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(path: str) -> list[tuple[str, float]]:
    """Normal pieces and scores of a sentencepiece BPE model file; other model kinds are refused."""
    with open(path, "rb") as source:
        message = source.read()
    pieces = []
    for number, value in _fields(message):
        inner = dict(_fields(value)) if number in (1, 2, 3) else {}
        if number == 1 and inner.get(3, 1) == 1:
            pieces.append((inner[1].decode("utf-8"), float(np.frombuffer(inner[2], "<f4")[0])))
        elif number == 2 and (inner.get(3) != 2 or not inner.get(35)):
            raise ValueError("only BPE models with byte fallback")
        elif number == 3 and (inner.get(2) or inner.get(3, 1) != 1 or inner.get(4, 1) != 0 or inner.get(5, 1) != 1):
            raise ValueError("only models without character maps, with a leading space and kept white space")
    return pieces


class Transducer:
    """The compiled machine of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        characters = {c for p, _ in pieces for c in p}
        self.cost = {c: 1 if c in self.score else len(c.encode("utf-8")) for c in characters}
        self.borders_inside = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        # trie: children by (node, character), the token that ends at a node, nodes with children
        self.child: dict[tuple[int, str], int] = {}
        self.token: dict[int, str] = {}
        self.grows = {0}
        nodes = 1
        for p in [*self.score, *characters]:
            node = 0
            for c in p:
                self.grows.add(node)
                node, fresh = self.child.setdefault((node, c), nodes), nodes
                nodes += node == fresh
            self.token[node] = p
        self.compatible: dict[tuple[str | None, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.width = 128
        self.class_of = np.full(_BREAK + 1, -1, np.int32)
        self.class_of[_BREAK] = 0
        self.letters: list[str | int] = [0, 1, 2, 3, 4]  # class 0 begins a text, 1 to 4 are unknown characters by bytes
        self.states: dict[tuple, int] = {}
        self.kept: list[tuple] = []
        self.next = np.full((1024, self.width), -1, np.int32)
        self.delta = np.zeros((1024, self.width), np.int16)
        self.start = self._state((None, ((0, None, 0),)))

    @classmethod
    def of(cls, path: str) -> Transducer:
        if path not in _compiled:
            _compiled[path] = cls(read_model(path))
        return _compiled[path]

    def _state(self, key: tuple) -> int:
        found = self.states.setdefault(key, len(self.kept))
        if found == len(self.kept):
            self.kept.append(key)
            if found >= len(self.next):
                more = (min(len(self.next), 1 << 15), self.width)
                self.next = np.concatenate([self.next, np.full(more, -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros(more, np.int16)])
        return found

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """Character classes; new characters get the next free ones."""
        classes = self.class_of[points]
        if (classes < 0).any():
            for point in np.unique(points[classes < 0]).tolist():
                c = chr(point)
                if c in self.cost:
                    self.class_of[point] = len(self.letters)
                    self.letters.append(c)
                else:
                    self.class_of[point] = len(c.encode("utf-8", "surrogatepass"))
            while len(self.letters) > self.width:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)], axis=1)
                self.width *= 2
            classes = self.class_of[points]
        return classes

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short string by repeated merging of the best pair, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: str | None, token: str) -> bool:
        key = (before, token)
        known = self.compatible.get(key)
        if known is None:
            known = self._merge((before or "") + token) == ([before, token] if before else [token])
            self.compatible[key] = known
        return known

    def _compile(self, state: int, letter: str | int) -> tuple[int, int]:
        if isinstance(letter, int):  # a text's begin, or the bytes of an unknown character
            return self.start, letter
        before, entries = self.kept[state]
        if before is None or before + letter not in self.borders_inside:
            entries = ((0, None, 0),)
        grown, ended = [], None
        for node, token, count in entries:
            node = self.child.get((node, letter))
            if node is None:
                continue
            piece = self.token.get(node)
            if piece is not None and self._follows(token, piece):
                ended = (piece, count + (1 if piece in self.score else self.cost[letter]))
            if node in self.grows:
                grown.append((node, token, count))
        piece, delta = ended  # a single character always ends a piece, so there is one
        key = (letter, (*((n, t, c - delta) for n, t, c in grown), (0, piece, 0)))
        return self._state(key), delta

    def _step(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        following = self.next[states, classes]
        missing = following < 0
        if missing.any():
            for code in np.unique(states[missing].astype(np.int64) * self.width + classes[missing]).tolist():
                state, letter = divmod(code, self.width)
                to, delta = self._compile(state, self.letters[letter])
                self.next[state, letter], self.delta[state, letter] = to, delta
            following = self.next[states, classes]
        return following, self.delta[states, classes]

    def deltas(self, points: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Change of the token count at each character of a stream of texts."""
        if len(self.kept) > _MAX_STATES:
            self._reset()
        total = len(points)
        steps = max(64, -(-total // lanes))
        lanes = -(-total // steps)
        stream = np.full(lanes * steps, _BREAK, np.int64)
        stream[:total] = points
        classes = np.ascontiguousarray(self._classes(stream).reshape(lanes, steps).T)
        seen, change = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int16)
        states = np.full(lanes, self.start, np.int32)
        for t in range(steps):
            states, change[t] = self._step(states, classes[t])
            seen[t] = states
        entry = np.full(lanes, self.start, np.int32)
        while True:  # the scan: entries that differ from those of the last run
            given = np.concatenate([[self.start], seen[-1, :-1]]).astype(np.int32)
            open_ = np.flatnonzero(given != entry)
            entry = given
            if not len(open_):
                break
            states = entry[open_]
            for t in range(steps):
                states, change[t, open_] = self._step(states, classes[t, open_])
                apart = states != seen[t, open_]
                seen[t, open_] = states
                if not apart.all():
                    open_, states = open_[apart], states[apart]
                if not len(open_):
                    break
        return change.T.ravel()[:total]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a batch of UTF-8 texts."""
        rows = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # characters before each row
        full = np.diff(first) > 0
        lead = np.cumsum(full + np.int64(1)) + 0  # a break for each row, and a space where it has characters
        begin = first[:-1] + np.concatenate([[0], lead[:-1]])
        stream = np.empty(len(points) + int(lead[-1]), np.int64)
        own = np.ones(len(stream), bool)
        own[begin] = False
        own[begin[full] + 1] = False
        stream[own] = points
        stream[begin] = _BREAK
        stream[begin[full] + 1] = 0x20
        stream[stream == 0x20] = 0x2581
        sums = np.concatenate([[0], np.cumsum(self.deltas(stream), dtype=np.int64)])
        return sums[np.append(begin[1:], len(stream))] - sums[begin] if rows else np.zeros(0, np.int64)


def count_tokens(docs: DataFrame, model: str, *, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; a column named ``into`` is replaced.  Map-only."""
    fields = [f for f in docs.schema.fields if f.name != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(model)
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            parts = [machine.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            counts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(counts, pa.int64())], names=[*(f.name for f in fields), into])

    return docs.select(*(F.col(f.name) for f in fields)).mapInArrow(run, T.StructType([*fields, T.StructField(into, T.LongType())]))
