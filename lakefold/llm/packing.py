"""Vector bin packing of training examples into sequences.

An example demands tokens, segments and loss-bearing tokens; a sequence limits all three.  The heuristic
fills one sequence after the other: among the waiting examples that fit, take the one whose demand vector
has the largest dot product with the remaining capacity (each dimension scaled by its limit and weighted by
how scarce it is among the waiting examples).  Examples of equal demand are interchangeable, so a step is one
array operation over the distinct demands.  With ``cut`` an example may be cut to fill a gap exactly.

Packing runs inside each input partition over a buffer of at most ``BUFFER`` waiting examples; what is
left in the last open sequence waits for the next buffer, so a partition pads its final sequence only.
There is no shuffle and no group: hot keys do not exist here.  Results depend on how the input is split,
but not on retries of a task.

Defined results: a null text counts as empty (one end token); an example that alone exceeds a limit of
:func:`pack_examples` gets a null sequence; nulls in a demand count as 0; columns of the input that clash
with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import MEMO_UNITS, UnitEncoder

CAPACITY = 1024
BUFFER = 8192


def place(demands: np.ndarray, limits: tuple[int, int, int], cut: bool, final: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of ``(item, start, tokens)`` and the pieces that still wait.

    ``demands`` has a row (tokens, segments, loss) per item; the loss-bearing tokens of an item come last.
    Without ``final`` the last sequence is left waiting if it has room.
    """
    limit = np.array(limits, float)
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    kinds = kinds.astype(float)
    order = np.argsort(kind_of.ravel(), kind="stable")
    bounds = np.searchsorted(kind_of.ravel()[order], np.arange(len(kinds) + 1))
    waiting = [order[a:b][::-1].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    left = np.diff(bounds)
    scale = kinds / limit
    scarce = (scale * left[:, None]).sum(0)
    weighted = scale * (scarce / max(scarce.sum(), 1e-12))
    rest: list[tuple[int, int, int, int]] = []  # tails of cut items: item, start, tokens, loss
    done: list[list[tuple[int, int, int]]] = []
    total = int(left.sum())
    while total or rest:
        free, pieces = limit.copy(), []
        while True:
            tail = next((t for t in rest if t[2] <= free[0] and free[1] >= 1 and t[3] <= free[2]), None)
            if tail is not None:
                rest.remove(tail)
                pieces.append(tail[:3])
                free -= (tail[2], 1, tail[3])
                continue
            score = np.where((left > 0) & (kinds <= free).all(1), weighted @ (free / limit), -1.0)
            best = int(score.argmax()) if len(score) else -1
            if best < 0 or score[best] < 0:
                break
            item = waiting[best].pop()
            left[best] -= 1
            total -= 1
            pieces.append((item, 0, int(kinds[best, 0])))
            free -= kinds[best]
        gap = int(free[0])
        if cut and gap and free[1] >= 1 and total:
            best = int(np.where(left > 0, kinds[:, 0], -1).argmax())  # nothing fits, so each waiting item is longer than the gap
            tokens, loss = int(kinds[best, 0]), int(kinds[best, 2])
            head_loss = max(0, gap - (tokens - loss))
            if tokens > gap and head_loss <= free[2]:
                item = waiting[best].pop()
                left[best] -= 1
                total -= 1
                pieces.append((item, 0, gap))
                rest.append((item, gap, tokens - gap, loss - head_loss))
        if not pieces:
            break  # what waits exceeds a limit on its own
        if not final and not total and not rest and sum(p[2] for p in pieces) < limit[0]:
            return done, pieces
        done.append(pieces)
    return done, []


PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack_texts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int = 0, capacity: int = CAPACITY, max_segments: int = CAPACITY, buffer: int = BUFFER, memo_units: int = MEMO_UNITS, keep_memo: bool = True) -> DataFrame:
    """Tokenise texts, append ``end`` and pack all tokens: one row per piece.

    Columns: ``key``, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.
    A document gives whole sequences first; its remainder is packed with those of other documents.  ``memo_units`` bounds the memo of encoded
    units; without ``keep_memo`` it ends with the task, which costs time but leaves the worker small for other stages.
    """
    schema = T.StructType([docs.schema[key], *PIECE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = (UnitEncoder.of if keep_memo else UnitEncoder)(tokenizer, True, False, memo_units)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        waiting: list[tuple] = []  # key, start, ids, tokens of the document

        def flush(final: bool) -> None:
            nonlocal sequence, waiting
            sizes = np.array([len(w[2]) for w in waiting], np.int64)
            demands = np.stack([sizes, np.ones_like(sizes), sizes], 1)
            done, kept = place(demands, (capacity, max_segments, capacity), True, final)
            for pieces in done:
                offset = 0
                for item, start, length in pieces:
                    doc, before, ids, tokens = waiting[item]
                    out.append((doc, before + start, length, ids[start : start + length].tobytes(), tokens, sequence, offset))
                    offset += length
                sequence += 1
            waiting = [(waiting[i][0], waiting[i][1] + start, waiting[i][2][start : start + length], waiting[i][3]) for i, start, length in kept]

        def batch_out() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 7
            ready = pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, arrow)], names=schema.names)
            out.clear()
            return ready

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            keys = batch.column(0).to_pylist()
            for row, last, ids, bounds in encoder.encode(batch.column(1), end):
                for r in range(row, last):
                    own = ids[bounds[r - row] : bounds[r - row + 1]]
                    tokens, at = len(own), 0
                    while tokens - at >= capacity:
                        out.append((keys[r], at, capacity, own[at : at + capacity].tobytes(), tokens, sequence, 0))
                        sequence, at = sequence + 1, at + capacity
                    if at < tokens:
                        waiting.append((keys[r], at, own[at:].copy(), tokens))
                    if len(waiting) >= buffer:
                        flush(False)
                    if len(out) >= 4096:
                        yield batch_out()
        if arrow is not None:
            if waiting:
                flush(True)
            yield batch_out()

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def pack_examples(examples: DataFrame, *, tokens: str = "tokens", loss: str = "loss_tokens", limits: tuple[int, int, int] = (4096, 64, 4096), buffer: int = BUFFER) -> DataFrame:
    """Whole instruction examples into sequences under limits on tokens, segments and loss-bearing tokens.

    Adds ``sequence_id``, ``offset`` and ``segment``; nothing is cut.
    """
    kept = [c for c in examples.columns if c not in ("sequence_id", "offset", "segment")]
    frame = examples.select(*kept)
    schema = T.StructType([*frame.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("segment", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[pa.Table] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, rows
            table = pa.concat_tables(held).combine_chunks()
            held, rows = [], 0
            need = np.stack([_longs(table[tokens]), np.ones(len(table), np.int64), _longs(table[loss])], 1)
            fits = np.flatnonzero((need <= np.array(limits)).all(1))
            ids, offsets, segments = [None] * len(table), [None] * len(table), [None] * len(table)
            for pieces in place(need[fits], limits, False, True)[0]:
                offset = 0
                for k, (item, _, length) in enumerate(pieces):
                    ids[fits[item]], offsets[fits[item]], segments[fits[item]] = sequence, offset, k
                    offset += length
                sequence += 1
            table = table.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            yield from table.append_column("segment", pa.array(segments, pa.int32())).to_batches()

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows >= buffer:
                yield from flush()
        if rows:
            yield from flush()

    return frame.mapInArrow(run, schema)


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.cast(column, pa.int64()), 0).to_numpy()
