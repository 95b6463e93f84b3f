"""Conversation repair as a lightest derivation.

A conversation's rows, by turn (nulls first, then role and text), are edited until their role initials read
``(s?(ua)+)?``.  Edits: Keep a row (free), Rerole it to user or assistant (2), Delete it (3; blank and duplicate rows
must go), Insert a row without text (2); a truncated row that stays adds 1.

*Deduction.*  An item is a grammar state reached from an entry state after some rows; its value is (cost, audit), the
audit being the initials of the edits so far.  A row edit or an insertion appends a letter and adds a cost; two blocks
join where the exit state of one is the entry of the other.  Both rules are superior (a result is never less than its
parts) and monotone: two audits of equal cost over the same rows are never the start of one another, because what
follows could only be insertions, which cost.  Knuth's agenda pops the least value first, so an item is final when it
is popped, and the search ends when its goal is.

*Scale.*  Rows are range-partitioned by (conversation, turn, role, text), so one conversation may lie in many tasks.
Blocks of ``BLOCK`` rows are solved by the agenda and joined pairwise.  Only the first and the last conversation of a
task can go on elsewhere; of those a task returns its joined items for every entry state, and few rows a conversation
are combined afterwards.  Earlier rows of equal role and text come from an aggregate merged on the map side, joined
under a salt.  What remains in one task is what the result asks for: the audit and the digest of one conversation
are one value each, and SHA-256 runs over its text in order, row by row.

Defined results: a null role or text is one space; a null conversation is a conversation; rows of equal turn stand by
role, then text; an empty role has no initial and can't be kept; an empty table gives an empty table.  Other columns
do not matter and are not returned.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK = 64

#: Characters of a text that range borders compare (the driver sees a sample of them); equal rows stay together.
BORDER = 64
SALTS = 16

#: Texts of a conversation that a task holds until its audit is known; longer ones are digested in a pass of their own.
HELD_BYTES = 16 << 20

NAMES = {"u": "user", "a": "assistant"}

#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)

_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")

Value = tuple[int, str]  # cost, audit


def lightest(axioms: Iterable[tuple[object, Value]], deduce, goals=None) -> dict:
    """Final values of the items, least first, until one of ``goals`` (all items without goals).

    ``deduce(item, value, final)`` yields (item, value) of the rules whose parts are all final.
    """
    agenda = [(value, item) for item, value in axioms]
    heapq.heapify(agenda)
    final: dict = {}
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if goals is not None and item in goals:
            break
        for other, weight in deduce(item, value, final):
            if other not in final:
                heapq.heappush(agenda, (weight, other))
    return final


def row_edits(initial: str, fault: str | None) -> list[tuple[int, str, str]]:
    """Cost, letter and the role initial that each edit of a row leaves (none after a deletion)."""
    if fault in ("blank", "duplicate"):
        return [(DELETE, "D", "")]
    more = TRUNCATED if fault == "truncated" else 0
    edits = [(DELETE, "D", "")]
    if initial in ("s", "u", "a"):
        edits.append((KEEP + more, "K", initial))
    edits += [(REROLE + more, "R", other) for other in NAMES if other != initial]
    return edits


def _transitions(rows: list[list[tuple[int, str, str]]]):
    """Rules over items (rows consumed, state): edit the next row, or insert a row."""

    def deduce(item, value, final):
        place, state = item
        cost, audit = value
        for initial in NAMES:
            if (state, initial) in STEP:
                yield (place, STEP[state, initial]), (cost + INSERT, audit + "I")
        if place < len(rows):
            for weight, letter, initial in rows[place]:
                if not initial:
                    yield (place + 1, state), (cost + weight, audit + letter)
                elif (state, initial) in STEP:
                    yield (place + 1, STEP[state, initial]), (cost + weight, audit + letter)

    return deduce


def solve_whole(rows: list[list[tuple[int, str, str]]]) -> Value:
    """The goal of a conversation of one block: the search ends when a final state of all rows is popped."""
    goals = {(len(rows), state) for state in FINAL}
    final = lightest([((0, START), (0, ""))], _transitions(rows), goals)
    return next(value for item, value in final.items() if item in goals)


def solve_block(rows: list[list[tuple[int, str, str]]], entries: Iterable[int]) -> dict[tuple[int, int], Value]:
    """Lightest (cost, audit) from each entry state to every exit state over a block of row edits."""
    out, deduce = {}, _transitions(rows)
    for entry in entries:
        final = lightest([((0, entry), (0, ""))], deduce)
        out.update({(entry, state): value for (place, state), value in final.items() if place == len(rows)})
    return out


def join_blocks(left: dict[tuple[int, int], Value], right: dict[tuple[int, int], Value]) -> dict[tuple[int, int], Value]:
    """Items over two neighbouring blocks: exit of the left one is entry of the right one."""

    def deduce(item, value, final):
        side, a, b = item
        if side == "left":
            pairs = ((a, d, value, final["right", c, d]) for c in (b,) for d in range(4) if ("right", c, d) in final)
        elif side == "right":
            pairs = ((c, b, final["left", c, a], value) for c in range(4) if ("left", c, a) in final)
        else:
            return
        for p, q, one, two in pairs:
            yield ("both", p, q), (one[0] + two[0], one[1] + two[1])

    axioms = [(("left", *k), v) for k, v in left.items()] + [(("right", *k), v) for k, v in right.items()]
    return {(p, q): v for (side, p, q), v in lightest(axioms, deduce).items() if side == "both"}


class _Blocks:
    """Joined items of a growing run of blocks: equal sizes are joined first, so audits are copied log(n) times."""

    def __init__(self, entries: tuple[int, ...]):
        self.entries, self.rows, self.stack = entries, [], []

    def add(self, edits: list[tuple[int, str, str]]) -> None:
        self.rows.append(edits)
        if len(self.rows) == BLOCK:
            self._close()

    def _close(self) -> None:
        size, items = 1, solve_block(self.rows, self.entries if not self.stack else range(4))
        self.rows = []
        while self.stack and self.stack[-1][0] == size:
            size, items = 2 * size, join_blocks(self.stack.pop()[1], items)
        self.stack.append((size, items))

    def solved(self) -> Value:
        """The lightest derivation of all rows from the start."""
        return goal(self.items()) if self.stack else solve_whole(self.rows)

    def items(self) -> dict[tuple[int, int], Value]:
        if self.rows or not self.stack:
            self._close()
        items = self.stack.pop()[1]
        while self.stack:
            items = join_blocks(self.stack.pop()[1], items)
        return items


def goal(items: dict[tuple[int, int], Value]) -> Value:
    """The lightest derivation of a whole conversation."""
    return min(items[START, state] for state in FINAL if (START, state) in items)


class Digest:
    """SHA-256 of the repaired ``role:text`` lines, following an audit row by row."""

    def __init__(self, audit: str):
        self.hash, self.audit, self.place, self.state, self.lines = hashlib.sha256(), audit, 0, START, 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.state = STEP[self.state, role[0]]

    def _expected(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _inserts(self) -> None:
        while self.audit[self.place : self.place + 1] == "I":
            self.place += 1
            self._line(self._expected(), "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.place]
        self.place += 1
        if letter != "D":
            self._line(role if letter == "K" else self._expected(), text)

    def hexdigest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def find_fault(text: str, duplicate: bool) -> str | None:
    """The first fault of a row: blank, duplicate or truncated."""
    if _BLANK.match(text):
        return "blank"
    if duplicate:
        return "duplicate"
    return None if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "truncated"


_FAULTS = ("blank", "duplicate", "truncated")
_ITEM = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])


def _segment_schema(key: T.DataType) -> T.StructType:
    longs = ["task", "place", "blank", "duplicate", "truncated", "illegal", "turns"]
    return T.StructType(
        [
            T.StructField("conversation", key),
            *(T.StructField(n, T.LongType()) for n in longs),
            T.StructField("least", T.LongType()),
            T.StructField("greatest", T.LongType()),
            T.StructField("first_role", T.StringType()),  # null: no rows
            T.StructField("last_role", T.StringType()),
            T.StructField("items", T.ArrayType(_ITEM)),
            T.StructField("sha256", T.StringType()),  # null: to be digested in another pass
            T.StructField("whole", T.BooleanType()),
        ]
    )


class _Segment:
    """The rows of one conversation that lie in one task."""

    def __init__(self, conversation, entries: tuple[int, ...]):
        self.conversation, self.counts, self.illegal, self.turns = conversation, dict.fromkeys(_FAULTS, 0), 0, 0
        self.least = self.greatest = self.first_role = self.last_role = self.before = None
        self.blocks, self.held, self.size = _Blocks(entries), [], 0

    def add(self, turn, role: str, text: str, earlier: bool) -> None:
        here = (turn, role, text)
        fault = find_fault(text, earlier or here == self.before)
        self.before = here
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last_role is not None and self.last_role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if self.first_role is None:
            self.first_role = initial
        self.last_role = initial
        if turn is not None and turn != self.greatest:
            self.turns += 1
            self.least, self.greatest = turn if self.least is None else self.least, turn
        self.blocks.add(row_edits(initial, fault))
        if self.held is not None:
            self.held.append((role, text))
            self.size += len(role) + len(text) + 64
            if self.size > HELD_BYTES:
                self.held = None

    def close(self, task: int, place: int, whole: bool) -> dict:
        digest = None
        if not whole:
            items = self.blocks.items()
        else:
            items = {(START, START): self.blocks.solved()}
            audit = items[START, START][1]
            if self.held is not None:
                following = Digest(audit)
                for role, text in self.held:
                    following.row(role, text)
                digest = following.hexdigest()
        return {
            "conversation": self.conversation,
            "task": task,
            "place": place,
            **self.counts,
            "illegal": self.illegal,
            "turns": self.turns,
            "least": self.least,
            "greatest": self.greatest,
            "first_role": self.first_role,
            "last_role": self.last_role,
            "items": [{"entry": p, "exit": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(items.items())],
            "sha256": digest,
            "whole": whole,
        }


def _solve(schema: T.StructType):
    """Sorted rows of a task to segments; the first and the last conversation stay open at both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, task = to_arrow_schema(schema), TaskContext.get().partitionId()
        segment, place = None, 0
        out: list[dict] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conversation", "turn", "role", "text", "copies", "earlier"))
            for conversation, turn, role, text, copies, earlier in zip(*columns):
                if segment is None or conversation != segment.conversation:
                    if segment is not None:
                        out.append(segment.close(task, place, place > 0))
                        place += 1
                    segment = _Segment(conversation, (START,) if place else tuple(range(4)))
                for _ in range(copies):
                    segment.add(turn, role, text, earlier)
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if segment is not None:
            out.append(segment.close(task, place, False))  # the conversation may go on in the next task
        yield pa.RecordBatch.from_pylist(out, arrow)

    return run


def _combine(segments: list[dict]) -> dict:
    """Segments of one conversation, in order, as one result."""
    counts = {n: sum(s[n] for s in segments) for n in (*_FAULTS, "illegal", "turns")}
    items, last_role, greatest, least = None, None, None, None
    for s in sorted(segments, key=lambda s: (s["task"], s["place"])):
        if s["first_role"] is None:
            continue
        here = {(i["entry"], i["exit"]): (i["cost"], i["audit"]) for i in s["items"]}
        items = here if items is None else join_blocks(items, here)
        if last_role is not None and last_role + s["first_role"] not in ("su", "ua", "au"):
            counts["illegal"] += 1
        last_role = s["last_role"]
        if s["least"] is not None:
            counts["turns"] -= s["least"] == greatest
            least, greatest = s["least"] if least is None else least, s["greatest"]
    cost, audit = goal(items) if items else (0, "")
    return {"conversation": segments[0]["conversation"], **counts, "least": least, "greatest": greatest, "cost": cost, "audit": audit}


def _combined(schema: T.StructType):
    def run(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.Table.from_pylist([_combine(table.to_pylist())], to_arrow_schema(schema))

    return run


def _digest(schema: T.StructType):
    """Rows of conversations behind their audits, in order, to digests; a row of text is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, conversation, following = to_arrow_schema(schema), None, None
        for batch in batches:
            out = []
            for key, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conversation", "audit", "role", "text", "copies"))):
                if audit is not None:
                    if following is not None:
                        out.append({"conversation": conversation, "digest": following.hexdigest()})
                    conversation, following = key, Digest(audit)
                    continue
                for _ in range(copies):
                    following.row(role, text)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if following is not None:
            yield pa.RecordBatch.from_pylist([{"conversation": conversation, "digest": following.hexdigest()}], arrow)

    return run


def repair_conversations(
    rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None
) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``copies`` says how often a row stands in its conversation; rows that stand nowhere only name it.
    """
    space = F.lit(" ")
    key = rows.schema[conversation].dataType
    base = rows.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, space).alias("role"),
        F.coalesce(text, space).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    marked = base.withColumn("print", F.md5(F.col("text").cast("binary")))
    firsts = (
        marked.where("copies > 0")
        .groupBy("conversation", "role", "print")
        .agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
        .where("first < last")
        .select(F.col("conversation").alias("c"), F.col("role").alias("r"), F.col("print").alias("p"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    )
    same = F.col("conversation").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p")) & (F.col("salt") == F.col("s"))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    known = salted.join(firsts, same, "left").select(
        "conversation", "turn", "role", "text", "copies", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("earlier")
    )
    order = ["conversation", "turn", "role", "text"]
    schema = _segment_schema(key)
    segments = stored(known.repartitionByRange(*order[:3], F.substring("text", 1, BORDER)).sortWithinPartitions(*order).mapInArrow(_solve(schema), schema), "segments")

    result = T.StructType(
        [
            T.StructField("conversation", key),
            *(T.StructField(n, T.LongType()) for n in (*_FAULTS, "illegal", "turns", "least", "greatest", "cost")),
            T.StructField("audit", T.StringType()),
        ]
    )
    names = [f.name for f in result.fields]
    item = F.get("items", F.lit(0))
    done = segments.where("whole").select(*names[:-2], item["cost"].alias("cost"), item["audit"].alias("audit"), "sha256")
    open_ = segments.where("NOT whole").groupBy("conversation").applyInArrow(_combined(result), result).withColumn("sha256", F.lit(None).cast("string"))
    solved = stored(done.unionByName(open_), "repairs")

    # Conversations that cross the border of a task, or are very long, are digested in a streaming pass.
    waiting = solved.where("sha256 IS NULL").select("conversation", "audit")
    wanted = base.alias("b").join(waiting.alias("w"), F.col("b.conversation").eqNullSafe(F.col("w.conversation")), "left_semi")
    none = F.lit(None)
    lines = waiting.select("conversation", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(0).alias("copies"), "audit").unionByName(
        wanted.select("conversation", F.lit(1).alias("kind"), "turn", "role", "text", "copies", none.cast("string").alias("audit"))
    )
    digest = T.StructType([T.StructField("conversation", key), T.StructField("digest", T.StringType())])
    digests = lines.repartition("conversation").sortWithinPartitions("conversation", "kind", "turn", "role", "text").mapInArrow(_digest(digest), digest)
    late = solved.alias("s").join(digests.alias("d"), F.col("s.conversation").eqNullSafe(F.col("d.conversation")), "left")
    return late.select(
        F.col("s.conversation").alias(conversation),
        F.coalesce(F.col("greatest") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *_FAULTS,
        "illegal",
        "cost",
        "audit",
        F.coalesce("sha256", "digest").alias("repaired_sha256"),
    )


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of conversations with damage by checksum of ``conv_id:turn``, and how often each of them stands.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks,
    3 repeats it, 4 makes the user its speaker.  A null is one space, in the checksum too.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rest = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", space)
    damaged = rows.select(
        "conv_id",
        "turn",
        F.when(rest == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(rest == 1, F.lit("")).when(rest == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(rest == 0, 0).when(rest == 3, 2).otherwise(1).alias("copies"),
    )
    return damaged, F.col("copies")
