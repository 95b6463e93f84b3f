"""Conversation repair against an exhaustive search over edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from lakefold.llm import registered, repair

SPACE = "\x20\t\n\x0b\x0c\r"


def faults(rows: list[tuple]) -> list[str | None]:
    out, seen = [], set()
    for _, role, text in rows:
        inside = text.strip(SPACE)
        if not inside:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if inside[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str, str]:
    """Cost, audit and repaired lines by trying all edits within a growing cost bound."""
    found = faults(rows)

    def search(i, roles, cost, audit, lines, bound):
        if cost > bound:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            yield cost, audit, "\n".join(lines)
        if i < len(rows):
            role, text = rows[i][1:]
            yield from search(i + 1, roles, cost + 3, audit + "D", lines, bound)
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                if role[:1] and re.fullmatch(r"s?(ua)*u?", roles + role[0]):
                    yield from search(i + 1, roles + role[0], cost + more, audit + "K", [*lines, f"{role}:{text}"], bound)
                for name in ("user", "assistant"):
                    if re.fullmatch(r"s?(ua)*u?", roles + name[0]):
                        yield from search(i + 1, roles + name[0], cost + 2 + more, audit + "R", [*lines, f"{name}:{text}"], bound)
        for name in ("user", "assistant"):
            if re.fullmatch(r"s?(ua)*u?", roles + name[0]):
                yield from search(i, roles + name[0], cost + 2, audit + "I", [*lines, f"{name}:"], bound)

    for bound in range(0, 3 * len(rows) + 1):
        best = min(search(0, "", 0, "", [], bound), default=None)
        if best and best[0] <= bound:
            return best
    raise AssertionError


def expected(rows: list[tuple]) -> tuple:
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    found = faults(rows)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(rows)
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def sample(seed: int, conversations: int, longest: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(r.randrange(1, longest)):
            text = r.choice(["Hello.", "Well", "", " \n", "Yes! \t", "Same.", "é?", None])
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 3), (3, 40)])
def test_equals_exhaustive_search(spark, seed, partitions):
    rows = sample(seed, 40, 6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(3)
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_conversations(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for conv, group in groupby(rows, key=lambda r: r[0]):
        plain = [(t, " " if role is None else role, " " if text is None else text) for _, t, role, text in group]
        assert got[conv] == expected(plain), plain


def test_blocks_equal_one_search():
    r = random.Random(3)
    for n in (0, 1, 63, 64, 65, 200, 517):
        edits = [repair.row_edits(r.choice("suat"), r.choice([None, None, "blank", "truncated"])) for _ in range(n)]
        blocks = repair._Blocks((repair.START,))
        for e in edits:
            blocks.add(e)
        assert repair.goal(blocks.items()) == repair.solve_whole(edits)


def test_long_conversation_over_many_tasks(spark):
    """One conversation of thousands of rows: many tasks give the result of one."""
    rows = [(7, t, ["user", "assistant", "tool", "user"][t % 4], f"Line {t}." if t % 5 else "") for t in range(3000)]
    rows += [(c, 0, "user", "Hi.") for c in (6, 8)] + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi.")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            results.append(sorted(map(str, repair.repair_conversations(docs).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == 4
    null = next(r for r in repair.repair_conversations(docs).collect() if r.conv_id is None)
    assert (null.cost, null.audit) == (0, "KK")


def test_query_on_damaged_rows(spark, tmp_path):
    rows = [(c, t, role, text) for c, t, role, text in sample(9, 120, 5)] + [(c, 0, "user", "Hi.") for c in range(200, 240)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in registered.QUERIES["op11_repair_conversations"](spark, str(tmp_path)).collect()}
    want: dict = {}
    for c, t, role, text in rows:
        kept = want.setdefault(c, [])
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert len(got) == len(want)
    for c, kept in want.items():
        assert got[c] == expected(kept), kept
    assert any(not kept for kept in want.values())
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", nothing) for c, kept in want.items() if not kept)
