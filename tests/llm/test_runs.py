"""Periodic runs against a quadratic search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from lakefold.llm import registered, runs
from lakefold.llm.words import BLANKS, Words, buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w: list[str]) -> list[tuple[int, int, int]]:
    """All maximal runs by comparing the text with itself at every lag."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q), q)  # lags ascend: the first one is the smallest
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def samples(seed: int) -> list[list[str]]:
    r = random.Random(seed)
    out = []
    for _ in range(150):
        w: list[str] = []
        for _ in range(r.randrange(1, 5)):
            kind = r.randrange(4)
            if kind == 0:
                w += [r.choice("abcdefgh") for _ in range(r.randrange(0, 40))]
            elif kind == 1:
                unit = [r.choice("ab") for _ in range(r.randrange(1, 60))]
                w += (unit * 9)[: r.randrange(1, 9 * len(unit) + 1)]
            elif kind == 2:
                x, y = ([r.choice("abcdef") for _ in range(r.randrange(16, 24))] for _ in range(2))
                w += (x + x + x + y + x + y) * r.randrange(1, 5)
            else:
                w += ["a"] * r.randrange(0, 90)
        if w and r.random() < 0.3:
            w[r.randrange(len(w))] = "z"
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_quadratic_search(seed):
    import pyarrow as pa

    texts = samples(seed)
    words = Words(*buffers(pa.array([" ".join(w) for w in texts])), BLANKS, lower=False)
    found = runs.slice_runs(words)
    for row, w in enumerate(texts):
        assert found.get(row, []) == brute_runs(w), w


def test_long_uniform_text_is_near_linear():
    import pyarrow as pa

    text = "word " * 300_000 + "end " + "one two three four five six seven eight nine ten eleven twelve " * 30_000
    words = Words(*buffers(pa.array([text])), BLANKS, lower=False)
    assert runs.slice_runs(words) == {0: [(0, 300_000, 1), (300_001, 360_000, 12)]}


def test_defined_rows_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n", 5), (3, "a " * 30, 5), (3, "a " * 30, 5), (None, "b\tc\n" * 12 + "d", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic int")
    got = {(r.doc_id, r.text): r.periodic for r in runs.find_runs(docs).collect()}
    assert len(runs.find_runs(docs).collect()) == 6
    assert got[1, None].n_words == 0 and got[1, None].runs == [] and got[1, None].top is None and got[1, None].collapsed_text == ""
    assert got[3, "a " * 30].collapsed_text == "a" and tuple(got[3, "a " * 30].top) == (0, 30, 1)
    assert got[None, "b\tc\n" * 12 + "d"].collapsed_text == "b c d"
    assert runs.find_runs(docs.limit(0)).count() == 0
    assert sorted(r.text for r in runs.collapse_runs(docs).where("text is not null").collect()) == sorted(["", " \n", "a", "a", "b c d"])


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["on", "off", "été", "up"]) for _ in range(r.randrange(0, 120))) + " \n") for k in range(300)]
    rows += [(1000, None), (1001, ""), (None, "x " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {row.doc_id: row for row in registered.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        w = WORD.findall(text or "")
        h = 1 if key is None else zlib.crc32(str(key).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        top = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None, None, None)
        row = got[key]
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *top)
        assert row.exponent_milli == (None if not found else 1000 * top[1] // top[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert sum(row.n_runs > 0 for row in got.values()) > 5
