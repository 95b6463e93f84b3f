"""Repeated phrases against a dictionary of all windows."""

from __future__ import annotations

import random
import re

import pytest

from lakefold.llm import phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows: list[tuple], width: int = 13) -> list[tuple]:
    first: dict[tuple, int] = {}
    split = [(key, WORD.findall(text or "")) for key, text in rows]
    for key, w in split:
        for i in range(len(w) - width + 1):
            if key is not None:
                window = tuple(w[i : i + width])
                first[window] = min(first.get(window, key), key)
    out = []
    for key, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if key is not None and first[tuple(w[i : i + width])] < key:
                gone.update(range(i, i + width))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    line = ["a", "common", "line", "of", "ten", "words", "that", "many", "texts", "have"]
    passages = [[r.choice("pqrstuvwxyz") * r.randrange(1, 4) for _ in range(r.randrange(13, 60))] for _ in range(6)]
    rows = []
    for key in range(250):
        w: list[str] = []
        for _ in range(r.randrange(0, 6)):
            w += [f"w{r.randrange(10_000)}" for _ in range(r.randrange(0, 15))]
            kind = r.randrange(5)
            if kind == 0:
                w += line
            elif kind == 1:
                p = r.choice(passages)
                a = r.randrange(len(p))
                w += p[a : a + r.randrange(1, len(p) + 1)]
            elif kind == 2:
                w += ["same"] * r.randrange(0, 30)
            elif kind == 3:
                w += [r.choice("ab") for _ in range(r.randrange(0, 25))]
        rows.append((key * 3 % 250, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(5, rows[9][1]), (5, rows[9][1]), (77, rows[9][1] + "é"), (None, rows[3][1]), (None, None), (8, None), (9, "")]
    return rows


@pytest.mark.parametrize("seed,hot,bits", [(1, 4096, 27), (2, 3, 27), (3, 40, 16)])
def test_equals_dictionary_of_windows(spark, seed, hot, bits):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, repeats int").repartition(5)
    got = phrases.remove_repeats(docs, hot=hot, filter_bits=bits).select("doc_id", "repeats.*").collect()
    want = brute(rows)
    assert sum(w[2] > 0 for w in want) > 50
    order = lambda x: (x[0] is None, *x)
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in got)) == sorted((-1 if w[0] is None else w[0], *w[1:]) for w in want)
    assert all(sum(s.end - s.begin for s in r.removed) == r.n_removed for r in got) and order((1,))


def test_text_keys_empty_tables_and_drop(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    docs = spark.createDataFrame([("b", shared), ("a", shared + " own"), ("c", "x\ny " + shared), ("d", "x\ny")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in phrases.drop_repeats(docs).collect()} == {"a": shared + " own", "c": "x y", "d": "x\ny"}
    assert phrases.remove_repeats(docs.limit(0)).count() == 0
