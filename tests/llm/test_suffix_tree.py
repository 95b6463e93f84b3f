"""Scores of the suffix tree against a tree of plain dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakefold.llm import suffix_tree

END = "\n"


def dictionary_scores(texts: list[tuple], train, divergence: float) -> list[tuple]:
    """Every token's probability in the longest kept context of its text; what is seen twice is listed, whatever the number of tokens."""
    tokens = [(i, [END, *(t or "").split(" "), END] if t else [END, END]) for i, t in texts]
    counts, grams = Counter(), [Counter(), Counter()]
    for i, line in tokens:
        if train(i):
            counts.update(line[1:])
            grams[0].update(zip(line, line[1:]))
            grams[1].update(zip(line, line[1:], line[2:]))
    n, once = sum(counts.values()), sum(c == 1 for c in counts.values())
    root = lambda w: counts[w] / (n + once) if counts[w] else once / (n + once)
    kept: dict = {}

    def chance(history: tuple, word: str) -> float:
        p = root(word)
        for d in (1, 2):
            context = history[-d:] if len(history) >= d else None
            if context in kept:
                nexts, left, total = kept[context]
                p = left * p + nexts.get(word, 0) / total
        return p

    for d in (1, 2):
        found: dict = {}
        for g, c in grams[d - 1].items():
            if c >= 2:
                found.setdefault(g[:-1], {})[g[-1]] = c
        level = {}
        for context, nexts in found.items():
            seen = counts[context[0]] if d == 1 else grams[0][context]
            total = seen + len(nexts)
            left = (total - sum(nexts.values())) / total
            below = {w: chance(context[1:] if d > 1 else (), w) for w in nexts}
            own = {w: c / total + left * below[w] for w, c in nexts.items()}
            p, q = min(sum(own.values()), 1 - 1e-9), min(sum(below.values()), 1 - 1e-9)
            if sum(o * math.log(o / below[w]) for w, o in own.items()) + (1 - p) * math.log((1 - p) / (1 - q)) >= divergence:
                level[context] = (nexts, left, total)
        kept.update(level)
    return sorted((i, round(sum(math.log10(chance(tuple(line[:k][-2:]), line[k])) for k in range(1, len(line))), 6)) for i, line in tokens)


def test_suffix_tree_lists_what_is_seen_twice_in_a_large_corpus(spark):
    """A share of the corpus as the least count left these passages out; the dictionaries have no such bound."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [(i, " ".join(rng.choices(words, k=400))) for i in range(1500)]
    passage = " ".join(f"once{k}" for k in range(30))
    texts += [(5000 + k, passage) for k in range(2)] + [(6000, "one two three one two four"), (6001, "one two three"), (7000, ""), (7001, None), (7001, "w1 w2 unseen"), (7003, "w1 w2 unseen")]
    assert sum(len((t or "").split(" ")) for _, t in texts) > 600_000
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = suffix_tree.score_texts(frame, F.col("doc_id") != 7003).select("doc_id", "score").collect()
    want = dictionary_scores(texts, lambda i: i != 7003, suffix_tree.DIVERGENCE)
    got = sorted((r.doc_id, r.score) for r in found)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)


def test_suffix_tree_does_not_depend_on_marks_and_buckets(spark, monkeypatch):
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randrange(1, 80)))) for i in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    want = dict(suffix_tree.score_texts(frame, F.lit(True)).select("doc_id", "score").collect())
    monkeypatch.setattr(suffix_tree, "MARK_BITS", 15)
    monkeypatch.setattr(suffix_tree, "_BUCKET_GRAMS", 700)
    monkeypatch.setattr(suffix_tree, "_HEAD", 1e-2)
    assert dict(suffix_tree.score_texts(frame.repartition(3), F.lit(True)).select("doc_id", "score").collect()) == pytest.approx(want, abs=1e-6)
