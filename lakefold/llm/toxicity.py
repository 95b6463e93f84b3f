"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding puts texts in lower case, maps letters that look alike to Latin ones and digits or signs that stand for
letters to these, and turns everything else into blanks.  Lexicon entries are whole words or word beginnings
with a weight, matched by one automaton.  Signs at the end of a word that holds a letter are read as letters and as
blanks; a word counts once whichever readings match.  A match inside an exception phrase does not count.
The raw value is the weight of the matches per word; ``raw / (raw + c)`` puts it between 0 and 1, where ``c`` is
chosen so that the calibrated cut lies at a score of 0.3.

The lexicon, the exception phrases and the cut are learned from at most ``fit_rows`` labelled rows (the lowest
hashes of their ids), the lexicon itself is bounded by ``entries``.  Scoring is map-only.

Defined results: null, empty and wordless texts score 0; without labelled rows of both kinds the lexicon is empty
and all scores are 0; repeated ids each keep a row; all columns pass through, the result column replaces one of
its name.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .words import buffers, slices

FIT_ROWS = 20_000
ENTRIES = 2000
CUT = 0.3
LEAST_ODDS = 2.0
LEAST_TEXTS = 4  # toxic texts of an entry
SIGNIFICANT = 20.0  # likelihood-ratio statistic of an entry's share in toxic text (chance below 1e-5)
_EVIDENCE = 10
_EVERY = ""  # the row of totals
_SMOOTH = 10  # words added to the length, so that one match in a tiny text does not decide alone

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _fold_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x10000):
        c = chr(point)
        if 0xD800 <= point < 0xE000:
            continue
        lower = c.lower()
        c = lower if len(lower) == 1 else c
        if 0xFF00 < point < 0xFF5F or 0x2100 <= point < 0x2150:
            wide = unicodedata.normalize("NFKC", c).lower()
            c = wide if len(wide) == 1 else c
        c = _ALIKE.get(c, c)
        table[point] = ord(c) if c.isalpha() or c in _SIGNS else 0x20
    return table


_SIGN_TABLE = np.zeros(0x110000, np.uint32)
for _sign, _letter in _SIGNS.items():
    _SIGN_TABLE[ord(_sign)] = ord(_letter)
_tables: list[np.ndarray] = []


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray]:
    """One folded string for a batch (each text between blanks) and where each text begins in it."""
    folded, _, begin = readings(data, offsets)
    return folded, begin


def readings(data: np.ndarray, offsets: np.ndarray) -> tuple[str, str, np.ndarray]:
    """The folded string with the signs at the ends of words as blanks, the same with them as letters, and where each text begins.

    Both have the same words at the same places; a word without any letter is blank in both.
    """
    if not _tables:
        _tables.append(_fold_table())
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    rows = len(offsets) - 1
    begin = first[:-1] + np.arange(rows)
    folded = np.full(len(points) + rows + 1, 0x20, np.uint32)
    own = np.ones(len(folded), bool)
    own[begin] = False
    own[-1] = False
    folded[own] = _tables[0][points]
    # a sign before a letter of its word stands for a letter; those at the end of a word are read both ways
    full = np.where(_SIGN_TABLE[folded] > 0, _SIGN_TABLE[folded], folded)
    holds = np.concatenate([[0], np.cumsum((folded != 0x20) & (_SIGN_TABLE[folded] == 0))])
    word = np.flatnonzero(np.diff((folded != 0x20).astype(np.int8), prepend=0))  # borders of words with their signs
    starts, stops = word[::2], word[1::2]  # the last point is a blank, so each word ends
    none = holds[stops] == holds[starts]
    marks = np.zeros(len(folded) + 1, np.int64)
    marks[starts[none]] += 1
    marks[stops[none]] -= 1
    full[np.cumsum(marks)[:-1] > 0] = 0x20
    letters = folded != 0x20
    signs = _SIGN_TABLE[folded]
    place = np.flatnonzero(signs)
    for p in place[::-1].tolist():
        if letters[p + 1] and not _SIGN_TABLE[folded[p + 1]]:
            folded[p] = signs[p]
        else:
            folded[p] = 0x20
            letters[p] = False
    return folded.tobytes().decode("utf-32-le", "replace"), full.tobytes().decode("utf-32-le", "replace"), np.append(begin, len(folded) - 1)


def fold_text(text: str) -> str:
    return fold(np.frombuffer(text.encode("utf-8"), np.uint8), np.array([0, len(text.encode("utf-8"))]))[0]


@dataclass
class Lexicon:
    """``entries``: folded words, or word beginnings with a final ``*``, and their weights; ``constant``: the c above."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    constant: float = 1.0

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            whole = not entry.endswith("*")
            key = " " + entry.rstrip("*") + (" " if whole else "")
            machine.add_word(key, (len(key), weight, False))
        for phrase in self.exceptions:
            key = f" {phrase} "
            machine.add_word(key, (len(key), 0.0, True))
        machine.make_automaton()
        return machine


def _ends(folded: str, full: str, longest: int) -> Iterator[tuple[int, str]]:
    """(blank before it, reading) of each word that ends in signs with some but not all of these as letters."""
    one, two = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (folded, full))
    border = np.flatnonzero(np.diff((one != two).astype(np.int8), prepend=0))
    for a, b in zip(border[::2].tolist(), border[1::2].tolist()):
        start = folded.rfind(" ", 0, a)
        for end in range(a + 1, min(b, start + 2 + longest)):  # no longer reading can be an entry
            yield start, f" {full[start + 1 : end]} "


def _matches(machine, folded: str, full: str | None = None, longest: int = 0) -> Iterator[tuple[int, int, float]]:
    """(first letter, end, weight) of each match outside the exception phrases; of matches at one word the heaviest.

    ``full``: the other reading of the signs at word ends; a word counts once whichever of its readings match.
    """
    if not len(machine):
        return
    best: dict[int, tuple[int, float]] = {}
    void: list[tuple[int, int]] = []
    for last, (size, weight, exception) in machine.iter(folded):
        start = last - size + 1
        if exception:
            void.append((start, last))
        elif weight > best.get(start, (0, 0.0))[1]:
            best[start] = (last + 1, weight)
    if full is not None and full != folded:
        for last, (size, weight, exception) in machine.iter(full):
            start = last - size + 1
            if exception:
                void.append((start, last))
            elif weight > best.get(start, (0, 0.0))[1]:
                best[start] = (last + 1, weight)
        for start, reading in _ends(folded, full, longest):
            for last, (size, weight, exception) in machine.iter(reading):
                if not exception and last + 1 == size and weight > best.get(start, (0, 0.0))[1]:
                    best[start] = (start + size, weight)
    covered = np.zeros(0)
    if void:
        covered = np.zeros(len(folded) + 1, np.int32)
        for a, b in void:
            covered[a] += 1
            covered[b] -= 1
        covered = np.cumsum(covered)
    for start, (end, weight) in best.items():
        if not void or not covered[start]:
            yield start, end, weight


def _raw(machine, data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, number of matches and words of each text."""
    folded, full, begin = readings(data, offsets)
    rows = len(offsets) - 1
    weight, found = np.zeros(rows), np.zeros(rows, np.int64)
    for start, _, w in _matches(machine, folded, full, longest):
        row = np.searchsorted(begin, start, side="right") - 1
        weight[row] += w
        found[row] += 1
    blank = np.frombuffer(folded.encode("utf-32-le"), np.uint32) == 0x20
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    return weight, found, np.diff(np.searchsorted(starts, begin))


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.LongType()), T.StructField("n_words", T.LongType())])


def score_texts(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into``: score, matches and words."""
    fields = [f for f in docs.schema.fields if f.name != into]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by its number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, constant = shared.value.automaton(), shared.value.constant
        longest = max((len(e.rstrip("*")) for e in shared.value.entries), default=0)
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            parts = [_raw(machine, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], longest) for a, b in slices(offsets)]
            weight, found, words = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
            raw = weight / (words + _SMOOTH)
            result = pa.StructArray.from_arrays([pa.array(raw / (raw + constant)), pa.array(found), pa.array(words)], names=RESULT.names)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), result], names=[*(f.name for f in fields), into])

    return docs.select(*(F.col(f.name) for f in fields)).mapInArrow(run, T.StructType([*fields, T.StructField(into, RESULT)]))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", fit_rows: int = FIT_ROWS, entries: int = ENTRIES, exceptions: Iterable[str] = ()) -> Lexicon:
    """Learn a lexicon from labelled documents; equal texts count once, and only words by class leave the tasks."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(label).alias("__label"))
    sample = rows.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)  # bounded: two numbers a row
    texts = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("__key") == F.col("__id"))
    texts = texts.groupBy(F.md5("text").alias("h")).agg(F.first("text").alias("text"), F.max("__label").cast("long").alias("label")).drop("h")
    texts = stored(texts, "toxicity-sample")  # at most fit_rows texts, read several times
    counted = texts.mapInArrow(_candidates, "word string, docs long, toxic long, clean long").groupBy("word").agg(F.sum("docs").alias("t"), F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    total = counted.where(F.col("word") == _EVERY).first()
    if total is None or not total.a or not total.b:
        return Lexicon()
    # how much more often the entry stands in toxic than in clean text, for entries of some toxic texts whose share is no chance
    odds = F.log((F.col("a") + 0.5) / float(total.a)) - F.log((F.col("b") + 0.5) / float(total.b))
    share = total.a / (total.a + total.b)
    n = F.col("a") + F.col("b")
    term = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0)
    chosen = counted.where((F.col("t") >= LEAST_TEXTS) & (F.col("word") != _EVERY) & (2 * (term("a", share) + term("b", 1 - share)) >= SIGNIFICANT)).withColumn("w", odds).where(F.col("w") >= LEAST_ODDS).orderBy(F.desc(F.col("w") * F.col("t")), "word").limit(4 * entries)
    weights = {r.word: r.w for r in chosen.collect()}
    lexicon = Lexicon(_telling(texts, weights, entries, LEAST_TEXTS), tuple(fold_text(e).strip() for e in exceptions))
    lexicon.exceptions += _learned_exceptions(texts, lexicon)
    scored = score_texts(texts, Lexicon(lexicon.entries, lexicon.exceptions, 1.0)).select("label", "toxicity.score").collect()
    lexicon.constant = _constant([(s / (1 - s), y == 1) for y, s in scored])
    return lexicon


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word beginnings of 3 to 8 letters: toxic texts that have them, and occurrences in either class."""
    docs: Counter = Counter()
    words: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            own = Counter(w for w in fold_text(text).split() if len(w) > 2)
            words[label != 1].update(own)
            words[label != 1][_EVERY] += own.total()
            if label == 1:
                docs.update({*own, *(w[:k] + "*" for w in own for k in range(3, 9) if len(w) >= k)})
                docs[_EVERY] += 1
    for counts in words:
        for w, n in list(counts.items()):
            for k in range(3, min(8, len(w)) + 1):
                counts[w[:k] + "*"] += n
    names = list({*words[0], *words[1]})
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[n] for n in part]) for c in (docs, *words))], names=["word", "docs", "toxic", "clean"])


def _telling(texts: DataFrame, weights: dict[str, float], entries: int, least: int) -> dict[str, float]:
    """The candidates worth keeping: each adds more toxic texts that lack evidence than it hits clean ones.

    A toxic text lacks evidence while fewer than ``_EVIDENCE`` kept entries match it; a clean text counts by the share of
    its words that match, in full from one in a hundred.  The sample's matches by text are bounded by its size.
    """
    shared = texts.sparkSession.sparkContext.broadcast(list(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Lexicon({w: float(i) for i, w in enumerate(shared.value)}).automaton()
        for batch in batches:
            found, sizes = [], []
            for text in batch.column("text").to_pylist():
                folded = fold_text(text)
                found.append(Counter(int(i) for _, (_, i, _) in machine.iter(folded)) if len(machine) else Counter())
                sizes.append(len(folded.split()))
            columns = [batch.column("label"), pa.array(sizes, pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "words", "entry", "n"])

    toxic: dict[int, list[int]] = {}
    clean: Counter = Counter()
    lacking: list[int] = []
    for row in texts.mapInArrow(run, "label long, words long, entry array<long>, n array<long>").toLocalIterator():
        if row.label == 1:
            for e in row.entry:
                toxic.setdefault(e, []).append(len(lacking))
            lacking.append(_EVIDENCE)
        else:
            for e, n in zip(row.entry, row.n):
                clean[e] += min(1.0, 100 * n / (row.words + _SMOOTH))
    names = list(weights)
    kept: dict[str, float] = {}
    gain = lambda e: sum(lacking[t] > 0 for t in toxic[e]) - clean[e]
    order = [(-gain(e), -len(names[e].rstrip("*")), names[e].endswith("*"), names[e], e) for e in toxic]
    heapq.heapify(order)
    while order and len(kept) < entries and -order[0][0] >= least:
        old, size, beginning, name, e = heapq.heappop(order)
        stem = name.rstrip("*")
        if any(stem.startswith(k.rstrip("*")) or k.startswith(stem) for k in kept):
            continue  # a form of a kept entry is no further evidence
        now = gain(e)
        if now < -old:  # others took its texts
            heapq.heappush(order, (-now, size, beginning, name, e))
        else:
            kept[name] = min(weights[name], log(1e4))
            for t in toxic[e]:
                lacking[t] -= 1
    return kept


def _learned_exceptions(texts: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """A match with its neighbour word: phrases of three or more clean texts and of no toxic one (at most 1000)."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value.automaton()
        for batch in batches:
            phrases, labels = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                folded, own = fold_text(text), set()
                for start, _, _ in _matches(machine, folded):
                    word = folded[start + 1 : folded.index(" ", start + 1)]
                    before, after = folded[:start].rsplit(None, 1)[-1:], folded[start + 1 + len(word) :].split(None, 1)[:1]
                    own |= {f"{b} {word}" for b in before} | {f"{word} {a}" for a in after}
                phrases += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(labels, pa.int64())], names=["phrase", "label"])

    found = texts.mapInArrow(run, "phrase string, label long").groupBy("phrase").agg(F.max("label").alias("worst"), F.count("*").alias("n"))
    return tuple(r.phrase for r in found.where("worst <> 1 AND n >= 3").orderBy(F.desc("n"), "phrase").limit(1000).collect())


def _constant(rows: list[tuple[float, bool]]) -> float:
    """``c`` that puts the best F1 cut of the sample's raw values at the score CUT."""
    rows = sorted(rows, reverse=True)
    total = sum(y for _, y in rows)
    best, cut, hits = 0.0, 1.0, 0
    for k, (raw, toxic) in enumerate(rows):
        hits += toxic
        if k + 1 < len(rows) and rows[k + 1][0] == raw or raw <= 0:
            continue
        f1 = 2 * hits / (k + 1 + total)
        if f1 > best:
            below = rows[k + 1][0] if k + 1 < len(rows) else 0.0
            best, cut = f1, (raw + below) / 2
    return cut * (1 - CUT) / CUT


def filter_toxic(docs: DataFrame, lexicon: Lexicon, cut: float = CUT, text: str = "text") -> DataFrame:
    """The documents that score below the cut."""
    return score_texts(docs, lexicon, text=text, into="__toxicity").where(F.col("__toxicity.score") < cut).drop("__toxicity")
