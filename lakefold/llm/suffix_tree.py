"""Language model scoring with a probabilistic suffix tree.

Symbols are the words of a text in lower case (A-Z), then one end symbol; a text begins in the context of the end
symbol and no context reaches over it, so a score does not depend on the text before.  Like the unigram base, the model speaks about the words of the training rows and one unknown word.

The tree holds contexts of one and two preceding words.  A gram (a context and its next word) that occurs ``SEEN`` times
or more in the training rows is listed, whatever the size of the corpus, and its context is a candidate.  So the tree
grows with the corpus; it is a table and is never gathered or broadcast.  A candidate stays if its next-word
distribution diverges from that of its suffix by ``DIVERGENCE`` nats or more.  Distributions are smoothed: a state gives
the listed words their counts and the rest of its mass, with the Witten-Bell weight, to the distribution of its suffix;
the root gives the unknown word the Good-Turing mass of the words seen once.  A token is scored in the state of the
longest kept suffix of its history.

The logarithm of a token's probability is a sum over its word, its listed grams and its contexts, so a text's score is
the sum of one value for each of its words and grams (see ``_level``).  Grams go by 64-bit hashes: a block of texts
sends each of its grams once to the gram's bucket, where the counts are summed or the values looked up, and the sums go
back to the texts.  The number of buckets follows the number of training tokens, so a task's memory does not.
A bitmap of at most ``MARK_BITS`` bits keeps most grams that cannot be listed from travelling; a fuller one costs
shuffle and changes nothing.

The root and the unigram base need the count of every word.  The most frequent words are looked up in place; the others
once a block of texts: a row (block, word, places) is joined to the word counts and summed back to the texts, so no
growing table is broadcast and a word is one row a block.  Words are known by 64-bit hashes.

Defined results: a null text counts as empty, which is the end symbol alone; without training rows every token
is the unknown word with probability 1; repeated ids each keep a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored, stored_at
from .words import Words, buffers, mix, per_row, slices

#: Occurrences that a listed gram has at least; ``least`` asks for a share of the training tokens too.
SEEN = 2.0
LEAST = 0.0
DIVERGENCE = 0.05
#: Words before the next one in the longest context.
DEPTH = 2

#: Share of the training tokens from which a word is looked up in place; it has no part in the result.
_HEAD = 1e-5
#: Grams of a bucket, about, and the base-2 logarithm of the bits that mark listed ones.
_BUCKET_GRAMS = 2_000_000
MARK_BITS = 28
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BITS = 20  # of a word's number in a gram's code of the gathered tree
#: Hash of the end symbol, which is no word.
_END = int(mix(np.array([0x0A], np.uint64)).view(np.int64)[0])


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, led by an end symbol, and the place of each text's first token."""
    rows = len(words.first) - 1
    first = words.first + np.arange(rows + 1) + 1
    stream = np.full(1 + len(words) + rows, _END, np.int64)
    stream[np.arange(len(words)) + words.rows + 1] = words.hashes().view(np.int64)
    return stream, first


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for a, b in slices(offsets):
            yield batch, a, b, *tokens(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def _counted(docs: DataFrame, codes) -> DataFrame:
    """Counts of the codes that ``codes(token stream)`` gives, summed per slice first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, stream, _ in _batches(batches, 0):
            code, n = np.unique(codes(stream), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _numbers(known: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """The place of each token in the sorted hashes ``known``, or -1."""
    if not len(known):
        return np.full(len(stream), -1)
    place = np.minimum(np.searchsorted(known, stream), len(known) - 1)
    return np.where(known[place] == stream, place, -1)


class SuffixTree:
    """Kept contexts by length: sorted codes, and for each the mass left to its suffix and listed next words."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, total: int, once: int):
        self.known, self.root = known, counts / max(total + once, 1)
        self.unknown = once / (total + once) if once else (1.0 if not total else 0.5 / total)
        self.totals = counts
        self.end = int(_numbers(known, np.array([_END]))[0])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def _state(self, level: tuple, code: np.ndarray) -> np.ndarray:
        contexts = level[0]
        if not len(contexts):
            return np.full(len(code), -1)
        place = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
        return np.where((contexts[place] == code) & (code >= 0), place, -1)

    def probabilities(self, number: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Probability of each token but the first in its longest kept state, given its root probabilities.

        With ``root`` 1 the result for an unlisted token is the factor on its root probability.
        """
        out = root.copy()
        context = number[:-1].astype(np.int64)
        for d, level in enumerate(self.levels):
            if d:  # one word further back; without it there is no longer context
                back = np.concatenate([np.full(d, -1), number[: -1 - d]])
                nearer = np.concatenate([np.full(d - 1, -1), number[: len(number) - d]])
                back = np.where(nearer == self.end, -1, back)  # a text begins at the end symbol
                context = np.where((context >= 0) & (back >= 0), (back << (_BITS * d)) | context, -1)
            state = self._state(level, context)
            at = np.flatnonzero(state >= 0)
            if not len(at):
                continue
            _, left, grams, listed = level
            out[at] *= left[state[at]]
            if len(grams):
                code = (context[at] << _BITS) | number[1:][at]
                place = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                hit = (number[1:][at] >= 0) & (grams[place] == code)
                out[at[hit]] += listed[place[hit]]
        return out

    def grow(self, grams: np.ndarray, n: np.ndarray, totals: np.ndarray, divergence: float) -> None:
        """Add the contexts one word longer, from the counts of grams (sorted codes) and of their contexts."""
        depth = len(self.levels)
        context = grams >> _BITS
        first = np.flatnonzero(np.diff(context, prepend=-1))
        codes = context[first]
        word = grams & ((1 << _BITS) - 1)
        kinds = np.diff(np.append(first, len(grams)))
        state = np.repeat(np.arange(len(codes)), kinds)
        total = totals.astype(float)
        listed = n / (total + kinds)[state]
        left = (total - np.add.reduceat(n, first) + kinds) / (total + kinds) if len(first) else np.zeros(0)
        # the suffix's distribution at the listed words
        below = self.root[word]
        stream = [(context >> (_BITS * k)) & ((1 << _BITS) - 1) for k in range(depth)]
        for d, level in enumerate(self.levels):
            suffix = sum((stream[k] << (_BITS * k) for k in range(1, d + 1)), stream[0]) if d < depth else context
            at = self._state(level, suffix)
            ok = np.flatnonzero(at >= 0)
            below[ok] *= level[1][at[ok]]
            place = np.minimum(np.searchsorted(level[2], (suffix[ok] << _BITS) | word[ok]), max(len(level[2]) - 1, 0))
            hit = level[2][place] == (suffix[ok] << _BITS) | word[ok] if len(level[2]) else np.zeros(len(ok), bool)
            below[ok[hit]] += level[3][place[hit]]
        own = listed + left[state] * below
        sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        p, q = np.minimum(sums(own), 1 - 1e-9), np.minimum(sums(below), 1 - 1e-9)
        kept = sums(own * np.log(own / below)) + (1 - p) * np.log((1 - p) / (1 - q)) >= divergence
        self.levels.append((codes[kept], left[kept], grams[kept[state]], listed[kept[state]]))


def fit(docs: DataFrame, vocabulary: DataFrame, *, least: float = LEAST, divergence: float = DIVERGENCE) -> tuple[SuffixTree, int, int]:
    """The tree gathered in memory, the number of training tokens and of distinct ones; ``docs`` has the training texts only.

    It is for few words (below 2 ** 20 listed ones); ``score_texts`` builds the same tree as tables and never calls this.
    """
    total, distinct, once = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))).first()
    bound = max(SEEN, least * total)

    def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = counts.where(F.col("n") >= bound).toArrow()
        order = np.argsort(rows["code"].to_numpy())
        return rows["code"].to_numpy()[order], rows["n"].to_numpy()[order]

    known, counts = frequent(vocabulary)
    if len(known) >= 1 << _BITS:
        raise ValueError(f"{len(known)} listed words; raise least or use score_texts")
    tree = SuffixTree(known, counts, total, once)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def pairs(stream: np.ndarray) -> np.ndarray:
        number = _numbers(shared.value, stream)
        both = (number[:-1] >= 0) & (number[1:] >= 0)
        return (number[:-1][both] << _BITS) | number[1:][both]

    bigrams, n2 = frequent(_counted(docs, pairs))
    tree.grow(bigrams, n2, counts[np.unique(bigrams >> _BITS)], divergence)
    contexts = spark.sparkContext.broadcast(bigrams)

    def triples(stream: np.ndarray) -> np.ndarray:
        number = _numbers(shared.value, stream)
        if len(number) < 3:
            return np.zeros(0, np.int64)
        at = np.flatnonzero((number[:-2] >= 0) & (number[1:-1] >= 0) & (number[2:] >= 0) & (number[1:-1] != tree.end))
        context = (number[at] << _BITS) | number[at + 1]
        at = at[_numbers(contexts.value, context) >= 0]
        return (number[at] << (2 * _BITS)) | (number[at + 1] << _BITS) | number[at + 2]

    if len(bigrams):
        trigrams, n3 = frequent(_counted(docs, triples))
        tree.grow(trigrams, n3, n2[np.searchsorted(bigrams, np.unique(trigrams >> _BITS))], divergence)
    return tree, total, distinct


def _longer(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Codes of the grams with these contexts and suffixes."""
    return mix(context.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + suffix.view(np.uint64)).view(np.int64)


def _grams(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every gram with ``depth`` words of context: the place of its last token, and the codes of its context and of its suffix."""
    code, valid = stream, np.ones(len(stream), bool)
    for d in range(1, depth + 1):
        context, suffix, valid = code[:-1], code[1:], valid[:-1]
        if d > 1:  # a text begins at the end symbol, and no context reaches over it
            valid = valid & (stream[d - 1 : -1] != _END)
        if d < depth:
            code = _longer(context, suffix)
    at = np.flatnonzero(valid)
    return at + depth, context[at], suffix[at]


def _marked(marks: np.ndarray, code: np.ndarray) -> np.ndarray:
    place = code & (len(marks) * 8 - 1)
    return (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _marks(codes: DataFrame, n: int) -> np.ndarray:
    """A bitmap with the low bits of all codes, of eight bits a code and at most ``2 ** MARK_BITS``."""
    bits = min(max(int(8 * n).bit_length(), 15), MARK_BITS)
    place = F.col("code").bitwiseAND(F.lit((1 << bits) - 1))
    paged = codes.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(F.lit(32767)).alias("bit")).repartition("page")  # a page is built in one task
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for page, found in paged.groupBy("page").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        marks[page * 4096 : page * 4096 + 4096] = np.frombuffer(bytes(found), np.uint8)
    return marks


def _by_bucket(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the codes by bucket and code, the buckets that have some, and where each begins and ends there."""
    order = np.argsort(codes.view(np.uint64), kind="stable")
    high = codes[order].view(np.uint64) >> np.uint64(32)  # a bucket is a range of codes
    bucket = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return order, bucket[first], np.append(first, len(codes))


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the values between two bounds each, as one binary value."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _arrays(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind) for value in column]


def _in_buckets(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", *order)


def _count_grams(texts: DataFrame, depth: int, marks: np.ndarray, bound: float, buckets: int) -> DataFrame:
    """``(code, context, suffix, n)`` of the grams seen ``bound`` times; ``marks`` has all codes of one word less that can be part of them."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, stream, _ in _batches(batches, 0):
            _, context, suffix = _grams(stream, depth)
            may = _marked(shared.value, suffix)
            may[may] = _marked(shared.value, context[may])
            context, suffix = context[may], suffix[may]
            code, first, n = np.unique(_longer(context, suffix), return_index=True, return_counts=True)
            order, bucket, bounds = _by_bucket(code, buckets)
            order = order[np.lexsort((context[first[order]], np.repeat(bucket, np.diff(bounds))))]  # equal contexts side by side compress
            at = first[order]
            columns = [pa.array(bucket), _blobs(context[at], bounds), _blobs(suffix[at], bounds), _blobs(n[order].astype(np.uint32), bounds)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "context", "suffix", "n"])

    def merged(parts: list[tuple]) -> pa.RecordBatch:
        context, suffix, n = (np.concatenate(p) for p in zip(*parts))
        code = _longer(context, suffix)
        order = np.argsort(code)
        first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else np.zeros(0, np.int64)
        total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        kept = total >= bound
        at = order[first[kept]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (code[at], context[at], suffix[at], total[kept])], names=["code", "context", "suffix", "n"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            columns = zip(batch.column("bucket").to_pylist(), _arrays(batch.column("context"), np.int64), _arrays(batch.column("suffix"), np.int64), _arrays(batch.column("n"), np.uint32))
            for bucket, *arrays in columns:
                if bucket != current:
                    if parts:
                        yield merged(parts)
                    current, parts = bucket, []
                parts.append(arrays)
        if parts:
            yield merged(parts)

    sent = texts.mapInArrow(send, "bucket int, context binary, suffix binary, n binary")
    return _in_buckets(sent, buckets).mapInArrow(receive, "code long, context long, suffix long, n long")


def _sum_values(texts: DataFrame, depth: int, values: DataFrame, marks: np.ndarray, buckets: int) -> DataFrame:
    """``(row, more)``: per text (row, text) the sum of ``values`` (code, value) over its grams."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, stream, first in _batches(batches, 1):
            rows = batch.column("row").to_numpy()[a:b]
            at, context, suffix = _grams(stream, depth)
            code = _longer(context, suffix)
            may = _marked(shared.value, code)
            owner = rows[np.searchsorted(first, at[may], side="right") - 1]
            base = int(rows.min())
            order, bucket, bounds = _by_bucket(code[may], buckets)
            owner = owner[order] - base
            owner = owner.astype(np.uint16 if not len(owner) or owner.max() < 1 << 16 else np.int64)
            code = code[may][order]
            # a code goes once, with the number of its places
            begin = np.flatnonzero(np.append(True, np.diff(code) != 0)) if len(code) else np.zeros(0, np.int64)
            kinds = np.searchsorted(begin, bounds)
            times = np.diff(np.append(begin, len(code))).astype(np.uint32)
            columns = [
                pa.array(bucket), pa.array(np.full(len(bucket), base)), _blobs(code[begin], kinds), _blobs(times, kinds), _blobs(owner, bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "base", "code", "times", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(pending)
            code = table["code"].to_numpy()
            order, bucket, bounds = _by_bucket(code, buckets)
            columns = [
                pa.array(bucket), pa.nulls(len(bucket), pa.int64()), _blobs(code[order], bounds), pa.nulls(len(bucket), pa.binary()),
                _blobs(table["value"].to_numpy()[order], bounds),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "base", "code", "times", "data"])

        pending = []
        for batch in batches:
            pending.append(batch)
            if sum(p.num_rows for p in pending) >= _BUCKET_GRAMS // 4:
                yield packed()
                pending = []
        if pending:
            yield packed()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, known, value = None, [], None, None
        for batch in batches:
            columns = zip(batch.column("bucket").to_pylist(), batch.column("base").to_pylist(), _arrays(batch.column("code"), np.int64), _arrays(batch.column("times"), np.uint32), batch.column("data"))
            for bucket, base, code, times, data in columns:
                if bucket != current:
                    current, parts, known = bucket, [], None
                if base is None:  # the values of a bucket come first
                    parts.append((code, np.frombuffer(data.as_buffer(), np.float64)))
                    continue
                if known is None:
                    known, value = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
                    order = np.argsort(known)
                    known, value, parts = known[order].astype(np.int64), value[order], []
                place = _numbers(known, code)
                hit = np.repeat(place >= 0, times)
                data = data.as_buffer()
                owner = np.frombuffer(data, np.uint16 if data.size == 2 * len(hit) else np.int64)[hit]
                rows, place_of = np.unique(owner, return_inverse=True)
                if not len(rows):
                    continue
                more = np.bincount(place_of, np.repeat(value[place[place >= 0]], times[place >= 0]))
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64) + base), pa.array(more)], names=["row", "more"])

    schema = "bucket int, base long, code binary, times binary, data binary"
    both = texts.select("row", "text").mapInArrow(send, schema).unionByName(values.select("code", "value").mapInArrow(pack, schema))
    return _in_buckets(both, buckets, F.col("base").asc_nulls_first()).mapInArrow(receive, "row long, more double").groupBy("row").agg(F.sum("more").alias("more"))


def _level(grams: DataFrame, below: DataFrame, divergence: float) -> DataFrame:
    """One level of the tree: ``(code, n, p, gain, context, passed)`` of its grams.

    ``below`` has of every listed gram of one word less its count ``n`` and probability ``p`` in the longest kept context.
    At a kept context a token's log probability changes by ``passed``, the logarithm of the mass left to the suffix, and by
    ``gain`` on top if the gram is listed there; ``passed`` is null at other contexts.
    """
    # both joins read the same columns, so they share one exchange
    under = below.toDF("suffix", "suffix_n", "under")
    totals = below.toDF("context", "total", "context_p")
    whole = Window.partitionBy("context")
    rows = grams.join(under, "suffix").drop("suffix", "suffix_n").join(totals, "context").drop("context_p")
    rows = rows.withColumn("kinds", F.count(F.lit(1)).over(whole)).withColumn("listed", F.sum("n").over(whole))
    mass = F.col("total") + F.col("kinds")
    rows = rows.withColumn("left", (F.col("total") - F.col("listed") + F.col("kinds")) / mass)
    rows = rows.withColumn("own", F.col("n") / mass + F.col("left") * F.col("under"))
    for name, value in (("p_own", "own"), ("p_under", "under")):
        rows = rows.withColumn(name, F.least(F.sum(value).over(whole), F.lit(1 - 1e-9)))
    rest = (1 - F.col("p_own")) * F.log((1 - F.col("p_own")) / (1 - F.col("p_under")))
    kept = F.sum(F.col("own") * F.log(F.col("own") / F.col("under"))).over(whole) + rest >= divergence
    rows = rows.withColumn("kept", kept)
    return rows.select(
        "code", "n", F.when(F.col("kept"), F.col("own")).otherwise(F.col("under")).alias("p"),
        F.when(F.col("kept"), F.log10(F.col("own") / F.col("under")) - F.log10("left")).otherwise(0.0).cast("float").alias("gain"),
        "context", F.when(F.col("kept"), F.log10("left")).cast("float").alias("passed"),
    )


def _passed(level: DataFrame) -> DataFrame:
    """``(code, passed)`` of the kept contexts."""
    return level.where("passed IS NOT NULL").groupBy(F.col("context").alias("code")).agg(F.first("passed").alias("passed"))


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a job go when it ends: its result is stored."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


SCORED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("at", T.ArrayType(T.LongType()))]))),
    ]
)


def score_texts(docs: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text", least: float = LEAST, divergence: float = DIVERGENCE) -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score and score (the tree's log10 probability of the text)."""
    spark = docs.sparkSession
    with _tidy(spark):
        own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"), train.alias("train"))
        texts, texts_path = stored_at(own, "texts", "zstd")
        training = texts.where("train").select("text")
        vocabulary, counts_path = stored_at(_counted(training, lambda stream: stream[1:]), "word-counts")
        total, distinct, once = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))).first()
        bound = max(SEEN, least * total)
        buckets = max(1, -(-total // _BUCKET_GRAMS))
        below = vocabulary.where(F.col("n") >= bound).select("code", "n", (F.col("n") / max(total + once, 1)).alias("p"))
        marks, levels, passed, spent = [_marks(below, below.count())], [], [], [texts_path]
        for depth in range(1, DEPTH + 1):
            grams, grams_path = stored_at(_count_grams(training, depth, marks[-1], bound, buckets), "grams")
            level = _level(grams, below, divergence)
            level, level_path = stored_at(level if depth < DEPTH else level.drop("n", "p"), "level")
            discard(spark, grams_path)
            contexts, contexts_path = stored_at(_passed(level), "contexts")
            levels.append(level), passed.append(contexts)
            spent += [level_path, contexts_path]
            marks.append(_marks(level, level.count()))
            below = level.select("code", "n", "p") if depth < DEPTH else None
        # a word or gram has one value: its own gain, and what is passed on where it is the context of the next token
        words = stored(vocabulary.join(passed[0], "code", "left").select("code", "n", F.coalesce("passed", F.lit(0.0)).alias("value")), "words")
        discard(spark, counts_path)
        sums = []
        for depth, level in enumerate(levels, 1):
            values = level.select("code", F.col("gain").cast("double").alias("value"))
            if depth < DEPTH:
                values = level.select("code", "gain").join(passed[depth], "code", "left").select("code", (F.col("gain").cast("double") + F.coalesce("passed", F.lit(0.0))).alias("value"))
            sums.append(stored(_sum_values(texts, depth, values.where("value <> 0"), marks[depth], buckets), "sums"))
        head = words.where(F.col("n") >= max(SEEN, _HEAD * total)).orderBy("code").toArrow()  # at most 1 / _HEAD rows
        scored = stored(_word_scores(texts, head, total, distinct, once), "scored")
        for path in spent:
            discard(spark, path)
    divisor = total + 0.1 * (distinct + 1)
    unknown = once / (total + once) if once else (1.0 if not total else 0.5 / total)
    rare = scored.select(F.explode("rare").alias("r")).select("r.word", "r.at").join(words.withColumnRenamed("code", "word"), "word", "left")
    found = rare.select(F.explode("at").alias("row"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0.0)).alias("value"))
    root = F.when(F.col("n") > 0, F.col("n") / max(total + once, 1)).otherwise(F.lit(float(unknown)))
    words_more = found.groupBy("row").agg(
        F.sum(F.log10((F.col("n") + 0.1) / divisor)).alias("more"),
        F.sum((F.col("n") > 0).cast("long")).alias("more_known"),
        F.sum(F.col("value") + F.log10(root)).alias("more_score"),
    )
    result = scored.drop("rare").join(words_more, "row", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    for depth, more in enumerate(sums, 1):
        result = result.join(more.withColumnRenamed("more", f"grams_{depth}"), "row", "left")
        score = score + F.coalesce(f"grams_{depth}", F.lit(0.0))
    return result.select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
    )


def _word_scores(texts: DataFrame, head: pa.Table, total: int, distinct: int, once: int) -> DataFrame:
    """Per text the sums over the words of ``head`` (code, n, value) and the places of its other words."""
    shared = texts.sparkSession.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("code", "n", "value")))
    divisor = total + 0.1 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, value = shared.value
        own = np.log10(n / max(total + once, 1)) + value
        base_of = np.log10((n + 0.1) / divisor)
        for batch, a, b, stream, first in _batches(batches, 2):
            rows = batch.column("row").to_numpy()[a:b]
            number = _numbers(known, stream[1:])
            listed = number >= 0
            logs, base = np.zeros(len(number)), np.zeros(len(number))
            logs[listed], base[listed] = own[number[listed]], base_of[number[listed]]
            # the other words of the slice, each with the texts of its places
            other = np.flatnonzero(~listed)
            other = other[np.argsort(stream[1:][other], kind="stable")]
            names, begin = np.unique(stream[1:][other], return_index=True)
            owner = rows[np.searchsorted(first, other + 1, side="right") - 1]
            places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(other)), pa.int32()), pa.array(owner))
            pairs = pa.StructArray.from_arrays([pa.array(names), places], names=["word", "at"])
            bounds = np.zeros(b - a + 1, np.int32)
            bounds[1:] = len(names)  # the slice's first row carries them all
            borders = first - 1
            result = [
                pa.array(rows),
                pa.array(np.diff(first)),
                pa.array(per_row(listed, borders)),
                pa.array(per_row(base, borders)),
                pa.array(per_row(logs, borders)),
                pa.ListArray.from_arrays(pa.array(bounds), pairs),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key")[a:b], *result], names=["key", *SCORED.names])

    schema = T.StructType([texts.schema["key"], *SCORED.fields])
    return texts.select("key", "row", "text").mapInArrow(run, schema)
