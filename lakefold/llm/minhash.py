"""Near-duplicate classes by consistent weighted sampling.

Texts are cut into lower-case words of letters, digits and non-ASCII characters; five consecutive words are a
shingle (a shorter text is one shingle).  A shingle weighs its term frequency times ``1 + mean idf``, the mean over
its words of their inverse document frequency scaled to 0 .. 1.  Document frequencies are counted over all documents
in ``2 ** IDF_BITS`` bins of hashed words, so the table is bounded and broadcast; frequent words stand out, rare
ones share bins.

Improved consistent weighted sampling draws per hash function the shingle with the least ``ln c - r (t - b) - r``,
``t = floor(ln w / r + b)``; its variates come from fixed tables, addressed by a keyed hash of the shingle.
Signatures are cut into bands.  Texts with equal words are collapsed first.  In each bucket every member is compared
with the most central text, that whose buckets are largest over all bands.  Then, where members of a bucket are
still in different components, buckets of up to ``SMALL`` texts compare all members of different components; the
members of larger ones are searched exactly: a prefix-filter join on their rarest shingles by weight finds all pairs of
different components that can be alike.  It goes by levels, first against few texts of each shingle, then against ever
more; the pairs of a level are verified, the likeliest first, until none is left, and the next level lists only what is
still apart.  Pairs of the
first two steps whose signatures agree, and all pairs of the last, are verified by the exact weighted Jaccard
similarity of their texts.  Classes are the components of the verified links.

Defined results: null and empty texts are each a class of their own; texts without words are alike if their bytes are
equal; repeated rows share their class; a row with a null id is never looked up again, so only exact copies join it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import may_match, small_batches, stored
from .words import NOT_ALNUM, Words, buffers, mix, per_row, slices, span_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 13, 3
SMALL = 32
RARE_BITS = 18
BLOCK = 256
FIRST = 8  # candidates of a text and a component that are verified first; each round takes the square of it as many times more
IDF_BITS = 16
_TABLE_BITS = 16
_GRAIN = 64  # weights are multiples of 1 / 64, so equal shingles weigh the same to the last bit
_CHUNK = 1 << 16
_SLICE = 1 << 20  # bytes of text taken at once

_variates: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln c of the sampling scheme: Gamma(2, 1), uniform, ln Gamma(2, 1)."""
    if not _variates:
        rng = np.random.Generator(np.random.PCG64(20150801))
        n = 1 << _TABLE_BITS
        _variates.append((rng.gamma(2, 1, n).astype(np.float32), rng.random(n, np.float32), np.log(rng.gamma(2, 1, n)).astype(np.float32)))
    return _variates[0]


class Shingles:
    """Distinct shingles of the rows of a batch: row, hash, weight; ``first`` bounds each row's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, idf: np.ndarray, width: int = WIDTH):
        self.words = Words(data, offsets, NOT_ALNUM)
        counts, hashes = self.words.counts, self.words.hashes()
        terms = idf[(hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
        sums = np.concatenate([[0.0], np.cumsum(terms)])
        rows, codes, weights = [], [], []
        for size in range(1, width + 1):
            if size < width and not (counts == size).any():
                continue
            at, found = self.words.windows(hashes, size)
            row = np.searchsorted(self.words.first, at, side="right") - 1
            if size < width:
                own = counts[row] == size
                at, found, row = at[own], found[own], row[own]
            rows.append(row)
            codes.append(found)
            weights.append(np.round(_GRAIN * (1 + (sums[at + size] - sums[at]) / size)))
        row, code, weight = (np.concatenate(x) for x in (rows, codes, weights))
        _, index, times = np.unique(mix(code + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        order = np.argsort(row[index], kind="stable")
        index, times = index[order], times[order]
        self.row, self.code, self.weight = row[index], code[index], times * weight[index] / _GRAIN
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))


def signatures(shingles: Shingles, hashes: int) -> np.ndarray:
    """A row of ``hashes`` 32-bit samples per text; zeros where it has no shingle."""
    r, b, c = _tables()
    rows = len(shingles.first) - 1
    out = np.zeros((rows, hashes), np.uint32)
    keys = mix(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
    row = 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(shingles.first, shingles.first[row] + _CHUNK, side="right")) - 1)
        lo, hi = shingles.first[row], shingles.first[end]
        code, logs = shingles.code[lo:hi], np.log(shingles.weight[lo:hi]).astype(np.float32)
        begin = shingles.first[row:end] - lo
        full = np.flatnonzero(np.diff(shingles.first[row : end + 1]))
        begin, size = begin[full], np.diff(np.append(begin[full], hi - lo))
        for k in range(hashes if len(full) else 0):
            at = ((code * keys[k]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int32)
            step, shift = r[at], b[at]
            t = np.floor(logs / step + shift)
            value = c[at] - step * (t - shift + 1)
            least = np.minimum.reduceat(value, begin)
            hit = np.flatnonzero(value == np.repeat(least, size))
            hit = hit[np.searchsorted(hit, begin)]  # the first of each text
            out[row + full, k] = mix((at[hit].astype(np.uint64) << np.uint64(32)) + t[hit].astype(np.int64).view(np.uint64)).astype(np.uint32)
        row = end
    return out


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequencies, scaled to 0 .. 1, of the bins of hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            rows += len(batch)
            for a, b in slices(offsets, _SLICE):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)
                bins = (words.hashes() >> np.uint64(64 - IDF_BITS)).astype(np.int64)
                total += np.bincount(np.unique((words.rows << IDF_BITS) | bins) & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["bin", "n"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        counted = counts.toArrow()
    bins, n = counted["bin"].to_numpy(), counted["n"].to_numpy()  # at most 2 ** IDF_BITS + 1 rows
    documents = int(n[bins < 0].sum())
    frequency = np.zeros(1 << IDF_BITS)
    frequency[bins[bins >= 0]] = n[bins >= 0]
    return np.log((1 + documents) / (1 + frequency)) / np.log(2 + documents)


SIGNED = T.StructType(
    [
        T.StructField("rid", T.LongType()),
        T.StructField("print", T.LongType()),
        T.StructField("check", T.LongType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def sign(docs: DataFrame, idf, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Row number, fingerprints (null for an empty text), weight, signature and band keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, _SLICE):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                shingles = Shingles(part, local, idf.value)
                prints = fingerprints(shingles.words)
                found = signatures(shingles, bands * rows)
                cells = found.reshape(-1, bands, rows).astype(np.uint64)
                code = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:2])
                for k in range(rows):
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
                lists = np.where(np.diff(shingles.first) > 0, bands, 0)
                code = np.ascontiguousarray(code[lists > 0]).view(np.int64).ravel()
                empty = np.diff(local) == 0
                columns = [
                    batch.column(0)[a:b],
                    pa.array(rid + np.arange(b - a)),
                    *(pa.array(p.view(np.int64), mask=empty) for p in prints),
                    pa.array(per_row(shingles.weight, shingles.first)),
                    pa.array([s.tobytes() for s in found], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), pa.array(code)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *SIGNED.names])
                rid += b - a

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, T.StructType([docs.schema[key], *SIGNED.fields]))


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's word sequence, or of its bytes if it has no word."""
    hashes = words.hashes()
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(words.first[:-1], words.counts).astype(np.uint64)
    none = words.counts == 0
    raw = span_hashes(words.raw, words.offsets[:-1], words.offsets[1:])
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        mixed = mix(mix(hashes + np.uint64(salt)) + place * np.uint64(0xD1B54A32D192ED03))
        out.append(np.where(none, raw + np.uint64(salt), mix(per_row(mixed.view(np.int64), words.first).view(np.uint64) + np.uint64(salt))))
    return out[0], out[1]


def texts_of(docs: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of the documents whose key is in ``keys`` (distinct, named key); the other texts are not shuffled."""
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return may_match(texts, "key", keys).join(keys.hint("merge"), "key")  # a semi join would be pushed below the bitmaps


def verified(pairs: DataFrame, texts: DataFrame, idf, key_type: T.DataType, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of ``similarity`` or more.

    ``pairs``: a, b, key and fingerprint of either (key_a, print_a, ...); ``texts``: key, text.
    """
    left = texts.select(F.col("key").alias("key_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("key_b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "key_a").join(right, "key_b").select("a", "b", "print_a", "print_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.diff(buffers(batch.column(c))[1]) for c in (4, 5))
            for at, end in slices(np.concatenate([[0], np.cumsum(sizes)]), _SLICE):
                part = batch.slice(at, end - at)
                one, two = (Shingles(*buffers(part.column(c)), idf.value) for c in (4, 5))
                same = np.ones(len(part), bool)
                for side, c in ((one, 2), (two, 3)):  # rows of a repeated id: only the text that was signed
                    same &= fingerprints(side.words)[0].view(np.int64) == part.column(c).to_numpy(zero_copy_only=False)
                code = np.concatenate([mix(s.code + s.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (one, two)])
                weight, row = np.concatenate([one.weight, two.weight]), np.concatenate([one.row, two.row])
                order = np.argsort(code, kind="stable")
                twice = np.flatnonzero(code[order[1:]] == code[order[:-1]]) if len(order) else np.zeros(0, np.int64)
                common = np.minimum(weight[order[twice]], weight[order[twice + 1]])
                shared = np.bincount(row[order[twice]], common, len(part))
                union = per_row(one.weight, one.first) + per_row(two.weight, two.first) - shared
                keep = pa.array(same & (shared >= similarity * np.maximum(union, 1e-9)))
                yield part.select(["a", "b"]).filter(keep)

    return joined.mapInArrow(run, "a long, b long").distinct()


def _agreeing(pairs: DataFrame, nodes: DataFrame, hashes: int, similarity: float) -> DataFrame:
    """Pairs with keys and fingerprints whose signatures and weights leave ``similarity`` possible.

    The bar on equal samples lies five standard deviations below their expected number at ``similarity``.
    """
    sides = [nodes.select(F.col("rid").alias(s), *(F.col(c).alias(f"{n}_{s}") for c, n in (("key", "key"), ("print", "print"), ("weight", "weight"), ("signature", "sig")))) for s in ("a", "b")]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    close = joined.where(F.least("weight_a", "weight_b") >= (similarity - 1e-9) * F.greatest("weight_a", "weight_b"))
    bar = similarity * hashes - 5 * (similarity * (1 - similarity) * hashes) ** 0.5
    fields = ["a", "b", "key_a", "key_b", "print_a", "print_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, hashes) for c in ("sig_a", "sig_b"))
            yield batch.select(fields).filter(pa.array((left == right).sum(1) >= bar))

    schema = T.StructType([close.schema[f] for f in fields])
    return close.select(*fields, "sig_a", "sig_b").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(rid, root) of every node with an edge: the least node of its component, by rounds of neighbours' and roots' roots."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("rid").alias("b"), "root"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "rid").select("rid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = lower.select(F.col("rid").alias("root"), F.col("root").alias("next"))
        after = stored(lower.join(jump, "root", "left").select("rid", "old", F.coalesce("next", "root").alias("root")), "labels")
        if not after.where("root <> old").limit(1).count():
            return after.select("rid", "root")
        labels = after.select("rid", "root")


def _shingle_counts(texts: DataFrame, idf) -> np.ndarray:
    """Texts by bin of hashed shingles; the table has ``2 ** RARE_BITS`` numbers whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARE_BITS, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in slices(offsets, _SLICE):
                code = Shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf.value).code
                total += np.bincount((code >> np.uint64(64 - RARE_BITS)).astype(np.int64), minlength=1 << RARE_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bin", "n"])

    counts = texts.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession):
        counted = counts.toArrow()
    out = np.zeros(1 << RARE_BITS, np.int64)
    out[counted["bin"].to_numpy()] = counted["n"].to_numpy()
    return out


PREFIX = T.StructType([T.StructField(c, t) for c, t in (("rid", T.LongType()), ("root", T.LongType()), ("code", T.LongType()), ("weight", T.DoubleType()), ("rest", T.DoubleType()))])


def entries_of(docs: DataFrame, nodes: DataFrame, idf, key: str, text: str, similarity: float) -> DataFrame:
    """(code, rid, weight, rest, most, place, level): what ``meetings`` compares of the texts of ``nodes`` (rid, root, key, print).

    Each text lists its shingles in one order for all texts, rare ones first.  What two texts share cannot weigh more
    than either weighs from their first common shingle on, so that shingle lies in the prefix of both where
    ``similarity`` of the weight is still to come.  ``most`` is the most frequent component of a shingle.  ``place`` deals
    a shingle's texts out at random; about the first ``FIRST`` have level 0, and each level has ``FIRST`` times as many.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    texts = may_match(texts, "key", nodes.select("key")).join(nodes.hint("merge"), "key").select("rid", "root", "print", "text")
    texts = stored(texts, "held")
    counts = spark.sparkContext.broadcast(_shingle_counts(texts, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            rid, root, signed = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for a, b in slices(offsets, _SLICE):
                shingles = Shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf.value)
                same = fingerprints(shingles.words)[0].view(np.int64) == signed[a:b]  # rows of a repeated id: only the text that was signed
                order = np.lexsort((shingles.code, counts.value[(shingles.code >> np.uint64(64 - RARE_BITS)).astype(np.int64)], shingles.row))
                row, code, weight = shingles.row[order], shingles.code[order], shingles.weight[order]
                total = per_row(weight, shingles.first)
                sums = np.concatenate([[0.0], np.cumsum(weight)])
                rest = total[row] - (sums[:-1] - sums[shingles.first[row]])
                at = np.flatnonzero(same[row] & (rest >= (similarity - 1e-9) * total[row]))
                row = row[at]
                columns = [rid[a:b][row], root[a:b][row], code[at].view(np.int64), total[row], rest[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=PREFIX.names)

    prefix = stored(texts.mapInArrow(run, PREFIX), "prefixes")
    early = F.col("rest") >= (2 * similarity / (1 + similarity) - 1e-9) * F.col("weight")  # only there can a text meet a heavier one
    groups = prefix.groupBy("code", "root").agg(F.count("*").alias("n"), F.sum(early.cast("long")).alias("early"))
    shared = groups.groupBy("code").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.sum("early").alias("early"))
    shared = shared.select("code", F.col("top.root").alias("most"), "n", (F.col("n") - F.col("top.n")).alias("few"), "early").where("few > 0 AND early > 0")
    place = F.pmod(F.xxhash64("rid", "code"), F.lit(1 << 30))
    ahead = F.col("place") / (1 << 30) * F.col("n") / FIRST  # texts of the shingle before this one, in units of FIRST
    level = F.when(ahead < 1, 0).otherwise(F.floor(F.log(ahead) / F.log(F.lit(float(FIRST)))) + 1).cast("int")
    entries = prefix.join(shared.select("code", "most", "n"), "code").withColumn("place", place).withColumn("level", level)
    return stored(entries.select("code", "rid", "weight", "rest", "most", "place", "level"), "entries")


def meetings(entries: DataFrame, roots: DataFrame, level: int, similarity: float) -> DataFrame:
    """(a, b, bound): pairs of different components that share a shingle and can reach ``similarity``, ``b`` of ``level`` there.

    Texts outside the shingle's most frequent component meet the texts of the level that are in it or dealt out before
    them, in blocks of at most about ``BLOCK`` by ``BLOCK``.  So over all levels every pair meets that has not come into one
    component meanwhile: the first of two met the second, unless that was in the most frequent component, which then met
    the first.  A level is listed with the links of the levels before, so a group that is linked through a few of its
    texts is never listed pair by pair.
    """
    of = lambda name: roots.select(F.col("rid").alias(name), F.col("root").alias("__root"))
    now = entries.join(of("rid"), "rid", "left").withColumn("root", F.coalesce("__root", "rid")).drop("__root")
    now = now.join(of("most"), "most", "left").withColumn("most", F.coalesce("__root", "most")).drop("__root")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    open_ = now.groupBy("code").agg(F.sum((F.col("root") != F.col("most")).cast("long")).alias("few"), F.sum((F.col("level") == level).cast("long")).alias("n"))
    open_ = open_.where("few > 0 AND n > 0").select("code", parts("n").alias("wide"), parts("few").alias("high"))
    now = stored(now.join(open_, "code"), "open")
    spread = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fields = lambda s: [F.col("rid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("root", "weight", "rest", "place"))]
    left = now.where("root <> most").select("code", spread("high").alias("i"), every("wide").alias("j"), *fields("a"))
    right = now.where(F.col("level") == level).select("code", every("high").alias("i"), spread("wide").alias("j"), *fields("b"), "most")
    bound = F.least("rest_a", "rest_b") - (similarity / (1 + similarity)) * (F.col("weight_a") + F.col("weight_b"))
    met = left.join(right, ["code", "i", "j"]).where("root_a <> root_b AND (root_b = most OR place_a > place_b OR place_a = place_b AND a > b)").where(bound >= -1e-6)
    apart = F.col("root_b") == F.col("most")
    pair = [F.when(apart, F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(apart, F.col("b")).otherwise(F.greatest("a", "b")).alias("b")]
    return stored(met.select(*pair, bound.alias("bound")).groupBy("a", "b").agg(F.max("bound").alias("bound")), "candidates")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, class_id) per row: ``class_id`` is the least key of the class."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text))
    signed = stored(sign(docs, idf, key, text, bands, rows), "signed")
    alike = signed.where("print IS NOT NULL").groupBy("print", "check").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    alike = stored(alike, "alike")
    nodes = signed.join(alike.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", F.col(key).alias("key"), "print", "weight", "signature", "bands")
    members = stored(nodes.select("rid", F.explode("bands").alias("band")), "bands")
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(sizes, "band"), "buckets")
    central = members.groupBy("rid").agg(F.sum("size").alias("central"))
    members = stored(members.join(central, "rid").select("band", "size", "rid", "central"), "members")

    def linked(pairs: DataFrame) -> DataFrame:
        near = stored(_agreeing(pairs, nodes, bands * rows, similarity), "candidates")
        wanted = near.select(F.col("key_a").alias("key")).union(near.select("key_b")).distinct()
        return stored(verified(near, stored(texts_of(docs, wanted, key, text), "texts"), idf, docs.schema[key].dataType, similarity), "links")

    best = members.groupBy("band").agg(F.max(F.struct("central", (-F.col("rid")).alias("r"))).alias("m"))
    star = members.join(best.select("band", (-F.col("m.r")).alias("leader")), "band").where("rid <> leader")
    links = linked(star.select(F.least("leader", "rid").alias("a"), F.greatest("leader", "rid").alias("b")).distinct())
    roots = components(links)

    def unresolved(of: DataFrame) -> DataFrame:
        """Members of the buckets whose members are in different components."""
        placed = of.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
        return stored(placed.join(mixed, "band", "left_semi"), "rest")

    few = unresolved(members.where((F.col("size") > 2) & (F.col("size") <= SMALL)))
    other = few.select("band", F.col("rid").alias("b"), F.col("root").alias("other"))
    pairs = few.select("band", F.col("rid").alias("a"), "root").join(other, "band").where("a < b AND root <> other").select("a", "b").distinct()
    more = linked(pairs.join(links.select("a", "b"), ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = stored(links.union(more), "links")
        roots = components(links)

    rest = unresolved(members.where(F.col("size") > SMALL)).select("rid", "root").distinct()
    rest = stored(rest.join(nodes, "rid").select("rid", "root", "key", "print"), "apart")
    entries = entries_of(docs, rest, idf, key, text, similarity)
    ends = [rest.select(F.col("rid").alias(s), F.col("key").alias(f"key_{s}"), F.col("print").alias(f"print_{s}")) for s in ("a", "b")]
    levels = entries.agg(F.coalesce(F.max("level") + 1, F.lit(0))).first()[0]
    seen = None
    for level in range(levels):
        todo, take = meetings(entries, roots, level, similarity), FIRST
        if seen is not None:
            todo = todo.join(seen, ["a", "b"], "left_anti")
        while True:  # ends when every candidate is verified or inside one component
            for s in ("a", "b"):
                todo = todo.join(roots.select(F.col("rid").alias(s), F.col("root").alias(f"root_{s}")), s, "left").withColumn(f"root_{s}", F.coalesce(f"root_{s}", s))
            place = F.row_number().over(Window.partitionBy("a", "root_b").orderBy(F.desc("bound"), "b"))
            ranked = stored(todo.where("root_a <> root_b").withColumn("place", place).drop("root_a", "root_b"), "ranked")
            if not ranked.limit(1).count():
                break
            now = ranked.where(F.col("place") <= take).select("a", "b")
            seen = now if seen is None else seen.union(now)
            now = stored(now.join(ends[0], "a").join(ends[1], "b"), "candidates")
            wanted = now.select(F.col("key_a").alias("key")).union(now.select("key_b")).distinct()
            more = stored(verified(now, stored(texts_of(docs, wanted, key, text), "texts"), idf, docs.schema[key].dataType, similarity), "links")
            if more.limit(1).count():
                links = stored(links.union(more), "links")
                roots = components(links)
            todo, take = ranked.where(F.col("place") > take).select("a", "b", "bound"), take * FIRST**2
    row = signed.select("rid", F.col(key), "print", "check").join(alike.select("print", "check", "rep"), ["print", "check"], "left")
    row = row.join(roots.select(F.col("rid").alias("rep"), "root"), "rep", "left").select(key, F.coalesce("root", "rep", "rid").alias("class"))
    row = stored(row, "classes")
    least = row.groupBy("class").agg(F.min(key).alias("class_id"))
    return row.join(least, "class").select(key, "class_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the least key of each class, and of repeated rows one.

    Rows are told apart by key and text: different texts that share a key are judged one by one, and of two in one class
    that with the lesser hash stays.
    """
    own = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("print")))
    told = docs.withColumn("__row", own)
    classes = near_duplicates(told.select("__row", text), key="__row", text=text, **options)
    kept = classes.where(F.col("__row") == F.col("class_id")).select(F.col("__row").alias("__kept")).distinct()
    once = told.join(kept, F.col("__row") == F.col("__kept"), "left_semi").dropDuplicates(["__row"]).drop("__row")
    return once.unionByName(docs.where(F.col(key).isNull()))
