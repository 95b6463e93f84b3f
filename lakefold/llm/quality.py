"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio against trusted text.

Words (unigrams) and neighbouring words (bigrams) are hashed into ``buckets`` bins.  Two multinomials over
the bins are counted: one over trusted target documents, one over the whole raw corpus.  The score of a document
is the mean over its n-grams of the log ratio of their smoothed probabilities, so it does not depend on length;
a document is kept if its score reaches a threshold.  Everything runs as DataFrame expressions.

All labelled rows count (``fit_rows`` takes fewer, those with the lowest hashes of their ids); raw counts cover all
documents.  The weights are one array of ``buckets`` numbers, read by a scalar subquery.  The target is counted over
one half of the labelled rows; the threshold lies between the scores of trusted and rejected rows of the other half,
where the sum of both error rates is least, so it holds for texts that the target has not seen.  Bitmaps of
fixed size leave out texts without a label, the others meet their labels in one join and are stored; bins are summed
on the map side first.

Defined results: a null or empty text has no words and fails the base rules; without labelled rows of both kinds
the threshold is minus infinity and only the base rules decide; repeated ids each keep a row; all columns of the
documents pass through, those with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions.arrays import let

from .common import may_match, stored

BUCKETS = 1 << 16
PRIOR = 1.0

_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def _without(text: Column, characters: str) -> Column:
    for c in characters:  # byte searches; translate looks at every character
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{_BLANKS}]+"), "")


def _covered(windows: Column, width: int) -> Column:
    """Positions covered by windows (hashes by start) that occur twice or more."""

    def marked(ordered: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(ordered, k)["h"] == p["h"], F.lit(False))
        starts = F.sort_array(F.array_compact(F.transform(ordered, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total")),
            lambda a, p: F.struct((p + width).alias("end"), (a["total"] + p + width - F.greatest(a["end"], p)).alias("total")),
            lambda a: a["total"],
        )

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), marked))


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__text`` and the hashes ``__words`` of its words."""
    clean = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return clean.withColumn("__words", F.transform(_words(F.col("__text")), lambda w: F.xxhash64(w)))


def base_rules(docs: DataFrame) -> DataFrame:
    """The counting rules, for rows of :func:`with_words`."""
    words, text = F.col("__words"), F.col("__text")
    triples = F.transform(words, lambda h, i: F.xxhash64(h, F.get(words, i + 1), F.get(words, i + 2)))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(_BLANKS)) != "")
    return (
        docs.withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(_without(text, _BLANKS)).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .withColumn("__triples", F.slice(triples, 1, F.greatest(F.size(words) - 2, F.lit(0))))
        .withColumn("n_repeat_words", _covered(F.col("__triples"), 3))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("__triples")
    )


def _ngrams(words: Column, buckets: int) -> Column:
    """Bins of the words and of the pairs of neighbours (the last word pairs with nothing)."""
    pairs = F.transform(words, lambda h, i: F.pmod(F.xxhash64(h, F.get(words, i + 1), F.lit(2)), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(words, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def trusted_sample(labels: DataFrame, fit_rows: int | None = None, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(``__id``, ``__trusted``, ``__half``) of all labelled rows, or of at most ``fit_rows``."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("__trusted"))
    if fit_rows is not None:
        rows = rows.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    return rows.withColumn("__half", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)))


def ngram_weights(words: DataFrame, target: DataFrame, buckets: int, prior: float) -> Column:
    """Log probability ratio of each bin, as a scalar subquery over the ``__words`` of all rows and of the target's."""

    def bins_of(rows: DataFrame, raw: int) -> DataFrame:
        return rows.select(F.explode(_ngrams(F.col("__words"), buckets)).alias("bin"), F.lit(raw).alias("r"), F.lit(1 - raw).alias("t"))

    bins = bins_of(words, 1).unionAll(bins_of(target, 0))
    counts = bins.groupBy("bin").agg(F.sum("r").alias("raw"), F.sum("t").alias("target"))
    every = words.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    packed = every.agg(F.sort_array(F.collect_list(F.struct("bin", "raw", "target"))).alias("c"), F.sum("raw").alias("n"), F.sum("target").alias("m"))
    # the target's prior is the raw distribution, so a bin without evidence weighs nothing
    share = lambda x: (x["raw"] + 1) / (F.col("n") + buckets)
    weight = F.transform("c", lambda x: F.log((x["target"] + prior * buckets * share(x)) / (F.col("m") + prior * buckets)) - F.log(share(x)))
    return stored(packed.select(weight.alias("weights")), "quality-weights").scalar()


def score_documents(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, prior: float = PRIOR, fit_rows: int | None = None, threshold: float | None = None) -> DataFrame:
    """``docs`` with the base counts, ``score`` and ``kept``."""
    docs = docs.select(*(c for c in docs.columns if c not in RESULTS))
    sample = trusted_sample(labels, fit_rows, key).where("__half = 1 OR __trusted = 1" if threshold is None else "__half = 0 AND __trusted = 1")
    near = may_match(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", sample.select("__id"))
    known = near.join(sample.hint("merge"), near["__key"] == sample["__id"]).select("__text", "__trusted", "__half")
    known = with_words(stored(known, "quality-labelled"), "__text")
    words = with_words(docs, text)
    weights = ngram_weights(words, known.where("__half = 0 AND __trusted = 1"), buckets, prior)
    grams = _ngrams(F.col("__words"), buckets)
    score = F.when(
        F.size("__words") > 0,
        F.aggregate(F.col("__grams"), F.lit(0.0), lambda a, b: a + F.get(F.col("__weights"), b)) / F.size("__grams"),
    ).otherwise(F.lit(float("-inf")))

    def scored(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__grams", grams).withColumn("__weights", weights).withColumn("score", score).drop("__grams", "__weights")

    if threshold is None:
        threshold = _threshold(scored(known.where("__half = 1")))
    out = scored(base_rules(words)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # a later filter on `kept` must not be pushed below and there evaluate the whole expression in its lambdas: a column
    # that is not deterministic holds it here
    return out.withColumn("__hold", F.monotonically_increasing_id()).where("__hold >= 0").drop("__text", "__words", "__hold")


def _threshold(rows: DataFrame) -> float:
    """Where the two error rates of the labelled rows have the least sum; scores are ordered within bins, bins by their sums."""
    good = F.col("__trusted") == 1
    each = rows.where(F.size("__words") > 0).groupBy("score").agg(F.count_if(good).alias("g"), F.count_if(~good).alias("b"))
    each = stored(each.withColumn("bin", F.floor(F.col("score") * 1000)), "quality-scores")
    n_good, n_bad = each.agg(F.sum("g"), F.sum("b")).first()
    if not n_good or not n_bad:
        return float("-inf")
    bins = Window.orderBy("bin")  # as many rows as bins, whatever the number of texts
    before = each.groupBy("bin").agg(F.sum("g").alias("g_bin"), F.sum("b").alias("b_bin"), F.max("score").alias("top")).select(
        "bin", (F.sum("g_bin").over(bins) - F.col("g_bin")).alias("g_before"), (F.sum("b_bin").over(bins) - F.col("b_bin")).alias("b_before"), F.lag("top").over(bins).alias("top"))
    inside = Window.partitionBy("bin").orderBy("score")
    # rejecting everything below a score
    g, b = (F.sum(c).over(inside) - F.col(c) + F.col(f"{c}_before") for c in ("g", "b"))
    errors = g / F.lit(n_good) + 1 - b / F.lit(n_bad)
    best = each.join(before, "bin").select(F.struct(errors.alias("errors"), "score", F.coalesce(F.lag("score").over(inside), "top").alias("below")).alias("e")).agg(F.min("e")).first()[0]
    return best["score"] if best["below"] is None else (best["score"] + best["below"]) / 2


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    names = docs.columns
    packed = docs.select(F.struct("*").alias("__row"), F.col(options.get("text", "text")).alias("text"), F.col(options.get("key", "doc_id")).alias("doc_id"))
    kept = score_documents(packed, labels, **{k: v for k, v in options.items() if k not in ("text", "key")}).where("kept")
    return kept.select(*(F.col("__row")[c].alias(c) for c in names))
