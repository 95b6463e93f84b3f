"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage works on all that its predecessor kept and calls one operator of ``lakefold.llm`` over the whole table.
All stages but the last return the columns of documents, the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import decontaminate, minhash, packing, quality, toxicity
from lakefold.llm.common import stored
from lakefold.llm.registered import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the likelihood ratio's threshold; a null text fails."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def toxicity_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity cut; a null text scores 0 and stays."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    return toxicity.filter_toxic(docs, lexicon)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id; null ids and empty texts stay."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test passages are cut out; a document goes only if nothing else is in it.  ``n_chars`` follows the text."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences that training reads."""
    return packing.pack_texts(docs, tokenizer_path("byte_bpe_50k.json"), end=0, capacity=1024, memo_units=400_000, keep_memo=False)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The stages are learned or hashed and can't be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k + 1}")
    return docs
