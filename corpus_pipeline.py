"""A training corpus from raw documents: toxicity, near duplicates, repeats, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
a DataFrame that is written as Parquet and read again as the next stage's docs. All stages read
whole texts, take null and empty ones, rows without a doc_id, repeated rows and empty tables, and
leave further columns as they are, whatever their names; what becomes of each is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import packing, simhash, substrings, surrogates, toxicity
from lodestone.llm.common import discarded, scratch, ship, table

#: Near duplicates have 4/5 or more of their five-word shingles in common (exact Jaccard).
NEAR = {"words": 5}
WINDOW_WORDS = 35


def _as_documents(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows with the columns of ``docs`` from a struct ``row`` and a new text; n_chars follows it."""
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col(text).alias("text"))
        elif name == "n_chars":
            columns.append(F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return df.select(*columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic; the labels of held-out rows are not learned from. Null
    and empty texts score as texts in which nothing fires, and every row is judged by itself."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.reject(docs, toxicity.train(docs.where(~held_out), labels.where(~held_out)))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: texts that share 4/5 or more of their
    five-word shingles, directly or through others. Of null and empty texts one stays, of a
    repeated row one; rows without a doc_id stay."""
    ship(spark)
    return simhash.keep_one(docs, **NEAR)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that repeat anywhere in the corpus. Rows stay, if need be with an
    empty text; a null text stays null."""
    ship(spark)
    return _as_documents(substrings.remove_repeats(docs, WINDOW_WORDS), docs, "kept_text")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates under the session's key. Rows stay; a null text stays null."""
    key = spark.conf.get("spark.lodestone.surrogates.key", surrogates.KEY)
    return _as_documents(surrogates.pseudonymise(docs, key), docs, "new_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens; a null or empty text is its end token alone."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substrings", substrings_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express a learned classifier, SimHash or byte-pair encoding; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage returns is written to the shared folder and
    goes once the next one is written, the last one's stays as the result."""
    docs, base, before = table(spark, sf_dir, "documents"), scratch(spark, "corpus"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            discarded(spark, before)
        before = f"{base}/{name}"
    return docs
