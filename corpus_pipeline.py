"""The corpus pipeline: documents, rated, line-deduped, near-deduped, mixed and encoded.

Each stage takes what the one before it wrote and returns a DataFrame; all but the last return the columns
of documents. Run run(spark, sf_dir), or the STAGES one by one with a Parquet file in between.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.llm import linededup, mixing, pieces, quality, simhash
from tamarack.llm.common import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rate(spark, docs, sf_dir):
    """Documents whose chance of the top grade is at least one half."""
    return quality.rated(spark, docs, sf_dir, rejected=False).select(*COLUMNS)


def dedup_lines(spark, docs, sf_dir):
    """Documents without repeated and near lines, n_chars counted anew; what has lost all its words goes."""
    out = linededup.dedup_lines(docs)
    has_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(has_word | (F.col("n_copies") + F.col("n_near") == 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark, docs, sf_dir):
    """One document of each group of near duplicates (5-word shingles, similarity 0.8): that with the least doc_id."""
    return simhash.one_of_each(docs, simhash.similar_duplicates).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, ids and round_trip of every row."""
    return pieces.encode_documents(docs)


STAGES = [("quality classifier", rate), ("line dedup", dedup_lines), ("simhash near-dedup", dedup_documents), ("mixing sources", mix), ("sentencepiece", encode)]

#: The classifier and the near-dedup have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows, from documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, "stage")
    return docs
