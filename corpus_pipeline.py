"""A corpus pipeline: quality, language, near-duplicates, benchmark contamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Between stages the documents are written to the folder that the cluster shares and read again, so that a lost
executor costs a stage at most; a stage's table is deleted when its successor's is written.

Defined results, stage by stage: without ratings, or with one grade only, the quality stage keeps all; a null or empty text is rated by the thresholds
alone. The language stage drops texts that are null or have no letter; where no document has a language nothing can be
learned, and it keeps every text with a letter. Near-dedup leaves one row of each group, and one of rows equal in id and words; rows without an id stay.
Rows that come twice, very long texts and further columns, whatever their names, are carried through; empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, neardup, quality
from tidemark.shared import fresh, remove

#: A document goes if its chance to be fit is smaller.
LEAST_FIT = 0.4
#: A document goes if no language has this share of the probability, or if it has no letter.
LEAST_SCORE = 0.4


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, fitted on rated ones, holds to be above the lowest grade."""
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, quality.train(docs, ratings), least=LEAST_FIT)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; all with a letter, if there are none."""
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()))
    found = langid.identify(renamed, model, text=own["text"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*(F.col(x).alias(c) for c, x in own.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The trained stages can't be put in SQL; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh(spark, f"stage{k + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            remove(spark, last)
        last = path
    return docs
