"""A training-data pipeline over ``documents``: each stage works on all that the stage before it kept.

Quality rules drop what they reject, one document of each near-duplicate
group stays, personal data is masked, sources are repeated to their target
weights, and the texts become SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moltables.llm import mixing, ngram_join, pii, quality, spm
from moltables.session import shared_folder, stable


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the cascade, with the columns they came with."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every near-duplicate component."""
    return ngram_join.one_of_each(docs, stable(ngram_join.near_duplicate_components(docs)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind; n_chars follows. A null text stays null."""
    model = pii.trained(stable(pii.labelled_table(docs)))
    return pii.masked_documents(docs, model)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, rows of smaller sources repeated up to their budgets."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row with its ids, and whether they are the other library's and decode to the text."""
    return spm.encoded(docs, spm.model_path()).drop("decoded")


STAGES = [
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: The field of the third stage and the pieces of the last have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
