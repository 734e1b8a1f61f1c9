"""A pipeline over `documents`: toxic documents go, one of each group of near copies stays, contaminated
documents go, secrets are masked, and what is left is mixed to target weights.

Every stage reads what the stage before it wrote. The last returns the mix instead of documents. Stages use the
columns doc_id, text, source and n_chars; other columns, whatever their names, stay as they are until the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontamination, near_duplicates, queries, secrets, toxicity
from quillspan.llm.shared import Scratch, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those scored toxic. Null and empty texts, which score like ordinary ones, stay; repeated rows go or stay alike; no rows give no rows."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), queries.remainder(4) != 2)
    return toxicity.clean_docs(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each class of near copies. Texts without words are no copies of one another, but of repeated rows one stays."""
    ship(spark)
    return near_duplicates.first_docs(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without contaminated rows, each judged on its own. Null and empty texts stay."""
    return decontamination.clean_docs(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked and n_chars counted anew. Null texts stay null, with n_chars null."""
    ship(spark)
    masked = secrets.mask_docs(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document with its draws. Null and empty texts have size 0 and are taken without words; a null source is a source."""
    return queries.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Two stages fit or search in ways that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
