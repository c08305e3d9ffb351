"""Training-corpus pipeline over the documents table: language ID, line dedup, near dedup, secret scans, packing.

Each stage takes all that the one before kept, as Parquet, and its decisions take effect: documents of no known language go, repeated chunks of lines go, one
document of each class of near copies stays, credentials that look live are redacted, and what is left is packed. All stages but the last return
the columns of documents, with n_chars as of the text that is returned.

Empty tables pass through all stages; null texts are documents of no language and go in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, linedup, packing, secrets, simhash
from graphloom.llm.common import materialize, release, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.predict(docs, model).where("NOT rejected").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linedup.dedup_lines(docs).select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs, F.col("source"), F.concat_ws("/", "source", "lang"), secrets.EXAMPLE_OWNERS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packed)]
#: SQL can express neither the model nor the signatures; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
