"""The corpus that the engine's queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.sources.tables import table

#: As ``corpus``, for SQL: labelled documents join the documents under negative ids.
CORPUS = "(SELECT doc_id, text, lang, source, path FROM documents UNION ALL SELECT -labeled_id, text, lang, NULL, file FROM labeled_documents) AS corpus"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents and labelled documents as one table: (doc_id, text, lang, source, path)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "path")
    return docs.union(table(spark, d, "labeled_documents").select(-F.col("labeled_id"), "text", "lang", F.lit(None).cast("string"), F.col("file")))
