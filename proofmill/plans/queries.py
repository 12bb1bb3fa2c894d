"""Queries of the rule engine, and SQL that states them independently."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.plans import document_queries, relations
from proofmill.plans.corpus import CORPUS, corpus
from proofmill.plans.registry import all_rules, findings, sql_findings

QUERIES: dict = {**relations.QUERIES, **document_queries.QUERIES}
ORACLES: dict[str, str] = {**relations.ORACLES, **document_queries.ORACLES}


def _family(spark: SparkSession, d: str, family: str) -> DataFrame:
    return findings(corpus(spark, d), [r for r in all_rules() if r.family == family])


for _f in sorted({r.family for r in all_rules()}):
    QUERIES[f"lint_{_f.lower()}"] = partial(_family, family=_f)
    ORACLES[f"lint_{_f.lower()}"] = sql_findings([r for r in all_rules() if r.family == _f], CORPUS)


def findings_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return findings(corpus(spark, d)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_findings"))


QUERIES["findings_by_rule"] = findings_by_rule
ORACLES["findings_by_rule"] = f"SELECT rule_id, severity, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_findings FROM ({sql_findings(None, CORPUS)}) GROUP BY rule_id, severity"
