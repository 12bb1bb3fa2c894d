"""Writers of findings, reports and records; each writes a folder and replaces what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_findings_tsv(findings: DataFrame, path: str) -> None:
    """Lines of rule, severity, count and message, tab separated; tabs and line ends inside a field become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ").alias(c) for c in ("rule_id", "severity", "n", "message")]
    findings.select(*clean).write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_candidates(edits: DataFrame, path: str) -> None:
    """Of proposed edits (doc_id, no, rule_id, start, end, replacement) a CANDIDATE line a rule of a document, with an EDIT line each below it."""
    one = F.concat_ws("\t", F.lit("EDIT"), "start", "end", F.to_json(F.struct("replacement")))
    per = edits.groupBy("doc_id", "rule_id").agg(F.array_sort(F.collect_list(F.struct("no", one.alias("l")))).alias("es"))
    per.select(F.concat_ws("\n", F.concat_ws("\t", F.lit("CANDIDATE"), "doc_id", "rule_id"), F.array_join(F.transform("es", lambda e: e.l), "\n"))).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines, or with ``kind`` tsv tab separated with a header."""
    if kind == "json":
        report.write.mode("overwrite").json(path)
        return
    clean = [F.regexp_replace(c, r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in report.dtypes]
    report.select(*clean).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_records(records: DataFrame, path: str) -> None:
    """Training records as JSON lines."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)
