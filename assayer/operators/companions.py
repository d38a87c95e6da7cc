"""Evidence of companion files as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(evidence: DataFrame, folders: DataFrame, by: str = "folder") -> DataFrame:
    """evidence: folder, seq, kind, severity, relevance.  A folder without evidence gets one clean row.  The order of the
    cases matters: a mismatch is suspicious whatever its relevance, then what is not used does not apply, a match is
    verified, high severity is suspicious, and the rest is unchecked."""
    kind, relevance = F.col("kind"), F.col("relevance")
    status = F.when(kind.endswith("_mismatch"), "suspicious").when(relevance == "not_used", "not_applicable").when(kind.endswith("_match"), "verified").when(F.col("severity") == "high", "suspicious").otherwise("unchecked")
    severity = F.when(status.isin("not_applicable", "verified"), "info").otherwise(F.col("severity"))
    rows = evidence.select(by, F.concat(F.lit("config."), kind, F.lit("."), F.col("seq").cast("string")).alias("id"), status.alias("status"), severity.alias("severity"), (status == "suspicious").alias("mandatory"))
    none = folders.join(evidence.select(by).distinct(), by, "left_anti").select(by, F.lit("config.no_signals").alias("id"), F.lit("clean").alias("status"), F.lit("info").alias("severity"), F.lit(False).alias("mandatory"))
    return rows.unionByName(none)

