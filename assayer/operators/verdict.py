"""Verdicts and coverage from findings, each one aggregate per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("verified", "clean", "suspicious", "unchecked", "not_applicable", "error")
CORE = ("gguf_structure", "chat_template_static")
RUNTIME_CHECK = "runtime_advisory_join"


def verdicts(findings: DataFrame, by: list[str], runtime_in_scope=None, runs: DataFrame | None = None) -> DataFrame:
    """by columns, verdict, exit_code.  findings: status, severity, classification (or null and confidence), check,
    mandatory.  ``runs``: keys that get a verdict even without findings.  Map-side partial aggregates, one shuffle."""
    cls = F.coalesce("classification", "confidence") if "confidence" in findings.columns else F.col("classification")
    scope = F.lit(True) if runtime_in_scope is None else runtime_in_scope
    bad = F.col("status") == "suspicious"
    sev = F.col("severity")
    block = bad & (((sev == "critical") & cls.isin("high", "medium")) | ((sev == "high") & (cls == "high")))
    doubt = bad & ~block & (((sev == "critical") & (cls == "low")) | ((sev == "high") & (cls == "medium")) | (sev.isin("medium", "low") & (cls == "high")))
    gap = F.col("mandatory") & F.col("status").isin("unchecked", "error") & ~F.col("check").isin(*CORE, RUNTIME_CHECK)
    good = F.col("status").isin("verified", "clean", "not_applicable")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = findings.groupBy(*by).agg(some(block).alias("block"), some(doubt).alias("doubt"), some(gap).alias("gap"), *(some(good & (F.col("check") == c)).alias(n) for c, n in ((CORE[0], "structure"), (CORE[1], "template"), (RUNTIME_CHECK, "runtime"))), F.bool_or(scope).alias("scope"))
    if runs is not None:
        flags = runs.join(flags, by, "left").fillna(False)
    verdict = (
        F.when(F.col("block"), "not_suitable")
        .when(F.col("doubt") | F.col("gap") | ~F.col("structure") | ~F.col("template"), "undetermined")
        .when(~F.col("scope") | ~F.col("runtime"), "clean")
        .otherwise("suitable")
    )
    code = F.when(F.col("block"), 1).when(verdict == "undetermined", 2).otherwise(0)
    return flags.select(*by, verdict.alias("verdict"), code.alias("exit_code"))


def coverage(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts per status, zeros included, and the total."""
    return findings.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count("*").alias("total"))


def recommendations(findings: DataFrame, by: list[str]) -> DataFrame:
    """Advice that findings call for: (category, priority, title), the constant ones included."""
    has = lambda word, status=None: F.bool_or(F.col("id").contains(word) & (F.lit(True) if status is None else F.col("status") == status))
    rules = [
        ("runtime", "critical", "Update the runtime", has("CVE", "suspicious")),
        ("runtime", "medium", "Find out the runtime's version", has("runtime", "unchecked")),
        ("network", "high", "Keep keys out of arguments", has("api_key")),
        ("template", "critical", "Don't load the chat template", has("template", "suspicious")),
        ("template", "medium", "Limit prompt extraction", has("extraction")),
        ("companion", "critical", "Drop pickled files", has("pickle", "suspicious")),
        ("companion", "critical", "Rotate exposed credentials", has("credential") | has("api_key")),
        ("companion", "high", "Turn remote code off", has("trust_remote")),
        ("supply_chain", "high", "Check where the model comes from", has("supply_chain", "suspicious")),
        ("supply_chain", "medium", "Review an altered model", has("uncensored")),
        ("general", "low", "Verify digests", F.count("*") >= 0),
        ("general", "low", "Run with least rights", F.count("*") >= 0),
        ("general", "medium", "Keep models isolated", F.count("*") >= 0),
    ]
    made = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(a).alias("category"), F.lit(p).alias("priority"), F.lit(t).alias("title"))) for a, p, t, c in rules)))
    return findings.groupBy(*by).agg(made.alias("rows")).select(*by, F.explode("rows").alias("r")).select(*by, "r.*")
