"""Artifacts, runtimes and advisories: every triple is judged, those that can't apply only by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.scalars import compare_versions, component, version_key
from assayer.operators import knowledge

# The published ranges.  (id, component, scheme, affected, fixed, needs a chat template, severity, confidence)
ADVISORIES = (
    ("CVE-2024-32878", "llama.cpp", "build", {"lte": "2715"}, {"gte": "2740"}, False, "high", "high"),
    ("CVE-2024-34359", "llama-cpp-python", "semver", {"gte": "0.2.30", "lte": "0.2.71"}, {"gte": "0.2.72"}, True, "critical", "high"),
    ("CVE-2026-27940", "llama.cpp", "build", {"lte": "8145"}, {"gte": "8146"}, False, "high", "high"),
    ("CVE-2026-33298", "llama.cpp", "build", {"lt": "7437"}, {"gte": "7824"}, False, "high", "high"),
    ("CVE-2026-5760", "sglang", "semver", {"lt": "0.5.10"}, {"gte": "0.5.10"}, True, "high", "medium"),
    ("CVE-2026-7482", "ollama", "semver", {"lt": "0.17.1"}, {"gte": "0.17.1"}, False, "critical", "high"),
    ("GGUF-2026-05-001", "llama.cpp", "build", {"lt": "8000"}, {"gte": "8100"}, False, "high", "medium"),
    ("GHSA-6hc7-9rph-cm99", "llama.cpp", "build", {"gte": "7492", "lte": "9060"}, {"gte": "9061"}, False, "critical", "medium"),
    ("GHSA-vgg9-87g3-85w8", "llama.cpp", "build", {"lt": "5700"}, {"gte": "5701"}, False, "high", "high"),
)
# End of fixed values.
_RANGE = "struct<gt:string,gte:string,lt:string,lte:string>"


def advisories(spark: SparkSession) -> DataFrame:
    rows = [(i, c, s, *({k: r.get(k) for k in ("gt", "gte", "lt", "lte")} for r in (a, f)), t, sev, conf) for i, c, s, a, f, t, sev, conf in ADVISORIES]
    return spark.createDataFrame(rows, f"advisory string, rule_component string, scheme string, affected {_RANGE}, fixed {_RANGE}, needs_template boolean, rule_severity string, rule_confidence string")


def in_range(build: Column, version: Column, scheme: Column, bounds: str) -> Column:
    """Whether a build number or a dotted version keeps to all bounds that are set."""
    out = F.lit(True)
    for name, op in (("gt", "__gt__"), ("gte", "__ge__"), ("lt", "__lt__"), ("lte", "__le__")):
        b = F.col(f"{bounds}.{name}")
        number = getattr(build, op)(b.cast("bigint"))
        dotted = getattr(compare_versions(version_key(version), version_key(b)), op)(F.lit(0))
        out = out & F.when(b.isNull(), True).when(scheme == "build", number).otherwise(dotted)
    return out


def judgements(facts: DataFrame, runtimes: DataFrame, rules: DataFrame, every: bool = False, holds: Column | None = None) -> DataFrame:
    """facts: has_template and other columns, a few rows (the classes of artifacts).  runtimes: runtime_id, component,
    build, version, confidence.  Rules, tens of rows, meet runtimes by component; a row for each runtime, rule of its
    component and class.  With ``every``, rules of other components have their rows too, not applicable.  ``holds``:
    whether a rule is for a class, if not by its need of a template."""
    named, own = runtimes.withColumn("own", component(F.col("component"))), F.col("own") == F.col("rule_component")
    own = named.crossJoin(F.broadcast(rules)) if every else named.join(F.broadcast(rules), own)
    pairs = own.crossJoin(F.broadcast(facts))
    known = F.when(F.col("scheme") == "build", F.col("build").isNotNull()).otherwise(F.col("version").isNotNull())
    here = lambda bounds: in_range(F.col("build"), F.col("version"), F.col("scheme"), bounds)
    applies = (~F.col("needs_template") | F.col("has_template") if holds is None else holds) & (F.col("own") == F.col("rule_component"))
    status = F.when(~applies, "not_applicable").when(~known, "unchecked").when(here("affected"), "suspicious").when(here("fixed"), "verified").otherwise("unchecked")
    rank = lambda c: F.when(c == "low", 0).when(c == "medium", 1).otherwise(2)
    least = F.when(rank(F.col("rule_confidence")) <= rank(F.col("confidence")), F.col("rule_confidence")).otherwise(F.col("confidence"))
    return pairs.withColumn("status", status).select(
        *facts.columns, "runtime_id", "advisory", "status",
        F.when(F.col("status") == "suspicious", F.col("rule_severity")).otherwise("info").alias("severity"),
        F.when(F.col("status") == "suspicious", least).when(F.col("status") == "unchecked", "low").otherwise("high").alias("confidence"),
        (F.col("status") == "suspicious").alias("mandatory"),
    )


def findings(artifacts: DataFrame, runtimes: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each artifact (artifact_id, has_template), runtime and advisory: for reports of a run.  ``counts`` is for
    fleets."""
    facts = artifacts.select("has_template").distinct()
    return artifacts.select("artifact_id", "has_template").join(judgements(facts, runtimes, rules, every=True), "has_template").drop("has_template")


def counts(artifacts: DataFrame, runtimes: DataFrame, rules: DataFrame) -> DataFrame:
    """(advisory, status, severity, confidence, findings): how many triples came out how, without making them.  Triples of
    another component are not applicable."""
    facts = artifacts.groupBy("has_template").agg(F.count("*").alias("artifacts"))
    judged = judgements(facts, runtimes, rules).groupBy("advisory", "status", "severity", "confidence").agg(F.sum("artifacts").alias("findings"))
    total = facts.agg(F.sum("artifacts").alias("a")).crossJoin(runtimes.agg(F.count("*").alias("r")))  # a row
    rest = judged.groupBy("advisory").agg(F.sum("findings").alias("n"))
    rest = rules.select("advisory").join(rest, "advisory", "left").crossJoin(total).select("advisory", F.lit("not_applicable").alias("status"), F.lit("info").alias("severity"), F.lit("high").alias("confidence"), (F.col("a") * F.col("r") - F.coalesce("n", F.lit(0))).alias("findings"))
    every = judged.unionByName(rest).groupBy("advisory", "status", "severity", "confidence").agg(F.sum("findings").alias("findings"))
    return every.where("findings > 0")


def from_bundle(rules: DataFrame) -> DataFrame:
    """Rules of a loaded bundle in the form of ``advisories``, with their predicates in place of the need of a template."""
    bounds = lambda side: F.struct(*(F.try_element_at(F.col(side), F.lit(k)).alias(k) for k in ("gt", "gte", "lt", "lte"))).alias(side)
    return rules.select(F.col("id").alias("advisory"), component(F.col("component")).alias("rule_component"), F.when(F.col("version_scheme") == "semver", "semver").otherwise("build").alias("scheme"), bounds("affected"), bounds("fixed"), "predicates", F.col("severity").alias("rule_severity"), F.col("confidence").alias("rule_confidence"))


def met(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """``artifacts`` (architecture, name, has_chat_template, file_type and metadata, a JSON object) with ``met``: the ids,
    in order, of the rules whose predicates all hold.  All rules are one row, as large as a bundle may be at most."""
    text = lambda c: F.when(F.col(c).isNotNull(), F.regexp_extract(F.to_json(F.array(F.col(c).cast("string"))), r"(?s)^\[(.*)\]$", 1))
    facts = {"format": F.lit('"gguf"'), "architecture": text("architecture"), "name": text("name"), "has_chat_template": F.col("has_chat_template").cast("string"), "file_type": F.col("file_type").cast("string")}
    values = F.transform_values(F.from_json("metadata", "map<string,variant>"), lambda _, v: F.to_json(v))
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("advisory", "predicates"))).alias("_rules"))
    held = F.filter("_rules", lambda r: knowledge.predicates_hold(r["predicates"], facts, F.col("_values")))
    return artifacts.crossJoin(F.broadcast(listed)).withColumn("_values", values).withColumn("met", held["advisory"]).drop("_rules", "_values")


def findings_by_predicates(artifacts: DataFrame, runtimes: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``findings``, for rules ``from_bundle``; artifacts: artifact_id and what ``met`` reads."""
    classed = met(artifacts, rules).select("artifact_id", "met")
    judged = judgements(classed.select("met").distinct(), runtimes, rules, every=True, holds=F.array_contains("met", F.col("advisory")))
    return classed.join(judged, "met").drop("met")
