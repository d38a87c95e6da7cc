"""One call that checks targets: scan, detectors, companions, runtime, advisories, digests, verdict, report."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import companion, rules
from assayer.functions.scalars import error_origin, slug
from assayer.operators import advisories, companion_scan, companions, digests, reports, runtimes, template_findings, verdict
from assayer.sources import discovery, gguf, knowledge, scanners
from assayer.streaming import arrivals  # noqa: F401  part of the engine

FINDING = ["path", "id", "check", "status", "severity", "classification", "mandatory", "summary"]
HOOKS = ("targets", "scan", "templates", "companions", "runtime", "advisories", "verdict")


def label(path: str) -> str:
    """A word for a target."""
    kind = discovery.classify(path)
    return {"directory": "directory", "gguf": "gguf", "runtime": "runtime"}.get(kind.kind, "missing" if kind.detection_method == "missing" else "file")


def shaped(df: DataFrame, **given) -> DataFrame:
    """The columns of a finding; those that are absent are given or null."""
    kinds = {"mandatory": "boolean"}
    return df.select(*(F.col(c) if c in df.columns else given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FINDING))


def facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Headers of models: one row a file, errors as rows; one scan for all."""
    gguf.register(spark)
    return spark.read.format("gguf").load(paths)


def structure_findings(headers: DataFrame) -> DataFrame:
    bad = F.col("error_class").isNotNull()
    parsed = headers.select("path", F.when(bad, "gguf.inspection_error").otherwise("gguf.parsed").alias("id"), F.lit("gguf_structure").alias("check"), F.when(bad, "error").otherwise("clean").alias("status"), F.lit("info").alias("severity"), bad.alias("mandatory"), F.when(bad, F.concat_ws(": ", error_origin(F.col("error_message")), "error_message")).otherwise("header is well-formed").alias("summary"))
    omitted = headers.where(F.size("omitted_metadata_keys") > 0).select("path", F.lit("gguf.metadata_omitted").alias("id"), F.lit("gguf_structure").alias("check"), F.lit("unchecked").alias("status"), F.lit("low").alias("severity"), F.lit(False).alias("mandatory"), F.array_join("omitted_metadata_keys", ", ").alias("summary"))
    return shaped(parsed).unionByName(shaped(omitted))


def metadata_findings(headers: DataFrame) -> DataFrame:
    """Texts in metadata that address or run something, the file's name, and the repository it names."""
    values = headers.where(F.col("metadata").isNotNull()).select("path", F.explode(F.from_json("metadata", "map<string,string>")).alias("key", "value"))
    hit = values.where(F.col("key") != "tokenizer.chat_template").select("path", "key", F.explode(rules.metadata_hit(F.col("key"), F.col("value"))).alias("h"))
    unsafe = hit.select("path", F.concat(F.lit("gguf.metadata_pattern."), slug(F.col("key"))).alias("id"), F.lit("gguf_metadata_safety").alias("check"), F.lit("unchecked").alias("status"), F.lit("low").alias("severity"), F.lit(False).alias("mandatory"), F.col("h.rule").alias("summary"))
    names = headers.select("path", F.explode(rules.hits(companion.base_name(F.col("path")), rules.SUPPLY_CHAIN)).alias("h")).select("path", F.col("h.rule").alias("k"), F.lit(None).cast("string").alias("summary"))
    hosts = headers.where(F.col("metadata").isNotNull()).select("path", F.explode(companion.blocked_host(F.from_json("metadata", "map<string,string>"))).alias("summary")).select("path", F.lit("suspicious_repo").alias("k"), "summary")
    supply = names.unionByName(hosts).select("path", F.concat(F.lit("supply_chain."), "k").alias("id"), F.lit("supply_chain_verification").alias("check"), F.lit("suspicious").alias("status"), F.lit("high").alias("severity"), F.lit("high").alias("classification"), F.lit(True).alias("mandatory"), "summary")
    return shaped(unsafe).unionByName(shaped(supply))


def flag_findings(found: DataFrame) -> DataFrame:
    """What a runtime's flags open; runtimes without flags have no rows."""
    hit = found.where(F.size("flags") > 0).select(F.col("runtime").alias("path"), F.explode(rules.hits(F.array_join("flags", " "), rules.RUNTIME_FLAGS)).alias("h"))
    return shaped(hit.select("path", F.concat(F.lit("runtime_config."), "h.rule").alias("id"), F.lit("runtime_config_security").alias("check"), F.lit("suspicious").alias("status"), F.lit("high").alias("severity"), F.lit("high").alias("classification"), F.lit(True).alias("mandatory")))


def check(spark: SparkSession, targets: list[str], runtime: str | None = None, runtime_version: str | None = None, expected_sha256: str | None = None, full_hash: bool = False, bundle: knowledge.Bundle | None = None, tools: list[str] | None = None, observe=None) -> dict:
    """A report on targets: verdict, exit_code, findings, artifacts, runtimes, recommendations, observations.  The expected
    digest is the first artifact's.  ``bundle``: advisories other than the built-in ones."""
    if expected_sha256 is not None and len(targets) != 1:
        raise ValueError("an expected digest needs exactly one target")
    if runtime_version is not None and runtime is None:
        raise ValueError("a runtime's version needs a runtime")
    began, timing = time.monotonic(), {}

    def done(stage: str) -> None:
        timing[stage] = time.monotonic() - began
        if observe:
            observe(stage, timing[stage])

    one = lambda ident, chk, status, mandatory=True, summary=None, path=None: spark.createDataFrame([(path, ident, chk, status, "info", "high", mandatory, summary)], "path string, id string, check string, status string, severity string, classification string, mandatory boolean, summary string")
    walked = discovery.targets(spark, targets)
    found, more = walked.targets, walked.limit_reached
    models, programs = [t.path for t in found if t.kind == "gguf"], [t.path for t in found if t.kind == "runtime"]
    parts = []
    if more:
        parts.append(one("discovery.limit_reached", "target_discovery", "unchecked"))
    if not models:
        parts.append(one("no_targets", "target_discovery", "error"))
    done("targets")
    artifacts: list[dict] = []
    if models:
        headers = facts(spark, models).cache()
        artifacts = [r.asDict() for r in headers.select("path", "name", "architecture", "gguf_version", "tensor_count", "metadata_count", "file_size", F.col("chat_template").isNotNull().alias("has_chat_template"), "omitted_metadata_keys").collect()]
        parts += [structure_findings(headers), metadata_findings(headers)]
        done("scan")
        parts.append(shaped(template_findings.template_findings(headers.where("error_class is null").select("path", "chat_template"), "path", "chat_template")))
        done("templates")
        if full_hash or expected_sha256 is not None:
            expected = F.when(F.col("path") == models[0], F.lit(expected_sha256)).otherwise(F.lit(None).cast("string"))
            hashed = digests.file_digests(spark.createDataFrame([(m,) for m in models], "path string")).withColumn("expected", expected)
            parts.append(shaped(digests.digest_findings(hashed, ["path"]), check=F.lit("sha256"), summary=F.lit(None)))
        folders = list(dict.fromkeys(os.path.dirname(os.path.abspath(m)) for m in models))
        files = companion_scan.read_files(spark, folders).cache()
        every = spark.createDataFrame([(f,) for f in folders], "folder string")
        evidence = companion_scan.evidence(files)
        parts.append(shaped(companions.findings(evidence, every).withColumnRenamed("folder", "path"), check=F.lit("companion_config"), classification=F.lit("high")))
        parts.append(shaped(companion_scan.skipped(files).withColumnRenamed("folder", "path"), check=F.lit("companion_config"), classification=F.lit("high")))
        done("companions")
    known = []
    chosen = [runtime] if runtime else programs
    if chosen:
        about, sources = runtimes.read_runtimes(spark, chosen, {runtime: runtime_version} if runtime and runtime_version else None)
        identified = runtimes.identify(about, sources).cache()
        parts += [shaped(runtimes.posture(identified).withColumnRenamed("runtime", "path"), classification=F.lit("high")), flag_findings(identified)]
        known = [r.asDict() for r in identified.select("runtime", "component", "format", "build", "version", "commit", "method", "confidence", "flags").collect()]
        done("runtime")
        if models:
            rows = headers.where("error_class is null").withColumnRenamed("path", "artifact_id").withColumn("has_chat_template", F.col("chat_template").isNotNull())
            about = identified.select(F.col("runtime").alias("runtime_id"), "component", "build", "version", "confidence")
            if bundle:
                joined = advisories.findings_by_predicates(rows, about, advisories.from_bundle(bundle.table(spark)))
            else:
                joined = advisories.findings(rows.withColumnRenamed("has_chat_template", "has_template"), about, advisories.advisories(spark))
            parts.append(shaped(joined.select(F.col("artifact_id").alias("path"), F.concat(F.lit("join."), "advisory").alias("id"), F.lit("runtime_advisory_join").alias("check"), "status", "severity", F.col("confidence").alias("classification"), "mandatory")))
            done("advisories")
    else:
        parts.append(one("join.no_runtime", "runtime_advisory_join", "unchecked", False))
    if bundle and bundle.expired:
        parts.append(one("bundle.expired", "knowledge_bundle", "unchecked"))
    if tools:
        targets_table = spark.createDataFrame([(t.path,) for t in found], "target string")
        parts.append(shaped(scanners.findings(scanners.scan(targets_table, tools)).withColumnRenamed("target", "path")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("run", F.lit(1)).cache()
    result = verdict.verdicts(rows.withColumn("classification", F.coalesce("classification", F.lit("high"))), ["run"], F.lit(bool(chosen))).first()
    advice = [r.asDict() for r in verdict.recommendations(rows, ["run"]).drop("run").collect()]
    listed = [r.asDict() for r in rows.drop("run").orderBy("id", "path").collect()]  # what one run reports
    done("verdict")
    return {"verdict": result.verdict, "exit_code": result.exit_code, "findings": listed, "artifacts": artifacts, "runtimes": known, "recommendations": advice, "bundle": {"version": bundle.version, "digest": bundle.digest} if bundle else None, "observations": {"seconds": timing}}


__all__ = ["check", "facts", "label", "reports"]
