"""Findings on chat templates: from evidence, from what is known of a family, and a verdict of their own."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.jinja import JinjaError, Node, parse
from assayer.operators.templates import HIGH, template_evidence


def construct_counts(evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, constructs, kinds): how much evidence, and its kinds in order with their numbers, as ``call×2, macro``."""
    each = evidence.groupBy(*by, "kind").agg(F.count("*").alias("n"))
    named = F.when(F.col("n") > 1, F.concat("kind", F.lit("×"), F.col("n").cast("string"))).otherwise(F.col("kind"))
    rows = each.groupBy(*by).agg(F.sum("n").alias("constructs"), F.array_sort(F.collect_list(F.struct("kind", named.alias("t")))).alias("_kinds"))
    return rows.select(*by, "constructs", F.array_join(F.transform("_kinds", lambda x: x["t"]), ", ").alias("kinds"))


def security_findings(evidence: DataFrame, by: list[str]) -> DataFrame:
    """A finding for each piece of evidence, numbered by kind in order (column seq); what a pattern found in a template that
    can't be parsed counts with its kind."""
    base = F.regexp_replace("kind", "^poison_", "")
    poison, high = F.col("kind").startswith("poison_"), base.isin(*HIGH)
    n = F.row_number().over(Window.partitionBy(*by, base).orderBy("seq")) - 1
    rows = evidence.where(~F.col("kind").isin("error", "limit"))
    return rows.select(
        *by, F.concat(F.lit("template."), F.when(poison, "poison").otherwise("security"), F.lit("."), base, F.lit("."), n.cast("string")).alias("id"),
        F.when(poison, "template_poison_detection").otherwise("template_enhanced_security").alias("check"), F.when(high, "suspicious").otherwise("unchecked").alias("status"),
        F.when(high, "high").otherwise("low").alias("severity"), F.when(high, "high").otherwise("medium").alias("classification"), high.alias("mandatory"),
    )


def template_findings(templates: DataFrame, key: str, template: str) -> DataFrame:
    """All findings on each template: none there, broken or over a limit, parsed, its constructs, and what is suspicious."""
    found = template_evidence(templates, key, template)
    row = lambda df, ident, check, status, severity, mandatory: df.select(key, ident.alias("id"), F.lit(check).alias("check"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit("high").alias("classification"), F.lit(mandatory).alias("mandatory"))
    bad = found.where(F.col("kind").isin("error", "limit"))
    none = F.col(template).isNull() | (F.col(template) == "")
    absent = row(templates.where(none), F.lit("template.absent"), "chat_template_static", "not_applicable", "info", False)
    broken = row(bad, F.concat(F.lit("template."), "kind"), "chat_template_static", "error", "info", True)
    parsed = row(templates.where(~none).join(bad.select(key), key, "left_anti"), F.lit("template.parsed"), "chat_template_static", "clean", "info", False)
    built = row(construct_counts(found.where(~F.col("kind").isin("error", "limit")), [key]), F.lit("template.constructs"), "template_constructs", "unchecked", "low", False)
    return absent.unionByName(broken).unionByName(parsed).unionByName(built).unionByName(security_findings(found, [key]))


def template_verdicts(findings: DataFrame, by: list[str]) -> DataFrame:
    """not_suitable if anything is suspicious, undetermined if what isn't positive weighs high, else clean."""
    weighs = ~F.col("status").isin("verified", "clean", "not_applicable") & F.col("severity").isin("high", "critical")
    rows = findings.groupBy(*by).agg(F.bool_or(F.col("status") == "suspicious").alias("s"), F.bool_or(weighs).alias("w"))
    return rows.select(*by, F.when(F.col("s"), "not_suitable").when(F.col("w"), "undetermined").otherwise("clean").alias("verdict"))


def fingerprint(text: str) -> str | None:
    """A digest of a template's tree in which only the white space of plain text doesn't count; null if it can't be parsed."""

    def shape(n: Node):
        value = re.sub(r"\s+", " ", n.value).strip() if n.kind == "Data" and isinstance(n.value, str) else n.value
        return n.kind, repr(value), [shape(k) for k in n.kids], sorted((name, [shape(k) for k in (p if isinstance(p, list) else [p])]) for name, p in n.body.items())

    try:
        return hashlib.sha256(repr(shape(parse(text))).encode("utf-8", "surrogatepass")).hexdigest()
    except (JinjaError, RecursionError):
        return None


def with_fingerprint(df: DataFrame, template: str, out: str = "fingerprint") -> DataFrame:
    def run(it):
        for b in it:
            marks = [None if t is None else fingerprint(t) for t in b.column(template).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} string")


def compare_references(candidates: DataFrame, references: DataFrame, template: str = "template") -> DataFrame:
    """The columns of ``candidates`` (family, variant, revision and a template among them) with classification: identical
    to the reference of the same three, cosmetic (only white space of plain text differs), different, error (one can't be
    parsed), or not_applicable without such a reference."""
    own = with_fingerprint(candidates, template, "_mark")
    known = with_fingerprint(references.select("family", "variant", "revision", F.col("template").alias("_reference")), "_reference", "_known")
    both = own.join(known, ["family", "variant", "revision"], "left")
    kind = (
        F.when(F.col("_reference").isNull(), "not_applicable").when(F.col(template) == F.col("_reference"), "identical")
        .when(F.col("_mark").isNull() | F.col("_known").isNull(), "error").when(F.col("_mark") == F.col("_known"), "cosmetic").otherwise("different")
    )
    return both.select(*candidates.columns, kind.alias("classification"))


def comparison_findings(compared: DataFrame, by: list[str]) -> DataFrame:
    """A finding for each comparison."""
    c = F.col("classification")
    status = F.when(c == "identical", "verified").when(c == "cosmetic", "clean").when(c == "different", "unchecked").when(c == "error", "error").otherwise("not_applicable")
    return compared.select(*by, F.lit("template.reference_comparison").alias("id"), F.lit("chat_template_static").alias("check"), status.alias("status"), F.when(c == "different", "low").otherwise("info").alias("severity"), F.lit(True).alias("mandatory"))
