"""Tools for programs: a catalogue with schemas, and calls that answer with JSON, errors included."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayer import engine
from assayer.operators import advisories, companion_scan, digests, reports, structure, template_findings
from assayer.operators.templates import evidence

_TEXT = {"type": "string"}
_LIST = {"type": "array", "items": _TEXT}


def _schema(required: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "properties": required | (optional or {}), "required": sorted(required), "additionalProperties": False}


def inspect(spark: SparkSession, targets: list[str], runtime: str | None = None, runtime_version: str | None = None, expected_sha256: str | None = None) -> dict:
    return reports.agent(engine.check(spark, targets, runtime, runtime_version, expected_sha256))


def artifact_facts(spark: SparkSession, path: str) -> dict:
    row = engine.facts(spark, [path]).first().asDict(recursive=True)
    row["metadata"] = {k: v for k, v in json.loads(row.get("metadata") or "{}").items() if not isinstance(v, (list, dict))}
    return row


def check_template(spark: SparkSession, template: str) -> dict:
    df = spark.createDataFrame([(1, template)], "run int, template string")
    found = template_findings.template_findings(df, "run", "template")
    listed = [r.asDict() for r in found.drop("run").orderBy("id").collect()]
    return {"verdict": template_findings.template_verdicts(found, ["run"]).first().verdict, "findings": listed}


def companion_scan_tool(spark: SparkSession, folder: str, runtime: str = "llama.cpp") -> dict:
    files = companion_scan.read_files(spark, [folder]).cache()
    rows = companion_scan.evidence(files, runtime).orderBy("seq").collect()
    return {"evidence": [r.asDict() for r in rows], "errors": [r.summary for r in companion_scan.skipped(files).orderBy("id").collect()], "limit_reached": companion_scan.walk(folder)[1]}


def list_advisories(spark: SparkSession) -> dict:
    return {"advisories": [r.asDict(recursive=True) for r in advisories.advisories(spark).orderBy("advisory").collect()]}


def hash_file(spark: SparkSession, path: str, expected_sha256: str | None = None) -> dict:
    df = digests.file_digests(spark.createDataFrame([(path,)], "path string")).withColumn("expected", digests.expectation(F.lit(expected_sha256).cast("string")))
    r = df.withColumn("matches", F.col("digest") == F.col("expected")).first()
    if r.error:
        raise OSError(r.error)
    return {"path": path, "digest": r.digest, "bytes_read": r.bytes_read, "matches": r.matches}


def self_test(spark: SparkSession, vectors: list[dict] | None = None) -> dict:
    """How the template detectors do on labelled templates (template, malicious)."""
    rows = [(bool(v["malicious"]), any(e[0].removeprefix("poison_") in template_findings.HIGH for e in evidence(v["template"]))) for v in vectors or []]
    if not rows:
        return {"tp": 0, "tn": 0, "fp": 0, "fn": 0, "warning": "no labelled templates were given"}
    got = structure.confusion(spark.createDataFrame(rows, "e boolean, d boolean").withColumn("all", F.lit(1)), "e", "d", ["all"]).first()
    return {k: got[k] for k in ("tp", "tn", "fp", "fn")}


TOOLS = {
    "inspect": ("Check models, what lies beside them and a runtime.", _schema({"targets": _LIST}, {"runtime": _TEXT, "runtime_version": _TEXT, "expected_sha256": _TEXT}), inspect),
    "artifact_facts": ("What a model's header says.", _schema({"path": _TEXT}), artifact_facts),
    "check_template": ("Check a chat template.", _schema({"template": _TEXT}), check_template),
    "companion_scan": ("Check the files of a folder.", _schema({"folder": _TEXT}, {"runtime": _TEXT}), companion_scan_tool),
    "list_advisories": ("List the advisories.", _schema({}), list_advisories),
    "hash": ("Digest of a file, compared with an expected one.", _schema({"path": _TEXT}, {"expected_sha256": _TEXT}), hash_file),
    "self_test": ("Count hits and misses of the template detectors on labelled templates.", _schema({}, {"vectors": {"type": "array", "items": {"type": "object"}}}), self_test),
}


def find(name: str) -> tuple:
    if name not in TOOLS:
        raise KeyError(name)
    return TOOLS[name]


def functions() -> list[dict]:
    """The catalogue as function descriptions."""
    return [{"type": "function", "function": {"name": n, "description": d, "parameters": s}} for n, (d, s, _) in TOOLS.items()]


def tool_specs() -> list[dict]:
    """The catalogue as tools with an input schema."""
    return [{"name": n, "description": d, "input_schema": s} for n, (d, s, _) in TOOLS.items()]


def manifest() -> str:
    """The catalogue in Markdown."""
    return "\n".join(f"## {n}\n\n{d}\n\n```json\n{json.dumps(s, indent=2, sort_keys=True)}\n```\n" for n, (d, s, _) in TOOLS.items())


def render(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)


def _fits(value, schema: dict) -> bool:
    kind = {"string": str, "array": list, "object": dict}[schema["type"]]
    return isinstance(value, kind) and (kind is not list or all(_fits(v, schema["items"]) for v in value))


def invoke(spark: SparkSession, name: str, arguments: dict | str | None = None) -> dict:
    """The answer of a tool under ``result``, or ``error`` with a kind: unknown_tool, invalid_arguments, io_error or
    internal_error; never an exception."""
    try:
        _, schema, call = find(name)
    except KeyError:
        return {"error": {"kind": "unknown_tool", "message": f"there is no tool {name}"}}
    try:
        given = json.loads(arguments) if isinstance(arguments, str) else arguments or {}
        if not isinstance(given, dict):
            raise ValueError("arguments must be an object")
        odd = set(given) - set(schema["properties"])
        lacking = set(schema["required"]) - set(given)
        if odd or lacking:
            raise ValueError(f"unknown arguments {sorted(odd)}, missing arguments {sorted(lacking)}")
        for k, v in given.items():
            if not _fits(v, schema["properties"][k]) and (v is not None or k in schema["required"]):
                raise ValueError(f"{k} must be of type {schema['properties'][k]['type']}")
        return {"result": call(spark, **given)}
    except OSError as e:
        return {"error": {"kind": "io_error", "message": str(e)}}
    except (TypeError, ValueError) as e:
        return {"error": {"kind": "invalid_arguments", "message": str(e)}}
    except Exception as e:  # whatever a job raises must reach the caller as an answer
        return {"error": {"kind": "internal_error", "message": f"{type(e).__name__}: {e}".split("\n")[0]}}
