"""Other scanners as programs: whether they can be run, on what, how, and what their output says.

Nothing is run unless a caller asks for it.  A program gets no shell, a small environment with telemetry off, bounds on
time, output and memory, and its whole process group goes when a bound is passed."""

from __future__ import annotations

import json
import os
import re
import shutil
import signal
import subprocess
import tempfile
import time
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import slug

# The scanners' suffixes, words and exit codes, bounds, and the environment.
PICKLES = (".bin", ".pickle", ".pkl", ".pt", ".pth")
MODELS = (*PICKLES, ".h5", ".hdf5", ".keras", ".onnx", ".pb")
ENVIRONMENT = ("COMSPEC", "HOME", "LANG", "LC_ALL", "LC_CTYPE", "PATH", "PATHEXT", "SYSTEMROOT", "TEMP", "TMP", "TMPDIR", "WINDIR")
OPT_OUT = {"DO_NOT_TRACK": "1", "HF_HUB_DISABLE_TELEMETRY": "1", "NO_ANALYTICS": "1", "PROMPTFOO_DISABLE_TELEMETRY": "1"}
SECONDS, OUTPUT_BYTES, MEMORY_MB, TEXT = 60, 1 << 20, 1024, 2000
IMPORT_LINE = r"^(.+?):\s+(dangerous|suspicious)\s+import\s+'([^']+)'\s+FOUND\s*$"
ASSESSMENTS = {"LIKELY_OVERTLY_MALICIOUS": "critical", "LIKELY_MALICIOUS": "critical", "LIKELY_UNSAFE": "high", "POSSIBLY_UNSAFE": "medium", "SUSPICIOUS": "medium"}
# End of fixed values.
SCHEMA = "target string, tool string, n int, outcome string, external string, severity string, message string, location string, error string"


class Run(NamedTuple):
    code: int | None
    out: str
    err: str
    seconds: float
    report: str = ""


def supported(tool: Column, suffix: Column, is_folder: Column) -> Column:
    """Whether a scanner takes a target."""
    return (tool == "modelaudit") | is_folder | (tool.isin("picklescan", "fickling") & suffix.isin(*PICKLES)) | ((tool == "modelscan") & suffix.isin(*MODELS))


def arguments(tool: str, target: str, report: str) -> list[str]:
    return {
        "modelaudit": ["modelaudit", "scan", target, "--format", "json", "--no-cache"],
        "picklescan": ["picklescan", "--path", target, "--log", "INFO"],
        "fickling": ["fickling", "--check-safety", "--json-output", report, target],
        "modelscan": ["modelscan", "scan", "--path", target, "--reporting-format", "json"],
    }[tool]


def environment() -> dict[str, str]:
    return {k: os.environ[k] for k in ENVIRONMENT if k in os.environ} | OPT_OUT


def execute(command: list[str], seconds: float = SECONDS, most: int = OUTPUT_BYTES, memory_mb: int = MEMORY_MB) -> Run:
    """Run a program within bounds; a code of None means that it was ended."""
    if min(seconds, most) <= 0 or memory_mb < 0:
        raise ValueError("bounds must be positive")

    def bound() -> None:
        import resource

        if memory_mb:
            resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))

    began = time.monotonic()
    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        p = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=out, stderr=err, env=environment(), start_new_session=True, preexec_fn=bound)
        code = None
        while time.monotonic() - began < seconds and max(os.fstat(out.fileno()).st_size, os.fstat(err.fileno()).st_size) <= most:
            code = p.poll()
            if code is not None:
                break
            time.sleep(0.02)
        if code is None:
            try:
                os.killpg(p.pid, signal.SIGKILL)
            except OSError:
                pass
            p.wait()
        texts = []
        for f in (out, err):
            f.seek(0)
            texts.append(f.read(most).decode("utf-8", "replace"))
    return Run(code, *texts, time.monotonic() - began)


def version(tool: str) -> str | None:
    if tool == "picklescan" or not shutil.which(tool):
        return None
    run = execute([tool, *(["scan"] if tool == "modelscan" else []), "--version"], 10, 16 << 10)
    return (run.out or run.err).strip() or None if run.code == 0 else None


def _read_lines(run: Run) -> tuple[list, str | None]:
    """A line for each import."""
    found = []
    for at, line in enumerate(run.out.splitlines()):
        if m := re.match(IMPORT_LINE, line, re.IGNORECASE):
            place, kind, name = m[1], m[2].lower(), m[3]
            found.append((f"line-{at}", "critical" if kind == "dangerous" else "medium", f"{kind}: {name}", place))
    return found, "an exit code of findings without any" if run.code == 1 and not found else None


def _read_assessment(run: Run) -> tuple[list, str | None]:
    """One word for the whole file."""
    report = json.loads(run.report)
    word = str(report.get("severity", "UNKNOWN")).upper()
    found = [(word.lower(), ASSESSMENTS[word], str(report.get("analysis", word.lower())), "")] if word in ASSESSMENTS else []
    return found, "an exit code of findings without any" if run.code == 1 and not found else None


def _issue_reader(text, fields: tuple[tuple[str, ...], ...], failed: str):
    """A list of issues; fields: the keys of an id, a message and a place, the first that is there counts."""

    def read(run: Run) -> tuple[list, str | None]:
        report = json.loads(text(run.out))
        issues = report.get("issues", [])
        if not isinstance(issues, list):
            raise ValueError("its issues are no list")
        first = lambda issue, keys, other: str(next((issue[k] for k in keys if issue.get(k)), other))
        ident, message, place = fields
        found = [(first(x, ident, f"issue-{i}"), str(x.get("severity", "info")), first(x, message, "no message"), first(x, place, "")) for i, x in enumerate(issues) if isinstance(x, dict)]
        return found, "errors of its own" if report.get(failed) else None

    return read


READERS = {
    "picklescan": _read_lines,
    "fickling": _read_assessment,
    "modelaudit": _issue_reader(lambda out: out, (("rule_code", "type"), ("message",), ("location",)), "has_errors"),
    "modelscan": _issue_reader(lambda out: out[out.index("{") : out.rindex("}") + 1], (("operator",), ("description",), ("source",)), "errors"),
}


def parse(tool: str, run: Run) -> tuple[list[tuple[str, str, str, str]], str | None]:
    """(id, severity, message, location) of each finding, and an error, which leaves no findings."""
    ended = None if run.code in (0, 1) else run.err.strip() or run.out.strip() or f"exit code {run.code}"
    try:
        found, fault = READERS[tool](run)
    except (ValueError, AttributeError, TypeError) as e:
        found, fault = [], f"output that can't be read ({e})"
    error = ended or (f"{tool} gave {fault}" if fault else None)
    return ([] if error else found), error


def scan(targets: DataFrame, tools: list[str]) -> DataFrame:
    """Runs scanners on targets (column target: paths that all executors see), in tasks; a row a finding, or one that says
    not_available, error or completed."""

    def run(it):
        for b in it:
            rows = []
            for target, tool in zip(*(c.to_pylist() for c in b.columns)):
                if not shutil.which(tool):
                    rows.append((target, tool, 0, "not_available", None, None, None, None, None))
                    continue
                with tempfile.TemporaryDirectory() as folder:
                    report = os.path.join(folder, "report.json")
                    try:
                        done = execute(arguments(tool, target, report))
                        if os.path.exists(report):
                            with open(report, encoding="utf-8", errors="replace") as f:
                                done = done._replace(report=f.read(OUTPUT_BYTES))
                        found, error = parse(tool, done)
                    except OSError as e:
                        found, error = [], str(e)
                rows += [(target, tool, i, "finding", *f, None) for i, f in enumerate(found)]
                if error or not found:
                    rows.append((target, tool, 0, "error" if error else "completed", None, None, None, None, error))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "n" else pa.string()) for c, n in zip(zip(*rows), names)], names=names)

    pairs = targets.select("target", F.explode(F.array(*map(F.lit, tools))).alias("tool"), F.lower(F.regexp_extract("target", r"[^/](\.[^./]+)$", 1)).alias("suffix"))
    folder = F.col("suffix") == ""
    return pairs.where(supported(F.col("tool"), F.col("suffix"), folder)).select("target", "tool").mapInArrow(run, SCHEMA)


def import_lines(outputs: DataFrame, text_col: str) -> DataFrame:
    """The same findings as ``parse`` makes of a pickle scanner's output, for tables of captured output: the columns but the
    text, and external, severity, message, location and n."""
    rest = [c for c in outputs.columns if c != text_col]
    lines = outputs.select(*rest, F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "line"))
    part = lambda g: F.regexp_extract("line", f"(?i){IMPORT_LINE}", g)
    kind = F.lower(part(2))
    rows = lines.where(F.col("line").rlike(f"(?i){IMPORT_LINE}"))
    return rows.select(*rest, F.concat(F.lit("line-"), F.col("at").cast("string")).alias("external"), F.when(kind == "dangerous", "critical").otherwise("medium").alias("severity"), F.concat(kind, F.lit(": "), part(3)).alias("message"), part(1).alias("location"), F.col("at").alias("n"))


def findings(results: DataFrame) -> DataFrame:
    """Findings on targets from scanners' rows; the same words on the same place of a target count once, for the first
    scanner (by name and number)."""
    said = F.lower("severity")
    high, known = said.isin("high", "critical"), F.col("outcome") == "finding"
    message, location = F.substring(F.coalesce("message", F.lit("finding")), 1, TEXT), F.substring(F.coalesce("location", F.lit("")), 1, TEXT)
    weight = F.when(high, said).otherwise("info")
    same = Window.partitionBy("target", "outcome", F.when(known, weight), F.when(known, F.lower(message)).otherwise(F.col("tool")), F.when(known, F.lower(location))).orderBy("tool", "n")
    status = F.when(F.col("outcome") == "not_available", "unchecked").when(F.col("outcome") == "error", "error").when(F.col("outcome") == "completed", "verified").when(high, "suspicious").otherwise("unchecked")
    ident = F.when(known, F.concat_ws(".", F.lit("delegate"), "tool", slug(F.coalesce("external", F.lit("unknown"))), F.col("n").cast("string"))).otherwise(F.concat_ws(".", F.lit("delegate"), "tool", "outcome"))
    rows = results.withColumn("_first", F.row_number().over(same)).where("_first = 1")
    return rows.select("target", ident.alias("id"), F.concat(F.lit("delegate_"), "tool").alias("check"), status.alias("status"), F.when(known, weight).otherwise("info").alias("severity"), F.when(known, "medium").otherwise("high").alias("classification"), (known & high).alias("mandatory"), F.when(known, message).otherwise(F.col("error")).alias("summary"))
