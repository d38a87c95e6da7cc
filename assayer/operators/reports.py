"""Sinks: canonical JSON, SARIF rows and Markdown from findings."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import explained, sarif_level
from assayer.sources import report_sink
from assayer.tables import save


def canonical(value) -> str:
    """Sorted keys, two spaces, other scripts kept, one newline at the end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def write_atomically(text: str, path: str) -> None:
    """A reader sees the old file or the whole new one."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


#: Ranges of seq in which rules are numbered; their bounds are all that the driver holds.
RANGES = 200


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(id, rule_index, level, summary): the first finding of each id, numbered in order of appearance (column seq, ties
    by id).  Ids are numbered within ranges of seq, and ranges by the ids before them, so no task sees all ids.  Ranges
    are by fixed bounds, a function of seq alone, so that it doesn't matter which task counts or numbers a row."""
    return _numbered_rules(findings).select("id", sarif_level(F.col("f.severity")).alias("level"), F.col("f.summary").alias("summary"), F.col("rule_index").cast("int").alias("rule_index"))


def _numbered_rules(findings: DataFrame) -> DataFrame:
    """(id, seq, f, rule_index): f the first finding of each id."""
    extra = ["check"] if "check" in findings.columns else []
    first = findings.groupBy("id").agg(F.min("seq").alias("seq"), F.min_by(F.struct("severity", "summary", *extra), "seq").alias("f"))
    bounds = F.array(*map(F.lit, findings.approxQuantile("seq", [i / RANGES for i in range(1, RANGES)], 1e-3))).cast("array<double>")
    ranged = first.withColumn("_part", F.size(F.filter(bounds, lambda b: b <= F.col("seq"))))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))  # a row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    numbered = ranged.join(F.broadcast(before), "_part").withColumn("rule_index", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("seq", "id")) - 1)
    return numbered.select("id", "seq", "f", "rule_index")


def sarif_results(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(rule_id, rule_index, level, message, uri): suspicious findings and errors; the place is the finding's own path if
    it is an artifact's, else the first artifact's."""
    rules = sarif_rules(findings).select(F.col("id").alias("rule_id"), "rule_index")
    paths = artifacts.select(F.col("path").alias("_p")).distinct()
    head = artifacts.orderBy("seq").limit(1).select(F.col("path").alias("_first"))
    rows = findings.where(F.col("status").isin("suspicious", "error")).join(paths, F.col("path") == F.col("_p"), "left")
    rows = rows.crossJoin(F.broadcast(head)).join(rules, F.col("id") == F.col("rule_id"))  # head: one row
    return rows.select("rule_id", "rule_index", sarif_level(F.col("severity")).alias("level"), F.col("summary").alias("message"), F.coalesce("_p", "_first").alias("uri"))


def report_rows(findings: DataFrame, by: list[str]) -> DataFrame:
    """One JSON text per run: findings sorted by id, ties in order of appearance."""
    item = F.struct("id", "seq", "status", "severity", "check", "summary")
    return findings.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("findings")).select(*by, F.to_json(F.struct(F.transform("findings", lambda x: x.dropFields("seq")).alias("findings"))).alias("report"))


def markdown_escape(text):
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def explain(findings: DataFrame, ident: str) -> DataFrame:
    """The first finding of an id."""
    return findings.where(F.col("id") == ident).orderBy("seq").limit(1)


def previews(text, most: int = 200):
    """The first characters of a value, by code points."""
    return F.substring(text, 1, most)


def status_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(F.count_if(F.col("status") == "suspicious").alias("suspicious"), F.count_if(F.col("status") == "error").alias("errors"))


def errors_by_place(findings: DataFrame, by: list[str], place: str) -> DataFrame:
    """(by, place, errors): the ids of a place's errors in order of appearance."""
    rows = findings.where(F.col("status") == "error").groupBy(*by, place).agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("e"))
    return rows.select(*by, place, F.transform("e", lambda x: x["id"]).alias("errors"))


def needs(findings: DataFrame, by: list[str]) -> DataFrame:
    """Whether findings bear on the network or call for a sandbox, by their ids."""
    some = lambda *words: F.bool_or(F.col("id").rlike("|".join(words)))
    return findings.groupBy(*by).agg(some("bind_all_interfaces", "api_key").alias("network"), some("template\\.", "CVE", "GHSA").alias("sandbox"))


def summaries(findings: DataFrame, verdicts: DataFrame, by: list[str]) -> DataFrame:
    """(by, verdict, summary): a sentence with the number of suspicious findings and the first of them."""
    bad = F.col("status") == "suspicious"
    rows = findings.groupBy(*by).agg(F.count_if(bad).alias("n"), F.min_by(F.struct("id", "summary"), F.when(bad, F.col("seq"))).alias("f"))
    said = F.when(F.col("n") > 0, F.concat(F.lit("Verdict: "), "verdict", F.lit(". "), F.col("n").cast("string"), F.lit(" suspicious finding(s). First: "), "f.id", F.lit(" — "), F.coalesce("f.summary", F.lit("")))).otherwise(F.concat(F.lit("Verdict: "), "verdict", F.lit(". No suspicious findings.")))
    return verdicts.join(rows.withColumn("n", F.coalesce("n", F.lit(0))), by, "left").fillna({"n": 0}).select(*by, "verdict", said.alias("summary"))


def missing_core(findings: DataFrame, by: list[str], core: tuple[str, ...]) -> DataFrame:
    """(by, missing, gaps, checked): core checks without a row, those with rows but none positive, and all that ran."""
    good = F.col("status").isin("verified", "clean", "not_applicable")
    rows = findings.groupBy(*by).agg(F.collect_set("check").alias("checked"), F.collect_set(F.when(good, F.col("check"))).alias("positive"))
    wanted = F.array(*map(F.lit, core))
    gaps = F.array_except(F.array_intersect(wanted, "checked"), "positive")
    return rows.select(*by, F.array_sort(F.array_except(wanted, "checked")).alias("missing"), F.array_sort(gaps).alias("gaps"), F.array_sort(F.array_union("checked", F.array())).alias("checked"))


# Documents of one run, whose findings a caller has collected: bounded by what a run reports.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}


def in_order(findings: list[dict]) -> list[dict]:
    return [f for _, f in sorted(enumerate(findings), key=lambda x: (x[1]["id"], x[0]))]


def projection(report: dict) -> dict:
    """What of a report doesn't depend on when it was made: findings by id, coverage and limitations, no timings."""
    counts = {s: sum(f["status"] == s for f in report["findings"]) for s in ("verified", "clean", "suspicious", "unchecked", "not_applicable", "error")}
    own = {k: v for k, v in report.items() if k not in ("observations", "began", "seconds")}
    return own | {"findings": in_order(report["findings"]), "coverage": counts | {"total": len(report["findings"])}, "limitations": ["Static checks only: nothing was loaded or executed.", "A verdict covers the checks that were performed."]}


def sarif(report: dict, tool: str = "assayer", version: str = "1") -> dict:
    """A SARIF 2.1.0 document: a rule for the first finding of each id, results for what is suspicious or failed."""
    rules: dict[str, dict] = {}
    for f in report["findings"]:
        text = f.get("summary") or f["id"]
        rules.setdefault(f["id"], {"id": f["id"], "shortDescription": {"text": text}, "fullDescription": {"text": text}, "defaultConfiguration": {"level": LEVELS.get(f["severity"], "none")}, "properties": {"tags": [f["check"]]}})
    number, paths = {k: i for i, k in enumerate(rules)}, [a["path"] for a in report.get("artifacts", [])]
    results = []
    for f in report["findings"]:
        if f["status"] in ("suspicious", "error"):
            place = f.get("path") if f.get("path") in paths else paths[0] if paths else None
            where = {"locations": [{"physicalLocation": {"artifactLocation": {"uri": place}}}]} if place else {}
            results.append({"ruleId": f["id"], "ruleIndex": number[f["id"]], "level": LEVELS.get(f["severity"], "none"), "message": {"text": f.get("summary") or f["id"]}, **where})
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": list(rules.values())}}, "results": results, "artifacts": [{"location": {"uri": p}} for p in paths], "properties": {"verdict": report["verdict"]}, "invocations": [{"executionSuccessful": report["exit_code"] < 3, "exitCode": report["exit_code"]}]}
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}


# The same documents for findings that nothing holds at once.
def write_json(findings: DataFrame, report: dict, path: str, **options) -> None:
    """What ``canonical(projection(report))`` is, for findings in a table (columns of a finding and seq): tasks write the
    findings by id, ties by seq."""
    shown = [c for c in findings.columns if c != "seq"]
    counts = findings.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("verified", "clean", "suspicious", "unchecked", "not_applicable", "error"))).first()
    frame = projection(report | {"findings": []}) | {"findings": "@findings", "coverage": counts.asDict()}
    rows = findings.select(F.lit("findings").alias("section"), report_sink.item(**{c: F.col(c) for c in shown}).alias("item"), "id", "seq")
    report_sink.write_report(rows, frame, path, "id", "seq", **options)


def write_sarif(findings: DataFrame, artifacts: DataFrame, report: dict, path: str, **options) -> None:
    """What ``canonical(sarif(report))`` is, for findings (columns of a finding and seq) and artifacts (path, seq) in tables."""
    frame = sarif(report | {"findings": [], "artifacts": []})
    run = frame["runs"][0]
    run["tool"]["driver"]["rules"], run["results"], run["artifacts"] = "@rules", "@results", "@artifacts"
    numbered = save(_numbered_rules(findings), "rules")
    said = F.coalesce(F.when(F.col("f.summary") != "", F.col("f.summary")), F.col("id"))
    text = lambda c: F.struct(c.alias("text"))
    level = lambda c: F.coalesce(sarif_level(c), F.lit("none"))
    rules = numbered.select(F.lit("rules").alias("section"), report_sink.item(id=F.col("id"), shortDescription=text(said), fullDescription=text(said), defaultConfiguration=F.struct(level(F.col("f.severity")).alias("level")), properties=F.struct(F.array(F.col("f.check")).alias("tags"))).alias("item"), F.col("rule_index").cast("long").alias("seq"))
    paths = artifacts.select(F.col("path").alias("_p")).distinct()
    head = artifacts.orderBy("seq").limit(1).select(F.col("path").alias("_first"))
    bad = findings.where(F.col("status").isin("suspicious", "error")).join(paths, F.col("path") == F.col("_p"), "left").join(F.broadcast(head), how="left")  # head: a row at most
    bad = bad.join(numbered.select(F.col("id").alias("_id"), "rule_index"), F.col("id") == F.col("_id"))
    place = F.coalesce("_p", "_first")
    message = text(F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("id")))
    base = {"ruleId": F.col("id"), "ruleIndex": F.col("rule_index"), "level": level(F.col("severity")), "message": message}
    where = F.array(F.struct(F.struct(F.struct(place.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    results = bad.select(F.lit("results").alias("section"), F.when(place.isNull(), report_sink.item(**base)).otherwise(report_sink.item(**base, locations=where)).alias("item"), F.col("seq").cast("long").alias("seq"))
    listed = artifacts.select(F.lit("artifacts").alias("section"), report_sink.item(location=F.struct(F.col("path").alias("uri"))).alias("item"), F.col("seq").cast("long").alias("seq"))
    report_sink.write_report(rules.unionByName(results).unionByName(listed), frame, path, "seq", **options)


def escaped(text) -> str:
    return re.sub(r"([\\`*_\[\]<>|])", r"\\\1", str(text))


def _table(head: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join(escaped(c) for c in cells) + " |"
    return [line(head), "|" + "-|" * len(head), *map(line, rows), ""] if rows else []


def markdown(report: dict, include_observations: bool = False) -> str:
    """All of a report for people: verdict, artifacts, runtimes, what is suspicious, errors with what they mean, gaps,
    coverage, advice, the bundle and, if asked for, observations.  Sections without anything to say are left out."""
    found = in_order(report["findings"])
    pick = lambda s: [f for f in found if f["status"] == s]
    out = [f"# Verdict: {escaped(report['verdict'])}", "", *(f"> {x}" for x in projection(report)["limitations"]), ""]
    artifacts, runtimes = report.get("artifacts", []), report.get("runtimes") or []
    if artifacts:
        template = lambda a: {True: "yes", False: "no"}.get(a.get("has_chat_template"), "")
        rows = [[a.get("name") or os.path.basename(a["path"]), a["path"], a.get("architecture") or "unknown", a.get("gguf_version") or "", "" if a.get("tensor_count") is None else a["tensor_count"], template(a)] for a in artifacts]
        out += ["## Artifacts", "", *_table(["name", "path", "architecture", "format version", "tensors", "chat template"], rows)]
    if runtimes:
        known = lambda r: r.get("version") or (f"build {r['build']}" if r.get("build") is not None else r.get("commit") or "unknown")
        out += ["## Runtimes", "", *_table(["component", "version", "found by", "confidence"], [[r.get("component"), known(r), r.get("method") or "", r.get("confidence") or ""] for r in runtimes])]
    if bad := pick("suspicious"):
        out += [f"## Suspicious ({len(bad)})", ""]
        for f in bad:
            out += [f"- **{escaped(f.get('summary') or f['id'])}**", f"  - id: {escaped(f['id'])}", f"  - severity: {f['severity']}, confidence: {f.get('classification') or 'high'}", *([f"  - path: {escaped(f['path'])}"] if f.get("path") else [])]
        out.append("")
    if errors := pick("error"):
        out += [f"## Errors ({len(errors)})", ""]
        for f in errors:
            said = f.get("summary") or ""
            _, meaning, cause = explained(said)
            out += [f"- **{escaped(f.get('path') or f['id'])}**: {escaped(said or f['id'])}", *([f"  - meaning: {meaning}", f"  - likely cause: {cause}"] if f.get("check") == "gguf_structure" else [])]
        out.append("")
    if gaps := [f for f in pick("unchecked") if f["mandatory"]]:
        out += [f"## Not checked ({len(gaps)})", "", *(f"- {escaped(f.get('summary') or f['id'])}" for f in gaps), ""]
    for status in ("unchecked", "verified", "clean", "not_applicable"):
        rows = [[f["id"], f["severity"], f.get("summary") or ""] for f in pick(status) if status != "unchecked" or not f["mandatory"]]
        if rows:
            out += [f"## {'notes' if status == 'unchecked' else status} ({len(rows)})", "", *_table(["id", "severity", "summary"], rows)]
    counts = projection(report)["coverage"]
    out += ["## Coverage", "", ", ".join(f"{n} {escaped(s)}" for s, n in counts.items() if n) or "nothing was checked", ""]
    if advice := report.get("recommendations"):
        out += ["## Advice", "", *(f"{i}. {escaped(r['title'])} ({r['priority']})" for i, r in enumerate(advice, 1)), ""]
    if bundle := report.get("bundle"):
        out += ["## Advisories", "", f"- bundle: {escaped(bundle['version'])}", f"- digest: {escaped(bundle['digest'])}", ""]
    if include_observations and report.get("observations"):
        out += ["## Observations", "", *(f"- {escaped(k)}: {escaped(v)}" for k, v in sorted(report["observations"].items())), ""]
    return "\n".join(out) + "\n"


def terminal(report: dict, notes: int = 10, advice: tuple[int, int] = (5, 3), verbose: bool = True) -> str:
    """A short text: verdict, what is suspicious, errors by place, mandatory gaps, coverage and the most urgent advice;
    ``verbose``: also the first of the other findings and of the other advice."""
    found = in_order(report["findings"])
    pick = lambda *s: [f for f in found if f["status"] in s]
    out = [f"Verdict: {report['verdict']}"]
    out += [f"  ! {f['id']} [{f['severity']}] {f.get('summary') or ''}" for f in pick("suspicious")]
    for place in dict.fromkeys(f.get("path") or "" for f in pick("error")):
        out += [f"  errors in {place or 'the run'}:", *(f"    {f['id']} {f.get('summary') or ''}" for f in pick("error") if (f.get("path") or "") == place)]
    out += [f"  gap: {f['id']}" for f in pick("unchecked") if f["mandatory"]]
    rest = [f for f in pick("unchecked", "clean", "verified", "not_applicable") if f["status"] != "unchecked" or not f["mandatory"]] if verbose else []
    out += [f"  note: {f['id']}" for f in rest[:notes]] + ([f"  and {len(rest) - notes} more"] if len(rest) > notes else [])
    counts = projection(report)["coverage"]
    out.append("  " + ", ".join(f"{k} {v}" for k, v in counts.items() if v))
    urgent = [r for r in report.get("recommendations", []) if r["priority"] in ("critical", "high")]
    other = [r for r in report.get("recommendations", []) if r["priority"] not in ("critical", "high")] if verbose else []
    out += [f"  advice [{r['priority']}]: {r['title']}" for r in urgent[: advice[0]] + other[: advice[1]]]
    return "\n".join(out) + "\n"


def agent(report: dict) -> dict:
    """What a program that asked needs: verdict, a sentence, findings, facts."""
    bad = [f for f in report["findings"] if f["status"] == "suspicious"]
    said = f"Verdict: {report['verdict']}. " + (f"{len(bad)} suspicious finding(s). First: {bad[0]['id']} — {bad[0].get('summary') or ''}" if bad else "No suspicious findings.")
    return {k: report.get(k) for k in ("verdict", "exit_code", "artifacts", "runtimes", "findings", "bundle")} | {"summary": said}
