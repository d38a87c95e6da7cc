"""Reports for people: every section of a report, and what parse errors mean."""

from pyspark.sql import functions as F

from assayer.functions import companion, scalars
from assayer.operators import reports


def finding(i, status, **more):
    return {"path": f"/m/a|{i}", "id": f"x.{i}", "check": "gguf_structure", "status": status, "severity": "high", "classification": "medium", "mandatory": status != "clean", "summary": f"said *{i}*"} | more


REPORT = {
    "verdict": "not_suitable", "exit_code": 2, "artifacts": [{"path": "/m/a", "name": "A_b", "architecture": "llama", "gguf_version": 3, "tensor_count": 0, "has_chat_template": True}],
    "runtimes": [{"component": "llama.cpp", "build": 12, "version": None, "commit": None, "method": "nearby_build_file", "confidence": "high"}],
    "findings": [finding(1, "suspicious"), finding(2, "error", summary="truncated: file is truncated at byte 9"), finding(3, "unchecked"), finding(4, "clean"), finding(5, "unchecked", mandatory=False), *(finding(i, "clean") for i in range(10, 25))],
    "recommendations": [{"priority": p, "title": f"{p} {i}", "category": "c"} for p in ("critical", "high", "medium", "low") for i in range(4)],
    "bundle": {"version": "2026.1", "digest": "ab" * 32}, "observations": {"seconds": {"scan": 1.5}},
}


def test_markdown_has_every_section():
    text = reports.markdown(REPORT)
    for heading in ("# Verdict: not\\_suitable", "## Artifacts", "## Runtimes", "## Suspicious (1)", "## Errors (1)", "## Not checked (1)", "## notes (1)", "## clean (16)", "## Coverage", "## Advice", "## Advisories"):
        assert heading in text, heading
    assert "| A\\_b | /m/a | llama | 3 | 0 | yes |" in text and "| llama.cpp | build 12 | nearby\\_build\\_file | high |" in text
    assert "said \\*1\\*" in text and "/m/a\\|1" in text and "The header announces more than the file holds." in text and "16 clean" in text
    assert "## Observations" not in text and "scan" in reports.markdown(REPORT, True)
    little = reports.markdown({"verdict": "clean", "exit_code": 0, "findings": [], "artifacts": []})
    assert "nothing was checked" in little and "##" in little and "## Artifacts" not in little


def test_the_terminal_shows_urgent_advice_first():
    lines = reports.terminal(REPORT).splitlines()
    advice = [x for x in lines if "advice" in x]
    assert [x.split("]")[0].split("[")[1] for x in advice] == ["critical"] * 4 + ["high"] + ["medium"] * 3
    assert sum("note:" in x for x in lines) == 10 and "  and 7 more" in lines
    quiet = reports.terminal(REPORT, verbose=False)
    assert "note:" not in quiet and quiet.count("advice") == 5


def test_explanations_of_errors(spark):
    messages = ["a zero-sized dimension, truncated", "Truncated", "bad MAGIC", "version 9", "duplicate key", "byte budget", "limit", "alignment 3", "ranges overlap", "not UTF-8", "else", ""]
    rows = spark.createDataFrame([(m,) for m in messages], "m string").select("m", scalars.error_explanation(F.col("m")).alias("e"), scalars.error_origin(F.col("m")).alias("o")).collect()
    assert [r.o for r in rows] == ["zero_dimension", "truncated", "magic", "version", "duplicate", "limit", "limit", "alignment", "overlap", "encoding", "other", "other"]
    for r in rows:
        assert tuple(r.e) == scalars.explained(r.m) and r.e.origin == r.o and len(r.e.explanation) > 20 and len(r.e.cause) > 20


def test_snippets_begin_at_each_address(spark):
    long = "https://" + "z" * 600
    texts = {"a": [], "plain\u0001text": [], "x https://a b hf://c,\" ": ["https://a b hf://c", "hf://c"], f"{long}\nhttp://b": [long[:512], "http://b"], "\u0001https://a\u0001": ["https://a\u0001"], "see HuggingFace.co/x": ["HuggingFace.co/x"], "https://https://": ["https://https://", "https://"]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", companion.remote_snippets(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == texts
