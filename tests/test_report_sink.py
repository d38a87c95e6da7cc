"""Documents written by tasks are those that one run's report gives, and nothing is left by a job that fails."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import reports
from assayer.sources import report_sink

FIELDS = ["path", "id", "check", "status", "severity", "classification", "mandatory", "summary"]


def finding(i):
    status = ("suspicious", "error", "clean", "unchecked", "verified", "not_applicable")[i % 6]
    return {"path": f"/m/{i % 4}" if i % 5 else None, "id": f"rule.{i * 7 % 23}", "check": "companion_config", "status": status, "severity": ("critical", "high", "medium", "low", "info", "odd")[i % 6 - i % 2], "classification": "high", "mandatory": i % 2 == 0, "summary": [None, "", 'a "quoted"\n日本 text \\ end', "x"][i % 4]}


def report(n):
    return {"verdict": "not_suitable", "exit_code": 2, "findings": [finding(i) for i in range(n)], "artifacts": [{"path": "/m/1", "name": "ä"}, {"path": "/m/2", "name": None}][: n and 2], "runtimes": [], "recommendations": [], "bundle": None}


def table(spark, r):
    rows = [(*(f[k] for k in FIELDS), i) for i, f in enumerate(r["findings"])]
    return spark.createDataFrame(rows, "path string, id string, check string, status string, severity string, classification string, mandatory boolean, summary string, seq long")


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_the_same_json_as_a_report_held_whole(spark, tmp_path, n):
    r = report(n)
    target = f"{tmp_path}/out.json"
    for parts in (1, 5):
        reports.write_json(table(spark, r), r, target, parts=parts)
        assert open(target, encoding="utf-8").read() == reports.canonical(reports.projection(r))
    assert os.listdir(tmp_path) == ["out.json"]


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_the_same_sarif_as_a_report_held_whole(spark, tmp_path, n):
    r = report(n)
    artifacts = spark.createDataFrame([(a["path"], i) for i, a in enumerate(r["artifacts"])], "path string, seq long")
    reports.write_sarif(table(spark, r), artifacts, r, f"{tmp_path}/out.sarif", parts=4)
    assert open(tmp_path / "out.sarif", encoding="utf-8").read() == reports.canonical(reports.sarif(r))
    assert os.listdir(tmp_path) == ["out.sarif"]


def test_a_task_that_fails_leaves_the_old_document_and_nothing_else(spark, tmp_path):
    r = report(50)
    target = f"{tmp_path}/out.json"
    open(target, "w").write("old")
    rows = table(spark, r).select(F.lit("findings").alias("section"), F.when(F.col("seq") == 40, F.raise_error(F.lit("no item"))).otherwise(F.lit("{}")).alias("item"), "seq")
    with pytest.raises(Exception, match="no item"):
        report_sink.write_report(rows, {"findings": "@findings"}, target, "seq", parts=3)
    assert os.listdir(tmp_path) == ["out.json"] and open(target).read() == "old"
    with pytest.raises(Exception, match="no list"):
        report_sink.write_report(rows.where("seq < 9").withColumn("section", F.lit("other")), {"findings": "@findings"}, target, "seq")
    assert os.listdir(tmp_path) == ["out.json"] and open(target).read() == "old"


def test_a_million_findings(spark, tmp_path):
    n = 1_000_000
    i = F.col("seq")
    rows = spark.range(n).withColumnRenamed("id", "seq").select(F.concat(F.lit("/m/"), i % 100).alias("path"), F.concat(F.lit("rule."), F.lpad((i * 7919 % n).cast("string"), 7, "0")).alias("id"), F.lit("c").alias("check"), F.when(i % 2 == 0, "clean").otherwise("suspicious").alias("status"), F.lit("high").alias("severity"), F.lit("high").alias("classification"), F.lit(True).alias("mandatory"), F.lit("what was found").alias("summary"), "seq")
    began = time.time()
    reports.write_json(rows, {"verdict": "not_suitable", "exit_code": 2, "artifacts": []}, f"{tmp_path}/out.json", parts=16)
    assert time.time() - began < 240
    got = json.load(open(tmp_path / "out.json"))
    assert len(got["findings"]) == n and [f["id"] for f in got["findings"]] == [f"rule.{k:07}" for k in range(n)]
    assert got["coverage"]["suspicious"] == n // 2 and got["coverage"]["total"] == n
    os.unlink(tmp_path / "out.json")  # it is large
