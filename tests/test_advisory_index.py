"""Advisories met by slots and tree nodes: the same rows as every rule tried on every runtime, and no product of both."""

import random
import time

from pyspark.sql import functions as F

from assayer.operators import advisories, advisory_index

RANGE = "struct<gt:string,gte:string,lt:string,lte:string>"
RULES = f"advisory string, rule_component string, scheme string, affected {RANGE}, fixed {RANGE}, needs_template boolean, rule_severity string, rule_confidence string"
RUNTIMES = "runtime_id long, component string, build long, version string, confidence string, has_template boolean"


def plain(spark, runtimes, rules):
    """Every rule of a component on every runtime."""
    facts = spark.createDataFrame([(True,), (False,)], "has_template boolean")
    judged = advisories.judgements(facts, runtimes.withColumnRenamed("has_template", "own_template"), rules).where("status = 'suspicious'")
    own = runtimes.select("runtime_id", F.col("has_template").alias("t")).distinct()
    return judged.join(own, "runtime_id").where("has_template = t").select("runtime_id", "advisory", "severity", "confidence")


def version(rng):
    return rng.choice(["", "v"]) + ".".join(str(rng.randrange(4)) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".0", ".0.0", "-rc1", "b"])


def some_rules(rng, n):
    out = []
    for i in range(n):
        name, scheme = rng.choice([("llama.cpp", "build"), ("llama.cpp", "build"), ("ollama", "semver"), ("sglang", "semver"), ("sglang", "build")])
        bound = (lambda: str(rng.randrange(60))) if scheme == "build" else (lambda: version(rng))
        a = {"gt": None, "gte": None, "lt": None, "lte": None}
        for side in rng.sample(list(a), rng.randint(0, 3)):
            a[side] = bound()
        out.append((f"A-{i}", name, scheme, a, {}, rng.random() < 0.3, rng.choice(["high", "critical"]), rng.choice(["low", "medium", "high"])))
    return out


def some_runtimes(rng, n):
    return [(i, rng.choice(["llama-cli", "LLAMA.CPP", "ollama", " sglang", "other", None]), rng.choice([None, rng.randrange(62)]), rng.choice([None, version(rng), "", "x"]), rng.choice(["low", "medium", "high"]), rng.random() < 0.5) for i in range(n)]


def test_the_same_rows_as_every_rule_on_every_runtime(spark):
    for seed, n in ((1, 300), (2, 7), (3, 0)):
        rng = random.Random(seed)
        rules, runtimes = spark.createDataFrame(some_rules(rng, n), RULES), spark.createDataFrame(some_runtimes(rng, 400), RUNTIMES)
        got = sorted(map(tuple, advisory_index.affected(runtimes, rules).collect()))
        assert got == sorted(map(tuple, plain(spark, runtimes, rules).collect())) and (n < 10 or len(got) > 1000)


def test_the_built_in_advisories(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["llama-server", "ollama", "sglang", "llama-cpp-python"]), rng.randrange(9500), f"0.{rng.randrange(18)}.{rng.randrange(75)}", "high", i % 2 == 0) for i in range(500)]
    runtimes, rules = spark.createDataFrame(rows, RUNTIMES), advisories.advisories(spark)
    assert sorted(map(tuple, advisory_index.affected(runtimes, rules).collect())) == sorted(map(tuple, plain(spark, runtimes, rules).collect()))


def test_ten_thousand_rules_and_a_million_runtimes(spark):
    n = F.col("id")
    at = n * 7919 % 1_000_000
    text = lambda c: c.cast("string")
    affected = F.struct(F.lit(None).cast("string").alias("gt"), text(at).alias("gte"), F.lit(None).cast("string").alias("lt"), text(at + 30).alias("lte"))
    rules = spark.range(10_000).select(F.concat(F.lit("A-"), text(n)).alias("advisory"), F.when(n >= 0, "llama.cpp").otherwise("x").alias("rule_component"), F.lit("build").alias("scheme"), affected.alias("affected"), affected.alias("fixed"), F.lit(False).alias("needs_template"), F.lit("high").alias("rule_severity"), F.lit("high").alias("rule_confidence"))
    runtimes = spark.range(1_000_000).select(n.alias("runtime_id"), F.when(n % 2 == 0, "llama-cli").otherwise("llama-server").alias("component"), (n * 31 % 1_000_000).alias("build"), F.lit(None).cast("string").alias("version"), F.lit("high").alias("confidence"))
    began = time.time()
    found = advisory_index.affected(runtimes, rules)
    rows = found.count()
    assert time.time() - began < 180
    starts = {i * 7919 % 1_000_000 for i in range(10_000)}
    assert rows == sum(len(range(s, min(s + 30, 999_999) + 1)) for s in starts)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_slots_and_findings_are_not_broadcast(spark):
    """Saved tables of slots are small in their files, but not in the driver's memory."""
    rng = random.Random(6)
    found = advisory_index.affected(spark.createDataFrame(some_runtimes(rng, 400), RUNTIMES), spark.createDataFrame(some_rules(rng, 100), RULES))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and any(f"{c}#" in line for c in ("key", "slot", "at", "x", "node"))]
