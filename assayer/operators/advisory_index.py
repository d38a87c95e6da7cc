"""Runtimes that advisories affect, for thousands of advisories and millions of runtimes.

The bounds of a component's advisories cut its versions into slots: those on a bound and those between two.  Whatever
versions fall into one slot, the same advisories affect.  Distinct versions and bounds are sorted together, in ranges, and
a running count of bounds gives each its slot.  An advisory covers a run of slots; it is filed under the few nodes of a
binary tree that make up that run, and a slot that runtimes are in looks under the nodes above it, so that advisories and
slots meet by equal keys and each pair that does is one that holds.  Work grows with runtimes, advisories and findings,
never with a product of them, and no task holds all bounds or all runtimes of a component.  Slots, advisories and runtimes
are sorted and merged: saved tables look small in their files, and the planner would send them through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import component, version_key
from assayer.tables import save

#: Levels of the tree: as many slots as two to their power.
LEVELS = 24
_SIDES = ("gt", "gte", "lt", "lte")


def sort_key(scheme: Column, build: Column, version: Column) -> Column:
    """A text that sorts as versions do: of a build its number, of a dotted version its numbers without zeros at the end,
    each as its digits after how many they are."""
    part = lambda n: F.concat(F.lpad(F.length(n.cast("string")).cast("string"), 2, "0"), n.cast("string"))
    numbers = F.array_join(F.transform(version_key(version), part), "")
    return F.when(scheme == "build", part(build)).otherwise(F.regexp_replace(numbers, "(?:010)+$", ""))


def slots(versions: DataFrame, bounds: DataFrame) -> DataFrame:
    """(own, by, key, slot) of distinct versions and bounds (own, by, key): twice the number of bounds below, and one more
    for a bound."""
    n = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = versions.distinct().withColumn("b", F.lit(0)).unionByName(bounds.distinct().withColumn("b", F.lit(1)))
    every = every.groupBy("own", "by", "key").agg(F.max("b").alias("b"))
    ranged = save(every.repartitionByRange(n, "own", "by", "key").withColumn("range", F.spark_partition_id()), "versions")
    counts = ranged.groupBy("own", "by", "range").agg(F.sum("b").alias("c"))  # a row a range and component
    before = F.sum("c").over(Window.partitionBy("own", "by").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("own").alias("o"), F.col("by").alias("y"), F.col("range").alias("r"), F.coalesce(before, F.lit(0)).alias("before"))
    ranged = ranged.join(counts, (F.col("own") == F.col("o")) & (F.col("by") == F.col("y")) & (F.col("range") == F.col("r")))
    below = F.sum("b").over(Window.partitionBy("own", "by", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.select("own", "by", "key", (2 * (F.col("before") + F.coalesce(below, F.lit(0))) + F.col("b")).alias("slot"))


def _nodes(low: Column, high: Column) -> Column:
    """The nodes of the tree that make up the slots from low to high: two a level at most."""
    long = lambda c: c.cast("long")
    none = F.array().cast("array<long>")
    start = F.struct(long(low + (1 << LEVELS)).alias("l"), long(high + (1 << LEVELS) + 1).alias("r"), none.alias("n"))

    def up(a: Column, _: Column) -> Column:
        left, right = a["l"] % 2, a["r"] % 2
        found = F.concat(a["n"], F.when(left == 1, F.array(a["l"])).otherwise(none), F.when(right == 1, F.array(a["r"] - 1)).otherwise(none))
        onward = F.struct(F.shiftright(a["l"] + left, 1).alias("l"), F.shiftright(a["r"] - right, 1).alias("r"), found.alias("n"))
        return F.when(a["l"] < a["r"], onward).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, up, lambda a: a["n"])


def _merged(df: DataFrame) -> DataFrame:
    return df.hint("merge")


def affected(runtimes: DataFrame, rules: DataFrame) -> DataFrame:
    """(runtime_id, advisory, severity, confidence): a row for each runtime (runtime_id, component, build, version,
    confidence, and has_template if rules that need one are to be judged) in an advisory's affected range.  Runtimes whose
    version is unknown have none.  Rules as those of ``advisories``."""
    kinds = rules.select(F.col("rule_component").alias("k"), F.col("scheme").alias("by")).distinct()
    extra = ["has_template"] if "has_template" in runtimes.columns else []
    named = runtimes.withColumn("own", component(F.col("component"))).join(kinds, F.col("own") == F.col("k"))
    placed = named.select("runtime_id", "confidence", *extra, "own", "by", sort_key(F.col("by"), F.col("build"), F.col("version")).alias("key")).where("key is not null")
    side = lambda s: F.col(f"affected.{s}")
    keyed = rules.select("advisory", F.col("rule_component").alias("c"), F.col("scheme").alias("s"), "needs_template", "rule_severity", "rule_confidence", *(sort_key(F.col("scheme"), side(s).cast("bigint"), side(s)).alias(s) for s in _SIDES))
    ends = keyed.select(F.col("c").alias("own"), F.col("s").alias("by"), F.explode(F.array(*_SIDES)).alias("key")).where("key is not null")
    known = save(slots(placed.select("own", "by", "key"), ends), "slots")
    if (known.agg(F.max("slot")).first()[0] or 0) >= 1 << LEVELS:
        raise ValueError(f"more than {1 << LEVELS - 1} bounds of a component")
    for s in _SIDES:
        # A side without a bound has a key of its own that meets none, so that such rules are dealt out.
        keyed = keyed.withColumn(s, F.coalesce(s, F.concat(F.lit("~"), F.xxhash64("advisory").cast("string"))))
        of = _merged(known).select(F.col("own").alias("o"), F.col("by").alias("y"), F.col("key").alias("x"), F.col("slot").alias(f"{s}_slot"))
        keyed = keyed.join(of, (F.col("c") == F.col("o")) & (F.col("s") == F.col("y")) & (F.col(s) == F.col("x")), "left").drop("o", "y", "x")
    low = F.coalesce(F.greatest(F.col("gt_slot") + 1, "gte_slot"), F.lit(0))
    high = F.coalesce(F.least(F.col("lt_slot") - 1, "lte_slot"), F.lit((1 << LEVELS) - 1))
    covers = keyed.withColumn("low", low).withColumn("high", high).where("low <= high")
    covers = covers.select("c", "s", "advisory", "needs_template", "rule_severity", "rule_confidence", F.explode(_nodes(F.col("low"), F.col("high"))).alias("node"))
    occupied = known.join(_merged(placed.select("own", "by", "key").distinct()), ["own", "by", "key"], "left_semi").select("own", "by", "slot").distinct()
    above = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.floor((F.col("slot") + (1 << LEVELS)) / F.pow(F.lit(2.0), k)).cast("long"))
    met = occupied.withColumn("above", F.explode(above)).join(_merged(covers), (F.col("own") == F.col("c")) & (F.col("by") == F.col("s")) & (F.col("above") == F.col("node")))
    met = met.select(F.col("own").alias("o"), F.col("by").alias("y"), F.col("slot").alias("at"), "advisory", "needs_template", "rule_severity", "rule_confidence")
    found = placed.join(_merged(known), ["own", "by", "key"]).join(_merged(met), (F.col("own") == F.col("o")) & (F.col("by") == F.col("y")) & (F.col("slot") == F.col("at")))
    if extra:
        found = found.where(~F.col("needs_template") | F.col("has_template"))
    rank = lambda c: F.when(c == "low", 0).when(c == "medium", 1).otherwise(2)
    least = F.when(rank(F.col("rule_confidence")) <= rank(F.col("confidence")), F.col("rule_confidence")).otherwise(F.col("confidence"))
    return found.select("runtime_id", "advisory", F.col("rule_severity").alias("severity"), least.alias("confidence"))
