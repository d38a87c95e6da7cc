"""Rules of a bundle against facts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields of a predicate that are no metadata keys.
BUILT_IN = ("format", "architecture", "name", "has_chat_template", "file_type")
# End of fixed values.


def intervals_overlap(a: Column, b: Column) -> Column:
    """Whether bounds (maps of gt, gte, lt, lte to whole numbers) share a whole number."""

    def ends(x: Column) -> tuple[Column, Column]:
        at = lambda k: F.try_element_at(x, F.lit(k)).cast("bigint")
        return F.coalesce(at("gt") + 1, at("gte"), F.lit(0)), F.coalesce(at("lt") - 1, at("lte"))

    (p, q), (r, s) = ends(a), ends(b)
    last = F.least(q, s)  # a missing end is no bound
    return F.coalesce(F.greatest(p, r) <= last, F.lit(True))


def field(name: Column, facts: dict[str, Column], metadata: Column) -> Column:
    """The value, as JSON, of a predicate's field: by its first part alone, a fact or a metadata key."""
    first = F.substring_index(name, ".", 1)
    out = F.try_element_at(metadata, first)
    for k in BUILT_IN:
        out = F.when(first == k, facts[k]).otherwise(out)
    return out


def predicates_hold(predicates: Column, facts: dict[str, Column], metadata: Column) -> Column:
    """Whether all predicates hold; null equals null."""

    def holds(p: Column) -> Column:
        value = field(p["field"], facts, metadata)
        return F.when(p["operator"] == "present", value.isNotNull()).when(p["operator"] == "equals", F.coalesce(value, F.lit("null")).eqNullSafe(p["value"])).otherwise(F.lit(False))

    return F.forall(predicates, holds)


def list_faults(rules: DataFrame, by: list[str], ident: str, order: str) -> DataFrame:
    """(by, rows, distinct_ids, out_of_order) of lists of advisories."""
    previous = F.lag(ident).over(Window.partitionBy(*by).orderBy(order))
    rows = rules.withColumn("_late", previous >= F.col(ident))
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(ident).alias("distinct_ids"), F.count_if("_late").alias("out_of_order"))


def days_left(expires: Column, today: Column) -> Column:
    """expired, soon (under thirty days) or valid."""
    left = F.datediff(expires, today)
    return F.when(left <= 0, "expired").when(left < 30, "soon").otherwise("valid")
