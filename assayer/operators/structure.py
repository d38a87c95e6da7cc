"""Checks of tensors, digests, companions and siblings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Companion files: bytes of one, and of all that are read in a folder.
FILE_BYTES, TOTAL_BYTES = 2 << 20, 8 << 20


def overlaps(tensors: DataFrame, by: list[str], start: str, end: str, name: str) -> DataFrame:
    """Tensors that begin before the one before them ends (half-open ranges, ordered by start, end and name)."""
    w = Window.partitionBy(*by).orderBy(start, end, name)
    return tensors.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))


def coherence(artifacts: DataFrame, manifests: DataFrame, on: str) -> DataFrame:
    """(on, artifact_id, attribute, matches) for each attribute that both an artifact and a manifest of its folder declare."""
    both = artifacts.join(manifests, on)
    rows = F.array(*(F.struct(F.lit(a).alias("attribute"), F.lower(F.col(a)) .alias("x") if a == "sha256" else F.col(a).alias("x"), (F.lower(F.col(f"declared_{a}")) if a == "sha256" else F.col(f"declared_{a}")).alias("y")) for a in ("sha256", "architecture", "name")))
    out = both.select(on, "artifact_id", F.explode(rows).alias("r")).where("r.x <> '' and r.y <> ''")
    return out.select(on, "artifact_id", "r.attribute", (F.col("r.x") == F.col("r.y")).alias("matches"))


def sibling_mismatch(artifacts: DataFrame, by: str, order: str, template: str, most: int = 10) -> DataFrame:
    """Among a folder's first ``most`` artifacts, those whose template differs from the first one's (empty ones don't count)."""
    w = Window.partitionBy(by).orderBy(order)
    first = artifacts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where(F.col(template) != "")
    return first.withColumn("_first", F.first(template).over(w)).where(F.col(template) != F.col("_first")).drop("_n", "_first")


def running_total(rows: DataFrame, by: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Every row with ``running``, its group's total up to it, and ``fits``, whether that keeps to ``most``.  Which files are
    read under a total is another rule: ``read_within``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).withColumn("fits", F.col("running") <= most)


def read_within(rows: DataFrame, by: list[str], order: list[str], size: str, most_file: int = FILE_BYTES, most_total: int = TOTAL_BYTES) -> DataFrame:
    """Every row with status (read or skipped), reason, and bytes_read, the group's total after it.  In order, a file is
    skipped if it is over ``most_file`` or would take the total over ``most_total``; only files read add to the total,
    so later ones that fit are read.  Each row depends on those before it, so a group is one task's, in constant memory;
    ``order`` must be total within a group."""
    most = {"file": f"file exceeds the {most_file}-byte limit", "total": f"total inspection would exceed the {most_total}-byte limit"}

    def run(it):
        group, total = None, 0
        for b in it:
            status, reason, running = [], [], []
            for *key, n in zip(*(b.column(c).to_pylist() for c in [*by, size])):
                if key != group:
                    group, total = key, 0
                why = "size unknown" if n is None else most["file"] if n > most_file else most["total"] if total + n > most_total else None
                total += 0 if why else n
                status.append("skipped" if why else "read")
                reason.append(why)
                running.append(total)
            more = {"status": pa.array(status, pa.string()), "reason": pa.array(reason, pa.string()), "bytes_read": pa.array(running, pa.int64())}
            yield pa.RecordBatch.from_arrays([*b.columns, *more.values()], names=[*b.schema.names, *more])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "status string", "reason string", "bytes_read long"])
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, fields)


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Occurrence numbers from 0 within each kind."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def confusion(rows: DataFrame, expected: str, detected: str, by: list[str]) -> DataFrame:
    e, d = F.col(expected), F.col(detected)
    return rows.groupBy(*by).agg(F.count_if(e & d).alias("tp"), F.count_if(~e & ~d).alias("tn"), F.count_if(~e & d).alias("fp"), F.count_if(e & ~d).alias("fn"))
