"""Digests of files, and what they say against an expected one."""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import digest_ok
from assayer.sources import places
from assayer.tables import save

CHUNK = 1 << 20
#: Partitions at most; what is dealt: large files a partition at most, buckets of other files a partition; what opening a
#: file costs, in bytes.
MOST_PARTS, LARGE, BUCKETS, FILE_COST = 4096, 16, 64, 4096


def sized(files: DataFrame, path_col: str = "path", opener: str | None = None) -> DataFrame:
    """(path, size) of files; tasks look, null for what is no file."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64())])

    def run(it):
        for b in it:
            paths = b.column(0).to_pylist()
            found = [places.place(p, opener).look(p).size if p is not None else None for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.int64())], schema=schema)

    return files.select(F.col(path_col).alias("path")).mapInArrow(run, "path string, size long")


def dealt_by_size(files: DataFrame, parts: int) -> DataFrame:
    """Files (path, size) in ``parts`` partitions of bytes as equal as whole files allow.  Files that alone make up a
    notable share of a partition, ``LARGE`` times the partitions at most, and all others by ``BUCKETS`` buckets a partition
    are what is dealt: the longest first, each to the partition with the least so far.  The driver holds these only."""
    spark, parts = files.sparkSession, min(parts, MOST_PARTS)
    files = save(files, "sized")
    total = files.agg(F.sum(F.coalesce("size", F.lit(0)).cast("decimal(38,0)"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS * parts)).cast("int")
    files = files.withColumn("_bucket", F.when(F.coalesce("size", F.lit(0)) <= int(total) // (LARGE * parts), bucket))
    large = files.where("_bucket is null").select("path", "size").distinct().collect()
    small = files.where("_bucket is not null").groupBy("_bucket").agg(F.sum(F.coalesce("size", F.lit(0)) + FILE_COST).alias("size")).collect()
    heap = [(0, i) for i in range(parts)]
    where: list[tuple[int | None, str | None, int]] = []
    for size, _, item in sorted(((r["size"], str(r[0]), r) for r in large + small), key=lambda x: x[:2], reverse=True):
        held, part = heapq.heappop(heap)
        where.append((item["_bucket"], None, part) if "_bucket" in item else (None, item["path"], part))
        heapq.heappush(heap, (held + size, part))
    deal = F.broadcast(spark.createDataFrame(where, "b int, p string, part int"))  # (BUCKETS + LARGE) * parts rows
    key = F.coalesce(F.col("_bucket").cast("string"), F.concat(F.lit("/"), F.col("path")))
    same = key == F.coalesce(F.col("b").cast("string"), F.concat(F.lit("/"), F.col("p")))
    return files.join(deal, same, "left").repartitionById(parts, F.coalesce("part", F.lit(0))).select("path", "size")


def file_digests(files: DataFrame, path_col: str = "path", opener: str | None = None, parts: int | None = None) -> DataFrame:
    """(path, digest, bytes_read, error): each file is read once, a chunk at a time, in a task.  Files, whose digest can't
    be split, are dealt to tasks by size (``parts``: how many, the session's parallelism if not given); a path that
    repeats is read as often."""
    schema = pa.schema([("path", pa.string()), ("digest", pa.string()), ("bytes_read", pa.int64()), ("error", pa.string())])

    def run(it):
        for b in it:
            rows = []
            for path in b.column(0).to_pylist():
                own, n = hashlib.sha256(), 0
                try:
                    if path is None:
                        raise OSError("no path")
                    with places.place(path, opener).open(path) as f:
                        while chunk := f.read(CHUNK):
                            own.update(chunk)
                            n += len(chunk)
                    rows.append((path, own.hexdigest(), n, None))
                except OSError as e:
                    rows.append((path, None, n, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    dealt = dealt_by_size(sized(files, path_col, opener), parts or files.sparkSession.sparkContext.defaultParallelism)
    return dealt.select("path").mapInArrow(run, "path string, digest string, bytes_read long, error string")


def expectation(text: Column) -> Column:
    """An expected digest in lower case; anything but 64 hexadecimal digits is an error of its caller."""
    return F.when(text.isNull(), F.lit(None).cast("string")).when(digest_ok(text), F.lower(text)).otherwise(F.raise_error(F.lit("expected digest must be 64 hexadecimal digits")))


def digest_findings(rows: DataFrame, keep: list[str], digest: str = "digest", expected: str = "expected") -> DataFrame:
    """id, status, severity and mandatory for each digest: none expected, the same, or another one."""
    same = F.col(digest) == expectation(F.col(expected))
    kind = F.when(F.col(expected).isNull(), "digest_absent").when(same, "digest_match").otherwise("digest_mismatch")
    status = F.when(kind == "digest_absent", "unchecked").when(kind == "digest_match", "verified").otherwise("suspicious")
    return rows.select(*keep, F.concat(F.lit("identity."), kind).alias("id"), status.alias("status"), F.when(status == "suspicious", "high").otherwise("info").alias("severity"), (status != "unchecked").alias("mandatory"))
