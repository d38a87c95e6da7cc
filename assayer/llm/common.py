"""Shared plumbing: durable intermediate tables, balanced exchanges, connected components, remote files."""

from __future__ import annotations

import gc
import math
import os
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it is known to have at most so many rows.
BROADCAST_ROWS = 200_000
MOST_PARTS = 20_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  One is made up only where all tasks run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs whose results have been saved."""
    for _ in range(2):  # the first round lets go of what the second one finds unused
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def plan_bytes(df: DataFrame) -> int:
    """Size on storage of all that a plan reads, from file sizes; no job runs.  Estimates of joins, which Catalyst
    makes by multiplying, don't enter."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def parts(df: DataFrame, mb: float) -> int:
    """Partitions so that each holds about ``mb`` of the stored input: at least the session's default, and at most
    ``MOST_PARTS``, as more would cut exchanged runs into crumbs (operators then split partitions inside tasks)."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return max(least, min(MOST_PARTS, math.ceil(size / (mb * 1e6)))) if size < 1 << 60 else least


def prefix(df: DataFrame) -> str:
    """What no column of a table begins with: columns named after it clash with none."""
    p = "_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a saved table is small enough to broadcast; looks at ``rows`` + 1 rows at most."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def _murmur_int(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of an int column, as signed 32-bit integers."""
    with np.errstate(over="ignore"):
        u = np.uint32
        rot = lambda v, r: (v << u(r)) | (v >> u(32 - r))
        k = rot(x.astype(np.int32).view(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
        h = rot(k ^ u(seed), 13) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        return (h ^ (h >> u(16))).view(np.int32)


def partition_keys(n: int) -> np.ndarray:
    """For each of n partitions an int whose hash partition it is: repartition(n, key) then deals exactly evenly."""
    keys, start = np.full(n, -1, dtype=np.int32), 0
    while (keys < 0).any():
        x = np.arange(start, start + 16 * n, dtype=np.int32)
        p = np.mod(_murmur_int(x).astype(np.int64), n)
        first = np.unique(p, return_index=True)
        free = keys[first[0]] < 0
        keys[first[0][free]] = x[first[1][free]]
        start += 16 * n
    return keys


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: record batches for Python hold at most so many rows, unless the session says fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= rows:
        spark.conf.set(name, rows)


def batches(rows, schema: pa.Schema, most: int = 4096):
    """Rows (tuples) as record batches of bounded length."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def chunks(batch_iter, size_of, most: int):
    """Rows of record batches (as tuples of Python values) in lists of about ``most`` units of ``size_of``."""
    held, n = [], 0
    for b in batch_iter:
        for at in range(0, b.num_rows, 512):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 512).columns)):
                held.append(row)
                n += size_of(row)
                if n >= most:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def open_fs(uri: str):
    """A file system and a path in it, for files that executors write and read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Bits of a segment of ``maybe_among``, segments at most (32 MB of bits), bits that an id sets.
SEGMENT, MOST_SEGMENTS, PROBES = 1 << 16, 1 << 12, 4


def _places(ids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each id and the bits in it."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        more = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    bits = [((more >> np.uint64(16 * i)) % np.uint64(SEGMENT)).astype(np.int64) for i in range(PROBES)]
    return (h % np.uint64(segments)).astype(np.int64), np.stack(bits, axis=1) if len(ids) else np.zeros((0, PROBES), np.int64)


def maybe_among(ids: DataFrame, count: int):
    """A test (of an array) that all of the ``count`` ids of a table pass, and few others.  Tasks make bits, ten for each id
    and 32 MB at most; beyond, more others pass."""
    spark, name = ids.sparkSession, ids.columns[0]
    segments = max(1, min(MOST_SEGMENTS, math.ceil(10 * count / SEGMENT)))

    def deal(it):
        for b in it:
            own = np.asarray(b.column(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_places(own, segments)[0].astype(np.int32)), pa.array(own)], names=["segment", "id"])

    def mark(it):
        made: dict[int, np.ndarray] = {}
        for b in it:
            segment, at = _places(np.asarray(b.column("id")).astype(np.int64), segments)
            for s in np.unique(segment).tolist():
                made.setdefault(s, np.zeros(SEGMENT, bool))[at[segment == s].ravel()] = True
        yield from batches(((s, np.packbits(x).tobytes()) for s, x in made.items()), pa.schema([("segment", pa.int32()), ("bits", pa.binary())]), 64)

    dealt = ids.select(F.col(name).cast("long").alias("id")).mapInArrow(deal, "segment int, id long").repartition("segment")
    bits = np.zeros((segments, SEGMENT // 8), np.uint8)
    for s, x in dealt.mapInArrow(mark, "segment int, bits binary").collect():
        bits[s] = np.frombuffer(x, np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    def among(own: np.ndarray) -> np.ndarray:
        segment, at = _places(own, segments)
        held = sent.value[segment[:, None], at >> 3]
        return ((held >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)

    return among


def _forest(it):
    """Spanning stars of the edges (u, v) of a task: every end but a group's least, with the least."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in it:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    yield from batches(((x, find(x)) for x in list(root) if find(x) != x), pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges.  Tasks of ``BROADCAST_ROWS`` edges first replace theirs by spanning stars;
    if that took more than one task, alternating large-star and small-star steps follow until nothing changes.  Returns
    (id, component_id), the smallest id reachable, for every id that has an edge to another; null ends and loops are
    ignored.  Joins are on columns that were dealt anew, so that Spark can split hubs."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    e = save(e, "edges")
    tasks = math.ceil(e.count() / BROADCAST_ROWS)
    e = save(e.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long"), "stars")
    last = None
    while tasks > 1:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == last:
            break
        last = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + 0).alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + 0).alias("w"), "m")
        hop = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = save(hop.union(least.select("w", "m").toDF("u", "v")).distinct(), "small")
    own = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(own)
