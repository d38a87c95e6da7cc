"""Centroid clustering by Lloyd's rounds with Drake's adaptive bounds, in whole numbers.

Every vector keeps an upper bound of the distance to its centroid, lower bounds of the distances to its next nearest ones
and one lower bound for all the rest.  When centroids move, bounds move by as much.  A vector whose upper bound is below
all its lower bounds stays without a look at it.  Else its distances to its own centroid and to those near ones that the
upper bound reaches are taken exactly; if the best of them is below the bound of the rest, the order is certain; if not,
all centroids are scanned.  A block of vectors keeps as many near bounds as it needed in the last round.

Vectors lie in blocks, dealt by block once; the bounds of each round are dealt alike, so the join of both moves nothing.
A task hands on what vectors that changed their centroid add to and take from sums, and Spark adds that up: centroids are
the exact floors of sum by count.  Results don't depend on bounds, which only decide what is looked at.

Vectors of another number of components, null ones and those with a null or non-finite component are left out.  A null id
is clustered like any other, but comes last as a starting centroid; ids that repeat are rows of their own, and of equal
hashes the lesser vector starts first.  With fewer vectors than centroids there are as many centroids as vectors.  A
component of 2**40 or more is refused with an error; distances and inertias beyond a long are null.  An empty table gives
no rows; texts and labels and other columns don't enter, whatever their names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import blocks, common

#: Room for rounding in bounds: relative and absolute.
_SLACK, _LEAST = 1e-9, 1e-6


def _below(u: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether u is below low beyond doubt."""
    return u * (1 + _SLACK) + _LEAST < low


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def scan(x: np.ndarray, c: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """near: the nearest centroid (ties: smaller number) and the ``width`` next ones; bound: their distances and that of
    the nearest of the rest."""
    d = blocks.squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")[:, : width + 2]
    bound = np.full((len(x), width + 2), np.inf)
    bound[:, : order.shape[1]] = _root(np.take_along_axis(d, order, axis=1))
    return order[:, : width + 1].astype(np.int32), bound


def advance(x: np.ndarray, c: np.ndarray, move: np.ndarray, near: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """near and bound after centroids moved by ``move`` to c, with one near bound a vector for each that it needed at
    most; and how many vectors were scanned anew."""
    k, width, rows = len(c), near.shape[1] - 1, np.arange(len(x))
    near, bound = near.copy(), bound.copy()
    bound[:, 0] += move[near[:, 0]]
    bound[:, 1:-1] -= move[near[:, 1:]]
    bound[:, -1] -= move.max()
    look = rows[~_below(bound[:, 0], bound[:, 1:].min(axis=1))]
    own = ((x[look] - c[near[look, 0]]) ** 2).sum(axis=1)
    bound[look, 0] = _root(own)
    doubt = ~_below(bound[look, 0], bound[look, 1:].min(axis=1))
    look, own = look[doubt], own[doubt]
    reached = ~_below(bound[look, :1], bound[look, 1:-1])
    d = np.full((len(look), width + 1), np.inf, dtype=x.dtype)
    d[:, 0] = own
    i, j = np.nonzero(reached)
    d[i, j + 1] = ((x[look[i]] - c[near[look[i], j + 1]]) ** 2).sum(axis=1)
    best = d.min(axis=1) if len(look) else own
    number = np.where(d == best[:, None], near[look], k).min(axis=1) if len(look) else np.zeros(0, np.int32)
    bound[look[i], j + 1] = _root(d[i, j + 1])
    slot = np.argmax((near[look] == number[:, None]) & (d == best[:, None]), axis=1) if len(look) else np.zeros(0, np.int64)
    swap = np.flatnonzero(slot)
    to = look[swap]
    near[to, slot[swap]], bound[to, slot[swap]] = near[to, 0], bound[to, 0]
    near[look, 0], bound[look, 0] = number, _root(best)
    needed = int(reached.sum(axis=1).max()) if len(look) else 0
    again = look[~_below(bound[look, 0], bound[look, -1])]
    if len(again):
        near[again], bound[again] = scan(x[again], c, width)
    keep = min(width, max(1, -(-k // 8), needed))
    if keep < width:  # the least bounds stay, the others go into the one of the rest
        order = np.argsort(bound[:, 1:-1], axis=1, kind="stable") + 1
        rest = np.minimum(bound[:, -1], np.take_along_axis(bound, order[:, keep:], axis=1).min(axis=1))
        near = np.concatenate([near[:, :1], np.take_along_axis(near, order[:, :keep], axis=1)], axis=1)
        bound = np.concatenate([bound[:, :1], np.take_along_axis(bound, order[:, :keep], axis=1), rest[:, None]], axis=1)
    return near, bound, len(again)


def _change(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> bytes | None:
    """What sums and counts of clusters gain and lose (k rows, components and count)."""
    if before is None:
        before, moved = np.full(len(x), -1), np.arange(len(x))
    else:
        moved = np.flatnonzero(before != after)
    if not len(moved):
        return None
    one = np.concatenate([x[moved], np.ones((len(moved), 1), np.int64)], axis=1)
    total = np.zeros((k, one.shape[1]), np.int64)
    np.add.at(total, after[moved], one)
    was = before[moved] >= 0
    np.subtract.at(total, before[moved][was], one[was])
    return total.tobytes()


def _totals(state: DataFrame, k: int, size: int) -> np.ndarray:
    """The sum of all changes, as Python's integers."""
    schema = pa.schema([("c", pa.int32()), ("j", pa.int32()), ("v", pa.int64())])

    def run(it):
        total = np.zeros((k, size + 1), np.int64)
        rows = lambda t: [(int(a), int(b), int(t[a, b])) for a, b in zip(*np.nonzero(t))]
        for b in it:
            for x in b.column(0).to_pylist():
                total = total + np.frombuffer(x, np.int64).reshape(k, size + 1)
                if np.abs(total).max() >= 1 << 61:
                    yield from common.batches(rows(total), schema)
                    total = np.zeros((k, size + 1), np.int64)
        yield from common.batches(rows(total), schema)

    found = state.where("change is not null").select("change").mapInArrow(run, "c int, j int, v long")
    out = np.zeros((k, size + 1), dtype=object)
    for c, j, v in found.groupBy("c", "j").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect():  # k * (size + 1) at most
        out[c, j] = int(v)
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("v") == size) & sound)
    chosen = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = blocks.whole(np.array([r["v"] for r in chosen], np.float64).reshape(len(chosen), size))
    k = max(1, len(chosen))
    common.bound_batches(spark, blocks.BLOCK)

    def gather(it):
        for number, t in blocks.block_rows(it, blocks.partition_number()):
            ids = pa.array([t.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([blocks.pack(blocks.whole(blocks.matrix(t.column(1))))])], names=["block", "ids", "x"])

    dealt = blocks.Dealt(spark, "block", common.parts(df, 32))
    vectors = dealt.save(rows.mapInArrow(gather, "block long, ids array<long>, x binary"), "vectors", dealt=False)
    state, sums = None, np.zeros((k, size + 1), dtype=object)
    schema = pa.schema([("block", pa.int64()), ("width", pa.int32()), ("near", pa.binary()), ("bound", pa.binary()), ("change", pa.binary())])
    width = min(max(2, k // 4), k - 1)

    def held(data, w, count):
        return np.frombuffer(data[0], np.int32).reshape(count, w + 1), np.frombuffer(data[1], np.float64).reshape(count, w + 2)

    def step(now, move):
        shared = spark.sparkContext.broadcast((now, move))

        def assign(it):
            now, move = shared.value
            for b in it:
                for r in b.to_pylist():
                    whole = blocks.unpack(r["x"], size)
                    x, c = blocks.exact(whole, now)
                    if move is None:
                        before, (near, bound) = None, scan(x, c, width)
                    else:
                        near, bound = held((r["near"], r["bound"]), r["width"], len(x))
                        before = near[:, 0]
                        near, bound, _ = advance(x, c, move, near, bound)
                    after = np.ascontiguousarray(near[:, 0])
                    row = (r["block"], near.shape[1] - 1, np.ascontiguousarray(near).tobytes(), np.ascontiguousarray(bound).tobytes(), _change(whole, before, after, k))
                    yield from common.batches([row], schema)

        given = vectors.select("block", "x") if state is None else vectors.select("block", "x").join(state.select("block", "width", "near", "bound"), "block")
        return dealt.save(given.mapInArrow(assign, "block long, width int, near binary, bound binary, change binary"), "bounds")

    move = None
    for _ in range(rounds):
        state = step(centroids, move)
        sums = sums + _totals(state, k, size)
        last, centroids = centroids, centroids.copy()
        for i in range(len(chosen)):
            if sums[i, size]:
                centroids[i] = [int(s) // int(sums[i, size]) for s in sums[i, :size]]
        a, b = blocks.exact(last, centroids)
        move = _root(((a - b) ** 2).sum(axis=1)) if len(chosen) else np.zeros(k)
    if chosen:
        state = step(centroids, move)

    def results(it):
        out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
        for b in it:
            for r in b.to_pylist():
                x, c = blocks.exact(blocks.unpack(r["x"], size), centroids)
                near = held((r["near"], r["bound"]), r["width"], len(x))[0][:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((r["ids"], near.tolist(), blocks.as_long(((x - c[near]) ** 2).sum(axis=1))), out.types)], schema=out)

    done = vectors.join(state.select("block", "width", "near", "bound"), "block") if state is not None else vectors.selectExpr("*", "0 AS width", "x AS near", "x AS bound")
    done = common.save(done.mapInArrow(results, "vec_id long, cluster int, distance long"), "clusters")
    dealt.forget()
    inertia = {r[0]: None if r[2] else int(r[1]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")), F.max(F.col("distance").isNull())).collect()}  # k rows
    total = None if None in inertia.values() else sum(inertia.values())
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(i, fits(v), fits(total), digest[i]) for i, v in inertia.items()], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), F.col("cluster") == F.col("c")).drop("c")


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64) -> str:
    """Every distance of every round."""
    steps = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
  embedding AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS c, v AS m FROM kept ORDER BY sha256('{seed}:' || vec_id), e LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT best.c AS c, j, sum(x) AS s, count(*) AS n FROM (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept) JOIN a{i} USING (r) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(f, m) AS m FROM c{i} LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS f FROM s{i} GROUP BY c) USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c = best.c"""


ORACLE_CENTROIDS = oracle()
