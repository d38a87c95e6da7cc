"""Vector code compression: codebooks of vector parts by filtering Lloyd's rounds, in whole numbers.

Vectors lie in blocks of rows.  For each block and part position a kd-tree is built once over the block's parts: parts in
tree order, and of each node the bounding box, the sum and the count.  In a round, entries go down the tree with the
nodes.  Of a box, the entry nearest to its middle eliminates each entry that is nowhere in the box nearer than it (by the
corner furthest towards that entry; where both are equally far, the greater index goes).  A node with one entry left hands
its sum and count to it as a whole; in leaves the entries left are measured against each part.  Spark adds up sums and
counts by part position and entry.  Everything is exact, so results are those of plain rounds.

Null vectors and those with a null or non-finite component are dropped.  Ids that repeat are rows of their own; null ids
come after all others when the first codebooks are taken, and of equal ids the lesser vector comes first.  With fewer
vectors than entries there are as many entries as vectors.  Codebooks have the length of the first vector whose length is
a multiple of the number of parts and not zero; vectors of another length have null code and error, and their labels'
errors leave them out (null if nothing is left).  A component of 2**40 or more is refused with an error; errors beyond a
long are null.  An empty table gives no rows; other columns don't enter, whatever their names."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import blocks, common

#: Parts in a leaf at most.
LEAF = 16


@lru_cache(maxsize=64)
def layout(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    """Nodes over n parts in tree order, level by level: where each begins and ends, its first child (-1 for a leaf; the
    second one follows), and the levels."""
    start, end, child, levels = [0], [n], [], []
    at = 0
    while at < len(start):
        levels.append(slice(at, len(start)))
        for i in range(at, len(start)):
            a, b = start[i], end[i]
            if b - a > LEAF:
                child.append(len(start))
                start += [a, (a + b) // 2]
                end += [(a + b) // 2, b]
            else:
                child.append(-1)
        at = levels[-1].stop
    return np.array(start), np.array(end), np.array(child), levels


class Tree:
    """order: the row of each part; x: parts in tree order; low, high, total: of each node.  All whole numbers."""

    def __init__(self, order, x, low, high, total):
        self.order, self.x, self.low, self.high, self.total = order, x, low, high, total

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        n = len(x)
        start, end, child, _ = layout(n)
        order = np.arange(n)
        low, high, total = (np.empty((len(start), x.shape[1]), np.int64) for _ in range(3))
        for i in range(len(start)):
            a, b = start[i], end[i]
            own = x[order[a:b]]
            low[i], high[i], total[i] = own.min(axis=0), own.max(axis=0), own.sum(axis=0)
            if child[i] >= 0:
                widest = int(np.argmax(high[i] - low[i]))
                order[a:b] = order[a:b][np.argpartition(own[:, widest], (b - a) // 2)]
        return cls(order, x[order], low, high, total)

    def packed(self) -> list[bytes]:
        return [self.order.astype(np.int32).tobytes(), *map(blocks.pack, (self.x, self.low, self.high, self.total))]

    @classmethod
    def unpacked(cls, data: list[bytes], width: int) -> Tree:
        return cls(np.frombuffer(data[0], np.int32), *(blocks.unpack(d, width) for d in data[1:]))


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For parts in tree order the nearest entry (ties: lower index) and the squared distance to it; sums and counts of
    entries; and how many distances of single parts were measured."""
    k, (start, end, child, levels) = len(entries), layout(len(tree.x))
    x, z, low, high = blocks.exact(tree.x, entries, tree.low, tree.high)
    z2 = (z * z).sum(axis=1)
    code = np.zeros(len(x), np.int64)
    total, count, measured = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64), 0
    node, alive = np.array([0]), np.ones((1, k), bool)
    for _ in levels:
        if not len(node):
            break
        twice = low[node] + high[node]
        far = z2[None, :] - twice @ z.T
        far[~alive] = np.inf
        star = np.argmin(far, axis=1)
        i, j = np.nonzero(alive)
        to = z[j] - z[star[i]]
        corner = np.where(to > 0, high[node[i]], low[node[i]])
        margin = z2[j] - z2[star[i]] - 2 * (to * corner).sum(axis=1)
        gone = (margin > 0) | ((margin == 0) & (j > star[i]))
        alive[i[gone], j[gone]] = False
        one = alive.sum(axis=1) == 1
        for r in np.flatnonzero(one).tolist():
            n, e = node[r], np.argmax(alive[r])
            code[start[n] : end[n]] = e
            total[e] += tree.total[n]
            count[e] += end[n] - start[n]
        leaf = ~one & (child[node] < 0)
        for r in np.flatnonzero(leaf).tolist():
            a, b = start[node[r]], end[node[r]]
            left = np.flatnonzero(alive[r])
            own = left[np.argmin(z2[left][None, :] - 2 * (x[a:b] @ z[left].T), axis=1)]
            code[a:b] = own
            measured += (b - a) * len(left)
            np.add.at(total, own, tree.x[a:b])
            np.add.at(count, own, 1)
        down = ~one & ~leaf
        node = np.stack([child[node[down]], child[node[down]] + 1], axis=1).ravel()
        alive = np.repeat(alive[down], 2, axis=0)
    return code, ((x - z[code]) ** 2).sum(axis=1), total, count, measured


def _trees(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """A row a block: ids, labels, and of each part position a packed tree."""
    label = rows.select("label").schema.simpleString()[len("struct<label:") : -1]
    width = size // parts

    def run(it):
        for _, t in blocks.block_rows(it, blocks.partition_number()):
            x = blocks.whole(blocks.matrix(t.column("v")))
            trees = [Tree.build(x[:, p * width : (p + 1) * width]).packed() for p in range(parts)]
            label = t.column("label").combine_chunks()
            offsets = pa.array([0, len(label)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, label), pa.array([trees], pa.list_(pa.list_(pa.binary())))], names=["ids", "labels", "trees"]
            )

    return rows.mapInArrow(run, f"ids array<long>, labels array<{label}>, trees array<array<binary>>")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every vector that is kept; at most 256 entries."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    size = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*first).select(F.size("v")).limit(1).collect()
    size = size[0][0] if size else 0
    width, fits = size // parts, (F.size("v") == size) & (F.size("v") > 0)
    chosen = [r["v"] for r in rows.where(fits).orderBy(*first).limit(entries).collect()]
    chosen = blocks.whole(np.array(chosen, np.float64).reshape(len(chosen), size))
    books = [chosen[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    common.bound_batches(spark, blocks.BLOCK)
    trees = common.save(_trees(rows.where(fits), size, parts), "trees")

    def one_round(now):
        shared = spark.sparkContext.broadcast(now)  # parts * entries * width numbers

        def run(it):
            schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
            now = shared.value
            sums = [np.zeros(b.shape, np.int64) for b in now]
            counts = [np.zeros(len(b), np.int64) for b in now]

            def rows():
                return [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]

            for b in it:
                for each in b.column(0).to_pylist():
                    for p, data in enumerate(each):
                        _, _, s, n, _ = assign(Tree.unpacked(data, width), now[p])
                        sums[p] += s
                        counts[p] += n
                    if max(int(np.abs(s).max()) for s in sums) >= 1 << 61:
                        yield from common.batches(rows(), schema)
                        sums, counts = [s * 0 for s in sums], [c * 0 for c in counts]
            yield from common.batches(rows(), schema)

        found = trees.select("trees").mapInArrow(run, "part int, entry int, n long, s array<long>")
        each = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
        return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()  # parts * entries rows

    for _ in range(rounds if len(chosen) else 0):
        for r in one_round(books):
            books[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    label = rows.select("label").schema.simpleString()[len("struct<label:") : -1]
    shared = spark.sparkContext.broadcast(books)

    def finish(it):
        books = shared.value
        for b in it:
            labels = b.column("labels")
            for i, (ids, each) in enumerate(zip(b.column("ids").to_pylist(), b.column("trees").to_pylist())):
                codes, error = np.zeros((len(ids), parts), np.int64), 0
                for p, data in enumerate(each):
                    tree = Tree.unpacked(data, width)
                    code, d, _, _, _ = assign(tree, books[p])
                    codes[tree.order, p] = code
                    back = np.empty_like(d)
                    back[tree.order] = d
                    error = error + back
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), labels[i].values, pa.array(text), pa.array(blocks.as_long(error), pa.int64())], names=["vec_id", "label", "code", "error"])

    done = trees.mapInArrow(finish, f"vec_id long, label {label}, code string, error long")
    other = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    done = common.save(done.unionByName(other), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = common.save(done.groupBy("label").agg(total.cast("long").alias("label_error")).withColumnRenamed("label", "own"), "label-errors")
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()
    out = done.join(common.maybe_broadcast(sums), F.col("label").eqNullSafe(F.col("own")), "left").drop("own")
    return out.withColumn("codebooks_sha256", F.lit(digest))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    done = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return done.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every distance of every round; vectors of equal length."""
    steps = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, list_slice(v, CAST(p * len(v) // {parts} + 1 AS BIGINT), CAST((p + 1) * len(v) // {parts} AS BIGINT)) AS x FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r AS e, x AS m FROM cut WHERE r < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT r, cut.p, e, list_sum(list_transform(list_zip(x, m), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d FROM cut JOIN b{i} ON cut.p = b{i}.p) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT p, best.e AS e, j, sum(y) AS s, count(*) AS n FROM (SELECT r, p, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM cut) JOIN a{i} USING (r, p) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(f, m) AS m FROM b{i} LEFT JOIN (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS f FROM s{i} GROUP BY p, e) USING (p, e))""")
    return ",\n".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, sum(best.d) AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books"""


ORACLE_CODEBOOKS = oracle()
