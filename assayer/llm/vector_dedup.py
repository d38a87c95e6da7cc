"""Near-duplicate vectors by spherical-cap filters.

A filter direction is a code: one of K random directions for each block of a rotated vector, so K to the power of the
blocks directions need only K times the blocks products.  A vector is put under every direction whose sum of block
products passes a threshold; decoding the list block by block drops partial sums that cannot get there.  The threshold
follows the number of vectors, so that about ``CROWD`` strangers are under a direction.  Code books are added until
``RECALL`` of a fixed sample of random pairs at the least cosine meet under some direction, at any number of vectors.

What meets is ids and 128 signs of random projections; where these differ in few places, vectors are candidates.
Candidates that hang together are a family.  Each vector goes to its family once, and all pairs there are verified in
double precision.  Families over two blocks are verified under each direction instead, by blocks, a pair counting under
its least common direction only.  Tasks return counts and spanning links, never pairs.

Equal vectors of a label count once, with their number.  Vectors that are null, all zero or hold null or non-finite
values, and rows without a label, link with nothing; vectors of different length never link.  Repeated ids are rows of
their own, with links by their vectors (a copy of the same id too), and one component where they share it by vector
only; a null id takes no part.  Very long vectors cost a rotation matrix of their length squared.  Empty table: no rows.
Other columns don't enter, whatever their names."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.words import mix

#: Strangers under a direction, expected directions of a vector in a code book, vectors in a block, share of pairs that meet.
CROWD, LISTED, BLOCK, RECALL = 64, 3.0, 256, 0.98
#: Books at least and at most; random pairs that books are tried on; products of a block at most.
BOOKS, TRIED, WIDEST = (4, 64), 500, 16384
#: Signs of a sketch, and how many may differ: at a cosine of 0.98 eight do, with a deviation of under three.
SIGNS, DIFFER = 128, 28


class Codes:
    """Code books for vectors of one length among ``total`` vectors, of which pairs at ``least`` are to meet."""

    def __init__(self, size: int, total: int, least: float = 0.98):
        chance = min(0.02, CROWD / max(total, 2))
        self.least = NormalDist().inv_cdf(1 - chance)
        wanted, self.blocks = LISTED / chance, 2
        while wanted ** (1 / self.blocks) > WIDEST:
            self.blocks += 1
        self.blocks = min(size, self.blocks)
        self.k = max(2, int(np.ceil(wanted ** (1 / self.blocks))))
        rng = np.random.default_rng(size)
        cuts = np.linspace(0, size, self.blocks + 1).astype(int)
        self.signs, self.books = rng.standard_normal((size, SIGNS)), []
        tried = np.random.default_rng(size + 1)
        x = unit_rows(tried.standard_normal((TRIED, size)))
        away = tried.standard_normal((TRIED, size))
        away -= (away * x).sum(axis=1, keepdims=True) * x
        y = least * x + np.sqrt(max(0.0, 1 - least * least)) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        met = np.zeros(TRIED, bool)
        while len(self.books) < BOOKS[0] or (met.mean() < RECALL and len(self.books) < BOOKS[1]):
            turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
            self.books.append((turn, [(a, b, rng.standard_normal((b - a, self.k))) for a, b in zip(cuts[:-1], cuts[1:])]))
            last = len(self.books) - 1
            met |= [len(np.intersect1d(a, b)) > 0 for a, b in zip(self.listed(x, last), self.listed(y, last))]

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """Two words of signs for each unit vector."""
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)

    def listed(self, unit: np.ndarray, only: int | None = None) -> list[np.ndarray]:
        """For unit vectors (rows), the numbers of all directions that each is under (of one book only)."""
        out: list[list[np.ndarray]] = [[] for _ in unit]
        for book, (turn, parts) in enumerate(self.books):
            if only not in (None, book):
                continue
            turned = unit @ turn
            sums = [turned[:, a:b] @ g for a, b, g in parts]
            best = [s.max(axis=1) for s in sums]
            rest = np.cumsum([*best[::-1]], axis=0)[::-1]  # rest[j]: best possible from block j on
            for i in range(len(unit)):
                total, code = np.zeros(1), np.zeros(1, np.int64)
                for j, s in enumerate(sums):
                    more = rest[j + 1][i] if j + 1 < len(sums) else 0.0
                    t = total[:, None] + s[i][None, :]
                    p, c = np.nonzero(t + more >= self.least)
                    total, code = t[p, c], code[p] * self.k + c
                out[i].append(mix(mix(code.view(np.uint64) + np.uint64((book + 1) << 58)) + np.uint64(unit.shape[1])).view(np.int64))
        return [np.concatenate(x) for x in out]


def unit_rows(vectors: list) -> np.ndarray:
    v = np.array(vectors, dtype=np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


_codes: dict[tuple, Codes] = {}


def codes(size: int, total: int, least: float) -> Codes:
    """This process's code books for vectors of a length."""
    if (size, total, least) not in _codes:
        _codes.clear()
        _codes[size, total, least] = Codes(size, total, least)
    return _codes[size, total, least]


def spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join whatever ``link`` joins."""
    edges, seen = [], np.zeros(len(link), bool)
    for i in np.flatnonzero(link.any(axis=1)).tolist():
        if not seen[i]:
            todo, seen[i] = [i], True
            while todo:
                a = todo.pop()
                new = np.flatnonzero(link[a] & ~seen)
                seen[new] = True
                todo += new.tolist()
                edges += [(a, b) for b in new.tolist()]
    return edges


def near_sketches(words: np.ndarray) -> np.ndarray:
    """Which sketches (rows of two words) differ in few places."""
    words = words.view(np.uint64)  # bits of negative numbers are counted of their absolute value
    apart = sum(np.bitwise_count(words[:, None, j] ^ words[None, :, j]).astype(np.int16) for j in range(words.shape[1]))
    near = apart <= DIFFER
    np.fill_diagonal(near, False)
    return near


def link_block(vectors: list, weights: list[int], least: float, own: list[int] | None = None, lists: list | None = None, direction: int = 0):
    """Counts and spanning edges of the links in a block; of different own blocks only, if given; with ``lists`` of
    directions, only of pairs whose least common one is ``direction``."""
    unit = unit_rows(vectors)
    link = unit @ unit.T >= least
    if lists is not None:
        smaller = [np.array([f for f in x if f < direction], np.int64) for x in lists]
        if any(map(len, smaller)):
            _, which = np.unique(np.concatenate(smaller), return_inverse=True)
            met = np.zeros((len(vectors), int(which.max()) + 1), np.float32)
            met[np.repeat(np.arange(len(vectors)), [len(x) for x in smaller]), which] = 1
            link &= (met @ met.T) == 0
    np.fill_diagonal(link, False)
    if own is not None:
        link &= np.not_equal.outer(own, own)
    return link @ np.array(weights, np.int64), spanning(link)


def _groups(it, width: int):
    """Rows of batches whose first ``width`` columns are equal and stand together, two at least: key, other columns."""
    key, held = None, []
    for b in it:
        for at in range(0, b.num_rows, 512):
            for r in zip(*(c.to_pylist() for c in b.slice(at, 512).columns)):
                if r[:width] != key:
                    if len(held) > 1:
                        yield key, held
                    key, held = r[:width], []
                held.append(r[width:])
    if len(held) > 1:
        yield key, held


def _in_blocks(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Columns own, i, j: groups over two blocks are dealt as pairs of blocks."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("c")).where(F.col("c") > 2 * BLOCK)
    large = common.maybe_broadcast(common.save(large.toDF(*(f"{k}_" for k in keys), "c"), "crowds"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}_"))
    blocks = F.coalesce(F.ceil(F.col("c") / BLOCK), F.lit(1)).cast("int")
    dealt = rows.join(large, same, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(ident), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    keyed = rows.withColumn("a", F.when(fit, F.xxhash64("label", "v"))).withColumn("b", F.when(fit, F.xxhash64("v", F.lit(1))))
    classes = keyed.where("a is not null").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.min("label").alias("label"), F.first("v").alias("v"))
    classes = common.save(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    total = classes.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    n = common.parts(df, 4)
    common.bound_batches(spark, 4096)

    def under(it):
        for b in it:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, labels, vectors = np.asarray(part.column(0)), part.column(1), part.column(2).to_pylist()
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(vectors):
                    by_size.setdefault(len(v), []).append(i)
                for size, who in by_size.items():
                    books, unit = codes(size, total, least), unit_rows([vectors[i] for i in who])
                    lists, sketch = books.listed(unit), books.sketch(unit)
                    each = np.repeat(np.arange(len(who)), [len(x) for x in lists])
                    place = np.array(who)[each]
                    cols = [labels.take(pa.array(place)), pa.array(np.concatenate(lists)), pa.array(ids[place]), pa.array(sketch[each, 0]), pa.array(sketch[each, 1])]
                    yield pa.RecordBatch.from_arrays(cols, names=["label", "f", "id", "s", "t"])

    label = classes.select("label").schema.simpleString()[7:-1]
    found = classes.select("id", "label", "v").repartition(n).mapInArrow(under, f"{label}, f long, id long, s long, t long")
    found = common.save(found, "directions")

    def meet(it):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def edges():
            for _, g in _groups(it, 4):
                ids = [r[0] for r in g]
                yield from ((ids[a], ids[b]) for a, b in spanning(near_sketches(np.array([r[1:] for r in g], np.int64))))

        yield from common.batches(edges(), schema)

    order = ["label", "f", "i", "j"]
    dealt = _in_blocks(found, ["label", "f"], "id").select(*order, "id", "s", "t")
    edges = common.save(dealt.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(meet, "a long, b long").distinct(), "met")
    family = common.components(edges).toDF("member", "family")
    size = family.groupBy("family").agg(F.count("*").alias("m")).select((F.col("family") + 0).alias("g"), "m")
    family = common.save(family.join(size, F.col("family") == F.col("g")).select("member", "family", "m"), "families")
    vectors = classes.select("id", "w", "v")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def results(ids, counts, edges):
        yield from ((i, None, c) for i, c in zip(ids, counts.tolist()) if c)
        yield from ((ids[a], ids[b], None) for a, b in edges)

    def verify(it):
        yield from common.batches((x for _, g in _groups(it, 1) for x in results([r[0] for r in g], *link_block([r[2] for r in g], [r[1] for r in g], least))), schema)

    def verify_large(it):
        def out():
            for (_, f, i, j), g in _groups(it, 4):
                own = [r[1] for r in g] if i != j else None
                yield from results([r[0] for r in g], *link_block([r[3] for r in g], [r[2] for r in g], least, own, [r[4] for r in g], f))

        yield from common.batches(out(), schema)

    small = vectors.join(family.where(F.col("m") <= 2 * BLOCK), F.col("id") == F.col("member")).select("family", "id", "w", "v")
    done = common.save(small.repartition(n, "family").sortWithinPartitions("family").mapInArrow(verify, "a long, b long, n long"), "links")
    large = common.save(family.where(F.col("m") > 2 * BLOCK).select("member"), "large")
    if not large.isEmpty():
        met = found.join(large, F.col("id") == F.col("member"), "left_semi").select("label", "f", "id")
        lists = met.groupBy("id").agg(F.collect_list("f").alias("fs")).select(F.col("id").alias("x"), "fs")
        full = vectors.join(lists, F.col("id") == F.col("x")).select("x", "w", "v", "fs")
        dealt = _in_blocks(common.save(met, "under"), ["label", "f"], "id").join(full, F.col("id") == F.col("x"))
        dealt = dealt.select(*order, "id", "own", "w", "v", "fs").repartition(n, *order).sortWithinPartitions(*order)
        done = done.union(common.save(dealt.mapInArrow(verify_large, "a long, b long, n long"), "large-links"))
    groups = common.components(done.where("b is not null").select("a", "b"))
    least_id = groups.join(classes.select(F.col("id").alias("x"), "rep"), F.col("id") == F.col("x")).groupBy("component_id").agg(F.min("rep").alias("least"))
    groups = groups.join(least_id.select((F.col("component_id") + 0).alias("c"), "least"), F.col("component_id") == F.col("c")).select(F.col("id").alias("x"), "least")
    counts = done.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("y"), "n")
    each = classes.select("a", "b", "id", "rep", "w").join(counts, F.col("id") == F.col("y"), "left").join(groups, F.col("id") == F.col("x"), "left")
    each = common.save(each.select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "classes")
    out = keyed.join(each, ["a", "b"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair of a label; for tables of thousands of rows.
ORACLE_VECTOR_DEDUP = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""
