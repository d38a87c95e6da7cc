"""Operators 11 and 13 against plain rounds in Python's integers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from assayer.llm import blocks, centroids, codebooks

VECTORS = "vec_id long, embedding array<double>, label string, block int, own string, code int"


def kept(v, size=None):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (size is None or len(v) == size)


def whole(v):
    return [math.floor(1024 * x) for x in v]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, entries):
    return min((far(v, e), i) for i, e in enumerate(entries))


def moved(entries, members):
    return [[sum(c) // len(members[i]) for c in zip(*members[i])] if members.get(i) else e for i, e in enumerate(entries)]


def plain_clusters(rows, k, rounds, seed, size):
    rows = [(i, v, whole(v)) for i, v, *_ in rows if kept(v, size)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    entries = [r[2] for r in sorted(rows, key=key)[:k]]
    for _ in range(rounds):
        members = defaultdict(list)
        for r in rows:
            members[nearest(r[2], entries)[1]].append(r[2])
        entries = moved(entries, members)
    found = [(r[0], *nearest(r[2], entries)) for r in rows]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in found)


def plain_codes(rows, parts, entries, rounds):
    rows = [(i, v, l) for i, v, l, *_ in rows if kept(v)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in order if v and len(v) % parts == 0), 0)
    fit = [(i, whole(v), l) for i, v, l in rows if size and len(v) == size]
    width = size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = [whole(v) for _, v, _ in order if size and len(v) == size][:entries]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in fit:
                members[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = moved(books[p], members)
    out, total = [], {}
    for i, v, l in fit:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(b[0] for b in best)
        out.append((i, "".join(f"{b[1]:02x}" for b in best), error, l))
        total[l] = total.get(l, 0) + error
    out += [(i, None, None, l) for i, v, l in rows if not size or len(v) != size]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, total.get(l), digest) for i, c, e, l in out)


def vectors(size, n, seed=4):
    """Clouds of vectors with ties, copies, nulls and odd values."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.2) for x in rng.choice(middles)]
        rows.append((i * 3 % n, v, rng.choice(["a", "b", None])))
    rows += [(1000 + i, list(middles[0]), "copies") for i in range(n // 3)]  # a third are copies
    rows += [(2000 + i, [float(x) for x in np.eye(size)[i % size]], "a") for i in range(size)]  # ties
    rows += [(5, list(middles[1]), "a"), (5, list(middles[2]), "b"), (None, list(middles[3]), None), (3000, None, "a"), (3001, [], "b"), (3002, [0.5] * (size - 1), "short"), (3003, [None] + [0.1] * (size - 1), "a")]
    rows += [(3004, [math.nan] + [0.1] * (size - 1), "a"), (3005, [math.inf] + [0.1] * (size - 1), "a"), (3006, [0.0] * size, "b")]
    return [(*r, 7, "x", 1) for r in rows]


def test_bounds_never_change_the_nearest():
    rng = np.random.default_rng(1)
    for scale, k, width in ((1, 12, 4), (1, 3, 2), (1 << 30, 6, 2), (1, 1, 0)):
        x = rng.integers(-9, 9, (300, 4)) * scale
        c = np.concatenate([x[: k - k // 3], x[: k // 3]])[:k]  # with centroids that are equal
        x_, c_ = blocks.exact(x, c)
        near, bound = centroids.scan(x_, c_, min(width, k - 1))
        scanned = []
        for _ in range(8):
            members = [x[near[:, 0] == i] for i in range(k)]
            new = np.array([m.sum(axis=0) // len(m) if len(m) else c[i] for i, m in enumerate(members)])
            move = np.sqrt(((new - c).astype(float) ** 2).sum(axis=1))
            c = new
            x_, c_ = blocks.exact(x, c)
            near, bound, again = centroids.advance(x_, c_, move, near, bound)
            scanned.append(again)
            assert near[:, 0].tolist() == [nearest(v, c.tolist())[1] for v in x.tolist()]
            d = np.sqrt(blocks.squared(*blocks.exact(x, c)).astype(float))
            assert (bound[:, 1:-1] <= np.take_along_axis(d, near[:, 1:], axis=1) + 1e-6 * scale).all()
        assert scanned[-1] < len(x) // 2


@pytest.mark.parametrize("scale", [1, 1 << 30])
def test_filtering_finds_what_plain_search_finds(scale):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-50, 50, (700, 4)), np.tile(rng.integers(-50, 50, (1, 4)), (300, 1)), rng.integers(0, 2, (100, 4))]) * scale
    entries = np.concatenate([x[:40], x[5:9], x[1050:1060]])
    tree = codebooks.Tree.build(x)
    tree = codebooks.Tree.unpacked(tree.packed(), 4)
    code, d, total, count, measured = codebooks.assign(tree, entries)
    want = [nearest(v, entries.tolist()) for v in x[tree.order].tolist()]
    assert [(int(a), int(b)) for a, b in zip(d, code)] == want
    assert count.tolist() == [sum(w[1] == i for w in want) for i in range(len(entries))]
    assert total.tolist() == [x[tree.order][code == i].sum(axis=0).tolist() for i in range(len(entries))]
    assert measured < len(x) * len(entries) // 2  # most are eliminated
    same = codebooks.Tree.build(np.tile(x[:1], (5000, 1)))
    code, _, _, count, measured = codebooks.assign(same, entries)
    assert measured == 0 and count.max() == 5000


def test_clusters_are_those_of_plain_rounds(spark):
    rows = vectors(6, 90)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = centroids.cluster(df, k=5, rounds=4, size=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows, 5, 4, 3, 6)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("assayer_")]


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(4, 3)[:3]
    df = spark.createDataFrame(rows, VECTORS)
    assert Counter(map(tuple, centroids.cluster(df, rounds=2, size=4).collect())) == plain_clusters(rows, 8, 2, 3, 4)
    assert centroids.cluster(df.where("false"), rounds=2, size=4).count() == 0
    assert centroids.cluster(df, rounds=2, size=5).count() == 0
    huge = spark.createDataFrame([(1, [2.0**41, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*40"):
        centroids.cluster(huge, size=2)
    wide = [(1, [2.0**34, 0.0]), (2, [-(2.0**34), 1.0]), (3, [0.0, 5.0])]  # squares beyond a long
    got = centroids.cluster(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), k=1, rounds=1, size=2).collect()
    assert {r["vec_id"]: r["distance"] is None for r in got} == {1: True, 2: True, 3: False} and got[0]["inertia"] is None


def test_rounds_move_no_vectors(spark, monkeypatch):
    """The join of vectors and bounds has no exchange."""
    plans = []
    save = blocks.Dealt.save

    def spy(self, df, name, dealt=True):
        plans.append((dealt, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, name, dealt)

    monkeypatch.setattr(blocks.Dealt, "save", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        centroids.cluster(spark.createDataFrame(vectors(4, 40), VECTORS), k=3, rounds=2, size=4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [p for dealt, p in plans if dealt and "Join" in p]
    assert len(joins) == 2 and not any("Exchange" in p for p in joins)


def test_codes_are_those_of_plain_rounds(spark):
    rows = vectors(8, 120)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = codebooks.compress(df, entries=20, rounds=3).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, got.collect())) == plain_codes(rows, 4, 20, 3)


def test_codes_of_few_vectors_and_none(spark):
    rows = vectors(4, 3)[:3] + [(9, [1.0, 2.0], "z", 7, "x", 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = codebooks.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(map(tuple, got.collect())) == plain_codes(rows, 4, 256, 4)
    assert codebooks.compress(df.where("false")).count() == 0
    assert [r["code"] for r in codebooks.compress(df.where("vec_id = 9")).collect()] == [None]
