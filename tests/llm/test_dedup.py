import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import common, ngram_join, suffix_dedup, vector_dedup


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(want[k] == v for k, v in got.items()) and all(k in got for a, b in edges if a != b for k in (a, b))


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_components_of_few_edges_take_few_jobs(spark, monkeypatch, most):
    """Edges that fit a task need no steps of stars; those that don't still do."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    edges = [(i, i + 1) for i in range(1, 64)] + [(100 - i, 100) for i in range(1, 30)]
    spark.sparkContext.setJobGroup(f"components-{most}", "")
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}"))
    spark.sparkContext._jsc.clearJobGroup()
    assert got == components({x for e in edges for x in e}, edges)
    assert most == 40 or jobs <= 8


def brute_sets(rows, k, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for d, text, *_ in rows:
        w = (text or "").encode().translate(low).split()
        sets[d] = set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, components(sets, links)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_similar_sets(documents, rows, k, percent):
    sizes, want = brute_sets(rows, k, percent)
    got = ngram_join.similar_sets(documents, k=k, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (sizes[d], want[d]) for d in want}


def test_copies_exchange_a_part_of_their_shingles(spark, monkeypatch):
    """Copies, and texts of their own, are looked at in the first round only; near copies are found nevertheless."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(60)]
    near = [t.replace(t.split()[100], "other", 1) for t in texts[:5]]
    rows = [(i + 1000 * c, t) for c in range(8) for i, t in enumerate(texts)] + [(9000 + i, t) for i, t in enumerate(near)] + [(9100, None), (9101, "a b")]
    found, save = [], common.save

    def spy(df, name):
        out = save(df, name)
        if name == "sets":
            found.append(out.agg(F.sum(F.length("shared") / 8)).first()[0] or 0)
        return out

    monkeypatch.setattr(common, "save", spy)
    sizes, want = brute_sets(rows, 3, 90)
    got = ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (sizes[d], want[d]) for d in want}
    assert sum(found) < 0.5 * sum(sizes.values())


@pytest.mark.parametrize("count,most", [(5, 4096), (50_000, 4096), (50_000, 2)])
def test_maybe_among(spark, monkeypatch, count, most):
    monkeypatch.setattr(common, "MOST_SEGMENTS", most)
    among = common.maybe_among(spark.range(0, 3 * count, 3).toDF("id"), count)
    own = np.arange(3 * count)
    assert among(own[::3]).all() and (most == 2 or among(own[1::3]).mean() < 0.05) and among(own[:0]).tolist() == []


@pytest.mark.parametrize("many", [8, 1])
def test_large_family(spark, monkeypatch, many):
    """A family over the block bound is dealt as pairs of blocks, or by shingle, and still loses no link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "MANY_BLOCKS", many)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    sizes, want = brute_sets(rows, 3, 90)
    got = ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def opposite_words(n):
    """A word of the sequence that repeats nothing three times, and the same with the two letters exchanged."""
    x = [0]
    while len(x) < n:
        x += [1 - i for i in x]
    return "".join("ab"[i] for i in x), "".join("ba"[i] for i in x)


def test_hashes_of_regular_words(spark):
    """Polynomials modulo a power of two can't tell these words apart."""
    rows = [(10 * i + j, w) for i, n in enumerate((64, 1024, 4096)) for j, w in enumerate(opposite_words(n))]
    got = ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_wrong_links_are_found(documents, rows, monkeypatch):
    """A link that the words don't bear out is found, and then another seed is taken."""
    make = lambda *ids: documents.sparkSession.createDataFrame([tuple(rows[i][0] for i in ids)], "a long, b long")
    texts = documents.select("doc_id", "text")
    assert ngram_join._wrong(make(0, 1), texts, 3, 90) and not ngram_join._wrong(make(2, 7), texts, 3, 90)
    seeds = []
    monkeypatch.setattr(ngram_join, "_attempt", lambda rows, deal, k, percent, seed: seeds.append(seed) or (rows if seed == 2 else None))
    assert ngram_join.similar_sets(documents).count() == len(rows) and seeds == [0, 1, 2]


def test_partitions_split_in_tasks(documents, rows, monkeypatch):
    """Few partitions with many sub-partitions give what many partitions give; joined tables don't multiply them."""
    assert common.parts(documents.join(documents.selectExpr("doc_id as d"), F.col("doc_id") == F.col("d")), 1e-6) <= common.MOST_PARTS
    sizes, want = brute_sets(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "layout", lambda df, mb: (2, 7))
    got = ngram_join.similar_sets(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (sizes[d], want[d]) for d in want}


def test_long_texts_and_words(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30_000], "other", *words[30_000:]])), (3, "x" * 500_000 + " a b c"), (4, "x" * 500_000 + " a b c"), (5, "y" + "x" * 499_999 + " a b c")]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_similar_sets_edges(spark, empty):
    assert ngram_join.similar_sets(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (4, None), (3, "A b\tc D")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_sets(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (4, 0, 4), (3, 2, 1)], key=str)


def brute_repeats(rows):
    first, out = {}, {}
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], d) < d:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, documents, rows, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows) and {r[0]: tuple(r[1:]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 5000


def test_suffix_dedup_random(spark, tmp_path):
    """Few letters, so that grams repeat everywhere."""
    rng = random.Random(4)
    blocks = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(blocks) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()} == brute_repeats(rows)


@pytest.mark.parametrize("hot", [2, 5])
def test_hot_grams(spark, tmp_path, monkeypatch, hot):
    """A passage with other text around it each time, and text of few letters: windows of hot grams go by digest."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(14)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, blocks = letters(80), ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)]
    rows = [(i * 7 % 101, f"{letters(rng.randint(0, 90))}{passage}{letters(rng.randint(0, 90))}" if i % 3 else "".join(rng.choice(blocks) for _ in range(4))) for i in range(90)]
    rows += [(200, None), (201, passage), (202, passage * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()} == brute_repeats(rows)


def test_suffix_dedup_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, very long texts."""
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(400_000))
    rows = [(None, long), (1, long), (1, long), (2, long[1000:] + "x"), (None, None), (3, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0), (0, 400_000, 0), (1, 400_000, 0), (1, 400_000, 0), (2, 399_001, 399_000), (3, 1, 0)]


def test_remove_repeats_keeps_columns(documents, empty):
    left = suffix_dedup.remove_repeats(documents)
    assert left.columns == documents.columns and left.count() == documents.count()
    assert left.where("text is null").count() == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_loser_tree():
    rng = random.Random(6)
    runs, every = [], []
    for _ in range(5):
        run = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(40))
        every += run
        runs.append(suffix_dedup.front_decode(suffix_dedup.front_code([(s, b"L", 1, 2) for s in run])))
    got = list(suffix_dedup.merge(runs))
    assert [g[1] for g in got] == sorted(every)
    for a, b in zip(got, got[1:]):
        assert b[0] == suffix_dedup.common_prefix(a[1], b[1], 0)


@pytest.mark.parametrize("block", [256, 16])
def test_vectors(spark, monkeypatch, block):
    """With small blocks, families are dealt by direction and block."""
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    rows = []
    for i in range(1200):
        v = centres[i % 40] + rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.14, 0.2]) if i % 3 else rng.standard_normal(64)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 40 % 3)))
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(300)]
    rows += [(3000, None, 1), (3001, [0.0] * 64, 1), (3002, [float("nan")] + [1.0] * 63, 1), (3003, rows[7][1], None), (3004, [None] + [1.0] * 63, 1), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    good = [r for r in rows if r[0] < 3000]
    v = np.array([r[1] for r in good], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[r[0]].n_links for r in good)
    assert all(got[r[0]].n_links <= n for r, n in zip(good, link.sum(axis=1)))
    assert link.sum() > 90_000 and found >= 0.995 * link.sum()
    want = components([r[0] for r in good], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(np.triu(link)))])
    assert np.mean([got[d].component_id == c for d, c in want.items()]) > 0.99
    assert [(got[d].n_links, got[d].kept) for d in (3000, 3001, 3002, 3003, 3004)] == [(0, True)] * 5
    assert got[3005].n_links == 1 and got[3006].component_id == 3005 and not got[3006].kept
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 384])
@pytest.mark.parametrize("total", [1500, 51282, 10**6, 10**7, 10**9])
def test_recall_at_every_size(size, total):
    """Pairs at the least cosine meet, however many vectors there are; these pairs are not those that books were tried on."""
    books, rng = vector_dedup.Codes(size, total), np.random.default_rng(77)
    x = vector_dedup.unit_rows(rng.standard_normal((400, size)))
    y = rng.standard_normal((400, size))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * vector_dedup.unit_rows(y)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(books.listed(x), books.listed(y))]
    apart = sum(np.bitwise_count(a ^ b) for a, b in zip(books.sketch(x).view(np.uint64).T, books.sketch(y).view(np.uint64).T))
    assert np.mean(np.array(met) & (apart <= vector_dedup.DIFFER)) >= 0.95


def test_vectors_with_repeated_ids(spark):
    """Rows of one id with different vectors are rows of their own; other columns don't enter."""
    near = [1.0, 0.05, 0.0, 0.0]
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (1, [0.0, 0.0, 1.0, 0.0], 0), (2, near, 0), (2, near, 0), (3, near, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("id", "rep", "f", "family", "member"):
        df = df.selectExpr("*", f"0 as {c}")
    got = sorted(tuple(r) for r in vector_dedup.near_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)]


def test_partition_keys(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 61, 211):
        keys = common.partition_keys(n).tolist()
        dealt = spark.createDataFrame([(k,) for k in keys], "k int").select(F.expr(f"pmod(hash(k), {n})")).collect()
        assert [r[0] for r in dealt] == list(range(n))


def test_shared_counts():
    assert collections.Counter(suffix_dedup.settle([(b"x" * 50, b"", 1, 0), (b"x" * 50, b"", 2, 5)])) == {(2, 5, 55): 1}
