"""Similarity join on word shingles by several global orders.

A pair that links shares a shingle in the prefixes under each global order.  All orders put shingles that only one set
holds first, so sets whose unique shingles already fill the prefix are out.  Among the sets left, shingles are counted;
the first order goes by count, the others by magnitude of the count and hashes of their own.  Texts of the same words are
one set from the start.

Which shingles are shared is asked in rounds, by slices of their hashes.  After the first, a third, only sets are looked
at that are the first of equal texts and of which not more was alone than may be; so copies and texts of their own are
exchanged by a third, and no round exchanges much more than that.

1. Hubs.  For each first-order prefix shingle the most typical set (fewest unique shingles) of a task is its hub, and the
   most typical hub of all tasks the hub of hubs.  Pairs of set and hub that meet under all orders are verified.  So a
   dense group is linked by as many pairs as it has sets, and a shingle that many sets hold costs an exchanged row a task.
2. Rest.  Only sets of different components that still share a prefix shingle are left.  They are grouped by it, under
   one order after the other; in a group, pairs of different components that meet under all orders are verified.
   Large groups are dealt as blocks, and those of the largest component meet the blocks of other components only.
3. Links are of 64-bit hashes of shingles.  Shingles of one text that have one hash are compared word by word, so that
   every set has as many hashes as shingles; links of hashes may then only be too many, and the two texts of each link are
   compared word by word as well.  Should either fail, all is done again with another seed.

Tasks return spanning links, never all pairs.  Null or wordless text: empty set, linked with nothing.  Very long texts
and words are taken whole.  Rows with a null id get a null component; rows that repeat an id must repeat its text, and
stay rows of their own; of texts with equal words the least id stands for all.  Empty table: no rows.  Other columns of
the table don't enter, whatever their names."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.shared_keys import layout, shared_keys
from assayer.llm.words import Words, as_bytes, mix

ORDERS = 3
#: Sets in a block, shingles in a block; blocks from which on a group is tried by single shingles.
BLOCK, BLOCK_SHINGLES, MANY_BLOCKS = 64, 1 << 18, 16
#: Shingles that a task looks at together.
HELD = 1 << 19
#: Slices of all shingles, by hash, and those that are looked at first.
SLICES = 1 << 20
FIRST = SLICES // 3
#: No set is so large: a text has fewer bytes.
MIXED = (1 << 32) - 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MEMBERS = "id long, n long, tokens array<long>, heads array<array<long>>"


def plain_words(text: str | None) -> list[bytes]:
    return as_bytes(text).translate(_LOWER).split()


def shingle_sets(texts: list[bytes], k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, hashed; the text's number of each, ascending; and the texts in which
    different shingles have one hash.  Fewer words: all as one."""
    w = Words(texts, lower=True, seed=seed)
    keys, doc = w.windows(k)
    word = w.window_words(k)
    few = np.flatnonzero((np.diff(w.first) < k) & (np.diff(w.first) > 0))
    if len(few):
        own = []
        for i in few.tolist():
            h = np.uint64(0x51ED270B)
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                h = mix(np.array([h]) * np.uint64(0x9FB21C651E98DF25) + x + np.uint64(k))[0]
            own.append(h)
        keys, doc, word = np.concatenate([keys, np.array(own, np.uint64)]), np.concatenate([doc, few]), np.concatenate([word, few])
    order = np.lexsort((keys, doc))
    keys, doc, word = keys[order], doc[order], word[order]
    if not len(keys):
        return keys, doc, doc
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
    again = np.flatnonzero(~new)
    differ = np.zeros(len(again), bool)
    for j in range(k if len(again) else 0):
        differ |= ~w.same(word[again - 1] + j, word[again] + j)
    return keys[new], doc[new], np.unique(doc[again[differ]])


def _extract(k: int, seed: int, low: int = 0, high: int = SLICES):
    """Sets are named by their document; a digest of the words tells copies.  ``MIXED`` as the size of a set says that its
    shingles need another seed.  Of all shingles those of the slices from ``low`` to ``high`` go out."""

    def extract(held):
        keys, doc, mixed = shingle_sets([as_bytes(r[1]) for r in held], k, seed)
        size = np.bincount(doc, minlength=len(held)).astype(np.uint32)
        size[mixed] = MIXED
        slices = (keys >> np.uint64(44)).astype(np.int64)
        own = (slices >= low) & (slices < high)
        keys, doc = keys[own], doc[own]
        key = seed.to_bytes(8, "little")
        digests = np.frombuffer(b"".join(hashlib.blake2b(b" ".join(plain_words(r[1])), digest_size=16, key=key).digest() for r in held), np.int64).reshape(-1, 2)
        d1, d2 = np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])
        null = np.array([r[0] is None for r in held], dtype=np.uint8)
        ids = np.array([r[0] or 0 for r in held], dtype=np.int64)
        return keys, doc, np.zeros(len(keys), np.uint32), ids, null == 0, (ids, null, size, d1, d2)

    return extract


def _prefix(keys: np.ndarray, counts: np.ndarray, n: int, percent: int, order: int) -> np.ndarray:
    """The shared part of a set's prefix under an order."""
    least = -(-percent * n // 100)
    room = (n - least + 1) - (n - len(keys))
    if room <= 0:
        return keys[:0]
    ranks = mix(keys + np.uint64((order * 0xA0761D6478BD642F) % (1 << 64)))
    level = counts if order == 0 else np.frexp(counts)[1]
    return keys[np.lexsort((ranks, level))[:room]]


def link_group(sizes: np.ndarray, sets: list[np.ndarray], heads: list[list[np.ndarray]], comps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links between different components of a group (shared shingles only; sizes are of the whole sets)."""
    n = len(sets)
    ok = (100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)) & np.triu(np.ones((n, n), bool), 1)
    ok &= comps[:, None] != comps[None, :]
    for o in range(ORDERS):
        if not ok.any():
            return []
        ok &= _common([h[o] for h in heads]) > 0
    left, right = np.nonzero(ok)
    if len(left) <= 2 * n:
        inter = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], dtype=np.int64)
    else:
        inter = _common(sets)[left, right].astype(np.int64)
    link = 100 * inter >= percent * (sizes[left] + sizes[right] - inter)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for a, b in zip(left[link].tolist(), right[link].tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((a, b))
    return edges


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence blocks; shingles in one set only don't count."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[which] > 1
    col, row = number[which[keep]], row[keep]
    out, width, total = np.zeros((n, n), np.float32), 4096, int((count > 1).sum())
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for at in range(0, total, width):
        a, b = np.searchsorted(col, (at, at + width))
        block = np.zeros((n, min(width, total - at)), np.float32)
        block[row[a:b], col[a:b] - at] = 1
        out += block @ block.T
    return out


def _int64(column) -> list[np.ndarray]:
    """The lists of an array column."""
    if not len(column):
        return []
    at = np.asarray(column.offsets)
    return np.split(np.asarray(column.flatten()), (at[1:-1] - at[0]))


def _members(batch) -> list[tuple]:
    """(id, n, tokens, heads) of a batch's rows."""
    out, heads = [], batch.column("heads")
    for i, (d, n, t) in enumerate(zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), _int64(batch.column("tokens")))):
        out.append((d, n, t.view(np.uint64), [x.view(np.uint64) for x in _int64(heads[i].values)]))
    return out


def _held(it, width=lambda r: len(r[2])):
    """Rows of batches in lists of about HELD shingles."""
    rows, n = [], 0
    for b in it:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            extra = [part.column(c).to_pylist() for c in ("comp", "family") if c in part.schema.names]
            for r in zip(_members(part), *extra):
                rows.append((*r[0], *r[1:]))
                n += width(rows[-1])
            if n >= HELD:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def _by_token(heads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles in order, the row of each, and where each shingle begins."""
    tokens = np.concatenate([*heads, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    return tokens, row, start


def _hub_links(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of sets with the hub of a shingle in their task, and (token, id, odd): each task's hub of each shingle."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("odd", pa.float64())])

    def run(it):
        for rows in _held(it):
            tokens, row, start = _by_token([r[3][0] for r in rows])
            if not len(tokens):
                continue
            odd = np.array([(r[1] - len(r[2])) / r[1] for r in rows])
            place = np.empty(len(rows), np.int64)
            place[np.lexsort((np.array([r[0] for r in rows]), odd))] = np.arange(len(rows))
            best = np.minimum.reduceat(place[row], start)
            hub = np.argsort(place)[best]
            out = [(None, rows[h][0], t, odd[h]) for h, t in zip(hub.tolist(), tokens[start].view(np.int64).tolist())]
            to = np.repeat(hub, np.diff(np.append(start, len(tokens))))
            for a, b in np.unique(np.stack([row, to], axis=1)[row != to], axis=0).tolist():
                x, y = rows[a], rows[b]
                if all(len(np.intersect1d(x[3][o], y[3][o], assume_unique=True)) for o in range(1, ORDERS)):
                    inter = len(np.intersect1d(x[2], y[2], assume_unique=True))
                    if 100 * inter >= percent * (x[1] + y[1] - inter):
                        out.append((x[0], y[0], None, None))
            yield from common.batches(out, schema)

    done = common.save(members.mapInArrow(run, "a long, b long, token long, odd double"), "hubs")
    return done.where("a is not null").select("a", "b"), done.where("a is null").select("token", F.col("b").alias("id"), "odd")


def _pairs_that_link(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets those that meet under all orders and link."""
    x = members.toDF("ia", "na", "ta", "ha")
    y = members.toDF("ib", "nb", "tb", "hb")
    meet = [F.arrays_overlap(F.element_at("ha", o + 1), F.element_at("hb", o + 1)) for o in range(ORDERS)]
    both = pairs.join(x, F.col("a") == F.col("ia")).join(y, F.col("b") == F.col("ib")).where(meet[0] & meet[1] & meet[2])
    inter = F.size(F.array_intersect("ta", "tb"))
    return both.where(inter * 100 >= (F.col("na") + F.col("nb") - inter) * percent).select("a", "b")


def _closure(members: DataFrame, order: int) -> DataFrame:
    """(id, component_id): components that a chain of common prefix shingles joins, within families.  A shingle costs a
    row a task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("family", pa.int64()), ("token", pa.int64())])

    def run(it):
        for rows in _held(it, lambda r: len(r[3][order])):
            family, comp = np.array([r[5] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
            tokens, row, _ = _by_token([r[3][order] for r in rows])
            if not len(tokens):
                continue
            by = np.lexsort((comp[row], tokens, family[row]))
            t, f, c = tokens[by], family[row][by], comp[row][by]
            start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (f[1:] != f[:-1])]))
            least = np.repeat(c[start], np.diff(np.append(start, len(t))))
            edges = np.unique(np.stack([c, least], axis=1)[c != least], axis=0)
            yield from common.batches(zip(edges[:, 0].tolist(), edges[:, 1].tolist(), [None] * len(edges), [None] * len(edges)), schema)
            yield from common.batches(zip([None] * len(start), c[start].tolist(), f[start].tolist(), t[start].view(np.int64).tolist()), schema)

    found = common.save(members.mapInArrow(run, "a long, b long, family long, token long"), "chains")
    each = found.where("a is null").select("family", "token", "b")
    least = each.groupBy("family", "token").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < x").select((F.col("family") + 0).alias("f"), (F.col("token") + 0).alias("t"), "m")
    more = each.join(least, (F.col("family") == F.col("f")) & (F.col("token") == F.col("t"))).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return common.components(found.where("a is not null").select("a", "b").union(more))


def _rest_links(members: DataFrame, percent: int, n: int) -> DataFrame:
    """Links between different components (column comp) of sets that share a prefix shingle under each order."""
    spark = members.sparkSession
    members = members.withColumn("family", F.lit(0).cast("long"))
    done = members.where("false")
    for order in range(ORDERS):
        found = _closure(members, order)
        members = common.save(members.drop("family").join(found.toDF("c", "family"), F.col("comp") == F.col("c")).drop("c"), "members")
        size = members.groupBy("family").agg(F.count("*").alias("m")).where(F.col("m") > 2 * BLOCK).select(F.col("family").alias("f"))
        large = common.maybe_broadcast(common.save(size, "large"))
        done = done.unionByName(members.join(large, F.col("family") == F.col("f"), "left_anti"))
        members = members.join(large, F.col("family") == F.col("f"), "left_semi")
        if members.isEmpty():
            break
    if not members.isEmpty():
        # A group that chains of shingles made large is dealt by single shingles, if that moves less.
        single = members.withColumn("token", F.explode(F.array_distinct(F.element_at("heads", 1))))
        cost = single.groupBy("family", "token").agg(F.count("*").alias("c")).groupBy("family").agg(F.sum(F.col("c") * F.ceil(F.col("c") / BLOCK)).alias("by_token"))
        whole = members.groupBy("family").agg(F.count("*").alias("m")).select(F.col("family").alias("f"), (F.col("m") * F.ceil(F.col("m") / BLOCK)).alias("by_family"), "m")
        cheap = cost.join(whole, F.col("family") == F.col("f")).where((F.col("m") > MANY_BLOCKS * BLOCK) & (F.col("by_token") < F.col("by_family"))).select("f")
        cheap = common.maybe_broadcast(common.save(cheap, "chained"))
        again = single.join(cheap, F.col("family") == F.col("f"), "left_semi").withColumn("family", F.xxhash64("family", "token")).drop("token")
        members = members.join(cheap, F.col("family") == F.col("f"), "left_anti").unionByName(again)
    members = common.save(done.unionByName(members), "families")
    of = members.groupBy("family", "comp").agg(F.count("*").alias("m"), F.sum(F.size("tokens")).alias("t"))
    sizes = of.groupBy("family").agg(F.sum("m").alias("m"), F.sum("t").alias("t"), F.max(F.struct("m", "comp")).alias("big"))
    sizes = sizes.where((F.col("m") > 2 * BLOCK) | (F.col("t") > 2 * BLOCK_SHINGLES)).withColumn("all", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("t") / BLOCK_SHINGLES)))
    few = F.greatest(F.lit(1), F.ceil(F.col("all") * (F.col("m") - F.col("big.m")) / F.col("m"))).cast("int")
    blocks = sizes.select(F.col("family").alias("f"), F.col("big.comp").alias("largest"), few.alias("few"), F.greatest(F.lit(1), F.col("all") - few).cast("int").alias("rest"))
    blocks = common.maybe_broadcast(common.save(blocks, "blocks"))
    dealt = members.join(blocks, F.col("family") == F.col("f"), "left")
    large, inner = F.col("few").isNotNull(), F.col("comp") == F.col("largest")
    own = F.when(~large, 0).when(inner, F.col("few") + F.pmod(F.xxhash64("id"), F.col("rest"))).otherwise(F.pmod(F.xxhash64("id"), F.col("few"))).cast("int")
    meets = F.when(~large, F.array(F.lit(0))).when(inner, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("rest") - 1))
    dealt = dealt.withColumn("own", own).withColumn("o", F.explode(meets))
    dealt = dealt.select("family", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "id", "n", "tokens", "heads", "comp")

    def verify(it):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def groups():
            key, held = None, []
            for b in it:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    for f, i, j, m, c in zip(*(part.column(x).to_pylist() for x in ("family", "i", "j")), _members(part), part.column("comp").to_pylist()):
                        if (f, i, j) != key:
                            if len(held) > 1:
                                yield held
                            key, held = (f, i, j), []
                        held.append((*m, c))
            if len(held) > 1:
                yield held

        def links():
            for g in groups():
                for a, b in link_group(np.array([r[1] for r in g], np.int64), [r[2] for r in g], [r[3] for r in g], np.array([r[4] for r in g], np.int64), percent):
                    yield g[a][0], g[b][0]

        yield from common.batches(links(), schema)

    key = ["family", "i", "j"]
    found = common.save(dealt.repartition(n, *key).sortWithinPartitions(*key, "id").mapInArrow(verify, "a long, b long"), "links").distinct()
    common.release(spark)
    return found


def _wrong(links: DataFrame, rows: DataFrame, k: int, percent: int) -> bool:
    """Whether a link doesn't stand when the words of its two texts are compared."""
    ends = links.select(F.explode(F.array("a", "b")).alias("e")).distinct()
    texts = rows.join(common.maybe_broadcast(common.save(ends, "ends")), F.col("doc_id") == F.col("e")).select("e", "text")
    texts = common.save(texts.dropDuplicates(["e"]), "texts")
    pairs = links.join(texts.toDF("ea", "x"), F.col("a") == F.col("ea")).join(texts.toDF("eb", "y"), F.col("b") == F.col("eb"))

    def check(it):
        def words(text):
            w = plain_words(text)
            return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)}

        known, own = None, set()
        for batch in it:
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                if known != b:
                    known, own = b, words(y)
                other = words(x)
                inter = len(own & other)
                if 100 * inter < percent * (len(own) + len(other) - inter):
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([b], pa.int64())], names=["a", "b"])

    return not pairs.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").isEmpty()


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: documents link when 100 * intersection >= percent * union."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        out = _attempt(rows, layout(df, 4), k, percent, seed)
        if out is not None:
            return out
        seed += 1


def _attempt(rows: DataFrame, deal: tuple[int, int], k: int, percent: int, seed: int) -> DataFrame | None:
    """None if a link doesn't stand, or different shingles of a text have one hash."""
    spark, (n, subs) = rows.sparkSession, deal
    table = common.save(shared_keys(rows, _extract(k, seed, 0, FIRST), n, subs, percent=percent), "sets")
    common.release(spark)
    if not table.where(f"shared is null and size = {MIXED}").isEmpty():
        return None
    docs = table.where("shared is null").select("doc_id", F.col("size").alias("n_shingles"), "d1", "d2")
    classes = docs.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = common.save(classes, "classes")
    pieces = table.where("shared is not null").select(F.col("doc_id").alias("id"), F.col("size").alias("n"), "shared")
    pieces = common.save(pieces.join(classes.select("rep"), F.col("id") == F.col("rep"), "left_semi"), "first")
    # What is left to look at, in as many rounds as keep each to the shingles of the first one.
    every, left, sets = (x or 0 for x in (*docs.agg(F.sum("n_shingles")).first(), *pieces.agg(F.sum("n"), F.count("*")).first()))
    rounds = math.ceil((SLICES - FIRST) * left / (FIRST * every)) if left else 0
    parts, wanted = [pieces], common.maybe_among(pieces.select("id"), sets) if rounds else None
    for i in range(rounds):
        low, high = (FIRST + (SLICES - FIRST) * j // rounds for j in (i, i + 1))
        more = shared_keys(rows, _extract(k, seed, low, high), n, subs, percent=percent, wanted=wanted, hand_on=False)
        parts.append(common.save(more, "sets").select(F.col("doc_id").alias("id"), F.col("size").alias("n"), "shared"))
        common.release(spark)
    able = reduce(DataFrame.unionByName, parts)
    # Those found in all rounds; sets that ``wanted`` let through by mistake were not in the first.
    whole = able.groupBy("id").agg(F.first("n").alias("n"), F.sum(F.length("shared") / 8).alias("found"), F.count("*").alias("c"))
    whole = common.save(whole.where(f"c = {len(parts)} and found * 100 >= n * {percent}").select(F.col("id").alias("d"), "n"), "able")

    def shingles(it):
        for b in it:
            sets_of = [np.frombuffer(x, np.int64) for x in b.column("shared").to_pylist()]
            ids = np.repeat(np.asarray(b.column("id")), [len(x) for x in sets_of])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets_of, np.zeros(0, np.int64)])), pa.array(ids.astype(np.int64))], names=["token", "id"])

    able = able.select("id", "shared").join(common.maybe_broadcast(whole), F.col("id") == F.col("d"), "left_semi")
    every = able.mapInArrow(shingles, "token long, id long")
    held = every.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select((F.col("token") + 0).alias("t"), F.col("c").cast("int").alias("c"))
    counted = every.join(held, F.col("token") == F.col("t")).groupBy("id").agg(F.collect_list(F.struct("token", "c")).alias("tokens"))
    counted = counted.join(whole, F.col("id") == F.col("d")).where(F.size("tokens") * 100 >= F.col("n") * percent)
    counted = counted.select("id", "n", F.transform("tokens", lambda x: x["token"]).alias("tokens"), F.transform("tokens", lambda x: x["c"]).alias("counts"))

    def with_heads(it):
        lists = pa.list_(pa.int64())
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", lists), ("heads", pa.list_(lists))])
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for d, m, t, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _int64(part.column(2)), _int64(part.column(3))):
                    heads = [_prefix(t.view(np.uint64), c, m, percent, o).view(np.int64) for o in range(ORDERS)]
                    if len(heads[0]):
                        out.append((d, m, t, heads))
                yield from common.batches(out, schema)

    members = common.save(counted.mapInArrow(with_heads, MEMBERS), "members")
    common.release(spark)
    near, hubs = _hub_links(members, percent)
    best = hubs.groupBy("token").agg(F.min(F.struct("odd", "id")).alias("best"), F.count("*").alias("c")).where("c > 1").select((F.col("token") + 0).alias("t"), F.col("best.id").alias("hub"))
    pairs = hubs.join(best, F.col("token") == F.col("t")).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    near = common.save(near.union(_pairs_that_link(pairs, members, percent)).distinct(), "near")
    found = common.components(near)
    named = members.join(found.toDF("i", "c"), F.col("id") == F.col("i"), "left").select("id", "n", "tokens", "heads", F.coalesce("c", "id").alias("comp"))
    links = common.save(near.union(_rest_links(common.save(named, "named"), percent, n)), "all-links")
    if _wrong(links, rows, k, percent):
        return None
    common.release(spark)
    found = common.components(links)
    # Only sets that have copies or links need a name other than their own.
    named = classes.join(found, F.col("rep") == F.col("id"), "left").where("copies > 1 or component_id is not null")
    named = common.save(named.select(F.col("d1").alias("x"), F.col("d2").alias("y"), F.coalesce("component_id", "rep").alias("least")), "components")
    out = docs.join(named, (F.col("d1") == F.col("x")) & (F.col("d2") == F.col("y")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair that shares a shingle; for tables of thousands of rows.
ORACLE_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
sizes AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, unnest(sh) AS t FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM flat x JOIN flat y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 90 * (x.n + y.n - p.n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
"""
