"""Removal of byte strings of 50 that an earlier document holds, by merging sorted suffixes.

Every 50-byte window owns one anchor: the 24-byte gram in it of least hash, leftmost among equals.  Equal windows own
equal anchors, so only suffixes that start at anchors are sorted, and only those whose anchor gram some other document
has too.  Each task sorts its suffixes and sends front-coded runs to the grams' partitions; there loser trees merge the
runs by the common prefixes they already know and never compare those bytes again.  Neighbours that share less than a
gram part groups; in a group, windows are compared whole and all but the least document's are removed.  What repeats
inside a task's own run is settled there, and one witness is sent.  A gram that stands in very many places (``HOT``, say at
the edge of a passage, with another text before it each time) would be one task's group: its suffixes are not merged,
their windows go by a cryptographic digest of the 50 bytes to all tasks, each run's least document only.

Null text: empty.  Texts under 50 bytes lose nothing, very long ones are taken whole.  An id is a key: rows that repeat
one must repeat its text and are treated alike; rows with a null id neither lose bytes nor count as earlier documents.
An empty table has no spans; other columns don't enter, whatever their names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.shared_keys import doc_bucket, layout, pack, shared_keys, split, unpack
from assayer.llm.words import as_bytes, mix

LENGTH, GRAM = 50, 24
#: Suffixes of a run.
RUN = 1 << 17
#: Places that make a gram hot, at least; and hot grams at most: where there would be more, more places make one.
HOT, MOST_HOT = 20_000, 100_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on (the last 23 places have none)."""
    h, width = _BYTE[data], 1
    for _ in range(3):
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        width *= 2
    eight = h
    h = eight[:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[8:]
    return mix(h[:-8] * np.uint64(0x165667B19E3779F9) + eight[16:])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts one after the other: bytes, text bounds; and for each run of windows with one anchor the anchor's
    place, first and last window, and gram hash."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, bounds, none, none, none, np.zeros(0, np.uint64)
    h = _gram_hashes(data)
    # The hash above the place: of equal hashes the leftmost is the least.
    least, width, want = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - GRAM + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int32)
    ok = np.zeros(len(at), dtype=bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ok[a : max(a, b - LENGTH + 1)] = True
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    starts = [b for b in bounds[:-1].tolist() if b < len(ok) and ok[b]]
    new[starts] = True
    first = np.flatnonzero(new)
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | new[1:]
    last = np.flatnonzero(stop)
    place = at[first].astype(np.int64)
    return data, bounds, place, first, last, h[place]


def _extract(held):
    texts = [as_bytes(r[1]) for r in held]
    _, bounds, place, _, _, h = anchors(texts)
    row = np.searchsorted(bounds, place, side="right") - 1
    ids = np.array([r[0] or 0 for r in held], dtype=np.int64)
    return h, row, (place - bounds[row]).astype(np.uint32), ids, np.array([r[0] is not None for r in held]), None


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on ``known`` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(items: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, left context, doc, place): prefixes shared with the item before are left out."""
    shared, before = [], b""
    for x in items:
        shared.append(common_prefix(before, x[0], 0))
        before = x[0]
    rest = b"".join(x[0][c:] for x, c in zip(items, shared))
    left = b"".join(x[1] for x in items)
    u8 = lambda v: np.array(v, dtype=np.uint8)
    return pack(u8(shared), u8([len(x[0]) for x in items]), u8([len(x[1]) for x in items]), np.array([x[2] for x in items], np.int64), np.array([x[3] for x in items], np.int32), np.frombuffer(rest, np.uint8), np.frombuffer(left, np.uint8))


def front_decode(blob: bytes):
    """Items of a run as (prefix shared with the item before, suffix, left context, doc, place)."""
    shared, size, left_size, docs, places, rest, left = unpack(blob)
    rest, left, a, b, before = rest.tobytes(), left.tobytes(), 0, 0, b""
    for c, n, m, d, p in zip(shared.tolist(), size.tolist(), left_size.tolist(), docs.tolist(), places.tolist()):
        before = before[:c] + rest[a : a + n - c]
        yield c, before, left[b : b + m], d, p
        a, b = a + n - c, b + m


def merge(runs: list):
    """Items of sorted runs in order, each with the length of the prefix it shares with the one before.  A loser tree:
    every entry keeps the prefix it shares with the last winner, so of two entries the one that shares more is the
    smaller, and only on equal lengths are bytes compared, from there on."""
    size = 1
    while size < len(runs):
        size *= 2
    feeds = [iter(r) for r in runs]
    heads: list = [next(f, None) for f in feeds] + [None] * (size - len(runs))
    lcp = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        s, t, known = x[1], y[1], lcp[a]
        n = common_prefix(s, t, known)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    tree, level = [0] * size, list(range(size))
    at = size // 2
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            w, loser = play(level[i], level[i + 1])
            tree[at + i // 2] = loser
            up.append(w)
        level, at = up, at // 2
    top = level[0]
    while heads[top] is not None:
        item = heads[top]
        yield (lcp[top], *item[1:])
        heads[top] = nxt = next(feeds[top], None)
        lcp[top] = nxt[0] if nxt is not None else 0
        node = (size + top) // 2
        while node:
            w, tree[node] = play(top, tree[node])
            top, node = w, node // 2


def settle(group: list[tuple[bytes, bytes, int, int]]):
    """(doc, from, to) of windows in a group of one gram that a lesser document holds too."""
    least: dict[tuple[bytes, bytes], int] = {}
    for suffix, left, doc, _ in group:
        key = (suffix, left)
        if least.get(key, doc) >= doc:
            least[key] = doc
    alone = []
    for item in group:
        suffix, left, doc, place = item
        if least[suffix, left] < doc:
            yield doc, place, place + len(left) + len(suffix)
        else:
            alone.append(item)
    if len(least) == 1:
        return
    if len(alone) == 2:
        # Two contexts share one stretch around the gram: what agrees to its left and from it on.
        a, b = alone if alone[0][2] < alone[1][2] else alone[::-1]
        if a[2] < b[2]:
            right = common_prefix(a[0], b[0], GRAM)
            back = common_prefix(a[1][::-1], b[1][::-1], 0)
            if back + right >= LENGTH:
                yield b[2], b[3] + len(b[1]) - back, b[3] + len(b[1]) + right
        return
    first: dict[bytes, int] = {}
    for suffix, left, doc, _ in alone:
        s = left + suffix
        for q in range(len(s) - LENGTH + 1):
            w = s[q : q + LENGTH]
            if first.get(w, doc) >= doc:
                first[w] = doc
    for suffix, left, doc, place in alone:
        s, at = left + suffix, -1
        n = len(s) - LENGTH + 1
        for q in range(n + 1):
            hit = q < n and first[s[q : q + LENGTH]] < doc
            if hit and at < 0:
                at = q
            elif not hit and at >= 0:
                yield doc, place + at, place + q - 1 + LENGTH
                at = -1


_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
_RUN, _SPANS, _WINDOWS = 0, 1, 2


def _spans_out(spans: list | np.ndarray, n: int, targets: np.ndarray) -> list:
    if not len(spans):
        return []
    a = np.array(spans, dtype=np.int64)
    bucket = doc_bucket(a[:, 0], n)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(int(targets[b]), _SPANS, pack(*(np.ascontiguousarray(a[order[at[b] : at[b + 1]], j]) for j in range(3)))) for b in np.flatnonzero(np.diff(at)).tolist()]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the byte spans to remove, ascending and apart, as int32 pairs; documents that lose none are absent."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, subs = layout(df, 8)
    targets = common.partition_keys(n)
    # There is an anchor for a dozen bytes or so; text is stored in a half of its size, or less.
    size = common.plan_bytes(df)
    table = common.save(shared_keys(rows, _extract, n, subs, bits=48, keep_key=False, hot=max(HOT, size // (4 * MOST_HOT) if size < 1 << 60 else 0)), "anchors")
    keys = table.where("shared is not null").select("doc_id", "shared")
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in table.where("shared is null").select("d1").collect()], np.int64).view(np.uint64)))  # MOST_HOT by order of size
    common.release(spark)

    def sort_runs(it):
        held: dict[tuple[bytes, bytes], list] = {}
        warm: dict[tuple[bytes, bytes], list] = {}
        count = 0

        def windows():
            """Spans that a lesser document of the run has too, and rows of the windows that are left."""
            spans, least, rows = [], {}, []
            for (suffix, left), found in warm.items():
                s, first = left + suffix, min(x[0] for x in found)
                marks = [hashlib.blake2b(s[q : q + LENGTH], digest_size=16).digest() for q in range(len(s) - LENGTH + 1)]
                for doc, place in found:
                    if doc != first:
                        spans.append((doc, place, place + len(s)))
                        continue
                    for q, mark in enumerate(marks):
                        rows.append((mark, doc, place + q))
                        if least.get(mark, doc) >= doc:
                            least[mark] = doc
            warm.clear()
            spans += [(doc, p, p + LENGTH) for mark, doc, p in rows if doc != least[mark]]
            rows = [r for r in rows if r[1] == least[r[0]]]
            if not rows:
                return spans, []
            marks = np.frombuffer(b"".join(r[0] for r in rows), np.uint64).reshape(-1, 2)
            a, b = np.ascontiguousarray(marks[:, 0]), np.ascontiguousarray(marks[:, 1])
            doc, place = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int32)
            return spans, [(int(targets[t]), _WINDOWS, pack(a[at], b[at], doc[at], place[at])) for t, at in split((a % np.uint64(n)).astype(np.int64), n)]

        def flush():
            spans, sent = windows()
            out = [[] for _ in range(n)]
            for (suffix, left), found in held.items():
                least = min(x[0] for x in found)
                for doc, place, b in found:
                    if doc == least:
                        out[b].append((suffix, left, doc, place))
                    else:
                        spans.append((doc, place, place + len(left) + len(suffix)))
            held.clear()
            sent += _spans_out(spans, n, targets)
            for b, items in enumerate(out):
                if items:
                    items.sort()
                    sent.append((int(targets[b]), _RUN, front_code(items)))
            return sent

        for part in common.chunks(it, lambda r: len(r[2] or "") + 64, 1 << 20):
            data, bounds, place, first, last, h = anchors([as_bytes(r[2]) for r in part])
            row = np.searchsorted(bounds, place, side="right") - 1
            own = [np.frombuffer(r[1], np.uint32).astype(np.int64) + b for r, b in zip(part, bounds[:-1])]
            keep = np.isin(place, np.concatenate(own)) if own else np.zeros(len(place), bool)
            raw = data.tobytes()
            bucket = (mix(h[keep]) % np.uint64(n)).tolist()
            known, low = hot.value, (h[keep] >> np.uint64(16)) << np.uint64(16)
            many = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low if len(known) else np.zeros(len(low), bool)
            for a, p, q, i, b, m in zip(place[keep].tolist(), first[keep].tolist(), last[keep].tolist(), row[keep].tolist(), bucket, many.tolist()):
                if m:
                    warm.setdefault((raw[a : q + LENGTH], raw[p:a]), []).append((part[i][0], p - int(bounds[i])))
                else:
                    held.setdefault((raw[a : q + LENGTH], raw[p:a]), []).append((part[i][0], p - int(bounds[i]), b))
            count += int(keep.sum())
            if count >= RUN:
                yield from common.batches(flush(), _ROWS, 256)
                count = 0
        if held or warm:
            yield from common.batches(flush(), _ROWS, 256)

    def merge_runs(it):
        runs, digests = [], []
        for b in it:
            forward = []
            for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                if kind == _WINDOWS:
                    digests.append(unpack(blob))
                else:
                    runs.append(blob) if kind == _RUN else forward.append((bucket, kind, blob))
            yield from common.batches(forward, _ROWS, 256)
        if digests:
            x, y, doc, place = (np.concatenate(c) for c in zip(*digests))
            digests.clear()
            order = np.lexsort((doc, y, x))
            x, y, doc, place = x[order], y[order], doc[order], place[order]
            start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            later = doc != np.repeat(doc[start], np.diff(np.append(start, len(doc))))
            at = place[later].astype(np.int64)
            yield from common.batches(_spans_out(np.stack([doc[later], at, at + LENGTH], axis=1), n, targets), _ROWS, 256)
        group: list = []
        spans: list = []
        for lcp, suffix, left, doc, place in merge([front_decode(r) for r in runs]) if runs else ():
            if lcp < GRAM:
                if len(group) > 1:
                    spans.extend(settle(group))
                group = []
                if len(spans) > 1 << 17:
                    yield from common.batches(_spans_out(spans, n, targets), _ROWS, 256)
                    spans = []
            group.append((suffix, left, doc, place))
        spans.extend(settle(group))
        yield from common.batches(_spans_out(spans, n, targets), _ROWS, 256)

    def by_document(it):
        cols: list = [[], [], []]
        for b in it:
            for blob in b.column(2).to_pylist():
                for c, x in zip(cols, unpack(blob)):
                    c.append(x)
        if not cols[0]:
            return
        doc, start, end = (np.concatenate(c) for c in cols)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        ids, first = np.unique(doc, return_index=True)
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary())])

        def rows_of():
            for d, a, b in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(doc)]):
                s, e = start[a:b], np.maximum.accumulate(end[a:b])
                cut = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                yield d, np.stack([s[cut], e[np.append(cut[1:] - 1, len(s) - 1)]], axis=1).astype(np.int32).tobytes()

        yield from common.batches(rows_of(), schema, 1024)

    joined = rows.where("doc_id is not null").join(keys.withColumnRenamed("doc_id", "k"), F.col("doc_id") == F.col("k")).select("doc_id", "shared", "text")
    runs = joined.mapInArrow(sort_runs, "bucket int, kind byte, blob binary").repartition(n, "bucket").mapInArrow(merge_runs, "bucket int, kind byte, blob binary")
    spans = common.save(runs.repartition(n, "bucket").mapInArrow(by_document, "doc_id long, spans binary"), "spans")
    common.release(spark)
    return spans


def cut(raw: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of spans."""
    if not spans:
        return raw, 0
    pairs, out, at = np.frombuffer(spans, np.int32).reshape(-1, 2).tolist(), [], 0
    for a, b in pairs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), len(pairs)


def with_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``df`` and one of spans, and that one's name."""
    p = common.prefix(df)
    spans = repeated_spans(df, id_col, text_col).toDF(f"{p}key", f"{p}spans")
    return df.join(spans, F.col(id_col).cast("long") == F.col(f"{p}key"), "left").drop(f"{p}key"), f"{p}spans"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeats taken out of its text; a character that loses some of its bytes goes whole."""
    (joined, spans), names = with_spans(df, id_col, text_col), df.columns

    def run(it):
        for b in it:
            texts = [None if t is None else cut(as_bytes(t), s)[0].decode("utf-8", "ignore") for t, s in zip(b.column(text_col).to_pylist(), b.column(spans).to_pylist())]
            cols = [pa.array(texts, pa.string()) if f == text_col else b.column(f) for f in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, df.schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(it):
        for b in it:
            out = []
            for d, t, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", spans))):
                raw = as_bytes(t)
                left, n = cut(raw, s)
                out.append((d, len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            yield from common.batches(out, schema)

    joined, spans = with_spans(df)
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
