"""Which hashed keys of a set occur in some other set too, without moving texts.

A set is named by the id of its document.  Tasks sort their keys and send
delta-coded runs to the keys' partitions.  A key that a run already has in two sets is known to be shared and goes as
one witness, however often it occurs, so a key that a third of all sets hold costs a row a run.  Answers travel packed
by set.  Sets that repeat an id must repeat their keys; rows without an id have no shared keys.

Partitions are bounded in number.  What a partition holds beyond its size is split inside its task: runs are put
together again after the exchange, cut by sub-partition, and sorted by Spark, which spills; so exchanged pieces don't
shrink without end as the input grows."""

from __future__ import annotations

import math
import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm import common
from assayer.llm.words import mix

#: Keys that a task holds before it sends a run.
RUN = 1 << 19
#: Rows whose ids, sizes and digests a task holds before it sends them.
ROWS_HELD = 1 << 16
_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("sub", pa.int32()), ("blob", pa.binary())])
ROWS = "bucket int, kind byte, sub int, blob binary"
FIELDS = "doc_id long, size long, d1 long, d2 long, shared binary"
WITNESS, ASKING, FOUND, DOCUMENT, SET, HOT = 0, 1, 2, 3, 4, 5


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, byte planes compressed together."""
    import zstandard

    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cBq", a.dtype.kind.encode(), a.itemsize, len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return head + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n = blob[0]
    heads = [struct.unpack_from("<cBq", blob, 1 + 10 * i) for i in range(n)]
    body, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1 + 10 * n :]), dtype=np.uint8), 0, []
    for kind, size, length in heads:
        out.append(np.ascontiguousarray(body[at : at + size * length].reshape(size, length).T).view(f"{kind.decode()}{size}").reshape(length))
        at += size * length
    return out


def split(bucket: np.ndarray, n: int):
    """Places of each bucket's members, in order of the bucket."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(at)).tolist():
        yield b, order[at[b] : at[b + 1]]


def spread(keys: np.ndarray, n: int) -> np.ndarray:
    """The number below ``n`` of each key's part."""
    return (mix(keys.view(np.uint64) if keys.dtype != np.uint64 else keys) % np.uint64(n)).astype(np.int64)


def doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    return spread(docs.astype(np.int64), n)


def layout(df: DataFrame, mb: float) -> tuple[int, int]:
    """Partitions, and sub-partitions in each, so that one of these holds about ``mb`` of the stored input."""
    n, size = common.parts(df, mb), common.plan_bytes(df)
    return n, max(1, math.ceil(size / (mb * 1e6) / n)) if size < 1 << 60 else 1


def _encode(kind: int, arrays: list[np.ndarray]) -> bytes:
    """Keys of runs ascend and go as differences."""
    if kind in (ASKING, WITNESS):
        order = np.argsort(arrays[0], kind="stable")
        arrays = [a[order] for a in arrays]
        return pack(np.diff(arrays[0], prepend=np.uint64(0)), *arrays[1:])
    return pack(*arrays)


def _decode(kind: int, blob: bytes) -> list[np.ndarray]:
    arrays = unpack(blob)
    return [np.cumsum(arrays[0], dtype=np.uint64), *arrays[1:]] if kind in (ASKING, WITNESS) else arrays


def subdivided(df: DataFrame, n: int, subs: int, kinds: tuple[int, ...]) -> DataFrame:
    """Rows dealt by bucket; those of ``kinds`` split by the sub-partition of their first array, in its order."""
    df = df.repartition(n, "bucket")
    if subs == 1:
        return df

    def resplit(it):
        held: dict[int, list] = {k: [] for k in kinds}
        count, bucket = 0, 0

        def flush():
            for kind, parts in held.items():
                if parts:
                    arrays = [np.concatenate(x) for x in zip(*parts)]
                    for s, at in split(spread(arrays[0], n * subs) // n, subs):
                        yield bucket, kind, s, _encode(kind, [a[at] for a in arrays])
                    parts.clear()

        for b in it:
            forward = []
            for bucket, kind, sub, blob in zip(*(c.to_pylist() for c in b.columns)):
                if kind in held:
                    held[kind].append(_decode(kind, blob))
                    count += len(held[kind][-1][0])
                else:
                    forward.append((bucket, kind, -1, blob))
            if count >= RUN:
                forward += flush()
                count = 0
            yield from common.batches(forward, _ROWS, 256)
        yield from common.batches(flush(), _ROWS, 256)

    return df.mapInArrow(resplit, ROWS).sortWithinPartitions("sub")


def by_sub(it, forward: tuple[int, ...] = ()):
    """(rows to hand on, None) or (None, rows of a sub-partition) from batches in order of the sub-partition."""
    handed: list = []

    def rows():
        for b in it:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[1] in forward:
                    handed.append(r)
                else:
                    yield r

    for _, own in groupby(rows(), key=lambda r: r[2]):
        group: list = []
        for r in own:
            group.append(r)
            if len(handed) >= 256:
                yield list(handed), None
                handed.clear()
        yield None, group
    yield handed, None


def shared_keys(rows: DataFrame, extract, n: int, subs: int = 1, bits: int = 64, keep_key: bool = True, percent: int = 0, hot: int = 0, wanted=None, hand_on: bool = True) -> DataFrame:
    """``extract(rows)`` gives for a list of rows (doc_id, text): keys (uint64), the row number of each and a uint32 for
    each; for each row the id of its set (int64) and whether it has one; and arrays to hand on with each row (doc_id,
    null mark, size, d1, d2), or None.

    Result: a row per set, with ``size`` and ``d1`` its id (``doc_id`` too), ``shared`` holding the shared keys (uint64)
    or, without ``keep_key``, the values given with them (uint32); and, if rows are handed on, a row for each without
    ``shared``.  With ``percent``, only sets of which so much can be shared have a row, though ``extract`` may give a part of
    their keys: not more of these go without a partner than the set can do without; ``d2`` is the number of these.
    ``wanted(ids)`` tells the rows to look at.  Without ``hand_on``, rows aren't handed on.  With ``hot``, keys that stand in
    so many places have a row: ``d1`` the key, ``d2`` the number of places, no ``size``."""
    common.bound_batches(rows.sparkSession)
    targets, shift, total = common.partition_keys(n), np.uint64(64 - bits), n * subs

    def send(keys, sets, values):
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, sets, values = keys[order], sets[order], values[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.minimum.reduceat(sets, start) != np.maximum.reduceat(sets, start)
        local = np.repeat(many, np.diff(np.append(start, len(keys))))
        known = keys if keep_key else values
        for b, at in split(doc_bucket(sets[local], total) % n, n):
            yield int(targets[b]), FOUND, 0, pack(sets[local][at], known[local][at])
        witness = keys[start[many]]
        held = np.diff(np.append(start, len(keys)))[many].astype(np.uint32)
        for b, at in split(spread(witness, total) % n, n):
            yield int(targets[b]), WITNESS, 0, _encode(WITNESS, [witness[at], held[at]])
        keys, sets, values = keys[~local], sets[~local], values[~local]
        for b, at in split(spread(keys, total) % n, n):
            ask = [keys[at], sets[at]]
            yield int(targets[b]), ASKING, 0, _encode(ASKING, ask if keep_key else [*ask, values[at]])

    def look(it):
        for b in it:
            yield b.filter(pa.array(wanted(np.asarray(b.column(0).fill_null(0)).astype(np.int64)))) if wanted else b

    def gather(it):
        held, count = [], 0
        owned, sized, many = [], [], 0

        def flush():
            out = list(send(*(np.concatenate(x) for x in zip(*held)))) if held else []
            held.clear()
            return out

        def of_rows():
            """What is sent of the rows themselves, of many rows at once."""
            if owned:
                own = [np.concatenate(x) for x in zip(*owned)]
                for b, at in split(doc_bucket(own[0], n), n):
                    yield int(targets[b]), DOCUMENT, 0, pack(*(np.ascontiguousarray(x[at]) for x in own))
            if sized:
                own = [np.concatenate(x) for x in zip(*sized)]
                for b, at in split(doc_bucket(own[0], total) % n, n):
                    yield int(targets[b]), SET, 0, pack(*(x[at] for x in own))
            owned.clear()
            sized.clear()

        for part in common.chunks(look(it), lambda r: len(r[1] or "") + 64, 1 << 20):
            keys, row, values, ids, fit, own = extract(part)
            asks = fit[row]
            held.append(((keys[asks] >> shift) << shift, ids[row[asks]], values[asks]))
            count += int(asks.sum()) + len(part)
            out = []
            if own is not None:
                if hand_on:
                    owned.append(own)
                sized.append((ids[fit], own[2][fit], np.bincount(row, minlength=len(part)).astype(np.uint32)[fit]))
                many += len(part)
                if many >= ROWS_HELD:
                    out += of_rows()
                    many = 0
            if count >= RUN:
                out += flush()
                count = 0
            yield from common.batches(out, _ROWS, 256)
        yield from common.batches([*flush(), *of_rows()], _ROWS, 256)

    def answer(it):
        for handed, group in by_sub(it, (FOUND, DOCUMENT, SET)):
            yield from common.batches(handed or [], _ROWS, 256)
            asked = [_decode(ASKING, r[3]) for r in group or () if r[1] == ASKING]
            counted = [_decode(WITNESS, r[3]) for r in group or () if r[1] == WITNESS]
            witnesses = [x[0] for x in counted]
            if hot and counted:
                # Without a witness a key stands in one set a run, which is too few to be hot.
                seen = [*witnesses, *(x[0] for x in asked)]
                each, at = np.unique(np.concatenate(seen), return_inverse=True)
                number = np.bincount(at, np.concatenate([*(x[1] for x in counted), *(np.ones(len(x[0])) for x in asked)]), minlength=len(each))
                much = number >= hot
                if much.any():
                    yield from common.batches([(int(targets[0]), HOT, -1, pack(each[much], number[much].astype(np.int64)))], _ROWS, 256)
            if not asked:
                continue
            group.clear()
            cols = [np.concatenate(x) for x in zip(*asked)]
            asked.clear()
            order = np.argsort(cols[0], kind="stable")
            keys, sets, back = cols[0][order], cols[1][order], cols[0 if keep_key else 2][order]
            del cols, order
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            many = np.minimum.reduceat(sets, start) != np.maximum.reduceat(sets, start)
            if witnesses:
                w = np.unique(np.concatenate(witnesses))
                many |= w[np.minimum(np.searchsorted(w, keys[start]), len(w) - 1)] == keys[start]
            hit = np.repeat(many, np.diff(np.append(start, len(keys))))
            sets, back = sets[hit], back[hit]
            out = ((int(targets[b]), FOUND, 0, pack(sets[at], back[at])) for b, at in split(doc_bucket(sets, total) % n, n))
            yield from common.batches(out, _ROWS, 256)

    def by_set(it):
        schema = pa.schema([(f.split()[0], pa.binary() if "binary" in f else pa.int64()) for f in FIELDS.split(", ")])
        for handed, group in by_sub(it, (DOCUMENT, HOT)):
            for _, kind, _, blob in handed or ():
                if kind == HOT:
                    key, number = unpack(blob)
                    none = pa.nulls(len(key), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(key.view(np.int64)), pa.array(number), pa.nulls(len(key), pa.binary())], schema=schema)
                    continue
                doc, null, size, d1, d2 = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(size.astype(np.int64)), pa.array(d1), pa.array(d2), pa.nulls(len(doc), pa.binary())], schema=schema)
            found = [unpack(r[3]) for r in group or () if r[1] == FOUND]
            sizes = [unpack(r[3]) for r in group or () if r[1] == SET]
            if not found and not (sizes and percent):
                continue
            group.clear()
            if not found:
                found.append([np.zeros(0, np.int64), np.zeros(0, np.uint64 if keep_key else np.uint32)])
            sets, back = (np.concatenate(x) for x in zip(*found))
            found.clear()
            order = np.lexsort((back, sets))
            sets, back = sets[order], back[order]
            new = np.ones(len(sets), bool)
            new[1:] = (sets[1:] != sets[:-1]) | (back[1:] != back[:-1])
            sets, back = sets[new], back[new]
            ids = np.unique(sets)
            size = mine = np.zeros(len(ids), np.int64)
            if sizes:
                known, at = np.unique(np.concatenate([x[0] for x in sizes]), return_index=True)
                ids = known if percent else ids
                size, mine = (np.concatenate([x[j] for x in sizes])[at].astype(np.int64)[np.searchsorted(known, ids)] for j in (1, 2))
            first, last = np.searchsorted(sets, ids), np.searchsorted(sets, ids, side="right")
            able = np.flatnonzero((size > 0) & (100 * (mine - (last - first)) <= (100 - percent) * size)) if percent else np.arange(len(ids))
            yield from common.batches(((d, m, d, g, back[a:b].tobytes()) for d, m, g, a, b in zip(ids[able].tolist(), size[able].tolist(), mine[able].tolist(), first[able].tolist(), last[able].tolist())), schema, 1024)

    asked = subdivided(rows.mapInArrow(gather, ROWS), n, subs, (ASKING, WITNESS))
    return subdivided(asked.mapInArrow(answer, ROWS), n, subs, (FOUND, SET)).mapInArrow(by_set, FIELDS)
