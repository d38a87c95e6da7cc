"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document is cut into full pieces, each a sequence of its own, and a rest.  Rests are packed group by group: in
descending length each goes to the sequence of least estimated cost (linear plus quadratic in each piece's length, as
attention is) that has room; one that fits nowhere is cut to fill the roomiest.  A group's sequences are as few as its
tokens need, so a group leaves less than one sequence of padding.  Groups are made inside tasks: nothing is shuffled.
Null text is empty and gives a piece of the end id alone; repeated rows are packed apart; a null id is kept.  Of rests of
equal length the earlier row goes first, of sequences of equal cost the earlier one is taken.  Very long texts are full
pieces and a rest; an empty table has no pieces; other columns don't enter, whatever their names."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.pretokens import CHUNK, library_encoder, text_size

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: A group is packed at so many rests.
GROUP = 4096
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_rests(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(rest, start in it, length, sequence, offset) for rests shorter than ``size``."""
    n = -(-sum(lengths) // size)
    room, heap, out = [size] * n, [(0.0, b) for b in range(n)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            aside, chosen = [], None
            while heap:
                cost, b = heapq.heappop(heap)
                if room[b] >= left:
                    chosen = (cost, b)
                    break
                aside.append((cost, b))
            if chosen is None:
                chosen = max(aside, key=lambda x: (room[x[1]], -x[0]))
                aside.remove(chosen)
            cost, b = chosen
            put = min(left, room[b])
            out.append((i, start, put, b, size - room[b]))
            room[b] -= put
            start, left = start + put, left - put
            if room[b]:
                heapq.heappush(heap, (cost + LINEAR * put + QUADRATIC * put * put, b))
            for x in aside:
                heapq.heappush(heap, x)
    return out


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row per piece.  sequence_id: the task's number times 2^33 plus a running number."""
    common.bound_batches(df.sparkSession)
    schema = pa.schema([(f.split()[0], pa.int64()) for f in FIELDS.split(", ")])

    def run(it):
        encode, sequence = library_encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        rests: list = []  # doc_id, start, ids, doc_tokens

        def flush():
            nonlocal sequence
            placed = pack_rests([len(r[2]) for r in rests], size)
            rows = []
            for i, start, n, b, offset in placed:
                doc, first, ids, total = rests[i]
                rows.append((doc, first + start, n, zlib.crc32(ids[start : start + n]), total, sequence + b, offset))
            sequence += max((x[3] for x in placed), default=-1) + 1
            rests.clear()
            return rows

        for held in common.chunks(it, text_size, CHUNK):
            ids, at = encode([r[1] or "" for r in held])
            flat = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            rows = []
            for (doc, _), a, b in zip(held, at[:-1].tolist(), at[1:].tolist()):
                full = (b - a) // size * size
                for s in range(a, a + full, size):
                    rows.append((doc, s - a, size, zlib.crc32(flat[s : s + size]), b - a, sequence, 0))
                    sequence += 1
                if a + full < b:
                    rests.append((doc, full, flat[a + full : b].copy(), b - a))
            if len(rests) >= GROUP:
                rows += flush()
            yield from common.batches(rows, schema)
        yield from common.batches(flush(), schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FIELDS)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
