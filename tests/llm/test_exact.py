"""Texts made so that their hashes collide: results rest on words and lines, not on hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import line_dedup, ngram_join
from assayer.llm.words import Words

# Two words of one hash under seed 0.
ONE, OTHER = "lipc4ouvu4tbr7u3", 'dygyd7vt"qjq6nl>'


def test_colliding_shingles_of_one_text_lose_no_link(spark):
    w = Words([f"{ONE} {OTHER}".encode()])
    assert w.hash[0] == w.hash[1]
    text = f"{ONE} a b {OTHER} a b w0 w1 w2 w3 w4"
    rows = [(1, text, 0), (2, f"{text} zz", 0), (3, None, 0), (4, f"{ONE} a b c", 0), (5, f"{OTHER} a b c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").withColumn("shared", F.lit("x")).withColumn("_k", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_sets(df).collect()}
    assert got == {1: (9, 1), 2: (10, 1), 3: (0, 3), 4: (2, 4), 5: (2, 5)}


def test_words_are_compared_byte_by_byte():
    texts = [b"abc abd abc x" + b"y" * 200, b"x" + b"y" * 200 + b" x" + b"y" * 199 + b"z 12345678 123456789 12345678"]
    w = Words(texts)
    n = np.arange(len(w.hash))
    words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
    a, b = (x.ravel() for x in np.meshgrid(n, n))
    assert w.same(a, b).tolist() == [words[i] == words[j] for i, j in zip(a, b)]
    assert w.window_words(3).tolist() == [0, 1, 4, 5, 6]


_MASK, _P1, _P2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F


def _round(acc, lane):
    acc = (acc + lane * _P2) & _MASK
    return (((acc << 31) | (acc >> 33)) & _MASK) * _P1 & _MASK


def colliding_lines():
    """Two ASCII lines of 64 letters with one xxhash64 under the seed 42: a lane's second word undoes what its first one
    changed."""
    start, tail = (42 + _P1 + _P2) & _MASK, "k" * 24
    second = int.from_bytes(b"quietly.", "little")
    for n in range(100_000):
        one, two = b"morning!", f"{n:08d}".encode()
        a, b = (_round(start, int.from_bytes(x, "little")) for x in (one, two))
        undone = ((second + (a - b) * pow(_P2, -1, 1 << 64)) & _MASK).to_bytes(8, "little")
        if all(33 <= c < 127 for c in undone):
            return [(x + tail.encode() + y + tail.encode()).decode() for x, y in ((one, second.to_bytes(8, "little")), (two, undone))]


def test_unrelated_lines_of_one_hash_stay(spark):
    line, other = colliding_lines()
    hashes = spark.createDataFrame([(line,), (other,)], "x string").select(F.xxhash64("x"), F.xxhash64("x", F.lit(1))).collect()
    assert line != other and hashes[0] == hashes[1]
    rows = [(i, "s", f"own {i}\n{line}" if i < 10 else f"own {i}" if i < 19 else f"own {i}\n{other}") for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"), F.col("source")).collect()}
    assert got[0] == "own 0" and got[19] == f"own 19\n{other}"


def test_a_column_of_that_name_is_refused(spark):
    df = spark.createDataFrame([(1, "s", "a")], "doc_id long, source string, text string")
    with pytest.raises(ValueError, match="already"):
        line_dedup.drop_lines(df, F.col("source"), extra="DOC_ID")
