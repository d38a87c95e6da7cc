"""Digests of fleets: bytes are dealt evenly, whatever order and sizes files come in."""

import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.operators import digests


def loads(df):
    """Bytes of each partition."""

    def run(it):
        n = sum(sum(v or 0 for v in b.column("size").to_pylist()) for b in it)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return [r.n for r in df.mapInArrow(run, "n long").collect()]


@pytest.mark.parametrize(
    "sizes,parts",
    [([50_000_000] + [100_000] * 1000, 3), ([50_000_000] + [100_000] * 1000, 8), (list(range(1, 20_000)), 16), ([7] * 5, 16), ([10**9, 10**9, 10**8], 2), ([0] * 100, 4), ([2**40 // (i + 1) for i in range(3000)], 32)],
)
def test_the_longest_task_is_near_the_ideal(spark, sizes, parts):
    df = spark.createDataFrame([(f"/m/{i}", s) for i, s in enumerate(sizes)], "path string, size long").repartition(5)
    dealt = digests.dealt_by_size(df, parts)
    got = loads(dealt)
    assert len(got) == parts and sum(got) == sum(sizes) and dealt.count() == len(sizes)
    assert max(got) <= 1.2 * max(max(sizes), sum(sizes) / parts)


def test_files_of_odd_kinds(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}").write_bytes(os.urandom(i * 1000))
    paths = [str(tmp_path / f"{i}") for i in range(40)] + [str(tmp_path / "3")] + [None, str(tmp_path / "none"), str(tmp_path)]
    got = digests.file_digests(spark.createDataFrame([(p,) for p in paths], "path string"), parts=5).collect()
    assert len(got) == len(paths) and sum(r.path == str(tmp_path / "3") for r in got) == 2
    for r in got:
        if r.path in (None, str(tmp_path / "none"), str(tmp_path)):
            assert r.digest is None and r.error
        else:
            raw = open(r.path, "rb").read()
            assert (r.digest, r.bytes_read, r.error) == (hashlib.sha256(raw).hexdigest(), len(raw), None)


def test_another_scheme_and_no_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 3_000_000)
    got = digests.file_digests(spark.createDataFrame([(f"depot:{tmp_path}/f",)], "path string"), opener="tests.depot:open_depot").first()
    assert got.digest == hashlib.sha256(b"x" * 3_000_000).hexdigest()
    assert digests.file_digests(spark.range(0).select(F.lit("x").alias("path"))).count() == 0
