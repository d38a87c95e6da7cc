"""Long binaries read by ranges give the runs that one reader of the whole file finds, each once."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.operators import runtimes
from assayer.plans.fleets import model_bytes  # noqa: F401  the plans import without a session


def whole_runs(raw):
    return [(m.start(), m[0].decode()) for m in re.finditer(rb"[\x20-\x7e]+", raw)]


def binary(seed, size):
    rng = random.Random(seed)
    raw = bytearray(rng.randbytes(size))
    for i in range(0, size - 100, 997):
        raw[i : i + 30] = b"\0" + f"llama build: {i % 9000 + 1} end".encode()[:28].ljust(28, b".") + b"\0"
    raw[5000:9000] = b"x" * 4000  # a run longer than a range
    return bytes(raw)


@pytest.mark.parametrize("step", [1, 7, 1000, 4096, 10**9])
def test_ranges_split_no_run_and_repeat_none(tmp_path, step):
    raw = binary(1, 12_000)
    (tmp_path / "b").write_bytes(raw)
    got = [r for at in range(0, len(raw), step) for r in runtimes.printable_runs(str(tmp_path / "b"), at, min(at + step, len(raw)))]
    assert got == whole_runs(raw)


def test_an_identity_across_two_ranges_is_found_once(spark, tmp_path):
    raw = bytearray(os.urandom(3 << 20).replace(b"b", b"\0"))
    border = 1 << 20
    said = b"\0llama build: 4321 commit: abcdef1\0"
    raw[border - 10 : border - 10 + len(said)] = said
    (tmp_path / "llama-cli").write_bytes(raw)
    rows = spark.createDataFrame([(str(tmp_path / "llama-cli"), len(raw)), (str(tmp_path / "none"), 5), (str(tmp_path / "empty"), 0)], "runtime string, size long")
    for range_bytes in (1 << 20, 1 << 19, 64 << 20):
        found = [r for r in runtimes.binary_sources(rows, 4, range_bytes).collect() if "4321" in r.text]
        assert [(r.place, "llama build: 4321 commit: abcdef1" in r.text) for r in found] == [(0, True)]
    about, sources = runtimes.read_runtimes(spark, [str(tmp_path / "llama-cli")])
    got = runtimes.identify(about, sources).first()
    assert (got.build, got.method) == (4321, "static_binary_strings")
    assert runtimes.binary_sources(rows.where(F.lit(False))).count() == 0


def test_the_first_identity_of_a_long_file_counts(spark, tmp_path):
    raw = bytearray(b"\0" * (20 << 20))
    for at, n in ((19 << 20, 7), (9 << 20, 5), ((12 << 20) + 3, 6)):
        raw[at : at + 20] = f"\0llama build: {n}\0".encode().ljust(20, b"\0")
    (tmp_path / "llama-server").write_bytes(raw)
    about, sources = runtimes.read_runtimes(spark, [str(tmp_path / "llama-server")])
    assert runtimes.identify(about, sources).first().build == 5
