"""What a header scan holds and reads: strings that aren't kept, the share of expected keys, fewer columns, filters."""

import os
import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from assayer.sources import gguf
from assayer.sources.gguf import Limits, read_header
from tests.test_gguf import model, scan

BIG = 16 << 20


def at(path, raw):
    path.write_bytes(raw)
    return str(path)


def test_a_long_string_that_is_not_kept_is_never_held(tmp_path):
    p = at(tmp_path / "m", model([("a.long", 8, "é" * (BIG // 2)), ("tokenizer.chat_template", 8, "{{ x }}")]))
    tracemalloc.start()
    row = read_header(p, Limits(retained_bytes=1 << 20, essential_bytes=1 << 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row[-2] is None and row[15] == ["a.long"] and row[13] == "{{ x }}" and row[16] > BIG
    assert peak < 4 << 20


@pytest.mark.parametrize("cut", [1, 2, 3, (64 << 10) - 1, (64 << 10) + 1])
def test_strings_that_are_not_kept_are_checked_across_pieces(tmp_path, cut):
    good = ("x" * ((64 << 10) - cut) + "é日𝄞" * 4 + "y" * 100).encode()
    small = {"retained_bytes": 1000, "essential_bytes": 500}
    assert scan(tmp_path, model([("a.b", 8, good)]), **small)[1] is None
    for bad in (good[:-101], good + b"\xe6\x97", good.replace("日".encode(), b"\xe6\x97x", 1)):
        assert scan(tmp_path, model([("a.b", 8, bad)]), **small)[1] == "validation"


def test_expected_keys_have_a_share_of_their_own(tmp_path):
    """Other keys spend their share; what is expected is kept after them."""
    entries = [(f"a.k{i}", 8, "x" * 900) for i in range(20)] + [("a.n", 4, 7), ("a.list", 9, (4, [1] * 100)), ("tokenizer.chat_template", 8, "t" * 1500), ("general.alignment", 4, 64), ("a.late", 4, 1)]
    row, error = scan(tmp_path, model(entries), retained_bytes=10_000, essential_bytes=2000)
    assert error is None and row[13] == "t" * 1500 and row[8] == 64 and row[9:11] == ("llama", "test")
    assert row[15] == [f"a.k{i}" for i in range(8, 20)] + ["a.list"]  # 8,000 bytes are not of that share, 7,200 are spent
    assert row[5] == len(entries) + 2
    row, error = scan(tmp_path, model([("tokenizer.chat_template", 8, "t" * 1500)]), retained_bytes=10_000, essential_bytes=1000)
    assert error is None and row[13] is None and row[15] == ["tokenizer.chat_template"]


def test_arrays_of_texts_and_flags_and_arrays(tmp_path):
    texts = ("a.texts", 9, (8, ["x" * 30] * 50))
    nested = ("a.nested", 9, (9, [(4, [1, 2]), (8, ["p", "q"])]))
    flags = ("a.flags", 9, (7, [1, 0, 1]))
    row, _ = scan(tmp_path, model([texts, nested, flags]))
    import json

    m = json.loads(row[14])
    assert m["a.texts"] == ["x" * 30] * 50 and m["a.nested"] == [[1, 2], ["p", "q"]] and m["a.flags"] == [True, False, True]
    row, error = scan(tmp_path, model([texts, nested, flags]), retained_bytes=1500, essential_bytes=100)
    assert error is None and row[15] == ["a.texts", "a.nested", "a.flags"]  # what fitted of the texts stays counted
    assert scan(tmp_path, model([("a.flags", 9, (7, [1, 2]))]), retained_bytes=100, essential_bytes=90)[1] == "validation"
    cut = model([("a.list", 9, (4, [1] * 1000))], tail=0)[:-40]
    assert scan(tmp_path, cut, retained_bytes=100, essential_bytes=90)[1] == "truncated"


def test_the_metadata_limit_is_one_of_entries(tmp_path):
    raw = model([("a.b", 8, "x" * 100)], [(f"tensor.{i:04}", [8], 0, 32 * i) for i in range(200)])
    assert scan(tmp_path, raw, metadata_bytes=400)[1] is None and scan(tmp_path, raw, metadata_bytes=100)[1] == "limit"


@pytest.fixture(scope="module")
def fleet(tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    for i in range(60):
        (root / f"d{i % 3}").mkdir(exist_ok=True)
        tensors = [(f"t{j}", [8], 0, 32 * j) for j in range(2000)]
        (root / f"d{i % 3}" / f"m{i:02}").write_bytes(model([("a.list", 9, (4, list(range(2000))))], tensors, tail=1 << 17) + b"\0" * i)
    (root / "d0/bad").write_bytes(b"GGUF" + struct.pack("<I", 9))
    return str(root)


def test_fewer_columns_stop_before_the_tensor_descriptors(spark, fleet):
    gguf.register(spark)
    whole = spark.read.format("gguf").load(fleet).where("error_class is null")
    some = spark.read.format("gguf").schema("tensor_count long, architecture string, path string").load(fleet)
    assert sorted(map(tuple, some.where("architecture is not null").collect())) == sorted(map(tuple, whole.select("tensor_count", "architecture", "path").collect()))
    from assayer.sources import places

    fetched, ranged = [], places.Ranged
    places.Ranged = type("Seen", (ranged,), {"__init__": lambda self, *a: (ranged.__init__(self, *a), fetched.append(self))[0]})
    try:
        for wanted in (None, ["path", "architecture"]):
            read_header(f"{fleet}/d0/m00", Limits(retained_bytes=1000, essential_bytes=500), wanted)
    finally:
        places.Ranged = ranged
    assert fetched[1].fetched < fetched[0].fetched / 2
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("gguf").schema("nothing string").load(fleet).collect()


def test_filters_on_paths_and_sizes_reach_the_scan(spark, fleet):
    gguf.register(spark)
    every = spark.read.format("gguf").load(fleet)
    plain = spark.createDataFrame(every.select("path", "file_size", "architecture", "alignment").collect())
    size = os.path.getsize(f"{fleet}/d0/m00")
    path, file_size = F.col("path"), F.col("file_size")
    for condition in (path.endswith("m07"), path == f"{fleet}/d1/m07", path.isin(f"{fleet}/d1/m07", f"{fleet}/d2/m08"), path.startswith(f"{fleet}/d2/"), path.contains("/m1") & (file_size > size + 12), file_size <= size, (F.col("alignment") == 32) & path.contains("1")):
        want = sorted(map(tuple, plain.where(condition).select("path", "architecture").collect()), key=str)
        found = gguf.scan(spark, [fleet], condition, ["path", "architecture"], perPartition="5")
        assert sorted(map(tuple, found.collect()), key=str) == want and want and found.columns == ["path", "architecture"]
        assert found.where(path.endswith("7")).count() == sum(w[0].endswith("7") for w in want) and found.count() == len(want)
    assert gguf.scan(spark, [fleet]).count() == every.count() == 61


def test_files_that_filters_rule_out_are_not_opened(fleet, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = gguf.PushedReader({"path": fleet, "perPartition": 7})
    every = sum(len(p.probed) for p in reader.partitions())
    other = GreaterThan(("alignment",), 1)
    assert list(reader.pushFilters([StringStartsWith(("path",), f"{fleet}/d1/"), GreaterThan(("file_size",), 1 << 40), other])) == [other]
    parts = reader.partitions()
    assert all("/d1/" in p for x in parts for p in x.probed) and sum(len(x.probed) for x in parts) == 20 and every == 61
    opened = []
    monkeypatch.setattr("assayer.sources.places.Local.open", lambda self, path: opened.append(path))
    assert [r for x in parts for r in reader.read(x)] == [] and not opened
    assert list(reader.pushFilters([EqualTo(("path",), f"{fleet}/d1/m07")])) == [] and len(reader.partitions()) == 1
