"""Walks of folders: order, limits, ignored names, large trees in tasks, and another scheme."""

import os
import time

import pytest

from assayer.sources import discovery, places
from assayer.sources.gguf import Limits, read_header
from tests import depot
from tests.test_gguf import model

GGUF = b"GGUF" + b"\0" * 16


def tree(root, *paths, data=GGUF):
    for p in paths:
        os.makedirs(os.path.dirname(root / p), exist_ok=True)
        (root / p).write_bytes(data)


def names(found, root):
    return [t.path.removeprefix(f"{root}/") for t in found.targets]


def test_ignored_folders_are_no_candidates(spark, tmp_path):
    tree(tmp_path, *(f".git/{i:03}" for i in range(300)))
    tree(tmp_path, "Cache/m.gguf", "VENV/n.gguf", "ok/m.gguf", "m.gguf")
    found = discovery.targets(spark, [str(tmp_path)])
    assert names(found, tmp_path) == ["m.gguf", "ok/m.gguf"] and not found.limit_reached and found.candidates == 2 and found.folders == 3


def test_a_folder_too_deep_is_a_limit(spark, tmp_path):
    tree(tmp_path, "a/b/c/d/here.gguf", "a/b/c/d/e/deep.gguf", "z/after.gguf")
    found = discovery.targets(spark, [str(tmp_path)])
    assert found.limit_reached and names(found, tmp_path) == ["a/b/c/d/here.gguf"]  # the walk ends where it would go deeper
    assert not discovery.inventory(spark, [str(tmp_path)], depth=5).limit_reached


def test_own_files_come_before_folders(spark, tmp_path):
    tree(tmp_path, *(f"a/{i:03}" for i in range(300)), data=b"x")
    tree(tmp_path, "z.gguf", "B.gguf", "c.gguf")
    found = discovery.targets(spark, [str(tmp_path)])
    assert names(found, tmp_path) == ["B.gguf", "c.gguf", "z.gguf"] and found.limit_reached and found.candidates == 256


def test_links_unreadable_folders_and_given_files(spark, tmp_path):
    tree(tmp_path, "real/m.gguf", "other.txt")
    (tmp_path / "link.gguf").symlink_to(tmp_path / "real/m.gguf")
    (tmp_path / "folder").symlink_to(tmp_path / "real")
    found = discovery.targets(spark, [str(tmp_path), str(tmp_path / "other.txt"), str(tmp_path / "none")])
    assert found.links == 2 and [(t.path.split("/")[-1], t.kind, t.detection_method) for t in found.targets] == [("none", "unknown", "missing"), ("other.txt", "gguf", "magic"), ("other.txt", "gguf", "magic"), ("m.gguf", "gguf", "magic")]
    with pytest.raises(OSError, match="can't list"):
        discovery.inventory(spark, [str(tmp_path / "none")])


def plain_walk(root, depth, most):
    """Files in order, and whether a limit was reached."""
    out, todo, limit = [], [(root, 0)], False
    while todo and not limit:
        folder, level = todo.pop()
        children = []
        for name in sorted(os.listdir(folder), key=lambda n: (n.casefold(), n)):
            path = f"{folder}/{name}"
            if os.path.isdir(path):
                if name.casefold() not in discovery.IGNORED:
                    limit |= level >= depth
                    children += [(path, level + 1)] if level < depth else []
            elif len(out) >= most:
                return out, True
            else:
                out.append(path)
        todo += children[::-1]
    return out, limit


def test_order_and_limits_hold_however_much_the_driver_plans(spark, tmp_path, monkeypatch):
    tree(tmp_path, *(f"{a}{b}/{c}/{d}" for a in "aB" for b in ("", "!", "b") for c in ("x", "X-1", "env") for d in ("1.gguf", "Two", "_3")), "0", "zz", "B/x/y/w/v/far", "m")
    for planned in (1, 7, 2000):
        monkeypatch.setattr(discovery, "PLANNED", planned)
        monkeypatch.setattr(discovery.plan, "__defaults__", (None, planned))
        for depth, most in ((4, 256), (4, 9), (2, 256), (1, 5), (5, 256)):
            want, limit = plain_walk(str(tmp_path), depth, most)
            found = discovery.inventory(spark, [str(tmp_path)], depth, most)
            assert (sorted(t.path for t in found.targets), found.candidates, found.limit_reached) == (sorted(want), len(want), limit)


def test_a_hundred_thousand_files_are_listed_by_tasks(spark, tmp_path):
    for a in range(20):
        for b in range(5):
            os.makedirs(tmp_path / f"{a:02}/{b}")
            for i in range(1000):
                os.close(os.open(tmp_path / f"{a:02}/{b}/{i:04}", os.O_CREAT | os.O_WRONLY))
    (tmp_path / "19/4/model").write_bytes(model())
    rows, left = discovery.plan([str(tmp_path)], 4)
    assert len(rows) < 5000 and len(left) > 50  # what the driver lists stays bounded
    began = time.time()
    listed = discovery.listing(spark, [str(tmp_path)])
    assert listed.where("kind = 'file'").count() == 100_001 and time.time() - began < 60
    assert [r.path for r in discovery.classified(listed.where("kind = 'file'").repartition(8)).collect()] == [str(tmp_path / "19/4/model")]
    found = discovery.targets(spark, [str(tmp_path)])
    assert found.limit_reached and found.candidates == 256


def test_another_scheme_gives_the_same_rows(spark, tmp_path):
    tree(tmp_path, "a/m.gguf", "b/n.gguf", data=model([("a.list", 9, (4, list(range(100_000))))], [("t", [32], 0, 0)], tail=1 << 20))
    opener = "tests.depot:open_depot"
    from assayer.sources import gguf

    gguf.register(spark)
    here = spark.read.format("gguf").load(str(tmp_path)).drop("path").collect()
    there = spark.read.format("gguf").option("opener", opener).load(f"depot:{tmp_path}")
    assert there.drop("path").collect() == here and len(here) == 2
    assert sorted(r.path for r in there.collect()) == [f"depot:{tmp_path}/a/m.gguf", f"depot:{tmp_path}/b/n.gguf"]
    found = discovery.targets(spark, [f"depot:{tmp_path}"], opener)
    assert [t.path for t in found.targets] == [f"depot:{tmp_path}/a/m.gguf", f"depot:{tmp_path}/b/n.gguf"]


def test_what_is_not_kept_is_not_read(tmp_path):
    (tmp_path / "m").write_bytes(model([("a.list", 9, (4, list(range(500_000))))], [("t", [32], 0, 0)], tail=1 << 20))
    read = lambda limits, wanted=None: (depot.READ.__setitem__(0, 0), read_header(f"depot:{tmp_path}/m", limits, wanted, "tests.depot:open_depot"), depot.READ[0])[1:]
    row, much = read(Limits())
    other, little = read(Limits(retained_bytes=1 << 20, essential_bytes=1 << 16))
    assert row[-2] is other[-2] is None and other[15] == ["a.list"] and row[16] == other[16]
    assert 2_000_000 <= much < 2_200_000 and little < 100_000  # never tensor data, and no array that is passed over
    assert read(Limits(), ["path", "file_size"]) == ((f"depot:{tmp_path}/m", os.path.getsize(tmp_path / "m")), 0)


def test_ranges_and_their_budget(tmp_path):
    data = os.urandom(3_000_000)
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb", buffering=0) as f:
        r = places.Ranged(f, len(data), 600_000)
        assert r.read(10) == data[:10] and r.skip(2_000_000) == 2_000_000 and r.read(100_000) == data[2_000_010:2_100_010]
        assert r.fetched < 200_000
        with pytest.raises(OSError, match="more than"):
            r.read(700_000)
    with open(tmp_path / "f", "rb", buffering=0) as f:
        r, out = places.Ranged(f, len(data)), b""
        for n in (1, 7, 100_000, 5, 2_000_000, 1 << 30):
            out += r.read(n)
        assert out == data and r.fetched == len(data) and r.read(5) == b"" and r.skip(9) == 0
