"""Header scans over files written here."""

import struct

import pytest

from assayer.sources.discovery import classify, targets
from assayer.sources.gguf import GgufSource, Limits, read_header

CODES = {4: "I", 6: "f", 7: "B", 10: "Q"}


def text(s, o="<"):
    raw = s if isinstance(s, bytes) else s.encode()
    return struct.pack(f"{o}Q", len(raw)) + raw


def value(kind, v, o="<"):
    if kind == 8:
        return text(v, o)
    if kind == 9:
        inner, items = v
        return struct.pack(f"{o}IQ", inner, len(items)) + b"".join(value(inner, x, o) for x in items)
    return struct.pack(f"{o}{CODES[kind]}", v)


def model(entries=(), tensors=(), version=2, o="<", counts=None, tail=1 << 14):
    entries = [("general.architecture", 8, "llama"), ("general.name", 8, "test"), *entries]
    n, m = counts or (len(tensors), len(entries))
    out = b"GGUF" + struct.pack(f"{o}IQQ", version, n, m)
    for k, kind, v in entries:
        out += text(k, o) + struct.pack(f"{o}I", kind) + value(kind, v, o)
    for name, dims, kind, offset in tensors:
        out += text(name, o) + struct.pack(f"{o}I{len(dims)}QIQ", len(dims), *dims, kind, offset)
    return out + b"\0" * tail


def scan(tmp_path, raw, **limits):
    p = tmp_path / "m.gguf"
    p.write_bytes(raw)
    row = read_header(str(p), Limits(**limits))
    return row, row[-2]


def test_minimal(tmp_path):
    row, error = scan(tmp_path, model([("tokenizer.chat_template", 8, "{{ x }}"), ("a.list", 9, (9, [(4, [1, 2])])), ("a.flag", 7, 1)], [("t", [32, 4], 2, 0), ("u", [8], 0, 96)]))
    assert error is None and row[2:6] == (2, "little", 2, 5) and row[9:11] == ("llama", "test") and row[13] == "{{ x }}"
    assert [t[4] for t in row[17]] == [72, 32] and row[7] % row[8] == 0


def test_big_endian(tmp_path):
    row, error = scan(tmp_path, model([("general.alignment", 4, 64)], version=3, o=">"))
    assert error is None and row[2:4] == (3, "big") and row[8] == 64


@pytest.mark.parametrize(
    "raw,kind",
    [
        (b"", "truncated"), (b"GG", "truncated"), (b"XXXX" + b"\0" * 40, "magic"), (model(version=1), "version"), (model(version=4), "version"), (model()[:20], "truncated"), (model(tail=0)[:40], "truncated"),
        (model([("general.name", 8, "again")]), "duplicate"), (model([("general.alignment", 4, 12)]), "validation"), (model([("general.alignment", 10, 32)]), "type"), (model([("Bad Key", 4, 1)]), "validation"),
        (model([("a.b", 8, b"\xff\xfe")]), "validation"), (model([("a.b", 7, 2)]), "validation"), (model(counts=(1 << 62, 2)), "limit"), (model(counts=(0, 1 << 62)), "limit"),
        (model(tensors=[("t", [0], 0, 0)]), "validation"), (model(tensors=[("t", [8], 4, 0)]), "type"), (model(tensors=[("t", [8], 0, 8)]), "validation"), (model(tensors=[("t", [33], 2, 0)]), "validation"),
        (model(tensors=[("t", [16], 0, 0), ("u", [16], 0, 32)]), "range"), (model(tensors=[("t", [1 << 40, 1 << 40], 0, 0)]), "range"), (model(tensors=[("t", [1 << 20], 0, 0)]), "range"), (model(tensors=[("t", [8], 0, 0), ("t", [8], 0, 32)]), "duplicate"),
        (model([("a.b", 9, (9, [(9, [(9, [(9, [(9, [(4, [1])])])])])]))]), "limit"),
    ],
)
def test_broken(tmp_path, raw, kind):
    assert scan(tmp_path, raw)[1] == kind


def test_limits(tmp_path):
    assert scan(tmp_path, model(), string_bytes=4)[1] == "limit"
    assert scan(tmp_path, model(), metadata_bytes=32)[1] == "limit"
    row, error = scan(tmp_path, model([("a.long", 8, "x" * 1000)]), retained_bytes=400, essential_bytes=100)
    assert error is None and row[15] == ["a.long"]


def test_source_and_discovery(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "venv").mkdir()
    for p in ("b.gguf", "a/noext", "venv/hidden.gguf"):
        (tmp_path / p).write_bytes(model())
    (tmp_path / "bad.gguf").write_bytes(b"GGUF\1")
    (tmp_path / "llama-cli").write_bytes(b"x")
    (tmp_path / "link.gguf").symlink_to(tmp_path / "b.gguf")
    assert [t.kind for t in targets(spark, [str(tmp_path)]).targets] == ["gguf", "gguf", "gguf", "runtime"]
    assert classify(str(tmp_path / "link.gguf")).detection_method == "symlink"
    spark.dataSource.register(GgufSource)
    rows = spark.read.format("gguf").option("perPartition", 1).load(str(tmp_path)).select("path", "architecture", "error_class").collect()
    assert sorted((r.path.split("/")[-1], r.architecture, r.error_class) for r in rows) == [("b.gguf", "llama", None), ("bad.gguf", None, "truncated"), ("noext", "llama", None)]


def test_arrivals(spark, tmp_path):
    from assayer.streaming.arrivals import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.gguf").write_bytes(model())
    seen = []
    stream = arrivals(spark, str(tmp_path / "in"), lambda rows, n: seen.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert [r.architecture for r in seen] == ["llama"]
