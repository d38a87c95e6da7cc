"""A data source for model files: ``spark.read.format("gguf").load(paths)``.

Only headers are read: metadata and tensor descriptors, never tensor data.  A file that cannot be read gives a row with
its error, so one bad file fails no task.  Files are dealt to partitions in groups; limits are options.

Paths are files or folders, local ones or URIs of any Arrow file system; files are read forward by ranges, and arrays that
are not kept are passed over.  Strings that are not kept are checked in pieces and never held.  With a schema of fewer
columns, reading stops where the last of them is known: tensor descriptors are only read for ``tensors``, offsets, errors
and ``bytes_read``, so without these a file whose descriptors are broken looks sound.  ``scan`` pushes conditions on
``path`` and ``file_size`` into the source too: files they rule out are never opened.

Options: path, maxDepth (4), perPartition (64), opener (of ``places.place``), and the limits of ``Limits`` by name."""

from __future__ import annotations

import codecs
import json
import re
import struct
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType

from assayer.functions.scalars import GGML_TYPES
from assayer.sources import places
from assayer.tables import save

# Fixed values of the format.
MAGIC = b"GGUF"
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "B", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY, BOOL = 8, 9, 7
EXPECTED = {"general.alignment": 4, "general.architecture": STRING, "general.file_type": 4, "general.name": STRING, "general.quantization_version": 4, "tokenizer.chat_template": STRING}
U64 = (1 << 64) - 1
# End of fixed values.

SCHEMA = """path string, file_size long, gguf_version int, byte_order string, tensor_count long, metadata_count long, metadata_end long,
tensor_data_offset long, alignment long, architecture string, name string, file_type long, quantization_version long, chat_template string,
metadata string, omitted_metadata_keys array<string>, bytes_read long,
tensors array<struct<name: string, dims: array<decimal(20,0)>, ggml_type: long, rel_offset: decimal(20,0), byte_size: decimal(20,0)>>,
error_class string, error_message string"""


@dataclass(frozen=True)
class Limits:
    metadata_bytes: int = 256 << 20
    retained_bytes: int = 64 << 20
    essential_bytes: int = 16 << 20
    string_bytes: int = 16 << 20
    template_bytes: int = 1 << 20
    array_elements: int = 2_000_000
    array_depth: int = 4
    entries: int = 16_384
    tensors: int = 100_000
    dimensions: int = 4
    name_bytes: int = 1024


class Unreadable(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


#: Strings that aren't kept are checked, and arrays passed over, in pieces of so many bytes.
PIECE = 64 << 10
#: Stands for a value that isn't kept.
GONE = object()


class Header:
    """Reads one header from a ``Ranged`` file, counting every byte against the limits.

    What is kept is counted too: strings by their bytes, numbers by theirs, array entries by eight bytes more each.
    Expected keys draw on a share of their own, so no other key can take their place; a value that doesn't fit is checked
    and left out.  Of an array whose entries don't all fit those that did stay counted."""

    def __init__(self, stream, size: int, limits: Limits):
        self.stream, self.size, self.limits = stream, size, limits
        self.at, self.elements, self.order = 0, 0, "<"
        self.until, self.kept, self.essential = None, 0, 0

    def _room(self, n: int) -> None:
        if self.until is not None and self.at + n > self.until:
            raise Unreadable("limit", "metadata limit exceeded")
        if self.at + n > self.size:
            raise Unreadable("truncated", f"file is truncated at byte {self.at}")

    def take(self, n: int) -> bytes:
        self._room(n)
        data = self.stream.read(n)
        if len(data) != n:
            raise Unreadable("truncated", f"file is truncated at byte {self.at}")
        self.at += n
        return data

    def skip(self, n: int) -> None:
        self._room(n)
        if self.stream.skip(n) != n:
            raise Unreadable("truncated", f"file is truncated at byte {self.at}")
        self.at += n

    def pieces(self, n: int):
        self._room(n)
        while n:
            yield self.take(min(n, PIECE))
            n -= min(n, PIECE)

    def number(self, code: str):
        return struct.unpack(self.order + code, self.take(struct.calcsize(code)))[0]

    def fits(self, n: int, key: str, each: int = 1) -> int:
        """How many of ``each`` things of n bytes are kept; they are counted."""
        if key in EXPECTED:
            if n > self.limits.essential_bytes:
                return 0
            self.essential += n * each
            self.kept += n * each
            return each
        room = self.limits.retained_bytes - self.kept - (self.limits.essential_bytes - self.essential)
        many = each if not n else max(0, min(each, room // n))
        self.kept += n * many
        return many

    def text(self, most: int, keep: str | None = None, counted: bool = False):
        """A string, or GONE if it is of a key (``keep``) and not kept; ``counted``: that is so whatever room there is."""
        n = self.number("Q")
        if n > most:
            raise Unreadable("limit", f"string of {n} bytes exceeds the limit of {most}")
        self._room(n)
        try:
            if not counted and (keep is None or self.fits(n, keep)):
                return self.take(n).decode("utf-8")
            check = codecs.getincrementaldecoder("utf-8")()
            for piece in self.pieces(n):
                check.decode(piece)
            check.decode(b"", final=True)
            return GONE
        except UnicodeDecodeError:
            raise Unreadable("validation", "string is not valid UTF-8") from None

    def value(self, kind: int, key: str, depth: int = 0, gone: bool = False):
        """A value of a key, or GONE.  ``gone``: it stands in an array that isn't kept."""
        if kind == STRING:
            return self.text(self.limits.template_bytes if key == "tokenizer.chat_template" and not depth else self.limits.string_bytes, key, gone)
        if kind == ARRAY:
            return self.array(key, depth, gone)
        if kind not in SCALARS:
            raise Unreadable("type", f"unknown value type {kind}")
        v = self.number(SCALARS[kind])
        if kind == BOOL:
            if v > 1:
                raise Unreadable("validation", "boolean is neither 0 nor 1")
            v = bool(v)
        return v if not gone and self.fits(struct.calcsize(SCALARS[kind]), key) else GONE

    def array(self, key: str, depth: int, gone: bool):
        if depth >= self.limits.array_depth:
            raise Unreadable("limit", "array depth limit exceeded")
        inner, n = self.number("I"), self.number("Q")
        if inner not in SCALARS and inner not in (STRING, ARRAY):
            raise Unreadable("type", f"unknown value type {inner}")
        self.elements += n
        if self.elements > self.limits.array_elements:
            raise Unreadable("limit", "array element limit exceeded")
        width = struct.calcsize(SCALARS[inner]) if inner in SCALARS else 8 if inner == STRING else 12
        self._room(n * width)
        gone = gone or not self.fits(8 * n, key)
        if inner in SCALARS:
            gone = gone or self.fits(width, key, n) < n
            if inner == BOOL:
                flags = []
                for piece in self.pieces(n):
                    if max(piece) > 1:
                        raise Unreadable("validation", "boolean is neither 0 nor 1")
                    flags += [] if gone else [b == 1 for b in piece]
                return GONE if gone else flags
            if gone:
                self.skip(n * width)
                return GONE
            return list(struct.unpack(f"{self.order}{n}{SCALARS[inner]}", self.take(n * width)))
        out, whole = [], not gone
        for _ in range(n):
            v = self.value(inner, key, depth + 1, gone)
            whole = whole and v is not GONE
            if whole:
                out.append(v)
            else:
                out.clear()
        return out if whole else GONE

    def read(self, tensors_too: bool = True) -> dict:
        """All there is, or without ``tensors_too`` what stands before the tensor descriptors."""
        if self.size < 4 or (magic := self.take(4)) != MAGIC:
            raise Unreadable("truncated", "file is truncated before its magic") if self.size < 4 else Unreadable("magic", f"bad magic {magic!r}")
        raw = self.take(4)
        little, big = (int.from_bytes(raw, o) for o in ("little", "big"))
        if little not in (2, 3) and big != 3:
            raise Unreadable("version", f"unsupported version {little}")
        self.order, version = ("<", little) if little in (2, 3) else (">", 3)
        tensor_count, entry_count = self.number("Q"), self.number("Q")
        for n, most, what in ((tensor_count, self.limits.tensors, "tensor"), (entry_count, self.limits.entries, "metadata")):
            if n > most:
                raise Unreadable("limit", f"{what} count {n} exceeds the limit of {most}")
        metadata, omitted, seen = {}, [], set()
        self.until = self.at + self.limits.metadata_bytes
        for _ in range(entry_count):
            key = self.text(self.limits.name_bytes)
            if not _good_key(key):
                raise Unreadable("validation", f"bad metadata key {key!r}")
            if key in seen:
                raise Unreadable("duplicate", f"duplicate metadata key {key}")
            seen.add(key)
            kind = self.number("I")
            if EXPECTED.get(key, kind) != kind:
                raise Unreadable("type", f"{key} has value type {kind}")
            v = self.value(kind, key)
            if v is GONE:
                omitted.append(key)
            else:
                metadata[key] = v
        self.until = None
        alignment = metadata.get("general.alignment", 32)
        if alignment < 8 or alignment & (alignment - 1):
            raise Unreadable("validation", f"alignment {alignment} is not a power of two of 8 or more")
        metadata_end = self.at
        out = {"version": version, "order": "little" if self.order == "<" else "big", "metadata": metadata, "omitted": omitted, "alignment": alignment, "metadata_end": metadata_end, "tensor_count": tensor_count}
        if not tensors_too:
            return out
        tensors, names = [], set()
        for _ in range(tensor_count):
            t = self.tensor(alignment)
            if t[0] in names:
                raise Unreadable("duplicate", f"duplicate tensor {t[0]}")
            names.add(t[0])
            tensors.append(t)
        data = self.at + -self.at % alignment
        if tensors and data > self.size:
            raise Unreadable("truncated", "file is truncated before its tensor data")
        end, last = 0, ""
        for name, _, _, offset, size in sorted(tensors, key=lambda t: (t[3], t[3] + t[4], t[0])):
            if data + offset + size > self.size:
                raise Unreadable("range", f"tensor {name} passes the end of the file")
            if offset < end:
                raise Unreadable("range", f"tensors {last} and {name} overlap")
            end, last = offset + size, name
        return out | {"data": data, "tensors": tensors}

    def tensor(self, alignment: int) -> tuple:
        name, n = self.text(self.limits.name_bytes), self.number("I")
        if not 1 <= n <= self.limits.dimensions:
            raise Unreadable("validation", f"tensor {name} has {n} dimensions")
        dims, kind, offset = [self.number("Q") for _ in range(n)], self.number("I"), self.number("Q")
        if 0 in dims:
            raise Unreadable("validation", f"tensor {name} has a zero-sized dimension")
        if kind not in GGML_TYPES:
            raise Unreadable("type", f"tensor {name} has unknown type {kind}")
        if offset % alignment:
            raise Unreadable("validation", f"offset of tensor {name} breaks the alignment")
        block, size = GGML_TYPES[kind]
        if dims[0] % block:
            raise Unreadable("validation", f"tensor {name} does not fill its blocks")
        total = dims[0] // block * size
        for d in dims[1:]:
            total *= d
        if total > U64:
            raise Unreadable("range", f"size of tensor {name} passes 64 bits")
        return name, dims, kind, offset, total


def _good_key(key: str) -> bool:
    import re

    return re.fullmatch(r"[a-z0-9]+(?:[_-][a-z0-9]+)*(?:\.[a-z0-9]+(?:[_-][a-z0-9]+)*)*", key) is not None


COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.replace("\n", " ").split(", ") if not c.startswith(("dims", "ggml_type", "rel_offset", "byte_size"))]
#: What can't be told before the tensor descriptors are read.
LATE = {"tensor_data_offset", "bytes_read", "tensors", "error_class", "error_message"}


def read_header(path: str, limits: Limits = Limits(), wanted: list[str] | None = None, opener: str | None = None, sizes=None) -> tuple | None:
    """A row for one file, of the columns ``wanted`` (all of SCHEMA).  ``sizes``: tests of the file's size; None if one
    fails."""
    names, row = wanted or COLUMNS, dict.fromkeys(COLUMNS)
    row["path"] = path
    try:
        at = places.place(path, opener)
        entry = at.look(path)
        row["file_size"] = entry.size
        if sizes and not all(test(entry.size) for test in sizes):
            return None
        if entry.kind != places.FILE:
            raise Unreadable("io", "not a regular file")
        if not {*names} <= {"path", "file_size"}:
            with at.open(path) as f:
                header = Header(places.Ranged(f, entry.size), entry.size, limits)
                row |= _facts(header.read(not LATE.isdisjoint(names)), header.at, names)
    except Unreadable as e:
        row |= {"error_class": e.kind, "error_message": str(e)}
    except OSError as e:
        row |= {"error_class": "io", "error_message": str(e)}
    return tuple(row[n] for n in names)


def _facts(h: dict, at: int, names: list[str]) -> dict:
    from decimal import Decimal

    m, tensors = h["metadata"], h.get("tensors")
    return {
        "gguf_version": h["version"], "byte_order": h["order"], "tensor_count": h["tensor_count"], "metadata_count": len(m) + len(h["omitted"]), "metadata_end": h["metadata_end"],
        "tensor_data_offset": h.get("data"), "alignment": h["alignment"], **{k: m.get(f"general.{k}") for k in ("architecture", "name", "file_type", "quantization_version")},
        "chat_template": m.get("tokenizer.chat_template"), "metadata": json.dumps(m, sort_keys=True, ensure_ascii=False) if "metadata" in names else None, "omitted_metadata_keys": h["omitted"], "bytes_read": at,
        "tensors": [(n, [Decimal(x) for x in d], k, Decimal(o), Decimal(b)) for n, d, k, o, b in tensors] if tensors is not None and "tensors" in names else None,
    }


@dataclass
class Files(InputPartition):
    """What a task reads: files as they are given, files of folders, which it probes, and folders, which it walks."""

    paths: list
    probed: list
    folders: list


def _path_test(f):
    """A test of paths for a filter on them, or None."""
    v = getattr(f, "value", None)
    tests = {
        ds.EqualTo: lambda p: p == v, ds.EqualNullSafe: lambda p: p == v, ds.In: lambda p: p in v,
        ds.StringStartsWith: lambda p: p.startswith(v), ds.StringEndsWith: lambda p: p.endswith(v), ds.StringContains: lambda p: v in p, ds.IsNotNull: lambda p: True,
    }
    return tests.get(type(f))


def _size_test(f):
    """A test of sizes, null for what is no file."""
    v = getattr(f, "value", None)
    tests = {ds.EqualTo: lambda s: s == v, ds.GreaterThan: lambda s: s > v, ds.GreaterThanOrEqual: lambda s: s >= v, ds.LessThan: lambda s: s < v, ds.LessThanOrEqual: lambda s: s <= v, ds.IsNotNull: lambda s: True}
    test = tests.get(type(f))
    return test and (lambda s: s is not None and test(s))


class GgufReader(DataSourceReader):
    def __init__(self, options, schema=None):
        self.options = dict(options)
        given = {f.name: int(options[f.name]) for f in fields(Limits) if f.name in options}
        if any(v <= 0 for v in given.values()):
            raise ValueError("limits must be positive")
        self.limits, self.opener, self.filters = Limits(**given), self.options.get("opener"), []
        self.wanted = [f.name for f in schema.fields] if schema is not None else COLUMNS
        if odd := {*self.wanted} - {*COLUMNS}:
            raise ValueError(f"there are no columns {sorted(odd)}")

    def _tests(self, column: str, make) -> list:
        return [make(f) for f in self.filters if f.attribute == (column,)]

    def partitions(self):
        from assayer.sources.discovery import DEPTH, classify, plan

        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        paths, n = [p.removeprefix("file://") if p.startswith("file:///") else p.removeprefix("file:") for p in paths], int(self.options.get("perPartition", 64))
        folders = [p for p in paths if classify(p, self.opener).kind == "directory"] if len(paths) == 1 or "paths" in self.options else []
        rows, left = plan(folders, int(self.options.get("maxDepth", DEPTH)), self.opener)
        tests = self._tests("path", _path_test)
        asked = lambda found: [p for p in found if all(t(p) for t in tests)]
        given, probed = asked([p for p in paths if p not in folders]), asked(sorted(r[3] for r in rows if r[4] == "file"))
        out = [Files(given[i : i + n], [], []) for i in range(0, len(given), n)] + [Files([], probed[i : i + n], []) for i in range(0, len(probed), n)]
        return out + [Files([], [], [(folders[r[0]], r[3], r[6])]) for r in left] or [Files([], [], [])]

    def _walked(self, root: str, folder: str, level: int):
        from assayer.sources.discovery import DEPTH, visit

        at, left = places.place(root, self.opener), [(folder, level)]
        while left:
            folder, level = left.pop()
            for r in visit(at, 0, folder, "", level, int(self.options.get("maxDepth", DEPTH))):
                if r[4] == "folder":
                    left.append((r[3], r[6]))
                elif r[4] == "file":
                    yield r[3]

    def _fits(self, path: str, sizes: list) -> bool:
        size = places.place(path, self.opener).look(path).size
        return all(test(size) for test in sizes)

    def read(self, partition):
        from assayer.sources.discovery import classify

        tests, sizes = self._tests("path", _path_test), self._tests("file_size", _size_test)
        for path in partition.paths:
            if (row := read_header(path, self.limits, self.wanted, self.opener, sizes)) is not None:
                yield row
        for found in (partition.probed, *(self._walked(*f) for f in partition.folders)):
            for path in found:
                if not all(t(path) for t in tests) or (sizes and not self._fits(path, sizes)):
                    continue
                if classify(path, self.opener).kind == "gguf":
                    if (row := read_header(path, self.limits, self.wanted, self.opener, sizes)) is not None:
                        yield row


class PushedReader(GgufReader):
    """Takes filters on path and size."""

    def pushFilters(self, filters):
        for f in filters:
            if (f.attribute == ("path",) and _path_test(f)) or (f.attribute == ("file_size",) and _size_test(f)):
                self.filters.append(f)
            else:
                yield f


class GgufSource(DataSource):
    @classmethod
    def name(cls):
        return "gguf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GgufReader(self.options, schema)


class GgufOnce(GgufSource):
    """The source under the name ``gguf_once``, with filters on path and size pushed into it.  Spark 4.1 keeps the filters
    of a DataFrame's first query for all its later ones, so a DataFrame of this source serves one query only: see ``scan``."""

    @classmethod
    def name(cls):
        return "gguf_once"

    def reader(self, schema):
        return PushedReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GgufSource)


def scan(spark: SparkSession, paths: list[str], where: Column | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """Headers of the files that a condition holds for, with some columns, read once and saved.  Files that conditions on
    path and size rule out are not opened, and of the others no more is read than the columns and the condition need."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GgufOnce)
    names, given = columns or COLUMNS, spark.read.format("gguf_once").options(**options)
    if where is not None:
        tried = spark.createDataFrame([], SCHEMA).where(where)  # which columns the condition is about
        named = {x.strip() for x in re.findall(r"(\w+)#\d+", tried._jdf.queryExecution().analyzed().toString().split("\n")[0])}
        names = [*names, *(n for n in COLUMNS if n in named and n not in names)]
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], SCHEMA).schema}
    found = given.schema(StructType([StructField(n, kinds[n]) for n in names])).load(paths)
    found = found if where is None else found.where(where)
    return save(found.select(*(columns or COLUMNS)), "headers")
