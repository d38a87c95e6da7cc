"""Finding and classifying targets under folders: by names and first bytes only.

Folders are walked in order: a folder's own files first, then its folders, by name whatever the case.  The driver visits
the first ``PLANNED`` entries; whatever folders are left are visited by tasks, a level at a time, so it never lists a
large tree.  Each entry carries a key of its place in the order, and limits are taken over the ordered union of all."""

from __future__ import annotations

import os
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import RUNTIME_NAMES
from assayer.sources import places
from assayer.tables import save

# Folders that hold no models, the depth of a walk and the files that are looked at.
IGNORED = frozenset({".git", ".hg", ".svn", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "cache", "caches", "env", "node_modules", "venv"})
DEPTH, CANDIDATES = 4, 256
# End of fixed values.

#: Entries that the driver visits before tasks do.
PLANNED = 2000
LISTING = "root int, folder string, entry string, path string, kind string, size long, level int, error string"
_ARROW = pa.schema([("root", pa.int32()), ("folder", pa.string()), ("entry", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("error", pa.string())])


class Target(NamedTuple):
    path: str
    kind: str
    detection_method: str


class Inventory(NamedTuple):
    """What a walk found, and what it left out."""

    targets: list[Target]
    candidates: int
    limit_reached: bool
    links: int
    folders: int


def runtime_name(path: str) -> str:
    name = os.path.basename(path).casefold()
    return name.removesuffix(".exe")


def classify(path: str, opener: str | None = None) -> Target:
    """Symbolic link, missing, folder, not regular, model by its first bytes, runtime by its name, or unknown: the first that holds."""
    at = places.place(path, opener)
    kind = at.look(path).kind
    if kind == places.LINK:
        return Target(path, "unknown", "symlink")
    if kind == places.MISSING:
        return Target(path, "unknown", "missing")
    if kind == places.FOLDER:
        return Target(path, "directory", "directory")
    if kind != places.FILE:
        return Target(path, "unknown", "not_regular")
    try:
        with at.open(path) as f:
            if f.read(4) == b"GGUF":
                return Target(path, "gguf", "magic")
    except OSError:
        return Target(path, "unknown", "unreadable")
    if runtime_name(path) in RUNTIME_NAMES:
        return Target(path, "runtime", "name")
    return Target(path, "unknown", "none")


def visit(at, root: int, folder: str, key: str, level: int, depth: int):
    """Rows of LISTING for a folder's entries, in whatever order they come; one of kind ``unreadable`` if it can't be
    listed.  ``folder`` and ``entry`` sort as the walk goes; a folder that is entered has its own key as ``folder``."""
    try:
        for e in at.entries(folder):
            name = f"{e.name.casefold()}\0{e.name}"
            path = f"{folder.rstrip('/')}/{e.name}"
            if e.kind == places.FOLDER:
                if e.name.casefold() in IGNORED:
                    yield root, key, name, path, "ignored", None, level, None
                elif level >= depth:
                    yield root, key, name, path, "deep", None, level, None
                else:
                    yield root, f"{key}/{name}", "", path, "folder", None, level + 1, None
            elif e.kind in (places.FILE, places.LINK):
                yield root, key, name, path, e.kind, e.size, level, None
    except OSError as e:
        yield root, key, "", folder, "unreadable", None, level, str(e)


def plan(roots: list[str], depth: int, opener: str | None = None, most: int = PLANNED) -> tuple[list[tuple], list[tuple]]:
    """What the driver lists itself: rows of entries, and rows of the folders that are left."""
    left = [(i, "", "", r, "folder", None, 0, None) for i, r in enumerate(roots)]
    rows: list[tuple] = []
    while left and len(rows) < most:
        root, key, _, path, _, _, level, _ = left.pop(0)
        for r in visit(places.place(roots[root], opener), root, path, key, level, depth):
            (left if r[4] == "folder" else rows).append(r)
    return rows, left


def listing(spark: SparkSession, roots: list[str], depth: int = DEPTH, opener: str | None = None, planned: tuple[list, list] | None = None) -> DataFrame:
    """Rows of LISTING for all entries under the roots.  Folders that are left by the plan (``planned``, if it was made
    already) are visited by tasks."""
    rows, left = planned or plan(roots, depth, opener)
    out = spark.createDataFrame(rows, LISTING)
    tasks = 4 * spark.sparkContext.defaultParallelism

    def expand(it):
        for b in it:
            for r in b.to_pylist():
                held = []
                for row in visit(places.place(roots[r["root"]], opener), r["root"], r["path"], r["folder"], r["level"], depth):
                    held.append(row)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)

    todo = spark.createDataFrame(left, LISTING) if left else None
    while todo is not None:  # depth + 1 times at most
        found = save(todo.repartition(tasks).mapInArrow(expand, LISTING), "listing")
        out = out.unionByName(found.where("kind <> 'folder'"))
        todo = found.where("kind = 'folder'")
        if todo.isEmpty():
            todo = None
    return out


def classified(files: DataFrame, opener: str | None = None) -> DataFrame:
    """Targets (path, kind, detection_method) among files (path); tasks read their first bytes."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("detection_method", pa.string())])

    def run(it):
        for b in it:
            found = [classify(p, opener) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found) if found else ([], [], []))], schema=schema)

    return files.select("path").mapInArrow(run, "path string, kind string, detection_method string").where("kind in ('gguf', 'runtime')")


def inventory(spark: SparkSession, roots: list[str], depth: int = DEPTH, most: int = CANDIDATES, opener: str | None = None) -> Inventory:
    """Models and runtimes under folders, by path.  In each folder's walk every regular file is a candidate, and ``most``
    are looked at; a folder deeper than ``depth`` ends the walk after the files beside it.  Either is a limit reached.
    A folder on the way that can't be listed is an error."""
    if not roots:
        return Inventory([], 0, False, 0, 0)
    planned = plan(roots, depth, opener)
    rows = listing(spark, roots, depth, opener, planned)
    ends = rows.where("kind = 'deep'").groupBy("root").agg(F.min("folder").alias("end")).withColumnRenamed("root", "r")
    seen = rows.join(F.broadcast(ends), F.col("root") == F.col("r"), "left").where("end is null or folder <= end").drop("r")  # a row a root
    seen = save(seen, "seen") if planned[1] else seen
    place = F.row_number().over(Window.partitionBy("root").orderBy("folder", "entry"))
    first = seen.where("kind = 'file'").withColumn("place", place).where(F.col("place") <= most + 1)
    first = [r.asDict() for r in first.select("root", "folder", "entry", "path", "place").collect()]  # most + 1 a root
    stops = [(r["root"], r["folder"], r["entry"]) for r in first if r["place"] > most]
    stop = spark.createDataFrame(stops, "r int, f string, e string")
    before = F.col("f").isNull() | (F.struct("folder", "entry") < F.struct("f", "e"))
    other = seen.where("kind <> 'file'").join(F.broadcast(stop), F.col("root") == F.col("r"), "left").where(before)
    kinds = {r.kind: r for r in other.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.struct("root", "folder", "path", "error")).alias("first")).collect()}
    if bad := kinds.get("unreadable"):
        raise OSError(f"can't list {bad.first.path}: {bad.first.error}")
    n = {k: r.n for k, r in kinds.items()}
    chosen = [(r["path"],) for r in first if r["place"] <= most]
    files = spark.createDataFrame(chosen, "path string").repartition(max(1, len(chosen) // 16))
    targets = [Target(*r) for r in classified(files, opener).collect()] if chosen else []
    return Inventory(sorted(targets, key=lambda t: t.path.casefold()), len(chosen), bool(stops) or n.get("deep", 0) > 0, n.get("link", 0), n.get("ignored", 0) + n.get("deep", 0))


def targets(spark: SparkSession, paths: list[str], opener: str | None = None) -> Inventory:
    """Files as they are given, whatever they are; folders walked; by path."""
    each = [classify(p, opener) for p in paths]
    found = inventory(spark, [t.path for t in each if t.kind == "directory"], opener=opener)
    own = [t for t in each if t.kind != "directory"]
    return found._replace(targets=sorted(own + found.targets, key=lambda t: t.path.casefold()))
