"""What a runtime is, from what lies around it; nothing is executed.

A runtime has sources of identity: given by the user, files nearby, the commit of a git folder, and strings of the binary.
The first source that names a build, a version or a commit is believed, with that source's confidence."""

from __future__ import annotations

import os
import re
import stat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import RUNTIME_NAMES, component, executable_format, identity

# Where identities are looked for, and the forms in which a user may give one.
NEARBY = ("build-info.json", "build-info.txt", "build_info.json", "build_info.txt", "llama-build-info.txt", "llama-version.txt", "version.txt", "build.txt", "CMakeCache.txt")
LEVELS, NEARBY_BYTES, HEAD_BYTES, WINDOW_BYTES, BINARY_BYTES = 4, 64 << 10, 4096, 1 << 20, 64 << 20
GIVEN_BUILD = r"(?i)^\s*(?:build\s*[:= -]?\s*)?b?(\d+)\s*\z"
GIVEN_VERSION = r"(?i)^\s*(?:version\s*[:= -]?\s*)?v?([0-9]+\.[0-9]+(?:\.[0-9]+)?(?:[-+][0-9A-Za-z.-]+)?)\s*\z"
GIVEN_COMMIT = r"(?i)^\s*(?:commit\s*[:= -]?\s*)?([0-9a-f]{7,40})\s*\z"
FLAGS_LINE = r"(?im)^\s*flags?\s*[:=]\s*(.+?)\s*$"
#: Sources in order of belief, with the name of the method and the confidence.
SOURCES = (("given", "explicit_override", "high"), ("nearby", "nearby_build_file", "high"), ("git", "git_metadata", "medium"), ("binary", "static_binary_strings", "low"))
# End of fixed values.
#: Bytes of a file that a task reads, and those read on at a time where a run goes beyond them.
RANGE_BYTES, CARRY_BYTES = 8 << 20, 64 << 10
SOURCE_ROWS = "runtime string, source string, place int, name string, text string"
TELLING = re.compile(r"build|version|llama|commit|revision|rev\b|^\s*b\d+\s*$", re.I | re.M)
_RUN = re.compile(rb"[\x20-\x7e]+")
IDENTITY = "struct<build:bigint,version:string,commit:string>"


def known(i: Column) -> Column:
    return i["build"].isNotNull() | i["version"].isNotNull() | i["commit"].isNotNull()


def given_identity(text: Column) -> Column:
    """A user's word: a build, a version or a commit by its form, else what the text says, else the text as a version."""
    group = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    build, version, commit, said = group(GIVEN_BUILD), group(GIVEN_VERSION), group(GIVEN_COMMIT), identity(F.trim(text))
    only = lambda **k: F.struct(*(k.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("build", "bigint"), ("version", "string"), ("commit", "string"))))
    return F.when(build.isNotNull(), only(build=build)).when(version.isNotNull(), only(version=version)).when(commit.isNotNull(), only(commit=F.lower(commit))).when(known(said), said).when(text.isNotNull(), only(version=F.trim(text)))


def file_identity(name: Column, text: Column) -> Column:
    """Of a nearby file: the typed members of a JSON object if any is of its type, else what the text says."""
    value = F.try_parse_json(text)
    typed = lambda k, kind, cast: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == kind, F.try_variant_get(value, f"$.{k}", cast))
    own = F.struct(typed("build", "BIGINT", "bigint").alias("build"), typed("version", "STRING", "string").alias("version"), F.lower(typed("commit", "STRING", "string")).alias("commit"))
    return F.when(name.endswith(".json") & known(own), own).otherwise(identity(F.trim(text)))


def file_flags(name: Column, text: Column) -> Column:
    """Of a nearby file: a JSON list of texts under flags, else the words of a flags line; null if it has none."""
    raw = F.try_variant_get(F.try_parse_json(text), "$.flags", "variant")
    listed = F.when(name.endswith(".json") & F.schema_of_variant(raw).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(F.try_parse_json(text), "$.flags", "array<string>"))
    line = F.regexp_extract(text, FLAGS_LINE, 1)
    return F.coalesce(listed, F.when(line != "", F.split(line, r"\s+")))


def identify(runtimes: DataFrame, sources: DataFrame, by: str = "runtime") -> DataFrame:
    """runtimes: ``by`` and other columns.  sources: ``by``, source (of ``SOURCES``), place (order among equals), name, text.
    Adds build, version, commit, method, confidence, identified and flags, of the first source that has them.  A user's
    word, once given, is the only source."""
    rank = F.lit(len(SOURCES))
    for i, (name, _, _) in enumerate(SOURCES):
        rank = F.when(F.col("source") == name, i).otherwise(rank)
    said = F.when(F.col("source") == "given", given_identity(F.col("text"))).when(F.col("source") == "nearby", file_identity(F.col("name"), F.col("text"))).otherwise(identity(F.col("text")))
    rows = sources.select(by, rank.alias("rank"), "place", said.alias("i"), F.when(F.col("source") == "nearby", file_flags(F.col("name"), F.col("text"))).alias("flags"))
    order = F.struct("rank", "place")
    best = rows.groupBy(by).agg(F.min_by("i", F.when(known(F.col("i")), order)).alias("i"), F.min(F.when(known(F.col("i")), F.col("rank"))).alias("rank"), F.min_by("flags", F.when(F.col("flags").isNotNull(), order)).alias("flags"))
    pick = lambda j: F.element_at(F.array(*(F.lit(s[j]) for s in SOURCES)), F.col("rank") + 1)
    joined = runtimes.join(best, by, "left")
    out = [F.col(f"`{c}`") for c in runtimes.columns]
    return joined.select(*out, F.col("i.build").alias("build"), F.col("i.version").alias("version"), F.col("i.commit").alias("commit"), F.when(F.col("rank").isNotNull(), pick(1)).otherwise("none").alias("method"), F.when(F.col("rank").isNotNull(), pick(2)).otherwise("low").alias("confidence"), F.col("rank").isNotNull().alias("identified"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


def runtime_component(path: Column) -> Column:
    """The known name of an executable, without .exe, or ``unknown``."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.exe$", "")
    return F.when(F.lower(name).isin(*RUNTIME_NAMES), name).otherwise("unknown")


def posture(runtimes: DataFrame, by: str = "runtime") -> DataFrame:
    """Findings on runtimes (columns error, recognized, identified, mode): an error alone, else what isn't recognized, whose
    build is unknown, and what others may write."""
    f = lambda when, name, check, status, severity: F.when(when, F.struct(F.lit(f"runtime.{name}").alias("id"), F.lit(check).alias("check"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(True).alias("mandatory")))
    fine = F.col("error").isNull()
    found = F.array(
        f(~fine, "inspection_error", "runtime_identity", "error", "info"),
        f(fine & ~F.col("recognized"), "not_recognized", "runtime_identity", "unchecked", "info"),
        f(fine & ~F.col("identified"), "unknown_build", "runtime_identity", "unchecked", "info"),
        f(fine & (F.col("mode").bitwiseAND(stat.S_IWOTH) != 0), "writable_by_others", "runtime_permissions", "suspicious", "medium"),
    )
    return runtimes.select(by, F.explode(F.array_compact(found)).alias("f")).select(by, "f.*")


def read_bounded(path: str, most: int, start: int = 0) -> bytes:
    """Nothing of a link, of what is no file, or of what can't be read."""
    if os.path.islink(path) or not os.path.isfile(path):
        return b""
    try:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(most)
    except OSError:
        return b""


def folders_around(path: str) -> list[str]:
    out = [os.path.dirname(os.path.realpath(path))]
    while len(out) <= LEVELS and os.path.dirname(out[-1]) != out[-1]:
        out.append(os.path.dirname(out[-1]))
    return out


def git_commit(folder: str) -> str | None:
    """The commit that a .git folder, or the folder that a .git file names, has checked out."""
    place = os.path.join(folder, ".git")
    if os.path.islink(place):
        return None
    if not os.path.isdir(place):
        said = read_bounded(place, HEAD_BYTES).decode("utf-8", "replace").strip()
        if not said.lower().startswith("gitdir:"):
            return None
        place = os.path.realpath(os.path.join(folder, said[7:].strip()))
        if not os.path.isdir(place):
            return None
    whole = re.compile(r"[0-9a-fA-F]{40}")
    read = lambda name, most: read_bounded(os.path.join(place, name), most).decode("ascii", "ignore")
    head = read("HEAD", HEAD_BYTES).strip()
    if whole.fullmatch(head):
        return head.lower()
    ref = head[4:].strip() if head.startswith("ref:") else ""
    if not ref or ref.startswith("/") or ".." in ref.split("/"):
        return None
    value = read(ref, HEAD_BYTES).strip()
    if whole.fullmatch(value):
        return value.lower()
    packed = dict(reversed(line.split(" ", 1)) for line in read("packed-refs", NEARBY_BYTES).splitlines() if line[:1] not in ("#", "^") and " " in line)
    return packed[ref].lower() if whole.fullmatch(packed.get(ref, "")) else None


def printable_runs(path: str, start: int, end: int):
    """(place, text) of the printable runs of a binary that begin in a range of its bytes, each whole: one that goes on
    beyond the range is read on, and one that began before it is another range's."""
    with open(path, "rb") as f:
        f.seek(max(0, start - 1))
        before = f.read(1) if start else b""
        data = f.read(end - start)
        for m in _RUN.finditer(data):
            if m.start() == 0 and before and _RUN.match(before):
                continue
            run = m[0]
            while m.end() == len(data) and f.tell() < BINARY_BYTES:
                more = f.read(min(CARRY_BYTES, BINARY_BYTES - f.tell()))
                on = _RUN.match(more)
                run += on[0] if on else b""
                if not more or not on or on.end() < len(more):
                    break
            yield start + m.start(), run.decode("ascii")


def binary_sources(runtimes: DataFrame, parts: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(runtime, source, place, name, text) of the printable runs of binaries (runtime, size) that may name an identity, a
    row for each window that they begin in.  Tasks read ranges of files, so one long file is many tasks' work."""
    size = F.least(F.col("size"), F.lit(BINARY_BYTES))
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(range_bytes).cast("long")))
    ranges = runtimes.select("runtime", F.explode(starts).alias("start"), size.alias("size")).select("runtime", "start", F.least(F.col("start") + range_bytes, "size").alias("end"))

    def run(it):
        for b in it:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                windows: dict[int, list[str]] = {}
                try:
                    for at, text in printable_runs(os.path.realpath(path), start, end):
                        if TELLING.search(text):
                            windows.setdefault(at // WINDOW_BYTES, []).append(text)
                except OSError:
                    continue
                if windows:
                    cols = [[path] * len(windows), ["binary"] * len(windows), list(windows), [""] * len(windows), ["\n".join(x) for x in windows.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["runtime", "source", "place", "name", "text"])

    return ranges.repartition(parts or runtimes.sparkSession.sparkContext.defaultParallelism, "runtime", "start").mapInArrow(run, SOURCE_ROWS)


def read_runtimes(spark, paths: list[str], given: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(runtimes, sources) of executables, read in tasks: path, mode, head, error, recognized; and what ``identify`` takes.
    Binaries of runtimes that a user names are not searched."""
    listed = spark.createDataFrame([(p, (given or {}).get(p)) for p in paths], "runtime string, given string").repartition(max(1, len(paths)))

    def facts(it):
        for b in it:
            rows = []
            for path in b.column(0).to_pylist():
                if not os.path.isfile(path):
                    rows.append((path, None, None, "missing" if not os.path.exists(path) else "not a regular file"))
                else:
                    rows.append((path, os.stat(path).st_mode & 0o7777, read_bounded(os.path.realpath(path), 64), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.string()))], names=["runtime", "mode", "head", "error"])

    def sources(it):
        for b in it:
            for path, word in zip(*(c.to_pylist() for c in b.columns)):
                rows = [("given", 0, "", word)] if word is not None else []
                if not rows and os.path.isfile(path):
                    around = folders_around(path)
                    near = [(name, read_bounded(os.path.join(d, name), NEARBY_BYTES)) for d in around for name in NEARBY]
                    rows += [("nearby", i, name, raw.decode("utf-8", "replace")) for i, (name, raw) in enumerate(near) if raw]
                    rows += [("git", i, ".git", f"commit: {c}") for i, c in enumerate(map(git_commit, around)) if c]
                if rows:
                    cols = [[path] * len(rows), *zip(*rows)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["runtime", "source", "place", "name", "text"])

    def sizes(it):
        for b in it:
            paths = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([os.path.getsize(p) if os.path.isfile(p) else 0 for p in paths], pa.int64())], names=["runtime", "size"])

    binaries = binary_sources(listed.where("given is null").select("runtime").mapInArrow(sizes, "runtime string, size long"))
    runtimes = listed.select("runtime").mapInArrow(facts, "runtime string, mode int, head binary, error string")
    runtimes = runtimes.withColumn("component", runtime_component(F.col("runtime"))).withColumn("recognized", F.col("component") != "unknown").withColumn("format", executable_format(F.col("head")))
    return runtimes, listed.mapInArrow(sources, SOURCE_ROWS).unionByName(binaries)


__all__ = ["binary_sources", "component", "identify", "posture", "read_runtimes"]
