"""Registered queries over files that Spark writes from the documents table: models, runtimes and folders.

Tasks write a file for each document under a new folder of the shared one, and the engine's own scans read them back.  The
SQL works out from the table what the files must say."""

from __future__ import annotations

import os
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import digests
from assayer.plans.registry import query, read
from assayer.sources import discovery, gguf, places
from assayer.tables import shared_folder


def write_files(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Writes ``data`` of each row to its ``path`` under a new folder; the folder.  A task that runs again writes the same."""
    root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    root = root.removeprefix("file://") if root.startswith("file:///") else root.removeprefix("file:")

    def run(it):
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        made: set[str] = set()
        for b in it:
            paths, data = b.column("path").to_pylist(), b.column("data").to_pylist()
            for p, d in zip(paths, data):
                folder = os.path.dirname(f"{base}/{p}")
                if folder not in made:
                    at.create_dir(folder, recursive=True)
                    made.add(folder)
                with at.open_output_stream(f"{base}/{p}") as f:
                    f.write(d)
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)], pa.int64())], names=["n"])

    rows.select("path", "data").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root


def _string(s: str, o: str) -> bytes:
    raw = s.encode()
    return struct.pack(f"{o}Q", len(raw)) + raw


def model_bytes(doc_id: int, lang: str, text: str) -> bytes:
    """A model file: one in ten of the other byte order, one in four with an alignment of its own, one in seventeen cut in
    its last metadata value."""
    o, version = (">", 3) if doc_id % 10 == 0 else ("<", 2 + doc_id % 2)
    entries = [("general.architecture", 8, lang), ("general.name", 8, f"doc-{doc_id}"), ("corpus.ids", 9, [doc_id, doc_id + 1, doc_id + 2])]
    if doc_id % 4 == 0:
        entries.append(("general.alignment", 4, 64))
    entries.append(("tokenizer.chat_template", 8, text))
    tensors = [(f"t{j}", [32, 1 + doc_id % 7]) for j in range(doc_id % 3)]
    out = b"GGUF" + struct.pack(f"{o}IQQ", version, len(tensors), len(entries))
    for key, kind, v in entries:
        out += _string(key, o) + struct.pack(f"{o}I", kind)
        out += _string(v, o) if kind == 8 else struct.pack(f"{o}I", v) if kind == 4 else struct.pack(f"{o}IQ{len(v)}Q", 10, len(v), *v)
    if doc_id % 17 == 0:
        return out[:-1]
    size = 128 * (1 + doc_id % 7)
    for j, (name, dims) in enumerate(tensors):
        out += _string(name, o) + struct.pack(f"{o}IQQIQ", len(dims), *dims, 0, j * size)
    align = 64 if doc_id % 4 == 0 else 32
    return out + b"\0" * (-len(out) % align + size * len(tensors))


@query("header_scan", """WITH d AS (SELECT doc_id, lang, text, doc_id % 3 AS n, 128 * (1 + doc_id % 7) AS size, CASE WHEN doc_id % 4 = 0 THEN 64 ELSE 32 END AS align, doc_id % 17 = 0 AS cut,
  24 + (8 + 20 + 4 + 8 + strlen(lang)) + (8 + 12 + 4 + 8 + 4 + strlen(CAST(doc_id AS VARCHAR))) + (8 + 10 + 4 + 4 + 8 + 24) + CASE WHEN doc_id % 4 = 0 THEN 8 + 17 + 4 + 4 ELSE 0 END + (8 + 23 + 4 + 8 + strlen(text)) AS head FROM documents),
e AS (SELECT *, head + n * (8 + 2 + 4 + 16 + 4 + 8) AS ends FROM d), f AS (SELECT *, ends + ((-ends % align) + align) % align AS data FROM e)
SELECT doc_id, CASE WHEN cut THEN head - 1 ELSE data + n * size END AS file_size, CASE WHEN cut THEN NULL WHEN doc_id % 10 = 0 THEN 'big' ELSE 'little' END AS byte_order, CASE WHEN cut THEN NULL ELSE CAST(CASE WHEN doc_id % 10 = 0 THEN 3 ELSE 2 + doc_id % 2 END AS INTEGER) END AS gguf_version,
 CASE WHEN cut THEN NULL ELSE lang END AS architecture, CASE WHEN cut THEN NULL ELSE 'doc-' || doc_id END AS name, CASE WHEN cut THEN NULL ELSE sha256(text) END AS template_sha256,
 CASE WHEN cut THEN NULL ELSE CAST(CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 4 END AS BIGINT) END AS metadata_count, CASE WHEN cut THEN NULL ELSE doc_id END AS first_id, CASE WHEN cut THEN NULL ELSE n END AS tensor_count, CASE WHEN cut THEN NULL ELSE head END AS metadata_end,
 CASE WHEN cut THEN NULL ELSE data END AS tensor_data_offset, CASE WHEN cut THEN NULL ELSE n * size END AS tensor_bytes, CASE WHEN cut THEN 'truncated' END AS error_class FROM f""")
def header_scan(spark, sf_dir):
    """A model file a document, whose template is its text; the header source walks the folder and reads all back."""
    build = F.udf(model_bytes, "binary", useArrow=False)  # a few bytes around each text
    docs = read(spark, sf_dir, "documents")
    root = write_files(spark, docs.select(F.concat("lang", F.lit("/"), F.col("doc_id") % 100, F.lit("/"), "doc_id").alias("path"), build("doc_id", "lang", "text").alias("data")), "models")
    gguf.register(spark)
    found = spark.read.format("gguf").load(root)
    ids = F.from_json(F.get_json_object("metadata", "$['corpus.ids']"), "array<long>")
    size = F.aggregate("tensors", F.lit(0).cast("long"), lambda a, t: a + t["byte_size"].cast("long"))
    return found.select(F.regexp_extract("path", r"([0-9]+)$", 1).cast("long").alias("doc_id"), "file_size", "byte_order", "gguf_version", "architecture", "name", F.sha2("chat_template", 256).alias("template_sha256"), "metadata_count", ids[0].alias("first_id"), "tensor_count", "metadata_end", "tensor_data_offset", F.when(F.col("error_class").isNull(), size).alias("tensor_bytes"), "error_class")


#: Where a document's file lies under its language's folder, by its id: names that are ignored whatever the case, folders
#: too deep in two languages of four, and own files beside folders.
_PLACE = "CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'B/' WHEN 2 THEN 'a/x/' WHEN 3 THEN 'Cache/x/' WHEN 4 THEN 'a/VENV/' WHEN 5 THEN 'a!/' WHEN 6 THEN 'b/x/y/z/' WHEN 7 THEN 'ab/c-1/c_2/' WHEN 8 THEN CASE WHEN lang IN ('de', 'fr') THEN 'c/1/2/3/4/' ELSE 'c/1/2/' END WHEN 9 THEN 'run-' || doc_id || '/' ELSE 'Z/' || doc_id % 5 || '/' END"
_NAME = "CASE WHEN doc_id % 11 = 9 THEN 'Llama-CLI.exe' WHEN doc_id % 2 = 0 THEN 'M' || doc_id || '.gguf' ELSE 'm' || doc_id END"
_KIND = "CASE WHEN doc_id % 11 = 9 THEN 'runtime' WHEN doc_id % 3 = 0 THEN 'gguf' ELSE 'unknown' END"
_TREE_SQL = f"""t AS (SELECT doc_id, lang, {_PLACE} AS place, {_NAME} AS name, {_KIND} AS kind FROM documents),
f AS (SELECT *, lang || '/' || place || name AS path, list_transform(list_filter(string_split(place, '/'), lambda p: p <> ''), lambda p: lower(p) || chr(1) || p) AS folder, lower(name) || chr(1) || name AS entry FROM t)"""


def _tree(spark, sf_dir) -> str:
    docs = read(spark, sf_dir, "documents").select("lang", F.expr(_PLACE).alias("place"), F.expr(_NAME).alias("name"), F.expr(_KIND).alias("kind"))
    data = F.when(F.col("kind") == "gguf", F.lit(b"GGUF\3\0")).otherwise(F.lit(b"\x7fELF"))
    return write_files(spark, docs.select(F.concat("lang", F.lit("/"), "place", "name").alias("path"), data.alias("data")), "tree")


@query("fleet_targets", f"WITH {_TREE_SQL} SELECT path, kind, CASE kind WHEN 'gguf' THEN 'magic' ELSE 'name' END AS detection_method, CAST(len(folder) + 1 AS INTEGER) AS level FROM f WHERE kind <> 'unknown' AND doc_id % 11 NOT IN (3, 4)")
def fleet_targets(spark, sf_dir):
    """All models and runtimes of a tree, found by tasks; folders of ignored names are not entered."""
    root = _tree(spark, sf_dir)
    files = discovery.listing(spark, [root], depth=9).where("kind = 'file'")
    found = discovery.classified(files.repartition(spark.sparkContext.defaultParallelism)).join(files.select("path", "level"), "path")
    return found.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), "kind", "detection_method", "level")


@query("walked_targets", f"""WITH {_TREE_SQL}, ends AS (SELECT lang, min(list_slice(folder, 1, 4)) AS e FROM f WHERE len(folder) > {discovery.DEPTH} GROUP BY lang),
seen AS (SELECT f.*, row_number() OVER (PARTITION BY f.lang ORDER BY folder, entry) AS n FROM f LEFT JOIN ends USING (lang) WHERE doc_id % 11 NOT IN (3, 4) AND len(folder) <= {discovery.DEPTH} AND (e IS NULL OR folder <= e)),
totals AS (SELECT lang, CAST(least(count(*), {discovery.CANDIDATES}) AS INTEGER) AS candidates, count(*) > {discovery.CANDIDATES} OR any_value(e) IS NOT NULL AS limit_reached FROM seen LEFT JOIN ends USING (lang) GROUP BY lang)
SELECT lang, path, kind, candidates, limit_reached FROM seen JOIN totals USING (lang) WHERE n <= {discovery.CANDIDATES} AND kind <> 'unknown'""")
def walked_targets(spark, sf_dir):
    """Each language's folder as a target of its own, under the walk's order and limits."""
    root = _tree(spark, sf_dir)
    rows = []
    for lang in sorted(e.name for e in places.place(root).entries(root)):  # a handful of folders
        found = discovery.inventory(spark, [f"{root}/{lang}"])
        rows += [(lang, t.path[len(root) + 1 :], t.kind, found.candidates, found.limit_reached) for t in found.targets]
    return spark.createDataFrame(rows, "lang string, path string, kind string, candidates int, limit_reached boolean")


@query("fleet_digests", "SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes_read FROM documents WHERE text IS NOT NULL")
def fleet_digests(spark, sf_dir):
    """A file a document, found by tasks and hashed in partitions of equal bytes."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    root = write_files(spark, docs.select(F.concat(F.col("doc_id") % 50, F.lit("/"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("data")), "texts")
    found = digests.file_digests(discovery.listing(spark, [root]).where("kind = 'file'"))
    return found.select(F.regexp_extract("path", r"([0-9]+)$", 1).cast("long").alias("doc_id"), "digest", "bytes_read")
