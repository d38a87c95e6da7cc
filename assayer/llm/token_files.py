"""Token-ID output: Parquet files of token lists in ascending id order, written and read by the executors.

Files hold row groups of ``GROUP_ROWS`` documents (fewer only where these would hold over ``GROUP_TOKENS`` ids, or at a
file's end) and page indexes; ids are dictionary encoded, offsets and lengths delta encoded, so that metadata or a few
documents can be read without the rest.  Null text counts as empty, a very long text is one list; a null id sorts first;
rows with equal ids stand together in any order, each with a place of its own.  Files are named by attempt and listed in
a manifest that only successful tasks return, so repeated tasks do no harm.  An empty table has no files; other columns
don't enter, whatever their names."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common
from assayer.llm.pretokens import CHUNK, library_encoder, text_size

#: Rows of a row group and bytes of a page.
GROUP_ROWS, PAGE_BYTES = 4096, 64 << 10
GROUP_TOKENS = 1 << 23
SCHEMA = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.large_list(pa.int32()))])


def write_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, mb: float = 16) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files; returns their manifest (part, path, docs, tokens, first,
    last, base, folder), one row a file (``common.MOST_PARTS`` at most), first and last being the ids it spans, base the
    number of token ids in all files before it."""
    spark = df.sparkSession
    common.bound_batches(spark)
    folder = common.shared_path(spark, "tokens")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(common.parts(df, mb), "doc_id").sortWithinPartitions("doc_id")
    out = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def run(it):
        import pyarrow.parquet as pq

        fs, root = common.open_fs(folder)
        part, encode, writer, docs, total = TaskContext.get().partitionId(), library_encoder(tokenizer_path), None, 0, 0
        name, waiting, first, last = f"part-{part:06d}-{uuid.uuid4().hex}.parquet", [], None, None

        def write(rows: int | None = None) -> None:
            """Write the first rows that wait as a row group; all of them without a number."""
            table = pa.concat_tables(waiting)
            rows = rows or table.num_rows
            writer.write_table(table.slice(0, rows), row_group_size=rows)
            waiting[:] = [table.slice(rows)] if rows < table.num_rows else []

        for held in common.chunks(it, text_size, CHUNK):
            ids, at = encode([r[1] or "" for r in held])
            n = np.diff(at) + 1
            flat = np.insert(ids, at[1:], end_id).astype(np.int32)
            ends = np.cumsum(n)
            table = pa.table([pa.array([r[0] for r in held], pa.int64()), pa.array(total + ends - n), pa.array(n.astype(np.int32)), pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(flat))], schema=SCHEMA)
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = pq.ParquetWriter(f"{root}/{name}", SCHEMA, filesystem=fs, compression="zstd", use_dictionary=["ids.list.element"], column_encoding={"doc_id": "DELTA_BINARY_PACKED", "local_start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, write_page_index=True, data_page_size=PAGE_BYTES, version="2.6")
            known = [r[0] for r in held if r[0] is not None]
            first, last = known[0] if first is None and known else first, known[-1] if known else last
            waiting.append(table)
            while sum(t.num_rows for t in waiting) >= GROUP_ROWS:
                write(GROUP_ROWS)
            if sum(int(np.asarray(t.column("n_tokens")).sum()) for t in waiting) >= GROUP_TOKENS:
                write()
            docs, total = docs + len(held), total + int(ends[-1])
        if writer is not None:
            if waiting:
                write()
            writer.close()
            yield from common.batches([(part, f"{root}/{name}", docs, total, first, last)], out)

    found = sorted(rows.mapInArrow(run, "part int, path string, docs long, tokens long, first long, last long").collect(), key=lambda r: r.part)  # a row a file
    base, listed = 0, []
    for r in found:
        listed.append((*r, base, folder))
        base += r.tokens
    return spark.createDataFrame(listed, "part int, path string, docs long, tokens long, first long, last long, base long, folder string")


def read_tokens(manifest: DataFrame, fold, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Apply ``fold(table, base)`` to each row group of the listed files, with only ``columns`` read."""
    files = manifest.select("path", "base", "folder").repartition(max(1, manifest.count()))

    def run(it):
        import pyarrow.parquet as pq

        for b in it:
            for path, base, folder in zip(*(c.to_pylist() for c in b.columns)):
                fs, _ = common.open_fs(folder)
                with fs.open_input_file(path) as f:
                    file = pq.ParquetFile(f)
                    for g in range(file.num_row_groups):
                        yield fold(file.read_row_group(g, columns=columns), base)

    return files.mapInArrow(run, schema)


def read_documents(manifest: DataFrame, wanted: list[int], columns: list[str] | None = None) -> DataFrame:
    """The rows of some documents: only files whose span of ids may hold one, only row groups whose statistics do, and
    only ``columns`` are read.  local_start counts from the file's first id; base from all ids."""
    wanted = sorted(set(wanted))
    names = columns or [f.name for f in SCHEMA]
    kinds = {"doc_id": "long", "local_start": "long", "n_tokens": "int", "ids": "array<int>"}
    files = manifest.where(F.col("first").isNotNull() & F.exists(F.lit(wanted).cast("array<long>"), lambda x: x.between(F.col("first"), F.col("last"))))
    files = files.select("path", "base", "folder").repartition(max(1, files.count()))

    def run(it):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for b in it:
            for path, base, folder in zip(*(c.to_pylist() for c in b.columns)):
                fs, _ = common.open_fs(folder)
                with fs.open_input_file(path) as f:
                    file = pq.ParquetFile(f)
                    place = file.schema_arrow.get_field_index("doc_id")
                    for g in range(file.num_row_groups):
                        known = file.metadata.row_group(g).column(place).statistics
                        if known is not None and known.has_min_max and not any(known.min <= x <= known.max for x in wanted):
                            continue
                        table = file.read_row_group(g, columns=list({"doc_id": 0} | dict.fromkeys(names)))
                        table = table.filter(pc.is_in(table.column("doc_id"), pa.array(wanted, pa.int64()))).select(names)
                        if "ids" in names:
                            table = table.set_column(names.index("ids"), "ids", table.column("ids").cast(pa.list_(pa.int32())))
                        for part in table.to_batches():
                            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([base] * part.num_rows, pa.int64())], names=[*names, "base"])

    return files.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", base long")


def digest(table: pa.Table, base: int) -> pa.RecordBatch:
    """Per document of a row group: place among all ids, count, and checksum of the ids read back."""
    lists = table.column("ids").combine_chunks()
    at = np.asarray(lists.offsets)
    raw = np.asarray(lists.values).astype("<u4")
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    ids = table.column("doc_id").combine_chunks()
    return pa.RecordBatch.from_arrays([ids, pa.array(np.asarray(table.column("local_start")) + base), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
