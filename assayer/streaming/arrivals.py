"""An extension: check model files as they arrive.  A stream of new paths feeds the same header scan, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from assayer.sources.gguf import SCHEMA, Limits, read_header


def scan_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Header rows of the files that a column names; works on batches and streams alike."""
    limits = Limits()

    def run(it):
        import pandas as pd

        for frame in it:
            rows = [read_header(p.removeprefix("file:").replace("///", "/"), limits) for p in frame[column]]
            if rows:
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in _FIELDS])

    return paths.select(column).mapInPandas(run, SCHEMA)


_FIELDS = "path file_size gguf_version byte_order tensor_count metadata_count metadata_end tensor_data_offset alignment architecture name file_type quantization_version chat_template metadata omitted_metadata_keys bytes_read tensors error_class error_message".split()


def arrivals(spark: SparkSession, folder: str, handle) -> DataStreamWriter:
    """``handle(rows, batch_id)`` gets the header rows of each batch of new ``.gguf`` files."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.gguf").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.writeStream.foreachBatch(lambda batch, number: handle(scan_paths(batch), number))
