"""WARC archives with a two-level capture index.

Each task writes the pages of a range of keys (reversed host, path, page id) as gzip members of one file, and an index
file of the same order: blocks of lines, each compressed, after them a sparse directory of the blocks' first lines.  A
row per file, its range of keys, is all that a reader holds.  A capture is found by binary search in these rows, in the
directory of the file, and in one block that is read by its range; then one range read gets its record.  Files carry a
name of their own per attempt; only those that successful tasks list exist for readers.

Equal payloads (by SHA-256 and length): the record of least page id is the response, the others revisit it and hold no
payload.  Rows that share the least id are all responses, and each is found by the id they share.  Null html is an empty
payload, a null url an empty key; a null page id comes first in its key and is the response of its payload only where no
row has an id.  Very long payloads are records of their own size, held by a task one batch at a time.  An empty table has
no archives; other columns don't enter, whatever their names."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import common

BLOCK_LINES = 512
FILES = "part int, first_key string, first_page string, last_key string, last_page string, warc string, cdx string, directory_at long, directory_size int, folder string"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def reversed_key(url: str | None) -> str:
    """com,example,www)/path?query: sites and their parts sort together."""
    try:
        x = urlsplit(url or "")
        host = x.hostname or ""
    except ValueError:
        return _clean((url or "").lower())
    return _clean(",".join(reversed(host.split("."))) + ")" + (x.path or "/") + ("?" + x.query if x.query else ""))


def _clean(key: str) -> str:
    """Index lines are cut at line ends and tabs."""
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member.  A revisit names its response and the length and digest of the payload it leaves out."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (page_id, url, ...) with the key of the url before them."""
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def run(it):
        for b in it:
            keys = pa.array([reversed_key(u) for u in b.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, *b.columns], names=["key", *b.schema.names])

    return rows.mapInArrow(run, f"key string, {schema}")


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives and index files; returns the saved list of files, a row each (``common.MOST_PARTS`` at most)."""
    spark = df.sparkSession
    common.bound_batches(spark)
    folder = common.shared_path(spark, "warc")
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    many = pages.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    many = common.save(many.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"), "payloads")
    joined = pages.join(common.maybe_broadcast(many), (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = common.save(_keyed(joined.select("page_id", "url", "html", refers.alias("refers_to"))), "captures")
    rows = rows.repartitionByRange(common.parts(df, 16), "key", "page_id").sortWithinPartitions("key", "page_id")

    def write(it):
        schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in FILES.split(", ")])
        fs, root = common.open_fs(folder)
        name = uuid.uuid4().hex
        warc = cdx = None
        at, index_at, lines, directory, first, last = 0, 0, [], [], ("", ""), ("", "")

        def end_block():
            nonlocal index_at
            packed = zlib.compress("\n".join(lines).encode(), 6)
            cdx.write(packed)
            key, page = lines[0].split("\t")[:2]
            directory.append(f"{key}\t{page}\t{index_at}\t{len(packed)}")
            index_at += len(packed)
            lines.clear()

        for b in it:
            if warc is None and b.num_rows:
                fs.create_dir(root, recursive=True)
                warc = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                cdx = fs.open_output_stream(f"{root}/{name}.cdx", compression=None)
                key, page = b.column(0)[0].as_py(), b.column(1)[0].as_py()
                first = key, "" if page is None else str(page)
            for place in range(0, b.num_rows, 256):
                for key, page, url, html, refers_to in zip(*(c.to_pylist() for c in b.slice(place, 256).columns)):
                    member = record(page, url, html.encode("utf-8", "surrogatepass"), refers_to)
                    warc.write(member)
                    lines.append(f"{key}\t{'' if page is None else page}\t{at}\t{len(member)}")
                    at, last = at + len(member), (key, "" if page is None else str(page))
                    if len(lines) == BLOCK_LINES:
                        end_block()
        if warc is not None:
            if lines:
                end_block()
            packed = zlib.compress("\n".join(directory).encode(), 6)
            cdx.write(packed)
            warc.close()
            cdx.close()
            yield from common.batches([(TaskContext.get().partitionId(), *first, *last, f"{root}/{name}.warc.gz", f"{root}/{name}.cdx", index_at, len(packed), folder)], schema)

    return common.save(rows.mapInArrow(write, FILES), "archives")


def _order(key: str, page: str) -> tuple:
    """The order of index lines: by key, then by page id, none first."""
    return key, page != "", int(page or 0)


def read_block(f, offset: int, length: int) -> list[list[str]]:
    """Lines of an index block (key, page id, record offset, record length) or of a directory (of block)."""
    f.seek(offset)
    return [line.split("\t") for line in zlib.decompress(f.read(length)).decode().split("\n")]


class Index:
    """Finds captures in the files that ``write_archives`` listed.  Holds the list, and of the file and block last read
    the directory and lines."""

    def __init__(self, files: list):
        self.files = sorted(tuple(r) for r in files)  # by part: files follow one another in the order of their keys
        self.firsts, self.lasts = ([_order(r[j], r[j + 1]) for r in self.files] for j in (1, 3))
        self.open, self.block = None, None

    def _file(self, i: int) -> None:
        if self.open != i:
            warc, cdx, at, size, folder = self.files[i][5:]
            fs, _ = common.open_fs(folder)
            self.close()
            self.warc, self.cdx = fs.open_input_file(warc), fs.open_input_file(cdx)
            self.directory = read_block(self.cdx, at, size)
            self.starts = [_order(x[0], x[1]) for x in self.directory]
            self.open, self.block = i, None

    def close(self) -> None:
        if self.open is not None:
            self.warc.close()
            self.cdx.close()
            self.open = None

    def _lines(self, b: int) -> None:
        if self.block != b:
            self.lines = read_block(self.cdx, int(self.directory[b][2]), int(self.directory[b][3]))
            self.places, self.block = [_order(x[0], x[1]) for x in self.lines], b

    def find(self, key: str, page: str | None = None):
        """Page id, headers and payload of every capture of a key, or of a key and page id ('' for none)."""
        wanted = (key,) if page is None else _order(key, page)
        i = bisect.bisect_left(self.lasts, wanted)
        while i < len(self.files) and self.firsts[i][: len(wanted)] <= wanted:
            self._file(i)
            b = max(0, bisect.bisect_left(self.starts, wanted) - 1)
            while b < len(self.starts) and self.starts[b][: len(wanted)] <= wanted:
                self._lines(b)
                for n in range(bisect.bisect_left(self.places, wanted), len(self.lines)):
                    if self.places[n][: len(wanted)] != wanted:
                        break
                    self.warc.seek(int(self.lines[n][2]))
                    yield self.lines[n][1], *parse(self.warc.read(int(self.lines[n][3])))
                b += 1
            i += 1


def look_up(files: list, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and payloads of all captures of a url.  ``files``: the rows that ``write_archives`` returned."""
    index = Index(files)
    out = [(fields, payload) for _, fields, payload in index.find(reversed_key(url))]
    index.close()
    return out


def read_captures(files: DataFrame, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every capture of the pages (id and url) of ``wanted``, found by binary search and read back by ranges.  Pages are
    dealt by ranges of keys, so that neighbours share a block; the list of files goes to all tasks."""
    schema = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in FOUND.split(", ")])
    listed = files.sparkSession.sparkContext.broadcast([tuple(r) for r in files.collect()])
    pages = _keyed(wanted.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))).select("key", "page_id").distinct()
    n = max(common.parts(wanted, 16), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pages = common.save(pages, "wanted").repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(it):
        index = Index(listed.value)

        def rows():
            for b in it:
                for key, page in zip(*(c.to_pylist() for c in b.columns)):
                    for found, fields, payload in index.find(key, "" if page is None else str(page)):
                        kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
                        if kind == "response":
                            digest, size = sha1(payload), len(payload)
                        refers = int(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None
                        yield int(found) if found else None, size, digest, kind, refers, fields.get("WARC-Target-URI", "")

        yield from common.batches(rows(), schema)
        index.close()

    return pages.mapInArrow(run, FOUND)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_captures(write_archives(pages), pages)


ORACLE_WARC = """
WITH p AS (SELECT page_id, coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), '') AS url, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
bits AS (SELECT page_id, url, p.html, first, CAST(CAST(from_hex(sha1(p.html)) AS BIT) AS VARCHAR) AS b FROM p JOIN firsts ON p.html = firsts.html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(b, 5 * i + j + 1, 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM bits
"""
