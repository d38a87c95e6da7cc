"""A sink for one JSON document whose lists are as long as a fleet's findings: ``df.write.format("report").save(path)``.

Rows (section, item) are items of the document's lists, in the order of partitions; the option ``frame`` is the document
without them, as JSON in which each list is the text ``@section``.  Each task writes what it has, ready for its place, to a
part beside the document.  When all have, the parts are put together in order, a piece at a time, and the document takes
its name in one step: a reader sees the old one or the whole new one, and a job that fails leaves nothing."""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from assayer.sources import places

PIECE = 1 << 20


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)


def framed(frame: dict) -> list[tuple[str, str | None, str]]:
    """The document's text in order: (text, the section that follows it or None, indentation of that section's line)."""
    out, at, text = [], 0, canonical(frame)
    while (mark := text.find('"@', at)) >= 0:
        end = text.index('"', mark + 1)
        line = text[text.rfind("\n", 0, mark) + 1 : mark]
        out.append((text[at:mark], text[mark + 2 : end], line[: len(line) - len(line.lstrip())]))
        at = end + 1
    return [*out, (text[at:] + "\n", None, "")]


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: its place among tasks, and (section, file) in order."""

    place: int
    files: list


class ReportWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.opener = options["path"], options.get("opener")
        self.frame = framed(json.loads(options["frame"]))
        self.indent = {s: i for _, s, i in self.frame if s}
        self.staging = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _fs(self):
        """An Arrow file system and the paths of the document and of the parts in it."""
        from pyarrow.fs import LocalFileSystem

        at = places.place(self.path, self.opener)
        fs = LocalFileSystem() if isinstance(at, places.Local) else at.fs
        return fs, at._plain(self.path), at._plain(self.path) + self.staging.removeprefix(self.path)

    def write(self, iterator):
        fs, _, staging = self._fs()
        context = TaskContext.get()
        files, out, section = [], None, None
        try:
            for row in iterator:
                if row.section not in self.indent:
                    raise ValueError(f"the frame has no list {row.section}")
                if row.section != section:
                    if out:
                        out.close()
                    section = row.section
                    files.append((section, f"{context.partitionId()}-{context.taskAttemptId()}-{len(files)}"))
                    fs.create_dir(staging, recursive=True)
                    out = fs.open_output_stream(posixpath.join(staging, files[-1][1]))
                    first = True
                pad = self.indent[section] + "  "
                text = canonical(json.loads(row.item)).replace("\n", f"\n{pad}")
                out.write(f"{'' if first else ','}\n{pad}{text}".encode())
                first = False
        finally:
            if out:
                out.close()
        return Parts(context.partitionId(), files)

    def commit(self, messages):
        fs, path, staging = self._fs()
        by_section: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m), key=lambda m: m.place):
            for section, file in m.files:
                by_section.setdefault(section, []).append(file)
        fs.create_dir(staging, recursive=True)
        whole = posixpath.join(staging, "whole")
        with fs.open_output_stream(whole) as out:
            for text, section, indent in self.frame:
                out.write(text.encode())
                if section is None:
                    continue
                out.write(b"[")
                for i, file in enumerate(by_section.get(section, [])):
                    out.write(b"," if i else b"")
                    with fs.open_input_stream(posixpath.join(staging, file)) as part:
                        while piece := part.read(PIECE):
                            out.write(piece)
                out.write(f"\n{indent}]".encode() if by_section.get(section) else b"]")
        fs.move(whole, path)
        fs.delete_dir(staging)

    def abort(self, messages):
        from pyarrow.fs import FileType

        fs, _, staging = self._fs()
        if fs.get_file_info(staging).type == FileType.Directory:
            fs.delete_dir(staging)


class ReportSink(DataSource):
    @classmethod
    def name(cls):
        return "report"

    def schema(self):
        return "section string, item string"

    def writer(self, schema, overwrite):
        return ReportWriter(self.options)


def write_report(rows: DataFrame, frame: dict, path: str, *order: str, parts: int | None = None, opener: str | None = None) -> None:
    """Writes rows (section, item and the columns of ``order``) as the lists of a document, each in that order."""
    spark = rows.sparkSession
    spark.dataSource.register(ReportSink)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "section", *order).sortWithinPartitions("section", *order).select("section", "item")
    given = {"frame": json.dumps(frame), **({"opener": opener} if opener else {})}
    ordered.write.format("report").options(**given).mode("append").save(path)


def item(**fields) -> F.Column:
    """A JSON object of columns, nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})
