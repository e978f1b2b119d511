"""Office files as a Spark data source: `spark.read.format("office")`, and the same as a stream.

Options: `path`, a folder or file by URI; `rows`, what a row is: `sheets` (a row of a workbook's sheet), `slides` (a slide)
or `markdown` (a file, by whatever converter is registered for its extension). A partition is a run of files of SPLIT bytes,
or one larger file, so that files are read by tasks and never by the driver, which only lists them. A file that can't be read
is one row with its error. Files whose extension `rows` doesn't know are passed over.

A stream takes files in the order of their time and name; its offset is how many files there were. Files that have been
listed have to stay, and files that are written while the stream runs need a later time than those before.

pyarrow's file systems read the files: local and HDFS paths, and object stores that it knows.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomdoc.sources import office

SPLIT = 16 << 20
SCHEMAS = {
    "sheets": "path string, sheet string, row int, cells array<string>, error string",
    "slides": "path string, slide int, title string, body array<string>, notes array<string>, error string",
    "markdown": "path string, markdown string, error string",
}


def _sheets(data: bytes, stem: str) -> Iterator[tuple]:
    for name, rows in office.xlsx_sheets(data):
        yield from ((name, i, cells) for i, cells in enumerate(rows))


def _slides(data: bytes, stem: str) -> Iterator[tuple]:
    yield from office.Deck(data).rows()


def _markdown(data: bytes, stem: str) -> Iterator[tuple]:
    raise NotImplementedError  # by the registry, which knows the extension


READERS = {"sheets": (_sheets, (".xlsx", ".xlsm")), "slides": (_slides, (".pptx",)), "markdown": (_markdown, None)}


@dataclass
class Files(InputPartition):
    """Paths within a file system."""

    paths: tuple[str, ...]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Reading:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], options.get("rows", "markdown").lower()
        self.split = int(options.get("split", SPLIT))
        self.extensions = READERS[self.rows][1] or tuple(office.converter_extensions())

    def files(self) -> list[fs.FileInfo]:
        """Files of known extensions, by time and name."""
        store, root = _store(self.path)
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        known = [f for f in listed if f.type == fs.FileType.File and posixpath.splitext(f.path)[1].lower() in self.extensions]
        return sorted(known, key=lambda f: (f.mtime_ns or 0, f.path))

    def parted(self, files: list[fs.FileInfo]) -> list[Files]:
        """Runs of files of `split` bytes, or one larger file each."""
        out: list[list[str]] = []
        size = 0
        for f in files:
            if not out or size + f.size > self.split:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(tuple(x)) for x in out or [[]]]  # Spark takes no partitions for one of its own

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        width = len(SCHEMAS[self.rows].split(", ")) - 2
        for path in partition.paths:
            stem, extension = posixpath.splitext(posixpath.basename(path))
            try:
                with store.open_input_stream(path) as file:
                    data = file.read()
                if self.rows == "markdown":
                    made = [(office.convert(data, extension.lower(), stem),)]
                else:
                    made = list(READERS[self.rows][0](data, stem))
            except Exception as e:  # a broken file is a row with its error, not the end of the job
                yield (path, *[None] * width, f"{type(e).__name__}: {e}"[:300])
                continue
            yield from ((path, *row, None) for row in made)


class OfficeReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.parted(self.files())


class OfficeStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802  the interface's name
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(self.files())}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.parted(self.files()[start["files"] : end["files"]])

    def commit(self, end: dict) -> None:
        pass


class OfficeFiles(DataSource):
    """Workbooks, presentations and whatever has a converter."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "markdown").lower()]

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(self.options)

    def streamReader(self, schema) -> OfficeStream:  # noqa: N802
        return OfficeStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(OfficeFiles)


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write a file of a folder whole or not at all; another attempt of the same task writes the same."""
    import uuid

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    draft, path = f"{root}/.{name}-{uuid.uuid4().hex}", f"{root}/{name}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, path)
    return path
