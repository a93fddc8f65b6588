"""Landed pages as a Spark source, a partition a page, in batch and stream; and a sink of one file a row, which is there as a whole or not at all."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.sources import boards

PAGES = "source string, employer string, base string, seq long, page string, payload string"
FILES = "name string, content string"
#: How often an abort looks for what tasks left, and the seconds between.
ABORT_TRIES, ABORT_WAIT = 5, 0.4


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; driver and tasks must reach it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def _names(path: str) -> list[str]:
    """Names of a folder's pages, ascending; hidden ones aren't pages."""
    files, root = _store(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")))


@dataclass
class Page(InputPartition):
    name: str
    seq: int


class _Pages:
    """What reading a page gives, in batch and stream."""

    def __init__(self, options: dict[str, str]):
        self.path, self.said = options["path"], tuple(options.get(k) for k in ("source", "employer", "base"))

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # an empty folder
            return
        files, root = _store(self.path)
        with files.open_input_stream(f"{root}/{partition.name}") as stream:
            text = stream.read().decode("utf-8", "replace")
        yield (*self.said, partition.seq, partition.name, text)


class PagesReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(name, k) for k, name in enumerate(_names(self.path))]


class PagesStream(_Pages, DataSourceStreamReader):
    """Offsets are the name of the last page read: new pages must land under names that come after those before."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(name, k) for k, name in enumerate(_names(self.path)) if start["after"] < name <= end["after"]]

    def commit(self, end: dict) -> None:
        pass


class Landed(DataSource):
    """format("landed"): the pages of a folder (option path) with the options source, employer and base as columns."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    rows: int


class FilesWriter(DataSourceWriter):
    """Tasks write below a hidden folder beside the target; the commit puts it in the target's place, an abort removes it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staged = path.rstrip("/"), overwrite, f".staged-{uuid.uuid4().hex}"

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        files, root = _store(self.path)
        parent, _, last = root.rpartition("/")
        return files, root, f"{parent}/{self.staged}-{last}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, _, staged = self._places()
        rows = 0
        for row in iterator:
            folder, _, _ = f"{staged}/{row.name}".rpartition("/")
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{staged}/{row.name}") as out:
                out.write((row.content or "").encode())
            rows += 1
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, staged = self._places()
        files.create_dir(staged, recursive=True)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            if not self.overwrite:
                files.delete_dir(staged)
                raise FileExistsError(self.path)
            files.delete_dir(root)
        files.move(staged, root)

    def abort(self, messages: list[Written | None]) -> None:
        # Tasks of the failed write may still be at work for a moment, and put files where others were just removed.
        files, _, staged = self._places()
        for _ in range(ABORT_TRIES):
            try:
                files.delete_dir(staged)
            except FileNotFoundError:
                pass
            except OSError:
                continue
            finally:
                time.sleep(ABORT_WAIT)


class Files(DataSource):
    """format("onefile"): each row (name, content) a file below a folder (option path)."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (Landed, Files):
        spark.dataSource.register(source)


def postings(spark: SparkSession, path: str, kind: str | boards.FieldMap, source: str, employer: str, base: str = "") -> DataFrame:
    """The postings of a folder of landed pages of one kind of board, see boards.parse."""
    register(spark)
    pages = spark.read.format("landed").options(path=path, source=source, employer=employer, base=base).load()
    return boards.parse(pages, kind, base="base")


def write_files(df: DataFrame, path: str, name: str = "name", content: str = "content", overwrite: bool = False) -> None:
    """Each row of df a file of its own: `name` is its path below the folder, `content` its text (null is empty).

    Names that repeat, whatever their case, that are empty or null, or that lead out of the folder are an error before anything is
    written.  Files appear together at the end; a write that fails leaves the folder as it was.  A task that is run again writes the same files.
    """
    register(df.sparkSession)
    rows = df.select(F.col(name).alias("name"), F.col(content).alias("content"))
    bad = rows.where(F.col("name").isNull() | (F.trim("name") == "") | F.col("name").rlike(r"(^|/)\.\.?(/|$)|^/|/$|//|\\|^[._]")).limit(5)
    again = rows.groupBy(F.lower("name").alias("name")).count().where("count > 1").limit(5)
    for what, found in (("no names of files", bad), ("names that repeat", again)):
        said = [r.name for r in found.select("name").collect()]
        if said:
            raise ValueError(f"{what}: {said}")
    rows.write.format("onefile").option("path", path).mode("overwrite" if overwrite else "append").save()
