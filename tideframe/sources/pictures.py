"""Pictures written by executors to any file system, so that a folder holds those of one finished write and no others.

Tasks write below a staging folder of the job, each attempt in a folder of its own. What attempts have committed is moved into
place when all have; an attempt that fails, and one whose result isn't used, leaves nothing that anyone sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .measure import open_file

SCHEMA = "name string, source string, data binary"
_STAGING = "_staging"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path on it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class PictureWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self._root, self._job = options["path"], options.get("job") or uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{located(self._root)[1]}/{_STAGING}/{self._job}"

    def write(self, iterator: Iterator) -> Written:
        system, _ = located(self._root)
        folder, names = f"{self._staging()}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        for name, source, data in iterator:
            if data is None and source is None:
                continue
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(data) if data is not None else open_file(source))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        """All attempts that count, gathered in one folder of the job; :func:`promote` moves it into place."""
        system, _ = located(self._root)
        done = f"{self._staging()}/done"
        system.create_dir(done, recursive=True)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{m.folder}/{name}", f"{done}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self._root)
        if system.get_file_info(self._staging()).type == fs.FileType.Directory:
            system.delete_dir(self._staging())


class PictureSink(DataSource):
    """``df.write.format("tideframe-pictures").option("job", name).mode("append").save(folder)`` of SCHEMA: a picture's bytes, or
    where to copy it from; rows without either are left out."""

    @classmethod
    def name(cls) -> str:
        return "tideframe-pictures"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options)


class Pictures:
    """A write of a folder's pictures in two steps: staged by executors, then put in place of those that are there."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.dataSource.register(PictureSink)
        self._folder, self._job = folder, uuid.uuid4().hex

    def stage(self, rows: DataFrame) -> list[str]:
        """Write SCHEMA's rows and return the names written, of which the caller's manifest is the bound."""
        rows.select("name", "source", "data").write.format("tideframe-pictures").option("job", self._job).mode("append").save(self._folder)
        system, root = located(self._folder)
        done = fs.FileSelector(f"{root}/{_STAGING}/{self._job}/done", allow_not_found=True)
        return sorted(x.base_name for x in system.get_file_info(done))

    def promote(self) -> None:
        """Put what was staged in place, and remove what a write before left and this one hasn't."""
        system, root = located(self._folder)
        done = f"{root}/{_STAGING}/{self._job}/done"
        new = {x.base_name for x in system.get_file_info(fs.FileSelector(done, allow_not_found=True))}
        for name in sorted(new):
            system.move(f"{done}/{name}", f"{root}/{name}")
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.type == fs.FileType.File and x.base_name not in new:
                system.delete_file(x.path)
        if system.get_file_info(f"{root}/{_STAGING}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{_STAGING}")
