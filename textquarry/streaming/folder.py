"""A folder as a stream of listings: one row a file and a mark for each scan, with offsets that survive restarts.

``spark.readStream.format("folder").option("path", ...).option("state", ...).load()`` gives path,
mtime, size, scan and complete.  An offset is the number of a scan; a scan that differs
from the one before is written to the state folder before its number is used, so a batch that is run again
reads the same listing.  The row without a path says whether the scan saw everything.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, mtime double, size long, scan long, complete boolean"


def _system(path: str):
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def listing(path: str, suffix: str) -> tuple[list[list], bool]:
    """(path, mtime, size) of the files below a folder, sorted, and whether every folder could be read."""
    from pyarrow import fs

    system, root = _system(path)
    files, complete, todo = [], True, [root]
    while todo:
        try:
            found = system.get_file_info(fs.FileSelector(todo.pop()))
        except (OSError, PermissionError):
            complete = False
            continue
        for f in found:
            if f.type == fs.FileType.Directory:
                todo.append(f.path)
            elif f.type == fs.FileType.File and f.path.endswith(suffix):
                files.append([f.path, f.mtime_ns / 1e9 if f.mtime_ns else 0.0, f.size])
    return sorted(files), complete


class _Scan(InputPartition):
    def __init__(self, number: int):
        self.number = number


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.state = options["state"].rstrip("/")

    def _stored(self, number: int) -> dict | None:
        system, root = _system(self.state)
        try:
            with system.open_input_stream(f"{root}/{number:09d}.json") as f:
                return json.loads(f.read())
        except (OSError, FileNotFoundError):
            return None

    def _newest(self) -> int:
        from pyarrow import fs

        system, root = _system(self.state)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return max((int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json")), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"scan": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self._newest()
        files, complete = listing(self.path, self.suffix)
        now = {"files": files, "complete": complete}
        if now == self._stored(last):
            return {"scan": last}
        system, root = _system(self.state)
        system.create_dir(root, recursive=True)
        part = f"{root}/.{last + 1:09d}.part"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(now).encode())
        system.move(part, f"{root}/{last + 1:09d}.json")
        return {"scan": last + 1}

    def partitions(self, start: dict, end: dict) -> list[_Scan]:
        # Each listing is whole, so the newest tells all.
        return [_Scan(end["scan"])] if end["scan"] > start["scan"] else []

    def read(self, partition: _Scan) -> Iterator[tuple]:
        found = self._stored(partition.number)
        if found is not None:
            yield None, None, None, partition.number, found["complete"]
            for path, mtime, size in found["files"]:
                yield path, mtime, size, partition.number, found["complete"]


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:  # noqa: N802
        return FolderReader(self.options)


def folder_stream(spark: SparkSession, path: str, state: str, suffix: str = ".zim") -> DataFrame:
    """The listings of a folder whose file names end in ``suffix``, as a stream; ``state`` is a shared folder."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").option("path", path).option("state", state).option("suffix", suffix).load()
