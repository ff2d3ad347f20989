"""Listings of files as a data source, in batches and streams: `register(spark)`, then `spark.read.format("listing")`.

Options: `path`, and `kind`: `folder` (the files below it, a partition for each folder) or `manifest` (a folder of pages, each a file of JSON
lines with path, folder, file_name, size_bytes and modified_time, as a drive or another store lists itself; a partition for each page).
Folders are reached through `pyarrow.fs`, so a path may be a local one or a URL that it knows.

Filters on folder and file_type (equality, IN, prefixes of folders) are answered here: folders they exclude are neither walked nor listed,
and Spark does not evaluate them again. As a stream, a folder gives the files changed since the last batch up to `settle` seconds ago
(default 1), a manifest its new pages (by name, so later pages must sort after earlier ones).
"""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

SCHEMA = "path string, folder string, file_name string, file_type string, size_bytes bigint, modified_time timestamp"


def file_type(name: str) -> str:
    """The extension in lower case, empty for a name without one."""
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


class Place(InputPartition):
    """A folder or page to list, and the times (milliseconds, from exclusive, to inclusive) of the files wanted."""

    def __init__(self, where: str, after: int | None = None, upto: int | None = None):
        self.where, self.after, self.upto = where, after, upto


class Wanted:
    """What filters leave: folders and types (None for all), and prefixes that a folder must all have."""

    def __init__(self) -> None:
        self.folders: set[str] | None = None
        self.types: set[str] | None = None
        self.prefixes: list[str] = []

    def add(self, f: Filter) -> bool:
        """Takes a filter over, if it can be answered here."""
        column = f.attribute if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) else None
        if column not in (("folder",), ("file_type",)):
            return False
        if isinstance(f, IsNotNull):
            return True  # neither is ever null
        if isinstance(f, StringStartsWith):
            if column == ("folder",):
                self.prefixes.append(f.value)
            return column == ("folder",)
        values = {f.value} if isinstance(f, EqualTo) else set(f.value)
        if column == ("folder",):
            self.folders = values if self.folders is None else self.folders & values
        else:
            self.types = values if self.types is None else self.types & values
        return True

    def folder(self, name: str) -> bool:
        return (self.folders is None or name in self.folders) and all(name.startswith(p) for p in self.prefixes)

    def below(self, name: str) -> bool:
        """Whether a folder or one below it can be wanted."""
        under = lambda x: name == "" or x == name or x.startswith(name + "/")
        return (self.folders is None or any(map(under, self.folders))) and all(under(p) or name.startswith(p) or p.startswith(name) for p in self.prefixes)

    def row(self, row: tuple) -> bool:
        return self.folder(row[1]) and (self.types is None or row[3] in self.types)


class Store:
    """Folders and pages under a path."""

    def __init__(self, options: dict):
        self.path, self.kind, self.settle = options["path"], options.get("kind", "folder"), float(options.get("settle", 1))
        if self.kind not in ("folder", "manifest"):
            raise ValueError("kind is folder or manifest")

    def _fs(self) -> tuple[fs.FileSystem, str]:
        found, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return found, root.rstrip("/")

    def folders(self, wanted: Wanted) -> Iterator[str]:
        """Names of folders relative to the path, from the top down, of those that can be wanted."""
        files, root = self._fs()
        todo = [""]
        while todo:
            name = todo.pop()
            if wanted.folder(name):
                yield name
            below = [i for i in files.get_file_info(fs.FileSelector(posixpath.join(root, name) if name else root)) if i.type == fs.FileType.Directory]
            todo += sorted((x for i in below if wanted.below(x := i.path[len(root) :].strip("/"))), reverse=True)

    def pages(self) -> list[str]:
        files, root = self._fs()
        return sorted(i.path for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))

    def rows(self, place: Place, wanted: Wanted) -> Iterator[tuple]:
        files, root = self._fs()
        if self.kind == "manifest":
            with files.open_input_stream(place.where) as f:
                for line in f.read().decode().splitlines():
                    x = json.loads(line)
                    at = x.get("modified_time")
                    row = (x.get("path"), x.get("folder") or "", x.get("file_name") or "", file_type(x.get("file_name") or ""), x.get("size_bytes"), datetime.fromisoformat(at).replace(tzinfo=UTC) if at else None)
                    if wanted.row(row):
                        yield row
            return
        for i in files.get_file_info(fs.FileSelector(posixpath.join(root, place.where) if place.where else root)):
            if i.type != fs.FileType.File:
                continue
            row, at = (i.path, place.where, i.base_name, file_type(i.base_name), i.size, i.mtime), i.mtime_ns // 1_000_000
            if wanted.row(row) and (place.after is None or place.after < at <= place.upto):
                yield row


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.store, self.wanted = Store(options), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.add(f):
                yield f

    def partitions(self) -> list[Place]:
        return [Place(x) for x in (self.store.pages() if self.store.kind == "manifest" else self.store.folders(self.wanted))] or [Place(None)]

    def read(self, partition: Place) -> Iterator[tuple]:
        return iter(()) if partition.where is None else self.store.rows(partition, self.wanted)


class ListingStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.store = Store(options)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": len(self.store.pages()) if self.store.kind == "manifest" else int((time.time() - self.store.settle) * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Place]:
        if self.store.kind == "manifest":
            return [Place(x) for x in self.store.pages()[start["at"] : end["at"]]]
        return [Place(x, start["at"], end["at"]) for x in self.store.folders(Wanted())]

    def read(self, partition: Place) -> Iterator[tuple]:
        return self.store.rows(partition, Wanted())


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)
