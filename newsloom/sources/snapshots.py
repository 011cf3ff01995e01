"""Stored snapshots of feeds as a data source of Spark: a partition a snapshot, and what fails is a row.

    snapshots.load(spark, folder).where("source = 'daily'")
    snapshots.stream(spark, folder)

A snapshot is a file of JSON lines, an item each, in the folder `source=<name>`, as Spark writes them with partitionBy.
Batches read each snapshot in a task of its own, however many a source has; equality on `source` is pushed down, so that
other sources aren't touched.
The stream takes what is new of each source by the files' names, one snapshot of each at a time. Whatever goes wrong with a
source, at listing or reading, gives a row with its error and no item; the others are read. The folder is a path or a URI
that pyarrow's file systems open, and one that executors see.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "source string, snapshot string, seq int, title string, link string, published string, error string"


class OfSource(InputPartition):
    """A snapshot of a source, or all that can be said of one that can't be listed."""

    def __init__(self, source: str, name: str | None, error: str | None = None):
        self.source, self.name, self.error = source, name, error


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (fs.LocalFileSystem(), folder)
    return system, path.rstrip("/")


def sources_in(folder: str) -> list[str]:
    system, path = opened(folder)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory]
    return sorted(n.removeprefix("source=") for n in names if n.startswith("source="))


def snapshots_of(folder: str, source: str) -> list[str]:
    system, path = opened(folder)
    files = system.get_file_info(fs.FileSelector(f"{path}/source={source}"))
    return sorted(f.base_name for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._")


def items_of(folder: str, source: str, names: list[str] | None = None) -> Iterator[tuple]:
    """The rows of a source's snapshots (default: all). source: as its folder is named."""
    system, path = opened(folder)
    name, shown = None, unquote(source)
    try:
        for name in snapshots_of(folder, source) if names is None else names:
            with system.open_input_stream(f"{path}/source={source}/{name}") as f:
                lines = f.read().decode().splitlines()
            items = [json.loads(line) for line in lines]
            # items of one snapshot are all there or none is
            rows = [(shown, name, k, *(None if x.get(c) is None else str(x[c]) for c in ("title", "link", "published")), None) for k, x in enumerate(items)]
            yield from rows
    except Exception as e:  # noqa: BLE001 what stops one source must not stop the others
        yield (shown, name, None, None, None, None, told(e))


class Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source",):
                mine = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = mine if self.wanted is None else self.wanted & mine
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for source in sources_in(self.folder):
            if self.wanted is None or unquote(source) in self.wanted:
                try:
                    out += [OfSource(source, name) for name in snapshots_of(self.folder, source)]
                except OSError as e:
                    out.append(OfSource(source, None, told(e)))
        return out

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:
            return iter(())
        if partition.error:
            return iter([(unquote(partition.source), None, None, None, None, None, partition.error)])
        return items_of(self.folder, partition.source, [partition.name])


class Polled(SimpleDataSourceStreamReader):
    """Offsets are the last snapshot taken of each source. A poll takes the next one of every source that has one."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"last": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        last = dict(start["last"])
        rows: list[tuple] = []
        for source in sources_in(self.folder):
            try:
                new = [n for n in snapshots_of(self.folder, source) if n > last.get(source, "")][:1]
            except OSError as e:
                rows.append((unquote(source), None, None, None, None, None, told(e)))
                continue
            rows += items_of(self.folder, source, new)
            last.update({source: n for n in new})
        return iter(rows), {"last": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for source, until in sorted(end["last"].items()):
            after = start["last"].get(source, "")
            yield from items_of(self.folder, source, [n for n in snapshots_of(self.folder, source) if after < n <= until])

    def commit(self, end: dict) -> None:
        pass


class Snapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Batch(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return Polled(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Snapshots)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a reader that takes filters is refused
    return spark


def load(spark: SparkSession, folder: str) -> DataFrame:
    return registered(spark).read.format("snapshots").option("path", folder).load()


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return registered(spark).readStream.format("snapshots").option("path", folder).load()
