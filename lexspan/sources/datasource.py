"""The markup formats as a data source:

spark.dataSource.register(UnitSource)
spark.read.format("lexspan_units").option("kind", "uslm").load("/folder")

For file systems that Arrow knows (local, hdfs, s3, gs); markup.read() reads any that Spark does."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexspan.sources import markup


class UnitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexspan_units"

    def schema(self) -> str:
        return markup.UNIT_SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return UnitReader(self.options["path"], self.options.get("kind", "uslm"))


class UnitReader(DataSourceReader):
    """One partition for each file below a path, of whatever file system Arrow knows."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        where, path = _open(self.path)
        if where.get_file_info(path).type == fs.FileType.File:
            return [InputPartition(self.path)]
        suffix = ".html" if self.kind == "ca_html" else ".xml"
        found = where.get_file_info(fs.FileSelector(path, recursive=True))
        base = self.path.rstrip("/")
        return [InputPartition(base + f.path[len(path.rstrip("/")) :]) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(suffix)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [f.name for f in markup._ARROW]
        where, path = _open(partition.value)
        with where.open_input_stream(path) as f:
            content = f.read()
        for r in markup.FORMATS[self.kind](content):
            row = {"path": partition.value, **r}
            row["breakpoints"] = [(p["pos"], p["prio"]) for p in row.get("breakpoints") or []]
            row["notes"] = dict(row.get("notes") or [])
            yield tuple(row.get(n) for n in names)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)
