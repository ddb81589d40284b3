"""``spark.read.format("imgmeta")`` and writing pictures with ``df.write.format("imgfile")``.

The reader lists files of a local or mounted folder and parses a file per row; the
writer saves one file per row of ``(name string, content binary)``. For stores that only Spark
reads, use ``pixelloom.sources.images`` instead.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..codecs import registry
from .images import META

#: Files of one task.
FILES = 64


@dataclass
class Files(InputPartition):
    paths: list[str]


class MetaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", ".")
        self.limit = int(options.get("filesPerPartition", FILES))

    def partitions(self) -> list[Files]:
        paths = sorted(str(p) for p in Path(self.root).rglob("*") if p.is_file())
        return [Files(paths[i : i + self.limit]) for i in range(0, len(paths), self.limit)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            raw = Path(path).read_bytes()
            try:
                i = registry.info(raw)
                yield (path, len(raw), i.format, i.width, i.height, i.depth, i.frames, i.crc_ok, None, i.extra)
            except Exception as e:
                yield (path, len(raw), None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200], None)


class ImageMeta(DataSource):
    """Metadata of all image files under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "imgmeta"

    def schema(self) -> str:
        return META

    def reader(self, schema: StructType) -> MetaReader:
        return MetaReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Tasks write beside the target; the driver renames on commit, so a repeated task does no harm."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.root, exist_ok=True)
        done = []
        for k, row in enumerate(rows):
            part = os.path.join(self.root, f".{os.getpid()}-{os.urandom(4).hex()}-{k}.part")
            Path(part).write_bytes(row["content"])
            done.append((part, os.path.join(self.root, os.path.basename(row["name"]))))
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        for m in messages:
            for part, target in m.files if m else []:
                os.replace(part, target)

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            for part, _ in m.files if m else []:
                Path(part).unlink(missing_ok=True)


class ImageFile(DataSource):
    """Saves rows of ``name`` and ``content`` as files."""

    @classmethod
    def name(cls) -> str:
        return "imgfile"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(ImageMeta)
    spark.dataSource.register(ImageFile)
