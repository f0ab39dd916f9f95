"""Texts in archives: a data source of tar and zip files, ``spark.read.format("archive")``.

Each archive is one partition, read as a stream by the task that has it; no archive is held whole. Wanted ids, as an
equality or a list in the query's filter, reach the reader, which decodes only those members and ends when it has them all.
Archives have to lie in a folder that all executors share.
"""

from __future__ import annotations

import glob
import os
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "archive string, doc_id string, text string"


class Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def members(path: str, suffix: str, wanted: set[str] | None) -> Iterator[tuple[str, bytes]]:
    """(id, contents) of the files with this suffix; of several with one id the first counts where ids are wanted."""
    left = None if wanted is None else set(wanted)

    def asked(name: str) -> str | None:
        base = name.rsplit("/", 1)[-1]
        found = base[: len(base) - len(suffix)] if base.endswith(suffix) else None
        return found if found is not None and (left is None or found in left) else None

    if left is not None and not left:
        return
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            for info in z.infolist():
                if not info.is_dir() and (found := asked(info.filename)) is not None:
                    yield found, z.read(info)
                    if left is not None:
                        left.discard(found)
                        if not left:
                            return
        return
    with tarfile.open(path, "r|*") as tar:
        for info in tar:
            if info.isfile() and (found := asked(info.name)) is not None and (held := tar.extractfile(info)) is not None:
                yield found, held.read()
                if left is not None:
                    left.discard(found)
                    if not left:
                        return


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(p for part in options["path"].split(",") for p in (glob.glob(os.path.join(part, "*")) if os.path.isdir(part) else [part]))
        self.suffix, self.wanted = options.get("suffix", ".txt"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ids are taken from the filters, which Spark applies again."""
        for f in filters:
            got = {f.value} if isinstance(f, EqualTo) and f.attribute == ("doc_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("doc_id",) else None
            if got is not None:
                self.wanted = got if self.wanted is None else self.wanted & got
            yield f

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths]

    def read(self, partition: Archive) -> Iterator[tuple[str, str, str]]:
        for doc_id, data in members(partition.path, self.suffix, self.wanted):
            yield os.path.basename(partition.path), doc_id, data.decode("utf-8", "replace")


class ArchiveSource(DataSource):
    """Options: ``path`` (files or folders, joined by commas) and ``suffix`` of the members (.txt)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, ids: list[str] | None = None, suffix: str = ".txt") -> DataFrame:
    """(archive, doc_id, text) of all members, or of those in ``ids``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    rows = spark.read.format("archive").option("suffix", suffix).load(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(ids))
