"""spark.read.format("docblocks").load(path): the blocks of files in a folder, one partition a file.

For folders that driver and executors both see; for other stores use sources.blocks.read_files, which reads through Spark.
"""

from __future__ import annotations

import os
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gneiss.sources.blocks import BINARY_READERS, FIELDS, TEXT_READERS, read

NAMES = [x.split(" ")[0] for x in FIELDS.split(", ")]


class DocBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docblocks"

    def schema(self) -> str:
        return f"path string, title string, pos int, {FIELDS}"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        known = {*TEXT_READERS, *BINARY_READERS}
        files = [os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names] if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in sorted(files) if f.rpartition(".")[2].lower() in known] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        doc = read(partition.value)
        for pos, b in enumerate(doc.blocks):
            x = asdict(b)
            yield (partition.value, doc.title, pos, *(x[n] for n in NAMES))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocBlocks)
