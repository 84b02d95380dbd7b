"""A data source that reads .npy files slice by slice."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


@dataclass
class Slice(InputPartition):
    file: str
    start: int
    stop: int


class ArraySlices(DataSource):
    """Options: path (a file or a glob), columns (one name a line), rows (of a slice, at most)."""

    @classmethod
    def name(cls) -> str:
        return "npy_slices"

    def columns(self) -> list[str]:
        return self.options["columns"].split("\n")

    def schema(self) -> StructType:
        return StructType([StructField("file", StringType()), StructField("row_id", LongType()), *[StructField(c, DoubleType()) for c in self.columns()]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SliceReader(self.options["path"].removeprefix("file://"), self.columns(), int(self.options.get("rows", 1 << 20)))


class SliceReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], rows: int):
        self.path, self.names, self.rows = path, columns, max(1, rows)

    def partitions(self) -> list[Slice]:
        """Headers alone are read here."""
        import glob

        import numpy as np

        found = []
        for file in sorted(glob.glob(self.path)):
            shape = np.load(file, mmap_mode="r", allow_pickle=False).shape
            width = int(np.prod(shape[1:]))
            if width != len(self.names):
                raise ValueError(f"{file} has {width} columns, not {len(self.names)}")
            found += [Slice(file, at, min(at + self.rows, shape[0])) for at in range(0, shape[0], self.rows)]
        return found or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if partition.stop <= partition.start:
            return
        whole = np.load(partition.file, mmap_mode="r", allow_pickle=False)
        for at in range(partition.start, partition.stop, 1 << 16):
            part = np.asarray(whole[at : min(at + (1 << 16), partition.stop)], dtype="float64").reshape(-1, len(self.names))
            ids = np.arange(at, at + len(part))
            yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(part)), pa.array(ids), *[pa.array(part[:, k]) for k in range(len(self.names))]], names=["file", "row_id", *self.names])
