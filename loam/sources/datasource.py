"""``spark.read.format("loam_rows")``: a table's row numbers as a data source, over which any cell expression runs.

    spark.dataSource.register(RowNumbers)
    spark.read.format("loam_rows").option("rows", 1000).load()
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class RowReader(DataSourceReader):
    def __init__(self, rows: int, size: int):
        self.rows, self.size = rows, size

    def partitions(self):
        return [Range(a, min(a + self.size, self.rows)) for a in range(0, max(1, self.rows), self.size)]

    def read(self, partition):
        yield from ((i,) for i in range(partition.start, partition.stop))


class RowNumbers(DataSource):
    """The row numbers of a table of ``rows`` rows (option), ``size`` a partition."""

    @classmethod
    def name(cls):
        return "loam_rows"

    def schema(self):
        return "row bigint"

    def reader(self, schema):
        return RowReader(int(self.options.get("rows", 0)), int(self.options.get("size", 1_000_000)))
