"""A data source over stored graph tables that takes predicates with it.

``spark.read.format("sextant_graph").option("path", ...)`` plans one partition for each row group of the stored Parquet files
that the pushed predicates cannot rule out by its statistics, and reads only rows that fulfil them. Paths are resolved by
pyarrow's file systems, on the driver and on executors alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

NAME = "sextant_graph"
_COMPARED = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


def expression(f: Filter) -> pc.Expression | None:
    """A pushed predicate as one of pyarrow; None for what stays with Spark."""
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name is None:
        return None
    column = ds.field(name)
    if isinstance(f, IsNotNull):
        return column.is_valid()
    if isinstance(f, IsNull):
        return column.is_null()
    if isinstance(f, In):
        return column.isin(list(f.value))
    if isinstance(f, StringStartsWith):
        return pc.starts_with(column, f.value)
    for kind, compare in _COMPARED.items():
        if type(f) is kind:
            return getattr(column, compare)(f.value)
    return None


class RowGroup(InputPartition):
    def __init__(self, path: str, group: int, rows: int):
        super().__init__((path, group))
        self.path, self.group, self.rows = path, group, rows


class GraphReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, columns: list[str]):
        self.uri, self.schema, self.columns = uri, schema, columns
        self.kinds: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if expression(f) is None:
                yield f
            else:
                self.kinds.append(f)

    def _filter(self) -> pc.Expression | None:
        out = None
        for f in self.kinds:
            out = expression(f) if out is None else out & expression(f)
        return out

    def partitions(self) -> list[RowGroup]:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        found, wanted = [], self._filter()
        for fragment in ds.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).get_fragments():
            fragment.ensure_complete_metadata()
            for part in fragment.split_by_row_group(wanted):
                found += [RowGroup(part.path, g.id, g.num_rows) for g in part.row_groups]
        return found

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        fragment = ds.ParquetFileFormat().make_fragment(partition.path, filesystem=fs, row_groups=[partition.group])
        for batch in fragment.to_batches(columns=self.columns, filter=self._filter()):
            if batch.num_rows:
                yield batch


class GraphSource(DataSource):
    """Options: ``path``, a folder of Parquet files as a URI; ``columns``, those to read, comma-separated (all if absent)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _uri(self) -> str:
        path = self.options["path"]
        return path if "://" in path else f"file://{path.removeprefix('file:')}"

    def schema(self) -> StructType:
        fs, path = pafs.FileSystem.from_uri(self._uri())
        whole = ds.dataset(path, filesystem=fs, format="parquet").schema
        wanted = self.options.get("columns")
        names = [c.strip() for c in wanted.split(",")] if wanted else whole.names
        return from_arrow_schema(pa.schema([whole.field(c) for c in names]))

    def reader(self, schema: StructType) -> GraphReader:
        return GraphReader(self._uri(), schema, schema.names)


def read_graph(spark: SparkSession, path: str, columns: list[str] | None = None):
    """A stored graph table through the source; predicates on it are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GraphSource)
    r = spark.read.format(NAME).option("path", path)
    return (r.option("columns", ",".join(columns)) if columns else r).load()
