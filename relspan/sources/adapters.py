"""Adapters from Python values, paths and tables to DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import ClassVar, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relspan.plans.frame import hidden

#: The hidden column that holds the places of rows with an order of their own.
PLACE = hidden()


class Adapter(Protocol):
    def supports(self, x: object) -> bool: ...

    def to_df(self, spark: SparkSession, x: object) -> DataFrame: ...


def rows_to_df(spark: SparkSession, rows: list) -> DataFrame:
    """Rows of dictionaries (or values, as column `value`) with their places in a last column, PLACE."""
    if not rows:
        return spark.createDataFrame([], f"value string, {PLACE} long")
    if isinstance(rows[0], Row):
        rows = [r.asDict(recursive=True) for r in rows]
    if not isinstance(rows[0], dict):
        rows = [{"value": v} for v in rows]
    names = list(dict.fromkeys(k for r in rows for k in r))
    known = [n for n in names if any(r.get(n) is not None for r in rows)]
    plain = [Row(**{n: _struct(r.get(n)) for n in known}, **{PLACE: i}) for i, r in enumerate(rows)]
    df = spark.createDataFrame(plain, samplingRatio=1.0)
    # A column of nulls only is one of texts.
    return df.select(*[F.col(f"`{n}`") if n in known else F.lit(None).cast("string").alias(n) for n in names], PLACE)


def _struct(v: object) -> object:
    return Row(**{k: _struct(x) for k, x in v.items()}) if isinstance(v, dict) and v else [_struct(x) for x in v] if isinstance(v, list) else v


class DataFrameAdapter:
    def supports(self, x: object) -> bool:
        return isinstance(x, DataFrame)

    def to_df(self, spark: SparkSession, x: object) -> DataFrame:
        return x


def _version(spark: SparkSession, path: str) -> tuple | None:
    """What changes when the files under a path do; None if the path is not one file or folder."""
    if set(path) & set("*?[{"):
        return None
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(jvm_path):
        return None
    status, sizes = fs.getFileStatus(jvm_path), fs.getContentSummary(jvm_path)
    return fs.makeQualified(jvm_path).toString(), status.getModificationTime(), sizes.getLength(), sizes.getFileCount(), sizes.getDirectoryCount()


class PathAdapter:
    """A path to Parquet, CSV, JSON lines or ORC by its ending, else a table's name."""

    #: Schemas by path and version of the files: Spark takes a job to read one.
    SCHEMAS: ClassVar[dict[tuple, StructType]] = {}
    READERS: ClassVar[dict[str, str]] = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc"}

    def supports(self, x: object) -> bool:
        return isinstance(x, str)

    def to_df(self, spark: SparkSession, x: object) -> DataFrame:
        kind = next((k for end, k in self.READERS.items() if x.rstrip("/").endswith(end)), None)
        if kind is None:
            return spark.table(x)
        reader = (spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read).format(kind)
        version = _version(spark, x)
        if version is None:
            return reader.load(x)
        if version not in self.SCHEMAS:
            df = reader.load(x)
            self.SCHEMAS[version] = df.schema
            return df
        return reader.schema(self.SCHEMAS[version]).load(x)


class PandasAdapter:
    def supports(self, x: object) -> bool:
        return type(x).__module__.startswith("pandas") and type(x).__name__ == "DataFrame"

    def to_df(self, spark: SparkSession, x: object) -> DataFrame:
        return spark.createDataFrame(x).withColumn(PLACE, F.monotonically_increasing_id()) if len(x) else spark.createDataFrame(x)


class IterableAdapter:
    """Lists, generators and other iterables of dictionaries, rows or values."""

    def supports(self, x: object) -> bool:
        return isinstance(x, Iterable) and not isinstance(x, (str, bytes))

    def to_df(self, spark: SparkSession, x: object) -> DataFrame:
        return rows_to_df(spark, list(x.values()) if isinstance(x, dict) else list(x))


@dataclass
class AdapterRegistry:
    """Adapters by falling priority; of one priority, the first registered goes first."""

    entries: list[tuple[int, Adapter]] = field(default_factory=lambda: [(30, DataFrameAdapter()), (30, PathAdapter()), (20, PandasAdapter()), (0, IterableAdapter())])

    def register(self, adapter: Adapter, priority: int = 0) -> None:
        self.entries.append((priority, adapter))
        self.entries.sort(key=lambda e: -e[0])

    def find(self, x: object) -> Adapter | None:
        return next((a for _, a in self.entries if a.supports(x)), None)

    def all(self) -> list[Adapter]:
        return [a for _, a in self.entries]

    def count(self) -> int:
        return len(self.entries)
