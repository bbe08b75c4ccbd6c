"""Tables by name: declared schema, unique keys, storage kind and statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.sources.parquet import read_zoned

#: Storage kind -> options it takes, and the storage level that stands for it.
STORAGE = {
    "boost_shared_memory": ((), StorageLevel.MEMORY_AND_DISK),
    "system_memory": ((), StorageLevel.MEMORY_AND_DISK),
    "pinned_memory": ((), StorageLevel.MEMORY_AND_DISK),
    "managed_memory": ((), StorageLevel.MEMORY_AND_DISK),
    "device_memory": (("device_id",), StorageLevel.MEMORY_AND_DISK),
    "numa_pool_memory": (("numa_node_id",), StorageLevel.MEMORY_AND_DISK),
    "shared_numa_pool_memory": (("numa_node_id",), StorageLevel.MEMORY_AND_DISK),
    "numa_memory": (("numa_node_set", "page_kind"), StorageLevel.MEMORY_AND_DISK),
    "numa_pinned_memory": (("numa_node_set", "page_kind"), StorageLevel.MEMORY_AND_DISK),
    "parquet_file": (("location",), None),
}
_PAGE_KINDS = ("system_default", "small", "transparent_huge", "huge2mb", "huge1gb")


def check_storage(options: dict) -> tuple[str, dict]:
    """(kind, other options) of a WITH clause; unknown kinds and options, and values of a wrong type, raise."""
    options = dict(options)
    kind = options.pop("storage_kind", "boost_shared_memory")
    if not isinstance(kind, str):
        raise ValueError("storage_kind must be a string")
    kind = kind.lower()
    if kind not in STORAGE:
        raise ValueError(f"unknown storage_kind {kind!r}; valid: {', '.join(STORAGE)}")
    for k, v in options.items():
        if k not in STORAGE[kind][0]:
            raise ValueError(f"option {k!r} is not valid for storage_kind {kind!r}")
        if k in ("device_id", "numa_node_id") and (not isinstance(v, int) or v < 0):
            raise ValueError(f"{k} must be an unquoted integer of 0 or more")
        if k == "numa_node_set" and not (isinstance(v, list) and all(isinstance(x, int) and x >= 0 for x in v)):
            raise ValueError("numa_node_set must be an integer list, such as ARRAY[0, 1]")
        if k == "page_kind" and (not isinstance(v, str) or v.lower() not in _PAGE_KINDS):
            raise ValueError(f"page_kind must be one of {', '.join(_PAGE_KINDS)}")
    if kind == "parquet_file" and not isinstance(options.get("location"), str):
        raise ValueError("storage_kind 'parquet_file' needs a location")
    return kind, options


@dataclass
class TableInfo:
    name: str
    schema: T.StructType
    unique_keys: list[tuple[str, ...]] = field(default_factory=list)
    storage: str = "boost_shared_memory"
    options: dict = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    rows: int = 0
    frame: DataFrame | None = None
    backed: bool = False
    parts: list[DataFrame] = field(default_factory=list)
    zones: str | None = None

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def location(self) -> str | None:
        return self.options.get("location")


class Catalog:
    """Names are registered once; unknown ones raise. Each table is also a temp view, so SQL sees it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, TableInfo] = {}

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._tables

    def table(self, name: str) -> TableInfo:
        if name.lower() not in self._tables:
            raise KeyError(f"no table {name!r}")
        return self._tables[name.lower()]

    def register(self, name: str, schema: T.StructType, unique_keys=(), storage: str = "boost_shared_memory", options: dict | None = None, partition_by=()) -> TableInfo:
        if name in self:
            raise ValueError(f"table {name!r} exists")
        names = schema.fieldNames()
        if len({n.lower() for n in names}) != len(names):
            raise ValueError("a column name repeats")
        for key in unique_keys:
            if not key or not set(key) <= set(names):
                raise ValueError(f"key {tuple(key)!r} names no column of {name!r}")
        kind, options = check_storage({"storage_kind": storage, **(options or {})})
        info = TableInfo(name, schema, [tuple(sorted(set(k))) for k in unique_keys], kind, options, tuple(partition_by))
        self._tables[name.lower()] = info
        self._refresh(info, empty=kind != "parquet_file")
        return info

    def register_frame(self, name: str, df: DataFrame, unique_keys=(), rows: int | None = None) -> TableInfo:
        """A table over an existing DataFrame, not copied; ``rows`` if known, else it is counted on demand."""
        if name in self:
            raise ValueError(f"table {name!r} exists")
        info = TableInfo(name, df.schema, [tuple(sorted(set(k))) for k in unique_keys], rows=rows or 0, frame=df, backed=True)
        self._tables[name.lower()] = info
        df.createOrReplaceTempView(name)
        return info

    def register_zoned(self, name: str, path: str, unique_keys=(), rows: int | None = None) -> TableInfo:
        """A table that ``write_zoned`` wrote; plans that filter it read only the zones that may hold a row."""
        info = self.register_frame(name, read_zoned(self.spark, path), unique_keys, rows)
        info.zones = path
        return info

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self:
            if if_exists:
                return
            raise KeyError(f"no table {name!r}")
        info = self._tables.pop(name.lower())
        for part in info.parts:
            part.unpersist()
        self.spark.catalog.dropTempView(info.name)

    def _refresh(self, info: TableInfo, empty: bool = False) -> None:
        if info.storage == "parquet_file" and not info.backed:
            info.frame = read_declared(self.spark, info.location, info.schema)
        elif empty:
            info.frame = self.spark.createDataFrame([], info.schema)
        info.frame.createOrReplaceTempView(info.name)

    def frame(self, name: str) -> DataFrame:
        return self.table(name).frame

    def append(self, name: str, df: DataFrame) -> int:
        """Appends the columns of ``df``, by position, cast to the declared types; gives the rows written."""
        info = self.table(name)
        if len(df.columns) != len(info.columns):
            raise ValueError(f"table {name!r} has {len(info.columns)} columns, not {len(df.columns)}")
        new = df.select(*[df[f"`{c}`"].cast(f.dataType).alias(f.name) for c, f in zip(df.columns, info.schema, strict=True)])
        if info.storage == "parquet_file":
            seen = Observation()
            writer = new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
            (writer.partitionBy(*info.partition_by) if info.partition_by else writer).parquet(info.location)
            n = seen.get["n"]
            self._refresh(info)
        else:
            # each append keeps its own rows; what was kept before is not kept again
            part = new.persist(STORAGE[info.storage][1])
            n = part.count()
            info.frame = part if not info.parts and not info.backed else info.frame.unionByName(part)
            info.parts.append(part)
            info.backed = False
            info.frame.createOrReplaceTempView(info.name)
        info.rows += n
        return n

    def tables(self) -> DataFrame:
        """``table_name, storage_kind, row_count, schema, unique_keys`` of each table."""
        rows = [(t.name, t.storage, t.rows, json.dumps([[f.name, f.dataType.simpleString()] for f in t.schema]), json.dumps(t.unique_keys)) for t in self._tables.values()]
        return self.spark.createDataFrame(rows, "table_name string, storage_kind string, row_count bigint, schema string, unique_keys string")

    def save(self, name: str, path: str) -> None:
        """A snapshot of a table: its rows as Parquet in the declared order of columns."""
        self.frame(name).write.mode("overwrite").parquet(path)

    def load(self, name: str, path: str, schema: T.StructType | None = None, unique_keys=()) -> TableInfo:
        """A table from a snapshot, with the declared schema if there is one."""
        df = read_declared(self.spark, path, schema) if schema is not None else self.spark.read.parquet(path)
        info = self.register(name, df.schema, unique_keys)
        self.append(name, df)
        return info


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_declared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet directory with the declared schema: the file's types are cast to it, never taken over; a
    directory that doesn't exist yet is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    return df.select(*[df[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema])
