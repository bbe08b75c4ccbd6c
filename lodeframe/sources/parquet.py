"""Parquet reads pruned by partition values or by value ranges, and writes into a chosen number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import expressions as E
from lodeframe.functions.types import INTEGRAL


def read_partitions(spark: SparkSession, path: str, schema: T.StructType, column: str, haystack: DataFrame) -> DataFrame:
    """Rows of a ``column=value`` directory whose value is in the first column of ``haystack`` (nulls dropped).

    A semi join on the partition column: Spark lists only the matching directories (dynamic pruning).
    The haystack must be integral.
    """
    key = haystack.schema[0]
    if not isinstance(key.dataType, INTEGRAL):
        raise TypeError("the values to look for must be integers")
    values = haystack.select(F.col(f"`{key.name}`").cast("bigint").alias("_lodeframe_key")).where("_lodeframe_key IS NOT NULL").distinct()
    df = spark.read.schema(schema).parquet(path)
    return df.join(values, df[column].cast("bigint") == F.col("_lodeframe_key"), "left_semi").select(*schema.fieldNames())


def write_files(df: DataFrame, path: str, files: int | None = None, mode: str = "append", codec: str | None = None) -> None:
    """Parquet in ``files`` files (None: as many as the input has partitions), compressed by ``codec`` (Spark's names)."""
    writer = (df.repartition(files) if files else df).write.mode(mode)
    (writer.option("compression", codec) if codec else writer).parquet(path)


_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
_NEGATED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def zone_condition(e: E.Expr, negated: bool = False) -> E.Expr | None:
    """What a filter says about a zone's statistics: column i becomes its minimum ``Ref(2 * i)`` or maximum
    ``Ref(2 * i + 1)``. None: nothing. An AND drops sides that say nothing, an OR with one says nothing;
    under NOT the two change places, and comparisons turn round."""
    match e:
        case E.Not(c):
            return zone_condition(c, not negated)
        case E.Binary("and" | "or" as op, a, b):
            x, y = zone_condition(a, negated), zone_condition(b, negated)
            if (op == "and") != negated:
                return x if y is None else y if x is None else E.Binary("and", x, y)
            return None if x is None or y is None else E.Binary("or", x, y)
        case E.Binary(op, a, b) if op in _FLIP:
            if isinstance(a, E.Lit):
                a, b, op = b, a, _FLIP[op]
            if not isinstance(a, E.Ref) or not isinstance(b, E.Lit) or b.value is None:
                return None
            low, high = E.Ref(2 * a.index), E.Ref(2 * a.index + 1)
            if negated and op == "=":
                return None
            op = _NEGATED[op] if negated else op
            if op == "=":
                return E.Binary("and", E.Binary("<=", low, b), E.Binary(">=", high, b))
            return E.Binary(op, low if op[0] == "<" else high, b)
    return None


def zone_map(df: DataFrame, zone: Column, columns: list[str] | None = None) -> DataFrame:
    """``zone, rows`` and the minimum, maximum and null count of each column (of ``columns``, if given), for each
    value of ``zone``."""
    stats = [s for c in columns or df.columns for s in (F.min(f"`{c}`").alias(f"{c}_min"), F.max(f"`{c}`").alias(f"{c}_max"), F.sum(F.col(f"`{c}`").isNull().cast("bigint")).alias(f"{c}_nulls"))]
    return df.groupBy(zone.alias("zone")).agg(F.count("*").alias("rows"), *stats)


def pruned_zones(zones: DataFrame, columns: list[str], condition: E.Expr) -> DataFrame:
    """The zones that may hold a row that ``condition`` (over ``columns``) lets through."""
    c = zone_condition(condition)
    if c is None:
        return zones
    cols, types = [], []
    for name in columns:
        for part in ("min", "max"):
            cols.append(F.col(f"`{name}_{part}`"))
            types.append(zones.schema[f"{name}_{part}"].dataType)
    return zones.where(E.compile(c, cols, types)[0])


#: Zones of one table, at most: their statistics are looked through by the driver.
MOST_ZONES = 100_000
_ZONE = "_lodeframe_zone"


def write_zoned(df: DataFrame, path: str, by: str, zones: int) -> None:
    """``df`` as Parquet in about ``zones`` directories of about equal size, each a range of ``by``, and beside them the
    statistics of every column in every zone, for ``read_zoned``. Null values of ``by`` are in the first zone."""
    if not 0 < zones <= MOST_ZONES:
        raise ValueError(f"a table has from 1 to {MOST_ZONES} zones")
    ranged = df.repartitionByRange(zones, F.col(f"`{by}`")).withColumn(_ZONE, F.spark_partition_id())
    ranged.write.partitionBy(_ZONE).parquet(f"{path}/rows")
    back = df.sparkSession.read.parquet(f"{path}/rows")
    zone_map(back, F.col(_ZONE), df.columns).coalesce(1).write.parquet(f"{path}/zones")


def read_zoned(spark: SparkSession, path: str, condition: E.Expr | None = None) -> DataFrame:
    """The rows of a zoned table that ``condition`` (over its columns) lets through. Only directories of zones
    whose statistics allow a row are listed and read; the condition itself then decides, and is pushed to the files."""
    rows, zones = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/zones")
    names = [c for c in rows.columns if c != _ZONE]
    if condition is not None:
        left = [r["zone"] for r in pruned_zones(zones, names, condition).select("zone").collect()]  # at most MOST_ZONES
        rows = rows.where(F.col(_ZONE).isin(left)).where(E.compile(condition, [F.col(f"`{c}`") for c in names], [rows.schema[c].dataType for c in names])[0])
    return rows.select(*[F.col(f"`{c}`") for c in names])
