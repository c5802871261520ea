"""Reading and writing tables as files, by Spark's own sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats by the name a user gives; the second part says how Spark reads it.
FORMATS = {
    "parquet": "source", "orc": "source", "json": "source", "csv": "source", "text": "source", "multidelimited": "text",
    "avro": "module", "sequencefile": "hive", "rcfile": "hive", "textfile": "hive",
}


def available(spark: SparkSession, name: str) -> bool:
    """Whether this session can read the format: avro needs Spark's module, the last three need Hive support."""
    kind = FORMATS[name.lower()]
    if kind == "module":
        try:
            spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.AvroFileFormat")
        except Exception:  # noqa: BLE001  any failure of the class loader means that it is not there
            return False
        return True
    return kind != "hive" or spark.conf.get("spark.sql.catalogImplementation") == "hive"


def read(spark: SparkSession, path: str, name: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Files of one format.  A schema is asked for where the files do not carry one: inferring it would read the data twice."""
    name = name.lower()
    if not available(spark, name):
        raise ValueError(f"this session cannot read {name}")
    if name == "multidelimited":
        if schema is None:
            raise ValueError("multidelimited needs a schema")
        return _multidelimited(spark, path, schema, options.get("delimiter", "||"))
    if name in ("csv", "json") and schema is None and options.get("inferSchema") != "true" and options.get("header") != "true":
        raise ValueError(f"{name} needs a schema")
    reader = spark.read.format(name).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def _multidelimited(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str) -> DataFrame:
    """Lines of fields that a string of any length separates; empty fields are null unless they are text."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in delimiter)
    parts = F.split("value", quoted)
    out = []
    for k, f in enumerate(schema.fields):
        field = F.get(parts, F.lit(k))
        out.append((field if isinstance(f.dataType, T.StringType) else F.nullif(field, F.lit("")).try_cast(f.dataType)).alias(f.name))
    return spark.read.text(path).select(*out)


@dataclass(frozen=True)
class Layout:
    """How a table's files are laid out."""

    format: str = "parquet"
    partition_by: Sequence[str] = ()
    bucket_by: Sequence[str] = ()
    buckets: int = 0
    sort_by: Sequence[str] = ()
    compression: str | None = None


#: What an insert does with partitions that exist.
EXISTING = ("error", "append", "overwrite")


@contextmanager
def overwriting(spark: SparkSession, mode: str) -> Iterator[None]:
    """The session's partitionOverwriteMode for one insert: inserts take it from the session only, so others must not run beside this one in the same session."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, mode)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def save(df: DataFrame, table: str, layout: Layout = Layout(), mode: str = "error") -> None:
    """df as a catalog table.  Rows are dealt by partition columns first, so that a partition has few files.

    With mode "overwrite" only the partitions that df has are replaced, if the
    table is partitioned and exists.  A table that exists keeps its own layout:
    its partition columns come from the catalog, not from `layout`.
    """
    spark = df.sparkSession
    if mode not in EXISTING:
        raise ValueError(f"{mode} is not one of {EXISTING}")
    exists = spark.catalog.tableExists(table)
    if exists and mode == "error":
        raise ValueError(f"{table} exists")
    keys = [c.name for c in spark.catalog.listColumns(table) if c.isPartition] if exists else list(layout.partition_by)
    columns = spark.table(table).columns if exists else [*(c for c in df.columns if c not in keys), *keys]
    # rebalancing splits a hot partition over several tasks; hashing by key would not
    rows = df.select(*columns)
    rows = rows.hint("rebalance", *keys) if keys else rows
    if layout.sort_by and not layout.buckets:
        rows = rows.sortWithinPartitions(*keys, *layout.sort_by)
    if exists:
        with overwriting(spark, "dynamic" if keys else "static"):
            rows.write.insertInto(table, overwrite=mode == "overwrite")
        return
    writer = rows.write.format(layout.format).mode("errorifexists")
    if layout.compression:
        writer = writer.option("compression", layout.compression)
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    if layout.buckets:
        writer = writer.bucketBy(layout.buckets, *layout.bucket_by)
        if layout.sort_by:
            writer = writer.sortBy(*layout.sort_by)
    writer.saveAsTable(table)


def point_lookup(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows with one of the keys.  Over files written by sorted_copy, footers' ranges leave few row groups to read."""
    return df.where(F.col(key).isin(list(values)))


def key_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with low <= key < high."""
    return df.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def sorted_copy(df: DataFrame, path: str, key: str, files: int, row_group_bytes: int = 8 << 20) -> None:
    """df as Parquet, range-partitioned and sorted by key: an index by the ranges in the files' footers."""
    rows = df.repartitionByRange(files, key).sortWithinPartitions(key)
    rows.write.mode("overwrite").option("parquet.block.size", str(row_group_bytes)).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
