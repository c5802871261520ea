"""Changing tables that lie in files: statements Spark's file tables lack, as rewrites of the partitions concerned.

A rewrite goes to a staging table first and from there over the partitions
that changed, since a table cannot be overwritten while it is read.  The swap
is not atomic: a reader may meet a partition while its files are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.files import overwriting

_MODES = {"add": "ADD PARTITIONS", "drop": "DROP PARTITIONS", "full": "SYNC PARTITIONS"}


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _name(table: str) -> str:
    return ".".join(f"`{p}`" for p in table.replace("`", "").split("."))


def _overwrite(spark: SparkSession, table: str, rows: DataFrame, whole: bool) -> None:
    staging = f"{table}__staging"
    spark.sql(f"DROP TABLE IF EXISTS {_name(staging)}")
    rows.write.format("parquet").saveAsTable(staging)
    try:
        with overwriting(spark, "static" if whole else "dynamic"):
            spark.table(staging).select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.sql(f"DROP TABLE {_name(staging)}")


def _touched(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """The whole partitions that have a row of the condition."""
    hit = df.where(condition).select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = [df[k].eqNullSafe(hit[f"__{k}"]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(hit, on, "left_semi")


def update(spark: SparkSession, table: str, values: Mapping[str, Column], condition: Column) -> None:
    """Sets columns on the rows of the condition; a null condition leaves the row.  Partition columns cannot be set."""
    keys = partition_columns(spark, table)
    if set(values) & set(keys):
        raise ValueError("a partition column cannot be updated: delete and insert")
    df = spark.table(table)
    source = _touched(df, keys, condition) if keys else df
    hit = F.coalesce(condition, F.lit(False))
    out = [F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in df.schema.fields]
    _overwrite(spark, table, source.select(*out), not keys)


def delete(spark: SparkSession, table: str, condition: Column) -> None:
    """Drops the rows of the condition.  Partitions whose rows all go are dropped from the catalog."""
    keys = partition_columns(spark, table)
    df = spark.table(table)
    kept = ~F.coalesce(condition, F.lit(False))
    if not keys:
        _overwrite(spark, table, df.where(kept), True)
        return
    gone = df.groupBy(*keys).agg(F.max(kept).alias("any")).where("NOT any").select(*keys).collect()  # partitions, not rows
    _overwrite(spark, table, _touched(df, keys, condition).where(kept), False)
    for r in gone:
        spec = ", ".join(f"`{k}` = {_literal(r[k])}" for k in keys)
        spark.sql(f"ALTER TABLE {_name(table)} DROP IF EXISTS PARTITION ({spec})")


def _literal(v) -> str:
    if v is None:
        return "null"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def without_deleted(base: DataFrame, deletes: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Merge on read: the base rows whose ids are not in the delete files."""
    return base.join(deletes.select(*row_id).distinct(), list(row_id), "left_anti")


def compact(spark: SparkSession, table: str) -> None:
    """Rewrites the table's small files into files of the advised size."""
    keys = partition_columns(spark, table)
    _overwrite(spark, table, spark.table(table).hint("rebalance", *keys), True)


def rename_column(spark: SparkSession, table: str, old: str, new: str) -> None:
    """Partition and bucket columns can be renamed too."""
    _rewrite(spark, table, lambda df: df.withColumnRenamed(old, new), {old: new})


def drop_column(spark: SparkSession, table: str, column: str) -> None:
    """Not a partition, bucket or sorting column: the table's layout rests on those."""
    said = _described(spark, table)
    if column in {*said["partitions"], *said["buckets"], *said["sorted"]}:
        raise ValueError(f"{column} is a partition column" if column in said["partitions"] else f"{column} is a bucket column")
    _rewrite(spark, table, lambda df: df.drop(column), {})


def _described(spark: SparkSession, table: str) -> dict:
    """Format, layout, comment and properties of a table, as the catalog has them."""
    db, name = table.replace("`", "").split(".") if "." in table else (spark.catalog.currentDatabase(), table)
    t = spark._jsparkSession.sharedState().externalCatalog().getTable(db, name)
    asked = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    spec = t.bucketSpec().get() if t.bucketSpec().isDefined() else None
    return {
        "format": t.provider().get() if t.provider().isDefined() else "hive",
        "partitions": list(asked(t.partitionColumnNames())),
        "bucket_count": spec.numBuckets() if spec else 0,
        "buckets": list(asked(spec.bucketColumnNames())) if spec else [],
        "sorted": list(asked(spec.sortColumnNames())) if spec else [],
        "comment": t.comment().get() if t.comment().isDefined() else None,
        "properties": dict(asked(t.properties())),
        "options": {k: v for k, v in dict(asked(t.storage().properties())).items() if k not in ("path", "serialization.format")},
    }


def _rewrite(spark: SparkSession, table: str, change, renamed: Mapping[str, str]) -> None:
    """The table under a changed schema, with its format, layout, comment and properties: written beside it, then renamed into its place."""
    said, fresh, old = _described(spark, table), f"{table}__new", f"{table}__old"
    for t in (fresh, old):
        spark.sql(f"DROP TABLE IF EXISTS {_name(t)}")
    now = lambda columns: [renamed.get(c, c) for c in columns]
    writer = change(spark.table(table)).write.format(said["format"]).options(**said["options"])
    if said["partitions"]:
        writer = writer.partitionBy(*now(said["partitions"]))
    if said["bucket_count"]:
        writer = writer.bucketBy(said["bucket_count"], *now(said["buckets"]))
        if said["sorted"]:
            writer = writer.sortBy(*now(said["sorted"]))
    writer.saveAsTable(fresh)
    if said["comment"]:
        spark.sql(f"COMMENT ON TABLE {_name(fresh)} IS {_literal(said['comment'])}")
    if said["properties"]:
        spark.sql(f"ALTER TABLE {_name(fresh)} SET TBLPROPERTIES ({', '.join(f'{_literal(k)} = {_literal(v)}' for k, v in said['properties'].items())})")
    spark.sql(f"ALTER TABLE {_name(table)} RENAME TO {_name(old)}")
    spark.sql(f"ALTER TABLE {_name(fresh)} RENAME TO {_name(table)}")
    if said["partitions"]:
        _follow(spark, table)
    spark.sql(f"DROP TABLE {_name(old)}")


def _follow(spark: SparkSession, table: str) -> None:
    """Partitions that a rename left at the table's former folder get their folder under the present one.  (Hive's catalog moves them itself.)"""
    db, name = table.replace("`", "").split(".") if "." in table else (spark.catalog.currentDatabase(), table)
    catalog = spark._jsparkSession.sharedState().externalCatalog()
    keys, home = partition_columns(spark, table), catalog.getTable(db, name).location().toString().rstrip("/")
    found = catalog.listPartitions(db, name, spark.sparkContext._jvm.scala.Option.empty())
    for k in range(found.size()):
        p = found.apply(k)
        at = p.location().toString().rstrip("/")
        if not at.startswith(f"{home}/"):
            spec = ", ".join(f"`{c}` = {_literal(p.spec().apply(c))}" for c in keys)
            spark.sql(f"ALTER TABLE {_name(table)} PARTITION ({spec}) SET LOCATION {_literal('/'.join([home, *at.split('/')[-len(keys):]]))}")
    spark.catalog.refreshTable(table)


def sync_partitions(spark: SparkSession, table: str, mode: str = "full") -> None:
    """Brings the catalog's partitions in line with the folders: add, drop or both."""
    spark.sql(f"MSCK REPAIR TABLE {_name(table)} {_MODES[mode.lower()]}")


def create_empty_partition(spark: SparkSession, table: str, **values) -> None:
    spec = ", ".join(f"`{k}` = {_literal(v)}" for k, v in values.items())
    spark.sql(f"ALTER TABLE {_name(table)} ADD PARTITION ({spec})")


def analyze(spark: SparkSession, table: str, columns: Sequence[str] | None = None) -> None:
    """Row count and size, and statistics of the columns (None: all)."""
    what = "FOR ALL COLUMNS" if columns is None else f"FOR COLUMNS {', '.join(f'`{c}`' for c in columns)}" if columns else ""
    spark.sql(f"ANALYZE TABLE {_name(table)} COMPUTE STATISTICS {what}")


def column_statistics(spark: SparkSession, table: str, column: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE EXTENDED {_name(table)} `{column}`").collect()
    return {r["info_name"]: r["info_value"] for r in rows}
