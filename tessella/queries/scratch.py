"""A database and a folder of this application, for queries that write before they read."""

from __future__ import annotations

import hashlib
import itertools
import uuid

from pyspark.sql import SparkSession

from tessella.mv.catalog import Materialized

_databases: dict[str, str] = {}
_views: dict[tuple[str, str], Materialized] = {}
_count = itertools.count()


def database(spark: SparkSession) -> str:
    """Its name is new for each application, so nothing of an earlier one is in the way."""
    app = spark.sparkContext.applicationId
    if app not in _databases:
        name = f"scratch_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE DATABASE {name}")
        _databases[app] = name
    return _databases[app]


def folder(spark: SparkSession) -> str:
    """A new folder under the warehouse, which all executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{database(spark)}.files/{next(_count)}"


def table_name(spark: SparkSession) -> str:
    return f"{database(spark)}.t{next(_count)}"


def base_table(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A catalog table over the files of sf_dir."""
    full = f"{database(spark)}.{name}_{hashlib.sha256(sf_dir.encode()).hexdigest()[:8]}"
    if not spark.catalog.tableExists(full):
        spark.catalog.createTable(full, path=f"{sf_dir}/{name}.parquet", source="parquet")
    return full


def views(spark: SparkSession, sf_dir: str) -> Materialized:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _views:
        _views[key] = Materialized(spark)
    return _views[key]
