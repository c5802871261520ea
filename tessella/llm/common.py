"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import itertools
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's and Java's regular expressions agree on this class.
SPACE = "\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}
_count = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors share.

    Where that is unset and the session is a single process (tests), a
    temporary folder; on a cluster it must be set.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="stages-")
        _folders[app] = f"{top.rstrip('/')}/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder is the cluster's to clean
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back.

    Cuts the lineage: a lost executor costs a read of files, not the work
    before, and what follows sees the same rows however often it runs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{next(_count):05d}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more; others are left to the end of the application."""
    for df in frames:
        if (path := getattr(df, "_written_to", None)) is not None:
            _remove(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Between the steps of a long job: shuffle files and broadcasts of finished steps go when the driver's garbage is collected, which may be hours away."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small DataFrame from driver values by JVM expressions only; no rows give an empty frame."""
    kind = T.ArrayType(T._parse_datatype_string(schema))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind.simpleString())))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even when body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def semi(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all their columns untouched, whose id is in keys (one column; null equals null)."""
    keys = keys.toDF("__key")
    return docs.join(keys, docs[id_col].eqNullSafe(keys["__key"]), "left_semi")


def utf8_batches(batches, columns: list[str], step: int = 256):
    """Slices of Arrow batches as lists, small enough that long texts do not pile up as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
