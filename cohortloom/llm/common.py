"""What the operators share: column picking, scratch tables, text expressions."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: ASCII white space: space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Python workers find this package even if the driver was started elsewhere."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``new=old`` columns only, by exact name and position.

    Other columns may have any name, also one that differs from a picked name only
    in case or that an operator uses itself.
    """
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [old for old in columns.values() if old not in at]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    if [*columns] == df.columns and [*columns.values()] == df.columns:
        return df
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select([F.col(f"_c{at[old]}").alias(new) for new, old in columns.items()])


def text_of(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z become a-z; other letters stay."""
    return F.translate(column, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of its own on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = kept.get() if kept.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cohortloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder, which is deleted when the driver's Python ends or by ``purge``."""
    folder = f"{shared_folder(spark)}/cohortloom/{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        if not _SCRATCH:
            atexit.register(_purge_all)
        _SCRATCH[folder] = spark
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def purge(spark: SparkSession) -> None:
    """Deletes this application's scratch tables: results that were not written elsewhere are lost."""
    for folder in [f for f in _SCRATCH if f.endswith(f"/{spark.sparkContext.applicationId}")]:
        dropped(_SCRATCH.pop(folder), folder)


def _purge_all() -> None:
    for folder, spark in _SCRATCH.items():
        with contextlib.suppress(Exception):  # the JVM may have ended; nothing is lost then but the folder stays
            conf = spark._jvm.org.apache.hadoop.conf.Configuration()
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read again: lineage ends there."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Frees what the driver still holds of queries that are over (plans, broadcasts, shuffles): it goes with the driver's garbage, which a heap with room to grow puts off."""
    gc.collect()
    spark._jvm.System.gc()


def row_key(id_column: Column, text: Column) -> list[Column]:
    """Two columns that tell apart rows whose id is null or repeated with other texts."""
    return [F.xxhash64(id_column.cast("string"), text).alias("_k1"), F.xxhash64(F.lit("k"), text, id_column.cast("string")).alias("_k2")]
