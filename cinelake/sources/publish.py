"""Snapshots that readers never see half-written: a version folder for each, and one pointer that names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path as Spark reads it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def read_pointer(spark: SparkSession, store: str) -> str | None:
    """The name that the pointer holds; None where nothing was published."""
    fs, path = _hadoop(spark, f"{store}/{POINTER}")
    if not fs.exists(path):
        return None
    return spark.read.text(f"{store}/{POINTER}", wholetext=True).first()[0].strip()


def swap_pointer(spark: SparkSession, store: str, name: str) -> None:
    """Names the current version: written beside the pointer, then moved over it in one step."""
    jvm = spark._jvm
    fs, fresh = _hadoop(spark, f"{store}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.writeBytes(name)
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    whole = fs.makeQualified(fresh)
    target = fs.makeQualified(_hadoop(spark, f"{store}/{POINTER}")[1])
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(whole, target, over)


def publish(df: DataFrame, store: str, status: DataFrame | None = None) -> str:
    """Writes a new version and makes it the current one; returns its name. Refused, with the old one left as it is, where a root of ``status`` (root, unreadable) can't be
    read: a rebuild would replace a good index by a nearly empty one. Whatever step fails, readers keep the old version."""
    spark = df.sparkSession
    if status is not None and (bad := [r["root"] for r in status.where("unreadable").limit(20).collect()]):
        raise ValueError(f"roots that can't be read: {', '.join(bad)}; the old snapshot stays")
    name = f"version={uuid.uuid4().hex}"
    df.write.mode("error").parquet(f"{store}/{name}")
    swap_pointer(spark, store, name)
    return name


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The current version's rows, or None."""
    name = read_pointer(spark, store)
    return None if name is None else spark.read.parquet(f"{store}/{name}")


def prune(spark: SparkSession, store: str, older_than_ms: int) -> list[str]:
    """Deletes versions but the current one that were written before a time (in ms since 1970), when no reader holds them any more."""
    keep, (fs, path), gone = read_pointer(spark, store), _hadoop(spark, store), []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("version=") and name != keep and s.getModificationTime() < older_than_ms:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def rebuild(spark: SparkSession, roots: list[str], store: str) -> DataFrame:
    """Scans the roots, merges with the current snapshot's entries of roots that are missing now, and publishes the index."""
    from ..plans.index import build_index
    from .tree import root_status, scan

    scanned = scan(spark, roots)
    status = materialize(root_status(scanned, roots), "status")
    files = scanned.where("problem IS NULL").select("path", "dir", F.regexp_replace("file", r"(?<=.)\.[^.]*$", "").alias("stem"), F.regexp_extract("file", r"(?<=.)\.([^.]*)$", 1).alias("ext"), "size", "mtime")
    old = current(spark, store)
    if old is None:
        old = spark.createDataFrame([], "base string, file string, dir string, size long, mtime timestamp")
    publish(build_index(files, old, status.select("root", "present")), store, status)
    return current(spark, store)
