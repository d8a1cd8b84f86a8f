"""A stored library whose edits rewrite only the buckets that hold an edited row.

Rows are dealt to buckets by a hash of their id. The store's pointer holds one line for each bucket, the folder that it stands in now; an edit writes the touched buckets
anew, beside the old ones, and then changes the pointer in one step. Files of other buckets keep their names, and a failed edit leaves the library as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import read_pointer, swap_pointer
from .library import apply_deletes, apply_edits, unknown_ids

#: Buckets of a new store; the pointer has a line for each.
BUCKETS = 64


def _bucket(buckets: int, c: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, store: str) -> tuple[str, list[str]]:
    """The schema, and each bucket's folder."""
    schema, *folders = read_pointer(spark, store).split("\n")
    return schema, folders


def _write(rows: DataFrame, store: str, buckets: int, numbers: list[int]) -> dict[int, str]:
    """Writes the rows of buckets; every bucket in ``numbers`` gets a folder, also if it has no rows left."""
    name = f"rows-{uuid.uuid4().hex}"
    rows.withColumn("bucket", _bucket(buckets)).repartition(min(buckets, len(numbers)), "bucket").write.partitionBy("bucket").parquet(f"{store}/{name}")
    return {b: f"{name}/bucket={b}" for b in numbers}


def create(library: DataFrame, store: str, buckets: int = BUCKETS) -> None:
    folders = _write(library, store, buckets, list(range(buckets)))
    swap_pointer(library.sparkSession, store, "\n".join([library._jdf.schema().toDDL().replace("\n", " "), *[folders[b] for b in range(buckets)]]))


def _read(spark: SparkSession, store: str, schema: str, folders: list[str]) -> DataFrame:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f"{store}/{f}" for f in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{store}/{f}"))]  # a bucket without rows has no folder
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def read(spark: SparkSession, store: str) -> DataFrame:
    schema, folders = _folders(spark, store)
    return _read(spark, store, schema, folders)


def change(spark: SparkSession, store: str, edits: DataFrame | None = None, deletes: DataFrame | None = None) -> tuple[list[int], DataFrame]:
    """Applies edits (id, field, value, seq), then deletes (id). Returns the rewritten buckets, and the ids of either that the library doesn't know."""
    schema, folders = _folders(spark, store)
    ids = [x.select("id") for x in (edits, deletes) if x is not None]
    asked = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
    touched = sorted(r[0] for r in asked.where("id IS NOT NULL").select(_bucket(len(folders)).alias("b")).distinct().collect())  # at most as many as buckets
    old = _read(spark, store, schema, [folders[b] for b in touched])
    unknown = unknown_ids(old, asked)
    if touched:
        rows = old if edits is None else apply_edits(old, edits)
        rows = rows if deletes is None else apply_deletes(rows, deletes)
        fresh = _write(rows, store, len(folders), touched)
        swap_pointer(spark, store, "\n".join([schema, *[fresh.get(b, f) for b, f in enumerate(folders)]]))
    return touched, unknown
