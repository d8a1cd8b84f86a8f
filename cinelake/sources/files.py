"""Listings, JSON documents, logs and versioned snapshots as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import directory, extension, file_name, under

# The extensions of ingest, index and consolidation, and the names of log columns.
INGEST_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "wmv", "mpg", "m4v", "divx"]
INDEX_EXTENSIONS = ["mp4", "m4v", "mkv", "avi", "wmv", "mov", "mpg", "mpeg", "ts", "flv", "webm"]
CONSOLIDATION_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "m4v", "mpg", "mpeg", "ts", "wmv", "flv", "webm", "vob"]
LOG_COLUMNS = ["ts", "mode", "group", "action", "src", "dest", "bytes", "status", "message"]
MAX_DEPTH = 4
MAX_ROOTS = 1000


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, dir, file, size, mtime) of the files below a root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    return files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).select("path", directory(F.col("path")).alias("dir"), file_name(F.col("path")).alias("file"), "size", "mtime")


def wanted(path: Column, root: Column, extensions: list[str], max_depth: int | None = MAX_DEPTH) -> Column:
    """Not hidden, not under a ``duplicates`` folder, not too deep, and of a listed type."""
    parts = F.split(F.substring(path, F.length(root) + 2, F.length(path)), "/")
    hidden = F.exists(parts, lambda s: s.startswith(".") | (F.lower(s) == "duplicates"))
    deep = F.lit(True) if max_depth is None else F.size(parts) - 1 <= max_depth
    return under(path, root) & ~hidden & deep & extension(path).isin(extensions)


def short_list(df: DataFrame, most: int) -> DataFrame:
    """A configured list for broadcasting, computed once; more rows than ``most`` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a configured list")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def distinct_roots(roots: DataFrame) -> DataFrame:
    """The rows of ``roots`` whose root isn't the same as, or nested in, another; of equal ones that with the least ``pos`` (if there is one) stays. A short configured list."""
    rows = sorted(roots.limit(MAX_ROOTS + 1).collect(), key=lambda r: r["pos"] if "pos" in roots.columns else 0)
    if len(rows) > MAX_ROOTS:
        raise ValueError(f"more than {MAX_ROOTS} rows in a configured list")
    names = [r["root"].rstrip("/") for r in rows]
    kept = [r for i, r in enumerate(rows) if not any(f"{names[i]}/".startswith(f"{other}/") and (other != names[i] or j < i) for j, other in enumerate(names) if j != i)]
    return roots.sparkSession.createDataFrame(kept, roots.schema)


def json_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) from a JSON array of strings; a broken document gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", T.ArrayType(T.StringType()))).alias("name")).where("name IS NOT NULL")


INDEX_DOCUMENT = T.StructType([T.StructField("builtAt", T.StringType()), T.StructField("roots", T.ArrayType(T.StringType())), T.StructField("missingRoots", T.ArrayType(T.StringType())), T.StructField("fileCount", T.LongType()), T.StructField("entries", T.ArrayType(T.StructType([T.StructField(n, T.LongType() if n in ("size", "mtime") else T.StringType()) for n in ("base", "file", "dir", "size", "mtime")])))])


def json_index(spark: SparkSession, path: str) -> DataFrame:
    """(base, file, dir, size, mtime) from an index document; a broken one gives no rows."""
    return spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", INDEX_DOCUMENT)["entries"]))


def write_snapshot(df: DataFrame, root: str, version: str, unreadable_roots: int = 0) -> str:
    """Writes a new version folder and never the one being read; refuses when a root couldn't be listed."""
    if unreadable_roots:
        raise ValueError(f"{unreadable_roots} roots can't be read; the old snapshot stays")
    df.write.mode("error").parquet(path := f"{root}/version={version}")
    return path


def write_log(log: DataFrame, path: str) -> None:
    """Tab-separated with one header row, in the first part; tabs and line ends in a field are escaped."""

    def safe(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        for raw, shown in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
            text = F.replace(text, F.lit(raw), F.lit(shown))
        return text

    header = log.sparkSession.createDataFrame([("\t".join(LOG_COLUMNS),)], "value string").coalesce(1)
    header.unionByName(log.select(F.concat_ws("\t", *[safe(c) for c in LOG_COLUMNS]).alias("value"))).write.text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows as strings; headers and rows of under eight fields are left out."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).select(fields.alias("c")).where((F.size("c") >= 8) & (F.get("c", F.lit(0)) != "ts"))
    return rows.select([F.get("c", F.lit(i)).alias(c) for i, c in enumerate(LOG_COLUMNS)])
