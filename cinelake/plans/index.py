"""The file index: merged snapshots and grouped, paged search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import fold, natural_key, under
from ..functions.titles import strip_variant
from ..sources.files import INDEX_EXTENSIONS, distinct_roots, wanted
from ..sources.store import materialize

PAGE = 50
#: Roots and queries are short configured lists; more than this many is an error, not a larger broadcast.
SHORT_LIST = 1000


def _short(df: DataFrame) -> DataFrame:
    if df.limit(SHORT_LIST + 1).count() > SHORT_LIST:
        raise ValueError(f"more than {SHORT_LIST} rows in a configured list")
    return F.broadcast(df)


def entries(files: DataFrame, roots: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """(base, file, dir, size, mtime, root) of the wanted files below present roots (root, present)."""
    r = _short(roots.where("present").select("root"))
    rows = files.join(r, under(F.col("path"), F.col("root"))).where(wanted(F.col("path"), F.col("root"), extensions or INDEX_EXTENSIONS))
    return rows.select(strip_variant(F.col("stem")).alias("base"), F.concat("stem", F.lit("."), "ext").alias("file"), "dir", "size", "mtime")


def build_index(files: DataFrame, previous: DataFrame, roots: DataFrame) -> DataFrame:
    """New snapshot: what was scanned, each file once however roots are nested, and the old entries of roots that are configured but missing now."""
    gone = _short(roots.where("NOT present").select("root"))
    carried = previous.join(gone, under(F.col("dir"), F.col("root")), "left_semi")
    return entries(files, distinct_roots(roots.where("present"))).withColumn("carried", F.lit(False)).unionByName(carried.select("base", "file", "dir", "size", "mtime").withColumn("carried", F.lit(True)))


def snapshot_meta(index: DataFrame, roots: DataFrame) -> DataFrame:
    names = roots.agg(F.array_sort(F.collect_list("root")).alias("roots"), F.array_sort(F.collect_list(F.when(~F.col("present"), F.col("root")))).alias("missing_roots"))
    return index.agg(F.count("*").alias("file_count")).crossJoin(names).withColumn("built_at", F.current_timestamp())


def without(index: DataFrame, trashed: DataFrame) -> DataFrame:
    return index.join(trashed.select("dir", "file"), ["dir", "file"], "left_anti")


def allowed(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Of the given (dir, file) those that the index knows."""
    return paths.join(index.select("dir", "file").distinct(), ["dir", "file"], "left_semi")


def valid_queries(queries: DataFrame) -> DataFrame:
    q = fold(F.col("query"))
    return queries.withColumn("q", q).where(F.length("q").between(1, 120))


def matching(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Index rows for each query (a short list): literal, case-insensitive, in base or file name."""
    q = _short(valid_queries(queries))
    return index.join(q, F.lower("base").contains(F.col("q")) | F.lower("file").contains(F.col("q")))


def search(index: DataFrame, queries: DataFrame, page: int = 0, size: int = PAGE, salts: int = 32) -> DataFrame:
    """Groups by base for each query, in natural order, with totals before paging: one page of each query. Groups are ranked by key alone, first within
    each of ``salts`` shares; files are gathered for the groups of the page only."""
    found = materialize(matching(index, queries).withColumn("base_key", fold(F.col("base"))), "found")  # read for groups, totals and files
    groups = found.groupBy("query", "base_key").agg(F.min("base").alias("base"), F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    totals = groups.groupBy("query").agg(F.count("*").alias("total_groups"), F.sum("n_files").alias("total_files"))
    order = [natural_key(F.col("base")), F.col("base_key")]
    share = Window.partitionBy("query", F.pmod(F.xxhash64("base_key"), F.lit(salts))).orderBy(*order)
    best = groups.withColumn("place", F.row_number().over(share)).where(F.col("place") <= (page + 1) * size).drop("place")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where((F.col("rank") > page * size) & (F.col("rank") <= (page + 1) * size))
    ranked = ranked.join(F.broadcast(totals), "query")  # a row for each query of a short list
    files = F.array_sort(F.collect_list(F.struct(natural_key(F.col("file")).alias("k"), F.col("file"), F.col("dir"), F.col("size"), F.col("mtime"))))
    lists = found.join(F.broadcast(ranked.select("query", "base_key")), ["query", "base_key"], "left_semi").groupBy("query", "base_key").agg(files.alias("files"))  # ``size`` rows a query
    return ranked.join(lists, ["query", "base_key"])


def page_range(total: Column, page: Column, size: int = PAGE) -> Column:
    """struct(pages, first, last) shown for a page."""
    pages = F.greatest(F.ceil(total / size), F.lit(1))
    return F.struct(pages.alias("pages"), F.when(total == 0, 0).otherwise(page * size + 1).alias("first"), F.least((page + 1) * size, total).alias("last"))


def unmounted(configured: DataFrame, present: DataFrame) -> DataFrame:
    return configured.select("root").subtract(present.select("root"))
