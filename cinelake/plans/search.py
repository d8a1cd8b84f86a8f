"""Search in an index by stored pieces of its names, and pages that begin behind the last key seen.

``build`` stores the index in blocks of rows with names near each other, and for each block the distinct pieces of one, two and three letters of its rows' bases and file names. A query is
looked up by the rarest of its own pieces of three letters (itself, where it is shorter), and the rows of the blocks that have it are verified by the literal, case-insensitive test; so every
query is answered in whole. Pieces are stored by hash of their own buckets, so a lookup reads the buckets of its pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import fold, natural_key
from ..sources.files import short_list
from .index import PAGE, SHORT_LIST, valid_queries

#: Folders that pieces are dealt to; a power of two.
BUCKETS = 64
#: Letters of the longest stored piece.
LETTERS = 3
#: A block has this many rows at least (as a power of two), and more where there would be more than so many blocks: what a lookup finds stays a short list for each query.
BLOCK_BITS, BLOCKS = 8, 1 << 14
#: Blocks found for all queries that are broadcast; more are joined by a shuffle.
BROADCAST = 200_000


def _pieces(c: Column, n: int) -> Column:
    """The distinct pieces of ``n`` letters; none of a shorter text."""
    last = F.length(c) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


@dataclass
class Postings:
    """``rows``: the index with the block of each row; ``pieces``: (piece, block) by bucket; ``counts``: (piece, n)."""

    rows: DataFrame
    pieces: DataFrame
    counts: DataFrame


def _rows(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.parquet(f"{store}/rows")  # read again, so a row keeps its id
    bits = max(BLOCK_BITS, (max(rows.count(), 1) // BLOCKS).bit_length())
    return rows.withColumn("block", F.shiftright("id", bits)).drop("id")


def build(index: DataFrame, store: str) -> Postings:
    """Writes the postings of an index (base, file, dir, size, ...) below ``store``."""
    spark = index.sparkSession
    near = index.sortWithinPartitions("base", "file").withColumn("id", F.monotonically_increasing_id())
    near.write.option("compression", "zstd").parquet(f"{store}/rows")
    both = F.array_distinct(F.concat(*[_pieces(F.lower(F.coalesce(c, F.lit(""))), n) for c in ("base", "file") for n in range(1, LETTERS + 1)]))
    pieces = _rows(spark, store).select("block", F.explode(both).alias("piece")).distinct().withColumn("bucket", _bucket(F.col("piece")))
    dealt = pieces.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "piece", "block")  # a frequent letter's bucket is several tasks'
    dealt.write.partitionBy("bucket").parquet(f"{store}/pieces")
    _stored(spark, store).groupBy("bucket", "piece").agg(F.count("*").alias("n")).select("piece", "n", "bucket").write.parquet(f"{store}/counts")
    return load(spark, store)


def _stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("block long, piece string, bucket int").parquet(f"{store}/pieces")  # an empty index has no files of pieces


def load(spark: SparkSession, store: str) -> Postings:
    return Postings(_rows(spark, store), _stored(spark, store), spark.read.schema("piece string, n long, bucket int").parquet(f"{store}/counts"))


def lookup(postings: Postings, queries: DataFrame) -> DataFrame:
    """Index rows for each (query), literal, case-insensitive, in base or file name: the same as ``index.matching``."""
    asked = short_list(valid_queries(queries).select("query", "q").distinct(), SHORT_LIST)
    own = F.when(F.length("q") >= LETTERS, _pieces(F.col("q"), LETTERS)).otherwise(F.array("q"))
    parts = asked.select("query", "q", F.explode(own).alias("piece"))
    buckets = [r[0] for r in parts.select(_bucket(F.col("piece"))).distinct().collect()]  # at most BUCKETS
    counts = postings.counts.where(F.col("bucket").isin(buckets)).select("piece", "n")
    known = F.broadcast(parts).join(counts, "piece").groupBy("query", "q").agg(F.count("*").alias("found"), F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    rarest = known.where(F.col("found") == F.when(F.length("q") >= LETTERS, F.size(_pieces(F.col("q"), LETTERS))).otherwise(1)).select("query", "q", "piece")
    rarest = short_list(rarest, SHORT_LIST)
    used = [r[0] for r in rarest.select(_bucket(F.col("piece"))).distinct().collect()]
    hits = postings.pieces.where(F.col("bucket").isin(used)).join(rarest, "piece").select("block", "query", "q")
    found = postings.rows.join(F.broadcast(hits) if hits.limit(BROADCAST + 1).count() <= BROADCAST else hits, "block")
    return found.where(F.lower("base").contains(F.col("q")) | F.lower("file").contains(F.col("q"))).drop("block")


def groups(found: DataFrame) -> DataFrame:
    """(query, base_key, base, n_files, bytes, sort_key) of what ``lookup`` or ``matching`` found."""
    rows = found.withColumn("base_key", fold(F.col("base"))).groupBy("query", "base_key").agg(F.min("base").alias("base"), F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    return rows.withColumn("sort_key", natural_key(F.col("base")))


def next_page(grouped: DataFrame, after: DataFrame | None = None, size: int = PAGE, salts: int = 32) -> DataFrame:
    """The ``size`` groups of each query behind the last one seen, in natural order, with their ``place`` on the page. ``after``: (query, sort_key, base_key), a row for each query of a
    short list, as ``last_seen`` gives it; queries without one begin at the start. Groups ahead of it are left out before anything is ranked, and no more than a page of each share is."""
    rows = grouped
    if after is not None:
        seen = short_list(after.select("query", F.col("sort_key").alias("__s"), F.col("base_key").alias("__b")), SHORT_LIST)
        rows = rows.join(seen, "query", "left")
        rows = rows.where(F.col("__s").isNull() | (F.col("sort_key") > F.col("__s")) | ((F.col("sort_key") == F.col("__s")) & (F.col("base_key") > F.col("__b")))).drop("__s", "__b")
    order = [F.col("sort_key"), F.col("base_key")]
    share = Window.partitionBy("query", F.pmod(F.xxhash64("base_key"), F.lit(salts))).orderBy(*order)
    best = rows.withColumn("place", F.row_number().over(share)).where(F.col("place") <= size)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= size)


def last_seen(page: DataFrame) -> DataFrame:
    """(query, sort_key, base_key) of the last group on each query's page."""
    z = page.groupBy("query").agg(F.max(F.struct("sort_key", "base_key")).alias("z"))
    return z.select("query", "z.sort_key", "z.base_key")
