"""What the training-data operators share: the shared folder, worker set-up and row keys."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import discard, materialize, shared_dir

__all__ = ["discard", "groups_for", "join_salted", "likely", "materialize", "prepare", "row_key", "shared_dir", "small_batches", "spilled_keys", "table"]

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as bytes.split() has it too.
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed on them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Bytes in a batch of rows that Spark hands to a Python worker.
BATCH = 4_000_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH bytes instead of 10,000 rows for what is planned inside: an executor and its workers hold a whole batch outside the heap, several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of one key that a merge join holds as objects on the heap; what a key has beyond that lies in memory that Spark counts and spills.
ROWS_HELD = 4096


@contextmanager
def spilled_keys(spark: SparkSession) -> Iterator[None]:
    """For joins that run inside: by default a merge join keeps all rows of a key on the heap, however many they are, and no spill frees them."""
    key = "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS_HELD))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of (id, text): rows with a null or repeated id stay apart unless they are equal in both."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("|"), F.col(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_for(df: DataFrame, text: str, mb: float) -> int:
    """How many groups of about ``mb`` MB of text the whole table makes; at least the shuffle's own partitions."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / (mb * 1e6)) + 1)


#: 64-bit words, and the bits of a key that choose one, of the table in ``likely``: 16 million keys fill it, and only speed depends on it.
WORD_BITS = 18


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a 64-bit hash, may be in ``wanted``: what a broadcast table of bits rules out isn't shuffled. None that is in it is lost."""
    word, bit = f"{key} & {(1 << WORD_BITS) - 1}", f"CAST(shiftrightunsigned({key}, {WORD_BITS}) & 63 AS INT)"
    bits = wanted.groupBy(F.expr(word).alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("__bits"))
    return rows.withColumn("__word", F.expr(word)).join(F.broadcast(bits), "__word").where(f"getbit(__bits, {bit}) = 1").select(*rows.columns)


#: Keys that ``join_salted`` spreads: those with more than SALTED rows and more than this share of all, so never more than 1 / SHARE keys.
SHARE, SALTED = 0.0001, 1000


def join_salted(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Equi-join in which a key that many rows of ``left`` have is spread over several tasks, and the rows of ``right`` repeated for each.

    ``counted``: a written table whose rows have left's keys at least as often (left itself by default). ``how``: inner or left. Rows of
    ``left`` are dealt by a hash of their columns, so a repeated task deals them alike.
    """
    counted = left if counted is None else counted
    total = counted.count()
    least = max(SALTED, total * SHARE)
    hot = counted.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > least).collect() if total > 4 * SALTED else []  # at most 1 / SHARE rows
    if not hot:
        return left.join(right, [*keys], how)
    schema = counted.select(*keys).schema.add("__salts", T.IntegerType())
    salts = F.broadcast(left.sparkSession.createDataFrame([(*(r[k] for k in keys), int(r["__n"] / least) + 1) for r in hot], schema))
    spread = left.join(salts, [*keys], "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("__salts", F.lit(1)))).drop("__salts")
    again = right.join(salts, [*keys], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)).cast("long") - 1))).drop("__salts")
    return spread.join(again, [*keys, "__salt"], how).drop("__salt")
