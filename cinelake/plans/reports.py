"""Totals, run summaries and the tail of the action log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.core import file_name

#: Bookkeeping rows that aren't actions (fixed values).
NOT_ACTIONS = ["GROUP_DONE", "EVAC_MKDIR", "MKDIR_DUP", "MKDIR_DEST"]


def batch_totals(matched: DataFrame) -> DataFrame:
    """Counts and sizes of an ingest batch, and the bytes that larger copies would add."""
    dup = F.col("action") != "insert"
    some = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    return matched.agg(F.count("*").alias("n_total"), F.coalesce(F.sum("title_size"), F.lit(0)).alias("size_total"), F.count_if(~dup).alias("n_new"), some(~dup, F.col("title_size")).alias("size_new"), F.count_if(dup).alias("n_duplicate"), some(dup, F.col("title_size")).alias("size_duplicate"), some(F.col("size_class") != "", F.col("title_size") - F.col("library_size")).alias("gain"))


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action", "status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def run_summary(log: DataFrame) -> DataFrame:
    """Counters of a run, and one line about them."""
    ok = F.col("status") == "OK"
    n = lambda *a: F.count_if(ok & F.col("action").isin(*a))
    c = log.agg(n("MOVE", "EVAC_MOVE").alias("moved"), n("MOVE_DUP", "EVAC_DUP").alias("duped"), n("RENAME_01").alias("renamed"), F.count_if((F.col("status") == "SKIP") & (F.col("action") != "RENAME_01_SKIP")).alias("skipped"), F.count_if(F.col("action") == "RENAME_01_SKIP").alias("flagged"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.coalesce(F.sum(F.when(ok & F.col("action").isin("MOVE", "EVAC_MOVE"), F.col("bytes"))), F.lit(0)).alias("moved_bytes"))
    return c.withColumn("line", formats.run_summary({"moved": F.col("moved"), "bytes": F.col("moved_bytes"), "duped": F.col("duped"), "renamed": F.col("renamed"), "skipped": F.col("skipped"), "failed": F.col("failed"), "flagged": F.col("flagged")}))


def action_tail(log: DataFrame, most: int = 400) -> DataFrame:
    """The last actions, in log order."""
    rows = log.where(F.col("action").isNotNull() & ~F.col("action").isin(*NOT_ACTIONS, "action", ""))
    return rows.orderBy(F.desc("line_no")).limit(most).orderBy("line_no")


def shown_actions(log: DataFrame) -> DataFrame:
    """Display fields of (action, src, dest, bytes)."""
    src = F.when(F.col("action").startswith("BALANCE"), "").otherwise(file_name(F.col("src")))
    return log.select("*", src.alias("shown_file"), formats.drive_of(F.col("src")).alias("from_drive"), formats.drive_of(F.col("dest")).alias("to_drive"), F.when(F.col("bytes") > 0, formats.byte_size(F.col("bytes"))).otherwise("").alias("shown_bytes"))
