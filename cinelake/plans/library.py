"""The title library: listing, copy-on-write edits and deletes, recent search terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.core import alike, natural_order

#: Columns that edits may change, and what a null becomes (fixed values).
EDITABLE = {"title": "", "dimensions": "", "duration": 0, "filesize": 0}


def text_filter(c: Column, kind: str, text: str) -> Column:
    low = F.lower(c)
    return {"startsWith": low.startswith, "contains": low.contains, "endsWith": low.endswith}[kind](text.lower())


def listing(library: DataFrame, conditions: list[tuple[str, str]] = ()) -> DataFrame:
    """Display columns of the titles that meet all (kind, text) conditions; natural title order without regard to case and accents with a filter, else newest first."""
    rows = library
    for kind, text in conditions:
        rows = rows.where(text_filter(F.col("title"), kind, text))
    seconds = formats.whole_seconds(F.col("duration"))
    rows = rows.select("id", "title", "dimensions", seconds.alias("seconds"), formats.duration(seconds).alias("shown_duration"), formats.byte_size(F.col("filesize")).alias("shown_size"), "date_created")
    return rows.orderBy(natural_order(F.col("title")), "id") if conditions else rows.orderBy(F.desc_nulls_last("date_created"), "id")


def find_titles(titles: DataFrame, library: DataFrame) -> DataFrame:
    """(title, id): for each different title the library's least id whose title is the same but for case, accents and blanks around it; null where there is none."""
    known = library.groupBy(alike(F.col("title")).alias("__key")).agg(F.min("id").alias("id"))
    asked = titles.select("title").distinct().withColumn("__key", alike(F.col("title")))
    return asked.join(known, "__key", "left").select("title", "id")


def counts(library: DataFrame, conditions: list[tuple[str, str]] = ()) -> DataFrame:
    shown = F.lit(True)
    for kind, text in conditions:
        shown = shown & text_filter(F.col("title"), kind, text)
    return library.agg(F.count("*").alias("total"), F.count_if(shown).alias("shown"))


def outcome_counts(refreshed: DataFrame) -> DataFrame:
    """Counters of a refresh: updated, unchanged, not found."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    return refreshed.agg(n("updated"), n("unchanged"), n("not_found"))


def settle(work: DataFrame, results: DataFrame) -> DataFrame:
    """A working list (path, ...) after the results (path, new_path, ok) of renaming or trashing: what succeeded has its new path or, without one, is gone;
    what failed or wasn't reported stays. Adds ``outcome``."""
    last = results.groupBy("path").agg(F.max(F.struct("ok", "new_path")).alias("r"))
    rows = work.join(last, "path", "left")
    outcome = F.when(F.col("r").isNull(), "pending").when(F.col("r.ok"), F.when(F.col("r.new_path").isNull(), "gone").otherwise("renamed")).otherwise("failed")
    rows = rows.withColumn("outcome", outcome).where("outcome <> 'gone'").withColumn("path", F.when(F.col("outcome") == "renamed", F.col("r.new_path")).otherwise(F.col("path")))
    return rows.select(*work.columns, "outcome")


def apply_edits(library: DataFrame, edits: DataFrame) -> DataFrame:
    """The library after edits (id, field, value, seq): of each field the last edit; other fields are refused; a null becomes the field's default."""
    last = edits.where(F.col("field").isin(list(EDITABLE))).groupBy("id", "field").agg(F.max(F.struct("seq", "value")).alias("z"))
    wide = last.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.struct(F.lit(1).alias("set"), F.col("z.value").alias("value")))).alias(f"new_{f}") for f in EDITABLE])
    rows = library.join(wide, "id", "left")
    value = lambda f: F.coalesce(F.expr(f"try_cast(new_{f}.value AS {library.schema[f].dataType.simpleString()})"), F.lit(EDITABLE[f]).cast(library.schema[f].dataType))
    return rows.select(*[F.when(F.col(f"new_{c}").isNotNull(), value(c)).otherwise(F.col(c)).alias(c) if c in EDITABLE else F.col(c) for c in library.columns])


def apply_deletes(library: DataFrame, deletes: DataFrame) -> DataFrame:
    return library.join(deletes.select("id").distinct(), "id", "left_anti")


def unknown_ids(library: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(library, "id", "left_anti")


def recent_terms(events: DataFrame, most: int = 25, shortest: int = 2) -> DataFrame:
    """For each owner the ``most`` latest different terms of (owner, term, ts), each in its latest spelling."""
    rows = events.withColumn("key", F.lower(F.trim("term"))).where(F.length("key") >= shortest)
    last = rows.groupBy("owner", "key").agg(F.max("ts").alias("ts"), F.max_by(F.trim("term"), F.struct("ts", "term")).alias("term"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("ts"), "key"))
    return last.withColumn("rank", rank).where(F.col("rank") <= most)
