"""From scanned files to titles, and titles against the library. Presence flags use the library as it was before the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import fold
from ..functions.titles import base_and_kind, library_title, split_suffix, strip_variant, with_first_number
from ..sources.files import INGEST_EXTENSIONS

PROBE = T.StructType([T.StructField("streams", T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))), T.StructField("format", T.StructType([T.StructField("duration", T.StringType())]))])


def parse_probe(raw: DataFrame) -> DataFrame:
    """(path, dimensions, duration): of the first stream that has both sides; zero sides are blank; whole seconds; broken JSON is left out, but not JSON that tells nothing (``{}``)."""
    told = F.col("p.streams").isNotNull() | F.col("p.format").isNotNull()
    whole = F.try_parse_json("raw")
    p = raw.withColumn("p", F.from_json("raw", PROBE)).where(told | (whole.isNotNull() & ~F.is_variant_null(whole)))
    p = p.withColumn("v", F.get(F.filter("p.streams", lambda s: s["width"].isNotNull() & s["height"].isNotNull()), F.lit(0)))
    shown = F.when((F.col("v.width") > 0) & (F.col("v.height") > 0), F.concat(F.col("v.width").cast("string"), F.lit(" x "), F.col("v.height").cast("string"))).otherwise("")
    return p.select("path", shown.alias("dimensions"), F.coalesce(F.floor(F.expr("try_cast(p.format.duration AS double)")), F.lit(0)).alias("duration"))


def with_probes(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds dimensions and duration to (path, ext, ...). A video whose probe failed is left out; what isn't a video has blank dimensions and no duration."""
    rows = files.join(probes.withColumn("__read", F.lit(True)), "path", "left")
    rows = rows.where(F.col("__read") | ~F.lower("ext").isin(INGEST_EXTENSIONS)).drop("__read")
    return rows.withColumns({"dimensions": F.coalesce("dimensions", F.lit("")), "duration": F.coalesce("duration", F.lit(0).cast("long"))})


def title_rollup(files: DataFrame, ascii_fold: bool = False) -> DataFrame:
    """One row for each title of (stem, path, size, ...): sums, and the spelling and path of the first path; with the columns dimensions and duration also the first
    path's dimensions and the sum of durations."""
    title = strip_variant(F.col("stem"))
    rows = files.withColumn("title", title).withColumn("title_key", fold(title, ascii_fold))
    more = []
    if {"dimensions", "duration"} <= set(files.columns):
        more = [F.min_by(F.coalesce("dimensions", F.lit("")), "path").alias("dimensions"), F.sum(F.coalesce("duration", F.lit(0))).alias("duration")]
    return rows.groupBy("title_key").agg(F.min_by("title", "path").alias("title"), F.sum("size").alias("title_size"), F.count("*").alias("n_files"), F.min("path").alias("title_path"), *more)


def missing_metadata(dimensions: Column, duration: Column, size: Column) -> Column:
    return F.coalesce(F.lower(F.trim(dimensions)), F.lit("")).isin("", "0 x 0") | (F.coalesce(duration, F.lit(0)) == 0) | (F.coalesce(size, F.lit(0)) == 0)


def presence(library: DataFrame) -> DataFrame:
    """For each base (before the first `` # ``): unnumbered_present, numbered_titles."""
    base = F.substring_index(F.col("title"), " # ", 1)
    rows = library.select(fold(base).alias("base_key"), fold(F.col("title")).alias("key"), F.col("title").contains(" # ").alias("numbered"))
    return rows.groupBy("base_key").agg(F.bool_or(~F.col("numbered")).alias("has_unnumbered"), F.count_distinct(F.when(F.col("numbered"), F.col("key"))).alias("n_numbered"), F.max(F.when(F.col("numbered"), F.col("key"))).alias("one_numbered"))


def ingest_match(titles: DataFrame, library: DataFrame) -> DataFrame:
    """Each rolled-up title with its library row (the least id of equal titles), size class, presence flags and action."""
    first = library.groupBy(fold(F.col("title")).alias("key")).agg(F.min("id").alias("id")).join(library, "id")
    first = first.select(F.col("key").alias("lib_key"), "id", F.col("filesize").alias("lib_size"), "dimensions", "duration")
    rows = titles.withColumn("db_title", library_title(F.col("title"))).withColumn("key", fold(F.col("db_title")))
    rows = rows.withColumn("b", base_and_kind(F.col("title"))).withColumn("base_key", fold(F.coalesce("b.base", "db_title")))
    # A second title of the batch that resolves to one library title is a duplicate of the first.
    again = F.row_number().over(Window.partitionBy("key").orderBy("title_path")) > 1
    rows = rows.withColumn("in_batch", again).join(first, F.col("key") == F.col("lib_key"), "left").join(presence(library).withColumnRenamed("base_key", "present_key"), F.col("base_key") == F.col("present_key"), "left")
    known = F.col("id").isNotNull()
    numbered = F.coalesce(F.col("b.numbered"), F.lit(False))
    others = F.coalesce(F.col("n_numbered"), F.lit(0)) - F.when(numbered & (F.col("one_numbered").isNotNull()) & known & F.col("key").contains(" # "), 1).otherwise(0)
    size_class = F.when(known & (F.col("lib_size") > 0) & (F.col("lib_size") < F.col("title_size")), "isLarger").when(known & (F.col("lib_size") == 0) & (F.col("title_size") > 0), "isLargerZeroDBSize").otherwise("")
    missing = known & missing_metadata(F.col("dimensions"), F.col("duration"), F.col("lib_size"))
    external = (~numbered & (F.coalesce(F.col("n_numbered"), F.lit(0)) > 0)) | (numbered & F.coalesce(F.col("has_unnumbered"), F.lit(False))) | (numbered & (others > 0))
    action = F.when(missing & ~F.col("in_batch"), "fill_missing").when(known | F.col("in_batch"), "duplicate").otherwise("insert")
    return rows.select("title", "db_title", "title_size", F.col("id").alias("library_id"), F.col("lib_size").alias("library_size"), size_class.alias("size_class"), (known & (F.col("title_size") > 0) & (F.col("lib_size") < F.col("title_size"))).alias("needs_update_size"), F.coalesce("has_unnumbered", F.lit(False)).alias("has_unnumbered"), (F.coalesce("n_numbered", F.lit(0)) > 0).alias("has_numbered"), external.alias("external_search"), action.alias("action"))


def numbering_plan(titles: DataFrame, library: DataFrame) -> DataFrame:
    """Library titles without a number whose base also has numbered titles, in the library or the batch: (id, title, new_title)."""
    numbered = library.select("title").unionByName(titles.select("title")).where(F.col("title").rlike(r" # \d"))
    bases = numbered.select(fold(F.substring_index("title", " # ", 1)).alias("base_key")).distinct()
    plain = library.where(~F.col("title").rlike(r"#\s*\d"))
    return plain.withColumn("base_key", fold(split_suffix(F.col("title"))["base"])).join(bases, "base_key", "left_semi").select("id", "title", with_first_number(F.col("title")).alias("new_title"))


def number_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, new_stem) of the unnumbered files of the titles that a numbering plan renames."""
    keys = plan.select(fold(F.col("title")).alias("title_key")).distinct()
    rows = files.withColumn("title_key", fold(split_suffix(F.col("stem"))["base"])).join(keys, "title_key", "left_semi")
    return rows.select("path", "stem", with_first_number(F.col("stem")).alias("new_stem"))


def duplicate_move_plan(duplicates: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose base begins a duplicate title: (path, target). A title's beginnings, of the lengths that bases have, are an equi-join key, so no nested loop runs."""
    titles = duplicates.select(fold(F.col("db_title")).alias("t"), (F.col("size_class") == "isLarger").alias("larger")).groupBy("t").agg(F.bool_or("larger").alias("larger"))
    rows = files.withColumn("begin", fold(F.substring_index(split_suffix(F.col("stem"))["base"], " # ", 1))).where("begin <> ''")
    lengths = F.broadcast(rows.agg(F.array_sort(F.collect_set(F.length("begin"))).alias("lengths")))  # one row; names have few different lengths
    begins = titles.join(lengths).select(F.explode(F.transform(F.filter("lengths", lambda i: i <= F.length("t")), lambda i: F.substring(F.col("t"), F.lit(1), i))).alias("begin"), "larger")
    begins = begins.groupBy("begin").agg(F.bool_or("larger").alias("larger"))
    return rows.join(begins, "begin").select("path", F.when(F.col("larger"), "duplicates/larger").otherwise("duplicates").alias("target"))


def fill_metadata(library: DataFrame, titles: DataFrame) -> DataFrame:
    """The library rows that lack dimensions, duration or size, each filled from the first title (by path) of a scan with probes that has it:
    (id, title, dimensions, duration, filesize, and what was needed and what was filled as comma-separated names)."""
    key = fold(library_title(F.col("title")))
    first = lambda c, has: F.min_by(F.when(has, F.col(c)), F.when(has, F.col("title_path"))).alias(f"new_{c}")
    known = titles.groupBy(key.alias("key")).agg(first("dimensions", F.col("dimensions") != ""), first("duration", F.col("duration") > 0), first("title_size", F.col("title_size") > 0))
    rows = library.where(missing_metadata(F.col("dimensions"), F.col("duration"), F.col("filesize"))).withColumn("key", fold(F.col("title"))).join(known, "key", "left")
    blank = F.coalesce(F.lower(F.trim("dimensions")), F.lit("")).isin("", "0 x 0")
    needs = {"dimensions": (blank, "new_dimensions"), "duration": (F.coalesce("duration", F.lit(0)) == 0, "new_duration"), "filesize": (F.coalesce("filesize", F.lit(0)) == 0, "new_title_size")}
    value = lambda c: F.when(needs[c][0] & F.col(needs[c][1]).isNotNull(), F.col(needs[c][1]).cast(library.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    needed, filled = (F.concat_ws(",", *[F.when(cond & extra(new), F.lit(c)) for c, (cond, new) in needs.items()]) for extra in (lambda new: F.lit(True), lambda new: F.col(new).isNotNull()))
    return rows.select("id", "title", *[value(c) for c in needs], needed.alias("needed"), filled.alias("filled"))


def fill_missing(library: DataFrame, titles: DataFrame) -> DataFrame:
    """The library rows that lack metadata, with what a scan of their title knows: (id, title, filesize, filled)."""
    known = titles.select(fold(library_title(F.col("title"))).alias("key"), "title_size").groupBy("key").agg(F.sum("title_size").alias("scanned"))
    rows = library.where(missing_metadata(F.col("dimensions"), F.col("duration"), F.col("filesize"))).withColumn("key", fold(F.col("title"))).join(known, "key", "left")
    size = F.when(F.coalesce(F.col("filesize"), F.lit(0)) == 0, F.coalesce("scanned", F.lit(0))).otherwise(F.col("filesize"))
    return rows.select("id", "title", size.alias("filesize"), ((F.coalesce(F.col("filesize"), F.lit(0)) == 0) & F.coalesce(F.col("scanned") > 0, F.lit(False))).alias("filled"))


def refresh_sizes(library: DataFrame, files: DataFrame) -> DataFrame:
    """Each title on disk against the library, by its whole title and else by its library title: (title, disk_size, id, outcome)."""
    disk = title_rollup(files).select("title", F.col("title_size").alias("disk_size"))
    least = library.groupBy(fold(F.col("title")).alias("key")).agg(F.min(F.struct("id", "filesize")).alias("row"))
    one, two = least.select(F.col("key").alias("k1"), F.col("row").alias("r1")), least.select(F.col("key").alias("k2"), F.col("row").alias("r2"))
    rows = disk.withColumn("k1", fold(F.col("title"))).withColumn("k2", fold(library_title(F.col("title")))).join(one, "k1", "left").join(two, "k2", "left").withColumn("row", F.coalesce("r1", "r2"))
    outcome = F.when(F.col("row").isNull(), "not_found").when(F.col("row.filesize") == F.col("disk_size"), "unchanged").otherwise("updated")
    return rows.select("title", "disk_size", F.col("row.id").alias("id"), outcome.alias("outcome"))


def insert_new(library: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows to add: titles that the library lacks, one for each key."""
    new = titles.select(library_title(F.col("title")).alias("title"), "title_size").withColumn("key", fold(F.col("title"))).groupBy("key").agg(F.min("title").alias("title"), F.sum("title_size").alias("filesize"))
    return new.join(library.select(fold(F.col("title")).alias("key")).distinct(), "key", "left_anti").select("title", "filesize", F.current_timestamp().alias("date_created"))
