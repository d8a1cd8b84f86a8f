"""Display forms of sizes, durations and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_BREAK = " "


def byte_size(c: Column, base: int = 1000) -> Column:
    """``1.50 GB``; a CASE ladder, so exact powers show as 1.00 of the next unit."""
    units = ["Bytes", "KB", "MB", "GB", "TB", "PB"]
    gap = NO_BREAK if base == 1000 else " "
    x = c.cast("double")
    out = F.when(c.isNull() | (x < 0), "Invalid Size").when(x == 0, "0 Bytes")
    for k in range(1, len(units)):
        out = out.when(x < float(base**k), F.concat(F.format_string("%.2f", x / float(base ** (k - 1))), F.lit(gap + units[k - 1])))
    return out.otherwise(F.concat(F.format_string("%.2f", x / float(base ** (len(units) - 1))), F.lit(gap + units[-1])))


def duration(c: Column) -> Column:
    """``H:MM:SS`` or ``MM:SS``; whole seconds."""
    s = F.floor(c)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    long, short = F.format_string("%d:%02d:%02d", h, m, r), F.format_string("%02d:%02d", m, r)
    return F.when(c.isNull(), "N/A").when(c < 0, "Invalid Duration").when(s == 0, "00:00:00").when(h > 0, long).otherwise(short)


def spoken_duration(c: Column) -> Column:
    s = F.floor(c)
    return F.concat_ws(" ", F.when(s >= 3600, F.format_string("%dh", F.floor(s / 3600))), F.when(s >= 60, F.format_string("%dm", F.floor(s / 60) % 60)), F.format_string("%ds", s % 60))


def whole_seconds(c: Column) -> Column:
    """Listing form: null and negative are 0, halves round up."""
    return F.greatest(F.round(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).cast("long")


def shown_date(ts: Column, duplicate: Column) -> Column:
    return F.when(duplicate & ts.isNotNull(), F.date_format(ts, "yyyy-MM-dd")).otherwise("")


def drive_of(path: Column) -> Column:
    """The volume's name: the segment behind ``/Volumes/``, or the first."""
    return F.regexp_extract(path, r"^/(?:Volumes/)?([^/]+)", 1)


def run_summary(c: dict[str, Column]) -> Column:
    """One line of counters: ``3 files moved (1.20 GB), 1 duplicate shelved``; zero parts are left out."""
    some = lambda n, one, many: F.when(n == 1, F.concat(F.lit("1 "), F.lit(one))).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))
    moved = F.concat(some(c["moved"], "file moved", "files moved"), F.lit(" ("), byte_size(c["bytes"]), F.lit(")"))
    parts = [moved, some(c["duped"], "duplicate shelved", "duplicates shelved"), some(c["renamed"], "file renamed", "files renamed"), some(c["skipped"], "skipped", "skipped"), some(c["failed"], "failure", "failures"), some(c["flagged"], "to review", "to review")]
    line = F.concat_ws(", ", *parts)
    return F.when(line == "", "Nothing to do").otherwise(line)


def last_run(c: dict[str, Column]) -> Column:
    """One line about a run that has ended: dry_run, finished (shown as it is; null: unknown), seconds (null: not told), moved, bytes, duped, failed, renamed, skipped, flagged, and
    index_rebuilt (null: not tried). What was skipped or needs review, or failed to be rebuilt, is always told."""
    text = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    some = lambda n, *parts: F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(*parts)).otherwise("")
    review = " needs review (see RENAME_01_SKIP in the log)"
    return F.concat(
        F.when(c["dry_run"], "Dry run").otherwise("Run"), F.lit(" finished "), F.coalesce(c["finished"], F.lit("unknown")), F.when(c["seconds"].isNotNull(), F.concat(F.lit(" (took "), spoken_duration(c["seconds"]), F.lit(")"))).otherwise(""),
        F.lit(" — "), text(c["moved"]), F.lit(" moved ("), byte_size(F.coalesce(c["bytes"], F.lit(0))), F.lit("), "), text(c["duped"]), F.lit(" duplicates, "), text(c["failed"]), F.lit(" failed"),
        some(c["renamed"], F.lit(", "), text(c["renamed"]), F.lit(" renamed to # 01")), some(c["skipped"], F.lit(", "), text(c["skipped"]), F.lit(" groups skipped (space)")),
        F.when(c["flagged"] == 1, F.lit(f". 1 file{review}")).otherwise(some(c["flagged"], F.lit(". "), text(c["flagged"]), F.lit(f" files{review.replace('needs', 'need')}"))),
        F.when(c["index_rebuilt"], ". Drive index rebuilt.").when(~c["index_rebuilt"], ". Drive index rebuild FAILED — rebuild it manually.").otherwise(""),
    )
