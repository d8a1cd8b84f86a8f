"""Consolidation plans: the best copy of every item, the numbering of first episodes, a drive for every group (see ``placement``), and balancing.

Running sums are taken over range-partitioned blocks of the order, so that no drive is one task's sort. What is freed is found in bounded rounds of such sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import natural_key
from ..functions.titles import first_number_name, group_key, item_key, parse_episode, variant_key
from ..sources.files import CONSOLIDATION_EXTENSIONS, short_list, wanted
from ..sources.store import materialize
from .placement import MAX_DRIVES, drive_sums, in_order, listed_free, place

#: Names that may be tried for a file that collides: as given, with the run's stamp, then with a counter from 2 up to this.
LAST_NAME = 50
#: Shares that the files of one name are ranked in, if they are more than MANY and more than one in MANY of all.
SHARES, MANY = 32, 10_000


def running_sum(rows: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same key ahead of each row. Blocks are range partitions of the order; ``order`` leaves no ties."""
    blocks = materialize(rows.repartitionByRange(F.col(key), *order).withColumn("__block", F.spark_partition_id()), "blocks")
    sums = blocks.groupBy(key, "__block").agg(F.sum(value).alias("__s"))  # a row for each key and partition
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before).drop("__s")
    own = F.coalesce(F.sum(value).over(Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("__own", own).join(sums, [key, "__block"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__block", "__own", "__before")


def episodes(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """(path, drive, stem, ext, base, base_key, ep, variant, size, mtime) of the files that take part."""
    rows = files.where(wanted(F.col("path"), F.col("drive"), extensions or CONSOLIDATION_EXTENSIONS, None)).withColumn("p", parse_episode(F.col("stem")))
    return rows.select("path", "drive", "stem", "ext", F.col("p.base").alias("base"), group_key(F.col("p.base")).alias("base_key"), F.col("p.ep").alias("ep"), F.col("p.variant").alias("variant"), "size", "mtime")


def only(eps: DataFrame, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Groups whose name contains ``text``; the first ``limit`` of them in natural order."""
    if text:
        eps = eps.where(F.lower("base").contains(text.lower()))
    if limit is not None:
        eps = eps.join(F.broadcast(eps.select("base_key").distinct().orderBy(natural_key(F.col("base_key"))).limit(limit)), "base_key", "left_semi")
    return eps


def group_sizes(eps: DataFrame) -> DataFrame:
    """(base_key, display, n_files, bytes) of each group. The display is that of the first path."""
    return eps.groupBy("base_key").agg(F.min_by("base", "path").alias("display"), F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def group_order(eps: DataFrame) -> DataFrame:
    """The groups in the order of work: display name in natural order, then more bytes first."""
    return group_sizes(eps).orderBy(*in_order())


def items(eps: DataFrame) -> DataFrame:
    """Adds item_key, rename_01, flagged and new_name. An unnumbered file of a numbered group becomes ``# 01``, unless episode 1 stands only with a suffix. What a group
    holds is summed up before it meets the files, so that a group of many files isn't one task's."""
    rows = eps.withColumn("vk", variant_key(F.col("variant")))
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    flags = rows.groupBy("base_key").agg(some(F.col("ep").isNotNull()).alias("numbered"), some((F.col("ep") == 1) & (F.col("vk") == "")).alias("bare"), some((F.col("ep") == 1) & (F.col("vk") != "")).alias("suffixed"))
    rows = rows.join(flags, "base_key")
    plain = F.col("ep").isNull() & (F.col("vk") == "") & F.col("numbered")
    blocked = F.col("suffixed") & ~F.col("bare")
    key = F.when(plain & ~blocked, "EP00001").otherwise(item_key(F.col("ep"), F.col("variant")))
    rows = rows.withColumn("item_key", key).withColumn("rename_01", plain & ~blocked).withColumn("flagged", plain & blocked)
    return rows.withColumn("new_name", F.when(F.col("rename_01"), first_number_name(F.col("stem"), F.col("ext")))).drop("numbered", "bare", "suffixed", "vk")


def best_copies(eps: DataFrame) -> DataFrame:
    """Adds ``keep``: of each item the largest copy, then the newest, then the first path; found by partial minima and looked up by each file."""
    rows = items(eps)
    last = F.lit((1 << 63) - 1)
    order = F.struct(F.coalesce(-F.col("size"), last).alias("s"), F.coalesce(-F.unix_micros(F.col("mtime").cast("timestamp")), last).alias("m"), F.col("path").alias("p"))
    best = rows.groupBy("base_key", "item_key").agg(F.min(order)["p"].alias("__best"))
    return rows.join(best, ["base_key", "item_key"]).withColumn("keep", F.col("path") == F.col("__best")).drop("__best")


def drive_ranks(kept: DataFrame, drives: DataFrame) -> DataFrame:
    """Every group against every drive, best first: most files there (n, 0 where none), most bytes, most free space, then name."""
    every = F.array(*[F.struct(F.lit(d).alias("drive"), F.lit(free).alias("free_bytes")) for d, free in listed_free(drives)])
    held = F.map_from_entries(F.collect_list(F.struct("drive", F.struct("n", "bytes"))))  # at most MAX_DRIVES entries
    groups = drive_sums(kept).groupBy("base_key").agg(held.alias("held"), F.sum("bytes").alias("group_bytes"))
    rows = groups.select("base_key", "group_bytes", "held", F.explode(every).alias("d")).select("base_key", "group_bytes", "d.drive", "d.free_bytes", F.element_at("held", F.col("d.drive")).alias("own"))
    rows = rows.select("base_key", "drive", "free_bytes", F.coalesce("own.n", F.lit(0)).alias("n"), F.coalesce("own.bytes", F.lit(0)).alias("bytes"), "group_bytes")
    w = Window.partitionBy("base_key").orderBy(F.desc("n"), F.desc("bytes"), F.desc("free_bytes"), "drive")
    return rows.withColumn("rank", F.row_number().over(w))


def bids(kept: DataFrame, drives: DataFrame) -> DataFrame:
    """(base_key, drive, rank, bytes, group_bytes, incoming): every group against every drive, and what it would have to take in."""
    return drive_ranks(kept, drives).select("base_key", "drive", "rank", "bytes", "group_bytes", (F.col("group_bytes") - F.col("bytes")).alias("incoming"))


def accept(offers: DataFrame, free: DataFrame, reserve: int) -> DataFrame:
    """Adds ``taken`` and ``accepted`` to (base_key, drive, incoming)."""
    rows = running_sum(offers, "drive", [F.col("base_key")], "incoming", "ahead").join(short_list(free, MAX_DRIVES), "drive")
    return rows.withColumn("taken", F.col("ahead") + F.col("incoming")).withColumn("accepted", F.col("free_bytes") - F.col("taken") >= reserve).drop("ahead")


def consolidation_plan(files: DataFrame, drives: DataFrame, reserve: int = 0) -> DataFrame:
    """One row for each file: keep, shelve, skip, stay, rename or move, its target drive, file name there, bytes to move, and whether the name is taken there."""
    eps = materialize(best_copies(episodes(files)), "copies")
    target = place(eps.where("keep"), drives, reserve, group_sizes(eps)).select("base_key", F.col("drive").alias("target"), "evacuated")
    rows = eps.join(target, "base_key", "left").withColumn("file", F.coalesce("new_name", F.concat("stem", F.lit("."), "ext")))
    action = F.when(~F.col("keep"), "shelve").when(F.col("target").isNull(), "skip").when(F.col("drive") != F.col("target"), "move").when(F.col("rename_01"), "rename").otherwise("stay")
    rows = rows.withColumn("action", action).withColumn("move_bytes", F.when(action == "move", F.col("size")).otherwise(0)).withColumn("evacuated", F.coalesce("evacuated", F.lit(False)))
    moves = rows.where("action = 'move'").select("path", "target", "file", "size", "mtime")
    there = eps.where("keep").select("drive", F.concat("stem", F.lit("."), "ext").alias("file"), "size", "mtime")  # shelved copies make room
    return rows.join(collisions(moves, there).select("path", "class"), "path", "left").withColumnRenamed("class", "collision")


def leaving(groups: DataFrame, need: int, room: int) -> tuple[Column, Column, int]:
    """Which of one drive's (base_key, bytes) leave it, the largest first, until ``need`` is freed, each one only if it fits into what is left of ``room``: as conditions
    (leaves, was looked at), and what is left of the room.

    A round takes the longest run of groups, of those that fit, that ``room`` holds and ``need`` asks for, by a running sum; then those that are larger than the rest drop out.
    A group that ends a run is no larger than the run, so each round halves the room at least.
    """
    took, last = F.lit(False), None
    behind = lambda z: (F.col("bytes") < z[0]) | ((F.col("bytes") == z[0]) & (F.col("base_key") > z[1]))
    while need > 0 and room >= 0:
        rows = groups.where(F.col("bytes") <= room)
        if last is not None:
            rows = rows.where(behind(last))
        sums = running_sum(rows.withColumn("__all", F.lit(0)), "__all", [-F.col("bytes"), F.col("base_key")], "bytes", "before")
        run = sums.where((F.col("before") + F.col("bytes") <= room) & (F.col("before") < need))
        total, end = run.agg(F.sum("bytes"), F.max(F.struct((-F.col("bytes")).alias("b"), F.col("base_key").alias("k")))).first()
        if end is None:
            break
        own = F.col("bytes") <= room
        if last is not None:
            own = own & behind(last)
        last = (-end[0], end[1])
        took = took | (own & ~behind(last))
        need, room = need - total, room - total
    return took, ~behind(last) if need <= 0 and last is not None else F.lit(need > 0), room


def evacuation(groups: DataFrame, need: DataFrame, fresh: DataFrame | None = None, room: int | None = None) -> DataFrame:
    """Of (base_key, drive, bytes) those that leave for a sink with ``room`` bytes (None: enough), and those that it couldn't take (``fits`` is false), drive by drive in the
    order of their names, the largest first, until each drive's need_bytes are freed. Groups just moved to their drive (``fresh``) stay."""
    if fresh is not None:
        groups = groups.join(fresh.select("base_key", "drive"), ["base_key", "drive"], "left_anti")
    listed = need.select("drive", F.col("need_bytes").cast("long")).limit(MAX_DRIVES + 1).collect()
    if len(listed) > MAX_DRIVES:
        raise ValueError(f"more than {MAX_DRIVES} drives in a configured list")
    groups = materialize(groups, "leaving")
    left, out = (1 << 62) if room is None else room, []
    for drive, amount in sorted(map(tuple, listed)):
        own = groups.where(F.col("drive") == drive)
        took, seen, left = leaving(own, amount, left)
        out.append(own.where(seen).withColumn("fits", took))
    return reduce(DataFrame.unionByName, out) if out else groups.limit(0).withColumn("fits", F.lit(True))


def balance_plan(groups: DataFrame, drives: DataFrame, target_free: int, reserve: int = 0, fresh: DataFrame | None = None) -> DataFrame:
    """Groups to move to the sink so that each drive reaches its target, as far as the sink holds them (``fits``)."""
    need = drives.where("NOT is_sink").select("drive", F.greatest(F.lit(target_free) - F.col("free_bytes"), F.lit(0)).alias("need_bytes"))
    sink = drives.where("is_sink").agg(F.max("drive"), F.max("free_bytes")).first()
    return evacuation(groups, need, fresh, int(sink[1] or 0) - reserve)


def collisions(moves: DataFrame, existing: DataFrame, tolerance: int = 2) -> DataFrame:
    """Moves (path, target, file, size, mtime) onto a drive that has the file name already, with ``class``: 'duplicate' if a copy there has the same size and,
    within the tolerance in seconds, time; else 'suspect'. Existing files are summed up by name, and by name, size and a short span of time, before they are joined."""
    span = tolerance + 1
    second = F.unix_timestamp("mtime")
    there = existing.select(F.col("drive").alias("target"), F.lower("file").alias("key"), "size", second.alias("at"))
    names = there.select("target", "key").distinct()
    near = there.groupBy("target", "key", "size", F.floor(F.col("at") / span).alias("slot")).agg(F.collect_set("at").alias("times"))  # at most ``span`` different seconds
    rows = moves.withColumn("key", F.lower("file")).join(names, ["target", "key"])
    asked = rows.select("path", "target", "key", "size", second.alias("at")).withColumn("slot", F.explode(F.array(*[F.floor(F.col("at") / span) + i for i in (-1, 0, 1)])))
    same = asked.join(near, ["target", "key", "size", "slot"]).where(F.exists("times", lambda t: F.abs(t - F.col("at")) <= tolerance)).select("path", "target").distinct()
    return rows.join(same.withColumn("same", F.lit(True)), ["path", "target"], "left").withColumn("class", F.when(F.col("same"), "duplicate").otherwise("suspect")).drop("same")


def _stamped(names: DataFrame, tails: list[str]) -> DataFrame:
    """(target_dir, key, blocked): for the names (target_dir, name) that are another name with one of the ``tails``, that name and the numbers of such tails."""
    each, dot = F.array(*[F.struct(F.lit(i).alias("no"), F.lower(F.lit(t)).alias("tail")) for i, t in enumerate(tails) if t]), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    ends = names.select("target_dir", "name", F.explode(F.array_distinct(F.array(F.lit(""), dot))).alias("dot")).withColumn("rest", F.expr("left(name, length(name) - length(dot))"))
    found = ends.select("*", F.explode(F.filter(each, lambda t: F.col("rest").endswith(t["tail"]))).alias("t")).select("target_dir", "name", F.col("t.no").alias("no"), "t.tail", F.concat(F.expr("left(rest, length(rest) - length(t.tail))"), "dot").alias("key"))
    body, dot = F.regexp_replace("key", r"\.[^.]*$", ""), F.regexp_extract("key", r"(\.[^.]*)$", 1)
    return found.where(F.col("name") == F.lower(F.concat(body, "tail", dot))).groupBy("target_dir", "key").agg(F.collect_set("no").alias("blocked"))  # no more than there are tails


def free_names(plan: DataFrame, existing: DataFrame, stamp: str, most: int = LAST_NAME) -> DataFrame:
    """Adds free_name to (path, target_dir, file): the name as given, else with the run's stamp, else with a counter from 2 up to ``most``; never a name that
    exists or that another file of the plan asks for. Of several files with one name the first path takes the first free one. No free name: null, and a problem."""
    rows = plan.withColumn("key", F.lower("file"))
    name = ["target_dir", "key"]
    tails = ["", f"__{stamp}", *[f"__{stamp}_{i}" for i in range(2, most + 1)]]
    held = existing.select(F.col("dir").alias("target_dir"), F.lower("file").alias("key")).distinct()
    # Only names that look like tried ones can be in the way of those.
    taken = held.unionByName(rows.select(*name)).where(F.col("key").contains(F.lower(F.lit(f"__{stamp}")))).select("target_dir", F.col("key").alias("name")).distinct()
    blocked = _stamped(taken, tails)
    held = held.withColumn("held", F.lit(True))

    def chosen(turns: DataFrame) -> DataFrame:
        """Adds ``no``, the number of the tail that each turn takes."""
        free = F.filter(F.sequence(F.lit(0), F.lit(len(tails) - 1)), lambda i: F.when(i == 0, F.col("held").isNull()).otherwise(~F.array_contains(F.coalesce("blocked", F.array().cast("array<int>")), i)))
        known = turns.join(held, name, "left").join(blocked, name, "left")
        return known.withColumn("no", F.get(free, F.col("turn") - 1)).drop("turn", "held", "blocked")

    turn = lambda *share: F.row_number().over(Window.partitionBy(*name, *share).orderBy("path"))
    total, code = rows.count(), F.hash(*name)
    least = max(MANY, total // MANY)
    many = [r[0] for r in rows.groupBy(code.alias("code")).agg(F.count("*").alias("n")).where(F.col("n") > least).collect()] if total > least else []  # at most MANY
    few = rows
    if many:
        codes = F.broadcast(plan.sparkSession.createDataFrame([(c,) for c in many], "code int"))
        rows = rows.withColumn("code", code)
        few, shared = rows.join(codes, "code", "left_anti").drop("code"), rows.join(codes, "code", "left_semi").drop("code")
    out = chosen(few.withColumn("turn", turn()))
    if many:
        # There are no more names than tails: the first files of each share, then the first of those.
        first = shared.select("path", *name).withColumn("turn", turn(F.pmod(F.xxhash64("path"), F.lit(SHARES)))).where(F.col("turn") <= len(tails))
        given = chosen(first.withColumn("turn", turn()).where(F.col("turn") <= len(tails))).select("path", *name, "no")
        out = out.unionByName(shared.join(given, ["path", *name], "left"))
    stem, end = F.regexp_replace("file", r"\.[^.]*$", ""), F.regexp_extract("file", r"(\.[^.]*)$", 1)
    given = F.when(F.col("key").isNull() | F.col("target_dir").isNull(), F.col("file")).otherwise(F.concat(stem, F.get(F.array(*map(F.lit, tails)), F.col("no")), end))
    return out.select(*plan.columns, given.alias("free_name")).withColumn("problem", F.when(F.col("free_name").isNull(), "no_free_name"))


def running_free(moves: DataFrame, drives: DataFrame) -> DataFrame:
    """Free space of each drive after each step of (step, drive, delta); steps of a drive differ."""
    rows = running_sum(moves, "drive", [F.col("step")], "delta", "ahead")
    return rows.join(short_list(drives.select("drive", "free_bytes"), MAX_DRIVES), "drive").withColumn("free_after", F.col("free_bytes") + F.col("ahead") + F.col("delta")).drop("ahead")
