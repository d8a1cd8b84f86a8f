"""A drive for each group, in the order of work, as one group after the other would choose.

Each group takes its best drive that has room, and what it moves changes the room that the next groups find. Where no drive has room, the drives are
tried again, and groups placed earlier on the one tried leave it for the sink, the largest first, as far as the sink holds them.

Groups are cut into blocks of the order, and each block runs on its own from a guessed vector of free space (a number for each drive). A run also
tells how far that vector may be off before any of its choices changes. The driver chains the blocks: where the true start lies inside, the block stands
and only its end is shifted; other blocks run again from a better guess. So where space isn't short, all blocks settle in a round or two. A block in which
a group finds no room runs again from its true start, with the largest groups on each drive that the sink could hold; these lists are short, and
a block that needs more of them stops there and goes on with fresh ones.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import natural_key
from ..sources.store import discard, materialize, workers_import

#: Drives are a short configured list; more are an error.
MAX_DRIVES = 64
#: Groups of a block, and of each drive the groups that a block with evacuation takes along.
BLOCK, LISTED = 20_000, 1_000
#: Written results that are read together before they become one table.
PARTS = 32
NO_BOUND = 1 << 62


def numbered(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Adds each row's place, from 0, in an order without ties: range partitions, each row's place in its own, and the rows ahead of it (a row for each partition on the driver)."""
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    dealt = rows.withColumns(keys)
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    dealt = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, ahead, shifts = F.shiftright("__at", 33), 0, []
    for p, first, n in sorted(map(tuple, dealt.groupBy(part.alias("p")).agg(F.min("__at"), F.count("*")).collect())):
        shifts.append((p, ahead - first))
        ahead += n
    listed = rows.sparkSession.createDataFrame(shifts, "__part long, __shift long")
    return dealt.withColumn("__part", part).join(F.broadcast(listed), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def in_order() -> list[Column]:
    """The order of work of (display, bytes, base_key)."""
    return [natural_key(F.col("display")), -F.col("bytes"), F.col("base_key")]


def drive_sums(kept: DataFrame) -> DataFrame:
    return kept.groupBy("base_key", "drive").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def listed_free(drives: DataFrame) -> list[tuple[str, int]]:
    """The drives and their free space, a short configured list; more than MAX_DRIVES are an error."""
    rows = drives.select("drive", F.col("free_bytes").cast("long")).limit(MAX_DRIVES + 1).collect()
    if len(rows) > MAX_DRIVES:
        raise ValueError(f"more than {MAX_DRIVES} drives in a configured list")
    return sorted((r[0], r[1]) for r in rows)


class Margins:
    """How far each drive's free space may be shifted without changing a choice."""

    def __init__(self, drives: int):
        self.down, self.up, self.pairs = [NO_BOUND] * drives, [NO_BOUND] * drives, {}

    def took(self, d: int, over: int) -> None:
        self.down[d] = min(self.down[d], over)

    def passed(self, d: int, short: int) -> None:
        self.up[d] = min(self.up[d], short - 1)

    def before(self, d: int, e: int, more: int) -> None:
        """``d`` was tried ahead of ``e``, equal but for having ``more`` space (or, at 0, standing first)."""
        self.pairs[d, e] = min(self.pairs.get((d, e), NO_BOUND), more)

    def state(self) -> list:
        return [self.down, self.up, [[d, e, m] for (d, e), m in self.pairs.items()]]

    @staticmethod
    def hold(state: list, shift: list[int]) -> bool:
        down, up, pairs = state
        return all(-a <= s <= b for s, a, b in zip(shift, down, up, strict=True)) and all(shift[e] - shift[d] <= m for d, e, m in pairs)


def ranked(counts: list[int], sizes: list[int], free: list[int]) -> list[int]:
    """Drives, best first: most files there, most bytes, most free space, then as listed."""
    return sorted(range(len(free)), key=lambda d: (-counts[d], -sizes[d], -free[d], d))


def choose(counts: list[int], sizes: list[int], free: list[int], reserve: int, margins: Margins) -> tuple[int, int] | None:
    """(drive, rank) of the first drive with room for what the group would move there."""
    order, total = ranked(counts, sizes, free), sum(sizes)
    for k, d in enumerate(order):
        for e in order[k + 1 :]:
            if (counts[e], sizes[e]) != (counts[d], sizes[d]):
                break
            margins.before(d, e, free[d] - free[e] - (e < d))
        over = free[d] - (total - sizes[d]) - reserve
        if over >= 0:
            margins.took(d, over)
            return d, k + 1
        margins.passed(d, -over)
    return None


def settle(d: int, sizes: list[int], free: list[int]) -> int:
    """Moves a group to ``d``: its other drives get their space back. Returns the incoming bytes."""
    incoming = sum(sizes) - sizes[d]
    for e, n in enumerate(sizes):
        free[e] += n if e != d else -incoming
    return incoming


class Homes:
    """The placed groups of each drive, largest first; ``lists``: of each drive [(-bytes, pos)] and whether more stand behind them."""

    def __init__(self, lists: list[tuple[list[tuple[int, int]], bool]]):
        self.own = [sorted(own) for own, _ in lists]
        self.last = [own[-1] if more else None for own, (_, more) in zip(self.own, lists, strict=True)]

    def add(self, d: int, size: int, pos: int) -> None:
        insort(self.own[d], (-size, pos))

    def leave(self, d: int, need: int, room: int) -> tuple[list[tuple[int, int]], bool]:
        """The groups that leave ``d``, largest first and each one only if it fits into what is left of ``room``; and whether the list ended too soon."""
        own, out, at = self.own[d], [], 0
        while need > 0 and room >= 0:
            at = max(at, bisect_left(own, (-room, -1)))
            if at >= len(own) or (self.last[d] is not None and own[at] > self.last[d]):
                return out, self.last[d] is not None
            need, room, at = need + own[at][0], room + own[at][0], at + 1
            out.append(own[at - 1])
        return out, False


def run_block(rows: Iterable[tuple[int, list[int], list[int]]], free: list[int], reserve: int, sink: int | None, homes: Homes | None = None) -> tuple[list[tuple], list[int], dict]:
    """Decisions [(pos, drive, incoming, round, bytes)] of (pos, counts, sizes) in order, the positions evacuated, and a summary: end, margins, and ``stop``, the
    position of a group that needs room made (without ``homes``) or longer lists (with them)."""
    free, out, gone, margins, stop = list(free), [], [], Margins(len(free)), None
    for pos, counts, sizes in rows:
        total = sum(sizes)
        found = choose(counts, sizes, free, reserve, margins)
        if found is None and sink is not None and homes is None:
            stop = pos
            break
        if found is None and sink is not None:
            tried, moved, short = list(free), [], False
            for k, d in enumerate(ranked(counts, sizes, free)):
                required = total - sizes[d] + reserve
                if tried[d] < required and d != sink:
                    left, short = homes.leave(d, required - tried[d], tried[sink] - reserve)
                    if short:
                        break
                    moved += [(d, x) for x in left]
                    for size, _ in left:
                        tried[d] -= size
                        tried[sink] += size
                if tried[d] >= required:
                    found = d, k + 1 + len(free)
                    break
            if short:
                stop = pos
                break
            free = tried
            for d, x in moved:
                homes.own[d].remove(x)
                gone.append(x[1])
        if found is None:
            out.append((pos, -1, None, None, total))
            continue
        d, rank = found
        out.append((pos, d, settle(d, sizes, free), rank, total))
        if homes is not None and d != sink:
            homes.add(d, total, pos)
    return out, gone, {"end": free, "margins": margins.state(), "stop": stop}


DECIDED = "block long, pos long, drive int, incoming long, round int, bytes long, gone boolean, summary string"


def _as_frame(block: int, out: list[tuple], gone: list[int], summary: dict) -> pd.DataFrame:
    rows = [(block, *x, False, None) for x in out] + [(block, p, None, None, None, None, True, None) for p in gone] + [(block, None, None, None, None, None, None, json.dumps(summary))]
    frame = pd.DataFrame(rows, columns=["block", "pos", "drive", "incoming", "round", "bytes", "gone", "summary"])
    return frame.astype({"pos": "Int64", "drive": "Int32", "incoming": "Int64", "round": "Int32", "bytes": "Int64", "gone": "boolean"})


def _in_order(frame: pd.DataFrame) -> list[tuple[int, list[int], list[int]]]:
    frame = frame.sort_values("pos")
    return [(int(p), [int(x) for x in c], [int(x) for x in s]) for p, c, s in zip(frame["pos"], frame["counts"], frame["sizes"], strict=True)]


def _runner(starts: dict[int, list[int]], reserve: int, sink: int | None, homes: Homes | None = None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        return _as_frame(block, *run_block(_in_order(frame), starts[block], reserve, sink, homes))

    return one


class Run:
    """The blocks of one placement and what is settled of them."""

    def __init__(self, groups: DataFrame, free: list[int], reserve: int, sink: int | None, listed: int):
        self.groups, self.free, self.reserve, self.sink, self.listed = groups, free, reserve, sink, listed
        self.last = (groups.agg(F.max("block")).first()[0] or 0) if not groups.isEmpty() else -1
        self.results: dict[int, tuple[int, list[int], dict]] = {}  # by block: number of the run, its start, its summary
        self.runs: dict[int, DataFrame] = {}
        self.kept: list[DataFrame] = []
        self.gone: list[DataFrame] = []

    def try_blocks(self, starts: dict[int, list[int]]) -> None:
        """Runs blocks without evacuation, each from its start."""
        number = len(self.runs)
        some = self.groups.where(F.col("block").between(min(starts), max(starts)) & F.col("block").isin(list(starts)) if len(starts) <= self.last else F.lit(True))
        self.runs[number] = materialize(some.groupBy("block").applyInPandas(_runner(starts, self.reserve, self.sink), DECIDED), "tried")
        for r in self.runs[number].where("summary IS NOT NULL").select("block", "summary").collect():  # a row for each block
            self.results[r[0]] = (number, starts[r[0]], json.loads(r[1]))

    def settle(self, rows: DataFrame) -> None:
        self.kept.append(rows.where("NOT gone").select("pos", "drive", "incoming", "round", "bytes"))
        if len(self.kept) > PARTS:
            self.kept = [materialize(reduce(DataFrame.unionByName, self.kept), "decided")]

    def keep_blocks(self, blocks: list[int]) -> None:
        """The decisions of settled blocks, from the run that each stands by."""
        for number in {self.results[b][0] for b in blocks}:
            own = [b for b in blocks if self.results[b][0] == number]
            self.settle(self.runs[number].where(F.col("block").isin(own)))

    def decided(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.kept)

    def left(self) -> DataFrame:
        """The positions of groups that were sent on to the sink."""
        none = self.groups.sparkSession.createDataFrame([], "pos long")
        return reduce(DataFrame.unionByName, self.gone, none)

    def homes(self, room: int, most: int) -> Homes:
        """Of each drive but the sink the ``most`` largest settled groups that ``room`` could hold."""
        lists: list[tuple[list[tuple[int, int]], bool]] = [([], False) for _ in self.free]
        if self.kept and room >= 0:
            left = self.decided().where((F.col("drive") >= 0) & (F.col("drive") != self.sink) & (F.col("bytes") <= room))
            if self.gone:
                left = left.join(self.left(), "pos", "left_anti")
            for d in range(len(self.free)):
                if d != self.sink:
                    rows = left.where(F.col("drive") == d).orderBy(F.desc("bytes"), "pos").limit(most + 1).select("bytes", "pos").collect()
                    lists[d] = ([(-r[0], r[1]) for r in rows[:most]], len(rows) > most)
        return Homes(lists)

    def make_room(self, block: int, start: list[int]) -> list[int]:
        """Runs one block with evacuation, from its true start, as one task; returns its end."""
        reserve, sink = self.reserve, self.sink
        rows, most = self.groups.where(F.col("block") == block), self.listed
        gains = rows.agg(F.sum(F.col("sizes")[sink])).first()[0]  # what the block may give back to the sink
        while True:
            homes = self.homes(start[sink] - reserve + gains, most)

            done = materialize(rows.groupBy("block").applyInPandas(_runner({block: start}, reserve, sink, homes), DECIDED), "settled")
            summary = json.loads(done.where("summary IS NOT NULL").first()["summary"])
            stuck = done.where("NOT gone").isEmpty()
            most = 2 * most if stuck else self.listed  # a single group that displaces more than the lists hold
            if not stuck:
                self.settle(done)
                self.gone.append(done.where("gone").select("pos"))
                if len(self.gone) > PARTS:
                    self.gone = [materialize(self.left(), "gone")]
            start = summary["end"]
            if summary["stop"] is None:
                return start
            rows = rows.where(F.col("pos") >= summary["stop"])

    def finish(self) -> None:
        at, start, ahead = 0, list(self.free), self.last + 1
        while at <= self.last:
            ready, full = [], False
            while at <= self.last and at in self.results:
                _, used, summary = self.results[at]
                if not Margins.hold(summary["margins"], [a - b for a, b in zip(start, used, strict=True)]):
                    break
                if summary["stop"] is not None:
                    full = True
                    break
                ready.append(at)
                start = [s + e - u for s, e, u in zip(start, summary["end"], used, strict=True)]
                at += 1
            if ready:
                self.keep_blocks(ready)
            if full:
                start, at, ahead = self.make_room(at, start), at + 1, 1
                continue
            if at <= self.last:
                guess, starts = start, {}
                for b in range(at, min(at + ahead, self.last + 1)):
                    known = self.results.get(b)
                    if known is None or not Margins.hold(known[2]["margins"], [a - u for a, u in zip(guess, known[1], strict=True)]):
                        starts[b] = guess
                    if known is not None:
                        guess = [g + e - u for g, e, u in zip(guess, known[2]["end"], known[1], strict=True)]
                self.try_blocks(starts)
                ahead *= 2


def place(kept: DataFrame, drives: DataFrame, reserve: int = 0, order: DataFrame | None = None, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """(base_key, drive, incoming, round, evacuated): each group's drive, or nulls where none has room. ``round``: the chosen drive's place among the group's candidates, counted
    on where space had to be made; ``evacuated``: the group was sent on to the sink later. ``kept``: (base_key, drive, size) of the files; ``drives``: (drive, free_bytes, and
    is_sink, without which no room is made); ``order``: (base_key, display, bytes), groups in natural order of display, then the larger (by default by key and kept bytes)."""
    free = listed_free(drives)
    names = [d for d, _ in free]
    sinks = [r[0] for r in drives.where("is_sink").select("drive").limit(2).collect()] if "is_sink" in drives.columns else []
    workers_import(kept.sparkSession)
    held = F.map_from_entries(F.collect_list(F.struct("drive", F.struct("n", "bytes"))))  # an entry for each drive
    groups = drive_sums(kept).groupBy("base_key").agg(held.alias("held"), F.sum("bytes").alias("bytes"))
    own = lambda field: F.array(*[F.coalesce(F.element_at("held", F.lit(d))[field], F.lit(0)).cast("long") for d in names])
    groups = groups.select("base_key", "bytes", own("n").alias("counts"), own("bytes").alias("sizes"))
    if order is not None:
        groups = groups.drop("bytes").join(order.select("base_key", "display", "bytes"), "base_key")
    else:
        groups = groups.withColumn("display", F.col("base_key"))
    groups = materialize(numbered(groups, in_order()).select("base_key", "pos", "counts", "sizes", F.floor(F.col("pos") / block).alias("block")), "groups")
    run = Run(groups, [f for _, f in free], reserve, names.index(sinks[0]) if sinks else None, listed)
    run.finish()
    if not run.kept:
        return kept.sparkSession.createDataFrame([], "base_key string, drive string, incoming long, round int, evacuated boolean")
    rows = groups.select("base_key", "pos").join(run.decided(), "pos").join(run.left().withColumn("left", F.lit(True)), "pos", "left")
    to = F.when(F.col("left"), F.lit(sinks[0] if sinks else None)).when(F.col("drive") >= 0, F.element_at(F.array(*map(F.lit, names)), F.col("drive") + 1))
    done = materialize(rows.select("base_key", to.alias("drive"), "incoming", "round", F.when(F.col("drive") >= 0, F.coalesce("left", F.lit(False))).alias("evacuated")), "placement")
    for x in run.runs.values():
        discard(x)
    return done
