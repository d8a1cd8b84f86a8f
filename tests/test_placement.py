"""Placement, evacuation and balancing against loops over one group after the other."""

import random

import pytest

from cinelake.plans import consolidate
from cinelake.plans.placement import place


def serial(kept, drives, reserve):
    """One group after the other, as the rules say; every group may find a drive only after others have left it."""
    names = sorted(d for d, _, _ in drives)
    free, sink = {d: f for d, f, _ in drives}, next((d for d, _, s in drives if s), None)
    groups, homes, out = {}, [], {}
    for key, drive, size in kept:
        groups.setdefault(key, {}).setdefault(drive, []).append(size)
    total = {k: sum(map(sum, g.values())) for k, g in groups.items()}
    for key in sorted(groups, key=lambda k: (k, -total[k])):
        own = groups[key]
        ranked = sorted(names, key=lambda d: (-len(own.get(d, [])), -sum(own.get(d, [])), -free[d], d))
        found = None
        for make_room in (False, True) if sink else (False,):
            for k, d in enumerate(ranked):
                required = total[key] - sum(own.get(d, [])) + reserve
                if make_room and free[d] < required and d != sink:
                    need = required - free[d]
                    for h in sorted((h for h in homes if h["drive"] == d), key=lambda h: -h["bytes"]):
                        if need <= 0:
                            break
                        if free[sink] >= h["bytes"] + reserve:
                            h["drive"] = sink
                            free[d], free[sink], need = free[d] + h["bytes"], free[sink] - h["bytes"], need - h["bytes"]
                            out[h["key"]] = (sink, *out[h["key"]][1:3], True)
                if free[d] >= required:
                    found = d, k + 1 + make_room * len(names)
                    break
            if found:
                break
        if not found:
            out[key] = (None, None, None, None)
            continue
        d, rank = found
        incoming = total[key] - sum(own.get(d, []))
        free[d] -= incoming
        for e, sizes in own.items():
            free[e] += sum(sizes) if e != d else 0
        homes.append({"key": key, "drive": d, "bytes": total[key]})
        out[key] = (d, incoming, rank, False)
    return out


def case(seed):
    """Random groups over few drives with little room, with and without a sink."""
    rng = random.Random(seed)
    names = [f"/v{i}" for i in range(rng.choice([2, 3, 5]))]
    kept = [(f"g{k:03}", rng.choice(names), rng.choice([1, 5, 10, rng.randrange(1, 80)])) for k in range(60) for _ in range(rng.randrange(1, 5))]
    drives = [(d, rng.randrange(20, [60, 400, 3000][seed % 3]), bool(i == 0 and seed % 2 == 0)) for i, d in enumerate(names)]
    return kept, drives, rng.choice([0, 7])


@pytest.mark.parametrize("seed", range(4))
def test_placement_is_the_serial_loop(spark, seed):
    """In blocks and lists of any size."""
    kept, drives, reserve = case(seed)
    want = serial(kept, drives, reserve)
    given = spark.createDataFrame(kept, "base_key string, drive string, size long"), spark.createDataFrame(drives, "drive string, free_bytes long, is_sink boolean")
    for block, listed in (((7, 2), (100, 1000)), ((9, 1000),), ((20, 1),), ((13, 2),))[seed]:
        got = {r[0]: tuple(r)[1:] for r in place(*given, reserve, block=block, listed=listed).collect()}
        assert got == want


def test_the_cases_hold_all_outcomes():
    found = [w for seed in range(4) for w in serial(*case(seed)).values()]
    assert any(w[3] for w in found) and any(w[0] is None for w in found)


def leaves(groups, need, room):
    """[(drive, key, fits)] of (key, drive, bytes): what is looked at, drive by drive, largest first."""
    out = []
    for d in sorted(need):
        for key, _, size in sorted((g for g in groups if g[1] == d), key=lambda g: (-g[2], g[0])):
            if need[d] <= 0:
                break
            out.append((d, key, size <= room))
            if size <= room:
                need[d], room = need[d] - size, room - size
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_evacuation_skips_what_the_sink_cannot_hold(spark, seed):
    rng = random.Random(seed)
    groups = [(f"g{i}", rng.choice(["/a", "/b", "/c"]), rng.choice([0, 1, 3, 3, 50, rng.randrange(200)])) for i in range(80)]
    need, room = {"/a": rng.randrange(900), "/b": 0, "/c": rng.randrange(300)}, rng.randrange(700)
    got = consolidate.evacuation(spark.createDataFrame(groups, "base_key string, drive string, bytes long"), spark.createDataFrame(list(need.items()), "drive string, need_bytes long"), room=room)
    assert sorted((r["drive"], r["base_key"], r["fits"]) for r in got.collect()) == leaves(groups, need, room)


def test_a_refused_group_frees_nothing(spark):
    """/a holds 100 and 50 and needs 50, the sink has 55: the 50 moves, and a new group finds its room; balancing with 60 likewise."""
    kept = spark.createDataFrame([("a", "/a", 100), ("b", "/a", 50), ("c", "/a", 10), ("c", "/b", 5), ("c", "/b", 45)], "base_key string, drive string, size long")
    drives = spark.createDataFrame([("/a", 0, False), ("/b", 9, False), ("/s", 55, True)], "drive string, free_bytes long, is_sink boolean")
    got = {r[0]: (r[1], r[4]) for r in place(kept, drives).collect()}
    assert got == {"a": ("/a", False), "b": ("/s", True), "c": ("/a", False)}
    groups = spark.createDataFrame([("x", "/a", 100), ("y", "/a", 50)], "base_key string, drive string, bytes long")
    plan = consolidate.balance_plan(groups, drives.replace(55, 60, ["free_bytes"]), target_free=50)
    assert sorted((r["base_key"], r["fits"]) for r in plan.collect()) == [("x", False), ("y", True)]


def test_fresh_groups_stay(spark):
    groups = spark.createDataFrame([("x", "/a", 100), ("y", "/a", 50)], "base_key string, drive string, bytes long")
    drives = spark.createDataFrame([("/a", 0, False), ("/s", 10**6, True)], "drive string, free_bytes long, is_sink boolean")
    plan = consolidate.balance_plan(groups, drives, target_free=10**9, fresh=groups.where("base_key = 'x'"))
    assert [(r["base_key"], r["fits"]) for r in plan.collect()] == [("y", True)]


def test_no_groups(spark):
    assert place(spark.createDataFrame([], "base_key string, drive string, size long"), spark.createDataFrame([("/a", 1)], "drive string, free_bytes long")).count() == 0
