import datetime
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cinelake.functions import core, formats
from cinelake.functions import normalize as norm
from cinelake.functions import titles
from cinelake.oracles import ORACLES
from cinelake.plans import consolidate, index, ingest, names, reports
from cinelake.queries import QUERIES, snapshot
from cinelake.sources import derive, files
from cinelake.sources.derive import derived


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


CASES = {
    "some.movie.scene.01.jane.roe": "Some Movie - Scene_1 - Jane Roe",
    "Title_scene_2JaneRoe and Ann Poe": "Title - Scene_2 - JaneRoe, Ann Poe",
    "ghost vs witch disc 1": "Ghost vs. Witch - CD1",
    "Vol.4 of the tales": "# 04 of the Tales",
    "Movie 7 (Studio)": "Movie # 07 (Studio)",
    "Crime Scene 1999": "Crime Scene 1999",
    "Title 3 - Scene_1 - with jane": "Title # 03 - Scene_1 - With Jane",
    "the lord of the mills 1080p.x264-GRP": "The Lord of the Mills",
    "": "",
}


def test_normalize(spark):
    assert values(spark, [(k,) for k in CASES], "r string", norm.normalize(F.col("r"))) == list(CASES.values())


def test_normalize_is_a_fixed_point(spark, sf):
    rows = derived(spark, sf, "raw_files").select(norm.normalize(F.col("file_name")).alias("x"))
    assert rows.where(norm.normalize(F.col("x")) != F.col("x")).count() == 0
    assert values(spark, [(v,) for v in CASES.values()], "r string", norm.normalize(F.col("r"))) == list(CASES.values())


def test_restore_names(spark):
    vocabulary = spark.createDataFrame([("Jane Roe",), ("Ann Poe",), ("Vanity",), ("An Na",), ("Ann A",)], "name string")
    rows = spark.createDataFrame([(1, "T - Scene_1 - JaneRoe"), (2, "T - Scene_1 - Jane Roe Ann Poe"), (3, "T - Scene_2vanity"), (4, "T - Scene_1 - Jane Roe"), (5, "Plain"), (6, "T - Scene_3janeroe")], "id int, title string")
    got = {r["id"]: r["title"] for r in names.restore_names(rows, vocabulary).collect()}
    assert got == {1: "T - Scene_1 - Jane Roe", 2: "T - Scene_1 - Jane Roe, Ann Poe", 3: "T - Scene_2 - Vanity", 4: "T - Scene_1 - Jane Roe", 5: "Plain", 6: "T - Scene_3 - Jane Roe"}


def test_episode(spark):
    raw = ["A # 02 (Studio) - Scene_1", "A #3 B", "A # 3 secrets", "A - CD 2", "A"]
    got = values(spark, [(x,) for x in raw], "r string", titles.parse_episode(F.col("r")))
    assert [(g.base, g.ep, g.variant) for g in got] == [("A (Studio)", 2, "- Scene_1"), ("A #3 B", None, ""), ("A # 3 secrets", None, ""), ("A", None, "- CD 2"), ("A", None, "")]


def test_formats(spark):
    assert values(spark, [(0,), (1000,), (1_500_000_000,), (None,)], "n long", formats.byte_size(F.col("n"))) == ["0 Bytes", "1.00\xa0KB", "1.50\xa0GB", "Invalid Size"]
    assert values(spark, [(0.0,), (61.0,), (3661.0,), (None,)], "n double", formats.duration(F.col("n"))) == ["00:00:00", "01:01", "1:01:01", "N/A"]


def test_lookalikes_and_tidy(spark):
    assert values(spark, [("Аria Lee",), ("СОСО Lopez",), ("Мария",), (" - x1 ",), ("12",)], "n string", names.clean_name(F.col("n"))) == ["Aria Lee", "COCO Lopez", "Мария", "x1", None]
    got = values(spark, [("jane roe ann poe; max, li wu and bo",)], "n string", names.tidy_list(F.col("n"), F.array(F.lit("jane roe"))))
    assert got == [["jane roe", "ann poe", "max", "li wu", "bo"]]


def test_plan_invariants(spark, sf):
    drives = derived(spark, sf, "drives")
    eps = consolidate.best_copies(consolidate.episodes(derived(spark, sf, "media_files"))).cache()
    assert eps.where("keep").count() == eps.select("base_key", "item_key").distinct().count()
    best = eps.where("keep").select("base_key", "item_key", F.col("size").alias("best"))
    assert eps.join(best, ["base_key", "item_key"]).where("size > best").count() == 0
    at = consolidate.place(eps.where("keep"), drives, reserve=1000).select("base_key", F.col("drive").alias("target"))
    rows = eps.where("keep").join(at, "base_key").select("drive", F.coalesce("target", "drive").alias("target"), "size")
    before, after = rows.groupBy("drive").agg(F.sum("size").alias("b")), rows.groupBy(F.col("target").alias("drive")).agg(F.sum("size").alias("a"))
    room = drives.join(before, "drive", "left").join(after, "drive", "left").withColumn("left", F.col("free_bytes") + F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0)))
    assert room.where("left < least(1000, free_bytes)").count() == 0  # no drive is over-committed, with what came and what left


def test_free_names(spark):
    plan = spark.createDataFrame([("a/x.mp4", "t", "x.mp4"), ("b/X.mp4", "t", "X.mp4"), ("c/y.mp4", "t", "y.mp4")], "path string, target_dir string, file string")
    there = spark.createDataFrame([("t", "y.mp4")], "dir string, file string")
    got = {r["path"]: r["free_name"] for r in consolidate.free_names(plan, there, "S").collect()}
    assert got == {"a/x.mp4": "x.mp4", "b/X.mp4": "X__S.mp4", "c/y.mp4": "y__S.mp4"}


def test_page_past_the_end(spark):
    rows = spark.createDataFrame([(f"b{i}", f"b{i}.mp4", "/d", 1, None) for i in range(120)], "base string, file string, dir string, size int, mtime timestamp")
    asked = spark.createDataFrame([("B",)], "query string")
    assert [index.search(rows, asked, page=p).count() for p in range(4)] == [50, 50, 20, 0]


def oracle(sf):
    c = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_against_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = oracle(sf).execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) z").fetchall()
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(tuple(r) for r in got.select(columns).collect()) == key(want)


def test_normalize_all_names(spark, sf):
    rows = QUERIES["normalize_all"](spark, sf).collect()
    assert len(rows) == derived(spark, sf, "raw_files").count()
    form = re.compile(r"(.+)\.brand#(\d+)\.scene\.(\d+)\.([A-Za-z]+)(\.1080p\.x264-GRP)?\.mp4")
    for r in rows:
        words, brand, scene, name, _ = form.fullmatch(r["file_name"]).groups()
        assert r["title"] == f"{' '.join(w.capitalize() for w in words.split('.'))} Brand# {brand.zfill(2)} - Scene_{scene} - {name}"
    assert any("1080p" in r["file_name"] for r in rows)


def test_bursts_and_heartbeats_of_all_events(spark, sf):
    events = sorted((r["event_type"], r["ts"]) for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    gap, shown, bursts = datetime.timedelta(minutes=10), "%Y-%m-%d %H:%M:%S", []
    for kind, ts in events:
        if bursts and bursts[-1][0] == kind and ts < bursts[-1][2] + gap:
            bursts[-1][2:] = ts, bursts[-1][3] + 1
        else:
            bursts.append([kind, ts, ts, 1])
    want = [(k, a.strftime(shown), b.strftime(shown), (b + gap).strftime(shown), n) for k, a, b, n in bursts]
    assert sorted(map(tuple, QUERIES["debounce_all"](spark, sf).collect())) == sorted(want)
    last, now = dict(events), max(ts for _, ts in events)
    late = {k: int(now.timestamp()) - int(ts.timestamp()) > 300 for k, ts in last.items()}
    assert sorted(map(tuple, QUERIES["stale_all"](spark, sf).collect())) == sorted((k, ts.strftime(shown), late[k]) for k, ts in last.items())


def test_placement_tries_every_drive(spark):
    kept = spark.createDataFrame([("g", f"/v{i}", 100 - i) for i in range(12)], "base_key string, drive string, size long")
    drives = spark.createDataFrame([(f"/v{i}", 10**6 if i == 11 else 0) for i in range(12)], "drive string, free_bytes long")
    assert [(r["drive"], r["round"]) for r in consolidate.place(kept, drives).collect()] == [("/v11", 12)]


def test_long_configured_lists_are_errors(spark):
    drives = spark.range(65).selectExpr("concat('/v', id) AS drive", "1L AS free_bytes", "1L AS need_bytes")
    kept = spark.createDataFrame([("g", "/v1", 1, 1)], "base_key string, drive string, size long, bytes long")
    for f in (lambda: consolidate.drive_ranks(kept, drives), lambda: consolidate.evacuation(kept, drives), lambda: files.distinct_roots(spark.range(1001).selectExpr("concat('/r', id) AS root", "id AS pos"))):
        with pytest.raises(ValueError):
            f()


def test_mined(spark):
    rows = [("Jane.Roe.And.Ann.Poe.1080p", "/a", "Jane Roe and Ann Poe"), ("The.Jane.Roe.And.Ann.Poe.Bts", "/b", "x"), ("Li.Wu.And.Bo.Ek.x264", "/a", "x"), ("t.scene.1.maxray", "/a", "T - Scene_1 - Max Ray"), ("t.scene.1.maxray", "/c", "T - Scene_1 - Max Ray"), ("t.scene.2.x", "/Tom and Jerry", "T - Scene_2 - No One")]
    got = names.mined(spark.createDataFrame(rows, "stem string, dir string, title string"), spark.createDataFrame([("Li Wu Movies",), (".Hid Den",)], "folder string"), excluded=("Tom and Jerry",)).collect()
    assert sorted((r["name"], r["source"], r["sightings"]) for r in got) == [("Ann Poe", "dotted", 2), ("Jane Roe", "dotted", 2), ("Li Wu", "performer_folders", 2), ("Max Ray", "scene_tails", 2)]


def test_harvest_counts_files(spark, sf):
    own = [r["name"] for r in derived(spark, sf, "names").collect()]
    tails = Counter(re.search(r"\.scene\.\d+\.([A-Za-z]+)", r["file_name"])[1].lower() for r in derived(spark, sf, "raw_files").collect())
    squash = Counter(n.replace(" ", "").lower() for n in own)
    got = {r["name"]: r["sightings"] for r in QUERIES["harvest_names"](spark, sf).collect()}
    once = [n for n in own if squash[n.replace(" ", "").lower()] == 1]
    assert once and all(got[n] == 1 + tails[n.replace(" ", "").lower()] for n in once)


def test_placement_takes_a_drive_that_holds_nothing(spark):
    kept = spark.createDataFrame([("g", "/a", 100), ("g", "/c", 100)], "base_key string, drive string, size long")
    drives = spark.createDataFrame([("/a", 10), ("/b", 1_000_000), ("/c", 10)], "drive string, free_bytes long")
    assert [(r["drive"], r["incoming"], r["round"]) for r in consolidate.place(kept, drives).collect()] == [("/b", 200, 3)]


def test_placement_makes_room(spark):
    """/a is full and so is every other drive but the sink, which is too small for the group: an earlier group leaves /a for the sink."""
    kept = spark.createDataFrame([("a old", "/a", 60), ("b new", "/a", 100), ("b new", "/c", 50)], "base_key string, drive string, size long")
    drives = spark.createDataFrame([("/a", 10, False), ("/c", 0, False), ("/s", 70, True)], "drive string, free_bytes long, is_sink boolean")
    got = {r["base_key"]: (r["drive"], r["evacuated"]) for r in consolidate.place(kept, drives).collect()}
    assert got == {"a old": ("/s", True), "b new": ("/a", False)}
    tight = drives.withColumn("free_bytes", F.when(F.col("is_sink"), 59).otherwise(F.col("free_bytes")))
    assert {r["base_key"]: r["drive"] for r in consolidate.place(kept, tight).collect()} == {"a old": "/a", "b new": None}


def test_free_names_never_land_on_a_name(spark):
    plan = spark.createDataFrame([("a/X.mp4", "t", "X.mp4"), ("b/y.mp4", "t", "y.mp4"), ("c/y.mp4", "t", "y.mp4"), ("d/y__S.mp4", "t", "y__S.mp4"), ("e/n", "t", "n")], "path string, target_dir string, file string")
    there = spark.createDataFrame([("t", "X.mp4"), ("t", "x__s.MP4"), ("t", "n")], "dir string, file string")
    got = {r["path"]: r["free_name"] for r in consolidate.free_names(plan, there, "S").collect()}
    assert got == {"a/X.mp4": "X__S_2.mp4", "b/y.mp4": "y.mp4", "c/y.mp4": "y__S_2.mp4", "d/y__S.mp4": "y__S.mp4", "e/n": "n__S"}
    crowded = spark.createDataFrame([(f"{i:03}", "t", "z.mp4") for i in range(53)], "path string, target_dir string, file string")
    rows = consolidate.free_names(crowded, there, "S").collect()
    assert [r["path"] for r in rows if r["problem"]] == ["051", "052"] or sorted(r["path"] for r in rows if r["problem"]) == ["051", "052"]


def test_collision_classes_by_time(spark):
    moves = spark.createDataFrame([("p1", "/b", "A.mp4", 5, 100), ("p2", "/b", "b.mp4", 5, 100), ("p3", "/b", "c.mp4", 5, 100), ("p4", "/b", "d.mp4", 5, 100)], "path string, target string, file string, size int, t long").withColumn("mtime", F.timestamp_seconds("t"))
    there = spark.createDataFrame([("/b", "a.mp4", 5, 102), ("/b", "b.mp4", 5, 103), ("/b", "c.mp4", 6, 100), ("/b", "a.mp4", 9, 1)], "drive string, file string, size int, t long").withColumn("mtime", F.timestamp_seconds("t"))
    assert sorted((r["path"], r["class"]) for r in consolidate.collisions(moves, there).collect()) == [("p1", "duplicate"), ("p2", "suspect"), ("p3", "suspect")]


def test_restored_names_keep_to_their_rows(spark):
    rows = spark.createDataFrame([(1, "T - Scene_1 - JaneRoe", "k", "f"), (1, "T - Scene_1 - AnnPoe", "k2", "f2")], "id int, title string, key string, fixed string")
    vocabulary = spark.createDataFrame([("Jane Roe",), ("Ann Poe",)], "name string")
    assert sorted(map(tuple, names.restore_names(rows, vocabulary).collect())) == [(1, "T - Scene_1 - Ann Poe", "k2", "f2"), (1, "T - Scene_1 - Jane Roe", "k", "f")]


def test_nested_roots_list_a_file_once(spark):
    listing = spark.createDataFrame([("/v/a", "/v/a/x.mp4", "x", "mp4", 1, None), ("/w", "/w/y.mp4", "y", "mp4", 2, None)], "dir string, path string, stem string, ext string, size int, mtime timestamp")
    roots = spark.createDataFrame([("/v", True), ("/v/a", True), ("/v", True), ("/w", True), ("/gone", False)], "root string, present boolean")
    previous = spark.createDataFrame([("z", "z.mp4", "/gone/z", 3, None)], "base string, file string, dir string, size int, mtime timestamp")
    assert sorted((r["file"], r["carried"]) for r in index.build_index(listing, previous, roots).collect()) == [("x.mp4", False), ("y.mp4", False), ("z.mp4", True)]
    assert [r["root"] for r in files.distinct_roots(spark.createDataFrame([("/a/b", 1), ("/a", 2), ("/a", 3), ("/ab", 4)], "root string, pos int")).collect()] == ["/a", "/ab"]
    assert [r["root"] for r in index.unmounted(roots, roots.where("present")).collect()] == ["/gone"]


def test_log_round_trip(spark, tmp_path):
    row = ("2024", "EXEC", "a\tb", "MOVE", "x\ny", "", "5", "OK", "c\rd")
    log = spark.createDataFrame([row, ("2025", *row[1:])], ", ".join(f"`{c}` string" for c in files.LOG_COLUMNS)).repartition(2)
    files.write_log(log, f"{tmp_path}/log")
    lines = [x for p in sorted(tmp_path.glob("log/part-*")) for x in p.read_text().splitlines()]
    assert lines[0] == "\t".join(files.LOG_COLUMNS) and len(lines) == 3 and sum(x.startswith("ts\t") for x in lines) == 1
    assert "a\\tb" in lines[1] and "x\\ny" in lines[1] and "a\\\\tb" not in lines[1]
    assert sorted(r["ts"] for r in files.read_log(spark, f"{tmp_path}/log").collect()) == ["2024", "2025"]


def test_sources(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.mp4").write_bytes(b"12345")
    (tmp_path / "d" / "e" / "b.mp4").write_bytes(b"1")
    got = {r["file"]: (r["size"], r["dir"]) for r in files.listing(spark, f"{tmp_path}/d").collect()}
    assert got == {"a.mp4": (5, f"{tmp_path}/d"), "b.mp4": (1, f"{tmp_path}/d/e")}
    assert [r["file"] for r in files.listing(spark, f"{tmp_path}/d", recursive=False).collect()] == ["a.mp4"]
    (tmp_path / "n.json").write_text('["Ann Poe", null, "Bo Ek"]')
    (tmp_path / "broken.json").write_text('{"entries": [')
    (tmp_path / "i.json").write_text('{"builtAt": "x", "entries": [{"base": "b", "file": "f.mp4", "dir": "/d", "size": 3, "mtime": 9}]}')
    assert [r["name"] for r in files.json_names(spark, f"{tmp_path}/n.json").collect()] == ["Ann Poe", "Bo Ek"]
    assert files.json_names(spark, f"{tmp_path}/broken.json").count() == 0 and files.json_index(spark, f"{tmp_path}/broken.json").count() == 0
    assert [tuple(r) for r in files.json_index(spark, f"{tmp_path}/i.json").collect()] == [("b", "f.mp4", "/d", 3, 9)]
    assert spark.read.parquet(files.write_snapshot(spark.range(3), f"{tmp_path}/s", "1")).count() == 3
    for again in (lambda: files.write_snapshot(spark.range(1), f"{tmp_path}/s", "1"), lambda: files.write_snapshot(spark.range(1), f"{tmp_path}/s", "2", unreadable_roots=1)):
        with pytest.raises(Exception):
            again()


def test_small_forms(spark):
    one = lambda value, kind, column: values(spark, [(value,)], f"x {kind}", column)[0]
    x = F.col("x")
    assert [one(v, "double", formats.spoken_duration(x)) for v in (161.0, 5.0, 3605.0)] == ["2m 41s", "5s", "1h 0m 5s"]
    assert one(1536, "long", formats.byte_size(x, 1024)) == "1.50 KB"
    day = datetime.datetime(2024, 5, 6, 7, 8)
    assert [one(v, "timestamp", formats.shown_date(x, F.lit(d))) for v, d in ((day, True), (day, False), (None, True))] == ["2024-05-06", "", ""]
    assert [one(v, "string", core.plain_file_name(x)) for v in ("a.mp4", "a/b", "..", "", "a\\b")] == [True, False, False, False, False]
    assert [tuple(one(v, "int", index.page_range(x, F.lit(p)))) for v, p in ((120, 2), (0, 0), (50, 0))] == [(3, 101, 120), (1, 0, 0), (1, 1, 50)]
    assert [one("McCoy meets the iPod", "string", norm.title_case(x, keep)) for keep in (True, False)] == ["McCoy Meets The iPod", "McCoy Meets the iPod"]
    asked = spark.createDataFrame([("",), ("  ",), ("a" * 120,), ("a" * 121,), (" B ",)], "query string")
    assert sorted(r["q"] for r in index.valid_queries(asked).collect()) == ["a" * 120, "b"]


def test_only_some_groups(spark):
    eps = spark.createDataFrame([(f"Movie {i}", f"movie {i}", f"/p{i}", i) for i in (10, 2, 1)] + [("Other", "other", "/o", 5)], "base string, base_key string, path string, size int")
    assert sorted(r["base_key"] for r in consolidate.only(eps, "MOVIE", 2).collect()) == ["movie 1", "movie 2"]
    assert [r["base_key"] for r in consolidate.group_order(eps).collect()] == ["movie 1", "movie 2", "movie 10", "other"]


def test_run_summary_counts_what_to_review(spark):
    log = spark.createDataFrame([("MOVE", 5, "OK"), ("EVAC_MOVE", 6, "OK"), ("EVAC_DUP", 1, "OK"), ("RENAME_01_SKIP", 0, "SKIP"), ("GROUP_SKIP", 0, "SKIP"), ("MOVE", 9, "FAIL")], "action string, bytes long, status string")
    r = reports.run_summary(log).first()
    assert (r["moved"], r["moved_bytes"], r["duped"], r["skipped"], r["flagged"], r["failed"]) == (2, 11, 1, 1, 1, 1)
    assert r["line"] == "2 files moved (11.00\xa0Bytes), 1 duplicate shelved, 1 skipped, 1 failure, 1 to review"


def test_typed_segment(spark):
    vocabulary = spark.createDataFrame([("Angel Long",), ("Aurora Snow",), ("Aurora Snow Pack",), ("Andi Rose",), ("Vanity",)], "name string")
    cases = {"Angel Long, Ja": ("Ja", False), "Angel Long Ja": ("Ja", True), "Angel Long": ("Angel Long", False), "Aurora Snow Pac": ("Aurora Snow Pac", False), "Angel Long, And": ("And", False), "Angel Long and Ro": ("Ro", False), "No One Ja": ("No One Ja", False), "Angel Long Aurora Snow x": ("x", True), "ja": ("ja", False), "Angel Long, ": ("", False)}
    got = {r["partial"]: (r["typed"], r["glued"]) for r in names.typed_segment(spark.createDataFrame([(c,) for c in cases], "partial string"), vocabulary).collect()}
    assert got == cases
    assert names.most_words(vocabulary).first()[0] == 3


def test_typed_segments_of_all_names(spark, sf):
    rows = QUERIES["typed_segment"](spark, sf).collect()
    own = {r["name"].lower() for r in derived(spark, sf, "names").collect()}
    for r in rows:
        words = r["partial"].split(" ")
        glued = "," not in r["partial"] and " ".join(words[:2]).lower() in own and not any(n.startswith(" ".join(words[:3]).lower()) for n in own)
        assert (r["typed"], r["glued"]) == ((" ".join(words[2:]), True) if glued else (r["partial"].split(", ")[1], False) if "," in r["partial"] else (r["partial"], False))
    assert any(r["glued"] for r in rows)


def test_videos_that_cannot_be_probed_are_left_out(spark):
    found = spark.createDataFrame([("/a.mp4", "a", "mp4"), ("/b.MKV", "b", "MKV"), ("/c.txt", "c", "txt"), ("/d.mkv", "d", "mkv")], "path string, stem string, ext string")
    raw = spark.createDataFrame([("/a.mp4", '{"streams":[{"width":4,"height":3}],"format":{"duration":"7.9"}}'), ("/b.MKV", "no json"), ("/d.mkv", '{"streams":[]}')], "path string, raw string")
    got = {r.path: (r.dimensions, r.duration) for r in ingest.with_probes(found, ingest.parse_probe(raw)).collect()}
    assert got == {"/a.mp4": ("4 x 3", 7), "/c.txt": ("", 0), "/d.mkv": ("", 0)}


def test_a_probe_that_tells_nothing_is_no_failure(spark):
    raw = spark.createDataFrame([("/a", "{}"), ("/b", "{\n\n}"), ("/c", "null"), ("/d", ""), ("/e", None), ("/f", "{"), ("/g", '{"format":{}}'), ("/h", "[]")], "path string, raw string")
    assert sorted((r.path, r.dimensions, r.duration) for r in ingest.parse_probe(raw).collect()) == [(p, "", 0) for p in ("/a", "/b", "/g", "/h")]


def test_best_copies_by_hand(spark):
    """The largest, then the newest, then the first path; unknown times last. A group of many files has one of each item."""
    rows = [("/z", "A # 01", 5, None), ("/y", "A # 01", 5, "2020-01-01"), ("/x", "A # 01", 5, "2021-01-01"), ("/w", "A # 01", 5, "2021-01-01"), ("/v", "A", 9, "2019-01-01"), *[(f"/m{i}", f"A # {2 + i % 7:02}", i, "2020-01-01") for i in range(200)]]
    files = spark.createDataFrame([(f"{d}/f.mp4", d, stem, "mp4", size, t) for d, stem, size, t in rows], "path string, drive string, stem string, ext string, size long, t string").withColumn("mtime", F.to_timestamp("t"))
    got = consolidate.best_copies(consolidate.episodes(files))
    assert got.count() == len(rows)
    assert sorted(r.path for r in got.where("keep").collect()) == sorted(["/v/f.mp4", *[f"/m{i}/f.mp4" for i in range(193, 200)]])
    assert [r.new_name for r in got.where("rename_01").collect()] == ["A # 01.mp4"]
    without = consolidate.best_copies(consolidate.episodes(files.where("drive <> '/v'"))).where("keep AND ep = 1").collect()
    assert [r.path for r in without] == ["/w/f.mp4"]


def test_worklist_has_a_row_for_each_file(spark):
    rows = spark.createDataFrame([("A - Scene_1", "/1"), ("a # 02 - Scene_2", "/2"), ("B", "/3")], "stem string, path string")
    assert sorted((r.key, r.path) for r in names.worklist_files(rows).collect()) == [("a", "/1"), ("a", "/2")]
    assert [(r.key, r.n_files) for r in names.name_worklist(rows).collect()] == [("a", 2)]


def test_free_names_of_very_many_files(spark):
    """Only as many as there are names get one, the first paths, however many ask."""
    plan = spark.range(400).selectExpr("concat('p', lpad(id, 3, '0')) AS path", "'t' AS target_dir", "'x.mp4' AS file")
    none = spark.createDataFrame([], "dir string, file string")
    got = sorted((r.path, r.free_name) for r in consolidate.free_names(plan, none, "S").collect() if r.free_name)
    assert [p for p, _ in got] == [f"p{i:03}" for i in range(51)] and [n for _, n in got][:3] == ["x.mp4", "x__S.mp4", "x__S_2.mp4"]


def freed(plan, there, stamp, most):
    """free_names, one file after the other."""
    tails = ["", f"__{stamp}", *[f"__{stamp}_{i}" for i in range(2, most + 1)]]
    held, asked, out = {(d, f.lower()) for d, f in there}, {(d, f.lower()) for _, d, f in plan}, {}
    for path, d, f in sorted(plan):
        stem, dot, end = f.rpartition(".") if "." in f else (f, "", "")
        own = [f"{stem}{t}{dot}{end}" for t in tails]
        used = {x.lower() for (_, e, g), x in out.items() if x and e == d and g.lower() == f.lower()}
        out[path, d, f] = next((x for i, x in enumerate(own) if x.lower() not in used and (d, x.lower()) not in (held | asked if i else held)), None)
    return out


@pytest.mark.parametrize("many", [10_000, 2])
def test_free_names_on_random_names(spark, monkeypatch, many):
    """Stamps with dots, names that are stamped already, names without extension; files of a name in one task and in shares of it."""
    monkeypatch.setattr(consolidate, "MANY", many)
    rng = random.Random(many)
    for stamp in ("S", "1.b", "S_2"):
        parts = ["x", "X", f"x__{stamp}", f"X__{stamp}_2", f"x__{stamp.lower()}_02", f"x__{stamp}_3", "y.z", f"__{stamp}", f"x__{stamp}__{stamp}"]
        given = [n + e for n in parts for e in ("", ".mp4", ".MP4", ".b", ".")]
        plan = [(f"/p{i:04}", rng.choice("tu"), rng.choice(given)) for i in range(400)]
        there = [(rng.choice("tu"), rng.choice(given)) for _ in range(25)]
        found = consolidate.free_names(spark.createDataFrame(plan, "path string, target_dir string, file string"), spark.createDataFrame(there, "dir string, file string"), stamp, 4)
        rows = found.collect()
        assert {(r.path, r.target_dir, r.file): r.free_name for r in rows} == freed(plan, there, stamp, 4) and len(rows) == len(plan)
        assert all((r.problem == "no_free_name") == (r.free_name is None) for r in rows) and any(r.problem for r in rows)
        assert "posexplode" not in found._jdf.queryExecution().toString()  # the names tried aren't rows


def test_media_files_on_odd_rows(spark):
    """As the SQL has them, with nulls, repeated part keys and texts that end as a file's own name can, but without a shuffle of texts of the order lines."""
    rng = random.Random(5)
    some = lambda f: None if rng.random() < 0.07 else f()
    ends = ["a", "a # 01", "a # 01 - CD1", "b - Scene_2", "b", "c # 0-3", "a # 02 # 01", " # 01", "", "é - CD12"]
    part = [(rng.randrange(1, 25), some(lambda: rng.choice(["x", "y # 01"])), some(lambda: rng.choice("tu")), some(lambda: rng.choice(ends))) for _ in range(60)]
    line = [(some(lambda: rng.randrange(-60, 400)), some(lambda: rng.randrange(1, 25)), some(lambda: rng.randrange(-9, 9)), some(lambda: rng.choice([1, 2, 3, -5, 0, 2_000_000_000])), some(lambda: float(rng.randrange(-3, 9))), some(lambda: rng.random() * 99 - 20), some(lambda: rng.choice("ARN"))) for _ in range(5000)]
    part = spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_brand string")
    line = spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string").withColumn("l_shipdate", F.expr("timestamp_micros(pmod(xxhash64(l_orderkey, l_extendedprice), 1000000000))"))
    sql = derive.MEDIA_FILES.replace("VARCHAR(9)", "STRING").replace("FROM lineitem", "FROM {line} lineitem").replace("JOIN part ", "JOIN {part} part ")
    want, got = spark.sql(sql, line=line, part=part), derive.media_files(line, part)
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 2000
    assert not re.search(r"Exchange hashpartitioning\([^\n]*\b(drive|dir|stem|ext)#", got._jdf.queryExecution().toString())


def test_a_snapshot_reads_its_files_once(spark, sf):
    read = snapshot(spark, sf).inputFiles()
    assert read and not [f for f in read if "lineitem" in f]
