"""Search by stored pieces against a scan, and pages by the last key seen against the whole order."""

import random

from pyspark.sql import functions as F

from cinelake.plans import index, search

SCHEMA = "base string, file string, dir string, size long, mtime timestamp"


def rows(spark, n=400):
    rng = random.Random(4)
    words = ["Gray", "Manor", "İstanbul", "ÉTÉ", "x", "a b", "100%", "under_score", "\U0001f600", "Film", "aaa"]
    made = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), f"{rng.choice(words)} {rng.randrange(30)}.mp4", f"/d{i % 7}", i, None) for i in range(n)]
    return spark.createDataFrame([*made, ("", "", "/e", 1, None), (None, "only file.mp4", "/e", 1, None), made[0]], SCHEMA)


def test_lookup_is_the_scan(spark, tmp_path):
    indexed = rows(spark)
    queries = spark.createDataFrame([(q,) for q in ["gray", "GRAY manor", "x", "é", "été", "%", "_s", "a b", "aa", "aaaa", "aaa a", "\U0001f600", "29.mp4", "nothing", "  film ", "", " ", "y" * 121, "ONLY", "gray", "ra ma"]], "query string")
    postings = search.build(indexed, f"{tmp_path}/pieces")
    found = search.lookup(postings, queries)
    key = lambda df: sorted(map(str, df.select("query", "base", "file", "dir", "size").collect()))
    assert key(found) == key(index.matching(indexed, queries.distinct())) and found.count() > 500
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert search.lookup(search.build(indexed.limit(0), f"{tmp_path}/none"), queries).count() == 0


def test_pages_by_key_are_the_order(spark):
    indexed = spark.createDataFrame([(f"{'b' if i % 3 else 'B'} {i % 131}", f"f{i}", "/d", i, None) for i in range(300)] + [("b 7", "x", "/d", 1, None)], SCHEMA)
    grouped = search.groups(index.matching(indexed, spark.createDataFrame([("b",), ("b 1",)], "query string"))).cache()
    want = {q: [r.base_key for r in grouped.where(F.col("query") == q).orderBy("sort_key", "base_key").collect()] for q in ("b", "b 1")}
    seen, page = {"b": [], "b 1": []}, search.next_page(grouped, size=20)
    for _ in range(8):
        got = page.orderBy("query", "place").collect()
        for r in got:
            assert r.place == len([x for x in got if x.query == r.query and x.place <= r.place])
            seen[r.query].append(r.base_key)
        last = search.last_seen(page)
        done = spark.createDataFrame([(q, natural[-1].sort_key, natural[-1].base_key) for q in seen for natural in [grouped.where((F.col("query") == q) & (F.col("base_key") == seen[q][-1])).collect()]], "query string, sort_key string, base_key string")
        page = search.next_page(grouped, done, size=20)
        assert last.count() <= 2
    assert seen == want and page.count() == 0


def test_pieces_are_stored_by_block(spark, tmp_path):
    """Names near each other have their pieces in common, so there are few pieces to a row, however many letters its name has."""
    indexed = spark.range(20_000).selectExpr("concat('A rather long title of film ', lpad(id % 900, 3, '0')) AS base", "concat('A rather long title of film ', lpad(id % 900, 3, '0'), '.mp4') AS file", "concat('/d', id) AS dir", "id AS size", "timestamp'2020-01-01' AS mtime")
    postings = search.build(indexed, f"{tmp_path}/pieces")
    asked = spark.createDataFrame([("film 7",), ("899",), ("a",), ("none",)], "query string")
    key = lambda df: sorted(map(str, df.select("query", "file", "dir").collect()))
    assert key(search.lookup(postings, asked)) == key(index.matching(indexed, asked))
    assert postings.pieces.count() < 2 * indexed.count()
