"""The stored library, titles without regard to accents, and the line about a run."""

import glob

import pytest
from pyspark.sql import functions as F

from cinelake.functions import formats
from cinelake.functions.core import natural_order
from cinelake.plans import library, stored
from cinelake.sources.publish import read_pointer

SCHEMA = "id long, title string, dimensions string, duration double, filesize long"


def test_an_edit_rewrites_only_its_buckets(spark, tmp_path, monkeypatch):
    store = f"{tmp_path}/lib"
    rows = [(i, f"Title {i}", "1 x 1", 1.0, i) for i in range(200)]
    stored.create(spark.createDataFrame(rows, SCHEMA), store, buckets=16)

    def files():
        return {f: sorted(glob.glob(f"{store}/{f}/*.parquet")) for f in read_pointer(spark, store).split("\n")[1:]}

    before = files()
    edits = spark.createDataFrame([(7, "title", "Seven", 1), (7, "title", "Old", 0), (8, "owner", "x", 1), (900, "title", "none", 1)], "id long, field string, value string, seq int")
    touched, unknown = stored.change(spark, store, edits, spark.createDataFrame([(9,), (901,)], "id long"))
    after = files()
    assert 1 <= len(touched) <= 5 and sum(f in before for f in after) == 16 - len(touched)
    assert all(before[f] == files for f, files in after.items() if f in before)
    assert sorted(r[0] for r in unknown.collect()) == [900, 901]
    want = {i: ("Seven" if i == 7 else t) for i, t, *_ in rows if i != 9}
    assert {r.id: r.title for r in stored.read(spark, store).collect()} == want
    monkeypatch.setattr(stored, "swap_pointer", lambda *a: (_ for _ in ()).throw(OSError("broken")))
    with pytest.raises(OSError):
        stored.change(spark, store, deletes=spark.createDataFrame([(1,)], "id long"))
    assert {r.id: r.title for r in stored.read(spark, store).collect()} == want
    monkeypatch.undo()
    stored.change(spark, store, deletes=spark.range(300))  # every row
    assert stored.read(spark, store).count() == 0
    assert stored.change(spark, store, deletes=spark.createDataFrame([(None,)], "id long"))[0] == []
    stored.create(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", buckets=4)
    assert stored.read(spark, f"{tmp_path}/none").columns == ["id", "title", "dimensions", "duration", "filesize"]


def test_accents(spark):
    titles = ["Été 2", "ete 10", "ETE 2", "Zebra", "apple", "Élan", "elan", "Übermut 3"]
    shown = [r.title for r in spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, i int").orderBy(natural_order(F.col("title")), "i").collect()]
    assert shown == ["apple", "Élan", "elan", "Été 2", "ETE 2", "ete 10", "Übermut 3", "Zebra"]
    known = spark.createDataFrame([(5, "Élan"), (3, "ELAN"), (4, "Zebra")], "id int, title string")
    asked = spark.createDataFrame([("elan ",), ("zébra",), ("zebras",), (None,)], "title string")
    assert {r.title: r.id for r in library.find_titles(asked, known).collect()} == {"elan ": 3, "zébra": 4, "zebras": None, None: None}


def test_last_run(spark):
    none = {"dry_run": None, "finished": None, "seconds": None, "moved": None, "bytes": None, "duped": None, "failed": None, "renamed": None, "skipped": None, "flagged": None, "index_rebuilt": None}
    cases = [
        ({}, "Run finished unknown — 0 moved (0 Bytes), 0 duplicates, 0 failed"),
        ({"dry_run": True, "finished": "May 4", "seconds": 3725, "moved": 3, "bytes": 1500, "duped": 1}, "Dry run finished May 4 (took 1h 2m 5s) — 3 moved (1.50\xa0KB), 1 duplicates, 0 failed"),
        ({"renamed": 2, "skipped": 1, "flagged": 1, "index_rebuilt": True, "seconds": 0}, "Run finished unknown (took 0s) — 0 moved (0 Bytes), 0 duplicates, 0 failed, 2 renamed to # 01, 1 groups skipped (space). 1 file needs review (see RENAME_01_SKIP in the log). Drive index rebuilt."),
        ({"flagged": 2, "index_rebuilt": False}, "Run finished unknown — 0 moved (0 Bytes), 0 duplicates, 0 failed. 2 files need review (see RENAME_01_SKIP in the log). Drive index rebuild FAILED — rebuild it manually."),
    ]
    schema = "dry_run boolean, finished string, seconds long, moved long, bytes long, duped long, failed long, renamed long, skipped long, flagged long, index_rebuilt boolean"
    rows = spark.createDataFrame([tuple((none | c).values()) for c, _ in cases], schema)
    assert [r[0] for r in rows.select(formats.last_run({k: F.col(k) for k in none})).collect()] == [line for _, line in cases]
