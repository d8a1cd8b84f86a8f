"""Walking folders in parallel, and publishing an index that readers never see half-written."""

import os

import pytest
from pyspark.sql import functions as F

from cinelake.sources import publish, tree


def make(path, text="x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def root(tmp_path):
    a = f"{tmp_path}/a"
    for name in ["Gray Manor - Scene_1 - Mara Quill.mp4", "Gray Manor - Scene_2.mp4", "Lone Film.mkv", "Loud.MKV", "notes.txt", ".hidden.mp4", "Low/Deep Cut - Bonus Reel.avi", "e1/e2/e3/e4/Fourth.mp4", "e1/e2/e3/e4/e5/Fifth.mp4", "Duplicates/Kept Back.mp4", ".Trashes/Thrown.mp4", "Low/duplicates/Kept Back.mp4"]:
        make(f"{a}/{name}", name)
    os.symlink(f"{a}/Low", f"{a}/alias")
    os.symlink(f"{a}/Lone Film.mkv", f"{a}/alias.mp4")
    return a


def test_scan(spark, root, tmp_path):
    rows = tree.scan(spark, [root, f"{tmp_path}/none", f"{root}/notes.txt/"]).collect()
    files = {r.path.removeprefix(root): r for r in rows if r.problem is None}
    assert set(files) == {"/Gray Manor - Scene_1 - Mara Quill.mp4", "/Gray Manor - Scene_2.mp4", "/Lone Film.mkv", "/Loud.MKV", "/notes.txt", "/Low/Deep Cut - Bonus Reel.avi", "/e1/e2/e3/e4/Fourth.mp4"}
    r = files["/Low/Deep Cut - Bonus Reel.avi"]
    assert (r.dir, r.file, r.size) == (f"{root}/Low", "Deep Cut - Bonus Reel.avi", len("Low/Deep Cut - Bonus Reel.avi")) and r.mtime is not None
    assert sorted((r.root, r.problem) for r in rows if r.problem) == [(f"{root}/notes.txt", "missing"), (f"{tmp_path}/none", "missing")]
    assert tree.scan(spark, [root], max_depth=0).where("problem IS NULL").count() == 5
    assert tree.scan(spark, [root], max_depth=None).where("file = 'Fifth.mp4'").count() == 1
    assert tree.scan(spark, [root]).rdd.getNumPartitions() == 3  # the root's files, and each folder


def test_unreadable_folders_are_rows(root, monkeypatch):
    listed = os.scandir

    def scandir(path):
        if path.endswith("/Low"):
            raise PermissionError(path)
        return listed(path)

    monkeypatch.setattr(os, "scandir", scandir)
    rows = list(tree.walk(root, root, 0, 4))
    assert [(r[2], r[6]) for r in rows if r[6]] == [(f"{root}/Low", "unreadable")] and len(rows) == 7


def test_rebuild(spark, root, tmp_path):
    """Entries of a root that is away are carried forward, those of a root that isn't configured any more go."""
    store, other = f"{tmp_path}/store", f"{tmp_path}/b"
    make(f"{other}/Far Film - Scene_1.mp4")
    names = lambda df: sorted(r.file for r in df.collect())
    first = ["Deep Cut - Bonus Reel.avi", "Fourth.mp4", "Gray Manor - Scene_1 - Mara Quill.mp4", "Gray Manor - Scene_2.mp4", "Lone Film.mkv", "Loud.MKV"]
    assert publish.current(spark, store) is None
    made = publish.rebuild(spark, [root], store)
    assert names(made) == first
    assert {r.file: r.base for r in made.collect()}["Deep Cut - Bonus Reel.avi"] == "Deep Cut"
    assert names(publish.rebuild(spark, [root, other], store)) == sorted([*first, "Far Film - Scene_1.mp4"])
    os.rename(other, f"{other}.away")
    again = publish.rebuild(spark, [root, other], store)
    assert names(again) == sorted([*first, "Far Film - Scene_1.mp4"]) and names(again.where("carried")) == ["Far Film - Scene_1.mp4"]
    assert names(publish.rebuild(spark, [root, other], store)) == names(again)
    assert names(publish.rebuild(spark, [root], store)) == first
    kept = publish.read_pointer(spark, store)
    assert len(publish.prune(spark, store, 1 << 62)) == 4 and publish.read_pointer(spark, store) == kept
    assert names(publish.current(spark, store)) == first


def test_a_broken_build_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = f"{tmp_path}/store"
    publish.publish(spark.range(3), store)
    ids = lambda: sorted(r.id for r in publish.current(spark, store).collect())
    with pytest.raises(Exception, match="broken"):  # while the version is written
        publish.publish(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")), store)
    assert ids() == [0, 1, 2]
    swap = publish.swap_pointer
    monkeypatch.setattr(publish, "swap_pointer", lambda *a: (_ for _ in ()).throw(OSError("broken")))
    with pytest.raises(OSError):  # before the pointer moves
        publish.publish(spark.range(7), store)
    assert ids() == [0, 1, 2]
    monkeypatch.setattr(publish, "swap_pointer", swap)
    with pytest.raises(ValueError, match="/bad"):  # a root that can't be read
        publish.publish(spark.range(7), store, spark.createDataFrame([("/ok", False), ("/bad", True)], "root string, unreadable boolean"))
    assert ids() == [0, 1, 2]
    old = publish.current(spark, store)
    publish.publish(spark.range(9), store)
    assert len(ids()) == 9 and old.count() == 3  # a reader that began before goes on
