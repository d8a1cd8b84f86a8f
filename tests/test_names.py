"""Names behind a scene number: spaces and commas put back by the vocabulary."""

import pytest
from pyspark.sql import functions as F

from cinelake.plans import names

# A one-word name, two names with one spelling without spaces, and a name whose spelling without spaces is a name too.
VOCABULARY = ["Mara Quill", "Otto Vane", "Solace", "Ina Rook", "In Arook", "Lu Cille", "Lucille"]
# (what the case shows, title, expected or None where nothing changes, further names)
# Vocabularies of some cases, besides the above.
LONGER = ["Otto Va", "Otis V", "Lu Cille Quill", "Quill", "One Two Three Four Five", "One", "Two Three Four Five"]
FURTHER = ["Mara Quill Otto", "One Two Three Four Five"]
CASES = [
    ("a space comes back", "Film - Scene_1 - MaraQuill", "Film - Scene_1 - Mara Quill", []),
    ("in a list", "Film - Scene_2 - MaraQuill, OttoVane", "Film - Scene_2 - Mara Quill, Otto Vane", []),
    ("in the vocabulary's casing", "Film - Scene_1 - maraquill", "Film - Scene_1 - Mara Quill", []),
    ("two names with one spelling", "Film - Scene_1 - InaRook", None, []),
    ("a name already", "Film - Scene_1 - Lucille", None, []),
    ("unknown", "Film - Scene_1 - WhoEver", None, []),
    ("the title isn't touched", "MaraQuill - Scene_1 - Otto Vane", None, []),
    ("no scene", "MaraQuill Collection", None, []),
    ("spaced already", "Film - Scene_1 - Mara Quill", None, []),
    ("six letters are enough", "Film - Scene_1 - OttoVa", "Film - Scene_1 - Otto Va", LONGER),
    ("five letters are too short", "Film - Scene_1 - OtisV", None, LONGER),
    ("spaces and the comma", "Film - Scene_3 - MaraQuill OttoVane", "Film - Scene_3 - Mara Quill, Otto Vane", []),
    ("the comma alone", "Film - Scene_1 - Mara Quill Otto Vane", "Film - Scene_1 - Mara Quill, Otto Vane", []),
    ("a one-word name in front", "Film - Scene_1 - Solace Mara Quill", "Film - Scene_1 - Solace, Mara Quill", []),
    ("a one-word name at the end", "Film - Scene_1 - Mara Quill Solace", "Film - Scene_1 - Mara Quill, Solace", []),
    ("two words are never split", "Film - Scene_1 - Otto Vane", None, ["Otto", "Vane"]),
    ("a misplaced comma stays", "Film - Scene_1 - Solace Mara, Quill", None, []),
    ("a part that is a name", "Film - Scene_1 - Lu Cille Quill", None, LONGER),
    ("words left at the end", "Film - Scene_1 - Mara Quill Longer Version", None, []),
    ("words left in front", "Film - Scene_1 - Longer Mara Quill", None, []),
    ("words left between", "Film - Scene_1 - Mara Quill with Otto Vane", None, []),
    ("one part of two", "Film - Scene_1 - Mara Quill Longer Version, Otto Vane Solace", "Film - Scene_1 - Mara Quill Longer Version, Otto Vane, Solace", []),
    ("commas there already", "Film - Scene_3 - Mara Quill, Otto Vane", None, []),
    ("glued, lower case", "Film - Scene_2maraquill", "Film - Scene_2 - Mara Quill", []),
    ("a glued one-word name", "Film - Scene_2solace", "Film - Scene_2 - Solace", []),
    ("glued, unknown", "Film - Scene_2whoever", None, []),
    ("glued, two names", "Film - Scene_2inarook", None, []),
    ("a longer name before its beginning", "Film - Scene_1 - Mara Quill Otto Solace", "Film - Scene_1 - Mara Quill Otto, Solace", FURTHER),
    ("the longer name leaves a rest, the shorter doesn't", "Film - Scene_1 - Mara Quill Otto Vane", "Film - Scene_1 - Mara Quill, Otto Vane", FURTHER),
    ("a name twice", "Film - Scene_1 - Solace Solace Mara Quill Solace", "Film - Scene_1 - Solace, Solace, Mara Quill, Solace", []),
    ("five words as one name", "Film - Scene_1 - One Two Three Four Five", None, LONGER),
    ("a name of five words isn't looked up in a longer part", "Film - Scene_1 - One Two Three Four Five Solace", None, FURTHER),
    ("one spelling by case", "Film - Scene_1 - Mara Quill Solace", "Film - Scene_1 - Mara Quill, SOLACE", ["SOLACE"]),
]


@pytest.mark.parametrize("more", sorted({tuple(c[3]) for c in CASES}))
def test_cases(spark, more):
    own = [c for c in CASES if tuple(c[3]) == more]
    vocabulary = spark.createDataFrame([(n,) for n in [*VOCABULARY, *more]], "name string")
    rows = spark.createDataFrame([(c[0], c[1], 1) for c in own] + [("twice", own[0][1], 2), ("null", None, 3), ("empty", "", 4)], "what string, title string, tail int")
    got = {r["what"]: (r["title"], r["tail"]) for r in names.restore_names(rows, vocabulary).collect()}
    assert got == {c[0]: (c[2] or c[1], 1) for c in own} | {"twice": (own[0][2] or own[0][1], 2), "null": (None, 3), "empty": ("", 4)}


def test_restoring_is_a_fixed_point(spark):
    vocabulary = spark.createDataFrame([(n,) for n in VOCABULARY], "name string")
    done = [(c[2] or c[1],) for c in CASES if not c[3]]
    again = names.restore_names(spark.createDataFrame(done, "title string").withColumn("was", F.col("title")), vocabulary)
    assert again.where("title <> was").count() == 0


def test_no_names(spark):
    none = spark.createDataFrame([], "name string")
    assert [r[0] for r in names.restore_names(spark.createDataFrame([("F - Scene_1 - A B C",), ("F",)], "title string"), none).orderBy("title").collect()] == ["F", "F - Scene_1 - A B C"]


def test_plan_with_leftovers(spark):
    """File names whose parts don't segment go through the whole plan."""
    vocabulary = spark.createDataFrame([(n,) for n in VOCABULARY], "name string")
    files = spark.createDataFrame([("/s", "film.scene.1.Mara.Quill.Longer.Version.mp4"), ("/s", "film.scene.2.MaraQuill.OttoVane.mkv"), ("/t", "film.scene.2.MaraQuill.OttoVane.mkv"), ("/s", "plain.mp4")], "dir string, file_name string")
    got = {r["path"]: r["new_name"] for r in names.normalize_plan(files, vocabulary).collect()}
    assert got == {"/s/film.scene.1.Mara.Quill.Longer.Version.mp4": "Film - Scene_1 - Mara Quill Longer Version.mp4", "/s/film.scene.2.MaraQuill.OttoVane.mkv": "Film - Scene_2 - Mara Quill, Otto Vane.mkv", "/t/film.scene.2.MaraQuill.OttoVane.mkv": "Film - Scene_2 - Mara Quill, Otto Vane.mkv", "/s/plain.mp4": "Plain.mp4"}


def test_pasted_lists(spark):
    """With a vocabulary table as with an array of names, and by hand."""
    known = ["Mara Quill", "Otto Vane", "Ana de la Cruz", "Lu Fei Wen", "Solace"]
    texts = {
        "mara quill otto vane": ["mara quill", "otto vane"], "Mara Quill, Otto Vane and Solace": ["Mara Quill", "Otto Vane", "Solace"], "Ana De La Cruz Mara Quill": ["Ana De La Cruz", "Mara Quill"],
        "Lu Fei Wen Otto Vane": ["Lu Fei Wen", "Otto Vane"], "Who Ever Lu Fei Wen": ["Who Ever", "Lu Fei Wen"], "Who Lu Fei Wen Otto": ["Who Lu", "Fei Wen Otto"], "One Two Three": ["One Two Three"],
        "One Two Three Four Five": ["One Two", "Three Four Five"], " - ; & 12 / ": [], "": [], "a\nb & c": ["a", "b", "c"], "Solace Mara Quill Otto Vane": ["Solace Mara", "Quill Otto Vane"],
    }
    lists = spark.createDataFrame([(t, i) for i, t in enumerate([*texts, *texts, None])], "text string, n int")
    got = names.tidy_lists(lists, spark.createDataFrame([(k,) for k in [*known, "mara quill"]], "name string")).collect()
    assert sorted((r.text or "?", r.n, r.people) for r in got) == sorted((t or "?", i, texts.get(t, [])) for i, t in enumerate([*texts, *texts, None]))
    own = lists.where("text IS NOT NULL").select("text", names.tidy_list(F.col("text"), F.array(*[F.lit(k.lower()) for k in known])).alias("people")).collect()
    assert all(r.people == texts[r.text] for r in own)
