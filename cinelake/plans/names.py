"""The name vocabulary: cleaning, mining from file names and folders, merging, restoring names in titles, suggestions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.core import let, natural_key, stem, trim
from ..functions.titles import ends_with_scene_number, strip_number
from ..sources.store import materialize

# Letters that look Latin, and what they look like.
LOOKALIKES = "АВЕКМНОРСТХЅІЈУаеорсхѕіјуΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
LATIN = "ABEKMHOPCTXSIJYaeopcxsijyABEZHIKMNOPTYXo"
# Words that end the people's part of a dotted release name, or are no name.
STOP_WORDS = """and the a an in on of with for to at my all about it she her his him our your its this that first last lets gets wants needs loves
anal lesbian solo toys masturbation hardcore bts action workout threesome creampie facial fetish footjob blowjob pov gonzo casting audition massage squirt
bonus scene part vol xxx parody remastered edition internal external french german russian czech euro american pornstar anime body school teen teens girl
girls big tits ass wet hot sexy young busty mp4 avi mkv wmv x264 x265 xvid 1080p 720p 2160p 4k""".split()
NAME_SHAPE = r"^\p{Lu}[\p{L}'.\-]*(?:\s+\p{Lu}[\p{L}'.\-]*){1,2}$"
WRAPPING = " \t\n\r\0\x0b-_.,;:|/\\\"'()[]"


def fold_lookalikes(c: Column) -> Column:
    """Lookalike letters become Latin in mixed words, and in words of lookalikes alone if another word of the name is plainly Latin."""
    glyphs = f"[{LOOKALIKES}]"

    def folded(words: Column) -> Column:
        latin = F.exists(words, lambda w: w.rlike(r"^[\p{IsLatin}'.\-]+$"))
        one = lambda w: F.when(w.rlike(glyphs) & (w.rlike("[A-Za-z]") | (w.rlike(rf"^(?:{glyphs}|['.\-])+$") & latin)), F.translate(w, LOOKALIKES, LATIN)).otherwise(w)
        return F.array_join(F.transform(words, one), " ")

    return let(F.split(c, r"\s+"), folded)


def clean_name(c: Column) -> Column:
    """A usable name, or null: without wrapping punctuation, at most 100 characters, with a letter."""
    plain = trim(F.regexp_replace(trim(c), r"\s+", " "), WRAPPING)
    return let(fold_lookalikes(plain), lambda n: F.when((F.length(n) <= 100) & n.rlike(r"\p{L}"), n))


def split_names(c: Column) -> Column:
    """The cleaned names of a list separated by commas, ``&``, ``and`` or ``+``."""
    return F.filter(F.transform(F.split(c, r"(?i)\s*[,&+]\s*|\s+and\s+"), clean_name), lambda n: n.isNotNull())


def is_name_shaped(c: Column) -> Column:
    return c.rlike(NAME_SHAPE)


def scene_tail(c: Column) -> Column:
    """What follows the scene number: the dash form, else a capitalised word after a space; null for neither."""
    dash, space = F.regexp_extract(c, r"(?id)Scene_\d+\s*-\s*(.+)$", 1), F.regexp_extract(c, r"(?d)Scene_\d+\s+(\p{Lu}.+)$", 1)
    return F.coalesce(F.nullif(dash, F.lit("")), F.nullif(space, F.lit("")))


def _trim_stops(words: Column) -> Column:
    stop = lambda w: F.lower(w).isin(STOP_WORDS)
    step = lambda ws: F.aggregate(ws, F.slice(ws, 1, 0), lambda acc, w: F.when((F.size(acc) == 0) & stop(w), acc).otherwise(F.concat(acc, F.array(w))))
    return F.reverse(step(F.reverse(step(words))))


def mined(files: DataFrame, folders: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(name, key, source, sightings) from scene tails, folders of people, and dotted releases with ``.And.`` between two people.

    files: (stem, dir) and, where tails are read from another form than the raw stem, title; folders: (folder). A dotted candidate stays if it was seen twice or is known from elsewhere.
    excluded: folders that are no source of names.
    """
    files = files.where(~F.exists(F.split("dir", "/"), lambda s: s.isin(list(excluded)) | s.startswith(".")))
    tails = files.select(F.explode(split_names(scene_tail(F.col("title" if "title" in files.columns else "stem")))).alias("name")).where(is_name_shaped(F.col("name"))).withColumn("rank", F.lit(1))
    people = folders.where(~F.col("folder").isin(list(excluded)) & ~F.col("folder").startswith(".")).select(F.regexp_replace("folder", r"(?i)\s+Movies$", "").alias("name")).where(is_name_shaped(F.col("name"))).withColumn("rank", F.lit(2))
    certain = tails.unionByName(people).select(clean_name(F.col("name")).alias("name"), "rank").where("name IS NOT NULL").withColumn("key", F.lower("name"))
    certain = certain.groupBy("key").agg(F.min_by("name", F.struct("rank", "name")).alias("name"), F.min("rank").alias("rank"), F.count("*").alias("sightings"))

    side = r"(?:\p{Lu}[\p{Ll}']+\.){0,2}\p{Lu}[\p{Ll}']+"
    pattern = rf"({side})\.And\.({side})"
    dotted = files.where(F.length("stem") - F.length(F.replace("stem", F.lit("."), F.lit(""))) >= 3)
    both = F.concat(*[F.regexp_extract_all("stem", F.lit(pattern), F.lit(i)) for i in (1, 2)])
    words = dotted.select(F.explode(both).alias("side")).select(_trim_stops(F.split("side", r"\.")).alias("w"))
    words = words.where(F.size("w").between(2, 3) & ~F.exists("w", lambda w: F.lower(w).isin(STOP_WORDS)))
    seen = words.select(F.array_join("w", " ").alias("name")).groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.count("*").alias("n"))
    # A third word that rides along with a known pair counts for the pair.
    pair = F.substring_index("key", " ", 2)
    known = certain.select(F.col("key").alias("pair")).unionByName(seen.select(F.col("key").alias("pair"))).distinct().withColumn("has", F.lit(True))
    three = seen.withColumn("pair", F.when(F.size(F.split("key", " ")) == 3, pair)).join(known, "pair", "left")
    shorter = F.col("has").isNotNull()
    seen = three.select(F.when(shorter, F.col("pair")).otherwise(F.col("key")).alias("key"), F.when(shorter, F.substring_index("name", " ", 2)).otherwise(F.col("name")).alias("name"), "n")
    seen = seen.groupBy("key").agg(F.min("name").alias("name"), F.sum("n").alias("n"))
    kept = seen.join(certain.select("key", F.lit(True).alias("sure")), "key", "left").where((F.col("n") >= 2) | F.col("sure"))
    all_rows = certain.unionByName(kept.select("key", "name", F.lit(3).alias("rank"), F.col("n").alias("sightings")))
    out = all_rows.groupBy("key").agg(F.min_by("name", "rank").alias("name"), F.min("rank").alias("rank"), F.sum("sightings").alias("sightings"))
    return out.select("name", "key", F.element_at(F.array(F.lit("scene_tails"), F.lit("performer_folders"), F.lit("dotted")), F.col("rank")).alias("source"), "sightings")


def merge_names(*sources: DataFrame) -> DataFrame:
    """(name, key): the union of name tables; of spellings that differ by case the first table's, then the least, wins."""
    rows = reduce(DataFrame.unionByName, [s.select(clean_name(F.col("name")).alias("name"), F.lit(i).alias("rank")) for i, s in enumerate(sources)])
    return rows.where("name IS NOT NULL").groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("rank", "name")).alias("name")).select("name", "key")


def rename_name(names: DataFrame, old: str, new: str) -> DataFrame:
    """Drops the old name and every spelling of the new one, then adds the new one as typed."""
    row = names.sparkSession.createDataFrame([(new, new.lower())], "name string, key string")
    return names.where(~F.col("key").isin(old.lower(), new.lower())).unionByName(row)


def delete_names(names: DataFrame, gone: DataFrame) -> DataFrame:
    return names.join(gone.select(F.lower("name").alias("key")).distinct(), "key", "left_anti").select("name", "key")


def find_names(names: DataFrame, text: str) -> DataFrame:
    return names.where(F.lower("name").contains(text.lower())).orderBy(natural_key(F.col("name")))


def squashed(names: DataFrame) -> DataFrame:
    """(squash, name): names of several words by their spelling without spaces; null where two entries give one spelling."""
    rows = names.where(F.col("name").contains(" ")).select(F.lower(F.replace("name", F.lit(" "), F.lit(""))).alias("squash"), "name")
    return rows.groupBy("squash").agg(F.count("*").alias("entries"), F.min("name").alias("name")).select("squash", "entries", F.when(F.col("entries") == 1, F.col("name")).alias("name"))


#: Words of the longest run that is looked up as one name.
LONGEST_NAME = 4


def _segmented(size: Column, hits: Column) -> Column:
    """The names that use up all ``size`` words of a part, from left to right the longest that leaves a rest which names use up too; empty where none do.
    ``hits``: array of (i, n, name), the names of n words from word i on. Filled from the last word back; the head of the list stands for the next word."""

    def step(acc: Column, i: Column) -> Column:
        rest = lambda h: F.get(acc, h["n"] - 1)
        able = F.filter(hits, lambda h: (h["i"] == i) & rest(h)["ok"])
        best = let(F.array_sort(F.transform(able, lambda h: F.struct((-h["n"]).alias("m"), h["n"].alias("n"), h["name"].alias("name")))), lambda x: F.get(x, F.lit(0)))
        found = let(best, lambda h: F.when(h.isNull(), none).otherwise(F.struct(F.lit(True).alias("ok"), F.concat(F.array(h["name"]), rest(h)["names"]).alias("names"))))
        return F.concat(F.array(found), acc)

    none = F.struct(F.lit(False).alias("ok"), F.array().cast("array<string>").alias("names"))
    end = F.array(F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("names")))
    return F.get(F.aggregate(F.sequence(size, F.lit(1), F.lit(-1)), end, step), F.lit(0))["names"]


def _restored(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(title, restored) of the different titles whose scene tail the vocabulary changes or may change."""
    vocabulary = names.where("name <> ''").groupBy(F.lower("name").alias("full")).agg(F.min("name").alias("name"))
    words = vocabulary.select(F.explode(F.split("full", " ")).alias("key")).unionByName(vocabulary.select(F.col("full").alias("key"))).distinct()
    lookup = squashed(names).where("name IS NOT NULL").select(F.col("squash").alias("key"), F.col("name").alias("fixed")).join(words, "key", "left_anti")
    single = vocabulary.where(~F.col("full").contains(" ")).select(F.col("full").alias("key"), F.col("name").alias("fixed"))
    lookup, either = materialize(lookup, "lookup"), materialize(lookup.unionByName(single), "lookup")

    glued = r"^(.*?(?<![A-Za-z0-9_])Scene_\d{1,2})(\p{L}{6,})(?!\w)(.*)$"
    rows = titles.select("title").distinct().where(F.col("title").contains("Scene_") | F.lower("title").contains("scene_"))
    rows = rows.withColumn("key", F.nullif(F.lower(F.regexp_extract("title", glued, 2)), F.lit(""))).join(either, "key", "left")
    text = F.when(F.col("fixed").isNotNull(), F.concat(F.regexp_extract("title", glued, 1), F.lit(" - "), F.col("fixed"), F.regexp_extract("title", glued, 3))).otherwise(F.col("title"))
    rows = rows.select("title", text.alias("text")).withColumn("s", normalize.split_tail(F.col("text"))).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "titles")  # written, so a row keeps its number

    # The pieces of a tail that are a squashed name: looked up by themselves, only hits come back.
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"[^\s,]+"), F.lit(0))
    asked = rows.where("s.head <> ''").select("__row", F.explode(F.array_distinct(F.transform(F.filter(pieces("s.tail"), lambda p: F.length(p) >= 6), F.lower))).alias("key"))
    hits = asked.join(lookup, "key").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("key", "fixed"))).alias("fixes"))
    parts_of = F.regexp_extract_all("s.tail", F.lit(r"[^\s,]+|[\s,]+"), F.lit(0))
    tail = F.when(F.col("fixes").isNull(), F.col("s.tail")).otherwise(F.array_join(F.transform(parts_of, lambda p: F.coalesce(F.element_at("fixes", F.lower(p)), p)), ""))
    parts = F.filter(F.transform(F.split("tail", r"\s*,\s*"), trim), lambda p: p != "")
    rows = materialize(rows.where("s.head <> ''").join(hits, "__row", "left").withColumn("tail", tail).select("__row", "title", F.col("s.head").alias("head"), parts.alias("parts")).unionByName(rows.where("s.head = ''").select("__row", "title", F.col("text").alias("head"), F.lit(None).cast("array<string>").alias("parts"))), "tails")

    # Parts of three words or more: each run of words is looked up as a name; the part itself, if it is one, stays.
    long = rows.select("__row", F.posexplode("parts").alias("part", "p")).withColumn("w", F.split("p", " ")).where(F.size("w") >= 3)
    starts = F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")
    lengths = F.array_distinct(F.concat(F.sequence(F.lit(1), F.least(F.lit(LONGEST_NAME), F.size("w") - F.col("i") + 1)), F.when(F.col("i") == 1, F.array(F.size("w"))).otherwise(F.array().cast("array<int>"))))
    runs = long.select("__row", "part", "w", starts).withColumn("n", F.explode(lengths))
    runs = runs.select("__row", "part", F.size("w").alias("words"), "i", "n", F.lower(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ")).alias("full"))
    found = runs.join(vocabulary, "full").groupBy("__row", "part", "words").agg(F.collect_list(F.struct("i", "n", "name")).alias("hits"), F.bool_or(F.col("n") == F.col("words")).alias("whole"))
    cut = found.where("NOT whole").select("__row", "part", _segmented(F.col("words"), F.filter("hits", lambda h: h["n"] <= LONGEST_NAME)).alias("names")).where(F.size("names") >= 2)
    cut = cut.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("part", F.array_join("names", ", ").alias("p")))).alias("cuts"))
    people = F.array_join(F.transform("parts", lambda p, i: F.coalesce(F.element_at("cuts", i), p)), ", ")
    return rows.join(cut, "__row", "left").select("title", F.when(F.col("parts").isNull(), F.col("head")).otherwise(F.concat("head", people)).alias("restored"))


def restore_names(titles: DataFrame, names: DataFrame, column: str = "title") -> DataFrame:
    """Titles with the people behind ``Scene_N`` put right by the vocabulary: a name without its spaces (six letters or more, one match, no known word),
    also glued to the number, and missing commas between names of a part of three words or more that names use up.

    Each different title is worked on once, and words are looked up by equi-joins, so the vocabulary may be large. Of spellings of a name that differ by case the least
    is written. Other columns pass through; a null title stays null.
    """
    fixed = _restored(titles.select(F.col(column).alias("title")), names).select(F.col("title").alias("__title"), F.col("restored").alias("__restored"))
    done = titles.join(fixed, F.col(column) == F.col("__title"), "left").withColumn(column, F.coalesce("__restored", column))
    return done.select(*titles.columns)


def normalize_plan(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(path, old_name, new_name, needs_rename, conflict): the rename plan for (dir, file_name).

    conflict: 'two_sources' where two files of a folder get one name, 'exists' where another file that stays has it, 'case_only' where only letters' case changes.
    Each different stem is normalised once.
    """
    rows = files.select("dir", "file_name", stem(F.col("file_name")).alias("stem"), F.regexp_extract("file_name", r"(?<=.)\.([^.]*)$", 1).alias("ext"))
    stems = materialize(rows.select("stem").distinct().withColumn("title", normalize.before_names(F.col("stem"))), "stems")
    if names is not None:
        stems = restore_names(stems, names)
    rows = rows.join(stems.select("stem", normalize.after_names(F.col("title")).alias("title")), "stem")
    new = F.concat("title", F.when(F.col("ext") != "", F.concat(F.lit("."), F.col("ext"))).otherwise(""))
    rows = rows.withColumn("new_name", new).withColumn("needs_rename", F.col("new_name") != F.col("file_name"))
    same = Window.partitionBy("dir", F.lower("new_name"))
    stays = F.max(F.when(~F.col("needs_rename"), 1)).over(same)
    conflict = F.when(~F.col("needs_rename"), F.lit(None)).when(stays == 1, "exists").when(F.count("*").over(same) > 1, "two_sources").when(F.lower("new_name") == F.lower("file_name"), "case_only")
    return rows.withColumn("conflict", conflict).select(F.concat("dir", F.lit("/"), "file_name").alias("path"), F.col("file_name").alias("old_name"), "new_name", "needs_rename", "conflict")


def worklist_files(files: DataFrame) -> DataFrame:
    """(key, title, path) of the files that end with the scene number."""
    rows = files.where(ends_with_scene_number(F.col("stem"))).withColumn("title", strip_number(F.regexp_replace("stem", r"(?i)\s*-?\s*Scene_\d+\s*$", "")))
    return rows.select(F.lower("title").alias("key"), "title", "path")


def name_worklist(files: DataFrame) -> DataFrame:
    """(key, title, n_files): titles with files that end with the scene number; ``worklist_files`` has those files, a row for each."""
    return worklist_files(files).groupBy("key").agg(F.min("title").alias("title"), F.count("*").alias("n_files"))


def suggest_names(partials: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """For each (partial) of two letters or more up to ``most`` names: those that start with it, then those that contain it. An equi-join on each name's
    pieces of two and three letters stands for the nested loop; a partial of three letters or more is looked up by the rarest of its own three-letter pieces."""
    low = names.select("name", F.lower("name").alias("key"))
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n))))
    by = low.select("name", "key", F.explode(F.array_distinct(F.concat(pieces("key", 2), pieces("key", 3)))).alias("g"))
    asked = partials.select("partial", F.lower("partial").alias("p")).where(F.length("p") >= 2).distinct()
    own = asked.select("partial", "p", F.explode(F.when(F.length("p") == 2, F.array("p")).otherwise(pieces("p", 3))).alias("g"))
    often = by.groupBy("g").agg(F.count("*").alias("often"))
    asked = own.join(often, "g").groupBy("partial", "p").agg(F.min_by("g", F.struct("often", "g")).alias("g"), F.count("*").alias("found"), F.max(F.size(F.when(F.length("p") == 2, F.array("p")).otherwise(pieces("p", 3)))).alias("all")).where(F.col("found") == F.col("all")).select("partial", "p", "g")
    hits = asked.join(by, "g").where(F.col("key").contains(F.col("p"))).withColumn("kind", F.when(F.col("key").startswith(F.col("p")), 1).otherwise(2))
    rank = F.row_number().over(Window.partitionBy("partial").orderBy("kind", natural_key(F.col("name")), "name"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("partial", "rank", "name", "kind")


def most_words(names: DataFrame) -> DataFrame:
    """(words): the longest name's number of words."""
    return names.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(0)).alias("words"))


def typed_segment(partials: DataFrame, names: DataFrame) -> DataFrame:
    """Adds typed, start and glued to (partial): the name being typed in a partial list begins behind the last separator (a word separator at the very end is
    not one yet), then behind leading names of two words or more that the vocabulary knows, but for the last word and names that a longer one begins with.

    The vocabulary is met by equi-joins: each run of words is one lookup among the names, and one, with the word behind it, among their beginnings.
    """
    separator = r"(?iu)\s*(?:[,&;/\n\r]|\band\b)\s*"
    body = F.regexp_extract("partial", rf"(?s)^(?:.*{separator})?(.*)$", 1)
    word_last = F.col("partial").rlike(r"(?iu)\band$")  # "..., And" may begin a name
    inner = F.regexp_extract(F.regexp_replace("partial", r"(?iu)and$", ""), rf"(?s)^(?:.*{separator})?(.*)$", 1)
    typed = F.when(word_last, F.concat(inner, F.regexp_extract("partial", r"(?iu)(and)$", 1))).otherwise(body)
    rows = partials.select("partial").distinct().withColumn("body", typed).withColumn("w", F.filter(F.split("body", r"\s+"), lambda x: x != ""))
    full = names.select(F.lower("name").alias("run")).distinct()
    begins = full.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.substring(F.col("run"), F.lit(1), i))).alias("begin")).distinct()
    n = F.size("w")
    spans = rows.where(n > 2).select("partial", "w", F.explode(F.sequence(F.lit(1), n - 2)).alias("i")).withColumn("n", F.explode(F.sequence(F.lit(2), F.size("w") - F.col("i"))))
    spans = spans.withColumn("run", F.lower(F.array_join(F.slice("w", F.col("i"), F.col("n")), " "))).withColumn("begin", F.lower(F.array_join(F.slice("w", F.col("i"), F.col("n") + 1), " ")))
    whole = rows.where(n >= 2).select("partial", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"), "w").withColumn("run", F.lower(F.array_join(F.slice("w", F.col("i"), F.size("w") - F.col("i") + 1), " ")))
    # A name that uses up all words is still being typed, so the walk stops before it.
    ending = whole.join(full, "run").select("partial", "i", F.lit(True).alias("ends"))
    known = spans.join(full, "run").join(begins.withColumn("longer", F.lit(True)), "begin", "left").groupBy("partial", "i").agg(F.max(F.struct("n", "longer")).alias("z"))
    steps = known.join(ending, ["partial", "i"], "left").where("ends IS NULL AND z.longer IS NULL").groupBy("partial").agg(F.map_from_entries(F.collect_list(F.struct("i", "z.n"))).alias("steps"))
    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), lambda at, i: F.when((at == i) & F.element_at("steps", i).isNotNull(), at + F.element_at("steps", i)).otherwise(at))
    done = rows.join(steps, "partial", "left").withColumn("at", F.when(F.col("steps").isNull(), 1).otherwise(walk)).withColumn("glued", F.col("at") > 1)
    rest = F.when(~F.col("glued"), F.col("body")).otherwise(F.regexp_replace("body", F.concat(F.lit(r"^\s*(?:\S+\s+){"), (F.col("at") - 1).cast("string"), F.lit("}")), F.lit("")))
    return done.withColumn("typed", rest).withColumn("start", F.length("partial") - F.length("typed")).select("partial", "typed", "start", "glued")


def _cut(words: Column, known: Callable[[Column], Column]) -> Column:
    """``words`` cut from left to right: ``known`` gives the length of the longest known name from a place on, or null for a pair; an odd last word joins the one before."""

    def step(acc: Column, i: Column) -> Column:
        n = F.coalesce(known(i), F.when(i < F.size(words), 2).otherwise(1))
        lone = (i == F.size(words)) & (F.size(acc["out"]) > 0)
        joined = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(acc["out"], -1), F.get(words, i - 1))))
        grown = F.when(lone, joined).otherwise(F.concat(acc["out"], F.array(F.array_join(F.slice(words, i, n), " "))))
        return F.when(i < acc["next"], acc).otherwise(F.struct(grown.alias("out"), (i + n).alias("next")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.size(words)), start, step)["out"]


def _list_parts(text: Column) -> Column:
    """What the separators of a pasted list leave, without parts that hold no letter."""
    return F.filter(F.transform(F.split(text, r"(?i)[,;&/\n]|\s+and\s+"), lambda p: trim(F.regexp_replace(p, r"\s+", " "), WRAPPING)), lambda p: p.rlike(r"\p{L}"))


def tidy_list(text: Column, known: Column) -> Column:
    """A pasted list of names (``known``: array of lower-case full names): separators dropped, runs of four words or more cut greedily by known names of two words or more, else in pairs; an odd last word joins the one before."""

    def cut(words: Column) -> Column:
        return _cut(words, lambda i: F.get(F.filter(F.array(*map(F.lit, (4, 3, 2))), lambda n: (i + n - 1 <= F.size(words)) & F.array_contains(known, F.lower(F.array_join(F.slice(words, i, n), " ")))), F.lit(0)))

    return F.flatten(F.transform(_list_parts(text), lambda p: let(F.split(p, " "), lambda w: F.when(F.size(w) >= 4, cut(w)).otherwise(F.array(p)))))


def tidy_lists(lists: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``people`` to (text, ...): what ``tidy_list`` makes of each pasted list, with a vocabulary of any size: each run of two to four words is one lookup by an equi-join.

    Each different text is cut once. Null and empty texts give no people; other columns pass through.
    """
    rows = lists.select("text").where("text IS NOT NULL").distinct().select(F.col("text").alias("__text"), F.posexplode(_list_parts(F.col("text"))).alias("no", "p")).withColumn("w", F.split("p", " "))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "parts")  # written, so a row keeps its number
    long = rows.where(F.size("w") >= LONGEST_NAME).select("__row", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    runs = long.withColumn("n", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST_NAME), F.size("w") - F.col("i") + 1))))
    runs = runs.select("__row", "i", "n", F.lower(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ")).alias("full"))
    known = runs.join(names.select(F.lower("name").alias("full")).distinct(), "full").groupBy("__row", "i").agg(F.max("n").alias("n"))
    known = known.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("known"))
    cut = rows.join(known, "__row", "left").withColumn("known", F.coalesce("known", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))))
    cut = cut.select("__text", "no", F.when(F.size("w") >= LONGEST_NAME, _cut(F.col("w"), lambda i: F.element_at("known", i))).otherwise(F.array("p")).alias("own"))
    whole = cut.groupBy("__text").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "own"))), lambda x: x["own"])).alias("people"))
    joined = lists.join(whole, F.col("text") == F.col("__text"), "left").drop("__text")
    return joined.withColumn("people", F.coalesce("people", F.array().cast("array<string>")))
