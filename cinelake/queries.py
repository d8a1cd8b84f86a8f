"""The registered queries of the media-catalogue jobs, over tables derived from the driver's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import normalize as norm
from .functions.core import natural_key, natural_order
from .functions.titles import episode_order, parse_episode, strip_variant
from .functions import formats
from .plans import consolidate, index, ingest, library, names, reports, search, stored
from .plans.placement import numbered
from .sources.derive import derived as table
from .sources.files import INGEST_EXTENSIONS, read_log, short_list, write_log
from .sources.store import fresh_dir, materialize
from .streaming.jobs import debounced, stale

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEARCHES = ["brand#1", "BOLT", "scene_2", "no such title"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media_files").where(F.lower("ext").isin(INGEST_EXTENSIONS))


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.title_rollup(scanned(spark, sf))


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("/vol0", True), ("/vol1", True), ("/vol2", False), ("/vol3", True)], "root string, present boolean")


def written(spark: SparkSession, sf: str) -> DataFrame:
    """The media files for jobs that read them more than once: written once, their paths put together when they are read."""
    files = materialize(table(spark, sf, "media_files").drop("path"), "media")
    return files.withColumn("path", F.concat("dir", F.lit("/"), "stem", F.lit("."), "ext"))


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The new listing lacks /vol2, whose old entries are carried forward."""
    files = written(spark, sf)
    old = files.where("mtime < TIMESTAMP '2000-01-01' AND lower(ext) <> 'txt' AND dir NOT LIKE '%/duplicates/%'")
    previous = old.select(strip_variant(F.col("stem")).alias("base"), F.concat("stem", F.lit("."), "ext").alias("file"), "dir", "size", "mtime")
    return index.build_index(files, previous, roots(spark))


def best(spark: SparkSession, sf: str) -> DataFrame:
    """The best copies; episodes are parsed once and written, as jobs read them more than once."""
    return consolidate.best_copies(materialize(consolidate.episodes(table(spark, sf, "media_files")), "episodes"))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return best(spark, sf).where("keep").select("base_key", "drive", "size")


@query
def title_rollup(spark, sf):
    return rollup(spark, sf)


@query
def ingest_match(spark, sf):
    return ingest.ingest_match(rollup(spark, sf), table(spark, sf, "library"))


def unglued(df: DataFrame, column: str = "title") -> DataFrame:
    """The derived titles hold a glued number, which rules numbering out; without it both outcomes occur."""
    return df.withColumn(column, F.regexp_replace(column, "(?i)brand#", "brand "))


@query
def numbering_plan(spark, sf):
    return ingest.numbering_plan(unglued(rollup(spark, sf)), unglued(table(spark, sf, "library")))


@query
def number_files(spark, sf):
    plan = ingest.numbering_plan(unglued(rollup(spark, sf)), unglued(table(spark, sf, "library")))
    return ingest.number_files(unglued(scanned(spark, sf), "stem"), plan)


@query
def duplicate_move_plan(spark, sf):
    matched = ingest.ingest_match(rollup(spark, sf), table(spark, sf, "library"))
    return ingest.duplicate_move_plan(matched.where("action <> 'insert'"), scanned(spark, sf))


@query
def fill_missing(spark, sf):
    return ingest.fill_missing(table(spark, sf, "library"), rollup(spark, sf))


def probed(spark, sf):
    return ingest.with_probes(scanned(spark, sf), ingest.parse_probe(table(spark, sf, "probe_raw")))


@query
def title_rollup_probed(spark, sf):
    return ingest.title_rollup(probed(spark, sf))


@query
def fill_metadata(spark, sf):
    return ingest.fill_metadata(table(spark, sf, "library"), ingest.title_rollup(probed(spark, sf)))


@query
def refresh_counts(spark, sf):
    return library.outcome_counts(ingest.refresh_sizes(table(spark, sf, "library"), scanned(spark, sf)))


@query
def refresh_sizes(spark, sf):
    return ingest.refresh_sizes(table(spark, sf, "library"), scanned(spark, sf))


@query
def insert_new(spark, sf):
    return ingest.insert_new(table(spark, sf, "library"), rollup(spark, sf)).drop("date_created")


@query
def probe_parse(spark, sf):
    return ingest.parse_probe(table(spark, sf, "probe_raw"))


@query
def listing_filtered(spark, sf):
    return library.listing(table(spark, sf, "library"), [("contains", "large"), ("endsWith", "1")]).withColumn("date_created", text("date_created"))


@query
def listing_newest(spark, sf):
    """The whole listing, newest first: each title's place."""
    rows = library.listing(table(spark, sf, "library"))
    newest = F.coalesce(-F.unix_micros(F.col("date_created").cast("timestamp")), F.lit((1 << 63) - 1))
    return numbered(rows, [newest, F.col("id")]).select("id", "title", (F.col("pos") + 1).alias("place"))


@query
def settle_renames(spark, sf):
    """The working list after a run that renamed some files, trashed some and failed on others."""
    work = table(spark, sf, "raw_files").select(F.concat("dir", F.lit("/"), "file_name").alias("path"), "dir")
    done = work.withColumn("n", F.pmod(F.length("path"), F.lit(4))).where("n < 3").select("path", F.when(F.col("n") == 0, F.concat("path", F.lit(".new"))).alias("new_path"), (F.col("n") < 2).alias("ok"))
    return library.settle(work, done)


@query
def listing_counts(spark, sf):
    return library.counts(table(spark, sf, "library"), [("contains", "large"), ("endsWith", "1")])


@query
def apply_edits(spark, sf):
    lib = table(spark, sf, "library")
    rows = lib.where("id % 9 = 0").select("id", F.explode(F.expr("array(struct('title' AS field, concat(title, ' edited') AS value, 1 AS seq), struct('title' AS field, CAST(NULL AS STRING) AS value, 0 AS seq), struct('filesize' AS field, CAST(NULL AS STRING) AS value, 2 AS seq), struct('owner' AS field, 'x' AS value, 3 AS seq))")).alias("e")).select("id", "e.*")
    return library.apply_edits(lib, rows).withColumn("date_created", text("date_created"))


@query
def apply_changes(spark, sf):
    """The stored library after edits and deletes of a few rows: what it holds then, from rewritten and untouched buckets."""
    lib = table(spark, sf, "library")
    store = fresh_dir(spark, "library")
    stored.create(lib, store)
    edits = lib.where("id % 97 = 0").select("id", F.lit("title").alias("field"), F.concat("title", F.lit(" edited")).alias("value"), F.lit(1).alias("seq"))
    stored.change(spark, store, edits, lib.where("id % 89 = 0").select("id").unionByName(spark.range(-1, 0)))
    return stored.read(spark, store).withColumn("date_created", text("date_created"))


def accented(spark: SparkSession, sf: str) -> DataFrame:
    """The library's titles, two thirds of them with accents and in upper case."""
    marked = F.when(F.col("id") % 3 == 0, F.translate("title", "aeo", "áèö")).when(F.col("id") % 3 == 1, F.upper(F.translate("title", "eu", "éü"))).otherwise(F.col("title"))
    return table(spark, sf, "library").select("id", marked.alias("title"))


@query
def titles_in_order(spark, sf):
    """Each title's place in natural order without regard to case and accents."""
    return numbered(accented(spark, sf), [natural_order(F.col("title")), F.col("id")]).select("id", "title", (F.col("pos") + 1).alias("place"))


@query
def find_titles(spark, sf):
    """Titles with accents and in capitals, and the library row that each one is."""
    return library.find_titles(accented(spark, sf), table(spark, sf, "library"))


@query
def last_run_lines(spark, sf):
    """The line about each owner's run, from its log."""
    log = table(spark, sf, "action_log")
    ok = F.col("status") == "OK"
    n = lambda cond: F.count_if(cond)
    runs = log.groupBy("grp").agg(n(ok & (F.col("action") == "MOVE")).alias("moved"), F.sum(F.when(ok & (F.col("action") == "MOVE"), F.col("bytes"))).alias("bytes"), n(ok & (F.col("action") == "MOVE_DUP")).alias("duped"), n(F.col("status") == "FAIL").alias("failed"), n(ok & (F.col("action") == "RENAME_01")).alias("renamed"), n(F.col("status") == "SKIP").alias("skipped"), F.max("line_no").alias("last"), F.max("ts").alias("finished"))
    c = {k: F.col(k) for k in ("moved", "bytes", "duped", "failed", "renamed", "skipped")} | {"dry_run": F.col("last") % 2 == 0, "finished": F.when(F.col("last") % 5 > 0, text("finished")), "seconds": F.when(F.col("last") % 3 > 0, F.col("last")), "flagged": F.col("last") % 4, "index_rebuilt": F.when(F.col("last") % 7 < 4, F.col("last") % 7 < 2)}
    return runs.select("grp", formats.last_run(c).alias("line"))


@query
def apply_deletes(spark, sf):
    lib = table(spark, sf, "library")
    gone = lib.where("id % 10 = 0").select("id").unionByName(spark.range(-1, 0))
    left = library.apply_deletes(lib, gone).select("id", F.lit("kept").alias("state"))
    return left.unionByName(library.unknown_ids(lib, gone).select("id", F.lit("not_found").alias("state")))


@query
def index_snapshot(spark, sf):
    return snapshot(spark, sf).withColumn("mtime", text("mtime"))


@query
def index_meta(spark, sf):
    return index.snapshot_meta(snapshot(spark, sf), roots(spark)).select("file_count", F.array_join("roots", ",").alias("roots"), F.array_join("missing_roots", ",").alias("missing_roots"))


def _searches(spark):
    return spark.createDataFrame([(q,) for q in SEARCHES], "query string")


@query
def index_without(spark, sf):
    """The index less the files that were trashed: those of every third byte size."""
    snap = snapshot(spark, sf)
    return index.without(snap, snap.where("size % 3 = 0")).select("dir", "file", "size")


@query
def index_allowed(spark, sf):
    """Of all files those that the index knows, and may act on."""
    files = table(spark, sf, "media_files").select("dir", F.concat("stem", F.lit("."), "ext").alias("file"))
    return index.allowed(snapshot(spark, sf), files)


@query
def index_search(spark, sf):
    found = index.matching(snapshot(spark, sf), _searches(spark))
    return found.groupBy("query").agg(F.count_distinct(F.lower("base")).alias("total_groups"), F.count("*").alias("total_files"), F.sum("size").alias("bytes"))


@query
def index_search_page(spark, sf):
    return index.search(snapshot(spark, sf), _searches(spark), page=1).select("query", "rank", "base_key", "n_files", "bytes", F.array_join(F.transform("files", lambda f: F.concat(f["dir"], F.lit("/"), f["file"])), "|").alias("files"), "total_groups", "total_files")


LOOKUPS = [*SEARCHES, "#4", "X", "  Copper ", ".mkv", "a b", ""]


@query
def index_lookup(spark, sf):
    """Search through stored pieces of names, for long and short queries."""
    postings = search.build(snapshot(spark, sf).drop("carried"), fresh_dir(spark, "pieces"))
    asked = spark.createDataFrame([(q,) for q in LOOKUPS], "query string")
    return search.lookup(postings, asked).select("query", "dir", "file", "size")


@query
def index_next_page(spark, sf):
    """The third page of each query's groups, each page found from the last group of the one before."""
    grouped = materialize(search.groups(index.matching(snapshot(spark, sf), _searches(spark))), "groups")
    page = search.next_page(grouped)
    for _ in range(2):
        page = search.next_page(grouped, search.last_seen(page))
    return page.select("query", "place", "base_key", "n_files", "bytes")


@query
def episode_parse(spark, sf):
    p = parse_episode(F.col("stem"))
    return table(spark, sf, "media_files").select("path", p["base"].alias("base"), p["ep"].alias("ep"), p["variant"].alias("variant"))


@query
def episode_order_rank(spark, sf):
    rows = consolidate.episodes(table(spark, sf, "media_files"))
    key = episode_order(F.struct("base", "ep", "variant"), F.col("path"))
    return rows.select("path", "base_key", F.row_number().over(Window.partitionBy("base_key").orderBy(key)).alias("place"))


@query
def best_copy(spark, sf):
    """For each file: what it is a copy of, and whether it is the one to keep."""
    return best(spark, sf).select("path", "item_key", "keep", "rename_01", "flagged")


@query
def rename01_flags(spark, sf):
    return best(spark, sf).where("rename_01 OR flagged").select("path", "item_key", "rename_01", "flagged", "new_name")


@query
def drive_rank(spark, sf):
    return consolidate.drive_ranks(kept(spark, sf), table(spark, sf, "drives")).select("base_key", "drive", "n", "bytes", "rank")


@query
def placement_round1(spark, sf):
    drives = short_list(table(spark, sf, "drives"), consolidate.MAX_DRIVES)
    offers = consolidate.bids(kept(spark, sf), drives).where("rank = 1")
    return consolidate.accept(offers, drives.select("drive", "free_bytes"), 1_000_000).select("base_key", "drive", "incoming", "accepted")


@query
def placement(spark, sf):
    """The drive of each group in the order of work; drives with too little room send groups to the sink."""
    eps = best(spark, sf)
    return consolidate.place(eps.where("keep"), table(spark, sf, "drives"), 1_000_000, consolidate.group_sizes(eps))


@query
def consolidation_plan(spark, sf):
    plan = consolidate.consolidation_plan(table(spark, sf, "media_files"), short_list(table(spark, sf, "drives"), consolidate.MAX_DRIVES), 1_000_000)
    return plan.select("path", "item_key", "keep", "flagged", "action", "target", "evacuated", "file", "move_bytes", "collision")


@query
def group_order(spark, sf):
    """Groups in the order of work."""
    rows = consolidate.group_order(consolidate.episodes(table(spark, sf, "media_files")))
    return rows.select("base_key", F.lower("display").alias("display"), "n_files", "bytes")


@query
def running_free(spark, sf):
    """Free space of each drive after each logged step."""
    steps = table(spark, sf, "action_log").select(F.col("line_no").alias("step"), F.concat(F.lit("/vol"), (F.col("line_no") % 4).cast("string")).alias("drive"), F.when(F.col("action") == "MOVE", -F.col("bytes")).otherwise(F.col("bytes")).alias("delta"))
    return consolidate.running_free(steps, table(spark, sf, "drives")).select("step", "drive", "free_after")


@query
def free_names(spark, sf):
    """Names in one folder for each drive's files, none of which may be taken."""
    files = written(spark, sf).where("lower(ext) <> 'txt'").select("path", F.col("drive").alias("target_dir"), F.concat("stem", F.lit("."), "ext").alias("file"))
    there = files.where("path LIKE '%/d7/%'").select(F.col("target_dir").alias("dir"), "file")
    return consolidate.free_names(files, there, "S").select("path", "free_name", "problem")


@query
def evacuation(spark, sf):
    groups = consolidate.drive_sums(kept(spark, sf))
    need = table(spark, sf, "drives").where("NOT is_sink").select("drive", F.floor(F.col("free_bytes") / 4).alias("need_bytes"))
    room = table(spark, sf, "drives").where("is_sink").first()["free_bytes"]
    return consolidate.evacuation(groups, need, room=room).select("base_key", "drive", "bytes", "fits")


@query
def balance_plan(spark, sf):
    groups = consolidate.drive_sums(kept(spark, sf))
    drives = table(spark, sf, "drives").withColumn("free_bytes", F.floor(F.col("free_bytes") / F.when(F.col("is_sink"), 3).otherwise(2)))
    return consolidate.balance_plan(groups, drives, target_free=drives.agg(F.max("free_bytes")).first()[0], reserve=1000).select("base_key", "drive", "bytes", "fits")


@query
def collision_classes(spark, sf):
    files = table(spark, sf, "media_files").withColumn("file", F.concat("stem", F.lit("."), "ext"))
    moves = files.where("drive = '/vol0'").withColumn("target", F.lit("/vol1"))
    there = files.where("drive = '/vol1'").withColumn("size", F.expr("CASE WHEN size % 3 = 0 THEN size + 1 ELSE size END"))
    pairs = consolidate.collisions(moves.unionByName(moves.withColumn("target", F.lit("/vol0"))), there.unionByName(files.where("drive = '/vol0'")))
    return pairs.select("path", "target", "class")


@query
def normalize_plan(spark, sf):
    return names.normalize_plan(table(spark, sf, "raw_files"), table(spark, sf, "names"))


@query
def normalize_plain(spark, sf):
    """The rename chain without a vocabulary, keeping the casing that words have; the other form is ``normalize_all``."""
    rows = table(spark, sf, "raw_files")
    raw = F.concat(F.lit("tales of THE "), F.regexp_replace("file_name", r"\.mp4$", ""))
    return rows.select("dir", "file_name", norm.normalize(raw, keep_casing=True).alias("title"))


@query
def normalize_all(spark, sf):
    """The same over all names, with release tails."""
    return table(spark, sf, "raw_files").select("dir", "file_name", norm.normalize(F.regexp_replace("file_name", r"\.mp4$", "")).alias("title"))


@query
def restore_names(spark, sf):
    """Tails of two or three people, glued, run together or with words that no name uses up."""
    return names.restore_names(table(spark, sf, "cast_titles").select("title", F.col("title").alias("was")), table(spark, sf, "names")).select("was", "title")


@query
def harvest_names(spark, sf):
    """Names mined from file names and folders; each different stem is normalised and restored once."""
    files = table(spark, sf, "raw_files").select("dir", F.regexp_replace("file_name", r"\.mp4$", "").alias("stem"))
    stems = materialize(files.select("stem").distinct().withColumn("title", norm.normalize(F.col("stem"))), "stems")
    known = files.join(names.restore_names(stems, table(spark, sf, "names")), "stem")
    return names.mined(known, table(spark, sf, "names").select(F.concat("name", F.lit(" Movies")).alias("folder"))).select("name", "key", "source", "sightings")


@query
def vocab_merge(spark, sf):
    own = table(spark, sf, "names")
    shouted = own.select(F.upper("name").alias("name"))
    parts = table(spark, sf, "part").select(F.concat("p_brand", F.lit(" "), "p_type").alias("name"))
    return names.merge_names(own, shouted, parts)


@query
def squash_ambiguity(spark, sf):
    own = table(spark, sf, "names")
    return names.squashed(own.unionByName(own.where("name LIKE 'B%'").select(F.upper("name").alias("name"))))


@query
def vocab_edit(spark, sf):
    """The vocabulary after one rename and some deletions, and what a search then finds."""
    own = names.merge_names(table(spark, sf, "names"))
    gone = table(spark, sf, "names").where("length(name) % 5 = 0").select(F.upper("name").alias("name"))
    return names.find_names(names.delete_names(names.rename_name(own, "NO SUCH NAME", "New Entry"), gone), "e").select("name", "key")


@query
def name_length(spark, sf):
    return names.most_words(table(spark, sf, "names"))


@query
def typed_segment(spark, sf):
    """Partial lists: a known name, then the beginning of the next part's, without and with a comma between."""
    own = table(spark, sf, "names").where(F.col("name").contains(" "))
    typed = table(spark, sf, "cast_titles").select("n1", F.lower(F.substring("n2", 1, 4)).alias("p")).distinct()
    partials = typed.select(F.explode(F.array(F.concat_ws(" ", "n1", "p"), F.concat_ws(", ", "n1", "p"))).alias("partial"))
    return names.typed_segment(partials, own)


@query
def tidy_lists(spark, sf):
    """Pasted lists: two people without and with a separator, a name of three words that some vocabulary entries have, odd words in front and at the end."""
    own = table(spark, sf, "names").where(F.col("name").contains(" "))
    elders = own.where("length(name) % 3 = 0").select(F.concat("name", F.lit(" Elder")).alias("name"))
    forms = ["concat(n1, ' ', n2)", "concat(n1, ' Elder ', n2)", "concat('Lone ', n1, ' Elder ', n2, ' Elder')", "concat(lower(n1), ' elder and ', n2, ' ', n1)", "concat(n1, '; ', n2, ' & -')", "concat(n1, ' Elder ', n2, ' ', n1)"]
    text = F.expr(f"CASE form % 6 {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(forms))} END")
    lists = table(spark, sf, "cast_titles").select(text.alias("text")).distinct()
    return names.tidy_lists(lists, own.unionByName(elders)).select("text", F.array_join("people", "|").alias("people"))


@query
def shown_actions(spark, sf):
    log = table(spark, sf, "action_log").select("line_no", "action", "bytes", F.concat(F.lit("/Volumes/vol"), (F.col("line_no") % 4).cast("string"), F.lit("/f"), F.col("line_no").cast("string"), F.lit(".mp4")).alias("src"), F.lit("/Volumes/sink").alias("dest"))
    return reports.shown_actions(log).select("line_no", "shown_file", "from_drive", "to_drive", "shown_bytes")


@query
def suggest_names(spark, sf):
    partials = table(spark, sf, "part").select(F.substring("p_name", 1, 3).alias("partial"))
    return names.suggest_names(partials.distinct(), table(spark, sf, "names")).select("partial", "rank", "name", "kind")


@query
def name_worklist(spark, sf):
    return names.name_worklist(table(spark, sf, "media_files")).select("key", "title", "n_files")


@query
def batch_totals(spark, sf):
    return reports.batch_totals(ingest.ingest_match(rollup(spark, sf), table(spark, sf, "library")))


@query
def action_summary(spark, sf):
    return reports.action_counts(table(spark, sf, "action_log"))


@query
def run_summary(spark, sf):
    return reports.run_summary(table(spark, sf, "action_log"))


@query
def action_tail(spark, sf):
    return reports.action_tail(table(spark, sf, "action_log")).withColumn("ts", text("ts"))


@query
def log_round_trip(spark, sf):
    """The action log as it is written, with tabs and line ends in a field, and read again."""
    log = table(spark, sf, "action_log").select(text("ts").alias("ts"), F.lit("dry-run").alias("mode"), F.concat("grp", F.lit("\t\n#")).alias("group"), "action", F.lit("a\rb").alias("src"), F.lit(None).cast("string").alias("dest"), "bytes", "status", F.col("line_no").alias("message"))
    write_log(log, at := fresh_dir(spark, "log"))
    return read_log(spark, at).withColumnRenamed("group", "grp")


@query
def recent_terms(spark, sf):
    events = table(spark, sf, "events").select((F.col("user_id") % 20).alias("owner"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 40).cast("string")).alias("term"), "ts")
    return library.recent_terms(events).select("owner", "key", text("ts").alias("ts"), "rank")


@query
def debounce_sessions(spark, sf):
    """The bursts of each user's events, closed after half an hour."""
    rows = debounced(table(spark, sf, "events"), key="user_id", gap="30 minutes")
    return rows.select("user_id", text("started").alias("started"), text("last").alias("last"), text("due").alias("due"), "n")


@query
def debounce_all(spark, sf):
    """The bursts of every event type."""
    rows = debounced(table(spark, sf, "events"), gap="10 minutes")
    return rows.select("event_type", text("started").alias("started"), text("last").alias("last"), text("due").alias("due"), "n")


@query
def stale_runs(spark, sf):
    """Index builds, which are stale after two minutes: each user's last event of each kind."""
    events = table(spark, sf, "events").select(F.concat_ws("/", "event_type", "user_id").alias("run"), "ts")
    now = events.agg(F.max("ts")).first()[0]
    return stale(events, F.lit(now), 120).select("run", text("last").alias("last"), "stale")


@query
def stale_all(spark, sf):
    """The last heartbeat of every run, whoever sent it."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("run"), "ts")
    return stale(events, F.lit(events.agg(F.max("ts")).first()[0]), 300).select("run", text("last").alias("last"), "stale")


@query
def titles_natural(spark, sf):
    """Titles by the natural order's key."""
    return table(spark, sf, "library").select("id", natural_key(F.col("title")).alias("sort_key"))
