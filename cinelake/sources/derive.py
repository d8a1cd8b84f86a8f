"""Input tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEDIA_FILES = """
SELECT drive, dir, stem, ext, concat(dir,'/',stem,'.',ext) AS path, max(size) AS size, max(mtime) AS mtime
FROM (
 SELECT concat('/vol', CAST(l_suppkey % 4 AS VARCHAR(9))) AS drive,
  concat('/vol', CAST(l_suppkey % 4 AS VARCHAR(9)), '/', CASE WHEN l_orderkey % 13 = 0 THEN 'duplicates' ELSE 'recorded' END, '/d', CAST(l_orderkey % 50 AS VARCHAR(9))) AS dir,
  concat(p_name,' ',p_type,' ',p_brand,
   CASE WHEN l_linenumber=1 THEN '' ELSE concat(' # 0', CAST(l_linenumber-1 AS VARCHAR(9))) END,
   CASE WHEN l_returnflag='A' THEN ''
        WHEN l_returnflag='R' THEN concat(' - Scene_', CAST(CAST(l_quantity AS INT) % 3 + 1 AS VARCHAR(9)))
        ELSE concat(' - CD', CAST(CAST(l_quantity AS INT) % 2 + 1 AS VARCHAR(9))) END) AS stem,
  CASE WHEN l_orderkey % 11 = 0 THEN 'txt' WHEN l_orderkey % 7 = 0 THEN 'MKV' ELSE 'mp4' END AS ext,
  CAST(round(l_extendedprice*100) AS BIGINT) AS size, l_shipdate AS mtime
 FROM lineitem JOIN part ON l_partkey = p_partkey) t
GROUP BY drive, dir, stem, ext
"""

LIBRARY = """
SELECT b.id, CASE b.id % 4 WHEN 0 THEN base WHEN 1 THEN concat(base,' # 01') WHEN 2 THEN concat(base,' # 02') ELSE upper(base) END AS title,
 CASE b.id % 5 WHEN 0 THEN '' WHEN 1 THEN '0 x 0' ELSE '1920 x 1080' END AS dimensions,
 CASE WHEN b.id % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(b.id % 5000 AS DOUBLE) + 0.4 END AS duration,
 CASE WHEN b.id % 7 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(round(price*5000) AS BIGINT) END AS filesize,
 o_orderdate AS date_created
FROM (SELECT concat(p_name,' ',p_type,' ',p_brand) AS base, min(p_partkey) AS id, max(p_retailprice) AS price FROM part GROUP BY concat(p_name,' ',p_type,' ',p_brand)) b
LEFT JOIN orders ON o_orderkey = b.id
"""

NAMES = """
SELECT DISTINCT concat(upper(substr(split_part(p_name,' ',1),1,1)), substr(split_part(p_name,' ',1),2),' ',
 upper(substr(split_part(p_name,' ',2),1,1)), substr(split_part(p_name,' ',2),2)) AS name FROM part
"""

RAW_FILES = """
SELECT concat('/stage/d', CAST(l_orderkey % 50 AS VARCHAR(9))) AS dir,
 concat(replace(lower(concat(p_type,' ',p_brand)),' ','.'),'.scene.',CAST(l_linenumber AS VARCHAR(9)),'.',
  upper(substr(split_part(p_name,' ',1),1,1)), substr(split_part(p_name,' ',1),2),
  upper(substr(split_part(p_name,' ',2),1,1)), substr(split_part(p_name,' ',2),2),
  CASE WHEN l_returnflag='A' THEN '.1080p.x264-GRP' ELSE '' END, '.mp4') AS file_name
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1,2
"""

# Two people of the vocabulary behind a scene, with and without what no name uses up.
CAST_TITLES = """
SELECT DISTINCT concat('Take ', CAST(a AS VARCHAR(9)), ' - Scene_', CAST(a % 3 + 1 AS VARCHAR(9)), ' - ',
 CASE a % 7 WHEN 0 THEN concat(n1, ' ', n2) WHEN 1 THEN concat(n1, ' Extended Cut') WHEN 2 THEN concat('Late ', n1, ' ', n2) WHEN 3 THEN concat(replace(n1, ' ', ''), ' ', replace(lower(n2), ' ', ''))
  WHEN 4 THEN concat(n1, ', ', n2) WHEN 5 THEN concat(n1, ' ', n2, ' ', n1) ELSE concat(n1, ' ', n2, ', ', n2, ' at Night') END) AS title, n1, n2, a % 7 AS form
FROM (SELECT x.p_partkey AS a, x.n AS n1, y.n AS n2 FROM
 (SELECT p_partkey, concat(upper(substr(split_part(p_name,' ',1),1,1)), substr(split_part(p_name,' ',1),2),' ', upper(substr(split_part(p_name,' ',2),1,1)), substr(split_part(p_name,' ',2),2)) AS n FROM part) x JOIN
 (SELECT p_partkey, concat(upper(substr(split_part(p_name,' ',1),1,1)), substr(split_part(p_name,' ',1),2),' ', upper(substr(split_part(p_name,' ',2),1,1)), substr(split_part(p_name,' ',2),2)) AS n FROM part) y ON y.p_partkey = x.p_partkey + 1) t
"""

DRIVES = "SELECT drive, CASE WHEN drive='/vol3' THEN true ELSE false END AS is_sink, CAST(floor(sum(size)/10) AS BIGINT) AS free_bytes FROM media_files GROUP BY drive"

ACTION_LOG = """
SELECT event_id AS line_no, ts, concat('group ', CAST(user_id AS VARCHAR(9))) AS grp,
 CASE event_type WHEN 'purchase' THEN 'MOVE' WHEN 'view' THEN 'GROUP_DONE' WHEN 'click' THEN 'MOVE_DUP' WHEN 'signup' THEN 'RENAME_01' ELSE 'MKDIR_DUP' END AS action,
 CAST(round(value*1000000) AS BIGINT) AS bytes,
 CASE WHEN event_type='error' THEN 'FAIL' WHEN event_id % 10 = 0 THEN 'SKIP' ELSE 'OK' END AS status FROM events
"""

PROBE_RAW = """
SELECT path, CASE WHEN length(stem) % 17 = 0 THEN 'not json{' ELSE concat('{"streams":[{"codec_type":"audio"},{"width":', CAST(size % 1921 AS VARCHAR(9)), ',"height":', CAST(size % 1081 AS VARCHAR(9)), '}],"format":{"duration":"', CAST(size % 7200 AS VARCHAR(9)), '.7"}}') END AS raw FROM media_files
"""

TABLES = {"media_files": MEDIA_FILES, "library": LIBRARY, "names": NAMES, "raw_files": RAW_FILES, "cast_titles": CAST_TITLES, "drives": DRIVES, "action_log": ACTION_LOG, "probe_raw": PROBE_RAW}
_INPUTS = {"media_files": ["lineitem", "part"], "library": ["part", "orders"], "names": ["part"], "raw_files": ["lineitem", "part"], "cast_titles": ["part"], "drives": ["media_files"], "action_log": ["events"], "probe_raw": ["media_files"]}


#: What MEDIA_FILES appends to a part's text, where that text itself ends so.
ENDS = r"((?: # 0-?\d+| - (?:Scene_|CD)-?\d+)*)$"


def media_files(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """MEDIA_FILES, but only numbers are shuffled: the order lines get the number of their part's text, are grouped by it and by what the other names are made of, packed in one
    number, and the names are written last."""
    base = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand")
    parts = part.select("p_partkey", base.alias("base")).withColumn("end", F.regexp_extract("base", ENDS, 1)).withColumn("root", F.expr("left(base, length(base) - length(end))"))
    # A text's number is its least part key; texts that share that (a part key may be repeated) are told apart by ``nth``.
    same = Window.partitionBy("root")
    parts = parts.withColumn("text", F.when(F.col("root").isNotNull(), F.min("p_partkey").over(same))).withColumn("ends", F.max(F.col("end") != "").over(same))
    parts = parts.withColumn("nth", F.dense_rank().over(Window.partitionBy("text").orderBy("root"))).drop("base")
    # In packed: the line number, and below it drive (0: null), folder (0: null), extension and what is behind the title (0: null).
    drive, day, shelved = F.expr("l_suppkey % 4"), F.expr("l_orderkey % 50"), F.expr("CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END")
    folder = F.when(day.isNotNull() & drive.isNotNull(), (day + 50) * 2 + shelved)
    kind = F.expr("CASE WHEN l_orderkey % 11 = 0 THEN 0 WHEN l_orderkey % 7 = 0 THEN 1 ELSE 2 END")
    behind = F.expr("CASE WHEN l_linenumber IS NULL THEN NULL WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) % 3 + 11 ELSE CAST(l_quantity AS INT) % 2 + 21 END")
    packed = F.when(behind.isNotNull(), F.col("l_linenumber").cast("long")).otherwise(F.lit(0))
    for value, bits in ((drive + 4, 3), (folder, 8), (kind, 2), (behind, 5)):
        packed = packed * (1 << bits) + F.coalesce(value, F.lit(0))
    number, field = F.shiftright("packed", 18), lambda low, bits: F.shiftright("packed", low).bitwiseAND(F.lit((1 << bits) - 1))
    drive, folder, kind, behind = field(15, 3), field(7, 8), field(5, 2), field(0, 5)
    scene = F.when(behind == 1, "").when(behind < 15, F.concat(F.lit(" - Scene_"), (behind - 11 + 1).cast("string"))).otherwise(F.concat(F.lit(" - CD"), (behind - 21 + 1).cast("string")))
    tail = F.concat(F.when(number == 1, "").otherwise(F.concat(F.lit(" # 0"), (number - 1).cast("string"))), scene)

    lines = lineitem.select("l_partkey", packed.cast("long").alias("packed"), F.expr("CAST(round(l_extendedprice*100) AS BIGINT)").alias("size"), F.col("l_shipdate").alias("mtime"))
    rows = lines.join(parts.drop("root"), F.col("l_partkey") == F.col("p_partkey"))
    known = (behind > 0) & F.col("text").isNotNull()  # else the stem is null
    written = F.when(known & F.col("ends"), F.concat("end", tail))  # where the same tail can come about in several ways
    rest = F.col("packed").bitwiseAND(F.lit((1 << 18) - (1 << 5)))
    rows = rows.select(F.when(known, F.col("text")).alias("text"), F.when(known, F.col("nth")).alias("nth"), written.alias("written"), F.when(known & ~F.col("ends"), F.col("packed")).otherwise(rest).alias("packed"), "size", "mtime")
    rows = rows.repartition("text", "nth").groupBy("text", "nth", "written", "packed").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    rows = rows.join(parts.where("text IS NOT NULL").groupBy("text", "nth").agg(F.first("root").alias("root")), ["text", "nth"], "left")
    volume = F.when(drive > 0, F.concat(F.lit("/vol"), (drive - 4).cast("string")))
    at = F.when(folder > 0, F.concat(volume, F.when(folder % 2 == 1, "/duplicates/d").otherwise("/recorded/d"), (F.shiftright(folder, 1) - 50).cast("string")))
    stem = F.concat("root", F.coalesce("written", tail))
    rows = rows.select(volume.alias("drive"), at.alias("dir"), stem.alias("stem"), F.when(kind == 0, "txt").when(kind == 1, "MKV").otherwise("mp4").alias("ext"), "size", "mtime")
    return rows.select("drive", "dir", "stem", "ext", F.concat("dir", F.lit("/"), "stem", F.lit("."), "ext").alias("path"), "size", "mtime")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables in ``sf_dir``, or such a table itself."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "media_files":
        return media_files(*(derived(spark, sf_dir, x) for x in _INPUTS[name]))
    sql = TABLES[name].replace("VARCHAR(9)", "STRING").replace("{", "{{").replace("}", "}}")
    inputs = {x: derived(spark, sf_dir, x) for x in _INPUTS[name]}
    for x in inputs:
        sql = sql.replace(f"FROM {x}", f"FROM {{{x}}} {x}").replace(f"JOIN {x} ", f"JOIN {{{x}}} {x} ")
    return spark.sql(sql, **inputs)


def ctes(*names: str) -> str:
    """The same tables as a WITH clause for the oracle, without its last comma."""
    need = list(dict.fromkeys(x for n in names for x in (*(["media_files"] if n in ("drives", "probe_raw") else []), n)))
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in need)
