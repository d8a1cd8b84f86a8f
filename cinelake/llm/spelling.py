"""Spelling variants: words that one inserted, deleted or replaced code point tells apart, found by asymmetric chunks.

The shorter word of a pair (of two equally long ones, either) is cut into two disjoint chunks, its halves. One edit leaves a chunk as it was,
the first at its place, the second at its place or one further on in a longer word. The other word gives its positional grams; those of a
length and place that no chunk can have within that shift aren't written. Words meet by (length, chunk, place) and are verified by their edit distance.

A chunk that many words share (PAIRS) isn't joined: the half that the edit must be in is halved again, so that these words meet by the chunk and
three quarters of the rest, and so on until groups are small or the edit has one place left, where a group holds at most one word for each
letter or pair of letters. Candidates so stay in proportion to words, and no link is lost.

Texts without words, empty and null texts give none. A null id counts as the empty text. Rows equal in id and text count each. An empty table
gives no words. Extra columns are ignored; very long texts and words are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare

#: Different words that a task counts before it sends their counts on.
HELD = 200_000
#: Candidates for each word of a group above which the group is split.
PAIRS = 32

_runs = re.compile(rb"[a-z\xc0-\xff]+").findall


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, a byte for each code point (Latin-1)."""
    return _runs(text.encode("latin-1", "replace").lower()) if text else []


def counts(docs: DataFrame, shortest: int, drop: int | None = None) -> DataFrame:
    """(word, n): how often each word of at least ``shortest`` code points occurs. ``drop``: where it divides the CRC of ``<doc_id>:<word>``, the word
    loses the code point at that value modulo its length."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for word, n in Counter(words_of(text.as_py())).items():
                    if drop and not (h := zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)) % drop:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        found[word] += n
                if len(found) >= HELD:
                    yield out()
                    found.clear()
        yield out()

    parts = docs.select(F.col("doc_id").cast("string").alias("d"), F.col("text").alias("t")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _signatures(rows: DataFrame) -> DataFrame:
    """Adds ``key`` to (word, length, longer, cuts, part): what stands left and right of the part of a word of ``length`` that the edit must be in."""
    first, last = _bounds()
    behind = F.col("length") - last
    right = F.substring("word", F.length("word") - behind + 1, behind)
    return rows.withColumn("key", F.concat_ws("|", "cuts", "part", "length", F.substring(F.col("word"), F.lit(1), first), right))


def _bounds() -> tuple[Column, Column]:
    """Where the part begins and ends: the ``part``-th of ``cuts`` equal parts of the length."""
    edge = lambda i: F.floor(i * F.col("length") / F.col("cuts")).cast("int")
    return edge(F.col("part")), edge(F.col("part") + 1)


def near(words: DataFrame, shortest: int) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of (word, n), once. Words have at least ``shortest`` code points."""
    length = F.length("word")
    roles = F.array(F.struct(length.alias("length"), F.lit(False).alias("longer")), F.struct((length - 1).alias("length"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*").where(F.col("length") >= shortest)
    rows = rows.withColumn("cuts", F.lit(2)).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    found, live = [], []
    while True:
        keyed = materialize(_signatures(rows), "chunks")
        live.append(keyed)
        c0, c1 = F.count_if(~F.col("longer")), F.count_if("longer")
        pairs = c0 * (c0 - 1) / 2 + c0 * c1
        sizes = keyed.groupBy("key").agg(c0.alias("c0"), (pairs > PAIRS * (c0 + c1)).alias("many"), F.count("*").alias("c")).where("c0 > 0 AND c > 1").select("key", "many")
        known = materialize(keyed.join(sizes, "key"), "groups")
        live.append(known)
        first, last = _bounds()
        split = F.col("many") & (last - first > 1)
        small = known.where(~split)
        a = small.where("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = small.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        found.append(materialize(a.join(b, "key").where((F.col("longer") | (F.col("b") > F.col("a"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b"), "near"))
        rows = known.where(split).drop("key", "many").withColumn("cuts", F.col("cuts") * 2).withColumn("part", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)))
        if known.where(split).isEmpty():
            break
    out = materialize(reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"]), "pairs")
    for x in (*live, *found):
        discard(x)
    return out


def forms(words: DataFrame, shortest: int, ratio: int) -> DataFrame:
    """(word, n, n_near, form, form_n) of (word, n): the form is the near word that occurs most often (of equals the least), if ``ratio`` times as often as the word."""
    pairs = near(words, shortest)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    rows = words.join(best, "word", "left")
    often = -F.col("best.m") >= ratio * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form) with a form: the last form of the chain. Each round doubles the steps; counts grow along a chain, so it ends."""
    at = materialize(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = joined
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def report(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, drop: int | None = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words with at least ``shortest`` code points and ``least`` occurrences."""
    words = materialize(counts(docs, shortest, drop).where(F.col("n") >= least), "words")
    formed = materialize(forms(words, shortest, ratio), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + ord(x) // 64 AS BIGINT), CAST(128 + ord(x) % 64 AS BIGINT)] END))"
_CRC = "xor(list_reduce([4294967295] || {0}, lambda c, b: list_reduce([xor(c, b)] || range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)".replace("{0}", _BYTES)
SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY 1, 2),
h AS (SELECT w, c, CAST({_CRC.format("concat(doc_id, ':', w)")} AS BIGINT) AS h FROM r),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, c FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
  UNION SELECT d.word, w.word FROM d JOIN words w ON d.d = w.word
  UNION SELECT w.word, d.word FROM d JOIN words w ON d.d = w.word),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS m FROM pairs JOIN words ON b = word GROUP BY 1),
tied AS (SELECT p.a AS word, n_near, m, min(p.b) AS other FROM pairs p JOIN words w ON p.b = w.word JOIN best ON best.word = p.a AND w.n = m GROUP BY 1, 2, 3),
f AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN tied ON tied.word = words.word),
walk AS (SELECT word, form AS top FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.top = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, top FROM walk JOIN f ON f.word = top WHERE f.form IS NULL)
SELECT f.word, form, coalesce(top, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON ends.word = f.word
"""
