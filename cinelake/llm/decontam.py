"""Benchmark decontamination through a distributed positional inverted index.

``build_index`` stores token postings as a table with one row per segment (a bounded run of whole
documents): for each term the ascending word positions at which it stands in the segment. A query
reads each segment on its own, so nothing is shuffled: for each test window it takes the rarest
term's list first (document frequency over the whole index), shifts every list by the term's offset
and intersects list after list until none is left or the phrase is found. A proximity match lets each term stand up to some words from
its place, counted from the rarest term's. A segment looks up the windows whose rarest term it holds, not all.

Words are maximal runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. Null and
empty texts have no words, and an item without words has no window. A repeated document row is
indexed and reported once for each row. Ids may have any type. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, row_key

#: Words of a segment; a longer document makes a segment of its own.
SEGMENT_WORDS = 400_000
#: Positions between two documents of a segment, more than any window and slop.
GAP = 4096
#: Bytes of test texts that are broadcast at once; larger test sets run in several blocks.
BLOCK_BYTES = 16_000_000
#: Words that a term may stand from its place in the proximity matches of the report.
NEAR = 2

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: str | None) -> list[bytes]:
    return _words(text.encode("utf-8", "surrogatepass").lower()) if text else []


INDEX = "segment string, doc_ids array<string>, firsts array<int>, lengths array<int>, terms array<binary>, starts array<int>, positions array<int>, dfs array<int>"


def build_index(docs: DataFrame, terms: set[bytes] | Broadcast | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of postings; ``terms`` keeps the postings of a bounded query vocabulary only (None: of all words)."""
    prepare(docs.sparkSession)
    wanted = terms if isinstance(terms, Broadcast) else docs.sparkSession.sparkContext.broadcast(terms)

    def segment(ids: list, texts: list[list[bytes]], keep: set[bytes] | None) -> pd.DataFrame:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.concatenate(([0], np.cumsum(lengths + GAP)[:-1])).astype(np.int64)
        numbers: dict[bytes, int] = {}
        codes, places, owners = [], [], []
        for d, found in enumerate(texts):
            own = np.fromiter((numbers.setdefault(w, len(numbers)) if keep is None or w in keep else -1 for w in found), np.int64, len(found))
            at = np.flatnonzero(own >= 0)
            codes.append(own[at])
            places.append(at + firsts[d])
            owners.append(np.full(len(at), d))
        code, place, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, places, owners))
        order = np.argsort(code, kind="stable")
        code, place, owner = code[order], place[order], owner[order]
        starts = np.searchsorted(code, np.arange(len(numbers) + 1))
        fresh = np.concatenate(([1], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))).astype(np.int64)[: len(code)]
        dfs = np.add.reduceat(fresh, starts[:-1]) if len(numbers) else np.zeros(0, np.int64)
        name = hashlib.md5(repr((ids[:1], ids[-1:], len(ids), len(code))).encode()).hexdigest()
        return pd.DataFrame({"segment": [name], "doc_ids": [ids], "firsts": [firsts.astype(np.int32)], "lengths": [lengths.astype(np.int32)], "terms": [list(numbers)], "starts": [starts.astype(np.int32)], "positions": [place.astype(np.int32)], "dfs": [dfs.astype(np.int32)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep, ids, texts, total = wanted.value, [], [], 0
        for frame in frames:
            for i, t in zip(frame.iloc[:, 0].tolist(), frame.iloc[:, 1].tolist(), strict=True):
                found = words(t)
                if texts and total + len(found) + GAP > SEGMENT_WORDS:
                    yield segment(ids, texts, keep)
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(found)
                total += len(found) + GAP // 16
        if texts:
            yield segment(ids, texts, keep)

    return docs.select(F.col(id_column).cast("string").alias("i"), F.col(text).alias("t")).mapInPandas(run, INDEX)


class Segment:
    """One row of the index."""

    def __init__(self, row):
        self.ids, self.firsts, self.lengths = row.doc_ids, np.asarray(row.firsts), np.asarray(row.lengths)
        self.number = {bytes(t): k for k, t in enumerate(row.terms)}
        self.starts, self.positions = np.asarray(row.starts), np.asarray(row.positions)

    def postings(self, term: bytes) -> np.ndarray:
        k = self.number.get(term)
        return self.positions[:0] if k is None else self.positions[self.starts[k] : self.starts[k + 1]]

    def phrase(self, order: list[tuple[bytes, int]]) -> np.ndarray:
        """First positions of the phrase whose (term, offset) pairs come rarest first."""
        found = None
        for term, offset in order:
            own = self.postings(term)
            if not len(own):
                return own
            if found is None:
                found = own - offset
                continue
            at = np.searchsorted(own, found + offset)
            found = found[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == found + offset)]
            if not len(found):
                break
        return found if found is not None else self.positions[:0]

    def near(self, order: list[tuple[bytes, int]], slop: int) -> np.ndarray:
        """Positions where the phrase would start if each term may stand up to ``slop`` words from its place."""
        found = None
        for term, offset in order:
            own = self.postings(term)
            if not len(own):
                return own
            if found is None:
                found = own - offset
                continue
            at = np.searchsorted(own, found + offset - slop)
            found = found[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= found + offset + slop)]
            if not len(found):
                break
        return found if found is not None else self.positions[:0]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, positions, side="right") - 1


def windows(items: list[tuple[str, str | None]], size: int) -> dict[tuple[bytes, ...], list[int]]:
    """Each distinct window and the numbers of its items."""
    found: dict[tuple[bytes, ...], list[int]] = {}
    for k, (_, text) in enumerate(items):
        own = words(text)
        for w in {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else ():
            found.setdefault(w, []).append(k)
    return found


def blocks(items: DataFrame, size_column: str = "text") -> Iterator[list[tuple[str, str | None]]]:
    """The stated query set in blocks of a checked size; a test set is read block by block, never held whole."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequencies(index: DataFrame) -> dict[bytes, int]:
    """Document frequency over the whole index; the terms are those of one block, so their number is bounded."""
    z = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("z"))
    return {bytes(r[0]): r[1] for r in z.groupBy("z.terms").agg(F.sum("z.dfs").alias("df")).collect()}


def _ordered(found: dict[tuple[bytes, ...], list[int]], df: dict[bytes, int]) -> list[tuple[list[tuple[bytes, int]], int, list[int]]]:
    """Windows all of whose terms are indexed, as ((term, offset) rarest first, length, items)."""
    return [(sorted(((t, o) for o, t in enumerate(w)), key=lambda x: (df[x[0]], x[1])), len(w), k) for w, k in found.items() if all(t in df for t in w)]


MATCHES = "doc_id string, n_words bigint, hits array<int>, items array<string>, near array<string>"


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, near: int = 0) -> DataFrame:
    """One row per document row: its word count, hit word positions, ids of the ``items`` (item_id, text) found, and ids of those with a proximity match within ``near`` words (none for 0).

    slop 0: exact phrases. slop > 0: proximity; then the words hit are those of the matching span.
    Several blocks of items are matched one after the other, and their hits joined by row key: rows equal in id and text have equal hits.
    """
    if size + max(slop, near) >= GAP:
        raise ValueError(f"windows and slop of {GAP} words or more would reach into the next document")
    stream = blocks(items.select(F.col("item_id").cast("string"), "text"))
    block, following = next(stream, []), next(stream, None)
    kind = docs.schema["doc_id"].dataType
    if following is None:
        found = _matched(docs, block, size, slop, near)[0]
        return found.withColumn("doc_id", F.col("doc_id").cast(kind))
    keyed = docs.select(row_key().alias("doc_id"), "text")
    counts, parts = None, []
    for block in chain([block, following], stream):
        found, index, queries = _matched(keyed, block, size, slop, near)
        some = (F.size("hits") > 0) | (F.size("near") > 0)
        found = materialize(found if counts is None else found.where(some), "hits")
        if counts is None:
            counts = found.groupBy("doc_id").agg(F.first("n_words").alias("n_words"))
        parts.append(found.where(some).dropDuplicates(["doc_id"]).select("doc_id", "hits", "items", "near"))
        discard(index)
        for q in queries:
            q.destroy()
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(union("hits"), union("items"), union("near"))
    by_key = counts.join(hits, "doc_id", "left").withColumnRenamed("doc_id", "__key")
    kept = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    rows = docs.select("doc_id", row_key().cast("string").alias("__key")).join(by_key, "__key")
    return rows.select("doc_id", "n_words", kept("hits", "array<int>"), kept("items", "array<string>"), kept("near", "array<string>"))


def _matched(docs: DataFrame, block: list[tuple[str, str | None]], size: int, slop: int, near: int) -> tuple[DataFrame, DataFrame, list[Broadcast]]:
    """One block's matches, and what they read: the index and the broadcasts."""
    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    found = windows(block, size)
    terms = context.broadcast({t for w in found for t in w})
    index = materialize(build_index(docs, terms), "postings")
    by_rarest: dict[bytes, list] = {}
    for phrase in _ordered(found, _frequencies(index)):
        by_rarest.setdefault(phrase[0][0][0], []).append(phrase)
    query = context.broadcast(([i for i, _ in block], by_rarest))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, phrases = query.value
        for frame in frames:
            for row in frame.itertuples(index=False):
                seg = Segment(row)
                hit: list[set[int]] = [set() for _ in seg.ids]
                got: list[set[str]] = [set() for _ in seg.ids]
                close: list[set[str]] = [set() for _ in seg.ids]
                for order, length, own in chain.from_iterable(phrases[t] for t in seg.number if t in phrases):
                    found = [names[k] for k in own if names[k] is not None]
                    if near:
                        at = seg.near(order, near)
                        for d in set(seg.owner(at + order[0][1]).tolist()):
                            close[d].update(found)
                        if not len(at):  # no phrase without a proximity match
                            continue
                    at = seg.near(order, slop) if slop else seg.phrase(order)
                    for p, d in zip(at.tolist(), seg.owner(at + order[0][1]).tolist(), strict=True) if len(at) else ():
                        first = p - int(seg.firsts[d])
                        hit[d].update(range(max(0, first - slop), min(first + length + slop, int(seg.lengths[d]))))
                        got[d].update(found)
                yield pd.DataFrame({"doc_id": pd.Series(list(seg.ids), dtype=object), "n_words": seg.lengths.astype(np.int64), "hits": [sorted(x) for x in hit], "items": [sorted(x) for x in got], "near": [sorted(x) for x in close]})

    return index.select("doc_ids", "firsts", "lengths", "terms", "starts", "positions").mapInPandas(run, MATCHES), index, [terms, query]


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the rows that hold an exact phrase of a test item."""
    keyed = docs.withColumn("__key", row_key())
    marked = matches(keyed.select(F.col("__key").alias("doc_id"), "text"), items, size).where(F.size("hits") > 0).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(materialize(marked, "contaminated"), "__key", "left_anti").select(*docs.columns)


def report(docs: DataFrame, items: DataFrame, size: int = 10, near: int = NEAR) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and n_near, the items with a proximity match."""
    found = matches(docs, items, size, near=near)
    found = found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.size("near").cast("long").alias("n_near"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "n_near")
