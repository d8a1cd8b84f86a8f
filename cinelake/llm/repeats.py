"""Substring deduplication by prefix-partitioned suffix trees.

A suffix here starts at a word, and its tree path ends after ``size`` words.

1. Prefixes are counted. A suffix's prefix runs from its start through the first place of its landmark, the ``LANDMARK``-word gram with the smallest hash
   among those that lie in its window; equal windows have equal prefixes, and neighbouring suffixes share their landmark, so a run of them is one entry.
   A prefix that stands in one run only has no inner node and goes.
2. Prefixes become groups of at most ``BOUND`` suffixes: the suffixes of a landmark stay together; a landmark beyond half the bound is split by
   the words ahead of it; what is still beyond takes the whole window as its prefix, and such a group is one node whose leaves a salted
   aggregation counts.
3. Each group gets its suffixes' words and builds its tree: suffixes in the order of their words (names of runs of 1, 2, 4 ... words, each ranked from
   two of the names before), and the longest common prefixes of neighbours. Neighbours with ``size`` words in common are leaves of one deep inner node, a repeat.
   Neighbouring repeated starts of a row join into maximal repeats (row, start, end).

A passage in a third of all rows doesn't gather in one group: each batch of rows first finds what it repeats itself, reports that, and sends one leaf for
each such window.

Hashes choose groups and candidates only: words are told apart by their bytes, within a batch and within a group, and windows by their words.
Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words and keep the hash of the empty string; texts shorter than a window lose
nothing. Rows equal in id and text repeat each other; a repeated id with another text is a row of its own. Extra columns are ignored by ``report`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, groups_for, join_salted, materialize, prepare, row_key, small_batches
from .wordhash import Words, mix, pieces, run_hashes, sliding_min, words_of

#: Words of a landmark gram.
LANDMARK = 8
#: Bytes of text hashed at once in a worker; a longer document is hashed alone.
CHUNK = 6_000_000
#: MB of text whose landmarks are counted in one bucket.
BUCKET_MB = 24
#: Suffixes of a group, whose words and names a task holds at once.
BOUND = 400_000
#: Bytes of words with equal hashes compared at once.
COMPARED = 1 << 18

COUNTED = "bucket bigint, marks binary, rows binary, starts binary, counts binary, ahead binary"
#: ``part``: the group, or KNOWN (``size`` words from each start are repeated), or WHOLE (the window itself is the prefix).
PARTS = "row_key bigint, start int, count int, part bigint"
KNOWN, WHOLE = -1, -2
REPEATS = "row_key bigint, start int, stop int"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _pack(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of ``x``, which values in it equal the one before, and each value's place among the distinct ones in 32 bits."""
    order = np.argsort(x, kind="stable").astype(np.int32)
    ordered = x[order]
    same = ordered[1:] == ordered[:-1]
    del ordered
    rank = np.zeros(len(x), np.uint32)
    rank[order[1:]] = np.cumsum(~same, dtype=np.uint32)
    return order, same, rank


def _alike(found: Words, one: np.ndarray, two: np.ndarray) -> bool:
    """Whether the words ``one`` have the bytes of the words ``two``, pair by pair."""
    length = found.ends[one] - found.starts[one]
    if not (length == found.ends[two] - found.starts[two]).all():
        return False
    edges = np.append(np.flatnonzero(np.diff((np.cumsum(length) - 1) // COMPARED, prepend=-1)), len(one))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        n = length[a:b]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not (found.data[np.repeat(found.starts[one[a:b]], n) + step] == found.data[np.repeat(found.starts[two[a:b]], n) + step]).all():
            return False
    return True


def word_names(found: Words) -> np.ndarray:
    """A number for each word, equal for words with equal bytes only."""
    order, same, name = _ranks(found.hashes)
    if not _alike(found, order[:-1][same], order[1:][same]):  # two words with one hash
        raw, known = found.data.tobytes(), {}
        name = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)], np.uint32)
    return name


def _spans(rows: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins neighbouring repeated starts (sorted) into (row, start, end)."""
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + 1)))) if len(rows) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [len(rows)])) - 1 if len(rows) else new
    return rows[new], starts[new], starts[last] + size


def _repeated(found: Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a batch, of those that start ``at``, with the same words as another: each, and the next with the same words."""
    path = run_hashes(found.hashes, size)[at]
    order = np.argsort(path).astype(np.int32)
    path = path[order]
    same = path[1:] == path[:-1]
    del path
    one, two = at[order[:-1][same]], at[order[1:][same]]
    del order
    if len(one):  # equal fingerprints: look at the words
        name, alike = word_names(found), np.ones(len(one), bool)
        for j in range(size):
            alike &= name[one + j] == name[two + j]
        one, two = one[alike], two[alike]
    return one, two


def _batch(keys: np.ndarray, found: Words, size: int, buckets: int) -> pd.DataFrame | None:
    # A worker holds a batch beside the executor's heap, so arrays are in 32 bits where they can be, and each goes before the next are made.
    flat, lengths = found.hashes, found.lengths
    if len(flat) < size:
        return None
    ends, n = np.cumsum(lengths), len(flat) - size + 1
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[:n]
    at = np.flatnonzero(np.arange(n) + size <= ends[doc]).astype(np.int32)
    if not len(at):
        return None
    one, two = _repeated(found, at, size)
    deep, send = np.zeros(n, bool), np.zeros(n, bool)
    deep[one] = deep[two] = True
    send[at] = True
    send[two] = False  # one leaf stands for the others
    del at, one, two
    grams = run_hashes(flat, LANDMARK)
    mark = sliding_min(grams, size - LANDMARK + 1)
    frames = []
    known = np.flatnonzero(deep)
    start = (np.arange(n) - (ends - lengths)[doc]).astype(np.int32)
    r, s, e = _spans(doc[known], start[known], size)
    if len(r):  # known repeats pass through the exchange, dealt by their row
        frames.append(_deal(keys[r].view(np.uint64) % np.uint64(buckets), lambda i: (b"", _pack(keys[r[i]], np.int64), _pack(s[i], np.int32), _pack(e[i] - s[i] - size + 1, np.int32), b"")))
    i = np.flatnonzero(send)
    # A run ends where its landmark's first place is left behind, so all of it has one place.
    head = i[np.concatenate(([True], (i[1:] != i[:-1] + 1) | (mark[i[1:]] != mark[i[:-1]]) | (doc[i[1:]] != doc[i[:-1]]) | (grams[i[:-1]] == mark[i[:-1]])))]
    count = np.diff(np.append(np.searchsorted(i, head), len(i)))
    ahead = np.full(len(head), -1)
    for d in range(size - LANDMARK + 1):
        ahead[(ahead < 0) & (grams[head + d] == mark[head])] = d
    frames.append(_deal(mix(mark[head]) % np.uint64(buckets), lambda j: (_pack(mark[head[j]], np.uint64), _pack(keys[doc[head[j]]], np.int64), _pack(start[head[j]], np.int32), _pack(count[j], np.int32), _pack(ahead[j], np.int32))))
    return pd.concat(frames, ignore_index=True)


def _deal(bucket: np.ndarray, row) -> pd.DataFrame:
    bucket = bucket.astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
    return pd.DataFrame([(int(bucket[j[0]]), *row(j)) for j in np.split(order, cut[1:])], columns=["bucket", "marks", "rows", "starts", "counts", "ahead"])


def _packed(sizes: np.ndarray, bound: int) -> np.ndarray:
    """Numbers of groups of at most ``bound``, for prefixes of at most half of that each."""
    return (np.cumsum(sizes) - sizes) // max(1, bound // 2)


def _group(frame: pd.DataFrame, bound: int) -> pd.DataFrame:
    """One bucket: prefixes in one run go, the others are dealt into groups."""
    known = frame["marks"].str.len() == 0
    joined = lambda c, kind, of: np.frombuffer(b"".join(frame.loc[of, c]), kind)
    out = [pd.DataFrame({"row_key": joined("rows", np.int64, known), "start": joined("starts", np.int32, known), "count": joined("counts", np.int32, known), "part": KNOWN})]
    mark, rows, starts, counts, ahead = (joined(c, k, ~known) for c, k in (("marks", np.uint64), ("rows", np.int64), ("starts", np.int32), ("counts", np.int32), ("ahead", np.int32)))
    _, name, often = np.unique(mark, return_inverse=True, return_counts=True)
    use = often[name] > 1
    name, rows, starts, counts, ahead = name[use], rows[use], starts[use], counts[use], ahead[use]
    if len(name):
        first = int(frame["bucket"].iloc[0]) << 24
        total = np.bincount(name, counts).astype(np.int64)
        light = total <= bound // 2
        group = np.zeros(len(total), np.int64)
        group[light] = _packed(total[light], bound)
        at = light[name]
        out.append(pd.DataFrame({"row_key": rows[at], "start": starts[at], "count": counts[at], "part": first + group[name[at]]}))
        if not light.all():  # longer prefixes: suffixes that start equally far ahead of their landmark
            run = np.repeat(np.flatnonzero(~at), counts[~at])
            step = np.arange(len(run)) - np.repeat(np.cumsum(counts[~at]) - counts[~at], counts[~at])
            _, name, total = np.unique(np.stack((name[run], ahead[run] - step)), axis=1, return_inverse=True, return_counts=True)
            name = name.ravel()
            light, after = total <= bound // 2, int(group.max()) + 1
            part = np.full(len(total), WHOLE, np.int64)
            part[light] = first + after + _packed(total[light], bound)
            out.append(pd.DataFrame({"row_key": rows[run], "start": (starts[run] + step).astype(np.int32), "count": np.int32(1), "part": part[name]}))
    return pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)


def suffix_tree(name: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start ``at`` places of ``name`` in the order of their first ``size`` words, and how many of these each shares with the next."""
    levels, both = [(1, _ranks(name)[2])], lambda a, b: (a.astype(np.uint64) << np.uint64(32)) | b
    while 2 * levels[-1][0] <= size:
        w, x = levels[-1]
        levels.append((2 * w, _ranks(both(x[:-w], x[w:]))[2]))
    w, x = levels[-1]
    order = np.argsort(both(x[at], x[at + size - w]))
    one, two = at[order][:-1], at[order][1:]
    common = np.zeros(len(one), np.int64)
    for w, x in reversed(levels):
        more = np.flatnonzero(common + w <= size)
        more = more[x[one[more] + common[more]] == x[two[more] + common[more]]]
        common[more] += w
    return order, common


def _subtree(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """One group's tree: the leaves below its deep inner nodes."""
    joined = lambda c, kind: np.frombuffer(b"".join(frame[c]), kind)
    rows, starts, counts = joined("rows", np.int64), joined("starts", np.int32), joined("counts", np.int32).astype(np.int64)
    name = word_names(words_of([b" ".join(frame["words"])]))
    stretch = counts + size - 1
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(stretch) - stretch, counts) + step
    order, common = suffix_tree(name, at, size)
    inner = np.flatnonzero(common >= size)
    deep = np.zeros(len(at), bool)
    deep[order[inner]] = deep[order[inner + 1]] = True
    row, start = np.repeat(rows, counts)[deep], (np.repeat(starts, counts) + step)[deep]
    order = np.lexsort((start, row))
    r, s, e = _spans(row[order], start[order], size)
    return pd.DataFrame({"row_key": r, "start": s.astype(np.int32), "stop": e.astype(np.int32)})


def _parts(docs: DataFrame, size: int, bound: int) -> DataFrame:
    """Runs of suffixes and their groups."""
    n = groups_for(docs, "text", BUCKET_MB)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(1), CHUNK):
                if (f := _batch(b.column(0)[i:j].to_numpy(), words_of(b.column(1)[i:j]), size, n)) is not None:
                    yield pa.RecordBatch.from_pandas(f, preserve_index=False)

    counted = docs.select("__key", "text").mapInArrow(ship, COUNTED).groupBy("bucket").applyInPandas(lambda f: _group(f, bound), PARTS)
    return materialize(counted.distinct(), "parts")  # rows equal in id and text send the same runs


def _stretches(joined: DataFrame, size: int, schema: str, whole: bool) -> DataFrame:
    """The words of runs: for trees packed by group, else one row for each window. ``joined``: __key, text and __runs, among other columns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, runs = (b.column(b.schema.get_field_index(c)) for c in ("__key", "text", "__runs"))
            for i, j in pieces(texts, CHUNK):
                found = words_of(texts[i:j])
                raw, first, out = found.data.tobytes(), np.cumsum(found.lengths) - found.lengths, {}
                begin, end = found.starts, found.ends
                for key, base, own in zip(keys[i:j].to_pylist(), first.tolist(), runs[i:j].to_pylist(), strict=True):
                    for r in own:
                        if (r["part"] == WHOLE) if whole else (r["part"] >= 0):
                            a = base + r["start"]
                            out.setdefault(r["part"], []).append((key, r["start"], r["count"], raw[begin[a] : end[a + r["count"] + size - 2]]))
                if whole:
                    rows = [(k, s, s + size, b" ".join(x.split())) for part in out.values() for k, s, _, x in part]
                    yield pa.RecordBatch.from_pydict({"row_key": pa.array([x[0] for x in rows], pa.int64()), "start": pa.array([x[1] for x in rows], pa.int32()), "stop": pa.array([x[2] for x in rows], pa.int32()), "words": pa.array([x[3] for x in rows], pa.binary())})
                    continue
                columns = [(part, _pack(np.array([x[0] for x in own]), np.int64), _pack(np.array([x[1] for x in own]), np.int32), _pack(np.array([x[2] for x in own]), np.int32), b" ".join(x[3] for x in own)) for part, own in out.items()]
                part, *packed = zip(*columns, strict=True) if columns else [()] * 5
                yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in zip(("rows", "starts", "counts", "words"), packed, strict=True)}})

    return joined.mapInArrow(cut, schema)


def _with_spans(docs: DataFrame, size: int, bound: int = BOUND) -> DataFrame:
    """``docs`` and __spans: the maximal repeats (start, stop) in words of each row, null where there are none."""
    if not LANDMARK <= size:
        raise ValueError(f"a window has at least {LANDMARK} words")
    prepare(docs.sparkSession)
    keyed = docs.withColumn("__key", row_key())
    with small_batches(docs.sparkSession):
        parts = _parts(keyed, size, bound)
    runs = parts.where(F.col("part") != KNOWN).groupBy(F.col("row_key").alias("__row_key")).agg(F.collect_list(F.struct("start", "count", "part")).alias("__runs"))
    # All columns travel along, so that this join and the last one share one exchange of the texts.
    joined = keyed.join(runs, F.col("__key") == F.col("__row_key"))
    trees = _stretches(joined, size, "part bigint, rows binary, starts binary, counts binary, words binary", whole=False)
    found = trees.groupBy("part").applyInPandas(lambda f: _subtree(f, size), REPEATS)
    found = found.unionByName(parts.where(F.col("part") == KNOWN).select("row_key", "start", (F.col("start") + F.col("count") + size - 1).alias("stop")))
    if not parts.where(F.col("part") == WHOLE).isEmpty():
        windows = materialize(_stretches(joined, size, f"{REPEATS}, words binary", whole=True), "windows")
        often = windows.groupBy("words").agg(F.count("*").alias("n")).where("n > 1").select("words")
        found = found.unionByName(materialize(join_salted(windows, often, "words").select("row_key", "start", "stop"), "repeats"))
    spans = found.distinct().groupBy(F.col("row_key").alias("__row_key")).agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    return keyed.join(spans, F.col("__key") == F.col("__row_key"), "left").drop("__key", "__row_key")


def maximal_repeats(docs: DataFrame, size: int = 35, bound: int = BOUND) -> DataFrame:
    """doc_id, start and stop in words of each row's maximal runs of words covered by a window that stands somewhere else too."""

    def merged(spans: pd.Series) -> pd.Series:
        out = []
        for own in spans:
            held: list[list[int]] = []
            for a, b in sorted((x["start"], x["stop"]) for x in own):
                if held and a <= held[-1][1]:
                    held[-1][1] = max(b, held[-1][1])
                else:
                    held.append([a, b])
            out.append([{"start": a, "stop": b} for a, b in held])
        return pd.Series(out, dtype=object)

    join = F.pandas_udf(merged, "array<struct<start:int,stop:int>>")
    return _with_spans(docs.select("doc_id", "text"), size, bound).where("__spans IS NOT NULL").select("doc_id", F.explode(join("__spans")).alias("z")).select("doc_id", "z.*")


def _kept(found: list[bytes], spans) -> tuple[list[bytes], int]:
    if spans is None or not len(spans):
        return found, 0
    gone = np.zeros(len(found) + 1, np.int32)
    np.add.at(gone, [s["start"] for s in spans], 1)
    np.add.at(gone, [s["stop"] for s in spans], -1)
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(found, keep.tolist(), strict=True) if k], int(len(found) - keep.sum())


def report(docs: DataFrame, size: int = 35, bound: int = BOUND) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by spaces."""

    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts.tolist(), spans.tolist(), strict=True):
            found = words(t)
            kept, n = _kept(found, s)
            out.append((len(found), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    digester = F.pandas_udf(digest, "n_words bigint, n_removed bigint, kept_sha256 string")
    return _with_spans(docs.select("doc_id", "text"), size, bound).select("doc_id", digester("text", "__spans").alias("z")).select("doc_id", "z.*")


def remove(docs: DataFrame, size: int = 35) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; a text that loses nothing stays as it is, to its white space."""

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts.tolist(), spans.tolist(), strict=True):
            kept, n = _kept(words(t), s) if s is not None and len(s) else ([], 0)
            out.append(b" ".join(kept).decode("utf-8", "surrogatepass") if n else t)
        return pd.Series(out, dtype=object)

    cutter = F.pandas_udf(cut, T.StringType())
    return _with_spans(docs, size).withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cutter("text", "__spans"))).select(*docs.columns)
