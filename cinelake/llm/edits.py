"""Edit-aware token counts.

Each document has a segment tree: leaves are runs of pre-tokens with their lengths in characters and their token counts, inner nodes
are sums of both. An edit (start, deleted, inserted; in code points of the text as the edits before it left it)
descends by the character sums to the pre-token it touches, steps back over the boundary context, re-encodes from there, and stops at
the first old boundary behind the edit at which a new pre-token starts as well: from a common boundary on, the pattern finds the same pre-tokens. Only the
leaves touched and the sums above them change.

Positions beyond the text's end mean its end. Null text counts as empty, a null edit list as none; null fields of an edit as 0 and ''.
Rows are independent, so repeated ids keep their own trees. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Shared, Tokenizer, _arrow

#: Pre-tokens of a fresh leaf, and how many times that a leaf may grow before the tree is dealt anew.
LEAF, GROWTH = 64, 8
#: A kept pre-token ends at least this far before an edit: the pattern looks at no more than one character behind a match.
CONTEXT = 2

TREE = [T.StructField("leaf_sizes", T.ArrayType(T.IntegerType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]


def _sums(values: np.ndarray, starts: list[int], ends: list[int], room: int) -> np.ndarray:
    """The sums of a tree over leaves with these bounds, the root at 1."""
    upto, out = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64))), np.zeros(2 * room, np.int64)
    out[room : room + len(ends)] = upto[ends] - upto[starts]
    while room > 1:
        out[room // 2 : room] = out[room : 2 * room].reshape(-1, 2).sum(axis=1)
        room //= 2
    return out


class TokenTree:
    def __init__(self, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None):
        sizes = np.minimum(LEAF, len(lengths) - np.arange(0, len(lengths), LEAF)) if sizes is None else sizes
        ends = np.cumsum(sizes).tolist() or [0]
        starts = [0, *ends[:-1]]
        self.lengths, self.counts = ([x[a:b] for a, b in zip(starts, ends, strict=True)] for x in (lengths, counts))
        self.room = 1 << (len(ends) - 1).bit_length()
        self.chars, self.tokens = _sums(lengths, starts, ends, self.room), _sums(counts, starts, ends, self.room)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def __len__(self) -> int:
        return sum(map(len, self.lengths))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.fromiter(map(len, self.lengths), np.int32, len(self.lengths)), np.concatenate(self.lengths), np.concatenate(self.counts)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where the leaf starts."""
        k, start = 1, 0
        while k < self.room:
            k *= 2
            if position - start >= self.chars[k] and self.chars[k + 1]:
                start += int(self.chars[k])
                k += 1
        return k - self.room, start

    def set_leaf(self, leaf: int, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.lengths[leaf], self.counts[leaf] = lengths, counts
        k = leaf + self.room
        self.chars[k], self.tokens[k] = lengths.sum(), counts.sum()
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]


def build(text: str, tok: Tokenizer) -> TokenTree:
    pieces = tok.find(text)
    return TokenTree(np.fromiter(map(len, pieces), np.int32, len(pieces)), np.fromiter(map(len, map(tok.piece_ids, pieces)), np.int32, len(pieces)))


def edit(text: str, tree: TokenTree, tok: Tokenizer, start: int, deleted: int, inserted: str) -> tuple[str, TokenTree, int]:
    """The edited text and its tree, and how many pre-tokens were encoded anew."""
    start = min(max(start, 0), len(text))
    stop = min(start + max(deleted, 0), len(text))
    new = text[:start] + inserted + text[stop:]
    shift = len(new) - len(text)
    # The last pre-token that ends CONTEXT characters before the edit stays; encoding starts behind it.
    first, at = tree.leaf_at(max(0, start - CONTEXT))
    ends = at + np.cumsum(tree.lengths[first])
    while first and (not len(ends) or ends[0] > start - CONTEXT):
        first -= 1
        at -= int(tree.lengths[first].sum())
        ends = at + np.cumsum(tree.lengths[first])
    keep = int(np.searchsorted(ends, start - CONTEXT, side="right"))
    position = int(ends[keep - 1]) if keep else at
    lengths, counts = list(tree.lengths[first][:keep]), list(tree.counts[first][:keep])
    # Walk old boundaries and new pre-tokens side by side until they meet behind the edit.
    leaf, index, old, fresh = first, keep, position, 0
    for match in tok.scan(new, position):
        begin = match.start()
        if begin >= start + len(inserted):
            while old < begin - shift and leaf < len(tree.lengths):
                if index < len(tree.lengths[leaf]):
                    old += int(tree.lengths[leaf][index])
                    index += 1
                else:
                    leaf, index = leaf + 1, 0
            if old == begin - shift:
                break
        lengths.append(match.end() - begin)
        counts.append(len(tok.piece_ids(match.group())))
        fresh += 1
    else:
        leaf, index = len(tree.lengths) - 1, len(tree.lengths[-1])
    leaf = min(leaf, len(tree.lengths) - 1)
    rest = slice(index, None)
    lengths, counts = np.array([*lengths, *tree.lengths[leaf][rest]], np.int32), np.array([*counts, *tree.counts[leaf][rest]], np.int32)
    none = np.zeros(0, np.int32)
    for k in range(first + 1, leaf + 1):
        tree.set_leaf(k, none, none)
    tree.set_leaf(first, lengths, counts)
    if len(lengths) > LEAF * GROWTH:
        _, lengths, counts = tree.arrays()
        tree = TokenTree(lengths, counts)
    return new, tree, fresh


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32), pa.int32()))


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with leaf_sizes, lengths, counts and n_tokens; the tree's sums follow from its leaves. No shuffle."""
    shared = Shared(docs.sparkSession, path, pattern)
    schema = T.StructType([*docs.schema.fields, *TREE, T.StructField("n_tokens", T.LongType())])
    at, out = docs.columns.index("text"), _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.get()
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, len(whole), 500)):
                trees = [build(x.as_py() or "", tok) for x in b.column(at)]
                parts = list(zip(*(t.arrays() for t in trees), strict=True))
                new = [*(_lists(list(p)) for p in parts), pa.array([t.total for t in trees], pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip([*b.columns, *new], out, strict=True)], schema=out)

    return docs.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, path: str, pattern: str) -> DataFrame:
    """Applies the column ``edits`` (array<struct<start,deleted,inserted>>) of each row: text, tree and n_tokens become those of the edited
    text; adds n_tokens_before, n_reencoded (pre-tokens encoded anew) and n_pretokens."""
    shared = Shared(trees.sparkSession, path, pattern)
    added = [T.StructField(n, T.LongType()) for n in ("n_tokens_before", "n_reencoded", "n_pretokens")]
    schema = T.StructType([*trees.schema.fields, *added])
    where, out = {c: trees.columns.index(c) for c in ("text", "edits", "leaf_sizes", "lengths", "counts", "n_tokens")}, _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.get()
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, len(whole), 500)):
                texts, done, totals, extra = [], [], [], []
                arrays = lambda c: (x.values.to_numpy(zero_copy_only=False) for x in b.column(where[c]))  # noqa: B023, E731
                for text, edits, sizes, lengths, counts, before in zip(b.column(where["text"]), b.column(where["edits"]), arrays("leaf_sizes"), arrays("lengths"), arrays("counts"), b.column(where["n_tokens"]), strict=True):
                    new, tree, fresh = text.as_py(), TokenTree(lengths, counts, sizes), 0
                    for e in edits.as_py() or ():
                        new, tree, n = edit(new or "", tree, tok, e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                        fresh += n
                    texts.append(new)
                    done.append(tree.arrays())
                    totals.append(tree.total)
                    extra.append((before.as_py(), fresh, len(done[-1][1])))
                columns = list(b.columns)
                columns[where["text"]] = pa.array(texts, pa.string())
                for c, p in zip(("leaf_sizes", "lengths", "counts"), zip(*done, strict=True), strict=True):
                    columns[where[c]] = _lists(list(p))
                columns[where["n_tokens"]] = pa.array(totals, pa.int64())
                columns += [pa.array(x, pa.int64()) for x in zip(*extra, strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, out, strict=True)], schema=out)

    return trees.mapInArrow(run, schema)


def attach(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds ``edits`` from a table (doc_id, seq, start, deleted, inserted), in order of seq; a document's edits are assumed to fit one row."""
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "deleted", "inserted"))).alias("e"))
    lists = lists.select(F.col("doc_id").alias("__id"), F.transform("e", lambda e: F.struct(e["start"].alias("start"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted"))).alias("edits"))
    return docs.join(lists, F.col("doc_id") == F.col("__id"), "left").drop("__id")


def revised(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits of each text, derived from its id: a cut, an insertion and a replacement."""
    text, h = F.coalesce("text", F.lit("")), F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0))
    n = F.length(text) + 1
    part = lambda start, deleted, inserted: F.struct(start.cast("int").alias("start"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))
    return docs.withColumn("edits", F.array(part(h % n, 9, F.lit("")), part(F.floor(h / 7) % n, 0, F.lit(" revised 2nd ")), part(F.floor(h / 49) % n, 12, F.substring(text, 1, 20))))


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts before and after the edits of ``revised``: each tree is built and edited in one pass, by the calls of ``build_trees`` and
    ``apply_edits`` without sending trees through Arrow between them."""
    shared = Shared(docs.sparkSession, path, pattern)
    counts = ("n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in counts), T.StructField("text_sha256", T.StringType())])
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.get()
        for b in batches:
            found, digests = [], []
            for text, edits in zip(b.column(1), b.column(2), strict=True):
                new = text.as_py() or ""
                tree, fresh = build(new, tok), 0
                before = tree.total
                for e in edits.as_py() or ():
                    new, tree, n = edit(new, tree, tok, e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                    fresh += n
                found.append((before, tree.total, len(tree), fresh))
                digests.append(hashlib.sha256(new.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field(0).type), *(pa.array(x, pa.int64()) for x in np.array(found, np.int64).reshape(-1, 4).T), pa.array(digests, pa.string())], schema=out)

    return revised(docs.select("doc_id", "text")).mapInArrow(run, schema)
