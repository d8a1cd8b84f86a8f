"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash (hash and displace) over the vocabulary's byte strings resolves a
whole pre-token that is a vocabulary entry with one probe and one comparison. Tier 2: any other
pre-token is merged by a heap of (rank, position) over a doubly linked list of its bytes.

Null text encodes as the empty text; an empty text has no ids and decodes to the empty text.
Very long texts are encoded whole. Extra columns pass through ``encode`` and ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import prepare

#: Pre-tokens and their ids kept by a worker; the cache starts anew beyond it. It bounds memory, not what is encoded.
CACHE = 400_000
#: Pre-tokens longer than this aren't cached.
LONG = 64


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: bucket by one hash, displace by another."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.n_buckets = n, max(1, n // 2)
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(self.n_buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(k)
            a, b, c = h & 0xFFFFFFFF, (h >> 32) & 0x7FFFFFFF, (h >> 64) & 0x7FFFFFFF
            buckets[a % self.n_buckets].append((b, c, i))
        self.shift = [0] * self.n_buckets
        slots = np.full(n, -1, np.int64)
        for x in sorted(range(self.n_buckets), key=lambda x: -len(buckets[x])):
            if len(buckets[x]) < 2:
                break
            d = 0
            while True:
                at = [(b + d * c + d * d) % n for b, c, _ in buckets[x]]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[x] = d
            for s, (_, _, i) in zip(at, buckets[x], strict=True):
                slots[s] = i
        free = iter(np.flatnonzero(slots < 0).tolist())
        for x in (x for x in range(self.n_buckets) if len(buckets[x]) == 1):  # a bucket of one goes straight to a free slot
            s = next(free)
            self.shift[x], slots[s] = -1 - s, buckets[x][0][2]
        self.order = slots.tolist()

    def slot(self, key: bytes) -> int:
        """The place of ``key`` among n; for a string outside the set any place, so the caller compares."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h & 0xFFFFFFFF) % self.n_buckets]
        if d < 0:
            return -1 - d
        return (((h >> 32) & 0x7FFFFFFF) + d * ((h >> 64) & 0x7FFFFFFF) + d * d) % self.n


class Known(dict):
    """The ids of pre-tokens seen before; others are looked up, then merged."""

    def __init__(self, tokenizer: Tokenizer):
        self.rank, self.merge = tokenizer.rank, tokenizer.merge

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        got = (r,) if (r := self.rank(raw)) >= 0 else self.merge(raw)
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = got
        return got


class Tokenizer:
    """Encodes by ranks read from a tiktoken file; ids are the ranks."""

    def __init__(self, lines: list[tuple[bytes, int]], pattern: str, perfect: PerfectHash | None = None):
        compiled = regex.compile(pattern)
        self.find, self.scan = compiled.findall, compiled.finditer
        self.hash = perfect or PerfectHash([k for k, _ in lines])
        keys = [k for k, _ in lines]
        self.merges = dict(lines)
        self.keys = [keys[i] for i in self.hash.order]
        self.ids = [lines[i][1] for i in self.hash.order]
        self.pieces = {r: k for k, r in lines}
        self.digits = {r: str(r) for _, r in lines}
        self.bytes = [self.merges.get(bytes([x]), -1) for x in range(256)]
        self.piece_ids = Known(self).__getitem__

    def rank(self, piece: bytes) -> int:
        """The rank of a vocabulary entry, -1 for any other string."""
        s = self.hash.slot(piece)
        return self.ids[s] if self.keys[s] == piece else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equal ranks; each merge is O(log n)."""
        n, rank = len(piece), self.merges.get
        end = [*range(1, n + 1), 0]  # a live node i spans piece[i:end[i]]; a dead one points to n, where no span ends
        before = list(range(-1, n - 1))
        ids = [self.bytes[x] for x in piece]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = end[i]
            if end[j] != stop:  # a neighbour has changed since
                continue
            end[i], end[j], ids[i] = stop, n, r
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece_ids, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


_workers: dict[object, Tokenizer] = {}


class Shared:
    """Sends the vocabulary (bounded by its file) once to each executor; a worker builds its tables once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        prepare(spark)
        lines = read_ranks(path)
        self.tables = spark.sparkContext.broadcast((lines, PerfectHash([k for k, _ in lines])))
        self.key, self.pattern = (path, pattern), pattern

    def get(self) -> Tokenizer:
        if self.key not in _workers:
            _workers[self.key] = Tokenizer(self.tables.value[0], self.pattern, self.tables.value[1])
        return _workers[self.key]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _with(batch: pa.RecordBatch, arrays: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip([*batch.columns, *arrays], schema, strict=True)], schema=schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` and an array<int> column ``into``; no shuffle."""
    shared = Shared(docs.sparkSession, path, pattern)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    at, out = docs.columns.index(text), _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.get()
        for b in batches:
            ids = pa.array([tok.encode(x or "") for x in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield _with(b, [ids], out)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``encoded`` and a binary column ``into`` with the bytes that the ids stand for; null ids decode to no bytes."""
    shared = Shared(encoded.sparkSession, path, pattern)
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())])
    at, out = encoded.columns.index(ids), _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.get()
        for b in batches:
            yield _with(b, [pa.array([tok.decode(x or []) for x in b.column(at).to_pylist()], pa.binary())], out)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text in one pass and returns doc_id, n_tokens and digests of ids and decoded bytes.

    The same calls as ``encode`` and ``decode``, without sending the ids through Arrow between them.
    """
    shared = Shared(docs.sparkSession, path, pattern)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.get()
        for b in batches:
            counts, first, second = [], [], []
            for x in b.column(1):
                ids = tok.encode(x.as_py() or "")
                counts.append(len(ids))
                first.append(hashlib.sha256(",".join(map(tok.digits.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(tok.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field(0).type), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    """The path and pattern that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
