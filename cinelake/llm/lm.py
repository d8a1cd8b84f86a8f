"""N-gram language-model scoring by a weighted backoff automaton whose weights are gathered from the whole corpus.

Model: absolute discounting, interpolated. After a context h with count c(h), a token w has probability
(c(hw) - D) / c(h) + a(h) p(w | h') if hw was kept, else a(h) p(w | h'), where h' lacks h's oldest token and a(h) = 1 - sum over kept hw of
(c(hw) - D) / c(h) is what the kept n-grams leave. N-grams of two tokens or more are kept if they occur ``least`` times in the training texts, so
what occurs once counts as the context's rest; those of three or more also need parts (without the first, without the last token) that occur ``grown`` times. At the root p(w) = (c + 1) / (N + V + 1), which leaves one share for all unseen words.

Automaton: each kept n-gram shorter than ``order`` is a state with a backoff weight log10 a(h) and a failure arc to the state without its oldest token; each kept
n-gram hw is an arc from h with its log-probability, to the longest state that ends the tokens read. One left-to-right traversal of a text carries the state:
while the state has no arc for the token it takes the failure arc and adds the backoff weight, then it takes the arc and adds that weight.

No model is held whole anywhere. Documents are dealt into blocks by a hash of the row, and a block meets its texts once for each round:
  1. it asks for each of its distinct words and bigrams once and sends its own training counts with the question; the partition that owns an
     n-gram's hash adds the counts up, answers every block that asked, and names one of them as the n-gram's reporter;
  2. it asks for the longer n-grams whose two parts were kept, one length in each round, and reports how many kept n-grams follow each context, and their
     sum; the contexts' owners add these up and answer likewise;
  3. it builds its part of the automaton, states and arcs that its texts can reach, and runs it.
A frequent word, context or passage is one entry of each block, so no key gathers rows. Messages without entries aren't sent, so their number is
bounded by the n-grams of the blocks.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token; the first state is a start token that isn't scored. Null and empty texts are
the end token alone. A row with a null id is a training row. Rows equal in id and text count as often as they stand. Extra columns are ignored.
A word is told by 64 bits of hash, a longer n-gram by a hash whose length grows with the corpus, so that about one in 500,000 unseen n-grams is taken for a seen one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, row_key
from .wordhash import mix, pieces, words_of

START, END = mix(np.arange(1, 3, dtype=np.uint64))
#: MB of text of a block.
BLOCK_MB = 8
#: Longest n-gram, the discount, the count from which an n-gram of two tokens or more is kept, and that from which one may be part of a longer one.
ORDER, DISCOUNT, LEAST, GROWN = 3, 0.75, 2, 8
#: Tokens of a stretch of a long text.
STRETCH = 512
_ODD = np.uint64(0x9FB21C651E98DF25)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers in as few whole bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return out.view("<u8").ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts, most of them 0 or 1, by byte planes and compressed."""
    raw = pack(x)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0]).T
    return raw[:1] + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def owners(unique: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, indices of its share in ascending order of the hashes) of every owner that has any."""
    if not len(unique):
        return
    owner = (mix(unique) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)  # short keys sort faster
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    for i, at in zip(owner[np.concatenate(([0], cuts))].tolist(), np.split(order, cuts), strict=True):
        yield i, at


def totals(docs: DataFrame, parts: int) -> tuple[int, int]:
    """N and V of the training tokens: each batch sends its distinct words once, the owners count them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(0), BLOCK_MB * 1_000_000):
                w = words_of(b.column(0)[i:j], fold=True)
                n = len(w.hashes) + j - i
                unique = np.unique(np.append(w.hashes, END))
                rows = [(p, pack(np.diff(unique[at], prepend=np.uint64(0)))) for p, at in owners(unique, parts)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "words": pa.array([x for _, x in rows], pa.binary()), "n": pa.array([n, *[0] * (len(rows) - 1)], pa.int64())})

    def count(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [f["n"].sum()], "v": [len(np.unique(np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in f["words"]])))]})

    got = docs.where(~F.col("held_out")).select("text").mapInArrow(ask, "part int, words binary, n bigint").groupBy("part").applyInPandas(count, "n bigint, v bigint").agg(F.sum("n"), F.sum("v")).first()
    return got[0] or 0, got[1] or 0


MESSAGE = "part int, block int, kinds array<int>, hashes array<binary>, first array<binary>, second array<binary>"
ANSWER = "block int, part int, kinds array<int>, first array<binary>, second array<binary>"


def _answer(f: pd.DataFrame, least: int) -> pd.DataFrame:
    """One owner: sums over the blocks that sent an entry. Questions (even kinds) get the sums of kept n-grams, doubled, plus 1 for the reporter; reports the sums."""
    kinds, hashes, values = ([x for xs in f[c] for x in xs] for c in ("kinds", "hashes", "first"))
    more = [x for xs in f["second"] for x in xs]
    out = {"first": [b""] * len(kinds), "second": [b""] * len(kinds)}
    for kind in sorted(set(kinds)):
        at = [i for i, k in enumerate(kinds) if k == kind]
        each = [np.cumsum(unpack(hashes[i]), dtype=np.uint64) for i in at]
        flat = np.concatenate(each)
        order = np.argsort(flat, kind="stable")
        fresh = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
        name = np.empty(len(flat), np.int64)
        name[order] = np.cumsum(fresh) - 1
        sums = [np.bincount(name, np.concatenate([unpack_counts(x[i]) for i in at]).astype(np.float64)).astype(np.uint64)[name] for x in ((values,) if kind % 2 == 0 else (values, more))]
        if kind % 2 == 0:
            reporter = np.zeros(len(flat), np.uint64)
            reporter[order[fresh]] = 1
            sums[0] = np.where(sums[0] >= (1 if kind == 0 else least), 2 * sums[0] + reporter, 0).astype(np.uint64)
        cuts = np.cumsum([len(x) for x in each])[:-1]
        for c, total in zip(("first", "second"), sums, strict=False):
            for i, x in zip(at, np.split(total, cuts), strict=True):
                out[c][i] = pack_counts(x)
    ends = np.cumsum([len(x) for x in f["kinds"]]).tolist()
    deal = lambda x: [x[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pd.DataFrame({"block": f["block"], "part": f["part"], "kinds": f["kinds"], "first": deal(out["first"]), "second": deal(out["second"])})


class Block:
    """N-grams of a block's texts as far as the answers reach. ``unique[k]``: distinct n-grams of k + 1 tokens; ``name[k]``: their number at each place, or -1."""

    def __init__(self, texts: pa.Array | list, train: np.ndarray, parts: int, bits: int, least: int, grown: int, answers: pa.Table | None):
        words = words_of(texts, fold=True)
        self.lengths = words.lengths + 2
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), np.uint64)
        inside = np.ones(len(self.flat), bool)
        inside[self.first] = inside[self.first + self.lengths - 1] = False
        self.flat[self.first], self.flat[self.first + self.lengths - 1], self.flat[inside] = START, END, words.hashes
        self.place = np.arange(len(self.flat)) - np.repeat(self.first, self.lengths)
        self.train = np.repeat(train, self.lengths)
        self.parts, self.shift, self.least, self.grown = parts, np.uint64(64 - bits), least, grown
        self.gram: list[np.ndarray] = []
        self.unique: list[np.ndarray] = []
        self.name: list[np.ndarray] = []
        self.head: list[np.ndarray] = []
        self.own: list[np.ndarray] = []  # training counts in this block
        self.total: list[np.ndarray] = []  # in the corpus, 0 if not kept
        self.reporter: list[np.ndarray] = []
        self.following: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # kept n-grams after each context, and their sum
        rows = () if answers is None else zip(*(answers.column(c).to_pylist() for c in ("part", "kinds", "first", "second")), strict=True)
        self.got = {(k, p): (a, b) for p, *own in rows for k, a, b in zip(*own, strict=True)}

    def number(self, k: int, used: bool = True) -> None:
        """Names the n-grams of k + 1 tokens: of two tokens or fewer all, of longer ones those both of whose parts occur often enough; none that aren't ``used``."""
        if k == 0:
            self.gram.append(self.flat)
        else:
            g = np.zeros(len(self.flat), np.uint64)
            with np.errstate(over="ignore"):
                g[1:] = mix(self.gram[k - 1][:-1] * _ODD + self.flat[1:] + np.uint64(k)) >> self.shift
            self.gram.append(g)
        able = self.place >= (k if used else len(self.place))
        if k > 1 and used:
            kept = self.kept(k - 1, self.grown)
            able[1:] &= kept[1:] & kept[:-1]
        at = np.flatnonzero(able)
        order = at[np.argsort(self.gram[k][at])]
        s = self.gram[k][order]
        fresh = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
        name = np.full(len(self.flat), -1, np.int32)
        name[order] = np.cumsum(fresh) - 1
        self.unique.append(s[fresh])
        self.name.append(name)
        self.head.append(order[fresh])
        self.own.append(np.add.reduceat(self.train[order].astype(np.int64), np.flatnonzero(fresh)) if len(s) else np.zeros(0, np.int64))

    def kept(self, k: int, least: int = 1) -> np.ndarray:
        """Whether the n-gram of k + 1 tokens that ends at each place was kept, and occurs ``least`` times."""
        return (self.name[k] >= 0) & np.append(self.total[k] >= least, False)[self.name[k]]

    def read(self, k: int) -> None:
        """Takes the answers on the n-grams of k + 1 tokens."""
        coded = np.zeros(len(self.unique[k]), np.uint64)  # of unused lengths none
        for p, at in owners(self.unique[k], self.parts):
            coded[at] = unpack_counts(self.got[2 * k, p][0])
        self.total.append((coded >> np.uint64(1)).astype(np.int64))
        self.reporter.append((coded & np.uint64(1)).astype(bool) & (coded > 1))

    def contexts(self, k: int) -> np.ndarray:
        """Numbers of the contexts of k + 1 tokens that kept n-grams can follow."""
        return np.flatnonzero(self.total[k] >= (self.grown if k else self.least))

    def read_following(self, k: int) -> None:
        at = self.contexts(k)
        sums = np.zeros((2, len(self.unique[k])))
        for p, i in owners(self.unique[k][at], self.parts):
            for s, raw in zip(sums, self.got[2 * k + 1, p], strict=True):
                s[at[i]] = unpack_counts(raw)
        self.following[k] = (sums[0], sums[1])

    def questions(self, k: int) -> list[tuple]:
        return [(p, 2 * k, pack(np.diff(self.unique[k][at], prepend=np.uint64(0))), pack_counts(self.own[k][at]), b"") for p, at in owners(self.unique[k], self.parts)]

    def reports(self, k: int) -> list[tuple]:
        """What this block's n-grams of k + 2 tokens, as far as it reports them, say of their contexts; contexts without any are asked for all the same."""
        chosen = np.flatnonzero(self.reporter[k + 1])
        context = self.name[k][self.head[k + 1][chosen] - 1]
        many = np.bincount(context, minlength=len(self.unique[k]))
        total = np.bincount(context, self.total[k + 1][chosen], minlength=len(self.unique[k])).astype(np.int64)
        at = self.contexts(k)
        return [(p, 2 * k + 1, pack(np.diff(self.unique[k][at[i]], prepend=np.uint64(0))), pack_counts(many[at[i]]), pack_counts(total[at[i]])) for p, i in owners(self.unique[k][at], self.parts)]


class Automaton:
    """States and arcs that a block's texts can reach, as arrays. State 0 is the root."""

    def __init__(self, block: Block, order: int, z: float, discount: float):
        self.block, sizes = block, [len(u) for u in block.unique]
        base = 1 + np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.failure, self.backoff, self.depth = np.zeros(base[order - 1], np.int64), np.zeros(base[order - 1]), np.zeros(base[order - 1], np.int64)
        self.weight, self.next = np.zeros(int(base[-1])), np.zeros(int(base[-1]), np.int64)
        #: At each place, the arc for its token from a state of each depth, or -1.
        self.arc = np.full((order, len(block.flat)), -1, np.int32)
        lower, rest = np.zeros(0), np.zeros(0)
        for k in range(order):
            c, head, own = block.total[k].astype(float), block.head[k], slice(int(base[k]), int(base[k + 1]))
            if k == 0:
                p = (c + 1) / z
            else:
                context, suffix = block.name[k - 1][head - 1], block.name[k - 1][head]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(c > 0, (c - discount) / block.total[k - 1][context] + rest[context] * lower[suffix], 1.0)
            self.weight[own] = np.log10(p)
            self.arc[k] = np.where(block.kept(k) if k else True, block.name[k] + base[k], -1)
            if k < order - 1:
                many, total = block.following[k]
                rest = np.where(many > 0, (c - total + discount * many) / np.maximum(c, 1), 1.0)
                self.backoff[own], self.depth[own] = np.log10(rest), k + 1
                self.failure[own] = suffix + base[k - 1] if k else 0
                self.next[own] = np.where(c > 0, np.arange(own.start, own.stop), 0)
            else:
                self.next[own] = suffix + base[k - 1] if k else 0
            lower = p
        self.starts = self.next[block.name[0][block.first] + base[0]]

    def run(self) -> np.ndarray:
        """Each text's log-probability. All texts of the block step from token to token together. A long text steps in stretches side by side: as a state knows
        no more than ``order - 1`` tokens, a stretch that starts so many tokens early at the root is in the whole traversal's state when it begins to score."""
        block, early = self.block, len(self.arc) - 1
        scored = block.lengths - 1
        stretches = np.maximum(1, -(-scored // STRETCH))
        text = np.repeat(np.arange(len(scored)), stretches)
        number = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        early = np.where(number > 0, early, 0)
        first = block.first[text] + 1 + number * STRETCH - early
        steps = np.minimum(STRETCH, scored[text] - number * STRETCH) + early
        state = np.where(number > 0, 0, self.starts[text])
        longest = np.argsort(-steps, kind="stable")
        text, first, steps, early, state = text[longest], first[longest], steps[longest], early[longest], state[longest]
        score, active = np.zeros(len(text)), len(text)
        for t in range(int(steps[0]) if len(steps) else 0):
            while steps[active - 1] <= t:
                active -= 1
            place, s = first[:active] + t, state[:active]
            added = np.zeros(active)
            arc = self.arc[self.depth[s], place]
            while len(miss := np.flatnonzero(arc < 0)):
                added[miss] += self.backoff[s[miss]]
                s[miss] = self.failure[s[miss]]
                arc[miss] = self.arc[self.depth[s[miss]], place[miss]]
            score[:active] += np.where(t >= early[:active], added + self.weight[arc], 0.0)
            state[:active] = self.next[arc]
        return np.bincount(text, score, minlength=len(scored))


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = ORDER, discount: float = DISCOUNT, least: int = LEAST, grown: int = GROWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    if order < 2:
        raise ValueError("the automaton has states for contexts: order is 2 or more")
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size / (BLOCK_MB * 1e6)) + 1

    def pressed(s: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=12).compress
        return pd.Series([None if t is None else press(t.encode("utf-8", "surrogatepass")) for t in s], dtype=object)

    out = held_out(F.col("doc_id"), modulus, remainder).alias("held_out")
    n, v = totals(docs.select("text", out), parts)
    # The blocks meet their texts in every round; the texts travel compressed.
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.pandas_udf(pressed, T.BinaryType())("text").alias("packed"), out, F.pmod(row_key(), F.lit(parts)).cast("int").alias("block"))
    z, bits = float(n + v + 1), min(64, max(40, 20 + n.bit_length()))

    def met(texts: pa.Table, answers: pa.Table | None, reach: int, low: int = 0) -> Block:
        """The block with the answers on n-grams of more than ``low`` and up to ``reach`` tokens, and those of the next length named."""
        read = zstandard.ZstdDecompressor().decompress
        text = [None if x is None else read(x) for x in texts.column("packed").to_pylist()]
        train = ~texts.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        block = Block(text, train, parts, bits, least, max(grown, least), answers)
        for k in range(min(order, max(2, reach + 1))):
            block.number(k, k >= low)
            if k < reach:
                block.read(k)
        return block

    def sent(texts: pa.Table, messages: list[tuple]) -> pa.Table:
        dealt: dict[int, list[tuple]] = {}
        for part, *message in messages:
            dealt.setdefault(part, []).append(tuple(message))
        block = texts.column("block")[0].as_py() if texts.num_rows else 0
        kinds = pa.array([[m[0] for m in own] for own in dealt.values()], pa.list_(pa.int32()))
        packed = {c: pa.array([[m[i] for m in own] for own in dealt.values()], pa.list_(pa.binary())) for i, c in enumerate(("hashes", "first", "second"), 1)}
        return pa.table({"part": pa.array(list(dealt), pa.int32()), "block": pa.array([block] * len(dealt), pa.int32()), "kinds": kinds, **packed})

    def ask(texts: pa.Table) -> pa.Table:
        block = met(texts, None, 0)
        return sent(texts, block.questions(0) + block.questions(1))

    def ask_on(reach: int):
        def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
            block = met(texts, answers, reach, min(reach - 2, 1))
            return sent(texts, (block.questions(reach) if reach < order else []) + block.reports(reach - 2))

        return ask

    def walk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = met(texts, answers, order)
        block.gram.clear()
        for k in range(order - 1):
            block.read_following(k)
        weights = np.log10((block.total[0] + 1) / z)[block.name[0]]
        weights[block.first] = 0  # the start isn't scored
        known = (block.total[0] > 0)[block.name[0]].astype(np.int64)
        known[block.first] = 0
        per = lambda x: np.add.reduceat(x, block.first) if len(block.first) else x
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held_out"), "n_tokens": block.lengths - 1, "n_known": per(known), "base_score": per(weights), "score": Automaton(block, order, z, discount).run()})

    answer = lambda f: _answer(f, least)
    answered = rows.groupBy("block").applyInArrow(ask, MESSAGE).groupBy("part").applyInPandas(answer, ANSWER)
    for reach in range(2, order + 1):
        asked = rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(ask_on(reach), MESSAGE)
        answered = answered.unionByName(asked.groupBy("part").applyInPandas(answer, ANSWER))
    walked = rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(walk, "id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return walked.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
