import hashlib
import math
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cinelake.llm import bpe, common, components, decontam, edits, entries, gam, jaccard, lm, quality, repeats, revisits, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="session")
def encoding():
    path, pattern = bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})


def pairs(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def test_bpe(odd_docs, no_docs, encoding):
    want = sorted((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(odd_docs) for ids in [encoding.encode_ordinary(t or "")])
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(odd_docs, *bpe.vocabulary()).collect()) == want
    assert bpe.digests(no_docs, *bpe.vocabulary()).count() == 0
    back = bpe.decode(bpe.encode(odd_docs, *bpe.vocabulary()), *bpe.vocabulary())
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded").cast("string")).count() == 0
    assert back.columns[: len(odd_docs.columns)] == odd_docs.columns


def test_merges(encoding):
    path, pattern = bpe.vocabulary()
    tok = bpe.Tokenizer(bpe.read_ranks(path), pattern)
    for s in ("a" * 500, "ab" * 300, "!?" * 80, "\U0001F600" * 40, "  \n x  ", "日本語テキスト" * 30):
        assert tok.encode(s) == encoding.encode_ordinary(s)
    assert all(tok.rank(k) == r for k, r in bpe.read_ranks(path)) and tok.rank(b"no such entry at all") == -1


def test_edits(odd_docs, no_docs, encoding):
    def edited(t, changes):
        for e in changes:
            s = min(e.start, len(t))
            t = t[:s] + e.inserted + t[s + e.deleted :]
        return t

    want = sorted((str(r.doc_id), len(encoding.encode_ordinary(r.text or "")), len(encoding.encode_ordinary(x))) for r in edits.revised(odd_docs).collect() for x in [edited(r.text or "", r.edits)])
    assert sorted((str(r.doc_id), r.n_tokens_before, r.n_tokens) for r in edits.report(odd_docs, *bpe.vocabulary()).collect()) == want
    assert edits.report(no_docs, *bpe.vocabulary()).count() == 0


def test_edit_trees_match_a_full_count(encoding):
    import random

    path, pattern = bpe.vocabulary()
    tok, rng = bpe.Tokenizer(bpe.read_ranks(path), pattern), random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "12", "'s", "!", "é"]) for _ in range(rng.randrange(400)))
        tree = edits.build(text, tok)
        for _ in range(12):
            text, tree, _ = edits.edit(text, tree, tok, rng.randrange(len(text) + 3), rng.randrange(9), rng.choice(["", " ", "x", "  new word", "'s"]))
            assert tree.total == len(encoding.encode_ordinary(text))
            assert tree.arrays()[1].sum() == len(text)


def test_kept_trees(spark, odd_docs, no_docs, encoding):
    """Trees as a table, edits from another table, and only a few pre-tokens encoded anew."""
    vocabulary = bpe.vocabulary()
    docs = odd_docs.where("doc_id <> 9 OR length(text) > 100").dropDuplicates(["doc_id", "text"]).withColumn("lengths_", F.lit(1))
    changes = [(1, 1, 4, 3, "bird"), (1, 0, 0, 0, "Now "), (9, 0, 20_000, 5, " in the middle "), (7, 0, 10**9, 4, " at the end"), (3, 0, 2, 2, "from nothing"), (99, 0, 0, 0, "no such document")]
    table = spark.createDataFrame(changes, "doc_id long, seq int, start int, deleted int, inserted string")
    trees = edits.build_trees(docs, *vocabulary)
    texts = dict(pairs(docs))
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {i: len(encoding.encode_ordinary(t or "")) for i, t in texts.items()}
    got = edits.apply_edits(edits.attach(trees, table), *vocabulary).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        for _, _, start, deleted, inserted in sorted(c for c in changes if c[0] == r.doc_id):
            start = min(start, len(t))
            t = t[:start] + inserted + t[start + deleted :]
        assert (r.text or "", r.n_tokens) == (t, len(encoding.encode_ordinary(t)))
        assert r.n_reencoded <= 40 and sum(r.counts) == r.n_tokens and sum(r.lengths) == len(t)
    assert edits.apply_edits(edits.attach(edits.build_trees(no_docs, *vocabulary), table), *vocabulary).count() == 0


def test_quality_verdict(spark, sf):
    """The distances and the verdict against NumPy, from the mean histograms of each language."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    shares, base = {}, {}
    for r in rows:
        t, words = r.text or "", WORD.findall(r.text or "")
        kinds = [unicodedata.category(c) for c in t]
        space, stop, symbol = " \t\n\x0b\x0c\r", ".,;:!?'\"()-", "#*$%&|<>"
        classes = [sum(k == "Ll" for k in kinds), sum(k == "Lu" for k in kinds), sum(k == "Nd" for k in kinds), sum(c in space for c in t), sum(c in stop for c in t), sum(c in symbol for c in t)]
        chars = np.array([*classes, len(t) - sum(classes)]) / max(1, len(t))
        common = [sum(w.lower() == x for w in words) / max(1, len(words)) for x in quality.COMMON_WORDS.get(r.lang, ())]
        shares[r.doc_id] = (chars, np.array([*common, 1 - sum(common)]), len(t), len(words))
    got = {r.doc_id: r for r in quality.report(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    good = [r for r in rows if not got[r.doc_id].base_failed and r.lang in quality.COMMON_WORDS and shares[r.doc_id][3] >= quality.MIN_WORDS and shares[r.doc_id][2] >= quality.MIN_CHARS]
    means = {k: [np.mean([shares[r.doc_id][i] for r in good if r.lang == k], axis=0) for i in (0, 1)] for k in {r.lang for r in good}}

    def distance(p, q):
        m = (p + q) / 2
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    for r in rows:
        chars, common, n, words = shares[r.doc_id]
        far = False
        for own, ref, long_enough, bound, found in ((chars, 0, n >= quality.MIN_CHARS, quality.CHAR_DISTANCE, got[r.doc_id].char_distance), (common, 1, words >= quality.MIN_WORDS, quality.WORD_DISTANCE, got[r.doc_id].word_distance)):
            if r.lang in means and long_enough:
                want = distance(own, means[r.lang][ref])
                assert abs(found - want) < 1e-6
                far |= want > bound
            else:
                assert found is None
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and not far)


def test_label_model_step():
    """One maximisation and one posterior against sums by hand, with a voter that depends on another."""
    rng = np.random.default_rng(1)
    votes, q = rng.integers(-1, 2, (40, 3)), rng.random(40)
    m = toxicity.LabelModel()
    m.parents = [-1, 0, -1]
    m.step(votes, q)
    odds = []
    for v in votes:
        total = math.log(m.prior / (1 - m.prior))
        for j, parent in enumerate(m.parents):
            p = []
            for w in (1 - q, q):
                own = {x: (sum(a for a, u in zip(w, votes, strict=True) if u[j] == x) + 0.5) / (w.sum() + 1.5) for x in (-1, 0, 1)}
                if parent < 0:
                    p.append(own[v[j]])
                else:
                    same = [a for a, u in zip(w, votes, strict=True) if u[parent] == v[parent]]
                    both = [a for a, u in zip(w, votes, strict=True) if u[parent] == v[parent] and u[j] == v[j]]
                    p.append((sum(both) + 5 * own[v[j]]) / (sum(same) + 5))
            total += math.log(p[1] / p[0])
        odds.append(1 / (1 + math.exp(-total)))
    assert np.allclose(m.posterior(votes), odds)
    copies = np.column_stack((votes, votes[:, 1]))
    information = m.dependencies(copies, q)
    assert m.tree(information)[3] == 1 or m.tree(information)[1] == 3


def test_boosting_step():
    """A tree of up to three leaves over bins against all pairs of cuts, taken greedily, and scores as sums of table entries."""
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=9), rng.random(9)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    first = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9) - gain(0, 9))
    halves = [(0, first), (first, 9)]
    a, b, k = max(((a, b, k) for a, b in halves for k in range(a + 1, b)), key=lambda z: gain(z[0], z[2]) + gain(z[2], z[1]) - gain(z[0], z[1]))
    parts = [p for p in halves if p != (a, b)] + [(a, k), (k, b)]
    want = np.zeros(9)
    for x, y in parts:
        want[x:y] = g[x:y].sum() / (h[x:y].sum() + 1)
    assert np.allclose(gam._steps(g, h, 2), want)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.Additive().fit(x, y)
    b = model.bins(x)
    total = [model.base + sum(t[b[i, j]] for j, t in enumerate(model.tables)) + sum(t[b[i, u] * gam.PAIR_BINS // model.sizes[u], b[i, v] * gam.PAIR_BINS // model.sizes[v]] for u, v, t in model.pairs) for i in range(300)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.array(total))))
    assert ((model.score(x) > 0.5) == y).mean() > 0.85  # what only a pair can tell


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_ranks_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in rows if r.toxic == 1) >= 0.9 * len(pos)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.03 * len(neg)
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) >= 0.95 * len(pos) * len(neg)
    assert len({round(n, 9) for n in neg}) > len(neg) / 2


def test_quality_counts(odd_docs, no_docs):
    def counts(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)

    got = quality.report(odd_docs).collect()
    assert sorted((str(r[0]), *r[1:6]) for r in got) == sorted((str(i), *counts(t)) for i, t in pairs(odd_docs))
    assert all(r.kept is not None and r.base_failed is not None for r in got)
    assert quality.report(no_docs).count() == 0 and quality.rules(no_docs).count() == 0
    assert quality.rules(odd_docs).columns == odd_docs.columns


def brute_components(rows, percent, size):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return sorted((str(i), len(s), str(least.get(label[k]) if s else i)) for k, (i, s) in enumerate(sets))


def test_jaccard(odd_docs, no_docs):
    got = jaccard.report(odd_docs).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute_components(pairs(odd_docs), 85, 4)
    assert jaccard.report(no_docs).count() == 0
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 3, 4, 5, None, 6, 7, 9, 9, 10]))


def test_jaccard_near_copies(spark):
    import random

    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (70, 80, 85, 90):
        assert sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.report(docs, percent).collect()) == brute_components(rows, percent, 4)


def test_jaccard_by_differences(spark, monkeypatch):
    """One large group of copies just inside and just outside the bound, some of which share their edits, so that links pass the hub by."""
    import random

    monkeypatch.setattr(jaccard, "PART_PAIRS", 0)
    rng = random.Random(8)
    base, rows = [f"b{i}" for i in range(90)], []
    shared = [[(rng.randrange(90), f"s{k}x{j}") for j in range(4)] for k in range(6)]
    for i in range(220):
        w = list(base)
        for at, new in (shared[i % 6][: rng.randrange(5)] if i % 2 else []):
            w[at] = new
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [] if rng.random() < 0.3 else [f"n{rng.randrange(10**6)}"]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 85, 4)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.report(docs).collect()) == want
    assert len({c for _, _, c in want}) > 5


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components.components(links).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and len(got) == 43


def test_suffix_trees(odd_docs, no_docs):
    rows = pairs(odd_docs)
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {p for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        want.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in repeats.report(odd_docs).collect()) == sorted(want)
    assert repeats.report(no_docs).count() == 0
    cut = repeats.remove(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == len(rows) and cut.where("text LIKE '%shared5 %'").count() == 0


def brute_near(w, frequency, items, low, slop=decontam.NEAR):
    """Items with a window whose terms all stand within ``slop`` words of their places, as counted from a rarest term."""
    found = set()
    for item, text in items:
        v = low(text)
        for k in range(max(1, len(v) - 9)) if v else ():
            win = v[k : k + 10]
            if not all(x in frequency for x in win):
                continue
            o = min(range(len(win)), key=lambda j: (frequency[win[j]], j))
            for p in (p for p, x in enumerate(w) if x == win[o]):
                if all(any(w[q] == x for q in range(max(0, p - o + j - slop), min(len(w), p - o + j + slop + 1))) for j, x in enumerate(win)):
                    found |= {item} if item is not None else set()
    return found


def test_proximity(spark):
    """Moved, missing and repeated words; string ids; a match that starts before its document does."""
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: words.findall((t or "").lower())
    rows = [("x", "b a c d e f g h i j k"), ("y", "a b z z c d e f g h i j k l"), ("z", "a b z z z z c d e f g h i j"), ("q", "j i h g f e d c b a"), ("n", None), (None, "c d e f g h i j a b")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    items = spark.createDataFrame([("one", "a b c d e f g h i j"), ("two", "k l"), ("three", "not there")], "item_id string, text string")
    frequency = Counter(x for _, t in rows for x in set(low(t)))
    want = sorted((str(i), len(brute_near(low(t), frequency, items.collect(), low))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_near) for r in decontam.report(docs, items).collect()) == want
    assert {n for _, n in want} == {0, 1, 2}


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame([("a", "cat sat on THE mat and the dog lay by"), ("b", "one two"), ("c", None), ("d", "..."), ("e", "nothing of this kind"), (None, "same id")], "item_id string, text string")
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want, frequency = [], Counter(x for _, t in pairs(odd_docs) for x in set(low(t)))
    for i, t in pairs(odd_docs):
        w, hit, found = low(t), set(), set()
        for item, text in items.collect():
            v = low(text)
            for win in {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9))} if v else ():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found |= {item} if item is not None else set()
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(brute_near(w, frequency, items.collect(), low))))
    assert sorted((str(r[0]), *r[1:]) for r in decontam.report(odd_docs, items).collect()) == sorted(want)
    assert decontam.report(no_docs, items).count() == 0
    assert decontam.report(odd_docs, items.limit(0)).where("contaminated").count() == 0
    near = spark.createDataFrame([("n", "cat on sat")], "item_id string, text string")
    assert decontam.matches(odd_docs, near, slop=1).where(F.size("items") > 0).count() == 3
    assert decontam.clean(odd_docs, items).columns == odd_docs.columns
    with pytest.raises(ValueError, match="next document"):
        decontam.matches(odd_docs, items, size=decontam.GAP)


def language_model(rows, order, discount=lm.DISCOUNT, least=lm.LEAST, grown=lm.GROWN):
    """The model on a small list of (id, text), token by token with the tokens themselves as states: (id, n_tokens, n_known, N, base, score) of each row."""
    out = lambda i: i is not None and zlib.crc32(i.encode()) % 7 == 2
    split = [(i, ["<s>", *[w.encode() for w in WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))], "</s>"]) for i, t in rows]
    counts = Counter(tuple(t[j - k : j + 1]) for i, t in split if not out(i) for k in range(order) for j in range(k, len(t)))
    n, v = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 and g != ("<s>",) for g in counts)
    kept = {}
    for g, c in sorted(counts.items(), key=lambda x: len(x[0])):
        if len(g) == 1 or (c >= least and (len(g) == 2 or all(p in kept and counts[p] >= grown for p in (g[:-1], g[1:])))):
            kept[g] = c
    after = {}
    for g, c in kept.items():
        after.setdefault(g[:-1], []).append(c)
    rest = lambda h: 1 - sum(c - discount for c in after.get(h, ())) / counts[h] if counts[h] else 1.0

    def arc(h, w):
        if not h:
            return (counts[w,] + 1) / (n + v + 1)
        return (kept[*h, w] - discount) / counts[h] + rest(h) * (arc(h[1:], w) if not h[1:] or (*h[1:], w) in kept else backed(h[1:], w))

    def backed(h, w):
        return arc(h, w) if not h or (*h, w) in kept else rest(h) * backed(h[1:], w)

    result = []
    for i, t in split:
        state, base, total, known = ("<s>",) if counts["<s>",] else (), 0.0, 0.0, 0
        for w in t[1:]:
            base += math.log10((counts[w,] + 1) / (n + v + 1))
            known += counts[w,] > 0
            while state and (*state, w) not in kept:
                total += math.log10(rest(state))
                state = state[1:]
            total += math.log10(arc(state, w))
            state = (*state, w)[-(order - 1) :] if counts[w,] else ()
        result.append((i, len(t) - 1, known, n, base, total))
    return result


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(odd_docs, no_docs, order):
    rows = [(None if i is None else str(i), t) for i, t in pairs(odd_docs)]
    want = language_model(rows, order, grown=2)
    got = lm.score(odd_docs, order=order, grown=2).collect()
    assert len(got) == len(rows)
    order_of = lambda r: (r[0] or "", r[1], r[2], round(r[4], 6), round(r[5], 6))  # noqa: E731  repeated ids and rows too
    own = [(None if r.doc_id is None else str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for g, w in zip(sorted(own, key=order_of), sorted(want, key=order_of), strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 and abs(g[5] - w[5]) < 1e-6 * abs(w[5])
    assert lm.score(no_docs, order=order).count() == 0


def test_language_model_against_a_walk_by_tokens(spark, monkeypatch):
    """Real texts over many blocks and owners: states of each depth, failures from each, kept and pruned n-grams."""
    monkeypatch.setattr(lm, "BLOCK_MB", 0.02)
    monkeypatch.setattr(lm, "STRETCH", 9)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = language_model([(str(i), t) for i, t in pairs(docs)], 3)
    got = {str(r.doc_id): r for r in lm.score(docs).collect()}
    assert len(got) == len(want)
    for i, n, known, total, base, score in want:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score) < 1e-6 * abs(score)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


@pytest.mark.parametrize("operator", [toxicity, gam])
def test_classifiers_take_odd_rows(spark, odd_docs, no_docs, operator):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (5, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = operator.score(odd_docs, known).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert operator.score(no_docs, labels).count() == 0


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for operator, label, least in ((toxicity, "toxic", 0.93), (gam, "quality", 0.95)):
        held = operator.score(docs, labels).where("held_out").join(labels, "doc_id")
        right = held.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
        assert right >= least, (label, right)


def test_revisits(spark):
    schema = "capture_id long, url string, kind string, status int, ts long, etag string, last_modified string, headers map<string,string>, payload_digest string, payload_length long, period string"
    rows = [
        (1, "http://WWW.x.org:80/a#z", "response", 200, 10, '"e"', "d", {"ETag": '"e"', "Content-Length": "5", "Date": "1"}, "p1", 5, "x"),
        (2, "https://x.org/a", "response", 500, 20, None, None, None, "bad", 1, None),
        (3, "http://x.org/a", "revisit", 304, 10, '"e"', None, None, None, None, None),
        (4, "http://x.org/a", "revisit", 304, 99_999, 'W/"e"', None, {"date": "2", "content-length": "0"}, None, None, None),
        (5, "http://x.org/a", "revisit", 304, 30, '"other"', None, None, None, None, None),
        (6, "http://x.org/a", "revisit", 304, 31, None, "d", None, None, None, None),
        (7, None, "revisit", 304, 31, None, None, None, None, None, None), (8, "http://x.org", "revisit", 304, None, None, None, None, None, None, None), (6, "http://x.org/a", "revisit", 304, 31, None, "d", None, None, None, None),
    ]
    captures = spark.createDataFrame(rows, schema)
    got = sorted((r.capture_id, r.resolution, r.response_id, r.payload_digest, dict(r.headers) if r.headers is not None else None) for r in revisits.resolve(captures.drop("period")).collect())
    stored = {"ETag": '"e"', "Content-Length": "5", "Date": "1"}
    assert got == [(3, "no_response", None, None, None), (4, "matched", 1, "p1", {"ETag": '"e"', "Content-Length": "5", "date": "2"}), (5, "mismatched", 1, None, None), (6, "matched", 1, "p1", stored), (6, "matched", 1, "p1", stored), (7, "no_response", None, None, None), (8, "no_response", None, None, None)]
    assert revisits.resolve(captures.drop("period").limit(0)).count() == 0
    clashing = captures.selectExpr("*", "1 AS earlier", "2 AS near", "3 AS url_key", "4 AS response", "5 AS r", "6 AS resolution")
    assert sorted((r.capture_id, r.resolution) for r in revisits.resolve(clashing).collect()) == [(c, x) for c, x, *_ in got]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert 0 < docs.count() < before
    assert set(entries.queries()) >= {"op1_edit_aware_counts", "op9_suffix_trees"}


def brute_repeats(rows, size=35):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {p for j in range(len(w) - size + 1) if seen[tuple(w[j : j + size])] > 1 for p in range(j, j + size)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def test_suffix_trees_by_group(spark, monkeypatch):
    """Small bounds: landmarks split by the words ahead, whole windows as prefixes; no group is above its bound, and the results stay."""
    monkeypatch.setattr(repeats, "CHUNK", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute_repeats(pairs(docs))
    for bound in (8, 120, 10**6):
        parts = repeats._parts(docs.withColumn("__key", repeats.row_key()), 35, bound)
        sizes = [r[0] for r in parts.where(F.col("part") >= 0).groupBy("part").agg(F.sum("count")).select("sum(count)").collect()]
        assert sizes and max(sizes) <= bound
        assert (parts.where(F.col("part") == repeats.WHOLE).count() > 0) == (bound == 8)
        assert sorted((str(r[0]), *r[1:]) for r in repeats.report(docs, bound=bound).collect()) == want


def test_suffix_tree():
    """Order and common prefixes against sorted slices, and words with equal hashes told apart."""
    rng = np.random.default_rng(5)
    name, size = rng.integers(0, 3, 400), 11
    at = rng.choice(400 - size, 200, replace=False)
    order, common = repeats.suffix_tree(name, at, size)
    suffixes = [tuple(name[i : i + size]) for i in at[order]]
    assert suffixes == sorted(suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], common.tolist(), strict=False):
        assert n == next((k for k in range(size) if a[k] != b[k]), size)
    found = repeats.words_of(["one two one three two", "two"])
    found.hashes = np.zeros_like(found.hashes)
    assert repeats.word_names(found).tolist() == [0, 1, 0, 2, 1, 1]


def test_suffix_trees_hold_little_at_once(spark, monkeypatch):
    """A worker holds at most 110 bytes for each word of a batch or a group, and text comes to it in small batches."""
    rng = np.random.default_rng(9)
    words = [" ".join(f"word{k}" for k in rng.integers(0, 9000, 150).tolist()) for _ in range(2000)]
    found = repeats.words_of([*words, *words[:30]])
    runs = [" ".join(t.split()[a : a + 48]) for t in words for a in range(0, 98, 14)]
    n = np.arange(len(runs))
    group = pd.DataFrame([(1, n.astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), np.full(len(n), 14, np.int32).tobytes(), " ".join(runs).encode())], columns=["part", "rows", "starts", "counts", "words"])
    for many, work in ((len(found.hashes), lambda: repeats._batch(np.arange(2030), found, 35, 12)), (48 * len(runs), lambda: repeats._subtree(group, 35))):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 110 * many
    kept, write, conf = {}, repeats.materialize, "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(repeats, "materialize", lambda df, name: kept.update({name: spark.conf.get(conf)}) or write(df, name))
    before, rows = spark.conf.get(conf), [(i, t) for i, t in enumerate(words[:20] + words[:3])]
    assert sorted((str(r[0]), *r[1:]) for r in repeats.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_repeats(rows)
    assert kept["parts"] == "4000000" and spark.conf.get(conf) == before


def test_words_compared_in_blocks(monkeypatch):
    """Words with equal hashes are told apart in whichever block they are compared."""
    monkeypatch.setattr(repeats, "COMPARED", 8)
    texts = ["one two six ten abcdefghijkl one two six ten abcdefghijkl", "ten", ""]
    found = repeats.words_of(texts)
    assert repeats.word_names(found)[:5].tolist() == repeats.word_names(found)[5:10].tolist() and len({*repeats.word_names(found).tolist()}) == 5
    for odd in range(5):
        found = repeats.words_of(texts)
        found.data = found.data.copy()
        found.data[found.ends[odd] - 1] = 33  # its hash stays that of the later word
        name = repeats.word_names(found).tolist()
        assert [name[k] == name[k + 5] for k in range(5)] == [k != odd for k in range(5)] and len({*name}) == 6
    assert repeats.word_names(repeats.words_of([""])).tolist() == []


def test_maximal_repeats(spark):
    common = " ".join(f"c{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a b {common} d"), (2, f"x {common} y"), (3, "short"), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, repeats.maximal_repeats(docs).collect())) == [(1, 2, 52), (2, 1, 51)]


def test_suffix_trees_with_a_recurring_landmark(spark):
    """One phrase in every line can stay the landmark of several hundred windows in a row."""
    texts = [" ".join(f"c{d}.{j}" if j < 17 else f"u{d}.{line}.{j}" for line in range(60) for j in range(20)) for d in range(40)]
    longest = 0
    for t in texts:
        grams = repeats.run_hashes(repeats.words_of([t]).hashes, repeats.LANDMARK)
        longest = max(longest, *Counter(repeats.sliding_min(grams, 28).tolist()).values())
    assert longest > 255
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "x " + t[:4000]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((str(r[0]), *r[1:]) for r in repeats.report(docs).collect()) == brute_repeats(rows)


def test_suffix_trees_with_equal_rows_in_two_batches(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(1500)))] * 2
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert repeats.maximal_repeats(docs).where("start >= stop").count() == 0
    assert sorted((str(r[0]), *r[1:]) for r in repeats.report(docs).collect()) == brute_repeats(rows)


def test_jaccard_of_few_documents_in_many_buckets(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(6))) for i in range(20)] + [(20, "d0w0 d0w1 d0w2 d0w3 d0w4 d0w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.report(docs).collect()) == brute_components(rows, 85, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_decontamination_block_by_block(spark, odd_docs, monkeypatch):
    """Several blocks give what one gives, and no more than one block's windows are built at once."""
    items = spark.createDataFrame([("a", "cat sat on THE mat and the dog lay by"), ("a", "door of the old house today"), ("b", "one two"), ("c", None), ("d", "no id here"), (None, "same id")], "item_id string, text string").coalesce(1)
    rows = lambda: sorted(str(tuple(r)) for r in decontam.matches(odd_docs, items).collect())
    whole, report = rows(), sorted(map(str, decontam.report(odd_docs, items).collect()))
    sizes, windows = [], decontam.windows
    monkeypatch.setattr(decontam, "windows", lambda block, size: sizes.append((len(block), len(live), len(made))) or windows(block, size))
    live, made, destroy = [], [], decontam.Broadcast.destroy
    make = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: live.append(1) or made.append(1) or make(self, value))
    monkeypatch.setattr(decontam.Broadcast, "destroy", lambda self, *a: live.pop() and destroy(self, *a))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1)
    assert rows() == whole
    assert [n for n, _, _ in sizes] == [1, 1, 1, 2, 1] and all(held == 0 for _, held, _ in sizes)
    assert [sent for _, _, sent in sizes] == [0, 2, 4, 6, 8]  # a block is done before the next one's windows are built
    assert sorted(map(str, decontam.report(odd_docs, items).collect())) == report


def test_pipeline_run(spark, sf, encoding, tmp_path):
    """The run against brute force on what the quality rules keep; documents made of others' passages end empty and stay."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    long = [r for r in quality.rules(real).where("lang = 'en'").orderBy("doc_id").collect() if 200 < len(r.text.split()) < 2000][:12]
    made = [(10**6 + k, " ".join(a.text.split()[20:120] + b.text.split()[60:160]), "en", a.source, 0) for k, (a, b) in enumerate(zip(long[::2], long[1::2], strict=True))]
    real.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast(real.schema["n_chars"].dataType))).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = pairs(quality.rules(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert len({i for i, _ in rows}) == len(rows)
    first = {i for i, _, component in brute_components(rows, 80, 5) if i == component}
    rows = [(i, t) for i, t in rows if str(i) in first]
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    cut = []
    for (i, t), w in zip(rows, split, strict=True):
        gone = {p for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        cut.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    banned = {g for r in items.collect() if (w := low(r.text)) for g in grams(w, min(10, len(w)))}
    sizes = {len(g) for g in banned}
    clean = [(i, t) for i, t in cut if not any(grams(low(t), n) & banned for n in sizes)]
    want = sorted((i, encoding.encode_ordinary(t or "")) for i, t in clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, list(r.token_ids)) for r in got) == want
    assert all(r.n_tokens == len(r.token_ids) for r in got) and any(r.n_tokens == 0 for r in got)


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Nulls, repeated rows and ids, very long texts and clashing columns pass every stage; no rows give no rows."""
    items = spark.createDataFrame([("a", "no id here but some words"), ("b", None)], "item_id string, text string")
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"{tmp_path}/{name}").columns == docs.columns
        kept = quality.rules(docs)
        want = {r.doc_id for r in kept.collect()}
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} <= want and (len(got) > 0) == (len(want) > 0)
    rows = jaccard.keep_one(odd_docs).collect()
    assert sum(r.text is None or not r.text.strip() for r in rows) == 3  # empty sets all stay
    assert Counter(r.doc_id for r in rows)[2] == 0 and Counter(r.doc_id for r in rows)[1] == 1
    assert decontam.clean(odd_docs, items).where("text = 'no id here but some words'").count() == 0


def test_likely_rows_hold_all_wanted(spark):
    rows = spark.range(60000).selectExpr("xxhash64(id) AS k", "id")
    wanted = rows.where("id % 600 = 0").select("k")
    got = {r.id for r in common.likely(rows, wanted.unionByName(wanted), "k").collect()}
    assert {*range(0, 60000, 600)} <= got and len(got) < 200
    assert common.likely(rows, wanted.limit(0), "k").columns == rows.columns and common.likely(rows, wanted.limit(0), "k").count() == 0


def test_jaccard_keeps_prefixes_of_candidates_only(spark, monkeypatch):
    """Texts that share nothing are written with no prefix of the second and third order, and their texts aren't fetched."""
    kept, write = {}, jaccard.materialize

    def noted(df, name):
        out = write(df, name)
        for c in {"second", "third", "packed", "text"} & {*out.columns}:
            kept[c] = max(kept.get(c, 0), out.where(f"{c} IS NOT NULL").count())
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(40))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " tail") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.report(docs).collect()) == brute_components(rows, 85, 4)
    assert 10 <= min(kept.values()) and max(kept.values()) <= 20


def test_jaccard_lists_of_one_passage(spark, monkeypatch):
    """Texts that share passages are linked by none: lists with the same texts are kept once, and two texts with many common lists are paired once."""
    import random

    kept, write, conf = {}, jaccard.materialize, "spark.sql.execution.arrow.maxBytesPerBatch"

    def noted(df, name):
        out = write(df, name)
        kept.setdefault("batch", set()).add(spark.conf.get(conf))
        if name == "first":
            kept[name] = (out.count(), out.select("token").distinct().count(), out.groupBy("token").agg(F.sort_array(F.collect_list("node")).alias("x")).select("x").distinct().count())
        return out

    def crossed(*args):
        out = crossing(*args)
        pairs = out[0] if isinstance(out, tuple) else out
        kept["pairs"] = (pairs.count(), pairs.distinct().count())
        return out

    crossing, before = jaccard._crossing, spark.conf.get(conf)
    monkeypatch.setattr(jaccard, "materialize", noted)
    monkeypatch.setattr(jaccard, "_crossing", crossed)
    rng = random.Random(3)
    rows = [(i, " ".join([f"d{i}"] + [f"p{k}w{j}" for k in sorted(rng.sample(range(9), 5)) for j in range(10)])) for i in range(70)]
    rows += [(70, rows[0][1] + " tail"), (71, rows[1][1] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.report(docs).collect()) == brute_components(rows, 85, 4)
    assert kept["pairs"][0] == kept["pairs"][1] > 40
    assert kept["first"][1] == kept["first"][2] > 10
    assert kept["batch"] == {"4000000"} and spark.conf.get(conf) == before


def test_similarity_join_spills_large_keys(spark, monkeypatch):
    """While it runs, a merge join keeps few rows of a key as objects on the heap; the setting is put back."""
    key = "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold"
    before = spark.conf.get(key)
    monkeypatch.setattr(jaccard, "_members", lambda docs, percent, size: docs.sparkSession.conf.get(key))
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert jaccard.near_duplicates(docs) == "4096" and spark.conf.get(key) == before != "4096"
