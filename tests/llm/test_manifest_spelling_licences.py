"""Merkle manifests, spelling variants and license scans against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cinelake.llm import licences, merkle, spelling


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level, fanout):
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        i //= fanout
    return out


def manifest_rows(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((sha(*map(encoded, (r.doc_id, r.source, r.lang, r.n_chars, r.text))), r))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[1].doc_id is not None, x[1].doc_id, x[0]))
    trees = {k: tree([h for h, _ in g], fanout) for k, g in groups.items()}
    top = tree([trees[k][-1][0] for k in names], fanout)
    for j, k in enumerate(names):
        for i, (leaf, r) in enumerate(groups[k]):
            both = siblings(trees[k], i, fanout) + siblings(top, j, fanout)
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            node = sha(*map(encoded, (r.doc_id, r.source, r.lang, r.n_chars + hit if r.n_chars is not None else None, r.text)))
            for left, right in both:
                node = sha(left, node, right)
            yield r.doc_id, leaf, trees[k][-1][0], top[-1][0], sha(*[x for s in both for x in s]), node, node == top[-1][0]


ordered = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("block", [256, 4])
def test_manifest(spark, odd_docs, no_docs, monkeypatch, block):
    """In one block and in many, so that roots go up several tiers; odd rows, equal rows, a null group."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    more = spark.createDataFrame([(i, f"text {i}", ["en", "de", "Ö", "zh"][i % 4 if i % 3 else 0], "s", None if i % 11 == 0 else i, "x", 2) for i in range(100, 240)], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    got = merkle.report(docs)
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(tuple(r)[:7] for r in got.collect()) == ordered(manifest_rows(docs.collect(), 2))
    if block == 256:
        assert merkle.report(no_docs).count() == 0


def test_manifest_of_wider_runs(spark, monkeypatch):
    """A run of three: siblings stand on both sides; a changed leaf doesn't fold to the root."""
    monkeypatch.setattr(merkle, "BLOCK", 9)
    leaves = [sha(str(i)) for i in range(31)]
    rows = spark.createDataFrame([("g", i, h) for i, h in enumerate(leaves)] + [("other", 0, sha("x"))], "g string, i int, digest string")
    made = merkle.manifest(rows, "g", "i", ["i"], fanout=3)
    want = tree([tree(leaves, 3)[-1][0], sha("x")], 3)[-1][0]
    assert made.root == want
    again = made.proofs().select("digest", merkle.folded(merkle.F.col("digest"), merkle.F.col("flanks")).alias("a"), merkle.folded(merkle.F.sha2("digest", 256), merkle.F.col("flanks")).alias("b")).collect()
    assert len(again) == 32 and all(r.a == want != r.b for r in again)


def test_one_row(spark, odd_docs):
    """A lone leaf is its group's root, and a lone group's root is the root."""
    one = odd_docs.where("doc_id = 7")
    r = merkle.report(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("") and r.verified == (zlib.crc32(b"7") % 7 != 0)


def spellings(rows, drop=199):
    found = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    n = {w: c for w, c in found.items() if len(w) >= 6 and c >= 5}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for g in gaps.values():
        for w in g:
            near[w] |= g - {w}
    form = {w: b for w in n if near[w] for b in [min(near[w], key=lambda x: (-n[x], x))] if n[b] >= 5 * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))


@pytest.mark.parametrize("most", [32, 0.1])
def test_spellings(spark, odd_docs, no_docs, monkeypatch, most):
    """With groups as they are, and with every group split down to one place."""
    monkeypatch.setattr(spelling, "PAIRS", most)
    rng = random.Random(5)
    base = ["zimmerés", "partition", "aaaaaaa", "überallängen", "separate", "÷×÷×÷×"]

    def edited(w):
        i, c = rng.randrange(len(w) + 1), rng.choice("abéöz")
        return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])

    words = [w for b in base for w in [b] * 60 + [edited(b) for _ in range(60)] * 6 + [edited(edited(b)) for _ in range(60)] * 5 + [b] * 400]
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "’", "_", "3"]).join(words[i::40]).upper() if i % 9 == 0 else " ".join(words[i::40])) for i in range(40)] + [(50, "Œuvre" * 3 + " \U0001f600abcdefg" * 5)]
    docs = spark.createDataFrame([(i, t, None, None, 0, "x", 1) for i, t in rows], odd_docs.schema).unionByName(odd_docs)
    want = ordered(spellings([(r.doc_id, r.text) for r in docs.collect()]))
    assert ordered(map(tuple, spelling.report(docs).collect())) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[1] != w[2] for w in want)
    if most == 32:
        assert spelling.report(no_docs).count() == 0


def scanned(text):
    """Every start of every template, without an index."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    at = lambda p: [i for i in range(len(w)) if w[i : i + len(p)] == p]
    base = sorted((i, label) for p, label in licences.PHRASES.items() for i in at(p.split()))
    labels, score = {label for _, label in base}, 0.0
    for t in licences.read():
        own, keys, m = [x.decode() for x in t.words], [[x.decode() for x in p] for p in t.phrases], len(t.words)
        for s in range(-m, len(w) + m):
            n = sum(own[o] in w[max(0, s + o - 2) : max(0, s + o + 3)] for o in range(m))
            if 100 * n >= 80 * m and all(any(s - 2 <= i and i + len(p) <= s + m + 2 for i in at(p)) for p in keys):
                labels.add(t.label)
                score = max(score, n / m)
    names = lambda x: ",".join(sorted(x))
    return len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, names({label for _, label in base}), names(labels), score


def test_licences(spark, odd_docs, no_docs):
    rng, notices = random.Random(2), [b" ".join(t.words).decode() for t in licences.read()]
    rows = [(100, "Licensed under CC BY-NC 4.0."), (101, "the MIT License and, apart from it, the Apache License"), (102, "All rights reserved. All Rights\nReserved!"), (103, "Copyright X. Released under the well known MIT License"), (104, "MIT license released under the"), (105, "GNU General Public License, version 3 " * 40)]
    for i in range(60):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = rng.choice([[], ["other"], ["one", "two"], [words[k - 1]]])
        rows.append((200 + i, " ".join([*("lead the of " * rng.randrange(3)).split(), *words, "under the version of license"])))
    docs = spark.createDataFrame([(i, t, None, None, 0, "x", 1) for i, t in rows], odd_docs.schema).unionByName(odd_docs)
    got = licences.report(docs)
    want = ordered((r.doc_id, *scanned(r.text)) for r in docs.collect())
    assert ordered(map(tuple, got.collect())) == want
    assert {label for w in want for label in w[6].split(",") if label} >= {"mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0", "cc-by", "reserved"}
    assert licences.report(no_docs).count() == 0


def test_licence_spans(spark):
    """Two notices in one file are two matches at their places, in whatever column."""
    text = f"one two Released under the MIT License {'x ' * 30} licensed under the apache license version 2.0"
    r = licences.scan(spark.createDataFrame([("a", text)], "key string, body string"), id_column="key", text="body").first()
    assert r.doc_id == "a" and sorted((m.label, m.start, m.in_place, m.n_words) for m in r.matches) == [("apache-2.0", 37, 8, 8), ("mit", 2, 5, 5)]
