"""License scans by a positional index of rare words.

``frequencies`` counts, over all documents, in how many each word of the templates stands. A template stands at a start if enough of its words are
in place (COVER percent, each within SLACK words of its offset) and all its key phrases stand inside. So of its rarest words by that count, the
number that may be missing and two more, at least two are in place: these are indexed with their offsets. A file's words are looked up there, the
starts that they propose are intersected by relative position, and the starts on which two agree are verified in whole. Every start is found.

Texts stay where they are; only the counts of the templates' words are shuffled, and templates are a short configured list. Words are maximal runs
of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. Null and empty texts have no words: no places, null first and last,
empty labels, score 0. Each row is scanned for itself, so repeated rows give equal results; very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label | opening words of a license or of its usual notice | key phrases that must stand inside.
TEMPLATES = """
agpl-3.0 | this program is licensed under the gnu affero general public license version 3 | affero general public license
apache-2.0 | licensed under the apache license version 2 0 | apache license; version 2
bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met | redistribution and use; source and binary forms
cc-by-4.0 | licensed under cc by 4 0 | cc by 4
cc-by-4.0 | this work is licensed under a creative commons attribution 4 0 international license | creative commons attribution 4
cc-by-nc-4.0 | licensed under cc by nc 4 0 | cc by nc
cc-by-nc-4.0 | this work is licensed under a creative commons attribution noncommercial 4 0 international license | creative commons attribution noncommercial
cc-by-sa-4.0 | licensed under cc by sa 4 0 | cc by sa
cc0-1.0 | to the extent possible under law the author has waived all copyright and related or neighboring rights to this work | waived all copyright
gpl-2.0 | this work is licensed under the gnu general public license version 2 | gnu general public license; version 2
gpl-3.0 | this work is licensed under the gnu general public license version 3 | gnu general public license; version 3
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to use copy; hereby granted
lgpl-3.0 | this library is licensed under the gnu lesser general public license version 3 | lesser general public license
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | permission is hereby granted; free of charge
mit | released under the mit license | mit license
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0 | mozilla public license
unlicense | this is free and unencumbered software released into the public domain | unencumbered software; public domain
"""
#: Percent of a template's words that must be in place, and by how many words each may be off.
COVER, SLACK = 80, 2

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: bytes | None) -> list[bytes]:
    return _words(text.lower()) if text else []


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[bytes, ...]]

    @property
    def least(self) -> int:
        """How many words must be in place."""
        return -(-COVER * len(self.words) // 100)


def read(lines: str = TEMPLATES) -> list[Template]:
    fields = [[f.strip() for f in line.split("|")] for line in lines.strip().splitlines()]
    return [Template(label, words(text.encode()), [tuple(words(p.encode())) for p in keys.split(";")]) for label, text, keys in fields]


def _texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("binary").alias("t"))


def frequencies(docs: DataFrame, templates: list[Template]) -> dict[bytes, int]:
    """In how many of the documents each word of the templates stands; as many entries as the templates have words."""
    prepare(docs.sparkSession)
    known = {w for t in templates for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                found.update(known.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(found.values(), pa.int64())], ["w", "n"])

    rows = _texts(docs).select("t").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n")).collect()
    return {w: 0 for w in known} | {bytes(r[0]): r[1] for r in rows}


class Index:
    """Postings of the templates' rarest words, and the search of one file."""

    def __init__(self, templates: list[Template], often: dict[bytes, int], phrases: dict[str, str]):
        self.templates = templates
        self.base = [(tuple(words(p.encode())), label) for p, label in phrases.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(templates):
            spare = len(t.words) - t.least
            for o in sorted(range(len(t.words)), key=lambda o: (often[t.words[o]], o))[: spare + 2]:
                self.postings[t.words[o]].append((k, o))

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, int]]]:
        """Places (start, label) of the base phrases, and matches (label, start, words in place, words of the template)."""
        held = set(found)
        base = [(at, label) for p, label in self.base if held.issuperset(p) for at in _starts(found, p)]
        proposed: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for w in held & self.postings.keys():
            for k, o in self.postings[w]:
                proposed[k].append((o, w))
        matches = []
        for k, rare in sorted(proposed.items()):
            t = self.templates[k]
            if len(rare) >= min(2, len(t.words)) and all(held.issuperset(p) for p in t.phrases):
                matches += self._verified(found, t, rare)
        return base, matches

    def _verified(self, found: list[bytes], t: Template, rare: list[tuple[int, bytes]]) -> list[tuple[str, int, int, int]]:
        inside = [(len(p), _starts(found, p)) for p in t.phrases]
        if not all(at for _, at in inside):
            return []
        own, places = set(t.words), defaultdict(list)
        for i, w in enumerate(found):
            if w in own:
                places[w].append(i)
        votes: dict[int, set[int]] = defaultdict(set)
        for o, w in rare:
            for p in places[w]:
                for s in range(p - o - SLACK, p - o + SLACK + 1):
                    votes[s].add(o)
        out: list[tuple[str, int, int, int]] = []
        best = (0, 0)
        for s in sorted(s for s, v in votes.items() if len(v) >= min(2, len(t.words))):
            n = sum(_within(places[w], s + o - SLACK, s + o + SLACK) for o, w in enumerate(t.words))
            if n >= t.least and all(_within(at, s - SLACK, s + len(t.words) + SLACK - size) for size, at in inside):
                rank = (n, sum(_within(places[w], s + o, s + o) for o, w in enumerate(t.words)))
                if out and s - out[-1][1] < len(t.words):  # starts of one place: most words in place, then most at their very offset, then the first
                    if rank > best:
                        out[-1], best = (t.label, s, n, len(t.words)), rank
                else:
                    out.append((t.label, s, n, len(t.words)))
                    best = rank
        return out


def _starts(found: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """Where the words of a phrase stand behind one another."""
    out, at = [], -1
    try:
        while True:
            at = found.index(phrase[0], at + 1)
            if tuple(found[at : at + len(phrase)]) == phrase:
                out.append(at)
    except ValueError:
        return out


def _within(places: list[int], low: int, high: int) -> bool:
    at = bisect_left(places, low)
    return at < len(places) and places[at] <= high


_ROW = pa.schema([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("base", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("in_place", pa.int64()), ("n_words", pa.int64())])))])


def scan(docs: DataFrame, templates: list[Template] | None = None, phrases: dict[str, str] = PHRASES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, starts (of base phrases, ascending), base (labels), and matches (label, start, in_place, n_words)."""
    templates = read() if templates is None else templates
    prepare(docs.sparkSession)
    texts = _texts(docs, id_column, text)
    index = Index(templates, frequencies(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), templates), phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = words(t.as_py())
                base, matches = index.scan(found)
                rows.append((len(found), sorted(at for at, _ in base), sorted({label for _, label in base}), [dict(zip(("label", "start", "in_place", "n_words"), m, strict=True)) for m in matches]))
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_ROW.names])

    kind = docs.select(F.col(id_column).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, starts array<long>, base array<string>, matches array<struct<label:string,start:long,in_place:long,n_words:long>>")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a matched template's words that is in place, else 0)."""
    rows = scan(docs)
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"]))))
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["in_place"] / m["n_words"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.get("starts", F.lit(0)).alias("first_word"), F.array_max("starts").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


_LIST = ", ".join(f"({k}, '{t.label}', '{b' '.join(t.words).decode()}', {len(t.words)}, {t.least})" for k, t in enumerate(read()))
_KEYS = ", ".join(f"({k}, {i}, '{b' '.join(p).decode()}', {len(p)})" for k, t in enumerate(read()) for i, p in enumerate(t.phrases))
_BASE = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
SQL = f"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tp(k, label, t, m, least) AS MATERIALIZED (VALUES {_LIST}), kp(k, i, p, len) AS MATERIALIZED (VALUES {_KEYS}), bp(p, label, len) AS MATERIALIZED (VALUES {_BASE}),
tw AS MATERIALIZED (SELECT k, m, unnest(string_split(t, ' ')) AS t, unnest(range(m)) AS o FROM tp),
ph AS MATERIALIZED (SELECT DISTINCT p, len, split_part(p, ' ', 1) AS t FROM (SELECT p, len FROM kp UNION ALL SELECT p, len FROM bp)),
pos AS MATERIALIZED (SELECT * FROM (SELECT rid, unnest(w) AS t, unnest(range(len(w))) AS place FROM dw) WHERE t IN (SELECT t FROM tw UNION SELECT t FROM ph)),
st AS MATERIALIZED (SELECT pos.rid, p, len, place FROM pos JOIN ph ON pos.t = ph.t JOIN dw ON dw.rid = pos.rid WHERE array_to_string(w[place + 1:place + len], ' ') = p),
bs AS (SELECT rid, count(*) AS n, min(place) AS a, max(place) AS z FROM st JOIN bp ON st.p = bp.p GROUP BY 1),
able AS MATERIALIZED (SELECT rid, k FROM st JOIN kp ON st.p = kp.p GROUP BY 1, 2 HAVING count(DISTINCT i) = (SELECT count(*) FROM kp q WHERE q.k = kp.k)),
cov AS (
  SELECT rid, k, m, s, count(DISTINCT o) AS n FROM (SELECT pos.rid, tw.k, m, o, place - o + unnest(range({-SLACK}, {SLACK + 1})) AS s FROM able JOIN pos ON pos.rid = able.rid JOIN tw ON tw.t = pos.t AND tw.k = able.k) GROUP BY 1, 2, 3, 4),
ok AS MATERIALIZED (
  SELECT cov.rid, cov.k, label, cov.m, s, n FROM cov JOIN tp ON tp.k = cov.k AND n >= least JOIN kp ON kp.k = cov.k JOIN st ON st.rid = cov.rid AND st.p = kp.p AND place >= s - {SLACK} AND place <= s + cov.m + {SLACK} - kp.len
  GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(DISTINCT i) = (SELECT count(*) FROM kp q WHERE q.k = cov.k)),
sc AS (SELECT rid, max(n / m) AS score FROM ok GROUP BY 1),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS b FROM (SELECT DISTINCT rid, label FROM st JOIN bp ON st.p = bp.p) GROUP BY 1),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT rid, label FROM st JOIN bp ON st.p = bp.p UNION SELECT rid, label FROM ok) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(b, '') AS base_labels, coalesce(l, '') AS labels, coalesce(score, 0) AS score
FROM dw LEFT JOIN bs ON bs.rid = dw.rid LEFT JOIN sc ON sc.rid = dw.rid LEFT JOIN bl ON bl.rid = dw.rid LEFT JOIN al ON al.rid = dw.rid
"""
