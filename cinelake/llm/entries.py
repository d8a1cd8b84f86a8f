"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, edits, gam, jaccard, licences, lm, merkle, quality, repeats, revisits, spelling, toxicity
from .common import table


def op1_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.report(table(spark, sf_dir, "documents"), *bpe.vocabulary())


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *bpe.vocabulary())


def op6_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.report(table(spark, sf_dir, "pages"))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_edit_aware_counts, op2_divergence_rules, op3_weak_supervision, op4_additive_model, op5_bpe_round_trip, op6_multi_order_join, op7_revisits, op8_positional_index, op9_suffix_trees, op10_backoff_automaton, op11_spelling_variants, op12_merkle_manifest, op13_licence_scan)}


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dg.n, item FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
wt AS MATERIALIZED (SELECT g, n, unnest(string_split(g, ' ')) AS t, unnest(range(n)) AS o FROM (SELECT DISTINCT g, n FROM win)),
p AS MATERIALIZED (SELECT * FROM (SELECT doc_id, rid, unnest(w) AS t, unnest(range(len(w))) AS pos FROM dw) WHERE t IN (SELECT t FROM wt)),
df AS (SELECT t, count(DISTINCT rid) AS df FROM p GROUP BY 1),
anchor AS MATERIALIZED (SELECT g, any_value(n) AS n, arg_min(wt.t, df * 1000 + o) AS t, arg_min(o, df * 1000 + o) AS o FROM wt LEFT JOIN df USING (t) GROUP BY g HAVING count(df) = count(*)),
cand AS (SELECT g, n, doc_id, rid, pos - o AS s FROM anchor JOIN p USING (t)),
nr AS (SELECT c.g, c.doc_id, c.rid, c.s FROM cand c JOIN wt ON wt.g = c.g JOIN p ON p.rid = c.rid AND p.t = wt.t AND abs(p.pos - (c.s + wt.o)) <= 2 GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT wt.o) = max(c.n)),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM nr JOIN win USING (g) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM dw WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw) a ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_revisits": revisits.SQL, "op8_positional_index": OP8_SQL, "op9_suffix_trees": OP9_SQL, "op11_spelling_variants": spelling.SQL, "op12_merkle_manifest": merkle.SQL, "op13_licence_scan": licences.SQL}
