"""A bounded sample of labelled rows, and what the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, the first by a hash of the id; with fewer, all.
LABELLED = 20_000


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id, which is then neither held out nor learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int = LABELLED) -> DataFrame:
    """(text, y) of at most ``limit`` labelled rows outside the held-out fold. An id with several labels counts as its greatest."""
    rows = labels.where((fold(F.col("doc_id"), modulus) != held_out) & F.col(label).isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    # Ids that aren't among the documents use up no places.
    rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` short rows: small enough to send to every executor.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
