"""A Merkle manifest of a table: one tree for each group, one over the groups' roots, and a proof for every row.

A level of an aligned block of at most BLOCK nodes is one string of fixed-width hex digests. The next level is hashed from substrings of
``fanout`` digests, and a node's siblings are the two substrings that flank it in its run. The roots of a group's blocks are the nodes of the
next tier and go through the same job, until a group has one block; the groups' roots make one more tree. Proofs are joined from the top
down by block, so only the first tier's blocks, one row for BLOCK leaves, meet what lies above them.

Leaves are placed by range partitions of (group, order) with the place in the partition added up, so no window holds a group. Rows of a
group with one order value follow their leaf digests, nulls first; rows equal in all columns take neighbouring places in any order. A null
group is a group of its own, ahead of the others, which follow bytewise. Null, empty and very long values are hashed as stated in
``encoded``; columns that aren't hashed or kept are ignored. An empty table has no groups, no root (null) and no proofs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import let
from .common import join_salted, materialize

#: Hex digits of a digest, and the most nodes of a block.
WIDTH, BLOCK = 64, 256
#: A table of groups or of partitions of groups with at most so many rows is broadcast; a longer one is joined by salted keys.
LISTED = 50_000
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts behind one another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[encoded(c) for c in columns.values()])


def _attach(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.join(F.broadcast(right), [*keys]) if right.count() <= LISTED else join_salted(left, right, *keys)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, each row's place in its group ``k`` by ``order``, and ``n``, the group's size."""
    dealt = rows.withColumn("__seq", F.monotonically_increasing_id())  # lets equal rows be dealt to several partitions
    dealt = dealt.repartitionByRange("k", *order, "__seq").sortWithinPartitions("k", *order, "__seq").drop("__seq")
    at = F.monotonically_increasing_id()
    dealt = materialize(dealt.withColumn("__at", at), "placed")
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    sums = materialize(dealt.groupBy("k", "__part").agg(F.count("*").alias("c"), F.min("__at").alias("first")), "places")
    group = Window.partitionBy("k")  # a row for each partition that holds some of the group
    before = F.coalesce(F.sum("c").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("k", "__part", F.sum("c").over(group).alias("n"), (before - F.col("first")).alias("shift"))
    return _attach(dealt, offsets, "k", "__part").withColumn("pos", F.col("__at") + F.col("shift")).drop("__at", "__part", "shift")


def _depth(fanout: int) -> int:
    """Levels that a whole block is hashed up."""
    depth = 1
    while fanout ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


def _parents(level: Column, fanout: int) -> Column:
    run = WIDTH * fanout
    starts = F.sequence(F.lit(1), F.length(level), F.lit(run))
    return F.array_join(F.transform(starts, lambda s: F.sha2(F.substring(level, s, F.lit(run)), 256)), "")


def _levels(level: Column, alone: Column, fanout: int) -> Column:
    """The block's levels from its nodes up: to its root, or, where other blocks stand beside it, up all levels of a whole block."""

    def step(levels: Column, _: Column) -> Column:
        return let(F.element_at(levels, -1), lambda top: F.when(alone & (F.length(top) == WIDTH), levels).otherwise(F.concat(levels, F.array(_parents(top, fanout)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_depth(fanout))), F.array(level), step)


def tiers(nodes: DataFrame, fanout: int, kept: list[str] = ()) -> list[DataFrame]:
    """Blocks (k, block, n, rows, levels) of (k, pos, n, digest, kept...) and of the roots of blocks, tier by tier, each written."""
    size, out = fanout ** _depth(fanout), []
    while True:
        rows = F.array_sort(F.collect_list(F.struct("pos", "digest", *kept)))  # at most ``size``
        blocks = nodes.groupBy("k", F.floor(F.col("pos") / size).alias("block")).agg(F.max("n").alias("n"), rows.alias("rows"))
        level = F.array_join(F.transform("rows", lambda r: r["digest"]), "")
        blocks = blocks.withColumn("levels", _levels(level, F.col("n") <= size, fanout))
        if kept:
            blocks = blocks.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in kept])))
        else:
            blocks = blocks.drop("rows")
        out.append(materialize(blocks, "blocks"))
        nodes, kept = out[-1].where(F.col("n") > size).select("k", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.element_at("levels", -1).alias("digest")), []
        if nodes.isEmpty():
            return out


def roots(trees: list[DataFrame], fanout: int) -> DataFrame:
    """(k, digest): each group's root, from the tier at which it has one block."""
    size = fanout ** _depth(fanout)
    tops = [t.where(F.col("n") <= size).select("k", F.element_at("levels", -1).alias("digest")) for t in trees]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _flanks(levels: Column, i: Column, fanout: int) -> Column:
    """For each level below the block's root what stands left and right, in its run, of the node above place ``i``."""

    def at(level: Column, up: Column) -> Column:
        def cut(node: Column) -> Column:
            first = node - node % fanout
            left = F.substring(level, first * WIDTH + 1, (node - first) * WIDTH)
            right = F.substring(level, (node + 1) * WIDTH + 1, (first + fanout - node - 1) * WIDTH)
            return F.struct(left.alias("left"), right.alias("right"))

        return let(F.floor(i / F.pow(F.lit(fanout), up)).cast("int"), cut)

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


FLANKS = "array<struct<left:string,right:string>>"


def proofs(trees: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """(k, pos, digest, flanks, the kept and ``above``'s columns) of every node of the first tier; ``above``: (k, flanks, ...) of each group's root."""
    size, upper = fanout ** _depth(fanout), None
    extra = [c for c in above.columns if c not in ("k", "flanks")]
    for tier in reversed(trees):
        tops = _attach(tier.where(F.col("n") <= size), above, "k")
        if upper is not None:
            under = tier.where(F.col("n") > size).join(upper.withColumnRenamed("pos", "block").drop("digest"), ["k", "block"])
            tops = tops.unionByName(under)
        names = [f.name for f in tier.schema["rows"].dataType.elementType.fields] if "rows" in tier.columns else []
        places = F.sequence(F.lit(0), (F.length(F.col("levels")[0]) / WIDTH).cast("int") - 1)
        own = F.transform(places, lambda i: F.struct((F.col("block") * size + i).alias("pos"), F.substring(F.col("levels")[0], i * WIDTH + 1, F.lit(WIDTH)).alias("digest"), _flanks(F.col("levels"), i, fanout).alias("own"), *[F.get("rows", i)[c].alias(c) for c in names]))
        upper = tops.select("k", "flanks", *extra, F.inline(own)).select("k", "pos", "digest", F.concat("own", "flanks").alias("flanks"), *names, *extra)
    return upper


def folded(start: Column, flanks: Column) -> Column:
    """The root that a leaf digest and its siblings make."""
    return F.aggregate(flanks, start, lambda node, s: digest(s["left"], node, s["right"]))


@dataclass
class Manifest:
    """``leaves``: tiers of the groups' trees; ``tops``: those of the tree over their roots; ``groups``: (k, digest, pos) of the groups; ``root``: its digest."""

    leaves: list[DataFrame]
    tops: list[DataFrame]
    groups: DataFrame
    root: str | None
    fanout: int

    def proofs(self) -> DataFrame:
        """(digest, flanks, subroot, root, kept columns) of every leaf."""
        none = self.groups.sparkSession.createDataFrame([("", [])], f"k string, flanks {FLANKS}")
        over = proofs(self.tops, none, self.fanout).select("pos", "flanks")
        above = materialize(self.groups.join(over, "pos").select("k", "flanks", F.col("digest").alias("subroot")), "subroots")
        return proofs(self.leaves, above, self.fanout).withColumn("root", F.lit(self.root))


def manifest(rows: DataFrame, group: str, order: str, kept: list[str], fanout: int = 2) -> Manifest:
    """Trees over (group, order, digest, kept...); the leaves of a group ascend by ``order``, then ``digest``."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # sorts null first, the rest bytewise
    keyed = rows.select(key.alias("k"), F.col(order).alias("o"), "digest", *[F.col(c).alias(f"kept_{c}") for c in kept])
    leaves = tiers(placed(keyed, ["o", "digest"]), fanout, [f"kept_{c}" for c in kept])
    subroots = materialize(roots(leaves, fanout).select(F.lit("").alias("k"), F.col("k").alias("g"), "digest"), "roots")
    listed = placed(subroots, ["g"])
    tops = tiers(listed.drop("g"), fanout)
    found = roots(tops, fanout).first()
    return Manifest(leaves, tops, listed.select(F.col("g").alias("k"), "digest", "pos"), found[1] if found else None, fanout)


def report(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and n_siblings.

    The fold starts from the leaf as it is read again: where 7 divides the CRC of the id, with one more in n_chars.
    """
    columns = {c: F.col(c) for c in COLUMNS}
    read = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(columns | {"n_chars": F.col("n_chars") + 1}))
    rows = docs.select("lang", "doc_id", leaf(columns).alias("digest"), read.alias("read"))
    found = manifest(rows, "lang", "doc_id", ["doc_id", "read"]).proofs()
    siblings = F.array_join(F.transform("flanks", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select(F.col("kept_doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("kept_read", "digest"), F.col("flanks")).alias("folded_root"), (F.length(siblings) / WIDTH).cast("long").alias("n_siblings"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "n_siblings")


_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
_CRC = f"xor(list_reduce([4294967295] || {_BYTES}, lambda c, b: list_reduce([xor(c, b)] || range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = "sha256(concat(" + ", ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + "))"
_STEP = "SELECT k, lvl + 1, (n + 1) // 2, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY k, lvl, n, pos // 2"
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS k, {_LEAF.format('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format('n_chars + 1')} END AS read FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
t AS (SELECT k, 0 AS lvl, n, pos, leaf AS h FROM l UNION ALL {_STEP.format('t')}),
s AS MATERIALIZED (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT '' AS k, 0 AS lvl, n, pos, h FROM s UNION ALL {_STEP.format('u')}),
a AS MATERIALIZED (SELECT l.k, l.pos, t.lvl, CASE WHEN t.pos % 2 = 0 THEN 'L' ELSE 'R' END || t.h AS sib FROM l JOIN t ON t.k = l.k AND t.n > 1 AND t.pos = xor(l.pos >> t.lvl, 1)
  UNION ALL SELECT l.k, l.pos, t.lvl, 'N' FROM l JOIN t ON t.k = l.k AND t.n > 1 AND t.pos = l.pos >> t.lvl AND t.pos % 2 = 0 AND t.pos = t.n - 1
  UNION ALL SELECT l.k, l.pos, 1000 + u.lvl, CASE WHEN u.pos % 2 = 0 THEN 'L' ELSE 'R' END || u.h FROM l JOIN s ON s.k = l.k JOIN u ON u.n > 1 AND u.pos = xor(s.pos >> u.lvl, 1)
  UNION ALL SELECT l.k, l.pos, 1000 + u.lvl, 'N' FROM l JOIN s ON s.k = l.k JOIN u ON u.n > 1 AND u.pos = s.pos >> u.lvl AND u.pos % 2 = 0 AND u.pos = u.n - 1),
p AS (SELECT k, pos, list(sib ORDER BY lvl) AS sibs FROM a GROUP BY 1, 2),
f AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, array_to_string(list_transform(coalesce(sibs, []), lambda x: x[2:]), '') AS flat,
    list_reduce([coalesce(read, leaf)] || coalesce(sibs, []), lambda h, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || h) WHEN 'R' THEN sha256(h || x[2:]) ELSE sha256(h) END) AS folded_root
  FROM l JOIN s ON s.k = l.k LEFT JOIN p ON p.k = l.k AND p.pos = l.pos)
SELECT doc_id, leaf, subroot, root, sha256(flat) AS proof_sha256, folded_root, folded_root = root AS verified, CAST(length(flat) // 64 AS BIGINT) AS n_siblings FROM f
"""
