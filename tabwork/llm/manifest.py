"""Merkle manifest of a dataset: every row is a leaf, every group a tree of its leaves in order, and the groups' roots have a
tree of their own. Each leaf comes back with its proof: what stands to the left and to the right of its digest on each level.

Time-forward processing: a node is labelled by its level and place. A priority queue ordered by label delivers the digests
of children to their parents, and the sweep back, from the last label to the first, delivers each node's proof to its
children, who put their own siblings before it. Both sweeps go block by block: a block is `arity ** levels` consecutive
nodes of a tree, its queue fits into a task, and what leaves it (its root going up, the proof of its root coming down) is
sorted and brought to its next reader by Spark's shuffle, which spills. So no task holds a tree, however large the group is.

Leaves are put in order by range, and numbered by the counts of ranges and groups. The driver sees the number of groups,
the size of the largest, and the root.

Defined results for odd input: a null field counts as `-`; a null group is a group of its own and the first; null ids come
first in their group; leaves of equal id are ordered by their digest, and repeated rows are leaves each; a group of one leaf
has that leaf as its root, and if it is the only group the proof is empty; an empty table gives an empty table; other input
columns are ignored; a text of any length is hashed whole, in one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import quoted, ranked, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Merkle:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    order: str = "doc_id"
    arity: int = 8
    #: levels that one task works through; it holds arity ** levels nodes
    levels: int = 4

    @property
    def block(self) -> int:
        return self.arity ** self.levels


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as its UTF-8 length, a colon and its text; `-` for null."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int, how: Merkle) -> int:
    """Levels above the nodes of a block in a tree with n nodes on their level."""
    levels = 0
    while n > 1 and levels < how.levels:
        n, levels = -(-n // how.arity), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int, arity: int) -> list[list[str]]:
    """The digests of a block by level, its own first. Messages (parent's label, child, digest) leave the queue by label."""
    found: list[list[str]] = [digests, *([] for _ in range(levels))]
    queue = [(1, i // arity, i, d) for i, d in enumerate(digests)] if levels else []  # in order, so a heap
    while queue:
        label, children = queue[0][:2], []
        while queue and queue[0][:2] == label:
            children.append(heappop(queue)[3])
        own = digest_of(children)
        found[label[0]].append(own)
        if label[0] < levels:
            heappush(queue, (label[0] + 1, label[1] // arity, label[1], own))
    return found


def sweep_down(found: list[list[str]], left: list[str], right: list[str], arity: int) -> tuple[list[list[str]], list[list[str]]]:
    """(left, right) of each node on the lowest level, given those of the block's root."""
    lefts, rights = [left], [right]
    for level in reversed(range(len(found) - 1)):
        below = [found[level][at:at + arity] for at in range(0, len(found[level]), arity)]
        lefts = [["".join(run[:i]), *above] for run, above in zip(below, lefts) for i in range(len(run))]
        rights = [["".join(run[i + 1:]), *above] for run, above in zip(below, rights) for i in range(len(run))]
    return lefts, rights


def _up(nodes: DataFrame, how: Merkle, name: str) -> DataFrame:
    """The roots of all blocks: tree, index (among the blocks of the tree), n (how many there are), digest; a saved table."""
    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("index")
        n = block["n"][0].as_py()
        top = sweep_up(block["digest"].to_pylist(), height(n, how), how.arity)[-1]
        return pa.table({"tree": block["tree"][:1], "index": block["block"][:1], "n": pa.array([-(-n // how.block)], pa.int64()), "digest": pa.array(top, pa.string())})

    blocks = nodes.withColumn("block", F.floor(F.col("index") / how.block).cast("long")).select("tree", "block", "index", "n", "digest")
    return saved(blocks.groupBy("tree", "block").applyInArrow(climb, "tree long, index long, n long, digest string"), name)


def _down(nodes: DataFrame, proofs: DataFrame, how: Merkle) -> DataFrame:
    """nodes with left and right; proofs: tree, block, left, right of the root of each block."""
    blocks = nodes.withColumn("block", F.floor(F.col("index") / how.block).cast("long"))

    def deliver(block: pa.Table, root: pa.Table) -> pa.Table:
        block = block.sort_by("index")
        found = sweep_up(block["digest"].to_pylist(), height(block["n"][0].as_py(), how), how.arity)
        lefts, rights = sweep_down(found, root["left"][0].as_py(), root["right"][0].as_py(), how.arity)
        texts = pa.list_(pa.string())
        return block.drop_columns("block").append_column("left", pa.array(lefts, texts)).append_column("right", pa.array(rights, texts))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return blocks.groupBy("tree", "block").cogroup(proofs.groupBy("tree", "block")).applyInArrow(deliver, f"{kinds}, left array<string>, right array<string>")


def _rounds(nodes: DataFrame, largest: int, how: Merkle, name: str) -> list[DataFrame]:
    """nodes, then the roots of their blocks, and so on until each tree has one."""
    found = [nodes]
    while len(found) < 2 or largest > 1:
        found.append(_up(found[-1], how, f"{name}-{len(found)}"))
        largest = -(-largest // how.block)
    return found


def _proofs(rounds: list[DataFrame], roots: DataFrame, how: Merkle) -> DataFrame:
    """The lowest nodes with their proofs; roots: tree, left, right."""
    above = roots.select("tree", F.lit(0).cast("long").alias("block"), "left", "right")
    for nodes in reversed(rounds[1:-1]):
        above = _down(nodes, above, how).select("tree", F.col("index").alias("block"), "left", "right")
    return _down(rounds[0], above, how)


def _placed(rows: DataFrame, how: Merkle) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, index and n; groups: tree, n), groups and leaves numbered in order."""
    order = [F.col("grp").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("digest")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ordered.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "leaves-by-range")
    # a row for each group in each range
    parts = placed.groupBy("grp", "range").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    before = F.sum("held").over(Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    parts = saved(parts.withColumn("before", F.coalesce(before, F.lit(0))), "leaf-ranges")
    sizes = parts.groupBy("grp").agg(F.sum("held").alias("n"))
    nulls = int(not parts.filter("grp IS NULL").isEmpty())
    rank = ranked(sizes, "grp").select(F.col("grp").alias("g"), F.when(F.col("grp").isNull(), 0).otherwise(F.col("position") + nulls).alias("tree"))
    groups = saved(sizes.join(rank, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "tree", "n"), "leaf-groups")
    starts = parts.join(groups.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).select(F.col("grp").alias("g"), F.col("range").alias("r"), "tree", "n", (F.col("before") - F.col("first")).alias("shift"))
    leaves = placed.join(starts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return leaves.select("tree", (F.col("at") + F.col("shift")).cast("long").alias("index"), "n", "digest", "ord", "seen"), groups.select("tree", "n")


def manifest(docs: DataFrame, how: Merkle = Merkle(), seen: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of docs: its id, leaf, subroot (its group's root), root, left and right (its proof, lowest level first), seen.

    seen: fields as somebody has them now, by name; the column of this name is the digest of the row with them (`verified` tells
    whether it still belongs to the root).
    """
    now = leaf(*[(seen or {}).get(f, quoted(f)) for f in how.fields])
    rows = saved(docs.select(quoted(how.order).alias("ord"), quoted(how.group).cast("string").alias("grp"), leaf(*map(quoted, how.fields)).alias("digest"), now.alias("seen")), "leaves")
    leaves, groups = _placed(rows, how)
    count = groups.agg(F.count("*").alias("n"), F.max("n").alias("largest")).first()
    trees = _rounds(leaves, count["largest"] or 0, how, "subtrees")
    subroots = trees[-1].select("tree", F.col("digest").alias("subroot"))
    tops = _rounds(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").cast("long").alias("index"), F.lit(count["n"]).cast("long").alias("n"), F.col("subroot").alias("digest")), count["n"], how, "toptree")
    root = tops[-1].first()
    nothing = F.array().cast("array<string>")
    top = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), nothing.alias("left"), nothing.alias("right"))
    above = _proofs(tops, top, how).select(F.col("index").alias("tree"), "left", "right")
    out = _proofs(trees, above, how).join(subroots.withColumnRenamed("tree", "t"), F.col("tree") == F.col("t"))
    return out.select(F.col("ord").alias(how.order), F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "left", "right", "seen")


def proof_text(left: Column | str = "left", right: Column | str = "right") -> Column:
    """All siblings' digests, lowest level first, from left to right."""
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")


def folded(digest: Column | str, left: Column | str = "left", right: Column | str = "right") -> Column:
    """The root that follows from a leaf's digest and its proof."""
    start = F.col(digest) if isinstance(digest, str) else digest
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), start, lambda d, s: F.sha2(F.concat(s["a"], d, s["b"]), 256))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    out = manifest(docs, seen={"text": tampered}).withColumn("folded_root", folded("seen"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of the decimal id, a bit at a time; nodes of both kinds of trees by level; proofs as steps of a row, folded one by one.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
c AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
    lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda s, one: xor(s >> 1, (s & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS crc FROM d WHERE doc_id IS NOT NULL),
f AS (SELECT rid, doc_id, lang, [coalesce(strlen(x) || ':' || x, '-') FOR x IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]] AS head, text, low FROM d),
h AS (SELECT f.rid, doc_id, lang, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(array_to_string(head, '') || coalesce(strlen(low) || ':' || low, '-')) AS lowered, coalesce(crc % 3 = 0, false) AS tampered FROM f LEFT JOIN c ON f.rid = c.rid),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h),
sub AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM p UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM sub WHERE n > 1 GROUP BY tree, level, idx // 8, n),
subroots AS (SELECT tree, digest AS subroot, level AS height FROM sub WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 8, n),
nodes AS (SELECT tree, level, idx, digest FROM sub WHERE n > 1 UNION ALL SELECT -1, level, idx, digest FROM top WHERE n > 1),
sides AS (
  SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes),
steps AS (
  SELECT rid, level AS step, l, r FROM p JOIN sides s ON s.tree = p.tree AND s.idx = p.idx // (8 ** level)::BIGINT UNION ALL
  SELECT rid, height + level, l, r FROM p JOIN subroots b ON b.tree = p.tree JOIN sides s ON s.tree = -1 AND s.idx = p.tree // (8 ** level)::BIGINT),
fold AS (
  SELECT rid, 0 AS step, CASE WHEN tampered THEN lowered ELSE leaf END AS digest FROM p UNION ALL
  SELECT f.rid, f.step + 1, sha256(l || f.digest || r) FROM fold f JOIN steps s ON s.rid = f.rid AND s.step = f.step),
ends AS (SELECT rid, max_by(digest, step) AS folded_root FROM fold GROUP BY rid),
proofs AS (SELECT rid, sha256(coalesce(string_agg(l || r, '' ORDER BY step), '')) AS proof_sha256 FROM (SELECT p.rid, step, l, r FROM p LEFT JOIN steps s ON s.rid = p.rid) GROUP BY rid),
root AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN subroots USING (tree) JOIN proofs USING (rid) JOIN ends USING (rid), root"""
