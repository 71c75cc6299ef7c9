"""Sharding by a k-d tree: nodes are split at weighted medians along their widest metadata dimension until the leaves hold
the target bytes. All nodes of a level are split together, and a median comes from histograms, not from a sort.

Equal texts stay in one shard: the points of the tree are groups of equal texts. Groups that weigh more than
`heavy_share` of a leaf are dealt to the leaves first, largest first, each to the emptiest leaf (there are at most
leaves / heavy_share of them, so the driver can do it); a group larger than a leaf is cut by a hash of its rows. The
splits then give each side of the tree the bytes that its leaves still lack.

A level takes two jobs: the widths of all nodes, and one histogram for all of them. A boundary bucket that holds more
than `tolerance` of a leaf is refined in a third. The driver sees a row per node; the tree itself is its list of splits.

Defined results for odd input: a null text counts as empty; null metadata sorts last, null ids first; equal rows and rows
that share an id or have none get slots of their own, and a heavy group of such rows is cut too; an empty table gives an
empty table; other input columns are ignored; a text of any length is measured whole.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ranked, saved, text_of


@dataclass(frozen=True)
class Tree:
    leaves: int = 16
    heavy_share: float = 0.05
    #: a cut is good enough if it misses its budget by this share of a leaf at most
    tolerance: float = 0.001
    #: slots of a shard are numbered in parts of about so many rows (64 parts at least), so that no task sorts a whole shard
    slot_rows: int = 1_000_000

    def __post_init__(self):
        if not 0 < self.leaves <= 65536:
            raise ValueError("between 1 and 65536 leaves, as one row per leaf is broadcast")


#: after so many levels the points are saved, so that a level works out no more than these again
SAVED_LEVELS = 4
DIMS = ("d_size", "d_id", "d_lang", "d_source")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own), size, text_crc32, group (hash of the text), and the metadata."""
    text = text_of()
    return docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _grouped(rows: DataFrame) -> DataFrame:
    """group, bytes, n, and the dimensions as numbers: languages and sources by their rank among all values."""
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), F.log2(F.max("size").cast("double")).alias("d_size"), F.coalesce(F.min("doc_id").cast("double"), F.lit(-1.0)).alias("d_id"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    for name in ("lang", "source"):
        # one row per value: broadcast by its measured size, and joined by shuffle beyond Spark's limit
        order = ranked(rows, name).select(F.col(name).alias(f"r_{name}"), F.col("position").cast("double").alias(f"d_{name}"))
        groups = groups.join(order, F.col(name).eqNullSafe(F.col(f"r_{name}"))).drop(name, f"r_{name}")
    return saved(groups, "groups")


def _part(parts) -> Column:
    """The part of a row of a heavy group, by a hash of the row."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id"), F.col("row")), parts).cast("int")


def _pieces(rows: DataFrame, heavy: list[tuple[int, int]], leaf: float) -> list[tuple[int, int, int, int]]:
    """(group, part, parts, bytes) of the heavy groups; a group larger than a leaf is cut by a hash of its rows, and the bytes of its parts are counted."""
    whole = [(group, 0, 1, size) for group, size in heavy if size <= leaf]
    cut = [(group, math.ceil(size / leaf)) for group, size in heavy if size > leaf]
    if not cut:
        return whole
    # at most one row per leaf
    inside = rows.join(F.broadcast(rows.sparkSession.createDataFrame(cut, "hg long, parts int")), F.col("group") == F.col("hg"))
    counted = inside.groupBy("group", "parts", _part(F.col("parts")).alias("part")).agg(F.sum("size").alias("bytes")).collect()
    return whole + [(r["group"], r["part"], r["parts"], r["bytes"]) for r in counted]


def _deal(pieces: list[tuple[int, int, int, int]], leaves: int) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """(group, part, parts, shard) for the pieces, largest first to the emptiest leaf, and what each leaf holds then."""
    load = [(0, shard) for shard in range(leaves)]
    dealt, held = [], [0.0] * leaves
    for group, part, parts, size in sorted(pieces, key=lambda p: (-p[3], p[:2])):
        full, shard = heapq.heappop(load)
        heapq.heappush(load, (full + size, shard))
        held[shard] = float(full + size)
        dealt.append((group, part, parts, shard))
    return dealt, held


def _widths(points: DataFrame, span: dict[str, tuple[float, float]], nodes: dict[int, tuple[int, int]], goal: list[float]) -> list[tuple]:
    """(node, dim, low, wide, budget) of every node of more than one leaf: its widest dimension and the bytes that go left."""
    stats = points.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{d}_{k}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    found = []
    for s in stats:
        lo, hi = nodes[s["node"]]
        if hi - lo < 2:
            continue
        width = {d: (s[f"{d}_hi"] - s[f"{d}_lo"]) / ((span[d][1] - span[d][0]) or 1.0) for d in DIMS}
        dim = max(DIMS, key=lambda d: (width[d], -DIMS.index(d)))
        mid = (lo + hi) // 2
        left, both = sum(goal[lo:mid]), sum(goal[lo:hi])
        found.append((s["node"], DIMS.index(dim), float(s[f"{dim}_lo"]), float(s[f"{dim}_hi"] - s[f"{dim}_lo"]) or 1.0, s["bytes"] * left / both if both else 0.0))
    return found


def _keyed(points: DataFrame, splits: DataFrame) -> DataFrame:
    """points joined with the splits of their nodes, with key: 1024 steps of the dimension, then 40 bits of a hash of the group for ties."""
    keyed = points.join(F.broadcast(splits), F.col("node") == F.col("sn"), "left")
    value = F.get(F.array(*DIMS), F.col("dim"))
    step = F.least(F.greatest((value - F.col("low")) / F.col("wide") * (1 << 10), F.lit(0.0)), F.lit(float((1 << 10) - 1))).cast("long")
    return keyed.withColumn("key", F.shiftleft(step, 40) + F.shiftrightunsigned(F.xxhash64(F.col("node"), F.col("group")), 24))


def _thresholds(points: DataFrame, splits: list[tuple], tolerance: float) -> dict[int, int]:
    """node -> key at which it is cut: from one histogram for all nodes, refined while a boundary bucket holds more than the tolerance."""
    spark, done = points.sparkSession, {}
    open_ = {s[0]: (0, (1 << 50) - 1, s[4], 0.0) for s in splits}
    keyed = _keyed(points, spark.createDataFrame(splits, "sn int, dim int, low double, wide double, budget double").drop("budget"))
    while open_:
        ranges = spark.createDataFrame([(n, lo, hi, budget, below) for n, (lo, hi, budget, below) in open_.items()], "rn int, lo long, hi long, budget double, below double")
        inside = keyed.join(F.broadcast(ranges), (F.col("node") == F.col("rn")) & F.col("key").between(F.col("lo"), F.col("hi")))
        bucket = F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * (1 << 18)).cast("long")
        sums = inside.groupBy("node", "budget", "below", bucket.alias("bucket")).agg(F.sum("bytes").alias("at"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        # at most 2^18 buckets a node
        upto = F.col("below") + F.sum("at").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.struct("bucket", "lo", "hi", "at", "upto")
        picked = sums.withColumn("upto", upto).groupBy("node", "budget").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("budget"), bound)), F.max(bound)).alias("b")).collect()
        open_ = {}
        for r in picked:
            b = r["b"]
            if b["at"] > tolerance and b["lo"] < b["hi"]:
                open_[r["node"]] = (b["lo"], b["hi"], r["budget"], b["upto"] - b["at"])
            else:
                over = abs(r["budget"] - b["upto"]) < abs(r["budget"] - (b["upto"] - b["at"]))
                done[r["node"]] = b["hi"] + 1 if over else b["lo"]
    return done


def sharded(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    rows = saved(described(docs), "described")
    groups = _grouped(rows)
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[f(d).alias(f"{d}{k}") for d in DIMS for k, f in ((0, F.min), (1, F.max))]).first()
    leaf = max(total["bytes"] / tree.leaves, 1.0)
    heavy = [(r["group"], r["bytes"]) for r in groups.filter(F.col("bytes") > tree.heavy_share * leaf).select("group", "bytes").collect()]
    dealt, held = _deal(_pieces(rows, heavy, leaf), tree.leaves)
    goal = [max(leaf - h, 0.0) for h in held]
    points = groups.filter(F.col("bytes") <= tree.heavy_share * leaf).select("group", "bytes", *DIMS, F.lit(1).alias("node"))
    span = {d: (total[f"{d}0"] or 0.0, total[f"{d}1"] or 0.0) for d in DIMS}
    nodes, level = {1: (0, tree.leaves)}, 0
    while any(hi - lo > 1 for lo, hi in nodes.values()):
        if level and level % SAVED_LEVELS == 0:
            points = saved(points, "points")
        splits = _widths(points, span, nodes, goal)
        cut = _thresholds(points, splits, tree.tolerance * leaf) if splits else {}
        table = spark.createDataFrame([(*s[:4], cut[s[0]]) for s in splits], "sn int, dim int, low double, wide double, threshold long")
        side = F.when(F.col("sn").isNull(), F.col("node")).when(F.col("key") < F.col("threshold"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
        points = _keyed(points, table).select("group", "bytes", *DIMS, side.alias("node"))
        level += 1
        nodes = {child: part for n, (lo, hi) in nodes.items() for child, part in (((2 * n, (lo, (lo + hi) // 2)), (2 * n + 1, ((lo + hi) // 2, hi))) if hi - lo > 1 else ((n, (lo, hi)),))}
    leaves = spark.createDataFrame([(n, lo) for n, (lo, _) in nodes.items()], "leaf int, shard int")
    light = points.join(F.broadcast(leaves), F.col("node") == F.col("leaf")).select("group", "shard")
    parts = min(max(64, -(-total["n"] // (tree.leaves * tree.slot_rows))), (1 << 20) // tree.leaves)
    return _numbered(_placed(rows, light, dealt, spark), parts)


def _placed(rows: DataFrame, light: DataFrame, dealt: list, spark) -> DataFrame:
    columns = ["doc_id", "row", "size", "text_crc32", "shard"]
    given = spark.createDataFrame([(g, part, parts, shard) for g, part, parts, shard in dealt], "hg long, part int, parts int, shard int")
    sizes = given.groupBy("hg").agg(F.max("parts").alias("parts"))
    # the heavy groups' rows join with a table of bounded size; the rest has no hot key left
    marked = rows.join(F.broadcast(sizes), F.col("group") == F.col("hg"), "left")
    hot = marked.filter(F.col("hg").isNotNull()).withColumn("p", _part(F.col("parts"))).drop("hg", "parts")
    hot = hot.join(F.broadcast(given.drop("parts")), (F.col("group") == F.col("hg")) & (F.col("p") == F.col("part"))).select(*columns)
    return marked.filter(F.col("hg").isNull()).select("doc_id", "row", "size", "text_crc32", "group").join(light, "group").select(*columns).unionByName(hot)


def _numbered(placed: DataFrame, parts: int) -> DataFrame:
    placed = saved(placed.withColumn("sub", F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id"), F.col("row")), F.lit(parts)).cast("int")), "placed")
    counts = placed.groupBy("shard", "sub").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("shard").alias("s"), F.col("sub").alias("u"), F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "row")) - 1
    return (placed.withColumn("number", number).join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("sub") == F.col("u")))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot")))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
