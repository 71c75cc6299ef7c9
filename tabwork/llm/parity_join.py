"""N-gram Jaccard join by parity sketches.

A text's set of shingles is folded by XOR into bit sketches: each shingle flips one bit. The bits in which two sketches
differ (their Hamming distance) can never be more than the shingles in which the sets differ, and 0.75 or more in common
means that sets of a and b shingles differ in (a + b) / 7 at most. Two sketches are used:

* a wide one per size band, cut into as many lanes as the band's largest set has members. A lane is kept as the XOR of
  the hashes of its bits. Two sets that may link differ in at most k lanes, so by the pigeonhole principle they agree in
  a filled lane among the k + 1 that come first in an order all sets share. Lanes are joined by equality.
* a narrow one of about a bit for each shingle (a power of two, 1024 at least), compared before the shingles themselves
  are. A sketch folds to half its bits by XOR of its halves, so sketches of two sizes compare.

What is left is verified on the whole shingle sets.

Copies do not become pairs. Equal sets are one node. In each bucket of equal lanes all nodes are first compared with the
smallest one, and linked nodes are contracted to components; only then are pairs across components made. Lanes that many
components share (passages of many texts) come last in the order: a node emits 1 + n / 32 spare lanes, and the nodes that
have more common lanes than that are joined once more among themselves by their rarest lanes. No bucket is cut or dropped.

Lanes that very many texts share (found by counts over a sample of the nodes; the sample decides only how a lane is
worked on) do not go through one task: their smallest node and size come from partial sums and are broadcast.

Defined results for odd input: null and empty texts have no shingles and are components of their own; every row is a
document, so rows that share a doc_id are compared each on its own and give a row each; rows without a doc_id take part
too, and a component is named by the smallest doc_id in it, or null where it has none; an empty table gives an empty
table; other input columns are ignored; a text of any length is read whole, in one task. Hashes of 64 bits stand for
words and shingles, 128 bits for sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import free_name, quoted, saved
from .shingles import in_chunks, mixed, shingle_sets

_U = np.uint64
#: longs in the sketch that travels with the lanes
BRIEF = 4


@dataclass(frozen=True)
class Join:
    #: buckets of up to so many nodes become pairs at once
    common: int = 64
    least_bits: int = 1024
    #: at most so many of the fullest lanes are kept out of the shuffle by lane, if `hot_nodes` of the sampled nodes have them
    hot_lanes: int = 1000
    hot_nodes: int = 32
    hot_sample: int = 64
    #: lists of up to so many ids are broadcast to pick texts; longer ones meet the texts in a shuffle
    broadcast_ids: int = 250_000


def _limit(a: int, b: int) -> int:
    """How many shingles sets of these sizes may differ in: |A xor B| <= (a + b) / 7."""
    return (a + b) // 7


def _levels(n: int) -> list[tuple[int, int]]:
    """(band, most different shingles) of each band in which a set of n members meets others: its own, and the one below where its smaller partners are."""
    def band(m: int) -> int:
        return max(0, ((m - 1).bit_length() - 1) // 2)

    own = band(n)
    out = [(own, _limit(n, 4 * n // 3))]
    low = band(-(-3 * n // 4))
    if low < own:
        out.append((low, _limit(n, 4 ** (low + 1))))
    return out


def lanes(members: np.ndarray, band: int) -> np.ndarray:
    """Keys of the filled lanes of a sorted set in a band, in ascending order."""
    top = 4 ** (band + 1)
    if band < 2:
        lane = members
    else:
        lane = (members >> _U(32)) * _U(top) >> _U(32)
    first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    pattern = np.bitwise_xor.reduceat(mixed(members ^ _U(0xA5A5A5A5DEADBEEF)), first)
    keys = mixed(pattern ^ mixed(lane[first] + _U((band + 1) << 56)))
    keys.sort()
    return keys


def _sketch(members: np.ndarray, least: int, most: int = 1 << 62) -> np.ndarray:
    bits = min(most, max(least, 1 << (max(len(members), 1) - 1).bit_length()))
    flips = np.bincount((members & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _lists(values: list[np.ndarray], kind=np.int64) -> pa.Array:
    flat = np.concatenate(values).view(kind) if values else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(flat))


def _each(rows: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow over (id, text): make(ids, sets) gives the columns of a batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in in_chunks(b):
                yield pa.RecordBatch.from_arrays(make(ids, shingle_sets(texts)), names=names)
            del b
        # a worker that waits for its next task keeps no batches
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def described(rows: DataFrame, how: Join) -> DataFrame:
    """uid, n, hi, lo (128 bits for the set), sketch, brief (one of 256 bits); rows: uid, text."""
    def make(ids, sets):
        return [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], _U).view(np.int64)),
                pa.array(np.array([np.add.reduce(mixed(s + _U(77))) if len(s) else 0 for s in sets], _U).view(np.int64)),
                _lists([_sketch(s, how.least_bits) for s in sets]), _lists([_sketch(s, 64 * BRIEF, 64 * BRIEF) for s in sets])]

    return _each(rows.select("uid", "text"), "uid long, n long, hi long, lo long, sketch array<long>, brief array<long>", make)


def _members(texts: DataFrame) -> DataFrame:
    return _each(texts, "node long, members array<long>", lambda ids, sets: [pa.array(ids, pa.int64()), _lists(sets)])


def _spare(n: int) -> int:
    return 1 + n // 32


def _keys(texts: DataFrame, every: bool) -> DataFrame:
    """node, band, need (lanes that must be looked at), key: the first lanes of each node, or all of them."""
    def make(ids, sets):
        rows = [(i, band, k + 1, lanes(s, band)) for i, s in zip(ids, sets) if len(s) for band, k in _levels(len(s))]
        keys = [x if every else x[:need + _spare(len(s))] for (_, _, need, x), s in zip(rows, (s for s in sets if len(s) for _ in _levels(len(s))))]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), _lists(keys)]

    return _each(texts, "node long, band int, need int, keys array<long>", make)


def components(links: DataFrame) -> DataFrame:
    """v, comp: the smallest node that each linked node reaches. Every round each node moves to the smallest neighbour of its smallest neighbour, and edges inside merged nodes go."""
    edges = saved(links.select("a", "b").filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = saved(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "up")
        twice = up.join(up.select(F.col("v").alias("w"), F.col("p").alias("q")), F.col("p") == F.col("w"))
        up = saved(twice.select("v", F.least("p", "q").alias("p")), "up")
        steps.append(up)
        left = edges.join(up, F.col("a") == F.col("v")).select(F.col("p").alias("a"), "b").join(up, F.col("b") == F.col("v")).select("a", F.col("p").alias("b"))
        edges = saved(left.filter("a <> b").distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    found = steps[0].select("v", F.col("p").alias("comp"))
    for up in steps[1:]:
        found = found.join(up.select(F.col("v").alias("w"), "p"), F.col("comp") == F.col("w"), "left").select("v", F.coalesce("p", "comp").alias("comp"))
    return saved(found, "components")


def _picked(texts: DataFrame, ids: DataFrame, how: Join, kind: str = "left_semi") -> DataFrame:
    """texts whose node is (or, for left_anti, is not) in ids, a saved table of node."""
    few = ids.limit(how.broadcast_ids + 1).count() <= how.broadcast_ids
    return texts.join(F.broadcast(ids) if few else ids, "node", kind)


def _distance(a: str, b: str):
    """Hamming distance of two sketches of any two sizes; the larger is folded."""
    large, small = F.when(F.size(a) > F.size(b), F.col(a)).otherwise(F.col(b)), F.when(F.size(a) > F.size(b), F.col(b)).otherwise(F.col(a))

    def bits(x, i):
        # at most twice the size, as sizes differ by a third at most
        return F.bit_count(x.bitwiseXOR(F.get("_large", i)).bitwiseXOR(F.when(F.size("_large") > F.size("_small"), F.get("_large", i + F.size("_small"))).otherwise(F.lit(0).cast("long"))))

    return {"_large": large, "_small": small}, F.aggregate(F.transform("_small", bits), F.lit(0), lambda s, v: s + v)


def _verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame, how: Join) -> DataFrame:
    """The pairs (a, b) that link: first by size, then by narrow sketch, then on the shingles themselves."""
    def side(x: str, column: str) -> DataFrame:
        return facts.select(F.col("node").alias(x), F.col(column).alias(f"{column}{x}"))

    near = pairs.distinct().join(side("a", "n"), "a").join(side("b", "n"), "b").filter(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    both, close = _distance("sketcha", "sketchb")
    near = near.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").withColumns(both)
    near = saved(near.filter(7 * close <= F.col("na") + F.col("nb")).select("a", "b", "na", "nb"), "near")
    wanted = saved(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "wanted")
    sets = saved(_members(_picked(texts, wanted, how).select("node", "text")), "members")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    shared = F.size(F.array_intersect("ma", "mb"))
    return saved(both.select("a", "b", "na", "nb", shared.alias("i")).filter("100 * i >= 75 * (na + nb - i)").select("a", "b"), "links")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of nodes whose components differ, that may link by size and brief sketch, and that agree in lanes enough.

    rows: key, node, comp, least (lanes to agree in), n, brief.
    """
    def side(x: str) -> DataFrame:
        return rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "least", "n")], *[F.get("brief", i).alias(f"s{i}_{x}") for i in range(BRIEF)])

    apart = " + ".join(f"bit_count(s{i}_a ^ s{i}_b)" for i in range(BRIEF))
    pairs = side("a").join(side("b"), "key").filter(f"node_a < node_b and comp_a <> comp_b and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b) and 7 * ({apart}) <= n_a + n_b")
    found = pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("lanes"), F.min(F.least("least_a", "least_b")).alias("least"))
    return found.filter("lanes >= least").select("a", "b")


def _with_uid(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with a long column `name` that tells rows apart: the doc_id, or a number that no doc_id has where that is null or
    there twice; and (uid, id) of the rows with such numbers, None where there are none.
    """
    own = free_name(docs, "_id_")
    ids = docs.select(F.col("doc_id").cast("long").alias(own))
    odd = saved(ids.groupBy(own).agg(F.count("*").alias("n")).filter(f"n > 1 or {own} is null").select(own), "odd-ids")
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), None
    ends = ids.agg(F.coalesce(F.min(own), F.lit(0)).alias("lo"), F.coalesce(F.max(own), F.lit(0)).alias("hi")).first()
    free = F.lit(ends["hi"] + 1) + F.monotonically_increasing_id() if ends["hi"] < 1 << 62 else F.lit(ends["lo"] - 1) - F.monotonically_increasing_id()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    numbered = saved(docs.join(odd, same, "left_semi").withColumn(name, free), "numbered")
    both = docs.join(odd, same, "left_anti").withColumn(name, F.col("doc_id").cast("long")).unionByName(numbered)
    return both, numbered.select(F.col(name).alias("u"), F.col("doc_id").cast("long").alias("id"))


def _buckets(lanes: DataFrame, how: Join) -> DataFrame:
    """key, node, pivot (the smallest node of the lane), g (its nodes), of lanes that several nodes share; lanes: node, keys, a saved table."""
    each = lanes.select("node", F.explode("keys").alias("key"))
    some = each.filter(F.pmod(F.xxhash64(F.lit("hot"), F.col("node")), F.lit(how.hot_sample)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    hot = saved(some.filter(F.col("n") >= how.hot_nodes).orderBy(F.desc("n"), "key").limit(how.hot_lanes).select("key"), "hot-lanes")
    bucket = Window.partitionBy("key")
    facts = {"pivot": F.min("node"), "top": F.max("node"), "g": F.count("*")}
    cold = each.join(F.broadcast(hot), "key", "left_anti").withColumns({k: f.over(bucket) for k, f in facts.items()})
    full = each.join(F.broadcast(hot), "key", "left_semi")
    full = full.join(F.broadcast(full.groupBy("key").agg(*[f.alias(k) for k, f in facts.items()])), "key")
    return saved(cold.unionByName(full).filter("pivot < top").select("key", "node", "pivot", "g"), "buckets")


def _components(rows: DataFrame, odd: DataFrame | None, how: Join) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, keeper (uid of the row that names the component), n_links; rows: uid, text; odd: as `_with_uid` gives it."""
    facts = described(rows, how)
    if odd is None:
        facts = facts.withColumn("doc_id", F.col("uid"))
    else:
        facts = facts.join(odd, F.col("uid") == F.col("u"), "left").withColumn("doc_id", F.when(F.col("u").isNull(), F.col("uid")).otherwise(F.col("id"))).drop("u", "id")
    facts = saved(facts, "described")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("best")
    sets = saved(facts.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("uid").alias("node"), best, F.first("sketch").alias("sketch"), F.first("brief").alias("brief")), "sets")
    nodes = sets.select("node", "n", "sketch", "brief")
    texts = rows.select(F.col("uid").alias("node"), "text")
    # one text for each node
    copies = facts.filter("n > 0").select(F.col("uid").alias("node")).join(nodes.select("node"), "node", "left_anti")
    alone = _picked(texts, saved(copies, "copies"), how, "left_anti")
    shared = _buckets(saved(_keys(alone, False).select("node", "keys"), "lanes"), how)
    links = _verified(shared.filter("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), nodes, texts, how)
    comp = components(links)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(comp, F.col("node") == F.col("v"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("v")

    # buckets that still hold several components
    own = placed(shared.select("key", "node", "g"))
    open_keys = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    rest = saved(own.join(open_keys, "key", "left_semi"), "open")
    spare = 1 + F.floor(F.col("n") / 32)
    # of the spare + 1 lanes in which a pair agrees, its common lanes may be missing
    common = rest.filter(F.col("g") > how.common).groupBy("node").agg(F.count("*").alias("c"))
    facts_of = nodes.select("node", "n", "brief").join(common, "node", "left").select("node", "n", "brief", spare.alias("spare"), F.coalesce("c", F.lit(0)).alias("c"))
    some = rest.filter(F.col("g") <= how.common).join(facts_of, "node").select("key", "node", "comp", F.greatest(F.col("spare") + 1 - F.col("c"), F.lit(1)).alias("least"), "n", "brief")
    more = _across(some)
    # a pair is sure to agree in the spare + 1 lanes of its smaller text only, so the spare of the smallest possible partner counts
    crowded = saved(facts_of.filter(F.col("c") > 1 + F.floor(F.col("n") * 3 / 128)).select("node"), "crowded")
    if not crowded.isEmpty():
        again = _keys(_picked(texts, crowded, how), True).select("node", "band", "need", F.explode("keys").alias("key"))
        again = saved(placed(again).join(nodes.select("node", "n", "brief", spare.alias("spare")), "node"), "again")
        # any order by key alone will do: lanes of one component first, then those of fewest nodes
        widths = again.groupBy("key").agg(F.when(F.min("comp") == F.max("comp"), 1).otherwise(F.count("*")).alias("width"))
        first = F.row_number().over(Window.partitionBy("node", "band").orderBy("width", "key"))
        rare = again.join(widths, "key").withColumn("r", first).filter("r <= need + spare and width > 1")
        more = more.union(_across(rare.select("key", "node", "comp", (F.col("spare") + 1).alias("least"), "n", "brief")))
    links = links.union(_verified(more, nodes, texts, how))
    comp = components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    # only linked nodes have a component of several sets to find a name for
    names = sets.select("node", "best").join(comp, F.col("node") == F.col("v")).groupBy("comp").agg(F.min("best").alias("name"))
    linked = comp.join(names, "comp").select(F.col("v").alias("w"), "name").join(degree, F.col("w") == F.col("node"), "left").select("w", "name", "n_links")
    named = sets.select("hi", "lo", "n", "node", "best").join(linked, F.col("node") == F.col("w"), "left").select("hi", "lo", "n", F.coalesce("name", "best").alias("best"), "n_links")
    joined = facts.select("uid", "doc_id", "n", "hi", "lo").join(named, ["hi", "lo", "n"], "left")
    return joined.select("uid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                         F.when(F.col("n") > 0, F.col("best.uid")).otherwise(F.col("uid")).alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id, and n_links (verified links of its text that were needed to find the component)."""
    rows, odd = _with_uid(docs.select("doc_id", "text"), "uid")
    return _components(rows.select("uid", "text"), odd, how).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The documents without the near copies: of each component the row of the smallest doc_id stays; columns as they were.

    Rows that share a doc_id or have none are documents of their own: copies among them go too, and a text that only rows
    without an id have keeps one of them.
    """
    name = free_name(docs, "_copy_")
    rows, odd = _with_uid(docs, name)
    found = saved(_components(rows.select(F.col(name).alias("uid"), "text"), odd, how).filter("keeper <> uid").select(F.col("uid").alias(f"{name}gone")), "gone")
    few = found.limit(how.broadcast_ids + 1).count() <= how.broadcast_ids
    kept = rows.join(F.broadcast(found) if few else found, F.col(name) == F.col(f"{name}gone"), "left_anti")
    return kept.select(*[quoted(c) for c in docs.columns])


def op3_parity_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
