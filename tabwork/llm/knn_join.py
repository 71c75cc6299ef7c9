"""Exact top-k search: a Voronoi kNN join. Vectors are grouped by their nearest pivot; from a small summary of each cell
(its radius, its size, its k smallest distances) follows how far a query's k-th neighbour can be at most, and so which
cells the query must visit. Only those copies of queries are made; each cell is solved locally with its visitors, and the
best k of all its cells are a query's answer.

The score is the integer inner product. With M the largest norm, (v, sqrt(M^2 - |v|^2)) and (q, 0) have the squared
distance |q|^2 + M^2 - 2 q.v, so the nearest are those of the highest score, and the triangle inequality holds.

A cell is left out of a query's visits if its ring (least and largest distance from its pivot) or the plane between its
pivot and the query's own proves all of it to be farther than that.

Cells are cut into blocks of bounded size, and a block's visitors into groups of bounded size, so no task grows with
a hot cell or with the number of queries. Pivots are a bounded sample (the vectors of smallest hash; as many as the square
root of the number of vectors, between 16 and `most_pivots`); every vector is searched, and bounds are loosened by a
hair against rounding.

Defined results for odd input: vectors that are null or hold null or non-finite components take no part, as queries or
as candidates; vectors count as padded with zeros to the longest length, so an empty one has the score 0 with all;
vectors so large that a score might not fit 64 bits (the square of the largest norm, times scale, is 2^63 or more) are an error;
repeated vectors are candidates each; a query's own row is not its candidate, other rows of the same id are, and each row
of a repeated id is a query with ranks of its own; an empty table gives an empty table; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved


@dataclass(frozen=True)
class Search:
    k: int = 10
    scale: float = 1024.0
    #: None: the square root of the number of vectors
    pivots: int | None = None
    most_pivots: int = 4096
    block_rows: int = 8192
    block_queries: int = 2048


def integers(vectors: DataFrame, vector: str, scale: float, is_query: Column) -> DataFrame:
    """row (a number of its own), vec_id, is_query, v array<double> of floor(scale * x), of the vectors that take part."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    for i, x in enumerate(np.split(flat, np.cumsum(lengths)[:-1])):
        out[i, :len(x)] = x[:width]
    return out


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as integers; doubles are exact below 2^53, Python's integers beyond."""
    if len(q) and len(v) and np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2 ** 53:
        return np.rint(q @ v.T).astype(np.int64)
    return np.array(q.astype(object) @ v.astype(object).T, dtype=object).astype(np.int64)


def pivot_count(n: int, how: Search) -> int:
    return how.pivots or max(16, min(int(n ** 0.5), how.most_pivots))


def knn_join(vectors: DataFrame, is_query: Column, how: Search = Search(), vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score."""
    found = _plan(vectors, is_query, how, vector)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, visits, plan, width = found
    part = lambda x, n, seed: F.pmod(F.xxhash64(F.lit(seed), x), n).cast("int")
    left = placed.join(plan, F.col("cell") == F.col("pc")).filter("groups > 0").select(
        "cell", part(F.col("row"), F.col("blocks"), "data").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "row", "vec_id", "v")
    right = visits.join(plan, F.col("cell") == F.col("pc")).select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part(F.col("query_row"), F.col("groups"), "query").alias("grp"), "query_row", "query_id", "q")

    def stacked(column: pd.Series) -> np.ndarray:
        sizes = np.fromiter((len(x) for x in column), np.int64, len(column))
        out = np.zeros((len(sizes), width))
        if sizes.sum():
            out[np.arange(width)[None] < sizes[:, None]] = np.concatenate(column.to_list())
        return out

    def solve(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("vec_id", kind="stable")
        rows, ids, v = data["row"].to_numpy(), data["vec_id"].to_numpy(), stacked(data["v"])
        places, owners, scores = [], [], []
        for at in range(0, len(asked) if len(data) else 0, 256):
            some = asked.iloc[at:at + 256]
            for i, (own, s) in enumerate(zip(some["query_row"], _scores(stacked(some["q"]), v)), at):
                other = np.flatnonzero(rows != own)
                sc = s[other]
                if len(sc) > how.k:
                    keep = np.flatnonzero(sc >= np.partition(sc, len(sc) - how.k)[len(sc) - how.k])
                    other, sc = other[keep], sc[keep]
                # rows lie in order of their ids, so a stable sort breaks ties by them
                best = np.argsort(-sc, kind="stable")[:how.k]
                places.append(other[best])
                owners.append(np.full(len(best), i))
                scores.append(sc[best])
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        who, where = flat(owners), flat(places)
        return pd.DataFrame({"query_row": asked["query_row"].to_numpy()[who], "query_id": asked["query_id"].to_numpy()[who], "row": rows[where], "vec_id": ids[where], "score": flat(scores).astype(np.int64)})

    keys = ["cell", "block", "grp"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query_row long, query_id long, row long, vec_id long, score long")
    order = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")).cast("int")
    return local.withColumn("rank", order).filter(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")


def _plan(vectors: DataFrame, is_query: Column, how: Search, vector: str):
    """(placed vectors, visits, blocks and groups of each cell, width), or None where no vector takes part."""
    spark = vectors.sparkSession
    rows = saved(integers(vectors, vector, how.scale, is_query), "vectors")
    ends = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).first()
    if not ends["n"]:
        return None
    width, top = max(ends["width"], 1), float(ends["norm"])
    if top ** 2 >= 2.0 ** 63:
        raise ValueError(f"scores up to {top ** 2:.3g} do not fit 64-bit integers; scale the vectors")
    chosen = rows.orderBy(F.xxhash64("vec_id", "row"), "row").select("v").limit(pivot_count(ends["n"], how)).collect()
    pivots = np.zeros((len(chosen), width + 1))
    for i, r in enumerate(chosen):
        pivots[i, :len(r["v"])] = r["v"]
    pivots[:, width] = np.sqrt(np.maximum(top ** 2 - (pivots[:, :width] ** 2).sum(1), 0))

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * x @ pivots.T, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(3), width)
            d = distances(np.hstack([x, np.sqrt(np.maximum(top ** 2 - (x ** 2).sum(1), 0))[:, None]]))
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["row", "vec_id", "is_query", "v", "cell", "d"])

    placed = saved(rows.select("row", "vec_id", "is_query", "v").mapInArrow(place, "row long, vec_id long, is_query boolean, v array<double>, cell int, d double"), "cells")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one more than k, as one of them may be the query itself
        best = pd.DataFrame({"cell": pd.Series(dtype="int32"), "d": pd.Series(dtype="float64")})
        for b in batches:
            both = pd.concat([best, b])
            best = both.sort_values(["cell", "d"]).groupby("cell").head(how.k + 1)
        yield best

    # bounded: k + 1 distances and one ring per cell
    close = placed.select("cell", "d").mapInPandas(nearest, "cell int, d double")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    near = close.withColumn("r", rank).filter(F.col("r") <= how.k + 1).collect()
    size = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("inner"), F.max("d").alias("outer")).collect()}
    near_cell, near_d = np.array([r["cell"] for r in near]), np.array([r["d"] for r in near])
    inner, outer = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for c, r in size.items():
        inner[c], outer[c] = r["inner"], r["outer"]
    slack = 1e-6 * (1.0 + top)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 256) for at in range(0, b.num_rows, 256)):
                q = _matrix(part.column(2), width)
                d = distances(np.hstack([q, np.zeros((len(q), 1))]))
                upper = d[:, near_cell] + near_d[None]
                bound = np.partition(upper, how.k, axis=1)[:, how.k] if upper.shape[1] > how.k else np.full(len(q), np.inf)
                lower = np.maximum(d - outer[None], inner[None] - d)
                # what lies in a cell lies on its pivot's side of the plane between that and the query's nearest pivot
                own = d.argmin(1)
                apart = np.sqrt(np.maximum(((pivots[own] ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * pivots[own] @ pivots.T), 0))
                plane = np.divide(d ** 2 - d[np.arange(len(d)), own][:, None] ** 2, 2 * apart, out=np.full(d.shape, -np.inf), where=apart > slack)
                who, cell = np.nonzero((np.maximum(lower, plane) <= bound[:, None] * (1 + 1e-9) + slack) & np.isfinite(outer)[None])
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(cell, pa.int32())], names=["query_row", "query_id", "q", "cell"])

    visits = saved(placed.filter("is_query").select("row", "vec_id", "v").mapInArrow(visit, "query_row long, query_id long, q array<double>, cell int"), "visits")
    guests = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    plan = spark.createDataFrame([(c, -(-r["n"] // how.block_rows), -(-guests.get(c, 0) // how.block_queries)) for c, r in size.items()], "pc int, blocks int, groups int")
    return placed, visits, F.broadcast(plan), width  # the plan has a row per pivot


def pairs_computed(vectors: DataFrame, is_query: Column, how: Search = Search(), vector: str = "embedding") -> tuple[int, int]:
    """(pairs of a query and a vector that the join looks at, all such pairs)."""
    found = _plan(vectors, is_query, how, vector)
    if found is None:
        return 0, 0
    placed, visits, _, _ = found
    sizes, guests = ({r["cell"]: r["count"] for r in t.groupBy("cell").count().collect()} for t in (placed, visits))
    return sum(n * guests.get(c, 0) for c, n in sizes.items()), placed.filter("is_query").count() * sum(sizes.values())


def op5_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return knn_join(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.rid, q.vec_id AS query_id, d.vec_id, d.rid AS other, coalesce(list_sum([q.e[i] * d.e[i] FOR i IN range(1, least(len(q.e), len(d.e)) + 1)]), 0)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.rid <> q.rid)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other)::INTEGER AS rank, vec_id, score FROM pairs)
WHERE rank <= 10"""
