"""Most similar vectors by cosine, exact, with bounds from the norms of what lies beside a centre.

The corpus stays where it is: blocks of vectors of one length, each dealt into cells around centres of its own. A unit vector
is its share along the centre and a rest, so a query and a vector of a cell cannot score more than the product of their shares
and the product of the norms of their rests, which is the cosine of the difference of their angles to the centre. Cells whose
angles leave a query no score as high as its k-th so far are left out, and that score is carried from block to block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.folders import saved
from .similar import ROUND_BYTES, SCALE, _arrow

#: a block's vectors take so many bytes at most
BLOCK_BYTES = 1 << 25
#: the level of a pair without a score; a score that is not a number has the level above all others, as in SQL
LEAST = -(2 ** 62)
#: what angles of doubles may be off, in levels
SLACK = 100
#: norms outside of these are not scaled; such vectors are compared one by one
PLAIN = (1e-100, 1e100)


@dataclass
class Cells:
    """Vectors of one length. `places`, `units`: those of plain norm, cell by cell, by place inside a cell; `odd`, `raw`: the others."""

    places: np.ndarray
    units: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    odd: np.ndarray
    raw: np.ndarray


_STORED = {f.name: "<i8" if f.name in ("places", "starts", "odd") else "<f8" for f in fields(Cells)}


def _norms(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt((v * v).sum(1))


def _plain(norm: np.ndarray) -> np.ndarray:
    return (norm > PLAIN[0]) & (norm < PLAIN[1])


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def make_cells(v: np.ndarray) -> Cells:
    """About sqrt(n) cells: vectors go to the nearest of evenly picked ones; the mean of a cell is its centre."""
    norm = _norms(v)
    plain = _plain(norm)
    places = np.flatnonzero(plain)
    units = v[plain] / norm[plain, None]
    n = len(units)
    picked = units[np.linspace(0, n - 1, max(1, int(np.sqrt(n)))).astype(int)] if n else units
    cell = (units @ picked.T).argmax(1) if n else np.zeros(0, np.int64)
    order = np.argsort(cell, kind="stable")
    used, starts = np.unique(cell[order], return_index=True)
    places, units, starts = places[order], units[order], np.append(starts, n)
    centres, low, high = picked[used], np.zeros(len(used)), np.zeros(len(used))
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        mean = units[a:b].mean(0)
        size = np.sqrt(mean @ mean)
        if size > 1e-6:
            centres[i] = mean / size
        angle = _angles(units[a:b] @ centres[i])
        low[i], high[i] = angle.min(), angle.max()
    return Cells(places, units, starts, centres, low, high, np.flatnonzero(~plain), v[~plain])


class _Best:
    """The k best of each query in a block: (levels, places, scores), by level and place."""

    def __init__(self, least: np.ndarray, k: int, own: list[np.ndarray]):
        self.least, self.k, self.own = least.copy(), k, own
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in own]

    def take(self, who: np.ndarray, places: np.ndarray, scores: np.ndarray, known: np.ndarray | None = None) -> None:
        """scores: of the queries `who` for the vectors at `places`."""
        with np.errstate(all="ignore"):
            levels = np.rint(np.nan_to_num(np.clip(scores, -4e9, 4e9)) * SCALE).astype(np.int64)
        levels[np.isnan(scores)] = -LEAST
        hits = levels >= self.least[who][:, None]
        if known is not None:
            hits &= known
        for i in np.flatnonzero(hits.any(1)):
            q, at = who[i], np.flatnonzero(hits[i])
            if len(self.own[q]):
                at = at[~np.isin(places[at], self.own[q])]
            old = self.found[q]
            all_ = [np.concatenate(x) for x in zip(old, (levels[i, at], places[at], scores[i, at]))]
            order = np.lexsort((all_[1], -all_[0]))[:self.k]
            self.found[q] = tuple(x[order] for x in all_)
            if len(order) == self.k:
                self.least[q] = max(self.least[q], all_[0][order[-1]])


def search_cells(cells: Cells, kinds: np.ndarray, asked: np.ndarray, asked_kinds: np.ndarray, bonus: float, best: _Best) -> int:
    """Brings the vectors of a block into `best`; kinds: numbers by place, and by query, -1 for none. Returns how many pairs were looked at.

    asked: one query a row, all of the cells' length.
    """
    looked, norm = 0, _norms(asked)
    plain = np.flatnonzero(_plain(norm))
    strange = np.flatnonzero(~_plain(norm))

    def extra(who: np.ndarray, places: np.ndarray) -> np.ndarray:
        own = asked_kinds[who][:, None]
        return np.where((kinds[places][None] == own) & (own >= 0), bonus, 0.0)

    # what is not of plain norm, on either side, pair by pair
    everything = np.concatenate([cells.places, cells.odd])
    for who, places, vectors in ((plain, cells.odd, cells.raw), (strange, everything, None)):
        if len(who) and len(places):
            if vectors is None:
                vectors = np.concatenate([cells.units, cells.raw])
            with np.errstate(all="ignore"):
                sizes = norm[who][:, None] * _norms(vectors)[None]
                best.take(who, places, (asked[who] @ vectors.T) / sizes + extra(who, places), sizes != 0)
            looked += sizes.size

    count = len(cells.centres)
    if not count or not len(plain):
        return looked
    units = asked[plain] / norm[plain, None]
    angle = _angles(units @ cells.centres.T)
    apart = np.maximum(0, np.maximum(angle - cells.high, cells.low - angle))
    bound = np.cos(apart)
    if bonus > 0:
        for c in range(count):
            here = np.unique(kinds[cells.places[cells.starts[c]:cells.starts[c + 1]]])
            bound[:, c] += bonus * (np.isin(asked_kinds[plain], here) & (asked_kinds[plain] >= 0))
    bound = np.floor(bound * SCALE).astype(np.int64) + SLACK
    seen = np.zeros(bound.shape, bool)

    def visit(c: int, rows: np.ndarray) -> int:
        rows = rows[(bound[rows, c] >= best.least[plain[rows]]) & ~seen[rows, c]]
        if not len(rows):
            return 0
        seen[rows, c] = True
        places = cells.places[cells.starts[c]:cells.starts[c + 1]]
        best.take(plain[rows], places, units[rows] @ cells.units[cells.starts[c]:cells.starts[c + 1]].T + extra(plain[rows], places))
        return len(rows) * len(places)

    # each query begins with its nearest cells, which lifts its k-th score; then cell by cell
    nearest = np.argsort(angle, axis=1)[:, :3]
    for turn in nearest.T:
        for c in np.unique(turn):
            looked += visit(c, np.flatnonzero(turn == c))
    rows = np.arange(len(plain))
    for c in range(count):
        looked += visit(c, rows)
    return looked


def similar_vectors(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 2, category: str | None = None, bonus: float = 0.1, block: int = 8192) -> DataFrame:
    """query, rank, match, score by cosine over ready vectors, and a bonus for an equal category; any number of queries.

    Exact: equal to looking at all pairs, ties by match. The corpus is written once, in blocks of up to `block` vectors (and
    BLOCK_BYTES), and neither shuffled nor copied for a query; queries come to the blocks in rounds of ROUND_BYTES, and only a
    task's best k a query are shuffled. Jobs: the index, the queries, their size, and the fetch of each round.

    Scores are ranked to nine digits. A pair of null vectors, of different lengths or with a zero vector has a null score and
    ranks last. Rows without a key take no part; a query is no match of itself.
    """
    fine = F.when(F.forall(vector, lambda x: x.isNotNull()), F.transform(vector, lambda x: x.cast("double")))
    key_kind, query_kind = (df.schema[key].dataType.simpleString() for df in (corpus, queries))
    arrow_key, arrow_query = _arrow(corpus, key), _arrow(queries, key)

    def sides(df: DataFrame) -> DataFrame:
        kind = F.col(category).cast("string") if category else F.lit(None).cast("string")
        return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), kind.alias("kind"), fine.alias("v"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # length (-1: no vector) -> ids, kinds and vectors that wait for a full block
        waiting: dict[int, list[tuple]] = defaultdict(list)

        def out(size: int) -> pa.RecordBatch:
            rows = sorted(waiting.pop(size), key=lambda r: r[0])
            made = make_cells(np.array([r[2] for r in rows], dtype=float).reshape(len(rows), size) if size > 0 else np.zeros((len(rows), 0)))
            lists = [pa.array([[r[i] for r in rows]], pa.list_(t)) for i, t in ((0, arrow_key), (1, pa.string()))]
            stored = [pa.array([np.ascontiguousarray(getattr(made, n), t).tobytes()], pa.binary()) for n, t in _STORED.items()]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *lists, *stored], names=["size", "ids", "kinds", *_STORED])

        for batch in batches:
            ids, kinds, vectors = (batch.column(i) for i in range(3))
            sizes = vectors.value_lengths().fill_null(-1).to_pylist()
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, (own, kind, size) in enumerate(zip(ids.to_pylist(), kinds.to_pylist(), sizes)):
                rows = waiting[size]
                rows.append((own, kind, flat[starts[i]:starts[i] + max(size, 0)].copy()))
                if len(rows) >= max(1, min(block, BLOCK_BYTES // (8 * max(size, 1)))):
                    yield out(size)
        for size in list(waiting):
            yield out(size)

    stored = ", ".join(f"{n} binary" for n in _STORED)
    index = saved(sides(corpus).mapInArrow(build, f"size int, ids array<{key_kind}>, kinds array<string>, {stored}"), "vector-index")
    asked = saved(sides(queries), "vector-queries")
    total = asked.agg(F.sum(F.greatest(F.coalesce(F.size("v"), F.lit(0)), F.lit(8)).cast("long"))).first()[0] or 0
    rounds = -(-total * 8 // ROUND_BYTES)
    found = None
    for r in range(rounds):
        # one round of queries, bounded in size
        some = asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toArrow()
        # length -> ids, kinds and a matrix
        grouped: dict[int, list[tuple]] = defaultdict(list)
        for own, kind, v in zip(*(some.column(c).to_pylist() for c in ("id", "kind", "v"))):
            grouped[-1 if v is None else len(v)].append((own, kind, v))
        shared = corpus.sparkSession.sparkContext.broadcast([
            (size, [x[0] for x in rows], [x[1] for x in rows], np.array([x[2] for x in rows], dtype=float).reshape(len(rows), size) if size > 0 else np.zeros((len(rows), 0)))
            for size, rows in grouped.items()])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # per length of queries and query: (-level, id, score), best first
            best: list[list[list[tuple]]] = [[[] for _ in own] for _, own, _, _ in shared.value]
            for batch in batches:
                for at in range(batch.num_rows):
                    size, ids = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                    named, kinds = np.unique([k or "" for k in batch.column(2)[at].as_py()], return_inverse=True)
                    kinds[[k is None for k in batch.column(2)[at].as_py()]] = -1
                    number = {n: i for i, n in enumerate(named.tolist())}
                    cells = Cells(**{n: np.frombuffer(batch.column(c)[at].as_py(), t) for c, (n, t) in enumerate(_STORED.items(), 3)})
                    for n in ("units", "centres", "raw"):
                        rows = {"units": cells.places, "centres": cells.low, "raw": cells.odd}[n]
                        setattr(cells, n, getattr(cells, n).reshape(len(rows), max(size, 0)))
                    by_id = defaultdict(list)
                    for i, own in enumerate(ids):
                        by_id[own].append(i)
                    for (other, own, own_kinds, v), lists in zip(shared.value, best):
                        for a in range(0, len(own), 512):
                            part = range(a, min(a + 512, len(own)))
                            least = np.array([-lists[i][-1][0] if len(lists[i]) == k else LEAST + 1 for i in part])
                            mine = _Best(least, k, [np.array(by_id.get(own[i], []), np.int64) for i in part])
                            if other == size and size > 0:
                                codes = np.array([-1 if own_kinds[i] is None else number.get(own_kinds[i], -1) for i in part])
                                search_cells(cells, kinds, v[a:a + 512], codes, bonus, mine)
                            for i, (levels, places, scores) in zip(part, mine.found):
                                new = [(-int(x), ids[p], float(s)) for x, p, s in zip(levels, places, scores)]
                                if len(new) + sum(x[2] is not None for x in lists[i]) < k:
                                    # pairs without a score: the least ids
                                    there = {int(p) for p in places} | set(by_id.get(own[i], ()))
                                    new += [(-LEAST, ids[p], None) for p in _first(len(ids), there, k)]
                                if new:
                                    lists[i] = sorted([*lists[i], *new], key=lambda x: x[:2])[:k]
            rows = [(q, match, score, level) for (_, own, _, _), lists in zip(shared.value, best) for q, found in zip(own, lists) for level, match, score in found]
            kinds = [pa.array([x[i] for x in rows], t) for i, t in enumerate((arrow_query, arrow_key, pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(kinds, names=["query", "match", "score", "level"])

        part = index.mapInArrow(search, f"query {query_kind}, match {key_kind}, score double, level long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return corpus.sparkSession.createDataFrame([], f"query {query_kind}, rank int, match {key_kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("level", "match"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "match", "score")


def _first(n: int, without: set[int], k: int) -> list[int]:
    out = []
    for p in range(n):
        if len(out) == k:
            break
        if p not in without:
            out.append(p)
    return out
