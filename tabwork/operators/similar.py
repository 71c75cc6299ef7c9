"""Most similar texts by an index of postings, exact and with early stops.

The corpus stays where it is: blocks of texts, each with its postings by gram and the largest weight that a gram has in it.
Queries come to the blocks in rounds of bounded size. In a block, a query's grams are taken from the largest bound (its weight
times the largest in the block) to the smallest; grams that together stay below the query's k-th score so far only add to
texts that others have brought in, and texts leave as soon as what is left cannot lift them to that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.folders import saved

#: scores are ranked to nine digits
SCALE = 10 ** 9
#: bytes of queries (16 a gram) that go to the tasks at a time
ROUND_BYTES = 1 << 26


def bigrams(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, tf: character pairs, case and spaces kept."""
    # those that begin at even places, and those at odd ones
    even, odd = (F.regexp_extract_all(t, F.lit("(?s).."), 0) for t in (F.col(text), F.substring(text, 2, 2147483647)))
    grams = df.select(key, F.explode(F.concat(even, odd)).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("tf"))


def gram_weights(tf: DataFrame, df: DataFrame) -> DataFrame:
    """gram, idf: ln((n + 1) / (texts that hold it + 1)) + 1, for n rows of df."""
    return tf.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(df.agg(F.count("*").alias("n")))).select("gram", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


@dataclass
class Block:
    """Postings of a block's texts by gram: their places in the block and the weights, and the largest weight of each gram."""

    grams: np.ndarray
    starts: np.ndarray
    texts: np.ndarray
    weights: np.ndarray
    tops: np.ndarray


_STORED = {"grams": "<i8", "starts": "<i8", "texts": "<i4", "weights": "<f8", "tops": "<f8"}


def make_block(grams: list[np.ndarray], weights: list[np.ndarray]) -> Block:
    rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    flat = np.concatenate(grams)
    scaled = np.concatenate([w / np.sqrt((w * w).sum()) for w in weights])
    order = np.argsort(flat, kind="stable")
    here, starts = np.unique(flat[order], return_index=True)
    return Block(here, np.append(starts, len(flat)), rows[order].astype(np.int32), scaled[order], np.maximum.reduceat(scaled[order], starts))


def search_block(block: Block, n: int, grams: np.ndarray, weights: np.ndarray, extra: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(texts, levels, postings read) of the block's texts whose level may be `least` or more; n texts; extra: what a text gets besides.

    Levels are scores in units of 1 / SCALE; a text without any of the grams has none.
    """
    place = np.minimum(np.searchsorted(block.grams, grams), len(block.grams) - 1)
    there = block.grams[place] == grams
    place, weights = place[there], weights[there]
    bounds = weights * block.tops[place]
    order = np.argsort(bounds)
    place, weights = place[order], weights[order]
    # what grams up to here may add together, with a hair for rounding
    upto = np.cumsum(bounds[order]) + 1e-9
    most = float(extra.max()) if extra is not None else 0.0
    weak = int(np.searchsorted(upto + most, least / SCALE)) if len(upto) else 0
    scores, seen, read = np.zeros(n), np.zeros(n, bool), 0
    for p, w in zip(place[weak:], weights[weak:]):
        part = slice(block.starts[p], block.starts[p + 1])
        scores[block.texts[part]] += w * block.weights[part]
        seen[block.texts[part]] = True
        read += part.stop - part.start
    left = np.flatnonzero(seen)
    more = extra if extra is not None else np.zeros(n)
    for i in range(weak - 1, -1, -1):
        left = left[scores[left] + more[left] + upto[i] >= least / SCALE]
        if not len(left):
            break
        part = slice(block.starts[place[i]], block.starts[place[i] + 1])
        texts = block.texts[part]
        where = np.minimum(np.searchsorted(texts, left), len(texts) - 1)
        hit = texts[where] == left
        scores[left[hit]] += weights[i] * block.weights[part][where[hit]]
        read += int(hit.sum())
    levels = np.rint((scores[left] + more[left]) * SCALE).astype(np.int64)
    good = levels >= least
    return left[good], levels[good], read


def similar_texts(corpus: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 2, category: str | None = None, bonus: float = 0.1, block: int = 4096) -> DataFrame:
    """query, rank, match, score: cosine of the weights of the corpus, and a bonus for an equal category; pairs that share no gram do not arise.

    Exact: equal to looking at all pairs, ties by match. The corpus is written once, as blocks of `block` texts, and never
    shuffled or copied for a query; a round of queries reads the blocks in place, and only a task's best k a query are shuffled.
    Jobs: the grams' weights, the index, the queries, and a round or more of searches.
    """
    kind_of = lambda df, c: df.schema[c].dataType.simpleString()
    key_kind, query_kind = kind_of(corpus, key), kind_of(queries, query_key)
    tf = bigrams(corpus, key, text)
    idf = saved(gram_weights(tf, corpus), "gram-weights")
    # two code points of 21 bits
    gram = F.shiftleft(F.ascii(F.substring("gram", 1, 1)).cast("long"), 21) + F.ascii(F.substring("gram", 2, 1))

    def listed(counts: DataFrame, df: DataFrame, own: str, name: str) -> DataFrame:
        """name, kind, g, w: a row per text."""
        rows = counts.filter(F.col(own).isNotNull()).join(idf, "gram").groupBy(F.col(own).alias(name)).agg(F.collect_list(F.struct(gram.alias("g"), (F.col("tf") * F.col("idf")).alias("w"))).alias("p"))
        if category:
            rows = rows.join(df.select(F.col(own).alias(name), F.col(category).cast("string").alias("kind")), name)
        else:
            rows = rows.withColumn("kind", F.lit(None).cast("string"))
        return rows.select(name, "kind", F.col("p.g").alias("g"), F.col("p.w").alias("w"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                made = make_block(*([x.values.to_numpy(zero_copy_only=False) for x in part.column(c)] for c in (2, 3)))
                ids, kinds = (pa.array([part.column(c).to_pylist()], pa.list_(part.column(c).type)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, kinds, *(pa.array([np.asarray(getattr(made, n), t).tobytes()], pa.binary()) for n, t in _STORED.items())], names=["ids", "kinds", *_STORED])
        pa.default_memory_pool().release_unused()

    index = saved(listed(tf, corpus, key, "match").mapInArrow(build, f"ids array<{key_kind}>, kinds array<string>, " + ", ".join(f"{n} binary" for n in _STORED)), "text-index")
    asked = saved(listed(bigrams(queries, query_key, query_text), queries, query_key, "query"), "text-queries")
    rounds = -(-(asked.agg(F.sum(F.size("g"))).first()[0] or 0) * 16 // ROUND_BYTES)
    found = None
    for r in range(rounds):
        # one round of queries, bounded in size
        some = [(q["query"], q["kind"], np.array(q["g"], np.int64), np.array(q["w"])) for q in asked.filter(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r).collect()]
        shared = corpus.sparkSession.sparkContext.broadcast([(i, kind, g[o], w[o] / np.sqrt((w * w).sum())) for i, kind, g, w in some for o in (np.argsort(g),)])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            some = shared.value
            best: list[list[tuple]] = [[] for _ in some]
            for batch in batches:
                for at in range(batch.num_rows):
                    ids, kinds = batch.column(0)[at].as_py(), np.array(batch.column(1)[at].as_py(), dtype=object)
                    here = Block(**{n: np.frombuffer(batch.column(c)[at].as_py(), t) for c, (n, t) in enumerate(_STORED.items(), 2)})
                    for own, (_, kind, g, w) in zip(best, some):
                        extra = None if kind is None else np.where(kinds == kind, bonus, 0.0)
                        least = -own[-1][0] if len(own) == k else 1
                        texts, levels, _ = search_block(here, len(ids), g, w, extra, least)
                        if len(levels) > k:
                            keep = levels >= np.partition(levels, len(levels) - k)[len(levels) - k]
                            texts, levels = texts[keep], levels[keep]
                        own[:] = sorted([*own, *((-int(x), ids[i]) for i, x in zip(texts, levels))])[:k]
            rows = [(q[0], match, -level) for q, own in zip(some, best) for level, match in own]
            kinds = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ([], [], []), (arrow_query, arrow_key, pa.int64()))]
            yield pa.RecordBatch.from_arrays(kinds, names=["query", "match", "level"])

        arrow_query, arrow_key = (_arrow(df, c) for df, c in ((queries, query_key), (corpus, key)))
        part = index.mapInArrow(search, f"query {query_kind}, match {key_kind}, level long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return corpus.sparkSession.createDataFrame([], f"query {query_kind}, rank int, match {key_kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("level"), "match"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "match", (F.col("level") / SCALE).alias("score"))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
