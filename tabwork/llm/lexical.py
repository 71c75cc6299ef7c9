"""Ranked lexical search by pair-bound MaxScore. The index is cut into blocks of documents. A block holds the postings of each
term, and for chosen pairs of terms the list of documents that hold both, with the largest impact that the two have together.

A search goes through the blocks of its task and keeps each item's best k so far; their lowest score is the threshold. In a
block the item's terms are taken in units, pairs where the index has them. A unit adds no more than the larger of its two
maxima to a document outside the pair's list, and the joint maximum to one inside, which is often much less than the sum of
the two maxima. Units whose bounds together stay below the threshold cannot bring a document in by themselves: only documents
of the other units are looked at, and from unit to unit those go whose score and remaining bounds stay below. The result is
exact, ties included.

Items are searched in blocks of bounded number and length against all documents: their terms are the vocabulary for which
postings are kept, and go to every task. A document's text is read once for a block of items, and its counts of vocabulary terms
are saved; numbers of documents and terms come from there. Only an item's best k of each task are shuffled.

Defined results for odd input: a null text has no terms, as a document or as an item; documents without terms do not
count; each row is a document of its own, so repeated rows rank one after the other; of equal scores the smaller doc_id is
first, null last; each row of the items is answered, and equal texts alike; an item without terms or hits has no rows; an
empty table gives an empty table; other input columns are ignored; a text of any length is read whole, in one row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved, text_of

#: A-Z to lower case, what is not part of a term to a blank; bytes from 0x80 on are part of terms
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Search:
    k: int = 10
    #: how much of a document's length counts, in percent
    length_share: int = 90
    block_docs: int = 2048
    block_items: int = 2048
    block_chars: int = 1 << 20
    #: without pairs the bounds are those of single terms
    pairs: bool = True


@dataclass(frozen=True)
class Corpus:
    """What weights depend on: documents with a term, all their terms with repeats, and the weight of each vocabulary term."""

    docs: int
    terms: int
    weights: np.ndarray

    def norms(self, lengths: list[int], share: int) -> np.ndarray:
        return np.array([100 - share + (share * n * self.docs) // self.terms for n in lengths], np.int64)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def pairs_of(terms: list[int], weights: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of an item's terms for which lists are kept: rarest first, two by two."""
    order = sorted(terms, key=lambda t: (-int(weights[t]), t))
    return [(min(a, b), max(a, b)) for a, b in zip(order[0::2], order[1::2])]


@dataclass
class Block:
    """Postings of a block's documents by term: documents (their places in the block), impacts and the largest impact; and of
    pairs of terms: the documents that hold both, and the largest impact of both together."""

    ids: np.ndarray
    no_id: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    tops: np.ndarray
    pairs: np.ndarray
    pair_starts: np.ndarray
    pair_docs: np.ndarray
    joint: np.ndarray

    def postings(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[place], self.starts[place + 1])
        return self.docs[part], self.impacts[part]


#: how a block is stored
_STORED = {"ids": "<i8", "no_id": "?", "terms": "<i4", "starts": "<i8", "docs": "<u2", "impacts": "<i8", "tops": "<i8", "pairs": "<i4", "pair_starts": "<i8", "pair_docs": "<u2", "joint": "<i8"}


def make_block(ids: list, lengths: list[int], terms: np.ndarray, counts: np.ndarray, held: np.ndarray, corpus: Corpus, pairs: list[tuple[int, int]], how: Search) -> Block:
    """The index of a block; terms and counts are those of all documents in order, held of each."""
    docs = np.repeat(np.arange(len(ids)), held)
    tf, norm = counts.astype(np.int64), corpus.norms(lengths, how.length_share)
    impacts = corpus.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[docs]))
    order = np.argsort(terms, kind="stable")
    docs, impacts, sorted_terms = docs[order].astype(np.uint16), impacts[order], terms[order]
    here, starts = np.unique(sorted_terms, return_index=True)
    starts = np.append(starts, len(sorted_terms)).astype(np.int64)
    place = {int(t): i for i, t in enumerate(here)}
    found, lists, joint = [], [], []
    mine, last = np.zeros(len(ids), np.int64), None
    for number, (a, b) in enumerate(pairs):
        i, j = place.get(a), place.get(b)
        if i is None or j is None:
            continue
        if last != i:
            mine[:] = -1
            mine[docs[starts[i]:starts[i + 1]]] = impacts[starts[i]:starts[i + 1]]
            last = i
        other = docs[starts[j]:starts[j + 1]]
        both = mine[other] >= 0
        if both.any():
            found.append(number)
            lists.append(other[both])
            joint.append(int((mine[other[both]] + impacts[starts[j]:starts[j + 1]][both]).max()))
    return Block(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], bool), here.astype(np.int32), starts, docs, impacts,
                 np.maximum.reduceat(impacts, starts[:-1]) if len(here) else np.zeros(0, np.int64), np.array(found, np.int32),
                 np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.concatenate([np.zeros(0, np.uint16), *lists]), np.array(joint, np.int64))


class Best:
    """An item's best rows so far, and the score that a document must reach to be among them."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids, no_id = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.no_id, no_id])
        keep = np.lexsort((ids, no_id, -scores))[:self.k]
        self.scores, self.ids, self.no_id = scores[keep], ids[keep], no_id[keep]
        if len(keep) == self.k:
            self.least = int(self.scores[-1])


def search_block(block: Block, terms: list[int], pairs: list[tuple[int, int, int]], best: Best, how: Search) -> int:
    """Bring the block's documents into the item's best; how many postings were read. pairs: two of the terms and the number of their list."""
    place = np.searchsorted(block.terms, terms)
    at = {t: int(p) for t, p in zip(terms, place) if p < len(block.terms) and block.terms[p] == t}
    tops, read = {t: int(block.tops[p]) for t, p in at.items()}, 0
    # units: (bound inside the pair's list, bound outside it, terms, list)
    units, paired = [], set()
    for a, b, number in pairs if how.pairs else ():
        if a in tops and b in tops:
            paired |= {a, b}
            k = int(np.searchsorted(block.pairs, number))
            apart, both = max(tops[a], tops[b]), None
            if k < len(block.pairs) and block.pairs[k] == number:
                both = block.pair_docs[block.pair_starts[k]:block.pair_starts[k + 1]]
            units.append((apart if both is None else max(int(block.joint[k]), apart), apart, (a, b), both))
    units += [(u, u, (t,), None) for t, u in tops.items() if t not in paired]
    units.sort(key=lambda u: u[0])
    total, weak = 0, 0
    while weak < len(units) and total + units[weak][0] < best.least:
        total += units[weak][0]
        weak += 1
    if weak == len(units):
        return 0
    scores = np.zeros(len(block.ids), np.int64)
    seen = np.zeros(len(block.ids), bool)
    for _, _, own, _ in units[weak:]:
        for t in own:
            docs, impacts = block.postings(at[t])
            scores[docs] += impacts
            seen[docs] = True
            read += len(docs)
    left = np.flatnonzero(seen)
    # what the other units may still add: the same for all documents, and more for those in the lists of pairs
    base, extra = sum(u[1] for u in units[:weak]), np.zeros(len(block.ids), np.int64)
    for bound, apart, _, both in units[:weak]:
        if both is not None and bound > apart:
            extra[both] += bound - apart
    for bound, apart, own, both in reversed(units[:weak]):
        left = left[scores[left] + base + extra[left] >= best.least]
        if not len(left):
            return read
        for t in own:
            docs, impacts = block.postings(at[t])
            if len(left) * 8 < len(docs):
                where = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
                hit = docs[where] == left
                scores[left[hit]] += impacts[where[hit]]
                read += int(hit.sum())
            else:
                scores[docs] += impacts
                read += len(docs)
        base -= apart
        if both is not None and bound > apart:
            extra[both] -= bound - apart
    left = left[scores[left] >= best.least]
    best.add(scores[left], block.ids[left], block.no_id[left])
    return read


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those in the vocabulary), counts; documents with a term only. A saved table."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part, keep = batch.slice(begin, 1024), []
                lengths, terms, counts, ends = [], [], [], [0]
                for i in range(part.num_rows):
                    found = terms_of(part.column(1)[i].as_py())
                    if found:
                        for t, c in Counter(found).items():
                            if t in known:
                                terms.append(known[t])
                                counts.append(c)
                        keep.append(i)
                        lengths.append(len(found))
                        ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int32())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return saved(rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>"), "term-counts")


def corpus_of(counts: DataFrame, n_terms: int) -> Corpus | None:
    """The numbers that weights depend on; None where no document has a term. A row per vocabulary term comes to the driver."""
    whole = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not whole["docs"]:
        return None
    holding = np.zeros(n_terms, np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r["term"]] = r["count"]
    return Corpus(whole["docs"], whole["terms"], np.array([weight(whole["docs"], int(h)) for h in holding], np.int64))


def indexed(counts: DataFrame, corpus: Corpus, pairs: list[tuple[int, int]], how: Search = Search()) -> DataFrame:
    """A row per block of documents, each array of it as bytes; a saved table."""
    if how.block_docs > 1 << 16:
        raise ValueError("a block holds 65536 documents at most")
    shared = counts.sparkSession.sparkContext.broadcast((corpus, pairs))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, pairs = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, how.block_docs):
                part = batch.slice(begin, how.block_docs)
                flat = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3)]
                held = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                block = make_block(part.column(0).to_pylist(), part.column(1).to_pylist(), *flat, held, corpus, pairs, how)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(getattr(block, name), kind).tobytes()], pa.binary()) for name, kind in _STORED.items()], names=list(_STORED))
        pa.default_memory_pool().release_unused()

    return saved(counts.mapInArrow(build, ", ".join(f"{name} binary" for name in _STORED)), "term-index")


def searched(index: DataFrame, items: list[tuple[str, list[int], list[tuple[int, int, int]]]], how: Search = Search()) -> DataFrame:
    """query, rank, doc_id, score: the best k of each item; items: name and terms of each, and its pairs with the numbers of their lists."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [Best(how.k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(**{name: np.frombuffer(batch.column(c)[i].as_py(), kind) for c, (name, kind) in enumerate(_STORED.items())})
                for (_, terms, pairs), own in zip(items, best):
                    search_block(block, terms, pairs, own, how)
        rows = [(name, None if gone else int(d), int(s)) for (name, _, _), own in zip(items, best) for d, gone, s in zip(own.ids, own.no_id, own.scores)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.string(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    local = index.mapInArrow(search, "query string, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())).cast("int")
    return local.withColumn("rank", rank).filter(F.col("rank") <= how.k).select("query", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, how: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each row of items; a job or more for each block of items."""
    spark = docs.sparkSession
    texts = items.filter("text IS NOT NULL").select(F.md5("text").alias("query"), "text").dropDuplicates(["query"])
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // how.block_items), -(-size["chars"] // how.block_chars))
    found = spark.createDataFrame([], "query string, rank int, doc_id long, score long")
    for b in range(blocks):
        # one block of items, bounded in number and length
        asked = texts.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query").collect()
        named = [(r["query"], sorted(set(terms_of(r["text"].encode())))) for r in asked]
        vocabulary = sorted({t for _, terms in named for t in terms})
        counts = counted(docs, vocabulary)
        corpus = corpus_of(counts, len(vocabulary))
        if corpus is None or not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        numbered = [(name, [number[t] for t in terms]) for name, terms in named if terms]
        own = [pairs_of(terms, corpus.weights) for _, terms in numbered]
        lists = {p: n for n, p in enumerate(sorted({p for x in own for p in x}))}
        asked = [(name, terms, [(*p, lists[p]) for p in x]) for (name, terms), x in zip(numbered, own)]
        found = found.unionByName(searched(indexed(counts, corpus, list(lists), how), asked, how))
    return items.select("item_id", F.md5("text").alias("q")).join(found, F.col("q") == F.col("query")).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT rid, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tf AS (SELECT rid, doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
n AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term, docs),
m AS (SELECT rid, 100 - 90 + ((90 * n * docs) // terms) AS m FROM n, g),
q AS (SELECT DISTINCT iid, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS iid, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)),
s AS (SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
