"""Line dedup: hashes of lines are partitioned by range with a secondary sort by document and position, and each partition
is streamed once. What comes back is a compressed bitmap of kept lines per document, not text.

A line's key is the line without blanks at both ends, A-Z in lower case. Keys found in `min_docs` documents or more lose
their lines everywhere, or all but the first one (by doc_id, then position) with `keep_first`. Lines without a key (fewer
than `min_chars` code points) stay.

The range has the document as its second key, so the lines of a hot key are dealt over as many partitions as they need. A
partition decides about the keys that lie inside it alone. Its first and last key may go on in other partitions: it gives a
row of counts for each of them, and their lines only where its own count leaves the matter open. The counts are summed by
key (at most two rows a partition).

Keys are compared by 64-bit hashes. The document's text is looked at twice: for its keys, and when lines are cut.

Defined results for odd input: a null text counts as empty, which is one empty line; every row is a document of its own,
but with `keep_first` rows of equal id and text keep the same lines; a line repeated within a document counts once; null
ids sort first, and documents of one id (or of none) follow one another by a hash; an empty table gives an empty table; input columns of any name are kept by `cut_lines`, the added ones give
way (`free_name`); a text of any length is split whole, in one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, quoted, saved, text_of

#: a line is stripped of these at both ends
BLANKS = b" \t\n\x0b\x0c\r"
BATCH_BYTES = 1 << 22


@dataclass(frozen=True)
class Lines:
    min_docs: int = 10
    min_chars: int = 1
    keep_first: bool = False


def line_keys(text: bytes, min_chars: int = 1) -> list[int]:
    """A hash for each line's key, 0 where the line has none."""
    from xxhash import xxh3_64_intdigest

    keys = [line.strip(BLANKS) for line in text.lower().split(b"\n")]
    if min_chars > 1:
        keys = [k if len(k.decode("utf-8", "replace")) >= min_chars else b"" for k in keys]
    return [(xxh3_64_intdigest(k) or 1) if k else 0 for k in keys]


def pack(dropped: np.ndarray, n_lines: int) -> bytes:
    """The bitmap of kept lines, compressed; bit i is set if line i stays."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _keyed(docs: DataFrame, how: Lines) -> DataFrame:
    """row, doc_id, digest (of the text), same (equal for equal id and text), keys (a hash per line); a saved table."""
    text = text_of()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.md5(text).alias("digest"), F.xxhash64("doc_id", text).alias("same"), text.cast("binary").alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size, some = 0, []
                column = batch.column(4)
                while at + len(some) < batch.num_rows and size < BATCH_BYTES:
                    some.append(column[at + len(some)].as_py())
                    size += len(some[-1])
                found = [line_keys(t, how.min_chars) for t in some]
                flat = np.array([k for x in found for k in x], np.uint64).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["row", "doc_id", "digest", "same", "keys"])
                at += len(some)
        pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(rows.mapInArrow(keys, f"row long, doc_id {kind}, digest string, same long, keys array<long>"), "line-keys")


_MARKS = "row long, pos int, key long, lead boolean, same long, part int, docs long"


def _streamed(lines: DataFrame, how: Lines) -> DataFrame:
    """Marks of a partition's lines, and counts for its first and last key; lines (row, same, pos, key) by range and in order.

    key null: the line goes. key and pos: the line goes if the key does. key and no pos: counts of a key, with its first line.
    """
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), True
        held: list[list[np.ndarray]] = []

        def closed(parts: list[list[np.ndarray]], at_start: bool, at_end: bool) -> pa.RecordBatch:
            key, same, row, pos = (np.concatenate(x) for x in zip(*parts))
            start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            run = np.repeat(np.arange(len(start)), np.diff([*start, len(key)]))
            new = np.ones(len(key), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            docs = np.add.reduceat(new.astype(np.int64), start)
            edge = np.zeros(len(start), bool)
            edge[0], edge[-1] = at_start or (at_end and len(start) == 1), at_end or (at_start and len(start) == 1)
            lead = (same == same[start][run]) & (pos == pos[start][run])
            gone = (docs >= how.min_docs)[run]
            # open: the partition does not know whether these lines go
            open_ = edge[run] & (lead | ~gone if how.keep_first else ~gone)
            sure = gone & ~open_ & ~(lead & how.keep_first)
            sums = np.flatnonzero(edge)
            n_sure, n_open, n_sums = int(sure.sum()), int(open_.sum()), len(sums)
            nothing = lambda n, t: pa.nulls(n, t)
            join = lambda t, *parts: pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p, t) for p in parts])
            return pa.RecordBatch.from_arrays([
                join(pa.int64(), row[sure], row[open_], nothing(n_sums, pa.int64())),
                join(pa.int32(), pos[sure], pos[open_], nothing(n_sums, pa.int32())),
                join(pa.int64(), nothing(n_sure, pa.int64()), key[open_], key[start][sums]),
                join(pa.bool_(), nothing(n_sure, pa.bool_()), lead[open_], nothing(n_sums, pa.bool_())),
                join(pa.int64(), nothing(n_sure, pa.int64()), same[open_], same[start][sums]),
                join(pa.int32(), nothing(n_sure + n_open, pa.int32()), np.full(n_sums, part)),
                join(pa.int64(), nothing(n_sure + n_open, pa.int64()), docs[sums])], names=["row", "pos", "key", "lead", "same", "part", "docs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            # the run that may go on is held back: a partition's size at most
            last = int(np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))[-1])
            if last or held and held[-1][0][-1] != columns[0][0]:
                ready = held + ([[c[:last] for c in columns]] if last else [])
                yield closed(ready, first, False)
                held, first = [[c[last:] for c in columns]], False
            else:
                held.append(columns)
        if held:
            yield closed(held, first, True)
        pa.default_memory_pool().release_unused()

    return saved(lines.select("key", "same", "row", "pos").mapInArrow(stream, _MARKS), "line-marks")


def keep_bitmaps(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """doc_id, digest (MD5 of the text), n_lines, n_dropped, bitmap (of kept lines; null where all stay): a row per row of docs."""
    texts = _keyed(docs, how)
    lines = texts.select("row", "doc_id", "same", F.posexplode("keys").alias("pos", "key")).filter("key <> 0")
    order = ["key", "doc_id", "same", "row"]
    marks = _streamed(lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos"), how)
    # at most two rows a partition
    counts = marks.filter("pos IS NULL").groupBy("key").agg(F.sum("docs").alias("docs"), F.min(F.struct("part", "same")).alias("first"))
    common = F.broadcast(counts.filter(F.col("docs") >= how.min_docs).select(F.col("key").alias("k"), F.col("first.same").alias("first_same")))
    left = marks.filter("key IS NOT NULL AND pos IS NOT NULL").join(common, F.col("key") == F.col("k"))
    if how.keep_first:
        left = left.filter(~(F.col("lead") & (F.col("same") == F.col("first_same"))))
    gone = marks.filter("key IS NULL").select("row", "pos").unionByName(left.select("row", "pos"))
    gone = gone.groupBy(F.col("row").alias("r")).agg(F.collect_list("pos").alias("gone"))
    both = texts.select("row", "doc_id", "digest", F.size("keys").alias("n_lines")).join(gone, F.col("row") == F.col("r"), "left")

    @F.pandas_udf("binary")
    def bitmap(lines_: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pack(np.asarray(x), k) for x, k in zip(lines_, n)])

    return both.select("doc_id", "digest", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), bitmap("gone", "n_lines").alias("bitmap"))


def cut_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the lines that their bitmaps keep, and n_lines and n_dropped; bitmaps as `keep_bitmaps` gives them for these docs."""
    p = free_name(docs, "_line_")
    # rows of equal id and text have the same bitmap
    one = bitmaps.groupBy("doc_id", "digest").agg(F.first("n_lines").alias("n_lines"), F.first("n_dropped").alias("n_dropped"), F.first("bitmap").alias("bitmap"))
    one = one.select(*[F.col(c).alias(p + c) for c in one.columns])
    both = docs.withColumn(p + "own", F.md5(text_of())).join(one, F.col("doc_id").eqNullSafe(F.col(p + "doc_id")) & (F.col(p + "own") == F.col(p + "digest")))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, n: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else "\n".join(x for x, keep in zip(t.split("\n"), unpack(m, k)) if keep) for t, k, m in zip(texts, n, maps)], dtype=object)

    # only texts that lose lines go to Python
    some = F.when(F.col(p + "bitmap").isNotNull(), text_of())
    both = both.withColumn(p + "cut", cut(some, F.col(p + "n_lines"), F.col(p + "bitmap")))
    return both.select(*[F.coalesce(p + "cut", "text").alias(c) if c == "text" else quoted(c) for c in docs.columns], F.col(p + "n_lines").alias(free_name(docs, "n_lines")), F.col(p + "n_dropped").alias(free_name(docs, "n_dropped")))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = cut_lines(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT rid, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid) JOIN d USING (rid)"""
