"""Best-fit packing: bounded-space online best-fit. Each task packs its own documents in one pass: a fixed number of open
bins sits in a bitset keyed by free space, a piece goes to the bin it fills best, and when there are too many bins the
fullest closes first. There is no shuffle, and a task holds its open bins and one batch.

A document is its ids and the end id. Documents longer than a sequence are cut, the odd piece first, so that all other
pieces fill a sequence each.

Defined results for odd input: a null or empty text is its end id alone; repeated rows are packed each on its own; an
empty table gives an empty table; a null doc_id stays null; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import encoder

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    length: int = 1024
    end_id: int = 2
    open_bins: int = 4096
    tokenizer: str = "byte_bpe_50k"


class OpenBins:
    """Open bins by free space: bit f of `free` is set while a bin with f places left is open."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.count, self.free, self.made = length, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of this size."""
        fits = self.free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            chosen = self._take(left)
        else:
            chosen, left = self.made, self.length
            self.made += 1
        rest = left - size
        if rest:
            if self.count == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            self.by_free[rest].append(chosen)
            self.free |= 1 << rest
            self.count += 1
        return chosen, self.length - left

    def _take(self, left: int) -> int:
        bins = self.by_free[left]
        chosen = bins.pop()
        if not bins:
            self.free &= ~(1 << left)
        self.count -= 1
        return chosen


def packed(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bins = encoder(how.tokenizer), OpenBins(how.length, how.open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows, part = [], batch.slice(at, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), how.end_id], dtype="<u4")
                    start, piece = 0, 0
                    while start < len(ids):
                        size = (len(ids) - start) % how.length or how.length
                        where, offset = bins.put(size)
                        rows.append((doc_id, piece, start, size, ids[start:start + size].tobytes(), base + where, offset))
                        start, piece = start + size, piece + 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
                                                 names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])
            del batch
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    out = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
