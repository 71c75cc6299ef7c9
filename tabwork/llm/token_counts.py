"""Token counts: the documents of flat token files, found by a scan for the end-of-document id.

A flat file is ids one after the other with an end id after each document, without an index. It comes as blocks, cut
at any byte, even inside an id: rows (file, block, data), and `at`, the place of a block's first byte, where that is
known. Each block is searched on its own with numpy; ids that lie across edges are put together from their pieces; and
what is open at the edges is stitched by prefix scans over block summaries, in two levels (within runs of blocks, then
over the runs), so that no task sees every block of a long file.

Defined results for odd input: a null or empty text is a document of its end id alone, and repeated rows are documents
each; a document of any length is one, however many blocks it takes; blocks without an end id only lengthen the document
they lie in; ids after the last end id are a document with `ended` false, and bytes after the last whole id are left
out; an empty or null block counts as no ids; (file, block) must be unique, as a block that is there twice has no place
of its own; an empty table gives an empty table; other columns are ignored. The end id is none of the
vocabulary's, so no text can bring one along; a writer whose ids do not allow that is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import saved
from .shingles import in_chunks
from .tokens import encoder


@dataclass(frozen=True)
class Layout:
    #: the first id that the vocabulary does not use
    end_id: int = 50257
    #: numpy's name of the id type in the files
    dtype: str = "<u2"
    block_bytes: int = 1 << 20
    run_blocks: int = 1024
    tokenizer: str = "byte_bpe_50k"


def read_blocks(spark: SparkSession, path: str, layout: Layout = Layout()) -> DataFrame:
    """Blocks of the flat files at a path, read by Spark's binary source: a file is read in one task, so files should be of the size of a part file (2 GB at most)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = data.as_buffer()
                for k, at in enumerate(range(0, view.size, layout.block_bytes)):
                    part = view.slice(at, min(layout.block_bytes, view.size - at)).to_pybytes()
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([k], pa.int64()), "at": pa.array([at], pa.int64()), "data": [part]})

    return files.mapInArrow(cut, "file string, block long, at long, data binary")


def write_blocks(docs: DataFrame, layout: Layout = Layout()) -> tuple[DataFrame, DataFrame]:
    """Token files of documents: (blocks, documents by place). A task writes one file; blocks are cut by size alone.

    Both come from one table: each block carries the ids of the documents that end in it, which say who a document is and
    nothing about where it lies.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, kind = encoder(layout.tokenizer), np.dtype(layout.dtype)
        if layout.end_id > np.iinfo(kind).max:
            raise ValueError(f"the end id {layout.end_id} does not fit {layout.dtype}")
        file, block, at, room = f"part-{TaskContext.get().partitionId():06d}", 0, 0, bytearray()
        ends: list[tuple[int, int | None]] = []  # (bytes from the start of `room`, doc_id)

        def flush(size: int) -> pa.RecordBatch:
            nonlocal block, at, room, ends
            inside = [d for to, d in ends if to <= size]
            ends = [(to - size, d) for to, d in ends if to > size]
            data, room = bytes(room[:size]), room[size:]
            block, at = block + 1, at + size
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block - 1], pa.int64()), pa.array([at - size], pa.int64()), pa.array([data], pa.binary()), pa.array([inside], pa.list_(pa.int64()))],
                                              names=["file", "block", "at", "data", "doc_ids"])

        for batch in batches:
            for doc_ids, texts in in_chunks(batch):
                for doc_id, text in zip(doc_ids, texts):
                    ids = encode(text)
                    if ids and max(ids) >= layout.end_id:
                        raise ValueError(f"the vocabulary {layout.tokenizer} uses ids up to {max(ids)}, so {layout.end_id} cannot end documents")
                    room += np.array([*ids, layout.end_id], dtype=kind).tobytes()
                    ends.append((len(room), doc_id))
                    while len(room) >= layout.block_bytes:
                        yield flush(layout.block_bytes)
        if room:
            yield flush(len(room))

    table = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, "file string, block long, at long, data binary, doc_ids array<long>"), "tokens")
    return table.select("file", "block", "at", "data"), table.select("file", "block", "doc_ids")


def _scanned(blocks: DataFrame, sums: dict[str, str], run_blocks: int) -> DataFrame:
    """file, block and, for each name -> column, the sum of that column over all earlier blocks of the file; a name that begins
    with "last" takes the largest instead (null where there is none). Two levels: blocks within a run, then runs.
    """
    def before(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], out: str) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({out + n: F.max(c).over(earlier) if n.startswith("last") else F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in columns.items()})

    runs = blocks.withColumn("run", F.floor(F.col("block") / run_blocks).cast("long"))
    inner = before(runs, ["file", "run"], "block", sums, "i_")
    totals = runs.groupBy("file", "run").agg(*[(F.max(c) if n.startswith("last") else F.sum(c)).alias(n) for n, c in sums.items()])
    outer = before(totals, ["file"], "run", {n: n for n in sums}, "o_").select("file", "run", *[f"o_{n}" for n in sums])
    joined = inner.join(outer, ["file", "run"])
    return joined.select("file", "block", *[(F.greatest(f"i_{n}", f"o_{n}") if n.startswith("last") else F.col(f"i_{n}") + F.col(f"o_{n}")).alias(n) for n in sums])


def _placed(blocks: DataFrame, layout: Layout) -> DataFrame:
    """file, block, at, data: with the place of each block's first byte."""
    if "at" in blocks.columns:
        return blocks.select("file", "block", "at", "data")
    sizes = saved(blocks.select("file", "block", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("size")), "block-sizes")
    starts = _scanned(sizes, {"at": "size"}, layout.run_blocks)
    return blocks.select("file", "block", "data").join(starts, ["file", "block"]).select("file", "block", "at", "data")


def _searched(blocks: DataFrame, layout: Layout) -> DataFrame:
    """file, block, until (whole ids of the file up to the block's end), ends (places of the end ids inside it), head, tail (bytes of ids that lie across its edges)."""
    kind = np.dtype(layout.dtype)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, data = batch.column(2)[k].as_py(), batch.column(3)[k].as_buffer()
                view = memoryview(data) if data else memoryview(b"")
                head = min(-at % kind.itemsize, len(view))
                whole = (len(view) - head) // kind.itemsize
                ids = np.frombuffer(view, dtype=kind, count=whole, offset=head) if whole else np.zeros(0, kind)
                tail = head + whole * kind.itemsize
                first = (at + head) // kind.itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([at], pa.int64()), pa.array([(at + len(view)) // kind.itemsize], pa.int64()), pa.array([first + np.flatnonzero(ids == layout.end_id)], pa.list_(pa.int64())),
                     pa.array([bytes(view[:head])], pa.binary()), pa.array([bytes(view[tail:])], pa.binary())], names=["file", "block", "at", "until", "ends", "head", "tail"])

    return blocks.mapInArrow(search, "file string, block long, at long, until long, ends array<long>, head binary, tail binary")


def _across(found: DataFrame, layout: Layout) -> DataFrame:
    """file, block, place: end ids that lie across the edges of blocks, in the block that holds their last byte."""
    kind = np.dtype(layout.dtype)
    size = kind.itemsize
    piece = lambda place, at, data: found.select("file", "block", place.cast("long").alias("place"), at.cast("long").alias("byte"), F.hex(data).alias("data")).filter("data <> ''")
    end = F.col("at") + F.octet_length("head")
    tail_at = F.col("until") * size
    pieces = piece(F.floor((end - 1) / size), F.col("at"), F.col("head")).union(piece(F.col("until"), F.greatest(tail_at, end), F.col("tail")))
    joined = pieces.groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("byte", "block", "data"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["data"]), "")
    wanted = np.array([layout.end_id], kind).tobytes().hex().upper()
    return joined.filter(text == wanted).select("file", F.array_max(F.transform("parts", lambda x: x["block"])).alias("block"), "place")


def token_counts(blocks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """file, ordinal (of the document in its file), start, n_tokens (without the end id), ended, block (where it ends)."""
    found = saved(_searched(_placed(blocks, layout), layout), "searched")
    across = _across(found.filter("octet_length(head) + octet_length(tail) > 0"), layout).withColumnsRenamed({"file": "f", "block": "b"})
    # an id across the edge comes before all others in the block; blocks are few beside ids
    sides = found.select("file", "block", "until", "ends").join(across, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left")
    sides = sides.select("file", "block", "until", F.when(F.col("place").isNotNull(), F.concat(F.array("place"), "ends")).otherwise(F.col("ends")).alias("ends"))
    sides = saved(sides.withColumns({"k": F.size("ends").cast("long"), "end": F.array_max("ends")}), "ends")
    before = _scanned(sides.select("file", "block", "k", "end"), {"k0": "k", "last": "end"}, layout.run_blocks)
    each = sides.select("file", "block", "ends").join(before, ["file", "block"]).select("file", "block", "k0", "last", "ends", F.posexplode("ends").alias("i", "place"))
    start = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.coalesce("last", F.lit(-1))) + 1
    done = each.select("file", (F.col("k0") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("place") - start).alias("n_tokens"), F.lit(True).alias("ended"), "block")
    # what is open at the end of a file
    files = sides.groupBy("file").agg(F.sum("k").alias("ordinal"), (F.coalesce(F.max("end"), F.lit(-1)) + 1).alias("start"), F.max("until").alias("n"))
    open_ = files.filter("start < n").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"), F.lit(None).cast("long").alias("block"))
    return done.unionByName(open_)


def documents(counts: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, n_tokens, file, ordinal, start, ended: the documents that end in a block, in order, meet the end ids found in it."""
    first = F.min("ordinal").over(Window.partitionBy("file", "block"))
    placed = counts.filter("ended").withColumn("i", (F.col("ordinal") - first).cast("int"))
    who = names.select(F.col("file").alias("f"), F.col("block").alias("b"), F.posexplode("doc_ids").alias("j", "doc_id"))
    return placed.join(who, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("i") == F.col("j"))).select("doc_id", "n_tokens", "file", "ordinal", "start", "ended")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    blocks, names = write_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents(token_counts(blocks), names)
