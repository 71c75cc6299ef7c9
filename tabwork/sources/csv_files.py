"""CSV files whose quoted fields may hold line breaks, commas and quotes, however the files are cut into blocks.

Files are read by lines, block by block. A line is a function from "begins inside a quoted field" to "ends inside one"; a task
composes the functions of a block's lines for both ways in which the block may begin, and numbers the records for both. One
row per block then tells, block after block, which way was right. So a file is read once, by as many tasks as it has blocks,
and only the lines of records that go over several lines are brought together.

The dialect is that of RFC 4180: a field that begins with a quote ends with one, a doubled quote inside stands for one, and
quotes inside other fields are plain characters. Lines end with \\n or \\r\\n; blank lines are no records; empty fields are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.folders import saved
from ..functions.rules import NUMBER, one_missing

_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
#: one whole field and the comma behind it, from where the last one ended
_FIELD = rf'\G(?:"{_INSIDE}"(?!")[^,]*+|[^",][^,]*+|)(?:,|\z)'
#: the end of a quoted field that began on an earlier line
_END = rf'^{_INSIDE}"(?!")[^,]*+(?:,|\z)'
_PIECE = rf'\G,(?:"{_INSIDE}"(?!")[^,]*+|[^",][^,]*+|)'
_QUOTED = rf'(?s)^"({_INSIDE})"(.*)\z'
_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, source, block, at, line, and what a task knows of each line: inside, open and number if its block begins outside (0) or inside (1) a field."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    ends_open = lambda c: F.startswith(F.regexp_replace(c, _FIELD, ""), F.lit('"'))
    plain = ~F.contains("line", F.lit('"'))
    after_out = F.when(plain, False).otherwise(ends_open(F.col("line")))
    after_in = F.when(plain, True).when(F.col("line").rlike(_END), ends_open(F.regexp_replace("line", _END, ""))).otherwise(True)
    text = text.select("*", F.xxhash64("file", "block").alias("piece"), after_out.alias("after0"), after_in.alias("after1"), F.col("line").isin("", "\r").alias("blank"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, numbers = None, [False, True], [0, 0]
        for batch in batches:
            piece, after0, after1, blank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5, 9))
            made = [[], [], [], [], [], []]
            edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)] if len(piece) else [0]
            for a, b in zip(edges, edges[1:]):
                if piece[a] != last:
                    last, carry, numbers = piece[a], [False, True], [0, 0]
                f0, f1 = after0[a:b].astype(bool), after1[a:b].astype(bool)
                # the last line that ends one way however it begins, and the flips since then
                sure = np.maximum.accumulate(np.where(f0 == f1, np.arange(b - a), -1))
                flips = np.cumsum(f0 & ~f1)
                for k in (0, 1):
                    known = f0[np.maximum(sure, 0)] ^ ((flips - flips[np.maximum(sure, 0)]) % 2 == 1)
                    after = np.where(sure >= 0, known, carry[k] ^ (flips % 2 == 1))
                    before = np.concatenate([[carry[k]], after[:-1]])
                    number = numbers[k] + np.cumsum(~before & ~blank[a:b].astype(bool))
                    carry[k], numbers[k] = bool(after[-1]), int(number[-1])
                    for held, x in zip(made[3 * k:3 * k + 3], (before, after, number)):
                        held.append(x)
            flat = [np.concatenate(x) if x else np.zeros(0) for x in made]
            kinds = [pa.bool_(), pa.bool_(), pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), batch.column(8), *(pa.array(x.astype(bool) if k == pa.bool_() else x.astype(np.int64), k) for x, k in zip(flat, kinds))],
                                             names=["file", "source", "block", "at", "line", "blank", "inside0", "open0", "number0", "inside1", "open1", "number1"])

    return saved(text.mapInArrow(scan, "file string, source string, block long, at long, line string, blank boolean, inside0 boolean, open0 boolean, number0 long, inside1 boolean, open1 boolean, number1 long"), "csv-lines")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file (path), source (its name), number (from 1, in the order of the file), record (its text).

    Jobs: one reads the files, one looks at a row per block. A file that ends inside a quoted field is an error.
    """
    lines = _lines(spark, path)
    # a row per block: how it ends and how many records begin in it, for both ways to begin
    ends = lines.groupBy("file", "block").agg(*[f.alias(n) for k in "01" for n, f in ((f"open{k}", F.max_by(f"open{k}", "at")), (f"n{k}", F.max(f"number{k}")))])
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({"flips": F.sum(F.when(F.col("open0") & ~F.col("open1"), 1).otherwise(0)).over(upto)})
    ends = ends.withColumn("sure", F.last(F.when(F.col("open0") == F.col("open1"), F.struct(F.col("open0").alias("open"), F.col("flips").alias("flips"))), ignorenulls=True).over(upto))
    after = F.when(F.col("sure").isNotNull(), F.col("sure.open").cast("int") + F.col("flips") - F.col("sure.flips")).otherwise(F.col("flips")) % 2 == 1
    by_block = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("after", after).withColumn("begins", F.coalesce(F.lag("after").over(by_block), F.lit(False)))
    held = F.when(F.col("begins"), F.col("n1")).otherwise(F.col("n0"))
    before = F.sum(held).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    blocks = saved(ends.select(F.col("file").alias("f"), F.col("block").alias("b"), "begins", "after", F.coalesce(before, F.lit(0)).alias("before")), "csv-blocks")
    cut = [r["f"] for r in blocks.groupBy("f").agg(F.max_by("after", "b").alias("open")).filter("open").limit(3).collect()]
    if cut:
        raise ValueError(f"a quoted field has no end in {cut}")
    pick = lambda name: F.when(F.col("begins"), F.col(name + "1")).otherwise(F.col(name + "0"))
    # a row per block: broadcast by its measured size, joined by shuffle beyond Spark's limit
    placed = lines.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select(
        "file", "source", "block", "at", "line", "blank", pick("inside").alias("inside"), pick("open").alias("open"), (F.col("before") + pick("number")).alias("number"))
    keys = ["file", "source", "number"]
    single = placed.filter("NOT inside AND NOT open AND NOT blank").select(*keys, F.col("line").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    several = placed.filter("inside OR open").groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["line"]), "\n").alias("record"))
    clean = F.regexp_replace(F.when(F.col("number") == 1, F.regexp_replace("record", r"^\uFEFF", "")).otherwise(F.col("record")), r"\r\z", "")
    return single.unionByName(several).select(*keys, clean.alias("record"))


def fields(record: Column | str) -> Column:
    """The fields of a record, empty ones as null."""
    text = F.concat(F.lit(","), F.col(record) if isinstance(record, str) else record)

    def value(piece: Column) -> Column:
        raw = F.substring(piece, 2, 2147483647)
        said = F.concat(F.replace(F.regexp_extract(raw, _QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(raw, _QUOTED, 2))
        return F.nullif(F.when(F.startswith(raw, F.lit('"')), said).otherwise(raw), F.lit(""))

    return F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), value)


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """source, row, col (both from 1), value: files of any layout as one grid, for `operators.grid`."""
    found = records(spark, path).select("source", F.col("number").alias("row"), F.posexplode(fields("record")).alias("col", "value"))
    return found.select("source", "row", (F.col("col") + 1).alias("col"), "value")


#: what a text may be, narrowest first; the counts of texts that are so add up over rows, blocks and files
_KINDS = ("bigint", "double", "boolean", "timestamp")


def _counts(value: Column) -> list[Column]:
    number = value.rlike(NUMBER)
    tests = (value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("bigint").isNotNull(), number, F.lower(F.trim(value)).isin("true", "false"), value.rlike(_TIME) & value.try_cast("timestamp").isNotNull())
    return [F.count(value).alias("known"), *[F.count(F.when(t, 1)).alias(k) for k, t in zip(_KINDS, tests)]]


def _kind() -> Column:
    """The narrowest type that holds all known values: the least upper bound in the lattice void < bigint < double < string, boolean and timestamp < string."""
    found = F.when(F.col("known") == 0, "void")
    for k in _KINDS:
        found = found.when(F.col(k) == F.col("known"), k)
    return found.otherwise("string")


def column_info(rows: DataFrame, by_file: bool = True) -> DataFrame:
    """(source,) name, position, known, missing, kind, for files whose first record holds the names; rows as `records` gives them.

    Files may have different columns. Counts by file add up to those of all files, of which by_file=False tells the types.
    """
    cells = rows.select("source", "number", F.posexplode(fields("record")).alias("position", "value"))
    names = cells.filter("number = 1").select(F.col("source").alias("s"), F.col("position").alias("p"), F.coalesce("value", F.concat(F.lit("_c"), F.col("position").cast("string"))).alias("name"))
    lengths = rows.groupBy("source").agg((F.count("*") - 1).alias("rows"))
    counts = cells.filter("number > 1").groupBy("source", "position").agg(*_counts(F.col("value")))
    every = names.join(counts, (F.col("s") == F.col("source")) & (F.col("p") == F.col("position")), "left").drop("source", "position").join(lengths.withColumnRenamed("source", "l"), F.col("s") == F.col("l"))
    every = every.select(F.col("s").alias("source"), F.col("p").alias("position"), "name", "rows", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("known", *_KINDS)])
    if not by_file:
        every = every.groupBy("name").agg(F.min(F.struct("source", "position")).alias("first"), F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in ("known", *_KINDS)])
    return every.select(*(["source", "name", "position"] if by_file else ["name", "first"]), "known", (F.col("rows") - F.col("known")).alias("missing"), _kind().alias("kind"))


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """A row per CSV file, whatever its columns: source, kilobytes, rows, columns, missing, types and missing_by_column (name:type and name:number, comma-joined in order)."""
    rows = records(spark, path)
    sizes = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("s"), F.round(F.col("length") / 1024, 1).alias("kilobytes"))
    count = rows.groupBy(F.col("source").alias("c")).agg((F.count("*") - 1).alias("rows"))
    listed = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", what))), lambda x: F.concat(x["name"], F.lit(":"), x[what].cast("string"))), ", ")
    info = column_info(rows).groupBy("source").agg(F.count("*").alias("columns"), F.sum("missing").alias("missing"), listed("kind").alias("types"), listed("missing").alias("missing_by_column"))
    return info.join(count, F.col("source") == F.col("c")).join(sizes, F.col("source") == F.col("s")).select("source", "kilobytes", "rows", "columns", "missing", "types", "missing_by_column")


def load_files(spark: SparkSession, path: str, common_only: bool = False) -> DataFrame:
    """CSV files of different columns as one table: all columns (or those that all files have), each of the type that holds its values in every file, with source and _row_id.

    Jobs: one saves the records, one finds names and types, a row per column name, one saves the names of each file; common_only takes two small ones more.
    """
    rows = saved(records(spark, path), "csv-records")
    found = column_info(rows, False).orderBy("first").collect()
    names = F.transform(fields("record"), lambda n, i: F.coalesce(n, F.concat(F.lit("_c"), i.cast("string"))))
    # a row per file: broadcast by its measured size, as a shuffle by file would bring a file's records to one task
    files = saved(rows.filter("number = 1").select(F.col("source").alias("s"), names.alias("names")), "csv-names")
    chosen = found
    if common_only:
        n = files.count()
        shared = {r["name"] for r in files.select(F.explode(F.array_distinct("names")).alias("name")).groupBy("name").count().filter(F.col("count") == n).collect()}
        chosen = [r for r in found if r["name"] in shared]
    body = rows.filter("number > 1").join(files, F.col("source") == F.col("s")).select("source", "number", "names", fields("record").alias("v"))
    value = lambda name: F.get("v", (F.array_position("names", name) - 1).cast("int"))
    typed = [(value(r["name"]) if r["kind"] in ("string", "void") else F.trim(value(r["name"])).try_cast(r["kind"])).alias(r["name"]) for r in chosen]
    return one_missing(body.select(*typed, "source", (F.col("number") - 1).alias("_row_id")))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True) -> DataFrame:
    """A file or folder of files of one layout, with source (file name) and _row_id (order within a source, from 1).

    Without a schema, names (header) and types come from the files by one job more.
    """
    if schema is None and header:
        return load_files(spark, path)
    rows = records(spark, path)
    if schema is None:
        rows = saved(rows, "csv-records")
        kinds = {r["position"]: r["kind"] for r in rows.select(F.posexplode(fields("record")).alias("position", "value")).groupBy("position").agg(*_counts(F.col("value"))).select("position", _kind().alias("kind")).collect()}
        schema = T.StructType([T.StructField(f"_c{i}", T._parse_datatype_string("string" if k == "void" else k)) for i, k in sorted(kinds.items())])
    wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    body = rows.filter(F.col("number") > int(header)).select("source", (F.col("number") - int(header)).alias("_row_id"), fields("record").alias("v"))
    cast = lambda i, f: F.get("v", F.lit(i)) if isinstance(f.dataType, T.StringType) else F.trim(F.get("v", F.lit(i))).try_cast(f.dataType)
    return one_missing(body.select(*[cast(i, f).alias(f.name) for i, f in enumerate(wanted)], "source", "_row_id"))
