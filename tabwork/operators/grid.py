"""Repair of spreadsheet-style grids, many sheets at once: every step works by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.folders import saved
from ..functions.rules import NUMBER, numeric_columns, stripped, text_columns, to_number

#: Labels of subtotal rows.
SUBTOTALS = ("소 계", "소계", "합 계", "합계", "계", "총계", "총 계", "내부흡수액", "소  계", "합  계")


def header_row(cells: DataFrame, most: int = 15) -> DataFrame:
    """source, header_row: of the first rows, the one that is fullest and most like names (0.6 filled, 0.4 text); the first of equals.

    cells: source, row, col, value (null or blank: empty).
    """
    filled = F.col("value").isNotNull() & (stripped("value") != "")
    text = filled & ~F.replace("value", F.lit(","), F.lit("")).rlike(NUMBER)
    width = cells.groupBy("source").agg(F.countDistinct("col").alias("width"))
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy("row"))
    rows = cells.withColumn("_r", rank).filter(F.col("_r") <= most).groupBy("source", "row").agg(F.count(F.when(filled, 1)).alias("f"), F.count(F.when(text, 1)).alias("t"))
    score = F.round(0.6 * F.col("f") / F.col("width") + 0.4 * F.coalesce(F.try_divide("t", "f"), F.lit(0.0)), 9)
    return rows.join(width, "source").groupBy("source").agg(F.max_by("row", F.struct(score.alias("s"), (-F.col("row")).alias("r"))).alias("header_row"))


def header_names(header: DataFrame) -> DataFrame:
    """source, col, name from two header rows: source, col, upper, lower (null or blank: empty)."""
    blank = lambda c: F.when(stripped(c) == "", None).otherwise(stripped(c))
    by_col = Window.partitionBy("source").orderBy("col")
    h = header.select("source", "col", blank("upper").alias("u"), blank("lower").alias("l"))
    facts = h.groupBy("source").agg(F.count("l").alias("names"), F.count(F.when(F.col("u").isNull(), 1)).alias("blanks"), F.count(F.when(F.col("l").rlike(NUMBER), 1)).alias("numbers"))
    two = (F.col("names") >= 3) & ((F.col("blanks") >= 2) | (F.col("numbers") < 0.3 * F.col("names")))
    parent = F.last("u", ignorenulls=True).over(by_col)
    run = F.count("u").over(by_col)
    h = h.join(facts.select("source", two.alias("two")), "source").withColumns({"p": parent, "run": run})
    within = F.row_number().over(Window.partitionBy("source", "run").orderBy("col")) - 1
    double = F.coalesce(F.nullif(F.concat_ws("_", "p", "l"), F.lit("")), F.concat(F.lit("col_"), F.col("col").cast("string")))
    single = F.coalesce("u", F.when(F.col("p").isNotNull(), F.concat_ws("_", "p", within.cast("string"))), F.concat(F.lit("col_"), F.col("col").cast("string")))
    named = h.withColumn("name", F.when(F.col("two"), double).otherwise(single))
    repeat = F.row_number().over(Window.partitionBy("source", "name").orderBy("col")) - 1
    return named.select("source", "col", F.when(repeat > 0, F.concat_ws("_", "name", repeat.cast("string"))).otherwise(F.col("name")).alias("name"))


def named_table(cells: DataFrame, most: int = 15) -> DataFrame:
    """source, row, name, value: the cells below each source's header row, each under the name of its column; cells as for `header_row`."""
    header = header_row(cells, most)
    titles = cells.join(header, "source").filter(F.col("row") == F.col("header_row")).select("source", "col", F.lit(None).cast("string").alias("lower"), F.col("value").alias("upper"))
    names = header_names(titles)
    body = cells.join(header, "source").filter(F.col("row") > F.col("header_row"))
    return body.join(names, ["source", "col"]).select("source", "row", "name", "value")


def fill_down(df: DataFrame, source: str, order: str, anchor: str | None = None, columns: list[str] | None = None, within_group: bool = False, blocks: int | None = None) -> DataFrame:
    """Merged cells: the anchor is filled from above; other text columns only from earlier continuation rows (rows whose
    anchor was blank), or with within_group from any earlier row of the anchor's group.

    A segmented scan on two levels, so that a source of any length is spread over tasks: rows are dealt into blocks by range of
    (source, order), and filled within their block. What a block hands on (the last known value of each column, and whether an
    anchor began a new group) is one row per source and block; these rows are scanned in order, and each block takes what comes
    in where it has nothing of its own. One job writes the blocks.
    """
    texts = [c for c in text_columns(df) if c not in (source, order)]
    anchor = anchor or texts[0]
    others = columns if columns is not None else [c for c in texts if c != anchor]
    empty = lambda c: F.when(stripped(c) == "", None).otherwise(F.col(c))
    rows = df.withColumns({c: empty(c) for c in (anchor, *others)}).withColumn("_more", F.col(anchor).isNull())
    rows = saved(rows.repartitionByRange(*([blocks] if blocks else []), source, order).withColumn("_block", F.spark_partition_id()), "fill-down")
    last = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(source, "_block").orderBy(order)
    # what other rows may take: values of continuation rows, or all values of a group
    given = {c: F.col(c) if within_group else F.when(F.col("_more"), F.col(c)) for c in others}
    rows = rows.withColumn("_group", F.count(anchor).over(inside))
    local = {f"_l_{c}": last(g, Window.partitionBy(source, "_block", "_group").orderBy(order) if within_group else inside) for c, g in given.items()}
    rows = rows.withColumns(local | {"_l_": last(F.col(anchor), inside)})

    newest = lambda c, known: F.max(F.when(known, F.struct(F.col(order).alias("o"), c.alias("v"))))
    ends = rows.groupBy(source, "_block").agg(newest(F.col(anchor), F.col(anchor).isNotNull()).alias("_a"), *[newest(g, g.isNotNull()).alias(f"_e_{c}") for c, g in given.items()])
    by_block = Window.partitionBy(F.col(source)).orderBy("_block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    if within_group:
        # a block with an anchor begins a group and hands on what comes after it; blocks without one hand on what they took
        ends = ends.withColumn("_epoch", F.count("_a").over(by_block))
        tail = lambda c: F.when(F.col("_a").isNull() | (F.struct(F.col(f"_e_{c}.o")) >= F.struct(F.col("_a.o"))), F.col(f"_e_{c}.v"))
        ends = ends.withColumns({f"_t_{c}": last(tail(c), Window.partitionBy(source, "_epoch").orderBy("_block")) for c in others})
        carried = {c: F.lag(f"_t_{c}").over(by_block) for c in others}
    else:
        carried = {c: F.last(F.col(f"_e_{c}.v"), ignorenulls=True).over(before) for c in others}
    carried = ends.select(F.col(source).alias("_s"), F.col("_block").alias("_b"), F.last("_a.v", ignorenulls=True).over(before).alias("_c_"), *[x.alias(f"_c_{c}") for c, x in carried.items()])
    both = rows.join(carried, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))

    def filled(c: str) -> Column:
        if within_group:
            return F.coalesce(c, f"_l_{c}", F.when(F.col("_group") == 0, F.col(f"_c_{c}")))
        return F.coalesce(c, F.when(F.col("_more"), F.coalesce(f"_l_{c}", f"_c_{c}")))

    made = {anchor: F.coalesce("_l_", "_c_")} | {c: filled(c) for c in others}
    return both.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def is_subtotal(columns: list[str], labels: tuple[str, ...] | None = None) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(stripped(c).isin(*(labels or SUBTOTALS)), F.lit(False))
    return hit


def drop_subtotals(df: DataFrame, labels: tuple[str, ...] | None = None) -> DataFrame:
    texts = text_columns(df)
    return df.filter(~is_subtotal(texts, labels)) if texts else df


def label_subtotals(df: DataFrame, anchor: str, continued: Column, labels: tuple[str, ...] | None = None) -> DataFrame:
    """The anchor of a continuation row takes the row's subtotal label; the last text column that has one wins."""
    found = F.lit(None).cast("string")
    for c in [c for c in text_columns(df) if c != anchor]:
        found = F.when(stripped(c).isin(*(labels or SUBTOTALS)), stripped(c)).otherwise(found)
    return df.withColumn(anchor, F.when(continued, F.coalesce(found, F.col(anchor))).otherwise(F.col(anchor)))


def text_to_number(df: DataFrame, share: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Text columns of which `share` of all rows says a number become numbers. One job decides; pass `columns` to decide yourself."""
    if columns is None:
        texts = text_columns(df)
        if not texts:
            return df
        rates = df.agg(*[F.avg(to_number(F.col(c)).isNotNull().cast("double")).alias(c) for c in texts]).first()
        columns = [c for c in texts if (rates[c] or 0) >= share]
    return df.withColumns({c: to_number(F.col(c)) for c in columns}) if columns else df


def whole_to_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Doubles that hold whole numbers only become longs. One job decides; pass `columns` to decide yourself."""
    if columns is None:
        doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        if not doubles:
            return df
        whole = df.agg(*[F.coalesce(F.bool_and((F.col(c) % 1 == 0) & (F.abs(c) < 9e15)), F.lit(False)).alias(c) for c in doubles]).first()
        columns = [c for c in doubles if whole[c]]
    return df.withColumns({c: F.col(c).cast("long") for c in columns}) if columns else df


def column_classes(df: DataFrame) -> DataFrame:
    numbers = set(numeric_columns(df))
    return df.sparkSession.createDataFrame([(c, "numeric" if c in numbers else "key") for c in df.columns], "column string, kind string")


def used_range(cells: DataFrame) -> DataFrame:
    """Per file and sheet the rows and columns that hold data, how many, and how densely; cells: file, sheet, row, col, value."""
    full = F.col("value").isNotNull() & (stripped("value") != "")
    out = cells.groupBy("file", "sheet").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"),
        F.countDistinct(F.when(full, F.col("row"))).alias("data_rows"), F.countDistinct(F.when(full, F.col("col"))).alias("data_cols"), F.count(F.when(full, 1)).alias("filled_cells"))
    out = out.withColumn("total_cells", (F.col("last_row") - F.col("first_row") + 1) * (F.col("last_col") - F.col("first_col") + 1))
    return out.withColumn("density", F.round(F.try_divide("filled_cells", "total_cells"), 3))
