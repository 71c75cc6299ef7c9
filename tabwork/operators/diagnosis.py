"""What is wrong with a table, exactly and in two scans of it.

The first scan counts, for all columns at once, missing and known values, summary rows, repeated rows and a histogram of each
column of numbers by the leading bits of its values. The histogram tells which values can be quartiles, and between which bounds
the limits of outliers must lie. The second scan saves only the values that these bounds leave open, and the first text values;
all else is worked out from the saved tables.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.folders import saved
from ..functions.rules import numeric_columns, text_columns, to_number
from .quality import SUMMARY_ROW, mixed_types
from .quantiles import BITS, ordered_bits, quantiles

#: rows of a text column that are looked at for mixed types (a fixed value), and the quartiles
FIRST, SHARES = 200, (0.25, 0.5, 0.75)
ROW = -1
Range = tuple[float, float]


@dataclass
class Numbers:
    """What the histogram tells of a column: known values, each rank that quartiles need with the range it lies in and the values before that range."""
    n: int = 0
    ranks: dict[int, tuple[Range, int]] = field(default_factory=dict)
    low: Range = (-math.inf, math.inf)
    high: Range = (-math.inf, math.inf)
    judged: bool = False

    def quartile(self, share: float, value) -> float:
        at = share * (self.n - 1)
        a, b = math.floor(at), math.ceil(at)
        return value(a) if a == b else (b - at) * value(a) + (at - a) * value(b)


def diagnosis(df: DataFrame, order: str | None = None, factor: float = 3.0, pattern: str = SUMMARY_ROW) -> DataFrame:
    """rule, column, value, message: what is wrong, most important first; a handful of rows.

    Rules: columns that miss more than 20 % (three at most), repeated rows (as equal if two 64-bit hashes are), rows that look like
    summaries, columns of one value (two; told by hashes), outliers (two) and columns of text and numbers (two) by their first values in
    order; null orders come first. The jobs run when this is called. Where the order is neither a number, date nor time, the last rule
    takes a scan of its own.
    """
    names, numbers, texts = df.columns, numeric_columns(df), [c for c in text_columns(df) if c != order]
    prunable = order is not None and isinstance(df.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    place = _place(order, df.schema[order].dataType) if prunable else None
    sums = saved(_sums(df, names, numbers, texts, place, pattern), "diagnosis")
    facts = {r["c"]: r for r in sums.groupBy("c").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(F.col("a") == 1, F.col("n"))), F.lit(0)).alias("ones"),
        F.sum("again").alias("again"), F.min("first").eqNullSafe(F.max("last")).alias("same")).collect()}
    if not facts:
        return _messages(df, [])
    known = {c: facts[i] for i, c in enumerate(names)}
    found = [("missing", c, _percent(f["n"] - f["known"], f["n"])) for c, f in sorted(known.items(), key=lambda e: (-(e[1]["n"] - e[1]["known"]), e[0])) if _percent(f["n"] - f["known"], f["n"]) > 20][:3]
    found += [("duplicates", None, facts[ROW]["again"])] if facts[ROW]["again"] else []
    summary = max((known[c]["ones"] for c in text_columns(df)), default=0)
    found += [("summary_rows", None, summary)] if summary else []
    found += [("constant", c, 1) for c in sorted(c for c, f in known.items() if f["known"] and f["same"])[:2]]
    of = {c: _numbers(c, rows, factor) for c, rows in _ranges(sums, names, numbers).items()}
    firsts = _first_places(sums, names, texts) if prunable else {}
    opened = saved(_opened(df, names, of, firsts, order, place), "diagnosis-open")
    found += [("outliers", c, n) for c, n in sorted(_outliers(sums, opened, names, of, factor).items()) if n][:2]
    mixed = _mixed(opened, names) if prunable else mixed_types(df, order) if texts else None
    found += [("mixed", r["column"], r["share"]) for r in mixed.orderBy("column").limit(2).collect()] if mixed is not None else []
    return _messages(df, found)


def _place(order: str, kind: T.DataType) -> Column:
    c = F.col(f"`{order}`")
    number = c if isinstance(kind, T.NumericType) else F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c.cast("timestamp"))
    return F.coalesce(number.cast("double"), F.lit(-math.inf))


def _number(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return F.when(v == 0, 0.0).otherwise(v)


def _hash(kind: T.DataType, c: str) -> Column:
    v = F.col(f"`{c}`")
    return F.when(v.isNotNull(), F.xxhash64(v.cast("string") if isinstance(kind, T.MapType) else v))


def _sums(df: DataFrame, names: list[str], numbers: list[str], texts: list[str], place: Column | None, pattern: str) -> DataFrame:
    """c, a, n, again, lo, hi, first, last: by column and class of its values (leading bits, summary or not, null if missing). Columns past the last are the places of known texts."""
    none = F.lit(None).cast("double")

    def cell(c: int, a: Column | int, v: Column = none, b: Column | int = 0, h: Column | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(c).alias("c"), lit(a).cast("long").alias("a"), lit(b).cast("long").alias("b"), v.alias("v"), (F.lit(None).cast("long") if h is None else h).alias("h"))

    cells = []
    for i, c in enumerate(names):
        kind, here = df.schema[c].dataType, F.col(f"`{c}`").isNotNull()
        a = F.when(here, F.when(F.col(f"`{c}`").rlike(pattern), 1).otherwise(0)) if isinstance(kind, T.StringType) else F.when(here, 0)
        cells.append(cell(i, a, _number(c) if c in numbers else none, h=_hash(kind, c)))
        if place is not None and c in texts:
            cells.append(F.when(here, cell(len(names) + i, 0, F.when(place == 0, 0.0).otherwise(place))))
    # nulls leave a hash as it is, so where they are is hashed too
    gaps = [F.col(f"`{c}`").isNull() for c in names]
    values = [F.col(f"`{c}`").cast("string") if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in names]
    cells.append(cell(ROW, F.xxhash64(*gaps, *values), b=F.xxhash64(F.lit(1), *values, *gaps)))
    rows = df.select(F.inline(F.array_compact(F.array(*cells))))
    rows = rows.withColumn("a", F.when(F.col("v").isNotNull(), F.shiftright(ordered_bits(F.col("v")), 64 - BITS)).otherwise(F.col("a")))
    ends = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("h").alias("first"), F.max("h").alias("last")]
    rows = rows.groupBy("c", "a", "b").agg(F.count("*").alias("n"), *ends)
    # rows are counted in the task that has them; only sums go on
    rows = rows.withColumn("a", F.when(F.col("c") != ROW, F.col("a"))).withColumn("again", F.col("n") - 1)
    return rows.groupBy("c", "a").agg(F.sum("n").alias("n"), F.sum("again").alias("again"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"))


def _placed(sums: DataFrame) -> DataFrame:
    """Buckets of numbers with the values before them and in all; at most 2^16 a column."""
    by = Window.partitionBy("c")
    before = F.sum("n").over(by.orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    return sums.filter("lo IS NOT NULL").select("c", "n", "lo", "hi", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(by).alias("total"))


def _ranges(sums: DataFrame, names: list[str], numbers: list[str]) -> dict[str, list]:
    if not numbers:
        return {}
    at = [F.lit(s) * (F.col("total") - 1) for s in SHARES]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    hit = F.filter(ranks, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    out: dict[str, list] = {}
    for r in _placed(sums).filter(F.col("c").isin([names.index(c) for c in numbers])).select("*", hit.alias("ranks")).filter("size(ranks) > 0").collect():
        out.setdefault(names[r["c"]], []).append(r)
    return out


def _numbers(c: str, rows: list, factor: float) -> Numbers:
    it = Numbers(rows[0]["total"], {k: ((r["lo"], r["hi"]), r["before"]) for r in rows for k in r["ranks"]})
    a, b = ([it.quartile(s, lambda k, e=e: it.ranks[k][0][e]) for e in (0, 1)] for s in (SHARES[0], SHARES[2]))
    it.judged = it.n >= 4 and not any(map(math.isnan, a + b))
    ends = [f(x, y) for x in a for y in b for f in (lambda p, q: p - factor * (q - p), lambda p, q: q + factor * (q - p))]
    if all(map(math.isfinite, ends)):
        low = (a[0] - factor * (b[1] - a[0]), a[1] - factor * (b[0] - a[1]))
        high = (b[0] + factor * (b[0] - a[1]), b[1] + factor * (b[1] - a[0]))
        # more than what rounding can make of it
        slack = 1e-9 * max(map(abs, [*ends, *a, *b]))
        # to the edges of buckets outside, so that all other buckets are beyond as a whole or not at all
        it.low, it.high = (_edge(low[0] - slack, 0), low[1] + slack), (high[0] - slack, _edge(high[1] + slack, 1))
    return it


def _edge(x: float, end: int) -> float:
    """The least (end 0) or largest number of x's bucket."""
    if not math.isfinite(x):
        return x
    size = 64 - BITS
    bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1)
    bits = (bits >> size << size) + (2 ** size - 1 if end else 0)
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(bits)))[0], bits)


def _first_places(sums: DataFrame, names: list[str], texts: list[str]) -> dict[str, float]:
    """For each text column a place that its first known values do not exceed."""
    found = _placed(sums).filter((F.col("c") >= len(names)) & (F.col("before") < FIRST)).groupBy("c").agg(F.max("hi").alias("hi")).collect()
    return {names[r["c"] - len(names)]: r["hi"] for r in found}


def _open_quartiles(it: Numbers) -> list[Range]:
    """Ranges of ranks of which only a bucket is known; none where no limits are asked for."""
    return list(dict.fromkeys(r for r, _ in it.ranks.values() if r[0] != r[1])) if it.judged else []


def _within(v: Column, r: Range) -> Column:
    # NaN is above all numbers, infinity included
    return (v >= r[0]) & (v <= r[1] if r[1] != math.inf else F.lit(True))


def _opened(df: DataFrame, names: list[str], of: dict[str, Numbers], firsts: dict[str, float], order: str | None, place: Column | None) -> DataFrame:
    """c, v, s, o: the numbers inside open ranges, and the text values up to the places with their order."""
    kind = df.schema[order].dataType if place is not None else T.LongType()
    cell = lambda c, v=None, s=None, o=None: F.struct(F.lit(c).alias("c"), *[(F.lit(None) if x is None else x).cast(t).alias(n) for n, x, t in (("v", v, "double"), ("s", s, "string"), ("o", o, kind))])
    cells = []
    for i, c in enumerate(names):
        if c in of and of[c].judged:
            inside = F.lit(False)
            for r in (*_open_quartiles(of[c]), of[c].low, of[c].high):
                inside = inside | _within(_number(c), r)
            cells.append(F.when(inside, cell(i, v=_number(c))))
        if c in firsts:
            cells.append(F.when(F.col(f"`{c}`").isNotNull() & (place <= firsts[c]), cell(i, s=F.col(f"`{c}`"), o=F.col(f"`{order}`"))))
    # without anything open no row of the table is read
    return df.select(F.inline(F.array_compact(F.array(*cells)))) if cells else df.sparkSession.createDataFrame([], T.StructType([T.StructField("c", T.IntegerType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("o", kind)]))


def _outliers(sums: DataFrame, opened: DataFrame, names: list[str], of: dict[str, Numbers], factor: float) -> dict[str, int]:
    """column -> values beyond the exact limits: those of whole buckets by the histogram, others by the saved values."""
    values = opened.filter("v IS NOT NULL")
    # ranks inside a range: one group a range, its ranks as the positions of one array
    ranges = [(names.index(c), r) for c, it in of.items() for r in _open_quartiles(it)]
    exact: dict[tuple[str, int], float] = {}
    if ranges:
        inner = [sorted({k - before for k, (x, before) in of[names[i]].ranks.items() if x == r}) for i, r in ranges]
        tag = F.array_compact(F.array(*[F.when((F.col("c") == i) & _within(F.col("v"), r), F.lit(g)) for g, (i, r) in enumerate(ranges)]))
        places = F.array(*[F.array(*[F.lit(k).cast("long") for k in (ks * 6)[:6]]) for ks in inner])
        rows = quantiles(values.select(F.explode(tag).alias("g"), "v"), ["v"], tuple(F.get(F.get(places, F.col("g0")), F.lit(j)) for j in range(6)), ["g"]).collect()
        for row in rows:
            i, r = ranges[row["g"]]
            at = dict(zip((inner[row["g"]] * 6)[:6], row["q"]))
            exact |= {(names[i], k): at[k - before] for k, (x, before) in of[names[i]].ranks.items() if x == r}
    limits = {}
    for c, it in of.items():
        a, b = (it.quartile(s, lambda k: exact.get((c, k), it.ranks[k][0][0])) for s in (SHARES[0], SHARES[2]))
        if it.judged and b - a > 0:
            limits[c] = (a - factor * (b - a), b + factor * (b - a))
    if not limits:
        return {}
    sure, some = F.lit(False), F.lit(False)
    for c, (low, high) in limits.items():
        it, here = of[c], F.col("c") == names.index(c)
        v = F.col("v")
        some = some | (here & (_within(v, it.low) | _within(v, it.high)) & ((v < low) | (v > high)))
        sure = sure | (here & ((F.col("hi") < it.low[0]) | ((F.col("lo") > it.high[1]) & F.lit(it.high[1] != math.inf))))
    counts = values.filter(some).groupBy("c").agg(F.count("*").alias("n")).unionAll(sums.filter("lo IS NOT NULL").filter(sure).groupBy("c").agg(F.sum("n").alias("n")))
    out = dict.fromkeys(limits, 0)
    for r in counts.collect():
        out[names[r["c"]]] += r["n"]
    return out


def _mixed(opened: DataFrame, names: list[str]) -> DataFrame:
    first = opened.filter("s IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("o"))).filter(F.col("k") <= FIRST)
    shares = first.groupBy("c").agg(F.count("*").alias("n"), F.avg(to_number(F.col("s")).isNotNull().cast("double")).alias("share"))
    return shares.filter("n >= 4 and share > 0.3 and share < 0.7").select(F.get(F.array(*map(F.lit, names)), F.col("c")).alias("column"), "n", "share")


def _percent(part: int, n: int) -> float:
    """With two decimals, halves up."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(part * 100 / n)).quantize(Decimal("0.01"), ROUND_HALF_UP)) if n else 0.0


def _messages(df: DataFrame, found: list[tuple[str, str | None, float]]) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(r, c, float(v)) for r, c, v in found], "rule string, column string, value double")
    whole, say = F.col("value").cast("long"), F.format_string
    return rows.withColumn("message", F.when(F.col("rule") == "missing", say("%s: %.1f%% missing", "column", "value")).when(F.col("rule") == "duplicates", say("%d repeated rows", whole)).when(
        F.col("rule") == "summary_rows", say("%d summary rows", whole)).when(F.col("rule") == "constant", say("%s: one value only", "column")).when(F.col("rule") == "outliers", say("%s: %d outliers", "column", whole)).otherwise(say("%s: text and numbers", "column")))
