"""One query for each operator over the given tables, and the SQL that says the same."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate as A, charts as C, combine as J, filters as O, grid as N, profiles as PR, quality as Q, select as P, text as X
from ..operators.diagnosis import diagnosis
from ..sources import tables as S
from ..functions.folders import shared_dir
from . import pipeline as D

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (read) as a query; read(name) gives a table."""
    def keep(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            _SQL[name] = sql
        return f
    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    large = O.filter_rows(lines, "l_quantity", "gte", 40)
    return A.aggregate(large, ["l_returnflag"], [{"column": "l_extendedprice", "func": "sum"}, {"column": "l_extendedprice", "func": "mean"}], largest_first=True)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *columns: str, to: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), to) for c in columns})


# ---- sources ----
def _by_status(read) -> dict[str, DataFrame]:
    orders = read("orders")
    return {s: orders.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderstatus AS source FROM orders WHERE o_orderstatus IN ('F', 'O')")
def s2_load(r):
    return S.load(_by_status(r), ["F", "O"]).select("o_orderkey", "o_orderstatus", "o_totalprice", "source")


@query("""SELECT o_orderstatus AS source, count(*)::BIGINT AS rows, 5::BIGINT AS columns, 0::BIGINT AS missing,
  'o_orderkey:bigint, o_custkey:bigint, o_totalprice:double, o_orderdate:timestamp_ntz, o_orderpriority:string' AS types FROM orders GROUP BY 1""")
def s4_inventory(r):
    out = S.inventory(r("orders"), "o_orderstatus").withColumnRenamed("o_orderstatus", "source")
    return out.withColumn("types", F.regexp_replace("types", "timestamp(_ntz)?", "timestamp_ntz"))


def _dealt(t: DataFrame, key: str) -> DataFrame:
    """t by key over as many tasks, and so files, as it takes to scan it, at least three: what one task gets does not grow with t."""
    return t.repartition(max(3, t.rdd.getNumPartitions()), key)


def _copied(r, format: str) -> str:
    """The orders in files of a format, in a folder of their own."""
    orders = r("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = f"{shared_dir(orders.sparkSession)}/tabwork-orders-{uuid.uuid4().hex}"
    S.save(_dealt(orders, "o_orderkey"), path, format)
    return path


_ORDERS = "o_orderkey long, o_orderstatus string, o_totalprice double"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s1_read_csv(r):
    return S.read_csv(r("orders").sparkSession, _copied(r, "csv"), _ORDERS).drop("source", "_row_id")


@query("SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS numbers FROM orders")
def s1_row_numbers(r):
    """Rows of a file are numbered from 1 without gaps."""
    files = S.read_csv(r("orders").sparkSession, _copied(r, "csv"), _ORDERS).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("_row_id").alias("d"), F.max("_row_id").alias("m"), F.min("_row_id").alias("l"))
    return files.agg(F.sum("n").alias("rows"), F.sum(F.when((F.col("d") == F.col("m")) & (F.col("l") == 1), F.col("d"))).alias("numbers"))


def _quoted_csv(r) -> str:
    """The documents as CSV: texts with line breaks, commas and quotes, quotes doubled."""
    docs = r("documents").select("doc_id", F.concat(F.lit('a "b",\n'), F.coalesce("text", F.lit(""))).alias("text"), "n_chars")
    path = f"{shared_dir(docs.sparkSession)}/tabwork-documents-{uuid.uuid4().hex}"
    _dealt(docs, "doc_id").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("""SELECT doc_id, md5('a "b",' || chr(10) || coalesce(text, '')) AS digest, n_chars FROM documents""")
def s1_quoted_line_breaks(r):
    return S.read_csv(r("documents").sparkSession, _quoted_csv(r)).select("doc_id", F.md5("text").alias("digest"), F.col("n_chars").cast("long").alias("n_chars"))


def _layouts(r) -> str:
    """Three files of different columns in a folder: nations, regions, and the customers' segments with gaps."""
    path = f"{shared_dir(r('nation').sparkSession)}/tabwork-layouts-{uuid.uuid4().hex}"
    c = r("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("amount"))
    tables = {"nation": r("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "region": r("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("amount"), F.lit(None).cast("string").alias("empty")), "customer": c}
    for name, t in tables.items():
        t.withColumn("kind", F.lit(name)).repartition(1).write.partitionBy("kind").mode("append").option("header", True).csv(path)
    return path


@query("""SELECT 25::BIGINT AS rows, 2::BIGINT AS columns, 0::BIGINT AS missing, 'id:bigint, name:string' AS types, 'id:0, name:0' AS missing_by_column WHERE (SELECT count(*) FROM nation) = 25
UNION ALL SELECT count(*)::BIGINT, 3, count(*)::BIGINT, 'id:bigint, amount:string, empty:void', 'id:0, amount:0, empty:' || count(*) FROM region
UNION ALL SELECT count(*)::BIGINT, 3, (count(*) FILTER (c_custkey % 3 <> 0) + count(*) FILTER (c_custkey % 4 = 0))::BIGINT, 'id:bigint, segment:string, amount:double',
  'id:0, segment:' || count(*) FILTER (c_custkey % 3 <> 0) || ', amount:' || count(*) FILTER (c_custkey % 4 = 0) FROM customer""")
def s4_file_info(r):
    """Files of different columns in one inventory."""
    return S.file_info(r("nation").sparkSession, _layouts(r) + "/*/*.csv").select("rows", "columns", "missing", "types", "missing_by_column")


@query("""SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL AS amount, NULL AS segment FROM nation UNION ALL SELECT r_regionkey, NULL, r_name, NULL FROM region
UNION ALL SELECT c_custkey, NULL, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal::VARCHAR END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END FROM customer""")
def s2_load_layouts(r):
    """Files of different columns as one table; amounts are texts in one file and so in the table."""
    return S.load_files(r("nation").sparkSession, _layouts(r) + "/*/*.csv").select("id", "name", "amount", "segment")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s5_save(r):
    return r("orders").sparkSession.read.schema(_ORDERS).json(_copied(r, "json"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 10")
def s6_preview(r):
    return S.preview(r("customer").select("c_custkey", "c_name", "c_mktsegment").withColumn("k", F.col("c_custkey")), "k").drop("k")


@query("SELECT o_orderstatus, o_orderkey::VARCHAR AS o_orderkey, substr(o_orderpriority, 1, 30) AS o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2")
def s7_head_sample(r):
    t = r("orders").select("o_orderstatus", "o_orderkey", "o_orderpriority")
    return S.head_sample(t, "o_orderstatus", "o_orderkey")


# ---- columns ----
@query("SELECT p_partkey, p_brand FROM part")
def p1_select(r):
    return P.select(r("part"), ["p_partkey", "p_brand"])


for _n, _op, _l, _r, _e in (
    ("p2_add", "add", "l_extendedprice", "l_tax", "l_extendedprice + l_tax"), ("p3_subtract", "subtract", "l_extendedprice", "l_discount", "l_extendedprice - l_discount"),
    ("p4_multiply", "multiply", "l_extendedprice", "l_discount", "l_extendedprice * l_discount"), ("p5_divide", "divide", "l_extendedprice", "l_tax", "CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END"),
    ("p6_abs_diff", "abs_diff", "l_quantity", "l_discount", "abs(l_quantity - l_discount)"), ("p7_percent", "percent", "l_tax", "l_discount", "CASE WHEN l_discount <> 0 THEN l_tax / l_discount * 100 END"),
):
    def _make(r, op=_op, l=_l, rr=_r):
        return rounded(P.calculate(r("lineitem"), l, op, rr, "x"), "x").select("l_orderkey", "l_linenumber", "l_partkey", "x")
    _make.__name__ = _n
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({_e}, 4) AS x FROM lineitem")(_make)


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month FROM orders")
def p8_split_date(r):
    return P.split_date(r("orders"), "o_orderdate").select("o_orderkey", "o_orderdate_year", "o_orderdate_month")


# ---- filters ----
for _n, _table, _key, _args, _where in (
    ("f1_gte", "part", "p_partkey", dict(column="p_size", operator="gte", value=40), "p_size >= 40"), ("f2_lte", "part", "p_partkey", dict(column="p_size", operator="lte", value=5), "p_size <= 5"),
    ("f3_gt", "orders", "o_orderkey", dict(column="o_totalprice", operator="gt", value=300000), "o_totalprice > 300000"), ("f4_lt", "orders", "o_orderkey", dict(column="o_totalprice", operator="lt", value=20000), "o_totalprice < 20000"),
    ("f5_eq", "customer", "c_custkey", dict(column="c_mktsegment", operator="eq", value="BUILDING"), "c_mktsegment = 'BUILDING'"), ("f6_neq", "customer", "c_custkey", dict(column="c_mktsegment", operator="neq", value="BUILDING"), "c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    ("f7_contains", "part", "p_partkey", dict(column="p_size", operator="contains", value="4"), "contains(p_size::VARCHAR, '4')"), ("f8_not_contains", "part", "p_partkey", dict(column="p_brand", operator="not_contains", value="1"), "NOT coalesce(contains(p_brand, '1'), false)"),
    ("f9_isna", "events", "event_id", dict(column="value", operator="isna"), "value IS NULL"), ("f10_notna", "events", "event_id", dict(column="value", operator="notna"), "value IS NOT NULL"),
    ("f11_in_range", "part", "p_partkey", dict(column="p_size", operator="in_range", value=10, value_max=20), "p_size BETWEEN 10 AND 20"), ("f12_col_gt", "part", "p_partkey", dict(column="p_size", operator="col_gt", compare_column="p_partkey"), "p_size > p_partkey"),
    ("f13_col_lt", "part", "p_partkey", dict(column="p_size", operator="col_lt", compare_column="p_partkey"), "p_size < p_partkey"), ("f14_col_eq", "part", "p_partkey", dict(column="p_size", operator="col_eq", compare_column="p_partkey"), "p_size = p_partkey"),
    ("f23_isin", "customer", "c_custkey", dict(column="c_mktsegment", operator="isin", value=["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
):
    def _make(r, table=_table, key=_key, args=_args):
        return O.filter_rows(r(table), **args).select(key)
    _make.__name__ = _n
    query(f"SELECT {_key} FROM {_table} WHERE {_where}")(_make)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def f15_top_n(r):
    return O.filter_rows(r("orders"), "o_totalprice", "top_n", n=20, order="o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def f16_bottom_n(r):
    return O.filter_rows(r("orders"), "o_totalprice", "bottom_n", n=20, order="o_orderkey").select("o_orderkey", "o_totalprice")


_REGIONS = "SELECT c.c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS nation FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey"


def _gaps(r):
    return r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("nation"))


@query(f"SELECT c_custkey, nation FROM ({_REGIONS}) WHERE nation IS NOT NULL")
def f17_drop_missing(r):
    return O.drop_missing(_gaps(r))


@query(f"SELECT c_custkey, nation FROM ({_REGIONS}) WHERE nation IS NULL OR trim(nation) IN ('', 'nan', 'None')")
def f18_blank(r):
    return O.blank(_gaps(r), "nation")


@query("SELECT p_partkey, p_type FROM part WHERE CASE WHEN (SELECT bool_or(p_type = 'STEEL') FROM part) THEN p_type = 'STEEL' WHEN (SELECT bool_or(contains(p_type, 'STEEL')) FROM part) THEN contains(p_type, 'STEEL') ELSE true END")
def f19_equal_or_like(r):
    return O.equal_or_like(r("part"), "p_type", "STEEL").select("p_partkey", "p_type")


for _n, _span, _where in (
    ("f20_date_range", (dt.date(1996, 3, 1), dt.date(1996, 9, 15)), "o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-09-15'"),
    ("f21_from_month", O.months((1997, 5)), "o_orderdate >= DATE '1997-05-01'"), ("f21_month_to_month", O.months((1996, 11), (1997, 2)), "o_orderdate >= DATE '1996-11-01' AND o_orderdate < DATE '1997-03-01'"),
    ("f21_upto_day", O.days(None, "1995-12-31"), "o_orderdate < DATE '1996-01-01'"),
    ("f22_last_year", O.relative("last_year", dt.date(1997, 6, 30)), "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"), ("f22_last_month", O.relative("last_month", dt.date(1997, 1, 15)), "o_orderdate >= DATE '1996-12-01' AND o_orderdate < DATE '1997-01-01'"),
    ("f22_this_year", O.relative("this_year", dt.date(1996, 2, 29)), "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"), ("f22_this_month", O.relative("this_month", dt.date(1996, 12, 31)), "o_orderdate >= DATE '1996-12-01' AND o_orderdate < DATE '1997-01-01'"),
    ("f22_quarter", O.relative("quarter", dt.date(1996, 1, 1), 4), "o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'"),
):
    def _make(r, span=_span):
        return O.date_range(r("orders"), "o_orderdate", *span).select("o_orderkey")
    _make.__name__ = _n
    query(f"SELECT o_orderkey FROM orders WHERE {_where}")(_make)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01'")
def f24_date_column_by_name(r):
    """Dates as text: of two columns that parse the one whose name says so; one whose name does but that holds no dates is passed over."""
    t = r("orders").select("o_orderkey", F.lit("2001-01-01").alias("holiday_name"), F.lit("none").alias("기간"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("주문일자"))
    return O.date_range(t, O.date_column(t), dt.date(1997, 1, 1)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01'")
def f24_date_column_by_value(r):
    t = r("orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("x"))
    return O.date_range(t, O.date_column(t), dt.date(1997, 1, 1)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01'")
def f24_date_column(r):
    t = r("orders")
    return O.date_range(t, O.date_column(t), dt.date(1997, 1, 1)).select("o_orderkey")


# ---- sorts ----
@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def o1_sort(r):
    return O.sort(r("customer"), "c_acctbal", "desc").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC")
def o2_sort_many(r):
    return O.sort(r("customer"), [("c_mktsegment", "asc"), ("c_acctbal", "desc")]).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal")
def o3_filter_then_sort(r):
    return O.sort(O.filter_rows(r("customer"), "c_acctbal", "gt", 5000), "c_acctbal").select("c_custkey")


# ---- aggregation ----
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, count(l_tax)::BIGINT AS l_tax_count FROM lineitem GROUP BY ALL")
def a1_group(r):
    out = A.aggregate(r("lineitem"), ["l_returnflag", "l_linestatus"], [{"column": "l_quantity", "func": "sum"}, {"column": "l_tax", "agg": "count"}])
    return rounded(out, "l_quantity_sum", to=2)


@query("SELECT c_mktsegment, max(c_custkey) AS c_custkey_max, max(c_nationkey) AS c_nationkey_max, max(c_acctbal) AS c_acctbal_max FROM customer GROUP BY 1")
def a2_all_numeric(r):
    return A.aggregate(r("customer"), ["c_mktsegment"], func="max")


for _n, _f, _e in (("a3_sum", "sum", "coalesce(sum(l_extendedprice), 0)"), ("a4_mean", "mean", "avg(l_extendedprice)"), ("a5_max", "max", "max(l_extendedprice)"), ("a6_min", "min", "min(l_extendedprice)"),
                   ("a7_count", "count", "count(l_extendedprice)::BIGINT"), ("a8_median", "median", "median(l_extendedprice)"), ("a9_std", "std", "stddev_samp(l_extendedprice)")):
    def _make(r, f=_f):
        return A.aggregate(r("lineitem"), ["l_returnflag"], [{"column": "l_extendedprice", "func": f}]).select("l_returnflag", F.round(F.col(f"l_extendedprice_{f}").cast("double"), 3).alias("x"))
    _make.__name__ = _n
    query(f"SELECT l_returnflag, round(({_e})::DOUBLE, 3) AS x FROM lineitem GROUP BY 1")(_make)


@query("SELECT round(sum(o_totalprice), 2) AS o_totalprice_sum, min(o_totalprice) AS o_totalprice_min FROM orders")
def a10_global(r):
    return rounded(A.aggregate(r("orders"), metrics=[{"column": "o_totalprice", "func": "sum"}, {"column": "o_totalprice", "func": "min"}]), "o_totalprice_sum", to=2)


@query("""SELECT 'p_size' AS column, round(sum(p_size), 4)::DOUBLE AS sum, round(avg(p_size), 4) AS mean, max(p_size)::DOUBLE AS max, min(p_size)::DOUBLE AS min FROM part
UNION ALL SELECT 'p_retailprice', round(round(sum(p_retailprice), 4), 2), round(avg(p_retailprice), 4), max(p_retailprice), min(p_retailprice) FROM part""")
def a11_totals(r):
    return rounded(A.totals(r("part"), columns=["p_size", "p_retailprice"]), "sum", to=2)


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY 1")
def a12_group_largest_first(r):
    return rounded(A.aggregate(r("orders"), ["o_orderpriority"], [{"column": "o_totalprice", "func": "sum"}], largest_first=True), "o_totalprice_sum", to=2)


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 5 GROUP BY 1")
def a13_head_sum(r):
    return rounded(A.head_sum(r("orders"), "o_orderstatus", "o_orderkey", 5, ["o_totalprice"]), "o_totalprice_sum", to=2)


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5 GROUP BY 1")
def a14_top_sum(r):
    return rounded(A.top_sum(r("orders"), "o_orderstatus", "o_totalprice", "o_orderkey"), "o_totalprice_sum", to=2)


@query("SELECT event_type, count(*)::BIGINT AS rows FROM events GROUP BY 1")
def a15_row_count(r):
    return A.row_count(r("events"), "event_type")


@query(f"SELECT count(*) FILTER (nation IS NULL)::BIGINT AS missing FROM ({_REGIONS})")
def a16_missing_cells(r):
    return A.missing_cells(_gaps(r))


# ---- joins and stacking ----
def _nations(r):
    return r("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))


@query("SELECT c_custkey AS id, c_nationkey AS nation, c_name AS name_x, n_name AS name_y FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j1_left_join(r):
    return J.left_join(r("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")), _nations(r), "nation")


@query("SELECT p_brand AS brand, p_size AS size_x, s.size AS size_y, p_partkey AS id FROM part LEFT JOIN (SELECT p_brand, max(p_size) AS size FROM part GROUP BY 1) s USING (p_brand)")
def j2_auto_join(r):
    part = r("part")
    return J.auto_join(part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("id")), part.groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_size").alias("size")))


@query("SELECT o_orderpriority AS k, count(*)::BIGINT AS n, m, s FROM orders JOIN (SELECT o_orderpriority AS k2, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_orderpriority = k2 JOIN (SELECT o_orderpriority AS k3, min(o_totalprice) AS s FROM orders GROUP BY 1) ON o_orderpriority = k3 GROUP BY ALL")
def j3_join_all(r):
    o = r("orders").withColumnRenamed("o_orderpriority", "k").groupBy("k")
    return J.join_all([o.agg(F.count("*").alias("n")), o.agg(F.max("o_totalprice").alias("m")), o.agg(F.min("o_totalprice").alias("s"))], "k")


@query("""WITH o AS (SELECT column_name AS c, row_number() OVER () AS n FROM (DESCRIBE orders)), c AS (SELECT column_name AS c, row_number() OVER () AS n FROM (DESCRIBE customer))
SELECT 'orders' AS first, 'again' AS other, (SELECT string_agg(c, ',' ORDER BY n) FROM o WHERE c <> 'o_orderstatus') AS common, (SELECT (count(*) - 1) / count(*) FROM o) AS ratio, 'o_orderstatus' AS only_first, '' AS only_other
UNION ALL SELECT 'orders', 'customer', '', 0, (SELECT string_agg(c, ',' ORDER BY n) FROM o), (SELECT string_agg(c, ',' ORDER BY n) FROM c)""")
def j4_overlap(r):
    out = J.overlap({"orders": r("orders"), "again": r("orders").drop("o_orderstatus"), "customer": r("customer")})
    return out.withColumns({c: F.array_join(c, ",") for c in ("common", "only_first", "only_other")})


def _codes(r):
    o = r("orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.length("o_orderpriority").cast("long").alias("code"), F.col("o_totalprice").alias("price"))
    return [o.filter("status = 'F'"), o.filter("status <> 'F'")]


_MERGED = "SELECT o_orderpriority AS priority, o_orderstatus AS status, min(length(o_orderpriority))::BIGINT AS code, round(avg(o_totalprice), 3) AS price FROM orders GROUP BY 1, 2"


@query(_MERGED)
def j5_combine(r):
    return rounded(J.combine(_codes(r), ["priority", "status"]), "price", to=3)


@query("""WITH p AS (SELECT r_name AS label, n_name, n_nationkey, contains(lower(r_name), lower(n_name)) OR contains(lower(n_name), lower(r_name)) AS c,
    levenshtein(lower(r_name), lower(n_name)) <= 1 AS d FROM (SELECT r_name FROM region UNION SELECT substr(n_name, 1, length(n_name) - 1) FROM nation), nation)
SELECT label, n_name AS matched FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN c THEN 0 ELSE 1 END, n_nationkey) AS n FROM p WHERE c OR d) WHERE n = 1""")
def j6_match_labels(r):
    labels = r("region").select(F.col("r_name").alias("label")).union(r("nation").select(F.expr("substr(n_name, 1, length(n_name) - 1)")))
    return J.match_labels(labels, r("nation"), "label", "n_name", "n_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def u1_stack_common(r):
    t = _by_status(r)
    return J.stack([t["F"].select("o_orderkey", "o_totalprice", "o_custkey"), t["O"].select("o_orderkey", "o_totalprice", "o_orderstatus")], True)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def u2_stack_all(r):
    t = _by_status(r)
    return J.stack([t["F"].select("o_orderkey", "o_custkey"), t["O"].select("o_orderkey", "o_totalprice")])


@query(_MERGED)
def u3_merge_same_layout(r):
    return rounded(J.merge_same_layout(_codes(r), ["priority", "status"]), "price", to=3)


@query("SELECT o_orderpriority AS priority, sum(length(o_orderpriority))::BIGINT AS code, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1")
def u4_stack_by(r):
    return rounded(J.stack_by(_codes(r), ["priority"]), "price", to=2)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def u5_first_of(r):
    return J.first_of(r("events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query(_MERGED)
def u3_merge_same_layout_default(r):
    """Without keys: all text columns are keys."""
    return rounded(J.merge_same_layout(_codes(r)), "price", to=3)


@query("SELECT c_custkey AS id, c_mktsegment AS segment_x, c_name AS name, n AS n, segment AS segment_y FROM customer JOIN (SELECT c_name AS k, c_custkey % 5 AS n, 'none' AS segment FROM customer) ON c_name = k")
def j2_auto_join_two_keys(r):
    """Two columns in common: the one with more distinct values is the key."""
    c = r("customer")
    left = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return J.auto_join(left, c.select(F.lit("none").alias("segment"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5).alias("n")))


@query("SELECT c_custkey::VARCHAR AS id_x, c_name AS name, CASE WHEN c_custkey <> 2 THEN c_custkey::VARCHAR ELSE '1' END AS id_y FROM customer")
def j2_auto_join_close_keys(r):
    """Two keys that differ in one value of all: counted exactly, where sketches cannot tell."""
    c = r("customer").select(F.when(F.col("c_custkey") != 2, F.col("c_custkey")).otherwise(1).cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("own"))
    return J.auto_join(c, c.select("id", "name")).select(F.col("own").alias("id_x"), "name", "id_y")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j5_combine_join(r):
    """Tables of different layouts are joined on their common column."""
    return J.combine([r("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), r("region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("region_name"))])


# ---- grids ----
@query("SELECT o_orderkey, length(o_orderpriority)::DOUBLE AS a, o_totalprice FROM orders")
def n5_text_to_number(r):
    return N.text_to_number(r("orders").select("o_orderkey", F.length("o_orderpriority").cast("string").alias("a"), "o_totalprice"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity::BIGINT AS l_quantity, l_tax FROM lineitem")
def n6_whole_to_long(r):
    return N.whole_to_long(r("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax"))


@query("SELECT count(*)::BIGINT AS rows FROM customer WHERE c_mktsegment NOT IN ('BUILDING')")
def n4_drop_subtotals(r):
    return A.row_count(N.drop_subtotals(r("customer"), ("BUILDING",)))


def _cells(r):
    """The events as a grid: a sheet per type, a row per event, three columns."""
    e = r("events").select(F.col("event_type").alias("file"), F.lit("s").alias("sheet"), (F.col("event_id") + 1).cast("int").alias("row"), "event_id", "value", "user_id")
    return e.select("file", "sheet", "row", F.inline(F.expr("array(struct(1 as col, cast(event_id as string) as value), struct(2 as col, cast(user_id as string) as value), struct(3 as col, case when value > 0.5 then cast(value as string) else ' ' end as value))")))


@query("""SELECT event_type AS file, 's' AS sheet, min(event_id + 1)::INTEGER AS first_row, max(event_id + 1)::INTEGER AS last_row, 1 AS first_col, 3 AS last_col, count(DISTINCT event_id)::BIGINT AS data_rows,
  (2 + max(CASE WHEN value > 0.5 THEN 1 ELSE 0 END))::BIGINT AS data_cols, (2 * count(*) + count(*) FILTER (value > 0.5))::BIGINT AS filled_cells,
  ((max(event_id) - min(event_id) + 1) * 3)::INTEGER AS total_cells, round((2 * count(*) + count(*) FILTER (value > 0.5)) / ((max(event_id) - min(event_id) + 1) * 3), 3) AS density FROM events GROUP BY 1""")
def n8_used_range(r):
    return N.used_range(_cells(r))


@query("""WITH c AS (SELECT event_type AS source, (event_id + 1)::INTEGER AS row, dense_rank() OVER (PARTITION BY event_type ORDER BY event_id) AS k,
    2 + (value > 0.5)::INT AS f, (event_id % 3 = 0)::INT AS t FROM events)
SELECT source, max_by(row, (round(0.6 * f / 3 + 0.4 * t / f, 9), -row)) AS header_row FROM c WHERE k <= 15 GROUP BY 1""")
def n1_header_row(r):
    cells = _cells(r).withColumnRenamed("file", "source")
    return N.header_row(cells.withColumn("value", F.when((F.col("col") == 1) & ((F.col("row") - 1) % 3 == 0), F.concat(F.lit("name "), "value")).otherwise(F.col("value"))))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS a, CASE WHEN event_id % 2 = 0 THEN event_type END AS o FROM events)
SELECT user_id, event_id, last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS anchor,
  coalesce(o, CASE WHEN a IS NULL THEN last_value(o IGNORE NULLS) OVER (PARTITION BY user_id, a IS NULL ORDER BY event_id) END) AS other FROM e""")
def n3_fill_down(r):
    e = r("events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("anchor"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("other"))
    return N.fill_down(e, "user_id", "event_id", "anchor", ["other"])


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS a, CASE WHEN event_id % 2 = 0 THEN event_type END AS o FROM events),
g AS (SELECT *, count(a) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e)
SELECT user_id, event_id, last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS anchor, last_value(o IGNORE NULLS) OVER (PARTITION BY user_id, k ORDER BY event_id) AS other FROM g""")
def n3_fill_down_groups(r):
    e = r("events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("anchor"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("other"))
    return N.fill_down(e, "user_id", "event_id", "anchor", ["other"], within_group=True)


# ---- grids with the operators' own labels ----
_LABELS = ("소계", "소 계", " 합  계\t", "총 계", "내부흡수액", "계", "총계(원)", "Total 2020", "Zwischensumme", "plain", "a total of", "합", "\t", " \u3000")
_LABELLED = "(SELECT c_custkey, [" + ", ".join("'" + x + "'" for x in _LABELS) + f"][1 + c_custkey % {len(_LABELS)}] AS label FROM customer)"


def _labelled(r):
    return r("customer").select("c_custkey", F.get(F.array(*map(F.lit, _LABELS)), (F.col("c_custkey") % len(_LABELS)).cast("int")).alias("label"))


@query(f"SELECT c_custkey, label FROM {_LABELLED} WHERE c_custkey % {len(_LABELS)} > 5")
def n4_drop_subtotals_default(r):
    return N.drop_subtotals(_labelled(r))


@query(f"SELECT c_custkey, label, CASE WHEN c_custkey % 2 = 0 AND c_custkey % {len(_LABELS)} <= 5 THEN trim(label, ' ' || chr(9)) ELSE 'group' END AS anchor FROM {_LABELLED}")
def n4_label_subtotals(r):
    return N.label_subtotals(_labelled(r).withColumn("anchor", F.lit("group")), "anchor", F.col("c_custkey") % 2 == 0)


@query(f"SELECT count(*) FILTER (c_custkey % {len(_LABELS)} IN (0, 1, 5, 6, 7, 8, 10))::BIGINT AS summary_rows FROM {_LABELLED}")
def q5_summary_rows_default(r):
    return Q.summary_rows(_labelled(r))


@query(f"SELECT c_custkey FROM {_LABELLED} WHERE c_custkey % {len(_LABELS)} >= {len(_LABELS) - 2}")
def f18_blank_default(r):
    return O.blank(_labelled(r), "label").select("c_custkey")


@query("""WITH h AS (SELECT p_brand AS source, p_partkey AS col, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS u, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN p_size::VARCHAR ELSE p_type END END AS l FROM part),
f AS (SELECT source, count(l) >= 3 AND (count(*) - count(u) >= 2 OR count(*) FILTER (try_cast(l AS DOUBLE) IS NOT NULL) < 0.3 * count(l)) AS two FROM h GROUP BY 1),
w AS (SELECT *, last_value(u IGNORE NULLS) OVER (PARTITION BY source ORDER BY col) AS p, count(u) OVER (PARTITION BY source ORDER BY col) AS run FROM h JOIN f USING (source)),
n AS (SELECT source, col, CASE WHEN two THEN coalesce(nullif(concat_ws('_', p, l), ''), 'col_' || col) ELSE coalesce(u, p || '_' || (row_number() OVER (PARTITION BY source, run ORDER BY col) - 1), 'col_' || col) END AS name FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY col) - 1 AS again FROM n)
SELECT source, col, CASE WHEN again > 0 THEN name || '_' || again ELSE name END AS name FROM k""")
def n2_header_names(r):
    k = F.col("p_partkey")
    return N.header_names(r("part").select(F.col("p_brand").alias("source"), k.alias("col"), F.when(k % 3 == 0, F.col("p_type")).alias("upper"), F.when(k % 4 != 0, F.when(k % 5 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type"))).alias("lower")))


@query("""SELECT event_type AS source, (event_id + 1)::INTEGER AS row, x.name, x.value FROM (
  SELECT *, min(event_id) OVER (PARTITION BY event_type) AS head FROM events) e, LATERAL (SELECT unnest(['event', 'user']) AS name, unnest([event_id::VARCHAR, user_id::VARCHAR]) AS value) x WHERE event_id > head""")
def n1_named_table(r):
    """The first row of each type holds names, the others their values."""
    cells = _cells(r).withColumnRenamed("file", "source").filter("col < 3")
    head = cells.groupBy("source").agg(F.min("row").alias("head"))
    name = F.when(F.col("col") == 1, "event").otherwise("user")
    return N.named_table(cells.join(head, "source").withColumn("value", F.when(F.col("row") == F.col("head"), name).otherwise(F.col("value"))).drop("head"))


@query("SELECT column_name AS column, CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'key' END AS kind FROM (DESCRIBE orders)")
def n7_column_classes(r):
    return N.column_classes(r("orders"))


# ---- quality ----
@query(f"""SELECT 'c_custkey' AS column, 0::BIGINT AS missing, 0.0::DOUBLE AS missing_percent, count(*)::BIGINT AS data_count FROM customer
UNION ALL SELECT 'nation', (count(*) - count(nation))::BIGINT, round((count(*) - count(nation)) * 100.0 / count(*), 2)::DOUBLE, count(nation)::BIGINT FROM ({_REGIONS})""")
def q1_missing_report(r):
    return rounded(Q.missing_report(_gaps(r)), "missing_percent", to=2)


@query("""SELECT 'p_brand' AS column, 'string' AS kind, count(p_brand)::BIGINT AS data_count, 0::BIGINT AS missing, count(DISTINCT p_brand)::BIGINT AS distinct, min(p_brand) AS min, max(p_brand) AS max FROM part
UNION ALL SELECT 'p_size', 'int', count(p_size)::BIGINT, 0, count(DISTINCT p_size)::BIGINT, min(p_size)::VARCHAR, max(p_size)::VARCHAR FROM part""")
def q2_profile(r):
    return Q.profile(r("part").select("p_brand", "p_size"))


@query(f"SELECT 'nation' AS column, round((count(*) - count(nation)) / count(*), 3) AS rate FROM ({_REGIONS}) HAVING count(nation) < count(*)")
def q3_missing_rates(r):
    return Q.missing_rates(_gaps(r))


@query("SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)))::BIGINT AS duplicates FROM documents")
def q4_duplicate_rows(r):
    return Q.duplicate_rows(r("documents").select("text", "lang"))


@query("SELECT greatest(count(*) FILTER (regexp_matches(c_mktsegment, '^B')), count(*) FILTER (regexp_matches(c_name, '^B')))::BIGINT AS summary_rows FROM customer")
def q5_summary_rows(r):
    return Q.summary_rows(r("customer"), "^B")


def _out(factor: float, outer: str) -> str:
    return f"WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT 'value' AS column, {outer} count(*) FILTER (b > a AND (value < a - {factor} * (b - a) OR value > b + {factor} * (b - a)))::BIGINT AS outliers FROM events, q"


@query(_out(3, "round(any_value(a - 3 * (b - a)), 4) AS low, round(any_value(b + 3 * (b - a)), 4) AS high,"))
def q6_outliers(r):
    return rounded(Q.outliers(r("events"), columns=["value"]), "low", "high")


@query("""WITH v AS (SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE user_id::VARCHAR END AS s FROM events ORDER BY event_id LIMIT 200)
SELECT 's' AS column, count(*)::BIGINT AS n, avg((try_cast(s AS DOUBLE) IS NOT NULL)::INT) AS share FROM v HAVING count(*) >= 4""")
def q7_mixed_types(r):
    return Q.mixed_types(r("events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("s")), "event_id")


@query("SELECT 'one' AS column")
def q8_constants(r):
    return Q.constants(r("part").select("p_partkey", "p_size", F.lit("x").alias("one")))


@query("""WITH l AS (SELECT c_custkey, c_name, ['소계', 'plain', 'a total of', 'x'][1 + c_custkey % 4] AS label FROM customer), n AS (SELECT count(*) AS n FROM customer),
g AS (SELECT count(*) FILTER (c_custkey % 3 = 0) AS k FROM customer), h AS (SELECT count(*) FILTER (label IN ('소계', 'a total of')) AS k FROM l),
m AS (SELECT avg((c_custkey % 2 = 0)::INT) AS s FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 200)),
t AS (SELECT count(*) FILTER (c_custkey % 50 = 0) AS k FROM customer)
SELECT 'missing' AS rule, 'gap' AS column, round((n - k) * 100.0 / n, 2)::DOUBLE AS value, printf('gap: %.1f%% missing', round((n - k) * 100.0 / n, 2)::DOUBLE) AS message FROM n, g
UNION ALL SELECT 'summary_rows', NULL, k::DOUBLE, k || ' summary rows' FROM h
UNION ALL SELECT 'constant', 'one', 1, 'one: one value only'
UNION ALL SELECT 'outliers', 'far', k::DOUBLE, 'far: ' || k || ' outliers' FROM t
UNION ALL SELECT 'mixed', 'm', s, 'm: text and numbers' FROM m""")
def q9_diagnosis(r):
    c, k = r("customer"), F.col("c_custkey")
    return rounded(diagnosis(c.select(
        k, F.when(k % 3 == 0, F.col("c_name")).alias("gap"), F.lit("x").alias("one"), F.get(F.array(*map(F.lit, ("소계", "plain", "a total of", "x"))), (k % 4).cast("int")).alias("label"),
        F.when(k % 50 == 0, 1e9 + k).otherwise(k % 7).alias("far"), F.when(k % 2 == 0, k.cast("string")).otherwise(F.col("c_name")).alias("m")), "c_custkey"), "value")


@query("""WITH o AS (SELECT o_orderpriority, o_totalprice, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS customer FROM orders), f AS (SELECT 'o_orderpriority' AS column, count(o_orderpriority) AS k, count(*) AS n, min(o_orderpriority) AS a, max(o_orderpriority) AS b, count(DISTINCT o_orderpriority) AS d FROM o
UNION ALL SELECT 'customer', count(customer), count(*), min(customer)::VARCHAR, max(customer)::VARCHAR, NULL FROM o UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(*), NULL, NULL, NULL FROM o)
SELECT f."column", k::BIGINT AS data_count, (n - k)::BIGINT AS missing, a AS min, b AS max, d::BIGINT AS "distinct", 0::BIGINT AS summary_rows FROM f""")
def q9_merged_profile(r):
    o = r("orders")
    parts = PR.states(o.select("o_orderpriority", "o_totalprice", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("customer"), "o_orderstatus"), F.col("o_orderstatus"))
    # estimates and decimal texts are left to the tests
    found, double = PR.report(PR.merged(parts.drop("o_orderstatus"))), F.col("kind") == "double"
    return found.select("column", "data_count", "missing", F.when(~double, F.col("min")).alias("min"), F.when(~double, F.col("max")).alias("max"), F.when(F.col("column") == "o_orderpriority", F.col("distinct")).alias("distinct"), "summary_rows")


@query("SELECT o_orderstatus, 'o_totalprice' AS column, round(min(o_totalprice), 2) AS min, round(avg(o_totalprice), 2) AS mean, round(max(o_totalprice), 2) AS max FROM orders GROUP BY 1")
def q10_numeric_stats(r):
    return Q.numeric_stats(r("orders").select("o_orderstatus", "o_totalprice"), "o_orderstatus")


@query("""SELECT 'p_brand' AS column, (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS distinct, p_brand AS value, count(*)::BIGINT AS count, row_number() OVER (ORDER BY count(*) DESC, p_brand)::INTEGER AS rank FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 3""")
def q11_text_stats(r):
    return Q.text_stats(r("part"), ["p_brand"])


@query("""WITH v AS (SELECT unnest(['l_returnflag', 'l_quantity', 'l_suppkey']) AS c, unnest([l_returnflag, l_quantity::VARCHAR, l_suppkey::VARCHAR]) AS value FROM lineitem),
n AS (SELECT c, value, count(*)::BIGINT AS n FROM v GROUP BY ALL)
SELECT c AS column, rank, value, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, value)::INTEGER AS rank FROM n) WHERE rank <= 3""")
def q11_frequent_merged(r):
    """Frequent values from states by line number that keep 40 values each; what is in doubt is counted again."""
    lines = r("lineitem").select("l_linenumber", "l_returnflag", *[F.col(c).cast("string").alias(c) for c in ("l_quantity", "l_suppkey")])
    parts = PR.frequent(lines, F.col("l_linenumber"), ["l_returnflag", "l_quantity", "l_suppkey"], 40)
    return PR.most_frequent_exact(parts, lines)


@query("""SELECT 'p' AS column, least(100, count(*))::BIGINT AS n, 1.0::DOUBLE AS share FROM orders""")
def q12_number_like(r):
    return Q.number_like(r("orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("string").alias("p")), "o_orderkey")


@query("SELECT event_type, count(*)::BIGINT AS rows, 2::BIGINT AS columns, 0::BIGINT AS columns_with_missing, 2::BIGINT AS numeric_columns, 0::BIGINT AS missing FROM events GROUP BY 1")
def q13_compare_sources(r):
    return Q.compare_sources(r("events").select("event_type", "event_id", "value"), "event_type")


@query(f"SELECT unnest(['rows', 'columns', 'columns_with_missing', 'numeric_columns']) AS item, unnest([(SELECT count(*) FROM customer), 2, 1, 1])::BIGINT AS value")
def q14_overview(r):
    return Q.overview(_gaps(r))


@query(_out(1.5, "round(avg(value), 1) AS mean, round(median(value), 1) AS median,"))
def q15_distribution(r):
    return Q.distribution(r("events"), ["value"])


@query(f"SELECT 'missing' AS item, 'nation' AS column, (count(*) - count(nation))::BIGINT AS value FROM ({_REGIONS}) UNION ALL SELECT 'missing_total', NULL, (count(*) - count(nation))::BIGINT FROM ({_REGIONS})")
def q16_structure(r):
    return Q.structure(_gaps(r))


# ---- charts ----
@query("SELECT c_custkey::VARCHAR AS c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, customer.c_custkey LIMIT 15")
def c1_bar(r):
    return C.bar(r("customer"), "c_custkey", ["c_acctbal"])


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice FROM orders")
def c2_line(r):
    return C.line(r("orders"), "o_orderkey", ["o_totalprice"])


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_acctbal, round(c_acctbal * 100 / sum(c_acctbal) OVER (), 1) AS percent FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 8)")
def c3_pie(r):
    return C.pie(r("customer"), "c_custkey", "c_acctbal")


@query("SELECT count(*)::BIGINT AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, min(p_size)::DOUBLE AS x0, max(p_size)::DOUBLE AS x1, round(regr_slope(p_retailprice, p_size) * min(p_size) + regr_intercept(p_retailprice, p_size), 4) AS y0, round(regr_slope(p_retailprice, p_size) * max(p_size) + regr_intercept(p_retailprice, p_size), 4) AS y1 FROM part")
def c4_trend(r):
    return rounded(rounded(C.trend(r("part"), "p_size", "p_retailprice"), "intercept", "y0", "y1"), "slope", to=6)


@query("""WITH f AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders),
w AS (SELECT *, CASE WHEN iqr > 0 THEN least(2 * iqr / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END AS w FROM f),
b AS (SELECT *, greatest(ceil((hi - lo) / w), 1)::BIGINT AS bins FROM w)
SELECT k AS bin, round(any_value(lo + k * ((hi - lo) / bins)), 3) AS start, round(any_value(lo + (k + 1) * ((hi - lo) / bins)), 3) AS end, count(o_totalprice)::BIGINT AS count FROM b, unnest(range(bins)) AS t(k) LEFT JOIN (SELECT o_totalprice, least(floor((o_totalprice - lo) / ((hi - lo) / bins)), bins - 1)::BIGINT AS p FROM orders, b) ON p = k GROUP BY k""")
def c5_histogram(r):
    return rounded(C.histogram(r("orders"), "o_totalprice"), "start", "end", to=3)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_type AS group, count(*)::BIGINT AS n, round(any_value(a), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(b), 4) AS q3, round(min(value) FILTER (value >= a - 1.5 * (b - a)), 4) AS low, round(max(value) FILTER (value <= b + 1.5 * (b - a)), 4) AS high,
  count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::BIGINT AS outliers FROM events JOIN q USING (event_type) GROUP BY 1""")
def c6_box(r):
    return rounded(C.box(r("events"), "value", "event_type"), "q1", "median", "q3", "low", "high")


@query("""WITH v AS (SELECT 'p_size' AS group, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
q AS (SELECT group, quantile_cont(v, 0.25) AS a, median(v) AS m, quantile_cont(v, 0.75) AS b FROM v GROUP BY 1)
SELECT group, count(*)::BIGINT AS n, round(any_value(a), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(b), 4) AS q3, round(min(v) FILTER (v >= a - 1.5 * (b - a)), 4) AS low, round(max(v) FILTER (v <= b + 1.5 * (b - a)), 4) AS high,
  count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a))::BIGINT AS outliers FROM v JOIN q USING (group) GROUP BY 1""".replace("group,", '"group",').replace("AS group", 'AS "group"').replace("USING (group)", 'USING ("group")'))
def c6_box_columns(r):
    return rounded(C.box_columns(r("part"), ["p_size", "p_retailprice"]), "q1", "median", "q3", "low", "high")


_BOXES = _SQL["c6_box_columns"].replace("p_size", "value").replace("'p_retailprice'", "'event_id'").replace("p_retailprice", "event_id").replace("part", "events")


@query(_BOXES)
def c6_box_many_groups(r):
    """More groups than a picture holds: a box per numeric column."""
    return rounded(C.box(r("events").select("user_id", "value", "event_id"), "value", "user_id"), "q1", "median", "q3", "low", "high")


@query("SELECT user_id, round(median(value), 4) AS value_median, count(value)::BIGINT AS value_count, round(median(event_id), 4) AS event_id_median FROM events GROUP BY 1")
def a8_medians_by_user(r):
    """Many groups, two medians and another figure at once."""
    out = A.aggregate(r("events"), ["user_id"], [{"column": "value", "func": "median"}, {"column": "value", "func": "count"}, {"column": "event_id", "func": "median"}])
    return rounded(out, "value_median", "event_id_median")


@query("SELECT p_size, p_retailprice FROM part")
def c4_scatter(r):
    return C.scatter(r("part"), "p_size", "p_retailprice")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY 1")
def c7_category_totals(r):
    return rounded(C.category_totals(r("orders"), "o_orderpriority", "o_totalprice"), "o_totalprice_sum", to=2)


# ---- texts ----
_TF = "tf AS (SELECT item_id, substr(text, i, 2) AS gram, count(*) AS tf FROM benchmark, unnest(range(1, length(text))) AS t(i) GROUP BY ALL), idf AS (SELECT gram, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY gram), raw AS (SELECT item_id, gram, tf * idf AS x FROM tf JOIN idf USING (gram)), w AS (SELECT item_id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM raw)"


@query(f"WITH {_TF} SELECT item_id, gram, round(w, 6) AS w FROM w")
def t1_tfidf(r):
    return rounded(X.tfidf(r("benchmark"), "item_id", "text").select("item_id", "gram", "w"), "w", to=6)


@query(f"""WITH {_TF}, s AS (SELECT a.item_id AS query, b.item_id AS match, sum(a.w * b.w) AS score FROM w a JOIN w b USING (gram) GROUP BY ALL)
SELECT query, rank, match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, match)::INTEGER AS rank FROM s) WHERE rank <= 2""")
def t2_similar_texts(r):
    b = r("benchmark")
    return rounded(X.similar_texts(b, b, "item_id", "text", "item_id", "text"), "score", to=6)


@query("""WITH v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, c.vec_id AS match, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) + CASE WHEN q.label = c.label THEN 0.1 ELSE 0 END AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query, rank, match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, match)::INTEGER AS rank FROM s) WHERE rank <= 2""")
def t3_similar_vectors(r):
    e = r("embeddings")
    return rounded(X.similar_vectors(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 2, "label"), "score", to=6)


@query(_SQL["t3_similar_vectors"].replace(" + CASE WHEN q.label = c.label THEN 0.1 ELSE 0 END", "").replace("rank <= 2", "rank <= 5"))
def t3_similar_vectors_20(r):
    """Five neighbours by cosine alone."""
    e = r("embeddings")
    return rounded(X.similar_vectors(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5), "score", to=6)


@query("""WITH b AS (SELECT min(text) AS text, 'custom_' || substr(md5(text), 1, 8) AS id FROM benchmark GROUP BY 2) SELECT id, text FROM b""")
def t4_append_new_rows(r):
    b = r("benchmark").select("text")
    known = b.filter(F.length("text") % 2 == 0).select(F.concat(F.lit("custom_"), F.substring(F.md5("text"), 1, 8)).alias("id"), "text").dropDuplicates(["id"])
    return X.append_new(known, b, "text").select("id", "text")


@query("SELECT doc_id, source FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 5")
def t4_examples_of(r):
    return X.examples_of(r("documents").select("doc_id", "source"), "source", "src3", "doc_id", 5)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 5")
def t4_examples_of_none(r):
    return X.examples_of(r("documents").select("doc_id", "source"), "source", "no such source", "doc_id", 5)


@query("SELECT count(*)::BIGINT AS rows FROM (SELECT DISTINCT 'custom_' || substr(md5(text), 1, 8) FROM benchmark)")
def t4_append_new(r):
    b = r("benchmark").select("text")
    known = b.filter(F.length("text") % 2 == 0).select(F.concat(F.lit("custom_"), F.substring(F.md5("text"), 1, 8)).alias("id"), "text").dropDuplicates(["id"])
    return A.row_count(X.append_new(known, b, "text"))


@query("""WITH n AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT conv_id, turn, substr(text, 1, 80) AS query, regexp_extract(t2, '(\\w+)', 1) AS code FROM n WHERE role = 'user' AND (contains(lower(text), 'the') OR contains(lower(text), 'und')) AND r2 = 'assistant' AND regexp_matches(t2, '(\\w+)'))
SELECT conv_id, query, code FROM (SELECT *, row_number() OVER (PARTITION BY substr(query, 1, 20) ORDER BY conv_id DESC, turn) AS k FROM f) WHERE k = 1 ORDER BY conv_id DESC, turn LIMIT 5""")
def t5_search_chats(r):
    return X.search_chats(r("conversations"), ["the", "und", "x"], fence=r"(\w+)")


@query("SELECT conv_id, coalesce(min_by(substr(text, 1, 28), turn) FILTER (role = 'user'), 'new') AS title FROM conversations GROUP BY 1")
def t6_chat_list(r):
    return X.chat_list(r("conversations"))


@query("SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations GROUP BY 1")
def t7_markdown(r):
    return X.markdown(r("conversations"))


@query("SELECT conv_id, turn, role, substr(replace(text, chr(10), ' '), 1, 150) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n BETWEEN 2 AND 7")
def t8_recent_context(r):
    return X.recent_context(r("conversations"))


@query("""WITH h AS (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS a, contains(lower(text), 'der')::INT + contains(lower(text), 'und')::INT AS b FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'other' WHEN a = greatest(a, b) THEN 'en' ELSE 'de' END AS intent, greatest(a, b) AS hits FROM h""")
def t9_classify(r):
    return X.classify(r("documents"), "text", {"en": ["the", "and"], "de": ["der", "und"]}, "other").select("doc_id", "intent", "hits")


@query("""SELECT conv_id, turn, role || chr(10) AS code, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS said FROM conversations""")
def t10_code_block(r):
    c = r("conversations").withColumn("text", F.concat("text", F.lit("\n```python\n"), F.col("role"), F.lit("\n```")))
    return X.code_block(c, "text").select("conv_id", "turn", "code", "said")


@query("SELECT CASE event_type WHEN 'error' THEN 'failed' ELSE event_type END AS label, count(*)::BIGINT AS runs FROM events GROUP BY 1")
def l1_runs_per_label(r):
    return X.runs_per_label(r("events"), "event_type", {"error": "failed"})


@query("SELECT user_id, round(avg((event_type <> 'error')::INT), 6) AS success_rate FROM events GROUP BY 1")
def l2_success_rate(r):
    return rounded(X.success_rate(r("events").withColumn("ok", F.col("event_type") != "error"), "ok", "user_id"), "success_rate", to=6)


@query("SELECT user_id, coalesce(string_agg(event_type, ' → ' ORDER BY event_id) FILTER (event_type <> 'error'), '') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 6 GROUP BY 1")
def l3_chains(r):
    return X.chains(r("events").withColumn("ok", F.col("event_type") != "error"), "user_id", "event_id", "event_type", "ok")


@query("SELECT user_id AS run, event_type AS stage, min_by(event_id, event_id)::BIGINT AS duration_ms, any_value(t)::BIGINT AS total_ms FROM events JOIN (SELECT user_id AS u, sum(event_id) AS t FROM events GROUP BY 1) ON u = user_id GROUP BY 1, 2")
def l4_stage_durations(r):
    return X.stage_durations(r("events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.col("event_id").alias("started_at"), F.col("event_id").alias("duration_ms")))


@query("SELECT o_orderpriority, round(sum(o_totalprice - 1000), 2) AS net_sum FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1")
def d1_pipeline(r):
    steps = [{"op": "load", "files": ["F"]}, {"op": "filter", "column": "o_totalprice", "operator": "gt", "value": 1000}, {"op": "calculate", "left": "o_totalprice", "operator": "subtract", "right": 1000, "name": "net"},
             {"op": "aggregate", "group_by": ["o_orderpriority"], "metrics": [{"column": "net", "func": "sum"}]}, {"op": "sort", "column": "net_sum", "direction": "desc"}]
    return rounded(D.run(steps, _by_status(r))[0], "net_sum", to=2)


@query("""SELECT unnest(['load', 'filter', 'aggregate']) AS step, unnest([count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 1000),
  count(DISTINCT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN o_orderpriority END)])::BIGINT AS rows FROM orders""")
def d1_row_counts(r):
    """Rows after each step, counted while the result is worked out."""
    steps = [{"op": "load", "files": ["F"]}, {"op": "filter", "column": "o_totalprice", "operator": "gt", "value": 1000}, {"op": "aggregate", "group_by": ["o_orderpriority"], "metrics": [{"column": "o_totalprice", "func": "sum"}]}]
    out, log = D.run(steps, _by_status(r), counted=True)
    out.write.format("noop").mode("overwrite").save()
    return r("orders").sparkSession.createDataFrame(list(zip([e["step"] for e in log], D.row_counts(log))), "step string, rows long")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'und') OR contains(lower(text), 'mehr') THEN 'union' WHEN contains(lower(text), 'the') THEN 'join' ELSE 'plain' END AS kind FROM documents")
def t9_merge_kind(r):
    return r("documents").select("doc_id", X.merge_kind(F.col("text"), ["und", "mehr"], ["the"]).alias("kind"))


@query("SELECT unnest(['step 2 (sort): no column o_totalpric; similar: [''o_totalprice'']']) AS problem FROM (SELECT 1 FROM orders LIMIT 1)")
def d2_problems(r):
    """What is wrong with a pipeline over the schemas of the given tables."""
    found = D.problems([{"op": "load"}, {"op": "sort", "column": "o_totalpric"}], {"o": r("orders").select("o_totalprice", "o_custkey")})
    return r("orders").sparkSession.createDataFrame([(p,) for p in found], "problem string")
