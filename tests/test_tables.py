"""The rules for missing values, grids and pipelines on small frames; the queries against SQL on the smallest tables."""

import datetime as dt
import glob
import hashlib
import math
import threading
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwork.functions.folders import saved, scratch, shared_dir
from tabwork.functions.rules import one_missing, to_number
from tabwork.operators import aggregate as A, charts as C, combine as J, filters as O, grid as N, profiles as PR, quality as Q, select as P, similar, text as X, vectors
from tabwork.operators.diagnosis import diagnosis
from tabwork.operators.quantiles import ordered_bits, quantile_lists, quantiles
from tabwork.plans import pipeline as D, table_queries
from tabwork.sources import csv_files as CSV, tables as S
from tabwork.streaming import runs as R
from tabwork.streaming.steps import follow, row_steps

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture()
def gaps(spark):
    return one_missing(spark.createDataFrame([(1, 1.0, "a", "k"), (2, math.nan, "", None), (3, None, None, "k"), (4, 5.0, " nan ", "l")], "id long, x double, s string, k string"))


def test_missing_values(gaps):
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(O.filter_rows(gaps, "x", "gt", 0)) == [1, 4]
    assert ids(O.filter_rows(gaps, "x", "neq", 1.0)) == [2, 3, 4]
    assert ids(O.filter_rows(gaps, "s", "not_contains", "a")) == [2, 3]
    assert ids(O.filter_rows(gaps, "x", "isna")) == [2, 3] and ids(O.filter_rows(gaps, "x", "notna")) == [1, 4]
    assert ids(O.blank(gaps, "s")) == [2, 3, 4] and ids(O.drop_missing(gaps)) == [1, 4]
    assert [r["id"] for r in O.sort(gaps, [("x", "desc"), ("id", "asc")]).collect()] == [4, 1, 2, 3]
    assert rows(A.aggregate(gaps, ["k"], [{"column": "x", "func": "sum"}])) == [("k", 1.0), ("l", 5.0)]
    assert A.aggregate(gaps.filter("x is null"), metrics=[{"column": "x", "func": "sum"}]).first()[0] == 0
    assert A.missing_cells(gaps).first()[0] == 4
    assert rows(P.calculate(gaps, "id", "divide", 0, "q").select("q")) == [(None,)] * 4
    with pytest.raises(ValueError):
        P.calculate(gaps, "s", "add", 1, "q")
    assert [tuple(r) for r in Q.missing_report(gaps).filter("missing > 0").collect()] == [("x", 2, 50.0, 2), ("k", 1, 25.0, 3), ("s", 1, 25.0, 3)]


def test_numbers_in_text(spark):
    got = spark.createDataFrame([("1,234",), ("1d",), (" 2 ",), (None,), ("1e3",)], "s string").select(to_number(F.col("s"))).collect()
    assert [r[0] for r in got] == [1234.0, None, 2.0, None, 1000.0]


def test_joins_and_merges(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    assert rows(J.left_join(left, right, "k").select("k", "v_x", "v_y")) == [("a", 1, 10), (None, 2, 20)]
    with pytest.raises(ValueError):
        J.auto_key(left, right.toDF("p", "q"))
    a = spark.createDataFrame([("x", 7, 1.0), ("소계", 7, 100.0)], "name string, code long, v double")
    b = spark.createDataFrame([("x", 7, 3.0), ("y", 8, 5.0)], "name string, code long, v double")
    assert rows(J.merge_same_layout([a, b], ["name"])) == [("x", 7, 2), ("y", 8, 5)]


def test_grid(spark):
    cells = spark.createDataFrame([("s", 1, 1, "Title"), ("s", 2, 1, "name"), ("s", 2, 2, "year"), ("s", 3, 1, "a"), ("s", 3, 2, "1,000")], "source string, row int, col int, value string")
    assert N.header_row(cells).first()["header_row"] == 2
    g = spark.createDataFrame([("s", 1, "A", "p"), ("s", 2, None, "q"), ("s", 3, None, None), ("s", 4, "B", None), ("s", 5, None, None)], "source string, r int, a string, t string")
    got = [tuple(r) for r in N.fill_down(g, "source", "r", "a").orderBy("r").select("a", "t").collect()]
    assert got == [("A", "p"), ("A", "q"), ("A", "q"), ("B", None), ("B", "q")]
    assert N.column_classes(g).count() == 4
    two = spark.createDataFrame([("s", 1, "P", "a"), ("s", 2, None, "b"), ("s", 3, None, "b"), ("s", 4, "Q", None)], "source string, col int, upper string, lower string")
    assert [r["name"] for r in N.header_names(two).orderBy("col").collect()] == ["P_a", "P_b", "P_b_1", "Q"]


def test_used_range(spark):
    """Three sheets in one table: rows, columns, filled cells, all cells, density; blank cells, an empty sheet and one that begins further in."""
    sheets = {"four": (33, 544), "five": (40, 663), "seven": (26, 425)}
    cells = spark.createDataFrame([("none", 3, 2, " ")], "file string, row int, col int, value string")
    for name, (height, filled) in sheets.items():
        # at most two gaps a row, so that no row or column is empty
        gaps = [18 * r + r % 18 for r in range(height)] + [18 * r + (r + 5) % 18 for r in range(height)]
        gap = F.when(F.col("id").isin(gaps[:18 * height - filled]), F.when(F.col("id") % 2 == 0, "\u3000 ")).otherwise("v")
        cells = cells.union(spark.range(18 * height).select(F.lit(name), (F.floor(F.col("id") / 18) + 1).cast("int"), (F.col("id") % 18 + 1).cast("int"), gap))
    cells = cells.union(spark.createDataFrame([("in", 5, 3, "x"), ("in", 7, 9, "y")], cells.schema))
    got = {r["file"]: tuple(r)[2:] for r in N.used_range(cells.withColumn("sheet", F.lit("s"))).collect()}
    want = {name: (1, height, 1, 18, height, 18, filled, 18 * height, round(filled / (18 * height), 3)) for name, (height, filled) in sheets.items()}
    assert got == want | {"in": (5, 7, 3, 9, 2, 2, 2, 21, 0.095), "none": (3, 3, 2, 2, 0, 0, 0, 1, 0.0)}


def test_pipeline(spark, tmp_path):
    t = {"t": spark.createDataFrame([("a", 1), ("b", 5)], "k string, v long")}
    good = [{"op": "load"}, {"op": "filter", "column": "v", "operator": "gt", "value": 2}, lambda df: df.withColumn("w", F.col("v") * 2), {"op": "save", "path": str(tmp_path / "o"), "format": "csv"}]
    out, log = D.run(good, t)
    assert rows(out) == [("b", 5, 10)] and log[-1]["columns"] == ["k", "v", "w"]
    assert rows(S.read_csv(spark, str(tmp_path / "o"), "k string, v long, w long").drop("source")) == [("b", 5, 10, 1)]
    assert "similar: ['v" in D.problems([{"op": "load"}, {"op": "sort", "column": "vv"}], t)[0] or D.problems([{"op": "load"}, {"op": "sort", "column": "vv"}], t)
    assert D.problems([{"op": "sort", "column": "v"}], t) == ["the first step must be load"]


def test_streams(spark, tmp_path):
    source = f"{SF}/part.parquet"
    (tmp_path / "in").mkdir()
    spark.read.parquet(source).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = row_steps(follow(spark, str(tmp_path / "in"), spark.read.parquet(source).schema), [{"op": "filter", "column": "p_size", "operator": "gte", "value": 40}, {"op": "select", "columns": ["p_partkey"]}])
    q = stream.writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from parts").count() == spark.read.parquet(source).filter("p_size >= 40").count()


def test_workbooks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>5</v></c></row></sheetData></worksheet>')
    assert rows(S.read_workbooks(spark, str(tmp_path))) == [("b.xlsx", "S", 1, 1, "name"), ("b.xlsx", "S", 1, 28, "5")]


def test_dates_and_code():
    assert O.months((2024, 12), (2024, 12)) == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))
    assert O.relative("quarter", dt.date(2024, 5, 1), 2) == (dt.date(2024, 4, 1), dt.date(2024, 7, 1))


def test_code_blocks(spark):
    df = spark.createDataFrame([("see\n```python\nx = 1\n```",), ("none",)], "t string")
    assert rows(X.code_block(df, "t").select("code", "said")) == [("x = 1\n", "see"), (None, "none")]


def test_similar_vectors(spark):
    """More queries than the former cap of 1000, in blocks, against all pairs; odd vectors; every 20th vector against SQL."""
    g = np.random.default_rng(5)
    v = g.integers(-3, 4, (1100, 4)).astype(float)
    data = [(i, x.tolist(), int(i % 3) if i % 7 else None) for i, x in enumerate(v)] + [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0], 1), (2002, [1.0], 1)]
    df = spark.createDataFrame(data, "id long, v array<double>, kind int")
    got = {(r["query"], r["rank"]): (r["match"], r["score"]) for r in X.similar_vectors(df, df, "id", "v", 2, "kind", block=300).collect()}
    assert len(got) == 2 * len(data)
    norm, kinds = np.sqrt((v * v).sum(1)), np.array([-1 if k is None else k for _, _, k in data[:1100]])
    for i in range(1100):
        if norm[i]:
            with np.errstate(all="ignore"):
                s = np.where(norm > 0, v @ v[i] / (norm * norm[i]) + 0.1 * ((kinds == kinds[i]) & (kinds[i] >= 0)), -9)
            s[i] = -9
            want = sorted(range(1100), key=lambda j: (-round(s[j], 9), j))[:2]
            assert [got[i, 1][0], got[i, 2][0]] == want and abs(got[i, 1][1] - s[want[0]]) < 1e-9
    assert all(got[q, 1][1] is None and got[q, 1][0] == 0 for q in (2000, 2001, 2002))
    assert X.similar_vectors(df, df.limit(0), "id", "v").count() == 0
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    name = "t3_similar_vectors_20"
    want = c.sql(table_queries.oracle_sql()[name])
    assert rows(table_queries.queries()[name](spark, SF).select(*want.columns)) == sorted(want.fetchall(), key=repr)


def test_similar_vectors_odd(spark):
    """Lengths, missing and odd vectors, ties and repeated ids, in many small blocks and tasks, against all pairs."""
    g = np.random.default_rng(8)
    some = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [1e200, 1e200], [1e-200, 0.0], [float("inf"), 1.0]]
    data = [(f"k{g.integers(60):02d}", [some[i % 8], g.integers(-2, 3, 2).astype(float).tolist(), g.integers(-2, 3, 3).astype(float).tolist()][i % 3], ["a", "b", None][g.integers(3)]) for i in range(240)]
    data.append((None, [1.0, 1.0], "a"))
    asked = list({d[0]: d for d in data if d[0]}.values())
    df, queries = (spark.createDataFrame(d, "id string, v array<double>, kind string").repartition(3) for d in (data, asked))
    for bonus in (0.1, -0.2):
        got = {(r["query"], r["rank"]): (r["match"], r["score"]) for r in X.similar_vectors(df, queries, "id", "v", 4, "kind", bonus, block=16).collect()}
        assert len(got) == 4 * len(asked)
        for own, q, kind in asked:
            want = []
            for other, v, its in data:
                if other is None or other == own:
                    continue
                level, score = 2 ** 62, None
                if q is not None and v is not None and None not in (*q, *v) and len(q) == len(v):
                    with np.errstate(all="ignore"):
                        a, b = np.array(q), np.array(v)
                        size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                        if size != 0:
                            score = float((a * b).sum() / size + bonus * (kind is not None and kind == its))
                            level = -2 ** 62 if np.isnan(score) else -round(score * 1e9)
                want.append((level, other, score))
            for rank, (_, match, score) in enumerate(sorted(want, key=lambda w: w[:2])[:4], 1):
                have = got[own, rank]
                assert have[0] == match and (have[1] is None if score is None else np.isclose(have[1], score, equal_nan=True, atol=1e-9)), (own, rank)
    assert X.similar_vectors(df.limit(0), queries, "id", "v").count() == 0
    assert X.similar_vectors(df, queries.limit(0), "id", "v").columns == ["query", "rank", "match", "score"]


def test_similar_vectors_looks_at_few():
    """Of vectors around a hundred directions a query looks at a small part, and finds what all pairs give; a third of all rows are equal."""
    g = np.random.default_rng(2)
    around = g.normal(size=(100, 32))
    v = around[g.integers(100, size=6000)] + 0.1 * g.normal(size=(6000, 32))
    v[::3] = v[0]
    asked = v[::20]
    cells, none = vectors.make_cells(v), np.zeros(6000, int)
    best = vectors._Best(np.full(300, vectors.LEAST + 1), 3, [np.array([i]) for i in range(0, 6000, 20)])
    looked = vectors.search_cells(cells, none, asked, np.full(300, -1), 0.1, best)
    assert looked < 0.5 * 300 * 6000
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    for i, (levels, places, _) in enumerate(best.found):
        s = np.rint(unit @ unit[20 * i] * 1e9).astype(int)
        s[20 * i] = -2 ** 62
        want = np.lexsort((np.arange(6000), -s))[:3]
        assert np.abs(s[want] - levels).max() <= 1 and (i % 3 or places.tolist() == want.tolist())
    rare = [i for i in range(300) if i % 3]
    few = vectors._Best(np.full(len(rare), vectors.LEAST + 1), 3, [np.array([20 * i]) for i in rare])
    assert vectors.search_cells(cells, none, asked[rare], np.full(len(rare), -1), 0.1, few) < 0.25 * len(rare) * 6000


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_match_labels(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abC"), rng.integers(1, 9)))
    left = [word() for _ in range(150)] + ["", None, "z", "Q" * 30, "x" * 19 + "yz", "Ünïcode", "ab" * 12 + "c"]
    right = [word() for _ in range(60) if True] + ["abcabcabcabcabc", None, "q" * 31, "x" * 19 + "wz", "ünicode", "ba" + "ab" * 11 + "dddd"]
    right = [x for x in right if x is None or len(x) > 3]
    a = spark.createDataFrame([(x,) for x in left + left[:9]], "l string")
    b = spark.createDataFrame([(x, int(i % 37)) for i, x in enumerate(right)], "r string, o long")

    def best(x, names):
        found = []
        for y, o in names:
            if y is None:
                continue
            lx, ly = x.lower(), y.lower()
            near = len(x) >= 2 and len(y) >= 2 and abs(len(x) - len(y)) <= 3 and _edits(lx[:20], ly[:20]) <= 1
            if lx in ly or ly in lx or near:
                found.append((0 if lx in ly or ly in lx else 1, o, y))
        return min(found)[2] if found else None

    for names in ([(x, i % 37) for i, x in enumerate(right)], [("", 99), ("abba", 1)]):
        b = spark.createDataFrame(names, "r string, o long")
        want = {(x, best(x, names)) for x in left if x is not None and best(x, names) is not None}
        assert set(rows(J.match_labels(a, b, "l", "r", "o"))) == want and len(want) > 5
        # many blocks, all cut further
        assert set(rows(J.match_labels(a, b, "l", "r", "o", block=25))) == want
    assert J.match_labels(a, b.limit(0), "l", "r", "o").columns == ["l", "matched"]
    assert rows(J.match_labels(a.limit(0), b, "l", "r", "o")) == []


def test_match_long_labels(spark):
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdefgh\U0001f600ü"), 10_000))
    a = spark.createDataFrame([(text.upper(),), ("aaa" + text + "bbb",), ("none of them",), ("tie",), (text[:9000],)], "l string")
    b = spark.createDataFrame([(text, float("nan")), (text[5000:5040], 2.0), (text[1:], 2.0), ("a tie b", 1.0), ("b tie", 1.0), ("the tie", None), (text + "c", float("nan")), (None, None)], "r string, o double")
    near = min(text[5000:5040], text[1:])
    for block in (2 ** 20, 3000):
        got = dict(rows(J.match_labels(a, b, "l", "r", "o", block=block)))
        assert got == {text.upper(): near, "aaa" + text + "bbb": near, "tie": "the tie", text[:9000]: text[5000:5040]}
    # a trigram that all labels share, in one block that is cut on both sides
    a = spark.range(400).select(F.concat(F.lit("www"), F.lpad("id", 3, "0"), F.lit("www")).alias("l"))
    b = spark.range(0, 400, 4).select(F.concat(F.lit("w"), F.lpad("id", 3, "0")).alias("r"), "id")
    got = rows(J.match_labels(a, b, "l", "r", "id", block=600))
    assert got == [(f"www{i:03d}www", f"w{i:03d}") for i in range(0, 400, 4)]


def test_similar_texts(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab가😀 "), rng.integers(0, 12))) for _ in range(90)] + [None, "zz", "a"]
    kinds = [None if i % 7 == 0 else str(i % 3) for i in range(len(texts))]
    df = spark.createDataFrame([(f"t{i:02}", t, k) for i, (t, k) in enumerate(zip(texts, kinds))], "id string, t string, kind string")
    grams = [[t[j:j + 2] for j in range(len(t) - 1)] if t else [] for t in texts]
    every = sorted({g for gs in grams for g in gs})
    tf = np.array([[gs.count(g) for g in every] for gs in grams], float)
    w = tf * (np.log((len(texts) + 1) / ((tf > 0).sum(0) + 1)) + 1)
    norm = np.sqrt((w * w).sum(1))
    cos = np.divide(w @ w.T, norm[:, None] * norm[None], out=np.zeros((len(w), len(w))), where=norm[:, None] * norm[None] > 0)
    for category in (None, "kind"):
        bonus = 0.1 * np.array([[category is not None and x is not None and x == y for y in kinds] for x in kinds])
        want = set()
        for i in range(len(texts)):
            ok = [j for j in range(len(texts)) if cos[i, j] > 0]
            order = sorted(ok, key=lambda j: (-round(cos[i, j] + bonus[i, j], 9), j))[:3]
            want |= {(f"t{i:02}", n + 1, f"t{j:02}", round(cos[i, j] + bonus[i, j], 6)) for n, j in enumerate(order)}
        for block in (20, 4096):
            got = X.similar_texts(df, df, "id", "t", "id", "t", 3, category, block=block).collect()
            assert {(r["query"], r["rank"], r["match"], round(r["score"], 6)) for r in got} == want
    assert X.similar_texts(df, df.limit(0), "id", "t", "id", "t").count() == 0 and X.similar_texts(df.limit(0), df, "id", "t", "id", "t").count() == 0


@pytest.mark.parametrize("name", sorted(table_queries.oracle_sql()))
def test_query_rows(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = table_queries.queries()[name](spark, SF), c.sql(table_queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    same = lambda found: sorted([tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in found], key=repr)
    assert same(got.select(*[f"`{x}`" for x in want.columns]).collect()) == same(want.fetchall())


def test_ordered_bits(spark):
    """The numbers of doubles are their bit patterns: every power of two and its neighbours, zeros, subnormals, infinities and NaN."""
    import struct

    xs = [f(2.0 ** e) for e in range(-1074, 1024) for f in (lambda x: x, lambda x: math.nextafter(x, 0), lambda x: math.nextafter(x, math.inf), lambda x: 1.37 * x)]
    xs = [x for x in xs if math.isfinite(x)] + [0.0, math.inf, 5e-324, 1.7976931348623157e308]
    xs += [-x for x in xs]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_bits(F.col("x"))).collect()
    sign = lambda x: -1 if x < 0 else 1
    assert all(b == sign(x) * struct.unpack("<q", struct.pack("<d", abs(x)))[0] for x, b in got)
    assert spark.range(1).select(ordered_bits(F.lit(math.nan)), ordered_bits(F.lit(None).cast("double"))).first()[:] == (2 ** 63 - 1, None)


def test_quantiles(spark):
    """Against Spark's own percentile: groups of missing keys, nulls, NaN, zeros of both signs, ties, infinite and close values; several rounds."""
    g = np.random.default_rng(4)
    close = [1.0 + i * 2.0 ** -52 for i in range(40)]
    data = [("n", float(x), int(x * 9)) for x in g.normal(size=300)] + [("t", float(x), None) for x in g.integers(0, 3, 50)] + [("c", x, 2 ** 60) for x in close] + [(None, x, 1) for x in (0.0, -0.0, 3.0, -0.0)]
    data += [("nan", x, 0) for x in (math.nan, 1.0, math.nan)] + [("none", None, None)] * 3 + [("one", 7.5, -1)] + [("inf", x, 5) for x in (math.inf, 1.0, -math.inf, 2.0, 3.0)] + [("e", 10.0 ** i * (-1) ** i, i) for i in range(-300, 300, 7)]
    df = spark.createDataFrame(data, "k string, x double, i long").repartition(5)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    want = {}
    for c in ("x", "i"):
        for r in df.groupBy("k").agg(F.count(c).alias("n"), F.percentile(F.col(c), F.array(*map(F.lit, shares))).alias("q")).collect():
            if r["n"]:
                want[r["k"], c] = (r["n"], r["q"])
    same = lambda a, b: (a != a and b != b) or a == b or abs(a - b) <= 1e-12 * max(abs(a), abs(b))
    got = {(r["k"], r["column"]): (r["n"], r["q"]) for r in quantiles(df, ["x", "i"], shares, ["k"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and all(map(same, got[k][1], want[k][1])) for k in want)
    whole = quantile_lists(df.filter("k <> 'nan'"), ["x", "i"], (0.5,))
    assert same(whole["x"][1][0], df.filter("k <> 'nan'").agg(F.median("x")).first()[0])
    assert quantile_lists(df.limit(0), ["x"], (0.5,)) == {"x": (0, [None])}
    med = {r["k"]: tuple(r)[1:] for r in A.aggregate(df, ["k"], [{"column": "x", "func": "median"}, {"column": "i", "func": "count"}]).collect()}
    assert None not in med and med["none"] == (None, 0) and med["t"][0] == want["t", "x"][1][3]
    assert A.aggregate(df.limit(0), metrics=[{"column": "x", "func": "median"}]).first()[0] is None
    assert Q.outliers(df.filter("k = 't'"), columns=["x"]).first()["outliers"] == 0 and Q.outliers(df.filter("k = 'none'"), columns=["x"]).first()[:] == ("x", None, None, 0)


def test_quantiles_plan(spark):
    """No task gets a column: neither percentile nor median stands in a plan by default, and one key's values are dealt over tasks."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    for df in (Q.outliers(events, columns=["value"]), Q.distribution(events, ["value"]), C.histogram(events, "value"), C.box(events, "value", "event_type"), A.aggregate(events, ["event_type"], [{"column": "value", "func": "median"}])):
        plan = df._jdf.queryExecution().toString().lower()
        assert "percentile" not in plan and "median(" not in plan


def _csv_text(rng, rows, columns, eol):
    """A CSV file by hand: plain, quoted and half-quoted fields, quoted line breaks, blank lines."""
    kinds = [lambda: "plain", lambda: "", lambda: '""', lambda: '"a,b"', lambda: '"x ""y"" z"', lambda: '"first\nsecond"', lambda: '"\n\n,\n"', lambda: '5" disk', lambda: 'a"b"c', lambda: '"é""\n"', lambda: "7", lambda: '"q"tail', lambda: '"cr\r\nlf"', lambda: '"' + "long\n" * 30 + '"']
    lines = [",".join(f"c{i}" for i in range(columns))]
    for _ in range(rows):
        lines.append(",".join(kinds[rng.integers(len(kinds))]() for _ in range(columns)))
        if rng.random() < 0.1:
            lines.append("")
    return eol.join(lines) + (eol if rng.random() < 0.5 else "")


@pytest.mark.parametrize("size", [97, 4096])
def test_csv_records(spark, tmp_path, size):
    """Files cut into blocks of a few bytes, in the middle of quoted fields, against Python's csv; rows are numbered in the order of the file."""
    import csv
    import io

    rng, want = np.random.default_rng(size), []
    for f in range(4):
        text = ("﻿" if f == 2 else "") + _csv_text(rng, 9 * f, 3, "\r\n" if f % 2 else "\n")
        (tmp_path / f"f{f}.csv").write_bytes(text.encode())
        # blank lines and lines of one empty field are alike to Python's csv, which gives []
        rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline="")) if r]
        want += [(f"f{f}.csv", i + 1, [x or None for x in r]) for i, r in enumerate(rows)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = [(r[0], r[1], r[2]) for r in CSV.records(spark, str(tmp_path)).select("source", "number", CSV.fields("record")).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        cells = CSV.csv_cells(spark, str(tmp_path))
        assert cells.count() == sum(len(r) for _, _, r in want) and cells.filter("value IS NOT NULL").count() == sum(x is not None for _, _, r in want for x in r)
        (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
        with pytest.raises(ValueError, match="open.csv"):
            CSV.records(spark, str(tmp_path))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv_copies_dealt(spark, tmp_path):
    """Four times the rows give four times the files or so, none of them larger, and the queries read every row back."""
    made, old = {}, {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        for n in (8, 32):
            k = spark.range(100 * n)
            k.select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"), F.lit(32).alias("n_chars")).repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
            k.select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.rand(1).alias("o_totalprice")).repartition(n).write.parquet(f"{tmp_path}/{n}/orders.parquet")
            read = lambda name: spark.read.parquet(f"{tmp_path}/{n}/{name}.parquet")  # noqa: B023, E731
            for name, path in (("documents", table_queries._quoted_csv(read)), ("orders", table_queries._copied(read, "csv"))):
                made[name, n] = [len(open(f).readlines()) for f in glob.glob(path.removeprefix("file://") + "/*.csv")]
            assert table_queries.s1_quoted_line_breaks(read).agg(F.count_distinct("doc_id")).first()[0] == 100 * n
            assert table_queries.s1_row_numbers(read).first()[:] == (100 * n, 100 * n)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in ("documents", "orders"):
        assert len(made[name, 8]) >= 3 and len(made[name, 32]) >= 2 * len(made[name, 8]) and max(made[name, 32]) <= 1.5 * max(made[name, 8])


def test_csv_records_stay(spark, tmp_path):
    """The names of each file go to its records, which are not dealt by file, however large the table of records is."""
    for f, n in (("a", 3000), ("b", 5)):
        (tmp_path / f"{f}.csv").write_text("id,text\n" + "".join(f'{i},"{hashlib.md5(f"{f}{i}".encode()).hexdigest()}\n"\n' for i in range(n)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        out = CSV.load_files(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert rows(out.groupBy("source").agg(F.count("text"), F.max("_row_id"))) == [("a.csv", 3000, 3000), ("b.csv", 5, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_csv_layouts(spark, tmp_path):
    """Types of different files meet in the narrowest that holds both; missing cells are counted by file and column; empty files and names."""
    (tmp_path / "a.csv").write_text("id,x,flag\n1,2,true\n2,,false\n")
    (tmp_path / "b.csv").write_text("x,id,when,\n2.5,3,2024-01-02,z\n,4,2024-01-02 03:04:05,\n")
    (tmp_path / "c.csv").write_text("id\n")
    (tmp_path / "d.csv").write_text("")
    info = {r["source"]: tuple(r)[2:] for r in CSV.file_info(spark, str(tmp_path)).collect()}
    assert info == {"a.csv": (2, 3, 1, "id:bigint, x:bigint, flag:boolean", "id:0, x:1, flag:0"), "b.csv": (2, 4, 2, "x:double, id:bigint, when:timestamp, _c3:string", "x:1, id:0, when:0, _c3:1"), "c.csv": (0, 1, 0, "id:void", "id:0")}
    out = CSV.load_files(spark, str(tmp_path))
    assert out.dtypes == [("id", "bigint"), ("x", "double"), ("flag", "boolean"), ("when", "timestamp"), ("_c3", "string"), ("source", "string"), ("_row_id", "bigint")]
    assert [tuple(r) for r in out.orderBy("id").select("id", "x", "flag", "_c3", "_row_id").collect()] == [(1, 2.0, True, None, 1), (2, None, False, None, 2), (3, 2.5, None, "z", 1), (4, None, None, None, 2)]
    (tmp_path / "c.csv").unlink()
    assert CSV.load_files(spark, str(tmp_path), True).columns == ["id", "x", "source", "_row_id"]
    assert rows(CSV.read_csv(spark, str(tmp_path / "a.csv"), header=False).select("_c0", "_c2", "_row_id")) == [("1", "true", 2), ("2", "false", 3), ("id", "flag", 1)]


def _fill_down_by_window(rows, within_group):
    """Row by row: source, order, anchor, a, b."""
    out = []
    for source in dict.fromkeys(r[0] for r in rows):
        top, held = None, [None, None]
        for _, o, anchor, *others in sorted((r for r in rows if r[0] == source), key=lambda r: r[1]):
            more = anchor is None
            top = top if more else anchor
            if within_group and not more:
                held = [None, None]
            made = []
            for i, x in enumerate(others):
                if within_group or more:
                    held[i] = x if x is not None else held[i]
                    made.append(held[i])
                else:
                    made.append(x)
            out.append((source, o, top, *made))
    return out


@pytest.mark.parametrize("within_group", [False, True])
@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_fill_down(spark, within_group, blocks):
    """Random grids, one source over many blocks, long runs without an anchor or a value; equal to filling row by row."""
    rng = np.random.default_rng(blocks)
    pick = lambda p: "".join(rng.choice(list("xyz"), 2)) if rng.random() < p else None
    data = [(f"s{k}" if k else None, i * 3, pick(0.03 if k % 2 else 0.4), pick(0.05), pick(0.5)) for k, n in enumerate((5, 400, 60, 1)) for i in range(n)]
    df = spark.createDataFrame(data, "source string, r long, a string, b string, c string").withColumn("n", F.col("r") * 2).repartition(5)
    out = N.fill_down(df.withColumn("b", F.coalesce("b", F.lit(" "))), "source", "r", "a", None, within_group, blocks)
    assert out.columns == df.columns and rows(out.drop("n")) == sorted(_fill_down_by_window(data, within_group), key=repr)


def test_merge_order(spark, tmp_path):
    """First values follow the order of files and rows, however the tables are cut into tasks."""
    t = spark.range(3000).select((F.col("id") % 7).cast("string").alias("k"), F.when(F.col("id") > 20, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("first"), (F.col("id") % 5).alias("n"))
    t.coalesce(1).write.option("parquet.block.size", 2000).parquet(str(tmp_path / "t"))
    found = set()
    for size in ("1k", "8k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        table = spark.read.parquet(str(tmp_path / "t"))
        found.add(tuple(rows(J.merge_same_layout([table.filter("n > 0"), table.filter("n = 0").select("first", "k", "n")], ["k"]))))
        assert table.rdd.getNumPartitions() > 1 or size == "64m"
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 1
    want = {str(k): next(f"v{i}" for i in range(21, 3000) if i % 7 == k and i % 5 > 0) for k in range(7)}
    assert {r[0]: r[1] for r in found.pop()} == want


def test_counted_steps(spark):
    """Counts of steps come from the one action: the plan reads the table once, and no job is added."""
    t = {"t": spark.read.parquet(f"{SF}/part.parquet")}
    out, log = D.run([{"op": "load"}, {"op": "filter", "column": "p_size", "operator": "gte", "value": 40}, {"op": "select", "columns": ["p_size"]}], t, counted=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    n = len(out.collect())
    assert D.row_counts(log) == [t["t"].count(), n, n] and 0 < n < t["t"].count()


def test_text_index():
    """Blocks of texts against all pairs: the same best scores, and less than half of the postings read where few texts are near."""
    rng, share = np.random.default_rng(7), []
    themes = [rng.choice(2000, 60, replace=False) for _ in range(40)]
    grams = [np.unique(np.concatenate([rng.choice(themes[i % 40], 25), rng.integers(0, 50, 6)])) for i in range(1200)]
    weights = [rng.random(len(g)) * np.where(g < 50, 0.1, 1.0) + 0.05 for g in grams]
    dense = np.zeros((1200, 2000))
    for i, (g, w) in enumerate(zip(grams, weights)):
        dense[i, g] = w / np.sqrt((w * w).sum())
    blocks = [similar.make_block(grams[at:at + 300], weights[at:at + 300]) for at in range(0, 1200, 300)]
    for q in range(0, 1200, 60):
        levels = np.rint(dense @ dense[q] * similar.SCALE)
        want, least, got, read = sorted(levels[levels > 0])[-2:], 1, [], 0
        for b in blocks:
            _, found, n = similar.search_block(b, 300, grams[q], dense[q, grams[q]], None, least)
            got = sorted([*got, *found])[-2:]
            least = int(got[0]) if len(got) == 2 else 1
            read += n
        assert all(abs(a - b) <= 1 for a, b in zip(got, want)) and len(got) == 2
        share.append(read / sum(int(np.isin(g, grams[q]).sum()) for g in grams))
    assert np.mean(share) < 0.5


def _streamed(spark, out, files, folder, name):
    """Rows of a stream that is given its files one after the other."""
    q = out.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(folder) + "-state").start()
    try:
        for i, f in enumerate(files):
            f.coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_run_logs_on_streams(spark, tmp_path):
    """Chains, rates and durations of a stream in three parts, out of order, equal those of the whole table."""
    e = spark.read.parquet(f"{SF}/events.parquet").filter("user_id < 12").select("user_id", "event_id", "event_type", (F.col("event_type") != "error").alias("ok"))
    parts = [e.filter(F.col("event_id") % 3 == k) for k in (1, 0, 2)]
    (tmp_path / "runs").mkdir()
    got = _streamed(spark, R.chains(follow(spark, str(tmp_path / "runs"), e.schema), "user_id", "event_id", "event_type", "ok"), parts, tmp_path / "runs", "chains")
    newest = {}
    for r in got:
        newest[r["user_id"]] = max(newest.get(r["user_id"], r), r, key=lambda x: x["seen"])
    assert {(k, r["chain"]) for k, r in newest.items()} == {tuple(r) for r in X.chains(e, "user_id", "event_id", "event_type", "ok").collect()}
    assert {(k, round(r["success_rate"], 9)) for k, r in newest.items()} == {(r[0], round(r[1], 9)) for r in X.success_rate(e, "ok", "user_id").collect()}
    s = e.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.col("event_id").alias("started_at"), (F.col("event_id") % 50).alias("duration_ms"))
    (tmp_path / "stages").mkdir()
    got = _streamed(spark, R.stage_durations(follow(spark, str(tmp_path / "stages"), s.schema)), [s.filter(F.col("started_at") % 2 == k) for k in (1, 0)], tmp_path / "stages", "stages")
    newest = {}
    for r in got:
        k = (r["run"], r["stage"])
        newest[k] = max(newest.get(k, r), r, key=lambda x: x["seen"])
    assert {(*k, r["duration_ms"], r["total_ms"]) for k, r in newest.items()} == {tuple(r) for r in X.stage_durations(s).collect()}


def test_late_runs(spark, tmp_path):
    """A session without news is closed by a timer, and rows behind the watermark do not open it again."""
    at = lambda rows: spark.createDataFrame([(u, i, "t", True, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for u, i, h in rows], "u string, i long, l string, ok boolean, ts timestamp")
    parts = [at([("a", 1, 0), ("a", 2, 0.1)]), at([("b", 3, 9)]), at([("b", 4, 9.1)]), at([("a", 5, 0.2), ("b", 6, 9.2)])]
    (tmp_path / "late").mkdir()
    out = R.chains(follow(spark, str(tmp_path / "late"), parts[0].schema), "u", "i", "l", "ok", time="ts", late="1 hour")
    got = [(r["u"], r["chain"], r["runs"], r["closed"]) for r in _streamed(spark, out, parts, tmp_path / "late", "late")]
    assert [x for x in got if x[0] == "a"] == [("a", "t → t", 2, False), ("a", "t → t", 2, True)]
    assert [x for x in got if x[0] == "b"] == [("b", " → ".join("t" * n), n, False) for n in (1, 2, 3)]


def _diagnosed(df, order):
    """The same findings by one operator each."""
    out = [("missing", r["column"], r["missing_percent"]) for r in Q.missing_report(df).collect() if r["missing_percent"] > 20][:3]
    again = Q.duplicate_rows(df).first()[0]
    out += [("duplicates", None, again)] if again else []
    some = Q.summary_rows(df).first()[0]
    out += [("summary_rows", None, some)] if some else []
    out += [("constant", c, 1) for c in sorted(r[0] for r in Q.constants(df).collect())[:2]]
    out += [("outliers", c, n) for c, n in sorted((r["column"], r["outliers"]) for r in Q.outliers(df).collect() if r["outliers"])[:2]]
    return out + [("mixed", c, round(x, 9)) for c, x in sorted((r["column"], r["share"]) for r in Q.mixed_types(df, order).collect())[:2]]


def test_diagnosis(spark):
    """Against the single operators: nulls, NaN, zeros of both signs, close and extreme values, ties, repeated rows, quartiles and limits in one bucket."""
    g = np.random.default_rng(8)
    seen = set()
    for i in (0, 1, 8):
        n = int(g.integers(40, 400))
        spread = [1e-9, 1.0, 1e6][i % 3]
        near = g.normal(1000, spread, n)
        far = np.where(g.random(n) < 0.1, near * g.choice([3, -2, 1 + 8 * spread / 1000], n), near)
        odd = g.choice([0.0, -0.0, 1.0, 2.0, 5e-324, -1e300, math.nan if i % 2 else 3.0, math.inf if i == 8 else 1.5], n)
        data = [(k, float(near[k]), float(far[k]), float(odd[k]), None if k % 4 == 0 else int(g.integers(0, 3) ** 9), g.choice(["1,000", "x", "total"]) if k % 3 else None, "only", None) for k in range(n)]
        data = data + data[:i]
        df = spark.createDataFrame([(r[0] if r[0] > 2 else None, *r[1:]) for r in data], "id long, near double, far double, odd double, n int, t string, one string, none string").repartition(4)
        # ties by order have equal texts
        got = [(r["rule"], r["column"], round(r["value"], 9)) for r in diagnosis(df, "id").collect()]
        assert got == _diagnosed(df, "id"), i
        for rule in ("outliers", "mixed"):
            assert {x for x in got if x[0] == rule} <= set(_diagnosed(df, "id"))
        seen |= {x[0] for x in got}
    assert seen == {"missing", "duplicates", "summary_rows", "constant", "outliers", "mixed"}
    assert [f.name for f in diagnosis(df.limit(0), "id").schema] == ["rule", "column", "value", "message"] and rows(diagnosis(df.limit(0), "id")) == []
    two = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert ("duplicates", None, 1.0, "1 repeated rows") in rows(diagnosis(two))


def test_diagnosis_scans(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    df = spark.range(5000).select(counted.asNondeterministic()("id").alias("id"), F.when(F.col("id") % 100 == 0, 1e9).otherwise(F.col("id") % 977 + 0.5).alias("x"), F.when(F.col("id") % 2 == 0, F.lit("y")).otherwise(F.lit("3")).alias("t"))
    assert {r[0] for r in diagnosis(df, "id").collect()} == {"outliers", "mixed"} and read.value == 10_000


def test_profiles(spark, tmp_path):
    """States of files: merged as if of one table; only new and changed files are read; files of other columns, without rows, without numbers."""
    data = spark.range(6000).select("id", (F.col("id") % 1000).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("total "), F.col("id") % 7)).alias("t"))
    for i in range(3):
        data.filter(F.col("id") % 3 == i).drop(*(["x"] if i == 2 else [])).coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    paths, asked = [str(tmp_path / f"f{i}") for i in range(3)], []

    def read(files):
        asked.append(len(files))
        return spark.read.option("mergeSchema", "true").parquet(*files)

    PR.refreshed(spark, paths[:2], read=read).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    now = PR.refreshed(spark, paths[1:], kept, read)
    assert asked == [2, 1] and now.count() == 2
    assert PR.refreshed(spark, paths[:2], kept, read).count() == 2 and asked == [2, 1]
    every = PR.merged(PR.refreshed(spark, paths, kept, read))
    got = {r["column"]: r for r in PR.report(every).collect()}
    assert [(got[c]["data_count"], got[c]["missing"], got[c]["summary_rows"]) for c in ("id", "x", "t")] == [(6000, 0, 0), (4000, 2000, 0), (4000, 2000, 4000)]
    assert (got["id"]["min"], got["id"]["max"], got["t"]["min"], got["t"]["max"]) == ("0", "5999", "total 0", "total 6") and got["t"]["distinct"] == 7 and got["t"]["quantiles"] is None
    assert abs(got["id"]["distinct"] - 6000) < 300 and all(abs(q - w) < 150 for q, w in zip(got["id"]["quantiles"], (1500, 3000, 4500)))
    none = {r["column"]: r for r in PR.report(PR.merged(kept.limit(0))).collect()}
    assert none["x"]["data_count"] == 0 and none["x"]["quantiles"] is None and none["x"]["distinct"] == 0
    odd = PR.report(PR.states(spark.sql("SELECT double('NaN') AS x, map(1, 2) AS m, CAST(NULL AS binary) AS b"))).collect()
    assert [(r["data_count"], r["quantiles"]) for r in odd] == [(1, None), (1, None), (0, None)]


def test_frequent(spark, tmp_path):
    """Bounds of counts hold for every value, sure ones are first, and the second scan gives exact counts; files of other columns."""
    g = np.random.default_rng(4)
    heavy = g.zipf(1.5, 6000) % 400
    data = [(int(i % 5), f"v{heavy[i]}" if i % 11 else None, f"u{i % 700}", None, "ab"[i % 2]) for i in range(6000)]
    df = spark.createDataFrame(data, "p int, heavy string, flat string, none string, few string")
    columns, some = ["heavy", "flat", "none", "few"], PR.frequent(df, F.col("p"), keep=20)
    real = {c: {} for c in columns}
    for row in data:
        for c, v in zip(columns, row[1:]):
            if v is not None:
                real[c][v] = real[c].get(v, 0) + 1
    bounds = {(r["column"], r["value"]): r for r in PR.frequent_bounds(some).collect()}
    for c in columns:
        unseen = max([r["unseen"] for (k, _), r in bounds.items() if k == c], default=0)
        for v, n in real[c].items():
            assert bounds[c, v]["at_least"] <= n <= bounds[c, v]["at_most"] if (c, v) in bounds else n <= unseen
    assert {(r["column"], r["count"]) for r in some.filter("value is null and part = 1").collect()} == {("heavy", sum(1 for d in data if d[0] == 1 and d[1] is None)), ("none", 1200)}
    want = sorted((c, i, v, n) for c in columns for i, (v, n) in enumerate(sorted(real[c].items(), key=lambda x: (-x[1], x[0]))[:3], 1))
    assert sorted(tuple(r) for r in PR.most_frequent_exact(some, df).collect()) == want
    sure = [r for r in PR.most_frequent(some).collect() if r["certain"]]
    assert {r["value"] for r in sure if r["column"] == "heavy"} and {r["value"] for r in sure if r["column"] == "few"} == {"a", "b"}
    assert all(r["value"] in [w[2] for w in want if w[0] == r["column"]] for r in sure)
    assert not [r for r in PR.most_frequent(some).collect() if r["column"] == "flat" and r["certain"]]
    assert PR.most_frequent_exact(PR.frequent(df.limit(0)), df.limit(0)).count() == 0
    for i in range(2):
        df.filter(f"p = {i}").drop(*(["few"] if i else [])).coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    kept = PR.refreshed(spark, [str(tmp_path / "f0")], make=PR.frequent)
    kept.write.parquet(str(tmp_path / "kept"))
    both = PR.refreshed(spark, [str(tmp_path / f"f{i}") for i in range(2)], spark.read.parquet(str(tmp_path / "kept")), make=PR.frequent)
    top = {(r["column"], r["rank"]): r for r in PR.most_frequent(both, 1).collect()}
    n = sum(1 for d in data if d[0] in (0, 1) and d[1] == top["heavy", 1]["value"])
    assert top["heavy", 1]["at_least"] == top["heavy", 1]["at_most"] == n and top["heavy", 1]["certain"]


def test_frequent_hot(spark):
    """Rows of a frequent value do not meet in a task: few values in doubt are broadcast, else values are counted before the join."""
    k = F.col("id")
    df = spark.range(0, 40000, 1, 8).select((k % 4).alias("p"), F.when(k % 10 > 0, "hot").otherwise(F.concat(F.lit("v"), k % 50)).alias("c"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("20k", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            out = PR.most_frequent_exact(PR.frequent(df, F.col("p"), keep=20), df)
            if threshold == "-1":
                lines = [x.strip(" :+-") for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
                at = next(i for i, x in enumerate(lines) if x.startswith("Join LeftSemi"))
                assert lines[at + 1].startswith("Aggregate")
            else:
                assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert rows(out) == [("c", 1, "hot", 36000), ("c", 2, "v0", 800), ("c", 3, "v10", 800)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scratch(spark):
    """Tables saved in a block go at its end, also when it fails; those of an outer block, another thread or none stay."""
    there = lambda df: glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tabwork-{df}-*")
    df = spark.range(5)
    kept = saved(df, "kept")
    with scratch(spark):
        outer = saved(df, "outer")
        with pytest.raises(ZeroDivisionError), scratch(spark):
            inner = saved(df, "inner")
            other = threading.Thread(target=lambda: saved(df, "thread"))
            other.start(), other.join()
            assert inner.count() == 5 and there("inner") and there("thread")
            1 / 0
        assert not there("inner") and there("outer") and outer.count() == 5
    assert not there("outer") and there("thread") and kept.count() == 5
    with scratch(spark):
        assert X.similar_vectors(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>"), spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), "id", "v").count() == 1
        assert there("vector-index")
    assert not there("vector-index")


@pytest.mark.parametrize("name, format, want", [("out", "csv", "out.csv"), ("out.csv", "csv", "out.csv"), ("a.b", "parquet", "a.b.parquet")])
def test_save_by_name(spark, tmp_path, name, format, want):
    df = spark.createDataFrame([(1, "x")], "k long, s string")
    steps = [{"op": "load"}, {"op": "save", "path": str(tmp_path) + "/", "format": format, "filename": name}]
    _, log = D.run(steps, {"a": df})
    assert log[-1]["path"] == str(tmp_path / want)
    back = spark.read.option("header", True).format(format).load(str(tmp_path / want))
    assert rows(back.select(F.col("k").cast("long"), "s")) == [(1, "x")]
