"""The stages of the corpus pipeline, each against SQL or plain Python over what the stage before kept, odd rows included."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabwork.llm import oracles, tokens
from tests.llm.test_operators import DOCS, SF, plain_components


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps, by name; "documents" is its first input."""
    long = " ".join(f"word{i % 97} the of and {i}" for i in range(40))
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (-5, long + " token: abcdefghijklmnop", "en", None, 9), (-6, long + " token: abcdefghijklmnop", "en", "a", 9), (-6, long + " token: abcdefghijklmnop", "en", "a", 9),
           (None, long + " token: abcdefghijklmnop", "en", "b", 9), (None, "other " + long[::-1], "xx", "b", 9), (-8, "\u00e9 " * 9000, "fr", "b", 1)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, DOCS)).withColumn("key", F.col("doc_id") * 2)
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), f"test-{name}")
        found[name] = docs
    return found


def by_sql(table, sql):
    """Rows of SQL over a table, as dicts."""
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "lang", "source").toArrow())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def test_columns(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near", "secrets", "mixing", "packing"]
    assert all(kept[n].columns == kept["documents"].columns for n in names[:-1])
    assert all(r["key"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for n in names[:-1] for r in kept[n].collect())


def test_quality(kept):
    want = Counter(r["doc_id"] for r in by_sql(kept["documents"], oracles.quality_sql()) if r["kept"])
    assert Counter(r["doc_id"] for r in kept["quality"].collect()) == want and 0 < sum(want.values()) < kept["documents"].count()


def test_near(kept):
    rows = kept["quality"].collect()
    found = plain_components([r["text"] for r in rows])
    first = {}
    for r, (_, c) in zip(rows, found):
        first[c] = min([first[c], r["doc_id"]] if c in first else [r["doc_id"]], key=lambda i: (i is None, i))
    assert Counter(r["doc_id"] for r in kept["near"].collect()) == Counter(first.values()) and len(first) < len(rows)


def test_secrets(kept):
    spans = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in by_sql(kept["near"], oracles.secrets_sql())}
    texts = {r["doc_id"]: r["text"] for r in kept["near"].collect()}
    masked = 0
    for r in kept["secrets"].collect():
        out, at = [], 0
        for start, end in sorted(spans[r["doc_id"]]):
            if start >= at:
                out += [texts[r["doc_id"]][at:start], "[SECRET]"]
            at = max(at, end)
        want = "".join(out) + texts[r["doc_id"]][at:]
        masked += bool(out)
        assert r["text"] == want and (not out or r["n_chars"] == len(want))
    assert masked > 0 and kept["secrets"].count() == kept["near"].count()


def test_mixing(kept):
    want = Counter()
    for r in by_sql(kept["secrets"], oracles.mixing_sql()):
        if r["size"]:
            want[r["doc_id"]] += r["taken"] // r["size"]
    assert Counter(r["doc_id"] for r in kept["mixing"].filter(F.trim("text") != "").collect()) == +want


def test_packing(kept):
    encode, rows = tokens.encoder(), kept["packing"].collect()
    want = Counter(r["doc_id"] for r in kept["mixing"].collect())
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == want
    sizes = Counter()
    for r in kept["mixing"].collect():
        sizes[r["doc_id"]] += len(encode(r["text"] or "")) + 1
    got, bins = Counter(), {}
    for r in rows:
        got[r["doc_id"]] += r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    assert got == sizes
    for parts in bins.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_empty(spark, kept):
    docs = kept["documents"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0
