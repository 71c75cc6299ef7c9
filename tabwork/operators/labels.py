"""Labels of one table matched with labels of another, by containment either way or by one edit.

Which labels contain which is found by automata (Aho-Corasick) over blocks of the labels that are looked for. A label of three
characters or more goes to the block of one of its trigrams, the one of least hash; a label that is looked through goes to the
blocks of all its trigrams, so it meets every label it can contain, and its copies are linear in its length. Blocks that hold too
many characters, such as those of a very frequent trigram, are cut on both sides. Labels of up to two characters and labels
within one edit meet by equal keys.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: characters of the labels of one side that one task holds at a time
BLOCK = 1 << 21
#: a table of so many rows at most (of three numbers) is broadcast
SMALL = 1 << 17
#: how many characters of two labels are compared for edits, and the largest difference of their lengths (fixed values)
HEAD, GAP = 20, 3
# what two labels share: the left or the right one as a whole; within one edit: all, all but one character of either, or
# (kinds from 1) all but the character at a place
LEFT_IN_RIGHT, RIGHT_IN_LEFT, SAME, LESS_LEFT, LESS_RIGHT = 0, -1, -2, -3, -4


def match_labels(left: DataFrame, right: DataFrame, left_label: str, right_label: str, right_order: str, block: int = BLOCK) -> DataFrame:
    """Each left label with the first right label it contains or that contains it (case ignored), else within one edit of its first 20 characters.

    One row per different left label that matches. Of right labels with equal order the smaller is first; a null order is before
    all others, NaN after. Null labels match nothing, an empty one is contained in every label. One small job counts characters.
    """
    named = lambda df, label: df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_label"), F.lower(label).alias("_low"), F.char_length(label).alias("_n"), *([F.col(right_order).alias("_order")] if df is right else []))
    a = named(left.select(left_label).distinct(), left_label)
    b = named(right, right_label)
    # labels that differ by case only are looked for once: lengths count in edits, so these keep all rows
    mine = a.select("_low").distinct()
    theirs = b.groupBy("_low").agg(F.min(F.struct("_order", F.col("_label").alias("_right"))).alias("_first")).select("_low", "_first._order", "_first._right")
    size = F.coalesce(F.sum(F.char_length("_low")), F.lit(0)).alias("n")
    chars = mine.agg(size).unionAll(theirs.agg(size)).agg(F.max("n")).first()[0]
    blocks = max(1, -(-chars // block))
    kinds = {f.name: f.dataType for f in theirs.schema}
    best = T.StructType([T.StructField("_low", T.StringType()), T.StructField("_order", kinds["_order"]), T.StructField("_right", kinds["_right"])])
    found = _held(theirs, mine, blocks, block, _first_within, best).unionByName(_held(mine, theirs, blocks, block, _first_around, best)).unionByName(_brief(mine, theirs))
    sure = a.join(found.groupBy("_low").agg(F.min(F.struct("_order", "_right")).alias("_first")), "_low").select("_label", F.lit(0).alias("level"), "_first")
    out = sure.unionByName(_close(a, b)).groupBy("_label").agg(F.min(F.struct("level", "_first")).alias("_best"))
    return out.select(F.col("_label").alias(left_label), F.col("_best._first._right").alias("matched"))


def _trigrams() -> Column:
    chars = F.split("_low", "")
    rest = lambda at: F.slice(chars, F.lit(at), F.size(chars))
    both = F.zip_with(F.zip_with(chars, rest(2), lambda x, y: F.concat(x, y)), rest(3), lambda x, y: F.concat(x, y))
    return F.transform(F.slice(both, F.lit(1), F.size(chars) - 2), lambda g: F.xxhash64(g))


def _held(wanted: DataFrame, texts: DataFrame, blocks: int, block: int, solve: Callable[[pa.Table, pa.Table], pa.Table], best: T.StructType) -> DataFrame:
    """What solve finds of the wanted labels (of three characters or more) inside the texts, block by block."""
    long = F.char_length("_low") >= 3
    # the length again after the lower case, which may change it
    w = wanted.filter(long).select("*", F.pmod(F.array_min(_trigrams()), F.lit(blocks)).alias("_g"))
    t = texts.filter(long).select("*", F.explode(F.array_distinct(F.transform(_trigrams(), lambda h: F.pmod(h, F.lit(blocks))))).alias("_g"))
    parts = lambda df, name: df.groupBy("_g").agg(F.ceil(F.sum(F.char_length("_low")) / block).alias(name))
    cut = parts(w, "_w").join(parts(t, "_t"), "_g")
    cut = F.broadcast(cut) if blocks <= SMALL else cut
    own = lambda n: F.pmod(F.xxhash64("_low"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    w = w.join(cut, "_g").select(*wanted.columns, "_g", own("_w").alias("_i"), each("_t").alias("_j"))
    t = t.join(cut, "_g").select(*texts.columns, "_g", each("_w").alias("_i"), own("_t").alias("_j"))
    place = ["_g", "_i", "_j"]
    return w.groupBy(*place).cogroup(t.groupBy(*place)).applyInArrow(solve, best)


def _by_order(row: tuple) -> tuple:
    """Rows in Spark's order: null, values, NaN; ties by the label."""
    order, right = row
    return (0 if order is None else 2 if order != order else 1, None if order is None or order != order else order, right)


def _automaton(texts: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, text in enumerate(texts):
        machine.add_word(text, i)
    machine.make_automaton()
    return machine


def _rows(labels: list[str], picked: list[int], right: pa.Table) -> pa.Table:
    return pa.table([pa.array(labels, right.schema.field("_low").type), *[right.column(c).take(pa.array(picked, pa.int64())) for c in ("_order", "_right")]], ["_low", "_order", "_right"])


def _ranked(right: pa.Table) -> list[int]:
    """Row numbers of the right labels, the first of them by order first."""
    keys = list(map(_by_order, zip(right.column("_order").to_pylist(), right.column("_right").to_pylist())))
    return sorted(range(len(keys)), key=keys.__getitem__)


def _first_within(right: pa.Table, left: pa.Table) -> pa.Table:
    """For each left label the first right label that it contains."""
    order, labels, picked = _ranked(right), [], []
    if order and left.num_rows:
        low = right.column("_low").to_pylist()
        machine = _automaton([low[i] for i in order])
        for text in left.column("_low").to_pylist():
            at = min((i for _, i in machine.iter(text)), default=None)
            if at is not None:
                labels.append(text)
                picked.append(order[at])
    return _rows(labels, picked, right)


def _first_around(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each left label the first right label that contains it."""
    wanted, found = left.column("_low").to_pylist(), {}
    if wanted and right.num_rows:
        machine, low = _automaton(wanted), right.column("_low").to_pylist()
        for i in _ranked(right):
            for _, at in machine.iter(low[i]):
                found.setdefault(at, i)
    return _rows([wanted[at] for at in found], list(found.values()), right)


def _keys(kind: int, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("text"), t))


def _brief(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Containment of labels of up to two characters: they are keys, as is what the other side's labels hold of that length."""
    chars = F.split("_low", "")
    pairs = F.slice(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda x, y: F.concat(x, y)), F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0)))
    held = F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.col("_low") == "", F.array().cast("array<string>")).otherwise(F.concat(chars, pairs))))
    whole = F.when(F.char_length("_low") <= 2, F.array("_low")).otherwise(F.array().cast("array<string>"))
    a = mine.select("_low", F.inline(F.concat(_keys(LEFT_IN_RIGHT, whole), _keys(RIGHT_IN_LEFT, held))))
    b = theirs.select("_order", "_right", F.inline(F.concat(_keys(LEFT_IN_RIGHT, held), _keys(RIGHT_IN_LEFT, whole))))
    first = b.groupBy("kind", "text").agg(F.min(F.struct("_order", "_right")).alias("_first"))
    return a.join(first, ["kind", "text"]).select("_low", "_first._order", "_first._right")


def _close(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels within one edit: heads of equal text, or equal text without one character, for each length that is near enough."""
    head = F.substring("_low", 1, HEAD)

    def near(less: int, whole: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.char_length(head)), lambda i: F.named_struct(F.lit("kind"), i, F.lit("text"), F.concat(F.substring(head, F.lit(1), i - 1), F.substring(head, i + 1, F.lit(HEAD)))))
        return F.concat(_keys(SAME, F.array(head)), _keys(whole, F.array(head)), _keys(less, F.array_distinct(F.transform(cut, lambda c: c["text"]))), cut)

    def keyed(df: DataFrame, keys: Column, sizes: Column, *columns: str) -> DataFrame:
        return df.filter("_n >= 2 and _low <> ''").select(*columns, keys.alias("_keys"), F.explode(sizes).alias("size")).select(*columns, "size", F.inline("_keys"))

    mine = keyed(a, near(LESS_LEFT, LESS_RIGHT), F.sequence(F.col("_n") - GAP, F.col("_n") + GAP), "_label")
    theirs = keyed(b, near(LESS_RIGHT, LESS_LEFT), F.array("_n"), "_label", "_order")
    first = theirs.groupBy("size", "kind", "text").agg(F.min(F.struct("_order", F.col("_label").alias("_right"))).alias("_first"))
    return mine.join(first, ["size", "kind", "text"]).select("_label", F.lit(1).alias("level"), "_first")
