"""Quality rules: counted base rules, then distribution divergence. The character classes and the common words of a
document are compared with the reference of its language by Jensen-Shannon distance; short documents are not judged.

Only DataFrame functions. The text is read once: `measured` puts all counts of a document beside it, the references are
sums of these counts over every document that passes the base rules, and the verdict compares the two.

Defined results for odd input: a null text has no words and fails the base rules; a null language is a language of its
own; a language without a word list is judged by its character classes alone; repeated rows are judged alike; an empty
table gives an empty table; input columns of any name are kept, the added ones give way (`free_name`); a text of any
length is measured whole, in one row. Five-word windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANK, free_name, quoted, saved, settled, text_of

#: The function words whose shares are compared, by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that it for on was with as be at by this are from".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le les et des un une en du que est pour qui dans par sur au pas plus".split(),
}
CLASSES = ("lower", "blank", "upper", "digit", "symbol", "mark", "other")
#: a whole word without a letter or digit
BARE_WORD = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
N_WORDS = 1 + max(map(len, COMMON_WORDS.values()))


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    #: a document fails if more than this share of its words lies in five-word windows that it repeats
    max_repeat_percent: int = 20
    #: the classes are judged from this many characters on, the words from this many words on
    guard_chars: int = 200
    guard_words: int = 60
    max_class_distance: float = 0.34
    max_word_distance: float = 0.325
    #: references up to this many languages are broadcast; beyond it the join is left to Spark
    broadcast_languages: int = 2000
    #: words without a letter or digit are a class of the word histogram of their own
    bare_class: bool = True
    #: if set, the word distance may exceed what chance alone gives at the document's length by this much at most
    word_margin: float | None = 0.1


def measured(docs: DataFrame, name: str, rules: Rules = Rules()) -> DataFrame:
    """docs with a struct column `name`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, words (and n_bare with bare_class).

    Each step is a column of its own: what stands inside a lambda or is taken from a struct would be worked out again for
    every element and every use. The struct is settled, so the result may be filtered, summed and joined.
    """
    text = text_of()
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({form for v in COMMON_WORDS.values() for w in v for form in (w, w.capitalize())})
    prefix = free_name(docs, "_measure_")

    def add(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({prefix + k: c for k, c in columns.items()})

    def at(k: str) -> Column:
        return F.col(prefix + k)

    def count(pattern: str) -> Column:
        return (F.char_length(at("rare")) - F.char_length(F.regexp_replace(at("rare"), pattern, ""))).cast("long")

    none = F.array().cast("array<bigint>")
    out = add(
        docs,
        tokens=F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.split(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), BLANK, -1)).otherwise(F.array().cast("array<string>")),
        rare=F.regexp_replace(text, "[a-z\\x20\\x09-\\x0D]+", ""),
        lines=F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    out = add(
        out,
        n=F.size(at("tokens")),
        hashes=F.transform(at("tokens"), lambda w: F.xxhash64(w)),
        common=F.transform(F.filter(at("tokens"), lambda w: w.isin(*every)), F.lower),
        listed=F.coalesce(F.try_element_at(lists, F.coalesce(F.col("lang").cast("string"), F.lit(""))), F.array().cast("array<string>")),
        chars=F.char_length(text).cast("long"),
        word_chars=F.char_length(F.array_join(at("tokens"), "")).cast("long"),
        upper=count("[A-Z]+"), digit=count("[0-9]+"), symbol=count("[#*$%&|<>]+"), mark=count("[\\x00-\\x7F&&[^A-Za-z0-9#*$%&|<>\\x20\\x09-\\x0D]]+"),
        rares=F.char_length(at("rare")).cast("long"),
    )
    out = add(out, windows=F.when(at("n") >= 6, F.transform(F.sequence(F.lit(1), at("n") - 4), lambda i: F.xxhash64(F.slice(at("hashes"), i, 5)))).otherwise(none))
    # only texts that repeat a window go on: windows by hash, then those with an equal neighbour, then their starts in order
    out = add(out, starts=F.when(F.size(F.array_distinct(at("windows"))) < F.size(at("windows")), F.array_sort(F.transform(at("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = add(out, before=F.concat(F.array(F.lit(None).cast(f"struct<h:bigint,i:int>")), F.slice(at("starts"), F.lit(1), F.greatest(F.size(at("starts")) - 1, F.lit(0)))), after=F.slice(at("starts"), F.lit(2), F.greatest(F.size(at("starts")), F.lit(0))))
    out = add(out, repeated=F.array_sort(F.filter(F.zip_with(F.zip_with(at("starts"), at("before"), lambda s, b: F.struct(s["i"].alias("i"), s["h"].alias("h"), (F.coalesce(s["h"] == b["h"], F.lit(False))).alias("eq"))), at("after"),
                                                             lambda s, a: F.when(s["eq"] | F.coalesce(s["h"] == a["h"], F.lit(False)), s["i"])), lambda i: i.isNotNull())))
    return settled(out, {name: F.struct(
        at("n").cast("long").alias("n_words"), at("word_chars").alias("word_chars"), at("symbol").alias("n_symbols"),
        (F.size(at("lines")) - F.size(F.array_distinct(at("lines")))).cast("long").alias("n_dup_lines"),
        F.coalesce(_spread(at("repeated")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(at("word_chars") - at("rares"), at("chars") - at("word_chars"), at("upper"), at("digit"), at("symbol"), at("mark"), at("rares") - at("upper") - at("digit") - at("symbol") - at("mark")).alias("classes"),
        F.transform(at("listed"), lambda w: F.size(F.filter(at("common"), lambda x: x == w)).cast("long")).alias("words"),
        *([F.regexp_count(text, F.lit(BARE_WORD)).cast("long").alias("n_bare")] if rules.bare_class else []),
    )}, [c for c in docs.columns if c != name])


def _spread(starts: Column) -> Column:
    """Words covered by five-word windows at these starts: each start adds the words up to the next one, five at most."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    return F.aggregate(starts, zero, lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(5))).alias("n"), i.alias("last")), lambda acc: acc["n"])


def base_failed(m: Column, rules: Rules) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def references(measures: DataFrame, name: str, rules: Rules = Rules()) -> DataFrame:
    """lang, and the summed classes, common words, words and bare words of all documents of it that pass the base rules."""
    m = F.col(name)
    total = lambda part, k: [F.coalesce(F.sum(F.get(m[part], i)), F.lit(0)).alias(f"{part}{i}") for i in range(k)]
    k = N_WORDS - 1
    bare = F.sum(m["n_bare"]) if rules.bare_class else F.lit(None).cast("long")
    sums = measures.filter(~base_failed(m, rules)).groupBy("lang").agg(*total("classes", len(CLASSES)), *total("words", k), F.sum(m["n_words"]).alias("all"), bare.alias("bare"))
    return sums.select("lang", F.array(*[f"classes{i}" for i in range(len(CLASSES))]).alias("classes"), F.array(*[f"words{i}" for i in range(k)]).alias("words"), "all", "bare")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares of the same length."""
    def term(a: Column, b: Column) -> Column:
        part = lambda u: F.when(u > 0, u * F.log2(u * 2 / (a + b))).otherwise(0.0)
        return (part(a) + part(b)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, v: s + v), F.lit(0.0)))


def chance_distance(classes: Column, n: Column) -> Column:
    """About the distance that n draws from the reference itself have from it: n * 8 ln 2 times its square is chi-square distributed."""
    return F.sqrt((classes - 1) / (8 * math.log(2) * F.greatest(n, F.lit(1))))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x.cast("double"), total), F.lit(0.0)))


def judged(measures: DataFrame, name: str, rules: Rules = Rules(), refs: DataFrame | None = None) -> DataFrame:
    """measures (a saved table, as it is read twice) with base_failed, class_distance, word_distance and kept in the struct `name`.

    refs: references of another table (as `references` gives them), so that verdicts stay as they are while a corpus grows.
    """
    refs = saved(references(measures, name, rules) if refs is None else refs, "references")
    p = free_name(measures, "_judge_")
    small = refs.limit(rules.broadcast_languages + 1).count() <= rules.broadcast_languages
    named = refs.select(*[F.col(c).alias(p + c) for c in refs.columns])
    joined = measures.join(F.broadcast(named) if small else named, F.col("lang").eqNullSafe(F.col(p + "lang")), "left")
    m, at = F.col(name), lambda c: F.col(p + c)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    bare, ref_bare = ([m["n_bare"]], [at("bare")]) if rules.bare_class else ([], [])
    if rules.bare_class:
        # the reference's bare words count up to the document's share of them: to have fewer is no fault, however many the others have
        some = (at("all") - at("bare")) * F.try_divide(m["n_bare"].cast("double"), m["n_words"] - m["n_bare"])
        joined = joined.withColumns({p + "all": at("all") - at("bare") + F.least(at("bare"), some), p + "bare": F.least(at("bare"), some)})
    # the words outside the list are one more class
    steps = joined.withColumns({
        p + "p_words": F.concat(m["words"], F.array(*bare, sum((-x for x in bare), m["n_words"] - total(m["words"])))), p + "words": F.slice(at("words"), F.lit(1), F.size(m["words"])),
        p + "p_chars": total(m["classes"]), p + "q_chars": total(at("classes"))})
    steps = steps.withColumns({
        p + "d_class": js_distance(shares(m["classes"], at("p_chars")), shares(at("classes"), at("q_chars"))),
        p + "d_word": js_distance(shares(at("p_words"), m["n_words"]), shares(F.concat(at("words"), F.array(*ref_bare, sum((-x for x in ref_bare), at("all") - total(at("words"))))), at("all")))})
    fails = base_failed(m, rules)
    class_d = F.when(at("all").isNotNull() & (at("p_chars") >= rules.guard_chars), at("d_class")).otherwise(0.0)
    word_d = F.when(at("all").isNotNull() & (m["n_words"] >= rules.guard_words), at("d_word")).otherwise(0.0)
    word_limit = F.lit(rules.max_word_distance)
    if rules.word_margin is not None:
        word_limit = F.least(word_limit, rules.word_margin + chance_distance(F.size(at("p_words")), m["n_words"]))
    return steps.select(*[quoted(c) for c in measures.columns if c != name], F.struct(
        f"{name}.*", fails.alias("base_failed"), class_d.alias("class_distance"), word_d.alias("word_distance"),
        (~fails & (class_d <= rules.max_class_distance) & (word_d <= word_limit)).alias("kept")).alias(name))


def quality_filter(docs: DataFrame, rules: Rules = Rules(), refs: DataFrame | None = None) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    name = free_name(docs, "quality")
    return judged(saved(measured(docs, name, rules), "measures"), name, rules, refs).filter(F.col(name)["kept"]).select(*[quoted(c) for c in docs.columns])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = judged(saved(measured(docs, "quality").drop("text"), "measures"), "quality")
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], *[F.round(f"quality.{c}", 6).alias(c) for c in ("class_distance", "word_distance")])
