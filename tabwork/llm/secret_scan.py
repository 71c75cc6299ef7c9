"""Secret scans: patterns for known secrets, and sliding-window Shannon entropy over long mixed strings.

Only DataFrame functions. A pattern's matches and the pieces between them (`regexp_extract_all` and `split` with the same
pattern) give every span in code points. The entropy of a window follows from the window before it: one count goes up,
one goes down, and the sum of n * log2(n) changes by their terms alone (counts are packed, a byte each, eight to a long).
Spans of patterns are blotted out of the text before candidates are looked for, so what is left of a candidate on either
side of one is a candidate by itself, where it has room for a window.

The work on a text is in proportion to its length and its matches: running sums over matches go by chunks of 64 on two
levels, and pieces of text are taken from chunks of it, never from its beginning.

Defined results for odd input: a null text counts as empty and has no spans; repeated rows get equal results; an empty
table gives an empty table; input columns of any name are kept, the added one gives way (`free_name`); a text of any
length is scanned whole, in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, quoted, settled, text_of

#: What a secret of each kind looks like, in the order of kinds.
ASSIGN = r"""(?=[pPsStTaA])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
_SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class EntropyRules:
    candidate: str = r"[A-Za-z0-9+/_=-]{20,}"
    window: int = 20
    #: least entropy in bits of a window, by the narrowest class that holds the whole candidate
    classes: tuple[tuple[str, str, float], ...] = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
    #: a candidate is looked at only if it has a letter and a digit and does not match the allow-list
    needs: tuple[str, ...] = (r"[A-Za-z]", r"[0-9]")
    allowed: str = r"(?i)example|sample|dummy|placeholder|changeme|lorem|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|(.)\1{7}|0123456789|abcdefgh"


def _placed(text: Column, pattern: str) -> tuple[Column, Column]:
    """The pieces between the matches, and the matches; null where there is no match."""
    has = text.rlike(pattern)
    return F.when(has, F.split(text, pattern, -1)), F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _before(df: DataFrame, x: str, join, levels: int = 2, size: int = 64) -> DataFrame:
    """df with x_before: for each element of the array of ints x, `join` of 0 and all elements before it.

    Chunks of `size` are worked through one by one, and the totals of chunks likewise, so no array grows by copies of itself.
    """
    def small(values: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    last = [x]
    for k in range(levels):
        values, chunks, totals = last[-1], f"{x}_chunks{k}", f"{x}_totals{k}"
        count = F.ceil(F.size(values) / size).cast("int")
        df = df.withColumn(chunks, F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(values, c * size + 1, F.lit(size)))))
        df = df.withColumn(totals, F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), join)))
        last.append(totals)
    top = f"{x}_top"
    df = df.withColumn(top, small(F.col(last[-1]), F.lit(0)))
    for k in reversed(range(levels)):
        name = f"{x}_before" if k == 0 else f"{x}_before{k}"
        df = df.withColumn(name, F.flatten(F.zip_with(f"{x}_chunks{k}", top, small)))
        top = name
    return df


def _located(df: DataFrame, x: str) -> DataFrame:
    """df with the array x of struct<start, end, text> of the matches; x_p and x_m hold the pieces between them and the matches."""
    pieces, matches = F.col(f"{x}_p"), F.col(f"{x}_m")
    df = df.withColumn(f"{x}_n", F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.char_length(p) + F.char_length(m)))
    df = _before(df, f"{x}_n", lambda a, b: a + b)
    starts = F.zip_with(f"{x}_n_before", F.slice(pieces, F.lit(1), F.size(matches)), lambda b, p: b + F.char_length(p))
    found = F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("text")))
    return df.withColumn(x, F.coalesce(found, F.array().cast("array<struct<start:int,end:int,text:string>>")))


def _gaps(df: DataFrame, x: str, spans: str, text: Column, chunk: int = 256) -> DataFrame:
    """df with the array x of struct<start, end, text>: what lies outside the spans (ordered by start), before, between and after them; null without spans."""
    some = F.size(spans) > 0
    df = df.withColumn(f"{x}_ends", F.when(some, F.transform(spans, lambda s: s["end"])))
    df = _before(df, f"{x}_ends", lambda a, b: F.greatest(a, b))
    # a span that begins inside those before it opens no gap
    gaps = F.filter(F.zip_with(spans, f"{x}_ends_before", lambda s, b: F.struct(b.alias("start"), s["start"].alias("end"))), lambda g: g["start"] <= g["end"])
    df = df.withColumns({f"{x}_all": F.when(some, F.concat(gaps, F.array(F.struct(F.array_max(f"{x}_ends").alias("start"), F.char_length(text).alias("end"))))),
                         f"{x}_text": F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))})

    def cut(g: Column) -> Column:
        first = F.floor(g["start"] / chunk).cast("int")
        joined = F.array_join(F.slice(f"{x}_text", first + 1, F.floor(g["end"] / chunk).cast("int") - first + 1), "")
        return F.struct(g["start"].alias("start"), g["end"].alias("end"), F.substring(joined, g["start"] - first * chunk + 1, g["end"] - g["start"]).alias("text"))

    # named outside the lambda too, so that the optimizer does not work it out again inside for each gap
    return df.withColumn(x, F.when(F.size(f"{x}_text") >= 0, F.transform(f"{x}_all", cut)))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def _entropy_spans(candidates: Column, rules: EntropyRules) -> Column:
    """From the first to the last window of each candidate that is as mixed as its class asks."""
    w = rules.window
    least = F.lit(float("inf"))
    for _, pattern, bits in reversed(rules.classes):
        least = (lambda p, b, rest: (lambda t: F.when(t.rlike(p), b).otherwise(rest(t) if callable(rest) else rest)))(pattern, bits, least)
    # each step adds one field, so that no step works out an earlier one again
    x = F.transform(candidates, lambda m: F.struct(m["start"].alias("start"), F.split(m["text"], "").alias("chars"), least(m["text"]).alias("least")))
    x = F.transform(x, lambda m: F.struct(m["start"].alias("start"), m["chars"].alias("chars"), m["least"].alias("least"), F.array_distinct(m["chars"]).alias("alphabet")))
    x = F.transform(x, lambda m: F.struct(
        m["start"].alias("start"), m["least"].alias("least"), F.array_repeat(F.lit(0).cast("long"), F.ceil(F.size(m["alphabet"]) / 8).cast("int")).alias("none"),
        F.transform(m["chars"], lambda c: F.array_position(m["alphabet"], c).cast("int") - 1).alias("ids")))

    def nlogn(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)

    def scan(m: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), m["none"].alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def enter(acc: Column, c: Column) -> Column:
            gone = F.when(acc["i"] >= w, F.get(m["ids"], acc["i"] - w)).otherwise(-1)
            return F.struct(acc["i"].alias("i"), acc["counts"].alias("counts"), acc["sum"].alias("sum"), acc["first"].alias("first"), acc["last"].alias("last"), c.alias("c"), gone.alias("gone"))

        def one(k: Column) -> Column:
            return F.call_function("shiftleft", F.lit(1).cast("long"), (k % 8) * 8)

        def held(counts: Column, k: Column) -> Column:
            return F.call_function("shiftrightunsigned", F.get(counts, F.floor(k / 8).cast("int")), (k % 8) * 8).bitwiseAND(F.lit(255)).cast("int")

        def step(acc: Column, c: Column) -> Column:
            a = enter(acc, c)
            n_in, n_out = held(a["counts"], a["c"]), F.coalesce(held(a["counts"], F.when(a["gone"] >= 0, a["gone"])), F.lit(0))
            moved = F.when(a["c"] == a["gone"], 0.0).otherwise(nlogn(n_in + 1) - nlogn(n_in) + F.when(a["gone"] >= 0, nlogn(n_out - 1) - nlogn(n_out)).otherwise(0.0))
            total = a["sum"] + moved
            counts = F.transform(a["counts"], lambda v, k: v + F.when(k == F.floor(a["c"] / 8), one(a["c"])).otherwise(F.lit(0).cast("long")) - F.when((a["gone"] >= 0) & (k == F.floor(a["gone"] / 8)), one(a["gone"])).otherwise(F.lit(0).cast("long")))
            hit = (a["i"] + 1 >= w) & (F.lit(w).cast("double") * (F.log2(F.lit(float(w))) - m["least"]) >= total - 1e-9)
            return F.struct((a["i"] + 1).alias("i"), counts.alias("counts"), total.alias("sum"),
                            F.when(hit & (a["first"] < 0), a["i"] + 1 - w).otherwise(a["first"]).alias("first"), F.when(hit, a["i"] + 1).otherwise(a["last"]).alias("last"))

        return F.aggregate(m["ids"], zero, step, lambda acc: F.struct((m["start"] + acc["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (m["start"] + acc["last"]).alias("end"), acc["first"].alias("first")))

    hits = F.filter(F.transform(x, scan), lambda s: s["first"] >= 0)
    return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scanned(docs: DataFrame, name: str, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """docs with an array column `name` of struct<start, kind, end>, ordered by start, then kind; to be filtered, summed or joined as any column."""
    text, t = text_of(), free_name(docs, "_scan_")
    out = docs
    for k, pattern in (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{14,}"), ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+")):
        pieces, matches = _placed(text, pattern)
        out = _located(out.withColumns({f"{t}{k}_p": pieces, f"{t}{k}_m": matches}), f"{t}{k}")
    long_enough = F.filter(f"{t}assign", lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 12)
    out = out.withColumn(f"{t}base", F.array_sort(F.concat(_spans(long_enough, "assign"), _spans(F.col(f"{t}access"), "access"), _spans(F.col(f"{t}hex"), "hex"))))
    out = _gaps(out, f"{t}gaps", f"{t}base", text)
    blot = lambda a, b: F.concat(a["text"], F.repeat(F.lit("\0"), F.coalesce(b["start"] - a["end"], F.lit(0))))
    rest = F.array_join(F.zip_with(f"{t}gaps", F.slice(f"{t}gaps", F.lit(2), F.greatest(F.size(f"{t}gaps") - 1, F.lit(0))), blot), "")
    out = out.withColumn(f"{t}rest", F.coalesce(rest, text))
    pieces, matches = _placed(F.col(f"{t}rest"), rf"(?<!{rules.candidate.partition('{')[0]}){rules.candidate}+")
    out = _located(out.withColumns({f"{t}entropy_p": pieces, f"{t}entropy_m": matches}), f"{t}entropy")
    mixed = lambda m: F.lit(True)
    for p in rules.needs:
        mixed = (lambda f, p: lambda m: f(m) & m["text"].rlike(p))(mixed, p)
    out = out.withColumn(f"{t}left", F.filter(f"{t}entropy", lambda m: mixed(m) & ~m["text"].rlike(rules.allowed)))
    extra = F.when(F.size(f"{t}left") > 0, _entropy_spans(F.col(f"{t}left"), rules)).otherwise(F.array().cast(_SPANS))
    return settled(out, {name: F.array_sort(F.concat(f"{t}base", extra))}, [c for c in docs.columns if c != name])


def span_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Each run of overlapping spans becomes `mask`; n_chars, where there is one, follows. Documents without spans stay as they are."""
    name = free_name(docs, "secrets")
    out = _gaps(scanned(docs, name), f"{name}_gaps", name, F.col("text"))
    clean = F.coalesce(F.array_join(F.transform(f"{name}_gaps", lambda g: g["text"]), mask), F.col("text"))
    out = settled(out, {f"{name}_clean": clean}, [*docs.columns, name])
    count = lambda c: F.when(F.size(name) > 0, F.char_length(f"{name}_clean").cast(docs.schema[c].dataType)).otherwise(quoted(c))
    return out.select(*[F.col(f"{name}_clean").alias(c) if c == "text" else count(c).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scanned(docs, "spans")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                      F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
