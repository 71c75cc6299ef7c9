"""Similar texts, conversations and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .similar import bigrams, gram_weights, similar_texts  # noqa: F401  similar_texts and similar_vectors are operators of this module
from .vectors import similar_vectors  # noqa: F401

FENCE = r"(?s)```[A-Za-z0-9_+-]*[ \t]*\n(.*?)```"


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, w: tf * (ln((n + 1) / (df + 1)) + 1), each text scaled to length 1."""
    tf = bigrams(df, key, text)
    raw = tf.join(gram_weights(tf, df), "gram").select(key, "gram", "idf", (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", "idf", (F.col("x") / F.col("norm")).alias("w"))


def append_new(known: DataFrame, new: DataFrame, query: str) -> DataFrame:
    """known and those of new whose id (custom_ and eight hex digits of the query) is not there yet; one row per id."""
    named = new.withColumn("id", F.concat(F.lit("custom_"), F.substring(F.md5(query), 1, 8))).dropDuplicates(["id"])
    return known.unionByName(named.join(known.select("id"), "id", "left_anti"), allowMissingColumns=True)


def examples_of(known: DataFrame, category: str, value: str, order: str, k: int = 2) -> DataFrame:
    """The first k examples of a category by `order`; where it has none, the first k of all."""
    hits = known.withColumn("_other", F.when(F.col(category) == value, 0).otherwise(1))
    least = hits.agg(F.min("_other").alias("_least"))
    return hits.join(F.broadcast(least)).filter((F.col("_other") == 0) | (F.col("_least") == 1)).orderBy(order).limit(k).drop("_other", "_least")


def search_chats(chats: DataFrame, keywords: list[str], most: int = 5, fence: str = FENCE) -> DataFrame:
    """conv_id, query, code: user turns with any keyword whose next turn is an assistant's with a code block; newest chats first, one per beginning."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    words = [w for w in keywords if len(w) > 1]
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.lower("text").contains(w.lower())
    found = chats.withColumns({"_role": F.lead("role").over(turn), "_text": F.lead("text").over(turn)})
    found = found.filter((F.col("role") == "user") & any_word & (F.col("_role") == "assistant") & F.col("_text").rlike(fence))
    found = found.select("conv_id", "turn", F.substring("text", 1, 80).alias("query"), F.regexp_extract("_text", fence, 1).alias("code"))
    first = F.row_number().over(Window.partitionBy(F.substring("query", 1, 20)).orderBy(F.desc("conv_id"), "turn"))
    return found.withColumn("_n", first).filter("_n = 1").orderBy(F.desc("conv_id"), "turn").limit(most).select("conv_id", "query", "code")


def chat_list(chats: DataFrame, default: str = "new") -> DataFrame:
    title = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 28)), F.when(F.col("role") == "user", F.col("turn")))
    return chats.groupBy("conv_id").agg(F.coalesce(title, F.lit(default)).alias("title"))


def markdown(chats: DataFrame) -> DataFrame:
    """conv_id, document: the turns in order, each under its role."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return chats.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"])), "\n\n").alias("document"))


def recent_context(chats: DataFrame, turns: int = 6, width: int = 150) -> DataFrame:
    """conv_id, turn, role, text of the last turns before the newest one, on one line each."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return chats.withColumn("_n", back).filter((F.col("_n") > 1) & (F.col("_n") <= turns + 1)).select("conv_id", "turn", "role", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, width).alias("text"))


def classify(df: DataFrame, text: str, keywords: dict[str, list[str]], default: str) -> DataFrame:
    """df with intent and hits: the category of which most keywords occur, the first of equals; none: default."""
    low = F.lower(text)
    hits = {k: sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w in v), F.lit(0)) for k, v in keywords.items()}
    best = F.greatest(*hits.values()) if len(hits) > 1 else next(iter(hits.values()))
    which = F.when(F.coalesce(best, F.lit(0)) == 0, default)
    for k, h in hits.items():
        which = which.when(h == best, k)
    return df.withColumns({"intent": which, "hits": F.coalesce(best, F.lit(0))})


def merge_kind(text: Column, union_hints: list[str], join_hints: list[str]) -> Column:
    """What kind of merge a text asks for: union, join or plain."""
    any_of = lambda hints: sum((F.when(F.lower(text).contains(h.lower()), 1).otherwise(0) for h in hints), F.lit(0)) > 0
    return F.when(any_of(union_hints), "union").when(any_of(join_hints), "join").otherwise("plain")


def code_block(df: DataFrame, text: str, fence: str = FENCE) -> DataFrame:
    """df with code (the first fenced block, or null) and said (the text before it)."""
    has = F.col(text).rlike(fence)
    return df.withColumns({"code": F.when(has, F.regexp_extract(text, fence, 1)), "said": F.trim(F.when(has, F.substring_index(text, "```", 1)).otherwise(F.col(text)), F.lit(" \t\r\n"))})


def runs_per_label(runs: DataFrame, label: str, names: dict[str, str] | None = None) -> DataFrame:
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), label), F.col(label)) if names else F.col(label)
    return runs.groupBy(shown.alias("label")).agg(F.count("*").alias("runs"))


def success_rate(runs: DataFrame, success: str = "success", session: str | None = None) -> DataFrame:
    rate = F.coalesce(F.avg(F.col(success).cast("double")), F.lit(0.0)).alias("success_rate")
    return runs.groupBy(session).agg(rate) if session else runs.agg(rate)


def chains(runs: DataFrame, session: str, order: str, label: str, success: str, last: int = 6, arrow: str = " → ") -> DataFrame:
    """session, chain: labels of the successful ones of the last runs, in order."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    recent = runs.withColumn("_n", back).filter(F.col("_n") <= last)
    steps = F.array_sort(F.collect_list(F.when(F.col(success), F.struct(F.col(order).alias("o"), F.col(label).alias("l")))))
    return recent.groupBy(session).agg(F.array_join(F.transform(steps, lambda s: s["l"]), arrow).alias("chain"))


def stage_durations(stages: DataFrame) -> DataFrame:
    """run, stage, duration_ms (of its first entry), total_ms (of the run)."""
    per = stages.groupBy("run", "stage").agg(F.min_by("duration_ms", "started_at").alias("duration_ms"))
    return per.join(stages.groupBy("run").agg(F.sum("duration_ms").alias("total_ms")), "run")
