"""Chat formatting: a finite-state machine over roles checks the order of turns, and what its transitions emit makes the
text segments and their loss flags; states, roles and emissions are a declarative template.

Everything is DataFrame functions. A conversation is one training example, so its turns meet in one row; conversations
are spread over the cluster by a hash of their id.

Defined results for odd input: a null role or text counts as the empty string; a null turn sorts before all others; rows
with equal turn are ordered by role, then text, and repeated rows stay (each is a turn); rows whose conv_id is null form
one conversation with a null id; an empty table gives an empty table; other columns of the input are ignored. Roles that
the template does not know have no transition: the machine stays where it is, reports the conversation as out of order,
and such a turn is learned only if its role is among `learned` and `learn_errors` is set. A text of any length is one
segment, and a conversation's turns must fit one row (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """What stands around each turn, which roles are learned, which orders of roles are right.

    `controls` are strings that must never appear inside a text as themselves: they are replaced by the escape character
    and one letter each, and the escape character by itself plus "0", so `unescape` brings every text back exactly.
    """

    start: str = "<|turn|>"
    after_role: str = "\n"
    end: str = "<|end|>"
    learned: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    escape: str = "\\"
    #: state -> {role: next state}; a role that is missing is an error, and the machine goes on from where it was
    moves: dict = field(default_factory=lambda: {"begin": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepting: tuple[str, ...] = ("answered",)
    #: whether turns of learned roles are learned where they are out of order too
    learn_errors: bool = True

    def __post_init__(self):
        letters = self.letters()
        if len(self.escape) != 1 or any(self.escape in c or not c or c[0].isalnum() for c in self.controls):
            raise ValueError("control strings must be non-empty, free of the escape character, and not start with a letter or digit")
        if len(letters) < len(self.controls) or {self.start, self.end} - set(self.controls):
            raise ValueError("start and end must be control strings, and there is room for 26 of them")

    def letters(self) -> str:
        return "abcdefghijklmnopqrstuvwxyz"

    def codes(self) -> list[tuple[str, str]]:
        # longer control strings first, so that one which contains another is taken whole
        ordered = sorted(self.controls, key=lambda c: (-len(c), c))
        return [(self.escape, self.escape + "0"), *((c, self.escape + x) for c, x in zip(ordered, self.letters()))]


def escape(text: Column, template: Template) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), template.codes(), text)


def unescape(text: Column, template: Template) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(template.codes()), text)


def _machine(roles: Column, template: Template) -> Column:
    """Run the role machine: struct(state, pos, error, loss); error is the 0-based first turn out of order or null, and loss
    holds what the transitions emitted, "1" or "0" for each turn.
    """
    begin = next(iter(template.moves))
    edges = [(state, role, to, role in template.learned) for state, row in template.moves.items() for role, to in row.items()]
    table = F.create_map(*[x for state, role, to, loss in edges for x in (F.lit(f"{state}\x00{role}"), F.struct(F.lit(to).alias("to"), F.lit("1" if loss else "0").alias("loss")))])

    def step(acc: Column, role: Column) -> Column:
        edge = F.try_element_at(table, F.concat(acc["state"], F.lit("\x00"), role))
        stray = F.when(role.isin(*template.learned), "1").otherwise("0") if template.learn_errors else F.lit("0")
        return F.struct(
            F.coalesce(edge["to"], acc["state"]).alias("state"),
            (acc["pos"] + 1).alias("pos"),
            F.coalesce(acc["error"], F.when(edge.isNull(), acc["pos"])).alias("error"),
            F.concat(acc["loss"], F.coalesce(edge["loss"], stray)).alias("loss"),
        )

    zero = F.struct(F.lit(begin).alias("state"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("error"), F.lit("").alias("loss"))
    return F.aggregate(roles, zero, step)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, order_ok, first_error (turn index), segments array<struct<text, loss>>, formatted string."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text"))).alias("turns"))

    def pieces(t: Column, loss: Column) -> Column:
        head = F.concat(F.lit(template.start), _named(t["role"], template), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), (loss == "1").alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    run = chats.select("conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), _machine(F.transform("turns", lambda t: t["role"]), template).alias("m"))
    out = run.withColumn("segments", F.flatten(F.zip_with("turns", F.split("m.loss", ""), pieces)))
    return out.select(
        "conv_id", "n_turns",
        (F.col("m.error").isNull() & F.col("m.state").isin(*template.accepting)).alias("order_ok"),
        F.col("m.error").alias("first_error"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns back from a formatted text: array<struct<role, text>>. Controls inside texts are escaped, so a plain split finds the turns."""
    parts = F.split(formatted, _literal(template.start), -1)
    found = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    cut = len(template.after_role)

    def turn(part: Column) -> Column:
        at = F.instr(part, template.after_role)
        role = F.substring(part, F.lit(1), at - 1)
        text = F.substring(part, at + cut, F.char_length(part) - at - cut + 1 - len(template.end))
        return F.struct(unescape(F.replace(role, F.lit(template.escape + "Z"), F.lit(template.after_role)), template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(found, turn)


def learned_text(said: Column, template: Template = Template()) -> Column:
    """All text under the loss mask in order, with nothing between, of turns read back from a formatted text: the machine runs over their roles once more."""
    flags = F.split(_machine(F.transform(said, lambda t: t["role"]), template)["loss"], "")
    return F.array_join(F.zip_with(said, flags, lambda t, loss: F.when(loss == "1", t["text"])), "")


def _named(role: Column, template: Template) -> Column:
    """A role as it stands in the output; what ends a role is escaped inside it too."""
    return F.replace(escape(role, template), F.lit(template.after_role), F.lit(template.escape + "Z"))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    sample = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sample).alias("text"))
    chats = format_chats(turns.unionByName(extra))
    back = chats.withColumn("said", read_turns(F.col("formatted"))).withColumn("learned", learned_text(F.col("said")))
    return back.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "order_ok")


def oracle() -> str:
    """The same figures from the table alone: what a turn adds to the output is fixed but for its escapes."""
    t = Template()

    def escaped(column: str) -> str:
        for a, b in t.codes():
            column = f"replace({column}, '{a}', '{b}')"
        return column

    fixed = len(t.start) + len(t.after_role) + len(t.end)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({fixed} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars,
  regexp_matches(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn, role, text), '^(su|u)(au)*a$') AS order_ok
FROM turns GROUP BY conv_id"""
