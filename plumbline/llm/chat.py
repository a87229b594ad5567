"""Chat formatting: a state machine over roles, segments with loss flags, from a declarative template (operator 2).

DataFrame functions only. A template marks each turn by an opening and a closing string. Inside texts (and unknown role
names) the escape character is doubled and every control string gets one after its first character, so no control string
is left in them and unescaping gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """turns: role -> (opening, closing, whether its text counts for the loss). Other roles are named between ``other`` strings.

    moves: (state, role) -> state; a conversation starts in "start" and may end in the states of ``ends``. A turn that no move
    allows is an error, and the machine goes on in the state named as the turn's role.
    """

    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({s.strip() for t in self.turns.values() for s in t[:2]} | {s.strip() for s in self.other}, key=lambda s: (-len(s), s))


def escaped(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + ESCAPE + s[1:])), template.controls(), doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, t: Template) -> Column:
    """The turn's three segments: opening, text, closing, each with its loss flag."""
    role, text = turn["role"], escaped(turn["text"], t)
    segment = lambda s, loss: F.struct(s.alias("text"), F.lit(loss).alias("loss"))
    given = lambda a, b, loss: F.array(segment(F.lit(a), False), segment(text, loss), segment(F.lit(b), False))
    out = F.array(segment(F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1])), False), segment(text, False), segment(F.lit(t.other[2]), False))
    for name, (a, b, loss) in t.turns.items():
        out = F.when(role == name, given(a, b, loss)).otherwise(out)
    return out


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, segments, valid, first_error): one row a conversation.

    Turns are ordered by turn, then role and text (ties, nulls first). A null text or role is taken as empty. first_error is the
    place (from 0) of the first turn that no move allows, or null; valid also asks for an end state. Rows without a conv_id are
    one conversation. A conversation is one row of the result, so its turns do meet in one task.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*(F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)))

    def step(state: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(state["state"], F.lit("\n"), turn["role"]))
        return F.struct(
            F.coalesce(to, turn["role"]).alias("state"),
            F.when(to.isNull() & state["error"].isNull(), state["at"]).otherwise(state["error"]).alias("error"),
            (state["at"] + 1).alias("at"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("error"), F.lit(0).alias("at"))
    out = turns.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
        F.aggregate("turns", start, step).alias("end"),
    )
    return out.select(
        "conv_id",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        (F.col("end.error").isNull() & F.col("end.state").isin(*template.ends)).alias("valid"),
        F.col("end.error").alias("first_error"),
    )


def parsed(text: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    lazy = lambda a, b: re.escape(a) + ".*?" + re.escape(b)
    kinds = [lazy(a, b) for a, b, _ in template.turns.values()] + [lazy(template.other[0], template.other[1]) + ".*?" + re.escape(template.other[2])]
    # a lazy stretch can't run past the closing string, as texts have no control strings
    whole = F.regexp_extract_all(text, F.lit("(?s)" + "|".join(kinds)), F.lit(0))

    def read(turn: Column) -> Column:
        a, b, c = template.other
        body = F.substring(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(c))
        cut = F.instr(body, F.lit(b))
        out = F.struct(unescaped(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(body, cut + len(b), F.length(body))).alias("text"))
        for name, (a, b, _) in template.turns.items():
            out = F.when(F.startswith(turn, F.lit(a)), F.struct(F.lit(name).alias("role"), unescaped(F.substring(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(b))).alias("text"))).otherwise(out)
        return out

    return F.transform(whole, read)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (-1L, 0L, 'user'), (-1L, 1L, 'assistant') as t(conv_id, turn, role)")
    out = formatted(rows.union(extra)).withColumn("turns", parsed(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The same by SQL from the input: formatting and reading back must change nothing. formatted_chars adds the marks and escapes.
OP2_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7
    + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[ROLE]', ''))) // 6
    + (length(text) - length(replace(text, '[TEXT]', ''))) // 6 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '<s>', ''))) // 3
    + case role when 'system' then 15 when 'user' then 15 when 'assistant' then 7 else 23 + length(role) end as chars,
    lag(role, 1, 'start') over (partition by conv_id order by turn, role, text) as before,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars,
  bool_and((before, role) in (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    and bool_or(back = 1 and role = 'assistant') as valid
from e group by conv_id
"""
