"""Chat formatting in DataFrame functions only: a finite-state machine over roles, and text segments with
loss flags from a declarative template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sign that takes control strings apart inside texts, and what stands for itself and for a cut.
ESCAPE, ITSELF, CUT = "␛", "␛0", "␛1"


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (before, after) a turn's text; ``other`` has those of any role not named, around the
    role, and around the text. ``begin`` and ``end`` enclose a conversation. ``loss``: roles that are learnt.
    ``order``: state -> {role: next state}, from ``start``; ``final`` states may end a conversation."""

    begin: str = "<s>"
    end: str = "</s>"
    turns: dict = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "[/ANS]")})
    other: tuple = ("[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]")
    loss: tuple = ("assistant",)
    start: str = "start"
    order: dict = field(default_factory=lambda: {"start": {"system": "asked", "user": "user"}, "asked": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({self.begin, self.end, *(x for p in self.turns.values() for x in p), *self.other})

    def check(self) -> None:
        """Markers may hold their first sign nowhere else, so none can arise where a text meets a marker."""
        firsts = {c[:1] for c in self.controls}
        if "" in firsts or any(x in c[1:] for c in self.controls for x in firsts) or any(ESCAPE in c for c in self.controls):
            raise ValueError("control strings must not be empty, nor hold a first sign of one after their own")


LLAMA_LIKE = Template()


def escaped(text: Column, template: Template = LLAMA_LIKE) -> Column:
    """``text`` without any control string; ``unescaped`` gives it back."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ITSELF))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + CUT + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(CUT), F.lit("")), F.lit(ITSELF), F.lit(ESCAPE))


def _by_role(role: Column, template: Template, which: int, other: Column) -> Column:
    out = other
    for name, marks in template.turns.items():
        out = F.when(role == name, F.lit(marks[which])).otherwise(out)
    return out


def validity(roles: Column, template: Template = LLAMA_LIKE) -> Column:
    """(valid, error_turn): runs the machine over an array of roles; error_turn is the first place that no
    rule allows (from 0), the number of turns if only the end is wrong, null if all is well."""
    steps = F.create_map(*[x for s, to in template.order.items() for r, t in to.items() for x in (F.lit(f"{s}\n{r}"), F.lit(t))])
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc, role):
        to = F.when(acc["bad"].isNull(), steps[F.concat(acc["state"], F.lit("\n"), role)])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["n"] + 1).alias("n"), F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"])).alias("bad"))

    def finish(acc):
        bad = F.coalesce(acc["bad"], F.when(~acc["state"].isin(*template.final), acc["n"]))
        return F.struct(bad.isNull().alias("valid"), bad.alias("error_turn"))

    return F.aggregate(roles, start, step, finish)


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = LLAMA_LIKE) -> DataFrame:
    """One row for each conversation: ``conv_id, valid, error_turn, segments, formatted``.

    ``segments`` is an array of (text, loss): markers and escaped texts in order; ``formatted`` joins them.
    Turns are ordered by turn (null first), ties by role and text, repeated rows included. A null text or
    role is an empty one; a role that the template doesn't name is kept, between the template's
    ``other`` marks; an order that the machine forbids is flagged and formatted all the same. A row
    whose conversation id is null belongs to no other row's conversation: it is one of its own, with a null id. An empty table gives an empty
    result; other columns are not read.
    """
    template.check()
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    grouped = turns.select(F.col(conv_col).alias("conv_id"), alone.alias("alone"), row.alias("row")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    o = template.other

    def segments(r):
        role = r["role"]
        before = _by_role(role, template, 0, F.concat(F.lit(o[0]), escaped(role, template), F.lit(o[1] + o[2])))
        after = _by_role(role, template, 1, F.lit(o[3]))
        plain = F.lit(False)
        return F.array(F.struct(before.alias("text"), plain.alias("loss")), F.struct(escaped(r["text"], template).alias("text"), role.isin(*template.loss).alias("loss")), F.struct(after.alias("text"), plain.alias("loss")))

    edge = lambda s: F.array(F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss")))
    out = grouped.withColumn("v", validity(F.transform("rows", lambda r: r["role"]), template)).withColumn("segments", F.concat(edge(template.begin), F.flatten(F.transform("rows", segments)), edge(template.end)))
    return out.select("conv_id", "v.valid", "v.error_turn", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def turns_of(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    q = re.escape
    o = template.other
    opens = "|".join([q(a) for a, _ in template.turns.values()] + [f"{q(o[0])}(?:(?!{q(o[1])}).)*+{q(o[1])}{q(o[2])}"])
    closes = "|".join([q(z) for _, z in template.turns.values()] + [q(o[3])])
    # a text holds no control string, so what lies between a mark that opens and one that closes is one text
    inside = F.substring(formatted, len(template.begin) + 1, F.length(formatted) - len(template.begin) - len(template.end))
    turns = F.slice(F.split(inside, f"(?<={closes})", -1), 1, F.greatest(F.size(F.split(inside, f"(?<={closes})", -1)) - 1, F.lit(0)))
    by_mark = F.create_map(*[F.lit(x) for r, (a, _) in template.turns.items() for x in (a, r)])

    def read(t):
        mark = F.regexp_extract(t, f"(?s)^({opens})", 1)
        rest = F.substring(t, F.length(mark) + 1, F.length(t))
        text = F.regexp_replace(rest, f"({closes})$", "")
        named = F.substring(mark, len(o[0]) + 1, F.length(mark) - len("".join(o[:3])))
        return F.struct(unescaped(F.coalesce(by_mark[mark], named)).alias("role"), unescaped(text).alias("text"))

    return F.transform(turns, read)


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
