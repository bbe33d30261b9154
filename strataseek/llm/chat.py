"""Chat formatting by a finite-state machine and a declarative template.

All of it is DataFrame expressions. The template names the strings around a turn, the
roles under the loss mask and the machine's transitions. The machine walks the turns of a
conversation and takes one transition for each: a transition out of a state by a role that
the template does not list leads to the error state, which is never left. A transition
says the next state and whether the turn's text is under the loss mask; each turn's
segments are emitted from the transition taken. ``valid`` tells whether the machine ends
in an accepting state; every conversation is formatted either way. Texts are escaped: a
backslash is doubled and the ``<|`` that control strings begin with gets a backslash
between, so no text can hold a control string and reading back is exact.

Null roles and texts are empty; a null conv_id is a conversation of its own; turns of one
number are ordered by role and text; repeated rows are repeated turns. A conversation is
one row, however many turns it has: the walk goes by ``BLOCK`` turns, so that its cost is
in proportion to them. Other columns, whatever their names, are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick


@dataclass(frozen=True)
class Template:
    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("assistant",)

    def machine(self) -> tuple[list[str], list[str], list[int], list[bool]]:
        """States (the first is the start, the last is the error), roles (the last stands for
        all others) and, for transition state * len(roles) + role, the next state and the
        loss flag."""
        states = [*dict.fromkeys([self.start, *(s for s, _ in self.transitions), *self.transitions.values()]), "error"]
        roles = [*dict.fromkeys([r for _, r in self.transitions] + list(self.loss_roles)), ""]
        steps = [(s, r) for s in states for r in roles]
        return states, roles, [states.index(self.transitions.get(x, "error")) for x in steps], [r in self.loss_roles for _, r in steps]


CHATML = Template()
#: Turns that the machine takes at a time.
BLOCK = 256


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def escape_role(x: Column) -> Column:
    """As ``escape``, with line feeds as a backslash and ``n`` put after it."""
    return F.replace(escape(x), F.lit("\n"), F.lit("\\n"))


def unescape_role(x: Column) -> Column:
    parts = F.split(x, r"\\\\", -1)  # between doubled backslashes
    return F.array_join(F.transform(parts, lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n")))), "\\")


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, valid, segments (text, loss) and formatted (their texts joined)."""
    rows = pick(turns, conv_id="bigint", turn="bigint", role="string", text="string")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text")))).alias("turns"))
    states, roles, to, loss = template.machine()
    n_roles, nexts, losses = len(roles), F.array(*[F.lit(x) for x in to]), F.array(*[F.lit(x) for x in loss])
    place = F.create_map(*[x for i, r in enumerate(roles[:-1]) for x in (F.lit(r), F.lit(i))])
    own = lambda t: F.coalesce(F.try_element_at(place, t["role"]), F.lit(n_roles - 1))
    # an array of transitions, the last one taken at its end; before the first, one that leads to the start is not needed: its state is 0
    step = lambda taken, t: F.concat(taken, F.array(F.when(F.size(taken) == 0, own(t)).otherwise(F.get(nexts, F.element_at(taken, -1)) * n_roles + own(t))))
    none = F.array().cast("array<int>")
    walk = lambda block, carried: F.aggregate(block, carried, step)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / BLOCK)), lambda b: F.slice("turns", (b * BLOCK + 1).cast("int"), BLOCK))
    # each block begins with the last transition of the one before it
    carried = lambda done: F.when(F.size(done) == 0, none).otherwise(F.slice(F.element_at(done, -1), -1, 1))
    done = F.aggregate(blocks, F.array().cast("array<array<int>>"), lambda done, block: F.concat(done, F.array(walk(block, carried(done)))))
    taken = F.flatten(F.transform(done, lambda x, i: F.when(i == 0, x).otherwise(F.slice(x, 2, BLOCK))))
    walked = per.withColumn("taken", taken)
    segment = lambda s, flag: F.struct(s.alias("text"), flag.alias("loss"))
    of = lambda t, k: F.array(segment(F.concat(F.lit(template.turn_start), escape_role(t["role"]), F.lit(template.role_end)), F.lit(False)), segment(escape(t["text"]), F.get(losses, k)), segment(F.lit(template.turn_end), F.lit(False)))
    last = F.get(nexts, F.element_at("taken", -1))
    made = walked.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), last.isin([states.index(x) for x in template.accepting]).alias("valid"), F.flatten(F.zip_with("turns", "taken", of)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Parses ``formatted`` and the loss mask back: conv_id, valid, turns (role, text),
    loss_text (all text under the mask, unescaped)."""
    quoted = "\\Q" + template.turn_start + "\\E"
    body = F.slice(F.split("formatted", quoted, -1), 2, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, template.role_end, 1)
        rest = F.substr(x, F.length(role) + len(template.role_end) + 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.left(rest, F.length(rest) - len(template.turn_end))).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("conv_id", "valid", F.transform(body, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid")
