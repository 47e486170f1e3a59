"""Chat formatting in windows of bounded size. DataFrame operations only.

Prefix sums of turn tokens cut a conversation into runs of whole turns. Each
run becomes one window: the system turn again, a little of the history before
the run, and the run itself. The texts of assistant turns are targets of the
loss in the window where they are new, and masked where they are repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _work

#: Turns whose tokens are summed up in one task, before the sums are.
STRETCH = 64


@dataclass(frozen=True)
class Template:
    """A turn is ``begin``, its role, a line end, its text, ``end``. Control strings within roles and texts get a backslash behind their first character, and backslashes are doubled."""

    begin: str = "<s>"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escaped(self, text: Column, line: bool = False) -> Column:
        """``line``: line ends are escaped as well, as in roles."""
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        found = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.controls)
        text = F.regexp_replace(text, found, r"\\")
        return F.replace(text, F.lit("\n"), F.lit("\\\n")) if line else text

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def turn(self, role: Column, text: Column) -> Column:
        """``role`` and ``text`` are escaped."""
        return F.concat(F.lit(self.begin), role, F.lit("\n"), text, F.lit(self.end))

    def turns(self, formatted: Column) -> Column:
        """Array of (role, text), as they were before they were escaped."""
        each = F.split(formatted, rf"\Q{self.end}\E", -1)
        role = lambda x: F.regexp_extract(x, r"(?s)^" + rf"\Q{self.begin}\E" + r"((?:[^\\\n]|\\.)*)\n", 1)
        text = lambda x: F.substr(x, F.char_length(role(x)) + (len(self.begin) + 2))
        return F.transform(F.slice(each, 1, F.size(each) - 1), lambda x: F.struct(self.unescaped(role(x)).alias("role"), self.unescaped(text(x)).alias("text")))


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits, and every other visible character: an upper bound, or near it, for what tokenizers make of prose."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long")


def same(key: str, other: str) -> Column:
    return F.col(key).eqNullSafe(F.col(other))


def measured(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, overhead: int) -> DataFrame:
    """(conv, pos, role, text, tokens, before): each turn's place in its conversation and the tokens before it.

    Sums are taken within stretches of turns, then over the stretches, so that
    a conversation that holds a third of all turns is no one task's work.
    """
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"tokens": tokens(F.col("text")) + overhead, "stretch": F.floor(F.col("turn") / STRETCH)})
    sums = rows.groupBy("conv", "stretch").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = lambda c: F.expr(f"coalesce(sum({c}) over (partition by conv order by stretch rows between unbounded preceding and 1 preceding), 0)")
    sums = sums.select(F.col("conv").alias("_conv"), F.col("stretch").alias("_stretch"), earlier("n").alias("turns_before"), earlier("sum").alias("tokens_before"))
    order = "partition by conv, stretch order by turn, role, text"
    rows = rows.withColumns({"k": F.expr(f"row_number() over ({order})"), "own": F.expr(f"coalesce(sum(tokens) over ({order} rows between unbounded preceding and 1 preceding), 0)")})
    rows = rows.join(sums, same("conv", "_conv") & same("stretch", "_stretch"))
    return rows.select("conv", (F.col("turns_before") + F.col("k") - 1).alias("pos"), "role", "text", "tokens", (F.col("tokens_before") + F.col("own")).alias("before"))


def chat_windows(
    conversations: DataFrame, budget: int = 2048, history_turns: int = 4, history_tokens: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system", target: str = "assistant", overhead: int = 4, template: Template = Template()  # noqa: B008
) -> DataFrame:
    """(conv, window, first_turn, turns, repeated, tokens, formatted, loss): each conversation as windows of whole turns.

    A turn counts ``tokens`` and ``overhead``. The room of new turns is what a
    conversation's system turn (its first turn, if it has that role) and
    ``history_tokens`` leave of the budget, a quarter of the budget at least;
    a turn falls into the run that the tokens before it, over half the room,
    tell, and one longer than that is a run of its own: so runs end with whole
    turns and stay within their room, but for a single turn that is itself
    larger, which stands whole. A window repeats the system turn, and before
    its run as many of the last ``history_turns`` turns as have
    ``history_tokens`` together; the first ``repeated`` of its ``turns`` turns
    are such. ``loss`` has the spans (code points of ``formatted``, end
    exclusive) of the texts of the window's new target turns, in order.

    Turns are ordered by turn number (null first), then role, then text, so
    repeated rows are turns as well. Null texts and roles are empty; a null
    conversation is one of its own; whole texts are taken, however long; other
    columns, whatever their names, are ignored; an empty table gives an empty
    result.
    """
    turns = _work.table(measured(conversations, conv_col, turn_col, role_col, text_col, overhead), "turns")
    heads = turns.where((F.col("pos") == 0) & (F.col("role") == system)).select(F.col("conv").alias("_conv"), F.col("role").alias("head_role"), F.col("text").alias("head_text"), F.col("tokens").alias("head"))
    room = F.greatest(F.lit(budget - history_tokens) - F.coalesce("head", F.lit(0)), F.lit(max(budget // 4, 2)))
    half = F.floor(room / 2)
    held = turns.join(heads.select("_conv", "head"), same("conv", "_conv"), "left")
    held = held.withColumn("window", F.floor(F.col("before") / half) * 2 + (F.col("tokens") > half).cast("long"))
    new = held.select("conv", "window", "pos", "role", "text", "tokens", "before", F.lit(False).alias("again"))
    runs = new.groupBy("conv", "window").agg(F.min("pos").alias("start"), F.min("before").alias("start_before"))
    back = runs.select(F.col("conv").alias("_conv"), "window", "start_before", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("d"), (F.col("start") - F.col("d")).alias("_pos")) if history_turns else runs.select(F.col("conv").alias("_conv"), "window", "start_before", F.lit(-1).alias("_pos")).limit(0)
    past = turns.join(back.where("_pos >= 0"), same("conv", "_conv") & (F.col("pos") == F.col("_pos"))).where((F.col("start_before") - F.col("before") <= history_tokens) & ~((F.col("pos") == 0) & (F.col("role") == system)))
    past = past.select("conv", "window", "pos", "role", "text", "tokens", "before", F.lit(True).alias("again"))
    first = runs.where("start > 0").join(heads, same("conv", "_conv")).select("conv", "window", F.lit(0).cast("long").alias("pos"), F.col("head_role").alias("role"), F.col("head_text").alias("text"), F.col("head").alias("tokens"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("again"))
    rows = new.union(past).union(first).withColumns({"role": template.escaped(F.col("role"), line=True), "text": template.escaped(F.col("text")), "target": (F.col("role") == target) & ~F.col("again")})
    # A window holds no more than its budget, or a single turn.
    windows = rows.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "again", "target", "role", "text"))).alias("t"), F.sum("tokens").alias("tokens"))
    windows = windows.withColumn("start", F.transform("t", lambda x: F.char_length(x["role"]) + F.char_length(x["text"]) + (len(template.begin) + 1 + len(template.end))))
    # Where each turn begins: the sum of the lengths before it.
    windows = windows.withColumn("start", F.expr("aggregate(start, array(0), (s, n) -> concat(s, array(element_at(s, -1) + n)))"))
    head = lambda x: F.char_length(x["role"]) + (len(template.begin) + 1)
    spans = F.transform("t", lambda x, k: F.when(x["target"], F.struct((F.get("start", k) + head(x)).alias("start"), (F.get("start", k) + head(x) + F.char_length(x["text"])).alias("end"))))
    return windows.select(
        F.col("conv").alias(conv_col), "window", F.get("t", F.size(F.filter("t", lambda x: x["again"])))["pos"].alias("first_turn"), F.size("t").alias("turns"), F.size(F.filter("t", lambda x: x["again"])).alias("repeated"), "tokens",
        F.array_join(F.transform("t", lambda x: template.turn(x["role"], x["text"])), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id", template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv, turns, loss, formatted_chars): what the windows of each conversation say: its turns (role, text) in order, the texts under the loss mask, and the length of all windows."""
    own = F.slice(template.turns(F.col("formatted")), F.col("repeated") + 1, F.col("turns") - F.col("repeated"))
    loss = F.transform("loss", lambda s: template.unescaped(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    read = windows.select(F.col(conv_col).alias("conv"), F.struct("window", own.alias("turns"), loss.alias("loss")).alias("w"), F.char_length("formatted").cast("long").alias("chars"))
    read = read.groupBy("conv").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    return read.select(F.col("conv").alias(conv_col), F.flatten("w.turns").alias("turns"), F.flatten("w.loss").alias("loss"), "formatted_chars")
