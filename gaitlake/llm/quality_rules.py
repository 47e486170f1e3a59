"""Quality rules as a short-circuit cascade.

Each rule is a cheap or dear test that rejects a document. On a bounded sample
the work of every rule, in characters that it passes over, and its rejections
are measured in one pass. The cascade then takes, at each place, the rule with
the most rejections per work among the documents that the rules before it let
through, and a document leaves it at the first rule that rejects it: what dear
rules need is computed for the rest alone. The order changes the cost and which
rule is named, never the verdict. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows that the costs and selectivities of the rules are measured on, a documented bound.
SAMPLE_ROWS = 2000
#: Seed of that sample.
SEED = 7


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean expression over ``text`` and the columns of ``measures``; ``passes`` tells how often it goes over the text (0: it looks at measures, which are there already)."""

    name: str
    rejects: Column
    passes: float = 0.0


def dropped(text: Column, characters: str) -> Column:
    """Number of the text's characters that are among the given ones."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text (null: none of anything).

    Repeats are counted within each row's arrays, sorted rather than compared
    in pairs, so a very long text costs n log n.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.withColumns({"_text": text})
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(F.translate(x, SPACE, " ")) != "")
    one = one.withColumns({"_words": F.transform(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)), "_lines": lines})
    n = F.size("_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    two = one.withColumns({"_windows": F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("_words", i + 1, WINDOW)).alias("h"), i.alias("p"))))})
    same = lambda x, i: F.coalesce(F.get("_windows", i)["h"] == x["h"], F.lit(False))
    again = F.filter("_windows", lambda x, i: same(x, i - 1) | same(x, i + 1))
    three = two.withColumns({"_again": F.sort_array(F.transform(again, lambda x: x["p"]))})
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).cast("long").alias("n"))
    return three.withColumns({
        "n_words": n.cast("long"), "word_chars": (F.char_length("_text") - dropped(F.col("_text"), SPACE)).cast("long"), "n_symbols": dropped(F.col("_text"), SYMBOLS),
        "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.aggregate("_again", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step)["n"],
    }).drop("_words", "_lines", "_windows", "_again", "_text")


def base_rules() -> list[Rule]:
    return [Rule("too_short", F.col("n_words") < 20), Rule("repeats", 100 * F.col("n_repeat_words") > 30 * F.col("n_words"))]


def default_rules(text_col: str = "text") -> list[Rule]:
    """The base rules, two more over measures (more symbols than words, mostly repeated lines), and three that read the text again: mostly capitals, mostly marks, many characters that no decoder understood."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    return [
        *base_rules(),
        Rule("symbols", F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("capitals", count("[^A-Z]") > 3 * count("[^a-z]"), 2.0),
        Rule("marks", 3 * count(r"[^\p{L}\p{M}\p{N}]") < F.col("word_chars"), 1.0),
        Rule("undecoded", 20 * dropped(text, "\ufffd") > F.col("word_chars"), 0.2),
    ]


@dataclass(frozen=True)
class Step:
    """A rule at its place, with what the sample says: rows that reach it, rows that it rejects there, and its work over those that reach it."""

    rule: Rule
    reached: int
    rejected: int
    work: float


def planned(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Step]:
    """The rules in the order to run, greedily by rejections per work among the rows that are left, on a sample of at most ``rows`` rows."""
    n = docs.count()
    some = docs.sample(min(1.0, 8 * rows / n), seed=SEED).limit(rows) if n > rows else docs
    flags = F.array(*(F.coalesce(rule.rejects, F.lit(False)) for rule in rules))
    # The driver gets a length and one flag a rule of each row of the sample.
    held = [(r[0], r[1]) for r in measures(some).select(F.char_length(F.coalesce(F.col("text"), F.lit(""))), flags).collect()]
    out, left, rest = [], held, list(range(len(rules)))
    while rest:
        size = sum(x for x, _ in left)
        work = {k: len(left) + rules[k].passes * size for k in rest}
        hits = {k: sum(f[k] for _, f in left) for k in rest}
        best = min(rest, key=lambda k: (-hits[k] / max(work[k], 1), rules[k].passes, k))
        out.append(Step(rules[best], len(left), hits[best], work[best]))
        left = [r for r in left if not r[1][best]]
        rest.remove(best)
    return out


def cascade(measured: DataFrame, order: Sequence[Rule]) -> DataFrame:
    """Adds ``failed_rule`` (null if none rejects) and ``kept``. A rule that is null for a row does not reject it."""
    failed = F.lit(None).cast("string")
    for rule in reversed(order):
        failed = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(failed)
    return measured.withColumns({"failed_rule": failed}).withColumns({"kept": F.col("failed_rule").isNull()})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures, base_failed, failed_rule, kept) for every row.

    Null and empty texts have no words and fail the base rules; whole texts
    are measured, however long; repeated rows are judged alike; other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    rules = default_rules()
    judged = cascade(measures(docs), [step.rule for step in planned(docs, rules)])
    base = F.lit(False)
    for rule in base_rules():
        base = base | rule.rejects
    return judged.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_rule")
