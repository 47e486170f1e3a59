"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet every source's token target, the one
closest in relative entropy to taking each document once is an exponential
tilt, ``exp(lambda * size)``, with one multiplier for each source, cut off at
the most copies allowed. The multipliers solve a convex dual; each Newton
iteration is one aggregation over the corpus. Rates are then rounded into
whole copies, with one threshold for each source chosen, again by aggregation,
so that the copies' tokens meet the target. The driver holds one line for each
source; documents get their source's numbers by a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _work
from gaitlake.llm._rows import numbered_copies

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
#: Sources up to this number are broadcast; of more, those with over this share of all rows are, and the others are joined by name.
FEW_SOURCES = 10_000
STEPS = 32


@dataclass
class Source:
    name: str | None
    size: int
    rows: int
    target: float = 0.0
    tilt: float = 0.0


def weights(n: int) -> list[int]:
    """1, 2, 3, repeating."""
    return [1 + k % 3 for k in range(n)]


def set_targets(sources: list[Source], weight: list[float], most: float = MOST_COPIES) -> None:
    """Shares the total size by weight; targets stop at ``most`` times the own size, and the excess is shared again among the rest."""
    total = float(sum(s.size for s in sources))
    open_ = list(range(len(sources)))
    left = total
    for s in sources:
        s.target = 0.0
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = [k for k in open_ if unit * weight[k] > most * sources[k].size]
        if not full:
            for k in open_:
                sources[k].target = unit * weight[k]
            return
        for k in full:
            sources[k].target = float(most * sources[k].size)
            left -= sources[k].target
        done = set(full)
        open_ = [k for k in open_ if k not in done]


def _joined(rows: DataFrame, sources: list[Source], **columns: dict[int, float]) -> DataFrame:
    """Rows of the sources that have the values given, each with those of its ``source`` (null like any other)."""
    kinds = ", ".join(["_source string", *(f"{c} double" for c in columns)])

    def table(keys: list[int]) -> DataFrame:
        return rows.sparkSession.createDataFrame([(sources[k].name, *(float(v[k]) for v in columns.values())) for k in keys], kinds)

    keys = list(next(iter(columns.values())))
    of = lambda t: rows["source"].eqNullSafe(t["_source"])
    if len(keys) <= FEW_SOURCES:
        few = F.broadcast(table(keys))
        return rows.join(few, of(few)).drop("_source")
    most = sum(s.rows for s in sources) // FEW_SOURCES
    large, others = F.broadcast(table([k for k in keys if sources[k].rows > most])), table([k for k in keys if sources[k].rows <= most])
    rest = rows.join(large, of(large), "left_anti")
    return rows.join(large, of(large)).unionByName(rest.join(others, rest["source"].eqNullSafe(others["_source"]))).drop("_source")


def balance(sizes: DataFrame, sources: list[Source], most: int = MOST_COPIES, rounds: int = 40, close: float = 1e-4) -> None:
    """Sets each source's tilt: Newton steps on the dual, kept within a bracket that every step narrows.

    ``sizes`` counts the documents (``n``) of each source and size: documents of one size share a rate, so the sums need no more.
    """
    number = {s.name: k for k, s in enumerate(sources)}
    low = {k: -60.0 for k, s in enumerate(sources) if s.size}
    high = dict.fromkeys(low, 60.0)
    now = {}
    for k in low:
        ratio = sources[k].target / sources[k].size
        if ratio >= most * (1 - 1e-12):
            sources[k].tilt = math.inf
        else:
            now[k] = max(-20.0, min(20.0, math.log(max(ratio, 1e-8))))
    for _ in range(rounds):
        if not now:
            return
        rows = _joined(sizes, sources, scale={k: max(sources[k].rows, 1) / sources[k].size for k in now}, tilt=now)
        rows = rows.withColumns({"z": F.col("size") * F.col("scale"), "tokens": F.col("size") * F.col("n")})
        x = F.least(F.col("tilt") * F.col("z"), F.lit(60.0))
        free = F.exp(x) < most
        sums = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.least(F.exp(x), F.lit(float(most)))), F.sum(F.when(free, F.col("tokens") * F.col("z") * F.exp(x)).otherwise(0.0))).collect()
        for name, got, slope in sums:
            k = number[name]
            gap = got - sources[k].target
            if abs(gap) <= close * sources[k].target or high[k] - low[k] < 1e-9:
                sources[k].tilt = now.pop(k)
                continue
            if gap > 0:
                high[k] = now[k]
            else:
                low[k] = now[k]
            step = now[k] - gap / slope if slope > 0 else math.nan
            now[k] = step if low[k] < step < high[k] else (low[k] + high[k]) / 2
    for k, t in now.items():
        sources[k].tilt = t


def _copies(rate: Column, draw: Column, shift: Column, most: int) -> Column:
    whole = F.floor(rate)
    return F.least(F.greatest(whole + (draw < rate - whole + shift).cast("long"), F.lit(0)), F.lit(most))


def round_rates(rated: DataFrame, sources: list[Source], most: int = MOST_COPIES, passes: int = 3) -> dict[int, float]:
    """Shift of each source's rounding threshold, from ``passes`` aggregations of STEPS thresholds each; taken tokens grow with it."""
    number = {s.name: k for k, s in enumerate(sources)}
    low = {k: -1.0 for k, s in enumerate(sources) if s.size and math.isfinite(s.tilt)}
    wide = 2.0
    best = dict.fromkeys(low, 0.0)
    for _ in range(passes):
        if not low:
            break
        joined = _joined(rated, sources, low=low)
        sums = [F.sum(F.col("size") * _copies(F.col("rate"), F.col("draw"), F.col("low") + wide * j / STEPS, most)).alias(f"s{j}") for j in range(STEPS + 1)]
        for row in joined.groupBy("source").agg(*sums).collect():
            k, taken = number[row[0]], row[1:]
            j = min(range(STEPS + 1), key=lambda j: abs(taken[j] - sources[k].target))
            best[k] = low[k] + wide * j / STEPS
            under = max((j for j in range(STEPS + 1) if taken[j] <= sources[k].target), default=0)
            low[k] += wide * min(under, STEPS - 1) / STEPS
        wide /= STEPS
    return best


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[Source]]:
    """A table of (id, source, size, key, the columns to keep) and the sources by code point, null last; ``key`` is a hash of id and text, and of the row's number among rows that are equal in both."""
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("int")
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = _work.table(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), text.alias("text"), F.monotonically_increasing_id().alias("row"), kept.alias("_kept")), "sizes")
    held = numbered_copies(rows, "_id", "text").withColumn("key", F.xxhash64("_id", "text", "nth")).drop("text", "nth", "row")
    found = held.groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    return held, [Source(*r) for r in sorted(found, key=lambda r: (r[0] is None, r[0] or ""))]


def mix(docs: DataFrame, weight: list[float] | None = None, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, copies, taken, rate, *keep) for every row.

    ``size`` counts the words between white space of the whole text, however
    long; ``weight`` is by source in order of code points, null last (default
    1, 2, 3, repeating). A document is taken ``copies`` times, at most
    ``most``; ``taken`` is that many times its size. Documents without words
    (null and empty texts) have rate 1 (``most`` in a source that is taken in
    full) and take nothing. Draws come from id and text, and of rows that are
    equal in both, null ids among them, from their number, so that reruns agree
    and rows that share an id are not taken all or none. ``keep`` names columns to
    carry along; others, whatever their names, are ignored; an empty table
    gives an empty result. There may be any number of sources; the driver
    holds a line for each.
    """
    sized, sources = sized_documents(docs, id_col, text_col, source_col, keep)
    set_targets(sources, list(weight or weights(len(sources))), most)
    sizes = _work.table(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    balance(sizes, sources, most)
    _work.drop(sizes)
    each = lambda f: {k: f(s) for k, s in enumerate(sources)}
    rated = _joined(
        sized.withColumns({"draw": F.pmod(F.xxhash64("key", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)}), sources,  # a draw in [0, 1)
        source_size=each(lambda s: s.size), target=each(lambda s: s.target), whole=each(lambda s: not math.isfinite(s.tilt)), slope=each(lambda s: s.tilt * s.rows / s.size if s.size and math.isfinite(s.tilt) else 0.0),
    )
    rate = F.when(F.col("whole") == 1, F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("slope") * F.col("size"), F.lit(60.0))), F.lit(float(most))))
    rated = rated.withColumns({"source_size": F.col("source_size").cast("long"), "rate": rate})
    shifts = round_rates(rated, sources, most)
    out = _joined(rated, sources, shift=each(lambda s: 0.0) | shifts)
    out = out.withColumns({"copies": _copies(F.col("rate"), F.col("draw"), F.col("shift"), most)})
    out = _repaired(out, sources, most)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rate", *(F.col("_kept")[c].alias(c) for c in keep))


def _repaired(out: DataFrame, sources: list[Source], most: int, passes: int = 3) -> DataFrame:
    """Up to ``passes`` times changes one document's copies by one in each source, the one whose size comes closest to what the source's sum is off."""
    number = {s.name: k for k, s in enumerate(sources)}
    for _ in range(passes):
        sums = {number[r[0]]: r[1] for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size"))).collect()}
        off = {k: sources[k].target - taken for k, taken in sums.items() if sources[k].size and math.isfinite(sources[k].tilt) and abs(sources[k].target - taken) >= 1}
        if not off:
            break
        can = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("off")) & F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        place = F.col("key")
        picked = _joined(out, sources, off=off).where(can).groupBy("source").agg(F.min(F.struct(F.abs(F.abs("off") - F.col("size")).alias("d"), place.alias("h")))["h"]).collect()
        # The pick goes by its key, and two halves make that two exact numbers.
        picks = {number[r[0]]: r[1] for r in picked}
        every = range(len(sources))
        out = _joined(out, sources, by={k: math.copysign(1, off[k]) if k in picks else 0.0 for k in every}, high={k: picks.get(k, 0) >> 32 for k in every}, low={k: picks.get(k, 0) & 0xFFFFFFFF for k in every})
        change = F.when((F.shiftright(place, 32) == F.col("high")) & (place.bitwiseAND(0xFFFFFFFF) == F.col("low")), F.col("by").cast("long")).otherwise(0)
        out = out.withColumns({"copies": F.least(F.greatest(F.col("copies") + change, F.lit(0)), F.lit(most))}).drop("by", "high", "low")
    return out
