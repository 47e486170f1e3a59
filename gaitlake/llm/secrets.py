"""Secret scan with corpus-wide ownership frequency.

Candidate credentials are found by pattern. Their hashes are then counted over
the whole corpus by distinct owner and distinct repository: a value that many
owners carry, or that one carries through very many repositories, is a widely
copied example; one that few carry in few places looks live. Candidates of the base kinds are always reported; those of the wider
kinds only where the counts say that they are owner-specific. DataFrame
operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _work


@dataclass(frozen=True)
class Kind:
    """A pattern; the value is capture group ``group`` and has ``least`` characters at least. Base kinds are always reported."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True
    #: Cheap test that every text with a match passes.
    hint: str | None = None


KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, hint="(?i)pass|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"),
    # Runs of 24 or more are the runs of any length that pass the test on length.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, hint="[0-9a-f]{24}"),
    Kind("prefixed", r"\b(?:gh[oprsu]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza)[A-Za-z0-9_-]+", 0, 20, base=False, hint="gh[oprsu]_|glpat-|xox|sk|AIza"),
    Kind("mixed", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{32,}", 0, 32, base=False, hint="[A-Za-z0-9+/_=-]{32}"),
)
#: A value with more owners, or in more repositories, than this is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 4


def candidates(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``hits``: for each leftmost non-overlapping match, failing ones included, its kind, number, the gap before it, its length and its value."""
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,n:int,value:string>>")

    def matches(number: int, kind: Kind) -> Column:
        match, value = (F.regexp_extract_all(text_col, F.lit(kind.pattern), F.lit(g)) for g in (0, kind.group))
        gaps = F.transform(F.split(text_col, kind.pattern, -1), lambda x: F.char_length(x))
        rows = F.zip_with(match, value, lambda m, v: F.struct(F.char_length(m).alias("n"), v.alias("value")))
        rows = F.zip_with(rows, F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda x, g: F.struct(x["n"].alias("n"), x["value"].alias("value"), g.alias("gap")))
        rows = F.transform(rows, lambda r, k: F.struct(F.lit(number).alias("kind"), k.alias("k"), r["gap"].alias("gap"), r["n"].alias("n"), r["value"].alias("value")))
        return F.when(F.col(text_col).rlike(kind.hint or kind.pattern), rows).otherwise(none)

    return docs.withColumn("hits", F.concat(*(matches(i, kind) for i, kind in enumerate(kinds))))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories) over all rows of (digest, owner, repo); distinct combinations are taken before anything is counted, so a hot value shrinks where it lies. A null owner or repository counts as one of its own."""
    pairs = found.select("digest", "owner", "repo").distinct()
    repos = pairs.groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    return repos.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), kinds: tuple[Kind, ...] = KINDS, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(id, n_<base kind>..., base_sha256, spans, live_spans) for every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    then kind. A value looks live if at most ``most_owners`` owners carry it,
    in at most ``most_repositories`` repositories. ``spans`` has all base spans
    and those of the wider kinds that look live and that no base span covers;
    ``live_spans`` has those of either that look live. Whole texts are scanned,
    however long. A null text is empty and has no spans; repeated rows are
    scanned alike and count once for an owner and a repository; a null owner
    or repository is one of its own; other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(owner_col).alias("owner"), F.struct(*(F.col(c).cast("string") for c in repo_cols)).alias("repo"))
    held = candidates(docs, kinds=kinds).select(F.monotonically_increasing_id().alias("row"), "_id", "owner", F.xxhash64("repo").alias("repo"), "hits")
    # Written at once: row numbers stay as they are, and texts are read only here.
    held = _work.table(held, "secrets")
    each = held.where(F.size("hits") > 0).select("row", "owner", "repo", F.explode("hits").alias("h")).select("row", "owner", "repo", "h.*")
    end = F.expr("sum(gap + n) over (partition by row, kind order by k)")
    least = F.element_at(F.array(*(F.lit(k.least) for k in kinds)), F.col("kind") + 1)
    each = each.withColumns({"end": end.cast("int"), "digest": F.sha2("value", 256)}).where(F.char_length("value") >= least)
    each = _work.table(each.select("row", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "digest", "owner", "repo"), "found")
    owned = ownership(each).select("digest", ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).alias("live"))
    spans = each.join(owned, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("all"))
    is_base = F.array(*(F.lit(k.base) for k in kinds))
    base = F.filter("all", lambda s: F.get(is_base, s["kind"]))
    spans = spans.withColumns({"base": base})
    free = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    spans = spans.withColumns({"all": F.filter("all", lambda s: F.get(is_base, s["kind"]) | (s["live"] & free(s)))})
    name = F.array(*(F.lit(k.name) for k in kinds))
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ","), F.lit(""))
    out = held.select("row", "_id").join(spans, "row", "left")
    live = F.filter("all", lambda s: s["live"])
    count = lambda i: F.coalesce(F.greatest(F.size(F.filter("base", lambda s: s["kind"] == i)), F.lit(0)), F.lit(0)).cast("long")
    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base]
    return out.select(F.col("_id").alias(id_col), *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("all").alias("spans"), text(live).alias("live_spans"))
