"""Phrase collocations by counts of all n-grams.

Phrases of one to ``max_n`` words are exploded into rows and counted by hash
aggregation for each language, one length after another. A phrase can only be
frequent if both phrases that are one word shorter are, so a row is made only
where a filter of the frequent ones lets both pass: what it withholds could
not have been kept, and what it lets pass wrongly is counted in full and then
dropped, so that counts are exact whatever the filter's load. All later steps
are joins and windows over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _text, _work

#: Ends of pieces, and white space within them.
BREAK, BLANK = _text.byte_class(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D)), _text.byte_class((0x20, 0x20), (0x09, 0x09))
WORD = ~(BREAK | BLANK)
#: Bits of the filter of frequent phrases, which every worker holds, whatever the size of the corpus: 8 MB.
FILTER_BITS = 1 << 26
#: Bytes of text whose phrases are counted together before they become rows.
BLOCK_BYTES = 1 << 20
EXACT = "decimal(38,0)"


def _keyed(hashes: np.ndarray, langs: np.ndarray, bits: int) -> np.ndarray:
    """Bits of the filter for phrases with their languages' hashes."""
    return _text.mix(hashes ^ langs) % np.uint64(bits)


def _hashes(texts: pa.Array) -> np.ndarray:
    data, offsets = _text.utf8(texts)
    return _text.span_hash(_text.prefix_hash(data), offsets[:-1], offsets[1:])


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """String array of spans of the bytes."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def phrases(batches: Iterator[pa.RecordBatch], n: int, allowed: np.ndarray | None, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, count) of the phrases of ``n`` words of blocks of texts, of which both shorter ones pass the filter; for single words also the number of all words, under the empty phrase."""
    for batch, data, offsets in _text.blocks(batches, most=block_bytes):
        data = _text.LOWER[data]
        start, end, first = _text.words(data, offsets, WORD)
        if not len(start):
            continue
        coded = pa.array(batch.column("lang")).dictionary_encode()
        lang = np.repeat(coded.indices.to_numpy(), np.diff(first))
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(BREAK[data], out=breaks[1:])
        joined = breaks[start[1:]] == breaks[end[:-1]]
        joined[first[(first > 0) & (first < len(start))] - 1] = False
        # The words again, each with one blank behind it.
        length = end - start
        to = np.cumsum(length + 1)
        at = to - length - 1
        spaced = np.full(to[-1], 0x20, np.uint8)
        spaced[np.arange(to[-1] - len(to)) + np.repeat(at - (np.cumsum(length) - length), length)] = data[np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)]
        ok = np.ones(max(len(start) - n + 1, 0), bool)
        for k in range(n - 1):
            ok &= joined[k : k + len(ok)]
        if allowed is not None and len(ok):
            many = len(start) - n + 2
            shorter = _text.span_hash(_text.prefix_hash(spaced), at[:many], (at + length)[n - 2 :])
            bit = _keyed(shorter, _hashes(coded.dictionary)[lang[:many]], 8 * len(allowed))
            passes = (allowed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            ok &= passes[:-1] & passes[1:]
        ok = np.flatnonzero(ok)
        rows = pa.table({"lang": lang[ok], "phrase": _gathered(spaced, at[ok], (at + length)[ok + n - 1])})
        found = rows.group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
        if n == 1:
            codes, counts = np.unique(lang, return_counts=True)
            found = pa.concat_tables([found, pa.table({"lang": codes, "phrase": pa.array([""] * len(codes), pa.large_string()), "count_all": counts}).cast(found.schema)])
        names = coded.dictionary.take(found["lang"].combine_chunks())
        yield from pa.table({"lang": names, "phrase": found["phrase"].cast(pa.string()), "count": found["count_all"]}).to_batches(max_chunksize=20_000)


def _filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes, with a bit set for each phrase: or-ed together by word on the executors, bits / 64 rows at most."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"bit": _keyed(_hashes(b.column("phrase")), _hashes(b.column("lang")), bits).astype(np.int64)})

    words = frequent.select("lang", "phrase").mapInArrow(placed, "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 4, least: int = 30, unknown: str = "und", filter_bits: int = FILTER_BITS, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """For each length 1 to ``max_n`` the (lang, phrase, count) of the phrases found ``least`` times or more; the first also has the number of all words of each language, under the empty phrase.

    Each is a table in the shared folder; the texts are read once for each length.
    """
    spark = docs.sparkSession
    held = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(unknown)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    found: list[DataFrame] = []
    for n in range(1, max_n + 1):
        shared = spark.sparkContext.broadcast(_filter(found[-1].where("phrase <> ''"), filter_bits)) if n > 1 else None

        def explode(batches: Iterator[pa.RecordBatch], n: int = n, shared: object = shared) -> Iterator[pa.RecordBatch]:
            return phrases(batches, n, shared.value if shared else None, block_bytes)

        rows = held.mapInArrow(explode, "lang string, phrase string, count long")
        counts = rows.groupBy("lang", "phrase").agg(F.sum("count").alias("count")).where((F.col("count") >= least) | (F.col("phrase") == ""))
        found.append(_work.table(counts, f"phrases{n}"))
        if shared:
            shared.destroy()
    return found


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 4, least: int = 30, covered: int = 80, top: int = 2000, unknown: str = "und", filter_bits: int = FILTER_BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to ``max_n`` words.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends
    and into words at blanks and tabs; phrases lie within a piece and are
    counted wherever they begin. One found a times, at least ``least``, is cut
    after each of its words into parts found l and r times; its score is the
    smallest floor(2000000 a / (l + r)), the first cut of equal ones counts.
    Left out is a phrase that a longer one found at least ``covered`` hundredths
    as often contains; it is enough to look one word further, as every phrase
    between the two is found at least as often as the longer. Best are those of
    high score, then high a, then in the order of their bytes.

    Whole texts count, however long, and repeated rows each count; a null text
    is empty, a null language is ``unknown``; other columns, whatever their
    names, are ignored; an empty table, or one without such phrases, gives an
    empty result.
    """
    levels = phrase_counts(docs, lang_col, text_col, max_n, least, unknown, filter_bits, block_bytes)
    counts = levels[0]
    for more in levels[1:]:
        counts = counts.unionByName(more)
    words = F.split("phrase", " ")
    candidates = counts.where(F.size(words) > 1).select("lang", "phrase", F.col("count").alias("a"))
    # Decimals hold products beyond 64 bits, and div is exact.
    longer = candidates.where(F.size(words) > 2).select("lang", "a", F.explode(F.array(F.expr("concat_ws(' ', slice(split(phrase, ' '), 1, size(split(phrase, ' ')) - 1))"), F.expr("concat_ws(' ', slice(split(phrase, ' '), 2, size(split(phrase, ' ')) - 1))"))).alias("part"))
    longer = longer.groupBy("lang", "part").agg(F.max("a").alias("longer")).withColumnRenamed("lang", "_lang")
    kept = candidates.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("part")) & (F.col("longer").cast(EXACT) * 100 >= F.col("a").cast(EXACT) * covered), "left_anti")
    cuts = kept.withColumn("w", words).withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("concat_ws(' ', slice(w, 1, k))").alias("head"), F.expr("concat_ws(' ', slice(w, k + 1, size(w) - k))").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r")), ["lang", "tail"])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    totals = counts.where("phrase = ''").select("lang", F.col("count").alias("n"))
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    ranked = best.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(F.col("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
