"""Fill-in-the-middle transformation on succinct boundary vectors.

Token and code point starts of a block of texts are packed bitvectors with a
directory of popcounts for each 512 bits. Ranks at a document's ends give its
number of tokens; two selects turn token numbers drawn from the document's id
into byte cuts. Nothing is held for each token but one bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _text

LETTER = _text.byte_class((0x41, 0x5A), (0x61, 0x7A))
#: Bytes that do not begin a code point.
CONTINUES = _text.byte_class((0x80, 0xBF))
#: Words of 64 bits in a block of the directory.
WORDS = 8


@dataclass(frozen=True)
class Markers:
    """Strings before the prefix, the suffix and the middle; of equal length, each beginning with a character that none holds elsewhere."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class BitVector:
    """Packed bits with the number of set bits before each block of WORDS words."""

    def __init__(self, bits: np.ndarray) -> None:
        blocks = len(bits) // (64 * WORDS) + 1
        packed = np.zeros(blocks * WORDS * 8, np.uint8)
        held = np.packbits(bits, bitorder="little")
        packed[: len(held)] = held
        self.words = packed.view("<u8").reshape(blocks, WORDS)
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, word = at // (64 * WORDS), at // 64 % WORDS
        found = self.before[block]
        for k in range(WORDS):
            found = found + np.where(k < word, np.bitwise_count(self.words[block, k]), 0)
        low = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
        return found + np.bitwise_count(self.words[block, word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the set bit of each number from 0, which must exist."""
        block = np.searchsorted(self.before, k, "right") - 1
        rest, word = k - self.before[block], np.zeros(len(k), np.int64)
        for _ in range(WORDS - 1):
            own = np.bitwise_count(self.words[block, word]).astype(np.int64)
            further = (rest >= own) & (word < WORDS - 1)
            rest, word = rest - np.where(further, own, 0), word + further
        bits, at = self.words[block, word], (block * WORDS + word) * 64
        for width in (32, 16, 8, 4, 2, 1):
            own = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            further = rest >= own
            rest, at = rest - np.where(further, own, 0), at + width * further
            bits = np.where(further, bits >> np.uint64(width), bits)
        return at


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[BitVector, BitVector]:
    """Starts of tokens (runs of ASCII letters, single other code points) and of code points."""
    letter, point = LETTER[data], ~CONTINUES[data]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    return BitVector(point & ~inside), BitVector(point)


def _cut(batches: Iterator[pa.RecordBatch], markers: Markers, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in (markers.prefix, markers.suffix, markers.middle))
    for batch, data, offsets in _text.blocks(batches):
        tokens, points = boundaries(data, offsets)
        start, end = offsets[:-1], offsets[1:]
        first = tokens.rank(start)
        n = tokens.rank(end) - first
        form = batch.column("form").to_pylist()
        drawn = [batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")]
        cuts = []
        for k in (np.minimum(*drawn), np.maximum(*drawn)):
            at, inner = end.copy(), k < n
            at[inner] = tokens.select((first + k)[inner])
            cuts.append(at)
        chars = [points.rank(x) for x in (start, *cuts)]
        held, out = data.tobytes(), []
        for a, b, c, d, f in zip(start.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist(), form, strict=True):
            out.append(held[a:d] if f == "plain" else b"".join((p, held[a:b], s, held[c:d], m, held[b:c])) if f == "psm" else b"".join((s, held[c:d], p, held[a:b], m, held[b:c])))
        plain = np.array([f == "plain" for f in form], bool)
        yield pa.record_batch(
            {
                "id": batch.column("id").cast(kind), "n": n, "form": batch.column("form"),
                "prefix_chars": pa.array(chars[1] - chars[0], pa.int64(), mask=plain), "middle_chars": pa.array(chars[2] - chars[1], pa.int64(), mask=plain),
                "output": pa.array(out, pa.binary()).cast(pa.string()),
            }
        )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, markers: Markers = Markers()) -> DataFrame:  # noqa: B008
    """(id, n, form, prefix_chars, middle_chars, output) for every row.

    A text of n tokens (runs of ASCII letters, and each other code point) is
    cut at two token boundaries, drawn like all else from the hash of seed and
    id: rows that share an id are cut by the same draws. Of a hundred texts,
    ``plain`` on average stay as they are, as do texts without any token and
    those that hold a marker; of the others ``spm`` in a hundred have the
    suffix first. Counts are of code points, null for plain. ``restored``
    gives the text back.

    Whole texts are cut, however long. A null text is an empty one, a null id
    counts as an empty one in the hash; repeated rows each give a row; other
    columns, whatever their names, are ignored; an empty table gives an empty
    result. No shuffle.
    """
    text, kind = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.schema[id_col].dataType
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    held = docs.select(F.col(id_col).alias("id"), text.alias("text"), drawn.alias("h"))
    h = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    whole = (F.col("text") == "") | F.contains("text", F.lit(markers.prefix)) | F.contains("text", F.lit(markers.suffix)) | F.contains("text", F.lit(markers.middle)) | (h[2] % 100 >= 100 - plain)
    held = held.select("id", "text", h[0].alias("h1"), h[1].alias("h2"), F.when(whole, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    schema = f"id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        return _cut(batches, markers, to_arrow_type(kind))

    return held.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:  # noqa: B008
    """The text again. Markers cannot reach over the edge of a part, and parts hold none, so each splits where it was put."""
    part = F.split(output, "|".join(rf"\Q{x}\E" for x in (markers.prefix, markers.suffix, markers.middle)), -1)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
