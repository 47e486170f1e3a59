"""Token ids in binary files: frequency-ranked, byte-aligned, control bytes apart.

Ids are replaced by their rank in falling order of corpus frequency, so that
common tokens take one byte. A value has one to four bytes; two bits of a
separate control stream tell how many, four values to a control byte. Readers
look the four lengths of a control byte up in a table and gather all values of
a block at once.

A file is a Parquet file of blocks, in ascending order of document ids; a
block is ``file`` and ``block`` number, ``before`` (tokens of the file before
it), ``ids`` and ``counts`` of its documents, and the streams ``control`` and
``data``. The token id of each rank lies beside the files, so that they can be
read without the tokenizer and by another application. Spark's commit protocol
makes files appear whole or not at all, whichever executors are lost.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.llm import _text, _work

#: Ends every document.
END_ID = 1
#: Tokens of a block, as soon as a document ends.
BLOCK_TOKENS = 1 << 18
#: Tokens of a file, and the number of files from which on files grow instead.
FILE_TOKENS, MOST_FILES = 1 << 24, 20_000
#: Bytes of text whose distinct pieces are looked up at once, and how many pieces of at most which length a worker remembers.
BLOCK_BYTES, CACHED_PIECES, CACHED_LENGTH = 4 << 20, 800_000, 48
#: Columns of the files.
BLOCKS = "file int, block int, before long, ids array<long>, counts array<int>, control binary, data binary"

_counts = np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3
#: Byte lengths of the four values of each control byte.
LENGTHS = (_counts + 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = more
    control = (padded.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1).astype(np.uint8)
    start = np.zeros(len(values) + 1, np.int64)
    np.cumsum(more.astype(np.int64) + 1, out=start[1:])
    data = np.zeros(start[-1], np.uint8)
    for k in range(4):
        has = more >= k
        data[start[:-1][has] + k] = (values[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` values, by lookup of control bytes in LENGTHS."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(length, dtype=np.int64) - length
    held = np.frombuffer(data, np.uint8)
    out = held[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(length > k)
        out[has] |= held[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@functools.cache
def _tokenizer(path: str) -> object:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts_at_spaces(path: str) -> bool:
    """Whether the tokenizer's own parts prove that pieces between white space, and marks after a letter or digit, have the ids that they have in the whole text.

    That holds if the text is composed, folded and stripped of white space
    only, and then cut by a pattern none of whose alternatives takes white
    space, or both marks other than the apostrophe and what comes before them.
    """
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    normal = (parts.get("normalizer") or {}).get("normalizers", [])
    cut = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    folds = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
    drops = cut[0].get("type") == "Split" and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and all(_ALTERNATIVE.fullmatch(x) for x in cut[0]["pattern"].get("Regex", " ").split("|"))
    later = len(cut) == 2 and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
    marked = all("<" in t["content"] and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in parts["added_tokens"])
    return bool(folds and drops and later and marked and parts.get("post_processor") is None and not parts["model"].get("dropout"))


#: What an alternative of the cutting pattern may be: an apostrophe with letters, letters, a digit, or marks.
_ALTERNATIVE = re.compile(r"'[a-z]+|\[?\\p\{L\}\]?\+|\[?\\p\{N\}\]?\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+")
#: Marks that are cut off a piece's end.
_TAIL = ".,;:!?*#$%&|"


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    Where ``parts_at_spaces`` proves it sound, the distinct pieces of a block
    of texts are encoded once and remembered, and texts are put together from
    them by index; otherwise, and with ``whole``, every text is encoded in one
    piece.
    """

    def __init__(self, path: str, end_id: int = END_ID, whole: bool = False) -> None:
        self.path, self.whole = path, whole or not parts_at_spaces(path)
        self.kind = id_kind(path)
        self.end = np.array([end_id], self.kind).tobytes()
        self.known: dict[bytes, bytes] = {}

    def texts(self, column: pa.Array) -> pa.Array:
        """The ids of each text of a string column and the end id, as little-endian bytes; null counts as empty."""
        column = pc.fill_null(column, pa.scalar("", column.type))
        if self.whole:
            return pa.array([x + self.end for x in self._ids(column.to_pylist())], pa.binary())
        pieces = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        words = pieces.flatten().dictionary_encode()
        ids = pa.concat_arrays([self._pieces(words.dictionary), pa.array([self.end], pa.binary())])
        n = pc.list_value_length(pieces).to_numpy().astype(np.int64)
        flat = ids.take(pa.array(np.insert(words.indices.to_numpy(), np.cumsum(n), len(ids) - 1)))
        ends = np.frombuffer(flat.buffers()[1], np.int32)[np.concatenate([[0], np.cumsum(n + 1)])]
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.ascontiguousarray(ends)), flat.buffers()[2]])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in _tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces. Those of ASCII alone, without the start of a special token, are lower-cased, and last marks after a letter or digit encoded apart, as many pieces differ in no more."""
        plain = pc.and_not(pc.string_is_ascii(pieces), pc.match_substring(pieces, "<"))
        small = pc.if_else(plain, pc.ascii_lower(pieces), pieces)
        core = pc.ascii_rtrim(small, _TAIL)
        core = pc.if_else(pc.and_(plain, pc.match_substring_regex(core, "[a-z0-9]$")), core, small)
        data, offsets = _text.utf8(small)
        start = offsets[:-1] + pc.binary_length(core).to_numpy()
        n = offsets[1:] - start
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        tail = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(data[at])])
        return pc.binary_join_element_wise(self._known(core.cast(pa.binary())), self._known(tail), b"")

    def _known(self, pieces: pa.Array) -> pa.Array:
        held = pieces.dictionary_encode()
        distinct = held.dictionary.to_pylist()
        if len(self.known) > CACHED_PIECES:
            self.known = {}
        missing = [p for p in distinct if p not in self.known]
        self.known.update(zip(missing, self._ids([p.decode() for p in missing]), strict=True))
        ids = pa.array([self.known[p] for p in distinct], pa.binary())
        for p in missing:
            if len(p) > CACHED_LENGTH:
                del self.known[p]
        return ids.take(held.indices)


def id_kind(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


@functools.cache
def _encoder(path: str, end_id: int, whole: bool) -> Encoder:
    """One for each worker process, so that later tasks find what earlier ones have encoded."""
    return Encoder(path, end_id, whole)


def _tokenise(path: str, whole: bool, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each core has a task of its own already
        encoder = _encoder(path, end_id, whole)
        for batch, _, _ in _text.blocks(batches, most=BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.texts(batch.column(1))], names=["id", "tokens"])

    return run


def _histogram(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = _text.utf8(batch.column(0))
            n = np.bincount(data.view(kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    return run


def _pack(shared: object, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, file = shared.value, TaskContext.get().partitionId()
        ids, held, size, block, before = [], [], 0, 0, 0
        width = np.dtype(kind).itemsize

        def done() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), kind)
            control, data = encode(rank[values])
            counts = [len(t) // width for t in held]
            row = [pa.array([x], k) for x, k in ((file, pa.int32()), (block, pa.int32()), (before, pa.int64()), (ids, pa.list_(pa.int64())), (counts, pa.list_(pa.int32())), (control, pa.binary()), (data, pa.binary()))]
            return pa.RecordBatch.from_arrays(row, names=["file", "block", "before", "ids", "counts", "control", "data"])

        for batch in batches:
            for i, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append(tokens)
                size += len(tokens) // width
                if size >= BLOCK_TOKENS:
                    yield done()
                    before += size
                    ids, held, size, block = [], [], 0, block + 1
        if ids:
            yield done()

    return run


def _unpack(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, base = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                ids = token[decode(row["control"], row["data"], int(ends[-1]))].astype("<u4")
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                start = ends - counts + row["before"] + base[row["file"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> None:
    """Writes ``folder``/blocks, the files, and ``folder``/ranks, the token id of each rank: all that a reader needs.

    ``path`` is a file of the tokenizers library. Texts are encoded once, to a
    table in the shared folder; the vocabulary's counts (bounded by its size)
    go to the driver and give the ranks. Files are ranges of ids, then of
    hashes of the ids' bytes, so one id with very many rows (or null) is
    spread too; there are as many as ``file_tokens`` tokens a file make, at
    most MOST_FILES, beyond which files grow.
    """
    spark, kind = docs.sparkSession, id_kind(path)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = _work.table(rows.mapInArrow(_tokenise(path, whole, end_id), "id long, tokens binary"), "tokenised")
    counts = ids.select("tokens").mapInArrow(_histogram(kind), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").collect()
    token = np.array([r[0] for r in counts], np.uint32)
    rank = np.zeros(int(token.max(initial=0)) + 1, np.uint32)
    rank[token] = np.arange(len(token), dtype=np.uint32)
    ranks = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(token.tolist())), "array<long>")).alias("rank", "token"))
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    files = max(1, min(MOST_FILES, -(-sum(r[1] for r in counts) // file_tokens)))
    ordered = ids.withColumn("spread", F.xxhash64("tokens")).repartitionByRange(files, "id", "spread").sortWithinPartitions("id", "spread").select("id", "tokens")
    ordered.mapInArrow(_pack(spark.sparkContext.broadcast(rank), kind), BLOCKS).write.parquet(f"{folder}/blocks")
    _work.drop(ids)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files alone. What goes to the executors is one number for each rank and each file."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    token = np.array([r[0] for r in spark.read.schema("rank int, token long").parquet(f"{folder}/ranks").orderBy("rank").select("token").collect()], np.uint32)
    sums = blocks.select("file", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("file").agg(F.sum("n")).collect()
    base, total = {}, 0
    for file, n in sorted((r[0], r[1]) for r in sums):
        base[file] = total
        total += n
    return blocks.mapInArrow(_unpack(spark.sparkContext.broadcast((token, base))), "id long, start long, n_tokens long, ids_crc32 long")


def tokenise(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, end_id: int = END_ID) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for every row, as read back from the files.

    Files stay in ``folder``; without one they lie in the shared folder until
    the application ends. Null and empty texts are the end id alone; a very
    long text is encoded like any other, in a block of its own. Documents lie
    in ascending order of ids, null ids first; repeated ids and rows follow
    each other in an order that their tokens give, each with its own ids.
    Other columns, whatever their names, are ignored. An empty table gives no
    blocks and an empty result.
    """
    folder = folder or _work.place(docs.sparkSession, "token-files")
    write_tokens(docs, path, folder, id_col, text_col, whole, end_id)
    return read_tokens(docs.sparkSession, folder).withColumnRenamed("id", id_col)
