"""Personal data: patterns, and a skip-chain conditional random field over tokens.

Patterns give the base spans, which are always kept. The field labels tokens
that hold a digit or an at sign, and capitalised words that follow a form of
address, are part of an e-mail address of the document, or repeat such a word;
all others are "outside" and enter as context. Neighbours are linked, and so
are distant tokens that repeat each other or are similar: the same letters and
digits, or the same last seven digits. Linked tokens share potentials, and
loopy message passing over chain and skip links makes a document's labels
agree: a number that is clearly a phone number once is one wherever it recurs.
Runs of tokens that the field labels and no base span touches are added.

The field is trained on a bounded sample of documents, by the gradient of the
joint likelihood that message passing gives. Base spans and forms of address
give the labels; those of other tokens are unknown and summed over. Features
are left out at random, so that links learn to speak where a token alone does
not say enough; in a corpus without repeats they keep the prior that linked
tokens agree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _text

KINDS = ("email", "ip", "card", "phone")
#: What the field labels: the base kinds, and names, which no pattern finds.
LABELS = (*KINDS, "name")
#: Bounds of the sample that the field is trained on: documents, by the hash of their texts, and their tokens.
TRAIN_DOCS, TRAIN_TOKENS = 6000, 30_000
FEATURE_BITS = 14
#: Messages pass until none changes by more than SETTLED, at most ROUNDS times.
ROUNDS, SETTLED, DAMPING = 50, 1e-3, 0.3
#: Prior potential of linked tokens with one label, along skip links.
AGREE = 5.0
#: Prior evidence of any token for being outside.
OUTSIDE = 2.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails at its start fails everywhere within, so matches begin at run starts.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_NAME = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Dear)\.?[\x20\x09-\x0D]+(?=[A-Z])")
#: Numbers that may be personal although no base span covers them.
_NUMBER = re.compile(r"\+?\(?(?:[0-9][().-]*){7,}")
_ADDRESS = re.compile(rb"(?:Mrs?|Ms|Dr|Prof|Dear)\.?[\x20\x09-\x0D]")
_CAPITAL = re.compile(r"[A-Z][a-z'-]+[.,;:!?]*")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0



def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.tld, in time linear in the text: each at sign is tried once."""
    last, run_start, at = 0, 0, text.find("@")
    local = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        start = at
        floor = max(last, run_start)
        while start > floor and text[start - 1] in local:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        run_start = at + 1
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind number) of the base patterns' matches, by start and then kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def doubtful(text: str) -> list[Span]:
    """Phone and card matches of nine or more digits that failed their test: what they hold is unknown, so it teaches nothing."""
    out = []
    for pattern, accepted in ((_CARD, {s[:2] for s in base_spans(text) if s[2] == 2}), (_PHONE, {s[:2] for s in base_spans(text) if s[2] == 3})):
        out += [(m.start(), m.end(), 0) for m in pattern.finditer(text) if m.span() not in accepted and sum(c in "0123456789" for c in m[0]) >= 9]
    return sorted(out)


def _shape(token: str) -> str:
    """Letters as a, digits as 9, runs shortened to their length class; marks as they are."""
    out = []
    for m in re.finditer(r"[0-9]+|[A-Za-z\u0080-\U0010ffff]+|.", token, re.S):
        kind = "9" if m[0][0] in "0123456789" else "a" if len(m[0]) > 1 or m[0].isalpha() else m[0]
        out.append(kind if kind not in "9a" else kind + str(min(len(m[0]), 20 if kind == "9" else 2)))
    return "".join(out)


@dataclass
class Tokens:
    """The labelled tokens of one document: spans, feature ids, which follow a form of address, chain and skip links between them."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    addressed: list[bool]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS)


#: Features that every number and every word have, each of its sort.
ALWAYS = [_hash("number"), _hash("word")]


def _form(token: str) -> str:
    return "".join(c for c in token if c.isalnum()).lower()


def tokens(text: str, base: list[Span]) -> Tokens:
    """Skip links join each token with the first one like it, so evidence passes between any two in two steps and there are as many links as tokens."""
    addressed = {m.end() for m in _NAME.finditer(text)}
    parts = {p.lower() for a, b, k in base if k == 0 for p in re.split("[^A-Za-z]+", text[a:b].partition("@")[0]) if len(p) >= 3}
    names = parts | {_form(_TOKEN.match(text, at)[0]) for at in addressed}
    out = Tokens([], [], [], [], [])
    before, last_index, seen = "^", -2, {}
    pending: list[int] | None = None
    for index, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        marked = bool(_MARKED.search(token))
        form = _form(token) if marked or names and token[0].isupper() else ""
        named = not marked and form in names and bool(_CAPITAL.fullmatch(token))
        shape = _shape(token) if marked else "N" if named else "w"
        if pending is not None:
            pending.append(_hash(f"mn{shape}"))
            pending = None
        if marked or named:
            digits = re.sub("[^0-9]", "", token)
            if named:
                own = [ALWAYS[1], _hash(f"wc{m.start() in addressed}{form in parts}")]  # nothing else: all words whose label is known are names
            else:
                own = [ALWAYS[0], _hash(f"ms{shape}"), _hash(f"mp{before}"), _hash(f"md{min(len(digits), 24)}"), _hash(f"ml{len(digits) >= 12 and luhn(digits)}{'@' in token}{token[:1] in '+('}")]
            k = len(out.spans)
            out.spans.append((m.start(), m.end()))
            out.features.append(own)
            out.addressed.append(named and m.start() in addressed)
            pending = own if marked else None
            if last_index == index - 1:
                out.chain.append((k - 1, k))
            for key in {form if len(form) >= 4 or named else "", digits[-7:] if len(digits) >= 7 else ""} - {""}:
                if seen.setdefault(key, k) != k and (seen[key], k) not in out.skip[-2:]:
                    out.skip.append((seen[key], k))
            last_index = index
        before = shape
    return out


def labels(found: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """Label of each token: 0, or 1 + the kind of the first base span that overlaps it."""
    out, k = [], 0
    ordered = sorted(base)
    for a, b in found:
        while k < len(ordered) and ordered[k][1] <= a:
            k += 1
        out.append(next((1 + s[2] for s in ordered[k : k + 4] if s[0] < b and a < s[1]), 0))
    return out


@dataclass(frozen=True)
class Graph:
    """Tokens of many documents: feature ids and the token of each, number of tokens, links, and their kind (0 chain, 1 skip)."""

    features: np.ndarray
    owner: np.ndarray
    n: int
    links: np.ndarray
    kind: np.ndarray

    @classmethod
    def of(cls, documents: list[tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]]) -> Graph:
        """From (features, chain, skip) of each document."""
        first = np.cumsum([0, *(len(d[0]) for d in documents)])
        every = [f for d in documents for f in d[0]]
        links = [(a + at, b + at) for d, at in zip(documents, first.tolist(), strict=False) for pairs in d[1:] for a, b in pairs]
        kind = [k for d in documents for k, pairs in enumerate(d[1:]) for _ in pairs]
        flat = np.array([x for f in every for x in f], int)
        return cls(flat, np.repeat(np.arange(len(every)), [len(f) for f in every]) if every else flat, len(every), np.array(links, int).reshape(-1, 2), np.array(kind, int))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass(frozen=True)
class Field:
    """Weights (features x labels) and the potentials of chain and skip links (2 x labels x labels)."""

    weights: np.ndarray
    pair: np.ndarray

    def unary(self, g: Graph, held: np.ndarray | None = None) -> np.ndarray:
        """Evidence of each token alone; ``held`` tells which of its features count."""
        out = np.zeros((g.n, self.weights.shape[1]))
        if held is None:
            np.add.at(out, g.owner, self.weights[g.features])
        else:
            np.add.at(out, g.owner[held], self.weights[g.features[held]])
        return out

    def marginals(self, g: Graph, unary: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each token's and each link's labels, by loopy sum-product until messages settle; exact where links form no loop."""
        m = len(g.links)
        source, target = np.concatenate([g.links, g.links[:, ::-1]]).T
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        potential = np.concatenate([self.pair[g.kind], self.pair[g.kind].transpose(0, 2, 1)])
        message = np.zeros((2 * m, unary.shape[1]))
        belief = unary
        for _ in range(rounds if m else 0):
            new = _log_sum((belief[source] - message[back])[:, :, None] + potential, 1)
            new = DAMPING * message + (1 - DAMPING) * (new - new.max(1, keepdims=True))
            change = np.abs(new - message).max()
            message = new
            belief = unary.copy()
            np.add.at(belief, target, message)
            if change < SETTLED:
                break
        out = (belief[source[:m]] - message[m:])[:, :, None] + (belief[target[:m]] - message[:m])[:, None, :] + potential[:m]
        pairs = np.exp(out - _log_sum(out.reshape(m, out.shape[1] * out.shape[2]), 1)[:, None, None]) if m else out
        return np.exp(belief - _log_sum(belief, 1)[:, None]), pairs


def prior() -> Field:
    """What holds before anything is learned: tokens are outside, words are no numbers nor the other way round, and along skip links one label is favoured."""
    n = 1 + len(LABELS)
    weights = np.zeros((1 << FEATURE_BITS, n))
    weights[ALWAYS, 0] = OUTSIDE
    weights[ALWAYS[0], -1] = weights[ALWAYS[1], 1:-1] = -20
    return Field(weights, np.stack([np.zeros((n, n)), AGREE * np.eye(n)]))


def fit(documents: list[tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]], known: list[list[int]], steps: int = 40, rate: float = 0.5, kept: float = 0.7) -> Field:
    """Ascends the joint likelihood of the ``known`` labels (-1: unknown, summed over): at each step, what features and links carry with those labels held, less what they carry without, both by message passing."""
    n, before, field = 1 + len(LABELS), prior(), prior()
    g, label = Graph.of(documents), np.array([y for d in known for y in d], int)
    if not (label >= 0).any():
        return field
    held = np.where(label[:, None] < 0, 0.0, np.where(np.arange(n) == label[:, None], 0.0, -50.0))
    rng = np.random.default_rng(1)
    sums = [np.full_like(field.weights, 1e-3), np.full_like(field.pair, 1e-3)]
    for _ in range(steps):
        some = (rng.random(len(g.features)) < kept) | np.isin(g.features, ALWAYS)
        unary = field.unary(g, some)
        (free, free_pairs), (truth, true_pairs) = (field.marginals(g, u, 12) for u in (unary, unary + held))
        slope = [-0.1 * field.weights, before.pair - field.pair]
        np.add.at(slope[0], g.features[some], (truth - free)[g.owner[some]])
        for k in (0, 1):
            slope[1][k] += (true_pairs - free_pairs)[g.kind == k].sum(0)
        slope[0][ALWAYS] = 0  # the prior stays: what is known of tokens is mostly that they are personal
        for own, total, at in zip((field.weights, field.pair), sums, slope, strict=True):
            total += at * at
            own += rate * at / np.sqrt(total)
    return field


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents of a block hold a digit, an at sign or a form of address; no others can have a span."""
    hit = (data == 64) | ((data >= 48) & (data <= 57))
    for m in _ADDRESS.finditer(data.tobytes()):
        hit[m.start()] = True
    hit = np.concatenate([[0], np.cumsum(hit)])
    return np.flatnonzero(hit[offsets[1:]] > hit[offsets[:-1]])


def _weak_labels(text: str, t: Tokens, base: list[Span]) -> list[int]:
    """What is known of the tokens: base spans, words after a form of address, and that short numbers are neither.

    Failed matches, other long numbers and capitalised words, and what is
    linked with a base span, are unknown: patterns miss them for their form,
    which says nothing of what they are.
    """
    sure, unsure = labels(t.spans, base), labels(t.spans, doubtful(text))
    out = []
    for (a, b), addressed, y, d in zip(t.spans, t.addressed, sure, unsure, strict=True):
        unknown = d or not _MARKED.search(text, a, b) or _NUMBER.fullmatch(text, a, b)
        out.append(1 + len(KINDS) if addressed else -1 if unknown and not y else y)
    for a, b in t.skip:
        for x, y in ((a, b), (b, a)):
            if out[x] > 0 and out[y] == 0:
                out[y] = -1
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in _text.blocks(batches):
        out = []
        for i in _marked(data, offsets):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            base = base_spans(text)
            t = tokens(text, base)
            out.append((batch.column(1)[int(i)].as_py(), t.features, _weak_labels(text, t, base), [list(e) for e in t.chain], [list(e) for e in t.skip]))
        nested = pa.list_(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), nested, pa.list_(pa.int32()), nested, nested))], names=["o", "features", "labels", "chain", "skip"])


def _learn(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row of the field that the rows train: from the first on, each that has no more tokens than those before it leave of ``most``. A long document is left out alone, not with all behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, known, size = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                own = len(batch.column(1)[k])
                if size + own <= most:
                    size += own
                    row = [batch.column(c)[k].as_py() for c in range(1, 5)]
                    documents.append((row[0], row[2], row[3]))
                    known.append(row[1])
        field = fit(documents, known)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (field.weights, field.pair)], names=["weights", "pair"])

    return run


def train(docs: DataFrame, text_col: str = "text", most: int = TRAIN_DOCS, most_tokens: int = TRAIN_TOKENS) -> Field:
    """Fits the field on at most ``most`` distinct texts with tokens to label, the first by their hashes, and at most ``most_tokens`` such tokens; one task does, and the driver gets the weights."""
    n = max(docs.count(), 1)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").withColumns({"o": F.xxhash64("text")})
    # Hashes fall evenly: about 20 times the bound is looked at, as few documents may have such tokens.
    cut = -(2**63) + min(2**64 - 1, int(2**64 * min(1.0, 20 * most / n)))
    nested = "array<array<int>>"
    some = rows.where(F.col("o") <= F.lit(cut)).mapInArrow(_examples, f"o long, features {nested}, labels array<int>, chain {nested}, skip {nested}").dropDuplicates(["o"]).orderBy("o").limit(most)
    learned = some.repartition(1).sortWithinPartitions("o").mapInArrow(_learn(most_tokens), "weights binary, pair binary").first()
    if not learned:
        return fit([], [])
    width = 1 + len(LABELS)
    return Field(np.frombuffer(learned[0]).reshape(-1, width), np.frombuffer(learned[1]).reshape(2, width, width))


def added_spans(text: str, t: Tokens, label: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of neighbouring tokens with one label that touch no base span, without marks at their ends."""
    taken = np.zeros(len(t.spans), bool)
    taken[[k for k, y in enumerate(labels(t.spans, base)) if y]] = True
    joined = {b: a for a, b in t.chain}
    runs: list[list[int]] = []
    for k in range(len(t.spans)):
        if not label[k] or taken[k]:
            continue
        if runs and joined.get(k) == runs[-1][-1] and label[runs[-1][-1]] == label[k] and LABELS[label[k] - 1] in ("phone", "name"):
            runs[-1].append(k)
        else:
            runs.append([k])
    out = []
    for run in runs:
        a, b = t.spans[run[0]][0], t.spans[run[-1]][1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b and not any(s[0] < b and a < s[1] for s in base):
            out.append((a, b, int(label[run[0]]) - 1))
    return out


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def _find(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for batch, data, offsets in _text.blocks(batches):
            n = len(offsets) - 1
            counts, base_text, all_text = np.zeros((len(KINDS), n), np.int64), [""] * n, [""] * n
            held = []
            for i in _marked(data, offsets):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                base = base_spans(text)
                held.append((i, text, tokens(text, base), base))
            if held:
                g = Graph.of([(t.features, t.chain, t.skip) for _, _, t, _ in held])
                best = field.marginals(g, field.unary(g))[0].argmax(1)
                at = 0
                for i, text, t, base in held:
                    for s in base:
                        counts[s[2], i] += 1
                    base_text[i] = _text_of(base)
                    all_text[i] = _text_of(base + added_spans(text, t, best[at : at + len(t.spans)], base))
                    at += len(t.spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array([sha256(b.encode()).hexdigest() for b in base_text]), pa.array(all_text)], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    Counts and digest are of the base spans; ``spans`` has those and the ones
    that the field adds (of the base kinds and ``name``), as ``kind:start:end``
    in code points, end exclusive, by start and then kind. Without ``field``
    one is trained on ``docs``. Null and empty texts have no spans; a very
    long text is one graph, with as many links as tokens or so; repeated rows
    are treated alike; other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    field = field or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_find(shared), f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
