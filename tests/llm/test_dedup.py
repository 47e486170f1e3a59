import os
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from gaitlake.llm import components as cc
from gaitlake.llm import near_dedup, substrings
from gaitlake.llm._windows import super_windows
from gaitlake.llm.collection import columnwise, repeated
from gaitlake.llm.near_dedup import band_keys, block_links, lanes, linked, near_duplicates, one_of_each, shingle_sets
from gaitlake.llm.substrings import remove_repeats, repeats


def test_columnwise_equals_sorted_suffixes(tmp_path):
    rng = random.Random(3)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab\0c") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 8))]
        suffixes = sorted(([255 if c == 0 else c for c in s[k:]] + [i - 1000], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        bwt, lcp = columnwise(strings)
        assert bwt.tolist() == [(strings[i][k - 1] or 255) if k else 0 for _, i, k in suffixes]
        want = [0]
        for (x, _, _), (y, _, _) in zip(suffixes, suffixes[1:], strict=False):
            want.append(next((n for n in range(min(len(x), len(y))) if x[n] != y[n] or x[n] < 0), 0))
        assert lcp.tolist() == want
        count = Counter(s[k : k + 3] for s in strings for k in range(len(s) - 2))
        assert [f.tolist() for f in repeated(strings, 3)] == [[count[s[k : k + 3]] > 1 for k in range(max(0, len(s) - 2))] for s in strings]
    assert np.array_equal(columnwise(strings, str(tmp_path))[0], columnwise(strings)[0])


def test_equal_windows_have_equal_anchors():
    text = bytes(random.Random(1).choice(b"abcd") for _ in range(400))
    data = np.frombuffer(text + b"zz" + text[50:300], np.uint8)
    offsets = np.array([0, 400, len(data)])
    doc, start, n, place, _ = super_windows(data, offsets, 60, 20)
    anchor = {}
    for d, s, k, p in zip(doc, start, n, place, strict=True):
        for w in range(s, s + k):
            assert w + 60 <= offsets[d + 1]
            assert anchor.setdefault(data[w : w + 60].tobytes(), p - w) == p - w
    assert n.sum() == sum(offsets[1:] - offsets[:-1] - 59)


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(x), sum(gone), spans, sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1000, 1])
def test_removal_equals_brute_force(docs, rows, monkeypatch, most):
    """Also where every anchor with several runs is split into single windows."""
    monkeypatch.setattr("gaitlake.llm.substrings.MOST_RUNS", most)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect())
    assert got == Counter((r[0], *e) for r, e in zip(rows, brute_removal([r[1] for r in rows], 200), strict=True))


def test_repeats_number_anchors():
    a, b = bytes(range(65, 125)), bytes(range(100, 64, -1)) + bytes(range(66, 90))
    pieces = [a[:40], a[1:41]]
    assert [f.any() for f in repeats(pieces, 40, 20)] == [False, False]
    assert [f.all() for f in repeats([a[:40], a[:40], b[:40]], 40, 20)] == [True, True, False]


def test_split_windows_are_sent_twice_at_most(spark, monkeypatch):
    """However many contexts a passage has, a collection gets two copies of its windows, and the verdict reaches all rows."""
    monkeypatch.setattr(substrings, "MOST_RUNS", 3)
    rng = random.Random(11)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = line(260)
    rows = [(k, line(150) + passage + line(150)) for k in range(40)] + [(50, line(400))]
    rows.append(rows[0])
    collect = substrings._collect

    def counted(length, anchor):
        inner = collect(length, anchor)

        def run(batches):
            seen = Counter()

            def each():
                for batch in batches:
                    seen.update(zip(batch.column("collection").to_pylist(), batch.column("piece").to_pylist(), strict=True))
                    if max(seen.values(), default=0) > 2:
                        raise ValueError("more than two copies in one collection")
                    yield batch

            return inner(each())

        return run

    monkeypatch.setattr(substrings, "_collect", counted)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((r[0], *e) for r, e in zip(rows, brute_removal([r[1] for r in rows], 200), strict=True))


@pytest.mark.parametrize("most", [40, 3])
def test_split_anchors_make_few_rows(spark, monkeypatch, most):
    """Contexts of a passage that differ at many places: no step makes nearly as many rows as their runs have windows, in one step of narrowing or several."""
    monkeypatch.setattr(substrings, "MOST_RUNS", most)
    rng = random.Random(12)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = line(500)
    rows = []
    for k in range(120):
        own = list(passage)
        for p in rng.sample(range(500), 2):
            own[p] = rng.choice("klmnopqrst")
        rows.append((k, "".join(own)))
    rows += [(200, passage), (201, passage), (202, rows[0][1])]
    frame = type(spark.range(1))
    plain, made = frame.mapInArrow, []

    def counted(self, func, schema, *more, **named):
        rows_out = spark.sparkContext.accumulator(0)
        made.append((schema, rows_out))

        def run(batches):
            for batch in func(batches):
                rows_out.add(batch.num_rows)
                yield batch

        return plain(self, run, schema, *more, **named)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((r[0], *e) for r, e in zip(rows, brute_removal([r[1] for r in rows], 200), strict=True))
    data = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8)
    _, start, n, _, anchors = super_windows(data, np.cumsum([0, *(len(r[1]) for r in rows)]), 200, 120)
    kinds = {(h, data[s : s + k + 199].tobytes()): k for h, s, k in zip(anchors.tolist(), start.tolist(), n.tolist(), strict=True)}
    runs = Counter(h for h, _ in kinds)
    windows = sum(k for (h, _), k in kinds.items() if runs[h] > most)
    # The first step cuts the documents into runs.
    later = [(schema, rows_out.value) for schema, rows_out in made[1:]]
    assert max(n for _, n in later) < windows / 4, (windows, later)
    assert sum(schema.startswith("near ") for schema, _ in later) > (most < 40)


def test_repeats_of_many_pieces(monkeypatch):
    """Also beyond the bytes that one call of super_windows takes uncut."""
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(1500))
    data = np.frombuffer(text, np.uint8)
    _, start, n, _, _ = super_windows(data, np.array([0, len(data)]), 40, 20)
    pieces = [text[s : s + k + 39] for s, k in zip(start.tolist(), n.tolist(), strict=True)]
    pieces.append(pieces[5])
    want = [f.tolist() for f in repeats(pieces, 40, 20)]
    assert sum(map(any, want)) == 2
    monkeypatch.setattr("gaitlake.llm._windows.PLACE_BITS", 9)
    assert [f.tolist() for f in repeats(pieces, 40, 20)] == want


def test_empty_tables(none):
    assert remove_repeats(none).count() == 0
    assert near_duplicates(none).count() == 0


def brute_groups(rows, width, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in ((r[0], r[1]) for r in rows if r[0] is not None):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: (len(sets[i]), group[i], group[i] == i) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_groups_equal_brute_force(docs, rows, width):
    found = [r for r in near_duplicates(docs, width=width).collect()]
    assert len(found) == len(rows)
    want = brute_groups(rows, width, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None} == want
    assert len({g for _, g, _ in want.values()}) < len(want)


def test_large_buckets_are_searched_to_the_end(spark, monkeypatch):
    """Chains whose links the leaders do not see, in blocks of two rows or so."""
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        words = list(base)
        for p in rng.sample(range(60), rng.randrange(1, 4)):
            words[p] = f"e{rng.randrange(3)}"
        rows.append((k * 3 % 41, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, width=4).collect()}
    assert got == brute_groups(rows, 4, 80)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_one_id_with_several_texts(spark, order):
    """Sets are the nodes: neither text of a shared id loses its links, in any order of the rows."""
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    rows = rows[order:] + rows[:order]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found) == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1})


def test_null_ids_are_linked(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(None, a), (7, a + " more"), (9, a + " more ."), (None, b), (None, b + " more"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in near_duplicates(df, width=4).collect())
    assert found == Counter({(None, True, 7, False): 1, (7, True, 7, True): 1, (9, True, 7, False): 1, (None, True, None, True): 2, (None, False, None, True): 2})
    kept = one_of_each(df, width=4).collect()
    assert Counter((r["doc_id"], (r["text"] or "-")[:1]) for r in kept) == Counter({(7, "a"): 1, (None, "b"): 1, (None, "-"): 2})


def test_one_of_each_group_stays(spark, docs, rows):
    """Clashing names, repeated rows, an id with two texts: one row of each group, and every row without words."""
    more = [(6, "quite another text of six words", *rows[6][2:]), (6, rows[6][1] + " x", *rows[6][2:])]
    df = docs.union(spark.createDataFrame(more, docs.schema))
    kept = one_of_each(df, width=5).collect()
    assert kept[0].asDict().keys() == rows_keys(docs)
    every = [*rows, *more]
    wide = brute_groups([(k, r[1]) for k, r in enumerate(every)], 5, 80)
    want = Counter()
    for root in {g for n, g, _ in wide.values() if n}:
        best = min((every[k] for k, (n, g, _) in wide.items() if n and g == root), key=lambda r: (r[0] is None, r[0] or 0))
        want[best[0]] += 1
    want.update(every[k][0] for k, (n, _, _) in wide.items() if not n)
    assert Counter(r["doc_id"] for r in kept) == want


def rows_keys(df):
    return dict.fromkeys(df.columns).keys()


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_signature_estimates_similarity_and_bands_find_it(similarity):
    """Lanes agree as often as their sets are alike, with less spread for 64 evaluations than one lane for each would have, and nearly all pairs share a band."""
    rng = np.random.default_rng(4)
    shares, met = [], 0
    for _ in range(300):
        both, own = int(similarity * 400), 400 - int(similarity * 400)
        every = rng.integers(0, 2**63, both + own, dtype=np.uint64)
        cut = rng.integers(0, own + 1)
        a, b = np.sort(every[: both + cut]), np.sort(np.concatenate([every[:both], every[both + cut :]]))
        x, y = lanes(a), lanes(b)
        shares.append((x == y).mean())
        met += (band_keys(a) == band_keys(b)).any()
    assert np.mean(shares) == pytest.approx(similarity, abs=0.01)
    assert np.std(shares) < 0.85 * np.sqrt(similarity * (1 - similarity) / 64)
    assert met >= 0.99 * 300


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_of_queries_against_all_rows(spark):
    """Every document whose id is divisible by 50 against all others, by brute force: at least nine tenths of the links, here all of them, are within components."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    component = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, width=4).collect()}
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = dict(zip([i for i, _ in texts], shingle_sets(pa.array([t for _, t in texts], pa.string()), 4), strict=True))
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and len(sets[a]) and len(sets[b]) and linked(sets[a], sets[b], 80)]
    assert links
    assert sum(component[a] == component[b] for a, b in links) == len(links)


@pytest.mark.parametrize("hot", [1, 500])
def test_large_groups_are_not_gathered(spark, docs, rows, monkeypatch, hot):
    """The same result where nearly every group counts as large."""
    monkeypatch.setattr(near_dedup, "HOT_ROWS", hot)
    found = near_duplicates(docs, width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None} == brute_groups(rows, 4, 80)


def test_block_links_join_what_is_linked():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 6], [9])]
    assert sorted(map(sorted, block_links(sets, np.arange(4), np.arange(4), np.zeros(4, int), 80))) == [[0, 1], [1, 2]]
    assert block_links(sets, np.arange(4), np.zeros(4, int), np.zeros(4, int), 80) == []


@pytest.mark.parametrize("local", [1_000_000, 3])
def test_components(spark, monkeypatch, local):
    """In one task, and by star steps over many."""
    monkeypatch.setattr(cc, "LOCAL_EDGES", local)
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(12)] + [(200, 200 + k) for k in range(1, 9)] + [(7, 7), (None, 3)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        stack = [n]
        while stack and n not in want or stack:
            x = stack.pop()
            if x not in want:
                want[x] = n
                stack += near[x]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r["node"]: r["component"] for r in cc.components(df).collect()} == want
    assert cc.components(df.limit(0)).count() == 0
