import itertools
import random
import re
import time
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaitlake.llm import _text, pii
from gaitlake.llm.decontaminate import covered, decontaminate, tables
from gaitlake.llm.pii import base_spans, find_pii
from gaitlake.llm.quality_rules import cascade, default_rules, measures, planned, quality_rules
from gaitlake.llm.secrets import scan_secrets

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def spans_text(spans):
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(spans))


def brute_pii(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (name, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]) + sum(map(int, digits[-1::-2]))
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (12 <= len(digits) <= 19 and double % 10 == 0) or name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, name, m.end()))
    return out


def test_pii_base_equals_brute_force_and_the_field_adds(docs, rows, none):
    found = {r["doc_id"]: r for r in find_pii(docs).collect()}
    for r in rows:
        spans = brute_pii(r[1] or "")
        got = found[r[0]]
        assert got["base_sha256"] == sha256(spans_text(spans).encode()).hexdigest()
        assert [got[f"n_{n}"] for n in ("email", "ip", "card", "phone")] == [sum(s[2] == n for s in spans) for n in ("email", "ip", "card", "phone")]
        assert set(spans_text(spans).split(",")) <= set(got["spans"].split(","))
    assert find_pii(none).count() == 0


def test_field_splits_what_a_pattern_took_for_one(spark):
    rows = [(k, f"word +1 ({200 + k}) 555-{4000 + k} word 4485469220670619 end") for k in range(60)]
    rows.append((99, "call +1 (855) 555-4208 4485469220670619 now"))
    got = {r["doc_id"]: r["spans"] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == "phone:5:22,card:23:39"


def enumerated(field, g, unary):
    """Marginals by summing over all labellings."""
    n = unary.shape[1]
    nodes, pairs = np.zeros_like(unary), np.zeros((len(g.links), n, n))
    for y in itertools.product(range(n), repeat=g.n):
        p = np.exp(sum(unary[k, y[k]] for k in range(g.n)) + sum(field.pair[t][y[a], y[b]] for (a, b), t in zip(g.links.tolist(), g.kind.tolist(), strict=True)))
        for k in range(g.n):
            nodes[k, y[k]] += p
        for e, (a, b) in enumerate(g.links.tolist()):
            pairs[e, y[a], y[b]] += p
    return nodes / nodes.sum(1, keepdims=True), pairs / pairs.sum((1, 2), keepdims=True)


@pytest.mark.parametrize(("links", "kind", "close"), [([(0, 1), (1, 2), (1, 3)], [0, 1, 1], 2e-3), ([], [], 1e-9), ([(0, 1), (1, 2), (2, 3), (0, 3)], [0, 0, 0, 1], 0.06)])
def test_marginals_equal_enumeration(links, kind, close):
    """Exactly where links form no loop, nearly in a loop."""
    rng = np.random.default_rng(5)
    n = 1 + len(pii.LABELS)
    field = pii.Field(np.zeros((4, n)), rng.normal(size=(2, n, n)) * (1.5 if close < 0.01 else 0.7))
    g = pii.Graph(np.zeros(0, int), np.zeros(0, int), 4, np.array(links, int).reshape(-1, 2), np.array(kind, int))
    unary = rng.normal(size=(4, n))
    for got, want in zip(field.marginals(g, unary), enumerated(field, g, unary), strict=True):
        assert np.abs(got - want).max(initial=0) < close


def test_a_long_document_leaves_the_others_to_train_on(monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda documents, known: (seen.append([len(k) for k in known]), type("Field", (), {"weights": np.zeros(1), "pair": np.zeros(1)}))[1])
    nested = pa.list_(pa.list_(pa.int32()))
    rows = [(k, [[1]] * n, [0] * n, [], []) for k, n in enumerate((50, 4, 3, 9, 2))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), nested, pa.list_(pa.int32()), nested, nested))], names=["o", "features", "labels", "chain", "skip"])
    assert len(list(pii._learn(10)(iter([batch])))) == 1
    assert seen == [[4, 3, 2]]


def test_training_ascends_the_likelihood():
    """Its step is the slope of the log-likelihood, by enumeration and differences."""
    documents = [([[1], [2], [1]], [(0, 1)], [(0, 2)])]
    g = pii.Graph.of(documents)
    n = 1 + len(pii.LABELS)
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(1 << pii.FEATURE_BITS, n)), rng.normal(size=(2, n, n)))

    def likelihood(f):
        u = f.unary(g)
        score = lambda y: sum(u[k, y[k]] for k in range(3)) + sum(f.pair[t][y[a], y[b]] for (a, b), t in zip(g.links.tolist(), g.kind.tolist(), strict=True))
        every = [(y, score(y)) for y in itertools.product(range(n), repeat=3)]
        return np.log(sum(np.exp(s) for y, s in every if y[:2] == (4, 0))) - np.log(sum(np.exp(s) for _, s in every))

    free, free_pairs = field.marginals(g, field.unary(g))
    held = np.zeros((3, n))
    held[[0, 1]] = -50
    held[0, 4] = held[1, 0] = 0
    true, true_pairs = field.marginals(g, field.unary(g) + held)
    for k, a, b in ((0, 4, 0), (1, 4, 4), (1, 4, 2)):
        moved = field.pair.copy()
        moved[k, a, b] += 1e-4
        slope = (likelihood(pii.Field(field.weights, moved)) - likelihood(field)) / 1e-4
        assert (true_pairs - free_pairs)[g.kind == k].sum(0)[a, b] == pytest.approx(slope, abs=3e-3)
    moved = field.weights.copy()
    moved[1, 4] += 1e-4
    slope = (likelihood(pii.Field(moved, field.pair)) - likelihood(field)) / 1e-4
    assert (true - free)[[0, 2], 4].sum() == pytest.approx(slope, abs=3e-3)


def test_skip_links_decide(spark):
    """What one place says of a token holds at another, where the token alone does not say it; without skip links it does not."""
    rng = random.Random(2)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    short = lambda: str(rng.randrange(10 ** rng.randrange(1, 7)))
    rows = []
    for k in range(300):
        rows.append((k, f"word +1 ({200 + k}) {number()} word and lot {short()} of words, see Dr. Adams then"))
        rows.append((1000 + k, f"lot {short()} of words, part {short()} too, lot {short()} again, lot {short()} and {short()} again, Dr. Barnes said"))
    texts = {5000: "reach me at +1 (855) 412-4208 any day. Some words later, lot 8554124208 again.", 5001: "Some words later, lot 8554124208 again.", 5002: "Mrs. Whitcombe wrote. Later on Whitcombe signed, and whitcombe did not.", 5003: "Later on Whitcombe signed."}
    df = spark.createDataFrame([*rows, *texts.items()], "doc_id long, text string")
    field = pii.train(df.where("doc_id < 5000"))
    alone = pii.Field(field.weights, np.stack([field.pair[0], np.zeros_like(field.pair[1])]))
    some = df.where("doc_id >= 5000")
    linked, unlinked = ({r["doc_id"]: r["spans"] for r in find_pii(some, f).collect()} for f in (field, alone))
    again = texts[5000].rindex("8554124208")
    assert f"phone:{again}:{again + 10}" in linked[5000] and f"phone:{again}:{again + 10}" not in unlinked[5000]
    assert linked[5001] == unlinked[5001] == linked[5003] == ""
    again = texts[5002].index("Whitcombe signed")
    assert linked[5002] == f"name:5:14,name:{again}:{again + 9}" and unlinked[5002] != linked[5002]


def test_personal_data_of_a_long_text(spark):
    """One graph of thousands of linked tokens."""
    text = "Call +1 (855) 555-4208 now. " + "some words 555-4208 and more " * 4000
    (row,) = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["n_phone"] == 1
    assert row["spans"].startswith("phone:5:22")


def test_long_runs_take_linear_time():
    assert base_spans("1" * 200_000) == []
    assert base_spans("a" * 200_000 + "@" + "b" * 200_000) == []


def brute_secrets(text):
    kinds = (("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    return [(m.start(), k, n, m.end()) for k, (n, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]


def test_secrets_base_equals_brute_force(docs, rows, none, spark):
    found = {r["doc_id"]: r for r in scan_secrets(docs).collect()}
    for r in rows:
        spans = brute_secrets(r[1] or "")
        assert found[r[0]]["base_sha256"] == sha256(spans_text(spans).encode()).hexdigest()
        assert set(spans_text(spans).split(",")) <= set(found[r[0]]["spans"].split(","))
    assert scan_secrets(none).count() == 0


def test_widely_copied_values_are_examples(spark):
    example, live = "ghp_" + "Ab1" * 12, "ghp_" + "Cd2" * 12
    rows = [(k, f"é key {example} end", f"o{k}", "r") for k in range(5)] + [(9, f"key {live} token = token: abcdefgh", "o1", "r")]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[0]["spans"] == ""
    assert got[9]["live_spans"].startswith("prefixed:4:44")
    assert got[9]["n_assign"] == 0


def test_mixed_values_are_judged_whole(spark):
    """Also where the first digit, capital or small letter comes late, and in very long runs."""
    late = ["aB" * 30 + "7", "x7" * 30 + "B", "X7" * 30 + "a", "aB" * 200_000 + "7"]
    rows = [(k, f"key {v} end", "o", "r") for k, v in enumerate([*late, "aB" * 30])]
    got = {r["doc_id"]: r["live_spans"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got == {**{k: f"mixed:4:{4 + len(v)}" for k, v in enumerate(late)}, len(late): ""}


def brute_leaks(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = word.findall((text or "").translate(lower))
    hit, names = set(), set()
    for name, t in items:
        own = word.findall((t or "").translate(lower))
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for e in range(len(words) - n + 1):
                if words[e : e + n] == own[k : k + n]:
                    hit.update(range(e, e + n))
                    names.add(str(name or ""))
    return len(words), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_leaks_equal_brute_force(spark, docs, rows, none):
    items = [("q1", rows[9][1]), ("q2", "ONE, two"), ("q3", None), ("q4", ""), ("q5", rows[7][1][300:700]), ("q5", rows[7][1][300:700]), (None, "x" * 700)]
    table = spark.createDataFrame(items, "item_id string, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = {r[0]: brute_leaks(r[1], items) for r in rows}
    for size in (1 << 24, 200):  # in one search, and in several
        got = decontaminate(docs, table, chunk_bytes=size).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == want
    assert not decontaminate(docs, table.limit(0)).where("contaminated").count()
    assert decontaminate(none, table).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_shift_tables_never_skip_an_occurrence(window):
    """Every place at which a window ends, by comparing all; few words, so that blocks and ends of windows recur."""
    rng = random.Random(window)
    for _ in range(40):
        words = [f"w{rng.randrange(3)}" for _ in range(rng.randrange(1, 300))]
        items = [("a", " ".join(words[40:52]) or "w0"), ("b", " ".join(f"w{rng.randrange(3)}" for _ in range(15))), ("c", "w1")]
        raw = " ".join(words).encode()
        data = np.frombuffer(raw, np.uint8)
        hashes, start, end, first = _text.word_hashes(data, np.array([0, len(data)]), _text.ALNUM)
        for table in tables(items, window):
            got = {(e, table.patterns[p]) for e, p in table.search(hashes, first, lambda k: raw[start[k] : end[k]])}
            own = [tuple(w.encode() for w in words[e - table.length + 1 : e + 1]) for e in range(len(words))]
            assert got == {(e, w) for e, w in enumerate(own) if e >= table.length - 1 and w in table.patterns}


def test_occurrences_take_linear_time(spark):
    """A text that is nothing but benchmark text, and a bucket that most places share."""
    item = " ".join(f"w{k}" for k in range(30))
    template = [(f"t{k}", f"what is x{k} the y{k} of the z{k} in the end") for k in range(3000)]
    table = spark.createDataFrame([("a", item), *template], "item_id string, text string")
    texts = [(k, " ".join([item] * (500 << k))) for k in (0, 3)] + [(9, " ".join(f"what is x{k} the y{k + 1} of the z{k} in the end" for k in range(2900)))]
    times = []
    for row in texts:
        df = spark.createDataFrame([row], "doc_id long, text string")
        began = time.perf_counter()
        (got,) = decontaminate(df, table).collect()
        times.append(time.perf_counter() - began)
        assert (got["n_hit"], got["n_items"]) == ((got["n_words"], 1) if row[0] < 9 else (0, 0))
    assert times[1] < 30 and times[2] < 30
    assert covered([0, 9, 5, 14, 20, 20]) == 16


def test_quality_measures_equal_brute_force(docs, rows, none):
    found = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for r in rows:
        text = r[1] or ""
        words = SPACED.findall(text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        count, again = Counter(windows), set()
        for k, w in enumerate(windows):
            if count[w] > 1:
                again.update(range(k, k + 8))
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        got = found[r[0]]
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and got["kept"])
    assert quality_rules(none).count() == 0


def test_cascade_orders_by_rejections_per_cost(spark):
    """By brute force: at each place no rule rejects more of the rows that are left for its work; dear rules see those alone."""
    rng = random.Random(6)
    words = lambda n, f=str: " ".join(f(f"{rng.choice('bdfg')}{k}{rng.choice('aeiou')}{rng.randrange(99)}") for k in range(n))
    texts = [words(60) for _ in range(6)] + [words(60, str.upper) for _ in range(4)] + ["few"] * 10 + [words(25) + " ***---!!!???" * 40] * 3 + [words(30) + "\ufffd" * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = default_rules()
    rejects = {r.name: {x["doc_id"] for x in measures(df).where(r.rejects).collect()} for r in rules}
    left, steps = set(range(len(texts))), planned(df.select("text"), rules)
    for k, step in enumerate(steps):
        rate = lambda r: len(rejects[r.name] & left) / max(1, len(left) + r.passes * sum(len(texts[i] or "") for i in left))
        assert (step.reached, step.rejected) == (len(left), len(rejects[step.rule.name] & left))
        assert rate(step.rule) == max(rate(s.rule) for s in steps[k:])
        left -= rejects[step.rule.name]
    assert {s.rule.name for s in steps} == {r.name for r in rules}
    assert all(s.reached < len(texts) for s in steps if s.rule.passes >= 1)
    assert [s.rule.name for s in planned(df.select("text"), rules)] == [s.rule.name for s in steps]


def test_order_never_changes_the_verdict(docs):
    rules = default_rules()
    measured = measures(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    one, other = ({(r["doc_id"], r["kept"]) for r in cascade(measured, order).select("doc_id", "kept").collect()} for order in (rules, rules[::-1]))
    assert one == other


def test_repositories_count(spark):
    """One owner with a value in very many repositories carries an example."""
    copied, live = "ghp_" + "Ab1" * 12, "ghp_" + "Cd2" * 12
    rows = [(k, f"key {copied} end", "o", f"r{k}") for k in range(6)] + [(10 + k, f"key {live} end", "o", f"r{k}") for k in range(4)] + [(20, f"key {live} end", "o", "r0")]
    got = {r["doc_id"]: r["spans"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[0] == "" and got[10] == got[20] == "prefixed:4:44,mixed:4:44"
