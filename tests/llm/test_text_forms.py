"""Chat windows, collocations and fill-in-the-middle: brute force, round trips and awkward rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from gaitlake.llm import collocations as col
from gaitlake.llm import oracles
from gaitlake.llm.chats import Template, chat_windows, read_back
from gaitlake.llm.fill_middle import BitVector, fill_in_middle, restored
from pyspark.sql import functions as F


def test_rank_and_select():
    rng = np.random.default_rng(0)
    for n, share in ((1, 1.0), (64, 0.5), (511, 0.1), (512, 0.9), (5000, 0.02), (5000, 1.0), (700, 0.0)):
        bits = rng.random(n) < share
        held, at = BitVector(bits), np.arange(n + 1)
        assert (held.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (held.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


def middle(doc_id, text):
    """The contract, in plain Python."""
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    return len(w), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_fill_in_middle_on_awkward_rows(spark, docs, rows, none):
    more = [(1000 + k, t) for k, t in enumerate(["a<P>b", "<S", "<", "é😀x\n\ty", "<M", ">", "<<P", "word " * 60_000, "\x00a\x00", "P><S", *["same text"] * 40])]
    frame = docs.select("doc_id", "text", F.lit("clash").alias("h"), F.lit(1).alias("form"), F.lit(2).alias("n")).union(spark.createDataFrame([(*r, "c", 1, 2) for r in more], "doc_id long, text string, h string, form int, n int"))
    got = fill_in_middle(frame).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    texts = [(r[0], r[1]) for r in rows] + more
    assert Counter(tuple(r) for r in got) == Counter((i, *middle(i, t), t or "") for i, t in texts)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(none).count() == 0


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want.astype(got.dtypes.to_dict()))


def phrases(docs, max_n=4, least=30, covered=80, top=2000):
    """The contract, in plain Python."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    good = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (g, p), a in good.items():
        if any(len(q) > len(p) and h == g and inside(p, q) and 100 * b >= covered * a for (h, q), b in good.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out.append((g, " ".join(p), a, left, right, n[g], score))
    ranked = []
    for g in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == g), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], k, *o[1:]) for k, o in enumerate(own[:top], 1)]
    return sorted(ranked)


@pytest.mark.parametrize(("least", "bits", "block"), [(30, 1 << 27, 4 << 20), (3, 1 << 27, 300), (3, 64, 4 << 20), (1, 1 << 12, 5000)])
def test_collocations_equal_brute_force(spark, least, bits, block):
    """Also with a filter that lets nearly all pass, and over many small blocks."""
    rng = random.Random(3)
    words = ["ab", "Ab", "b", "c\x00", "né", "ñ", "x7", "　", "zed", "😀"]
    join = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?", ""]) for _ in range(n))
    rows = [(rng.choice([None, "en", "de", ""]), join(rng.randrange(60))) for _ in range(60)] + [("en", None), ("en", ""), (None, " .. "), ("fr", None), ("en", "to be or not " * 3000), ("de", "ab b. " * 50)]
    rows += rows[:5]
    held = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "lang string, text string, phrase string, count int, n int")
    got = sorted(tuple(r) for r in col.collocations(held, least=least, filter_bits=bits, block_bytes=block).collect())
    assert got == phrases(rows, least=least) and got
    assert col.collocations(held.limit(0), least=least).count() == 0


def conversations():
    rng = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\n", "<", "s>", "word ", "é", "😀", "<\\s>", " "]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(n)))
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], text(60)) for c in range(8) for t in range(1 + c * 5)]
    rows += [(9, t, rng.choice([None, "tool\nx", "assistant"]), rng.choice([None, "", "a " * 300])) for t in range(150)]
    rows += [(10, 0, "system", "s " * 4000), (10, 1, "user", "u"), (10, 2, "assistant", "w " * 20_000), (10, 3, "assistant", ""), (11, 0, "system", "only"), (None, 1, "user", "x"), (None, None, "assistant", "y")]
    return rows + [rows[-1], (12, 5, "assistant", "tie"), (12, 5, "assistant", "tie"), (12, 5, "user", "b")]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*r, 0, "c", 1) for r in conversations()], "conv_id long, turn long, role string, text string, window int, conv string, pos int")


@pytest.mark.parametrize(("budget", "turns", "tokens"), [(2048, 4, 256), (120, 2, 30), (60, 0, 0), (1, 3, 10)])
def test_windows_read_back_give_every_turn_once(chats, budget, turns, tokens):
    got = {r["conv_id"]: r for r in read_back(chat_windows(chats, budget, turns, tokens)).collect()}
    want = {}
    for c, t, role, text in sorted(conversations(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["loss"] for c, r in got.items()} == {c: [t for role, t in w if role == "assistant"] for c, w in want.items()}


def test_windows_keep_their_budget(chats):
    budget, history = 400, 40
    rows = chat_windows(chats, budget, 3, history).collect()
    assert max(len([r for r in rows if r["conv_id"] == c]) for c in (7, 9)) > 3
    for r in rows:
        new = r["turns"] - r["repeated"]
        assert r["tokens"] <= budget or new == 1 or r["conv_id"] == 10
        assert r["repeated"] <= 4
        for turn in r["formatted"].split("</s>")[:-1]:
            assert turn.startswith("<s>") and not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>", turn[3:])
    own = [r for r in rows if r["conv_id"] == 7]
    assert all(r["formatted"].startswith("<s>system\n") for r in own) and any(r["repeated"] > 1 for r in own)


def test_windows_of_nothing_and_plan_without_python(chats):
    assert chat_windows(chats.limit(0)).count() == 0
    for frame in (chat_windows(chats), read_back(chat_windows(chats))):
        assert not re.search("Python|Arrow|Pandas|ExistingRDD", frame._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD", ""))


def test_escapes_are_reversible(spark):
    template = Template()
    texts = [(r[3] or "",) for r in conversations()] + [("\\",), ("<",), ("\\<s>",), ("<\\s>",), ("[[INST]]",), ("<<SYS>><</SYS>>",)]
    held = spark.createDataFrame(texts, "t string").withColumn("e", template.escaped(F.col("t"))).withColumn("b", template.unescaped(F.col("e")))
    for r in held.collect():
        assert r["b"] == r["t"] and not any(c in r["e"] for c in template.controls)


@pytest.mark.parametrize("name", ["COLLOCATIONS", "FILL_IN_MIDDLE"])
def test_oracle_on_awkward_rows(docs, rows, name):
    duck = duckdb.connect()
    duck.register("held", pd.DataFrame([r[:4] for r in rows if r[0] is not None], columns=["doc_id", "text", "lang", "source"]))
    duck.sql("create view documents as select * from held")
    held = docs.where("doc_id is not null")
    if name == "COLLOCATIONS":
        same(col.collocations(held).toPandas(), duck.sql(oracles.COLLOCATIONS).df())
    else:
        got = fill_in_middle(held).withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")
        same(got.toPandas(), duck.sql(oracles.FILL_IN_MIDDLE).df())
