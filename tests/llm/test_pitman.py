"""Word model: seating against a plain Chinese restaurant, messages, base scores by hand, held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.llm import pitman


def test_arrays_come_back():
    rng = np.random.default_rng(1)
    for a in (rng.integers(0, 300, 1000), rng.integers(0, 2**63, 50).astype(np.uint64), np.array([2**64 - 1], np.uint64),
              np.array([], np.int64), np.array([True, False]), rng.random(7), np.array([-5, 70_000])):
        assert (pitman.unpack(pitman.pack(a)) == a).all()


def seated_by_customers(c, strength, discount, sweeps, rng):
    """One dish, customer by customer: each leaves and sits down again by the weights of the tables."""
    tables, counts = [c], []
    at = [0] * c
    sizes = {0: c}
    for _ in range(sweeps):
        for i in range(c):
            sizes[at[i]] -= 1
            if not sizes[at[i]]:
                del sizes[at[i]]
            keys = list(sizes)
            weights = [sizes[k] - discount for k in keys] + [strength]
            k = rng.choices([*keys, None], weights)[0]
            if k is None:
                k = max(sizes, default=0) + 1
                sizes[k] = 0
            sizes[k] += 1
            at[i] = k
        counts.append(len(sizes))
    return np.array(counts[sweeps // 10 :]), tables


@pytest.mark.parametrize("c, strength, discount", [(2, 0.4, 0.5), (7, 1.5, 0.7), (30, 0.2, 0.8)])
def test_tables_are_drawn_as_customers_would_sit(c, strength, discount):
    counts, _ = seated_by_customers(c, strength, discount, 6000, random.Random(2))
    drawn = pitman.draw_tables(np.full(20_000, c), np.full(20_000, strength), discount, np.random.default_rng(3))
    assert drawn.mean() == pytest.approx(counts.mean(), rel=0.05)
    assert drawn.std() == pytest.approx(counts.std(), rel=0.1)
    assert pitman.expected(discount)(np.array([c]), np.array([strength]))[0] == pytest.approx(drawn.mean(), rel=0.03)


def test_large_dishes_follow_the_recursion(monkeypatch):
    """Means beyond the tabled counts agree with a table that reaches further."""
    discount, strengths = 0.7, np.array([0.01, 0.5, 3.0])
    c = np.full(3, 1000)
    near = pitman.expected(discount)(c, strengths)
    drawn = [pitman.draw_tables(np.full(20_000, 1000), np.full(20_000, s), discount, np.random.default_rng(1)).mean() for s in strengths]
    monkeypatch.setattr(pitman, "EXACT", 1000)
    pitman.stirling.cache_clear()
    try:
        exact = pitman.Expected(discount)(c, strengths)
    finally:
        pitman.stirling.cache_clear()
    assert near == pytest.approx(exact, rel=0.02) and drawn == pytest.approx(exact, rel=0.03)


def texts(prose, n):
    """Sentences in which every word decides the next one."""
    words = prose(5, 60)
    rng = random.Random(4)
    out = []
    for i in range(n):
        at, said = rng.randrange(60), []
        for _ in range(rng.randrange(1, 40)):
            said.append(words[at])
            at = (at * 7 + rng.choice([1, 1, 1, 2, 30])) % 60
        out.append(" ".join(said) + (f" own{i}" if i % 3 == 0 else ""))
    return out


def base_by_hand(rows, learned):
    def words(t):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]

    counts = Counter(w for i, t in rows if learned(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (i, len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
         sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)))
        for i, t in rows
    ]


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, prose, monkeypatch, small):
    if small:
        # Several chunks, shards and ranges, and restaurants that are split.
        for name, value in (("CHUNK_TOKENS", 300), ("SHARD_TOKENS", 2000), ("RANGE_WORDS", 100), ("FEWEST_HOT", 1)):
            monkeypatch.setattr(pitman, name, value)
    rows = list(enumerate(texts(prose, 600)))
    rows += [(600, None), (601, ""), (602, "ABC abc Äb äb"), (603, " \t"), (604, "the the " * 2000), (605, "the the " * 2000)]
    def learned(i):
        return zlib.crc32(str(i).encode()) % 5 != 1
    docs = spark.createDataFrame([(*r, 0.5, "w") for r in rows], "doc_id long, text string, score double, words string").repartition(3)
    scored = pitman.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).cache()
    got = {r["doc_id"]: r for r in scored.collect()}
    want = base_by_hand(rows, learned)
    assert len(got) == len(rows) == scored.count()
    for i, n_tokens, n_known, n, base in want:
        r = got[i]
        assert (r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (learned(i), n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and -1e4 < r["score"] < 0
    held = [r for i, r in got.items() if not learned(i) and i < 600]
    tokens = sum(r["n_tokens"] for r in held)
    model, base = (10 ** (-sum(r[k] for r in held) / tokens) for k in ("score", "base_score"))
    assert model < 0.5 * base
    told = {r["learned"]: r["perplexity"] for r in pitman.perplexity(scored.filter("doc_id < 600")).collect()}
    assert told[False] == pytest.approx(model)
    scored.unpersist()


def test_parent_gives_all_words_one():
    rng = np.random.default_rng(2)
    guests = rng.integers(1, 50, 200)
    tables = np.minimum(guests, rng.integers(1, 10, 200))
    parent = pitman.Parent(guests.sum(), tables.sum(), 200, 0.6, 1.5)
    unknown = parent.predictive(np.zeros(1), np.zeros(1))
    assert parent.predictive(guests, tables).sum() + unknown.sum() == pytest.approx(1)


def test_model_edges(spark, edge, nothing):
    assert pitman.score_texts(nothing, F.lit(True)).count() == 0
    out = pitman.score_texts(edge, F.col("lang") == "en").collect()
    assert len(out) == 10 and sum(r["learned"] for r in out) == 5
    assert {r["n_tokens"] for r in out if r["doc_id"] in (2, 3, 7)} == {1}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    none = pitman.score_texts(edge, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in none)
    assert all(r["score"] == pytest.approx(0, abs=1e-9) for r in none)
