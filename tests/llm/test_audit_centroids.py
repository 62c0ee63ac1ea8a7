"""Filter audit and centroid clustering against plain Python, with their edge cases."""

import re
from collections import Counter
from hashlib import sha256
from itertools import permutations
from math import floor

import numpy as np
import pytest

from daymark.llm import audit, centroids


def audited_by_hand(rows, labels):
    first, out = {}, {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        good = any(d == i and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if d is not None)
        parts.setdefault(source or "", []).append((fails, good, toxic))
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                counts = [0] * 6
                for fails, good, toxic in members:
                    gone = any(fails[x] for x in order[:step])
                    removed = fails[f] and not gone
                    alone = fails[f] and sum(fails.values()) == 1
                    for k, hit in enumerate((not gone and not fails[f], removed, fails[f] and gone, alone, removed and good, removed and toxic)):
                        counts[k] += hit
                out[part, "".join(order), step + 1] = counts
    return out


def test_audit_by_hand(spark, prose):
    long_text = " ".join(prose(1, 250, "abcdefghijklmnop"))
    texts = [long_text, long_text + " #", "word " * 300, "ABC def", "", None, " \t\n", "#", "a" * 50_000, long_text.upper(), "é ü 日本 \U0001f600"]
    rows = [(n, texts[n % len(texts)], ["a", "b", None, ""][n % 4]) for n in range(60)]
    rows += [(None, long_text, "a"), (None, "lone", "a"), (5, None, "b"), (5, None, "b"), (-3, long_text, "z")]
    labels = [(n, n % 2, n % 3 == 0 and 1) for n in range(0, 50)] + [(1, 0, 0), (1, 1, None), (None, 1, 1), (2, None, 1)]
    docs = spark.createDataFrame(
        [(*r, "x", "y", "z") for r in rows], "doc_id long, text string, source string, part string, mask string, n string"
    ).repartition(5)
    told = spark.createDataFrame([(a, b, int(c)if c is not None else None) for a, b, c in labels], "doc_id long, quality int, toxic int")
    want = audited_by_hand(rows, labels)
    got = {(r[0], r[1], r[2]): r for r in audit.audit(docs, told).collect()}
    assert set(got) == set(want)
    removed = Counter()
    for (part, order, step), counts in want.items():
        removed[part, order[step - 1]] += counts[1]
    for (part, order, step), counts in want.items():
        assert list(got[part, order, step][3:]) == [*counts, removed[part, order[step - 1]]]


def test_audit_edges(spark, edge, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(nothing, labels).count() == 0
    found = audit.audit(edge, labels)
    assert found.count() == 600 * 4
    rows = found.filter("step = 1 and part = 'a'").collect()
    assert all(r["kept"] + r["removed"] == 3 and r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_wide_integers_do_not_carry():
    most = (1 << 62) // 3
    total = most * audit.packed(1, True, False) + most * audit.packed(31, True, True)
    counts = audit.unpacked(total)
    first = audit.ORDERS.index("ABCDE")
    assert counts[first, 0].tolist() == [0, 2 * most, 0, most, 2 * most, most]
    assert counts[first, 1].tolist() == [0, 0, most, 0, 0, 0]


def clustered_by_hand(rows, k, rounds, seed, width, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vs in members.items():
            centres[n] = [sum(c) // len(vs) for c in zip(*vs)]
    final = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = sum(r[2] for r in final)
    return {
        (i, n, d, sum(r[2] for r in final if r[1] == n), inertia, sha256(",".join(map(str, centres[n])).encode()).hexdigest())
        for i, n, d in final
    }


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_clusters_by_hand(spark, spread):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centre[i % 6] + spread * rng.normal(size=16)]) for i in range(400)]
    # Ties, equal rows, and rows that take no part.
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000, None), (2001, [1.0] * 8), (2002, [float("nan")] * 16)]
    rows += [(2003, [float("inf")] + [0.0] * 15), (2004, [None] + [0.0] * 15), (2005, [])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(4)
    got = centroids.cluster(docs, k=9, width=16)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = got.collect()
    assert len(got) == 430 and {tuple(r) for r in got} == clustered_by_hand(rows, 9, 5, 2, 16)


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, [-0.5] * 64)], schema)
    got = sorted((r["vec_id"] or -1, r["cluster"], r["distance"]) for r in centroids.cluster(few).collect())
    # Two centroids are equal: the smaller number has both rows.
    assert got == [(-1, 2, 0), (1, 0, 0), (1, 0, 0)]


def test_huge_components_are_exact(spark):
    rows = [(i, [float(i * 10.0**e) for e in (0, 5, 9, 300)]) for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in centroids.cluster(docs, k=3, width=4).collect()}
    want = clustered_by_hand(rows, 3, 5, 2, 4)
    assert {r[:2] + r[5:] for r in got} == {r[:2] + r[5:] for r in want}
    assert all(a[2] == min(b[2], centroids.LARGEST) for a, b in zip(sorted(got), sorted(want)))


def test_search_leaves_worse_centroids():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 1)) * np.ones((1, 64), np.int64)
    points = centres[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 64))
    cluster, distance, seen = centroids.nearest(points, centres)
    whole = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert seen < 0.5 * points.size * 40
    assert (transform_by_hand(points[0]) == centroids.transform(points[:1])[0]).all()


def transform_by_hand(v):
    rows = [[(-1) ** bin(i & j).count("1") for j in range(len(v))] for i in range(len(v))]
    rows.sort(key=lambda r: sum(a != b for a, b in zip(r, r[1:])))
    return np.array(rows) @ v
