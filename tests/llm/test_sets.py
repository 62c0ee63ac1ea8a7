"""Exact copies, near copies, mixture, lines, tokens, nearest vectors, and the pipeline."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daymark.llm import bpe, exact, lines, mixing, near, topk
from daymark.llm import pipeline as corpus_pipeline

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def test_content_table_compares_contents():
    table = exact.ContentTable(4)
    placed = [table.place(7, str(i % 50).encode())[0] for i in range(200)]
    assert placed == [i % 50 for i in range(200)]


@pytest.mark.parametrize("bucket_bytes", [exact.BUCKET_BYTES, 300])
def test_exact_copies(spark, bucket_bytes):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 4))) for _ in range(400)]
    texts += [t.replace(" ", rng.choice([" ", "\t\n", "  "])) for t in texts[:100]] + ["same text"] * 200 + [None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub(" ", t or "")].append(i)
    want = {
        (i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    }
    got = exact.find_copies(docs, bucket_bytes=bucket_bytes).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_exact_edges(edge, nothing):
    out = exact.find_copies(edge).collect()
    assert len(out) == 10
    # The repeated row stays once; null, empty and blank texts: null equals empty only.
    assert sum(r["kept"] for r in out if r["doc_id"] == 1) == 1
    assert {r["doc_id"]: r["keep_id"] for r in out}[3] == 2
    kept = exact.drop_copies(edge)
    assert kept.columns == edge.columns and kept.count() == 8
    assert exact.find_copies(nothing).count() == 0 and exact.drop_copies(nothing).count() == 0


def test_exact_copies_over_three_levels(spark, monkeypatch):
    """Few buckets a level: what does not fit is spilled and dealt again, twice."""
    monkeypatch.setattr(exact, "FAN_OUT", 3)
    written, real = [], exact.materialise
    monkeypatch.setattr(exact, "materialise", lambda df, name: written.append(name) or real(df, name))
    texts = [f"text {i % 90} " * 20 for i in range(180)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = exact.find_copies(docs, bucket_bytes=2000).collect()
    assert written.count("spilled") >= 2
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, i % 90, 2) for i in range(180)}


def test_which_of_equal_rows_stays(spark):
    rows = [(1, "same", f"note {i}") for i in range(6)] + [(2, "same", "later"), (None, "lone", "a"), (None, "lone", "b")]
    schema = "doc_id long, text string, __sha256 string"
    one, two = (sorted(map(str, exact.drop_copies(spark.createDataFrame(r, schema).repartition(3)).collect())) for r in (rows, rows[::-1]))
    assert one == two and len(one) == 2


def shingle_strings(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def classes_by_hand(rows, width, percent):
    sets = {i: shingle_strings(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i)) for i in ids}


def near_rows(prose):
    """Families around the limit, a shared passage, copies, short texts of all lengths."""
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = prose(family, rng.choice([9, 25, 60, 150]))
        for _ in range(18):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 20 + 1)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(99)], [words[at], "more"]])
            rows.append(" ".join(words))
    passage = prose(99, 30)
    rows += [" ".join(passage + prose(1000 + i, rng.randrange(0, 40))) for i in range(120)]
    rows += [" ".join(prose(7, n)) for n in range(12)] * 2 + ["Same Text", "same  text", "", " "]
    return list(enumerate(rows))


@pytest.mark.parametrize("width, percent, block", [(4, 85, near.BLOCK), (5, 80, 8)])
def test_near_copies(spark, prose, monkeypatch, width, percent, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = near_rows(prose)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near.near_duplicates(docs, width=width, percent=percent).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == classes_by_hand(rows, width, percent)


def test_linked_sets_share_a_key(prose):
    """Sets at the limit of similarity always show a common key, in any band."""
    rng = np.random.default_rng(3)
    bands = near.Bands(85)
    for _ in range(400):
        size = int(np.exp(rng.uniform(0, np.log(3000)))) + 1
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        most = bands.differing(2 * len(a))
        b = np.unique(a[: len(a) - int(rng.integers(0, most + 1))])
        if not len(b) or not near.linked(a, b, 85):
            continue
        keys = [set(np.concatenate([near.part_keys(s, k, bands) for k in bands.of(len(s))]).tolist()) for s in (a, b)]
        assert keys[0] & keys[1]


def shown_keys(hashes, bands):
    return np.concatenate([near.part_keys(hashes, k, bands) for k in bands.of(len(hashes))])


@pytest.mark.parametrize("deals, spare", [(near.DEALS, near.SPARE), (1, 0), (2, 3)])
@pytest.mark.parametrize("percent", [50, 80, 95])
def test_linked_sets_share_a_shown_part(monkeypatch, percent, deals, spare):
    """Sets at the limit, one in the other or each with shingles of its own, also where parts run short."""
    monkeypatch.setattr(near, "DEALS", deals)
    monkeypatch.setattr(near, "SPARE", Fraction(spare))
    rng = np.random.default_rng(percent)
    bands, met = near.Bands(percent), 0
    for i in range(400):
        size = 1 + i % 12 if i % 2 else int(np.exp(rng.uniform(0, np.log(600)))) + 1
        pool = np.unique(rng.integers(0, 2**63, 3 * size).astype(np.uint64))
        rng.shuffle(pool)
        a, gap = pool[:size], 0
        for b in (pool[size - 1 :: -1], pool[: size * 100 // percent]):
            if len(b) == size:
                gap = bands.differing(2 * size) // 2
                b = np.concatenate((a[gap:], pool[size : size + gap]))
            a, b = np.sort(a), np.sort(b)
            if near.linked(a, b, percent):
                met += 1
                assert set(shown_keys(a, bands).tolist()) & set(shown_keys(b, bands).tolist())
            a = pool[:size]
    assert met > 600


def test_unlike_sets_of_one_size_show_no_common_key():
    """Empty parts and parts that hold only a common passage are the same in unlike sets."""
    rng = np.random.default_rng(8)
    bands = near.Bands(80)
    for size, passage, most in ((60, 0, 1), (150, 0, 1), (200, 9, 6), (800, 9, 3)):
        common = rng.integers(0, 2**63, passage).astype(np.uint64)
        keys = []
        for _ in range(300):
            own = rng.integers(0, 2**63, size + int(rng.integers(0, size // 4)) - passage).astype(np.uint64)
            keys.append(shown_keys(np.unique(np.concatenate((common, own))), bands))
        assert np.unique(np.concatenate(keys), return_counts=True)[1].max() <= most


def test_groups_of_unlike_documents_stay_empty(spark, prose):
    rows = [(i, " ".join(prose(5000 + i, 60 + i % 40))) for i in range(240)]
    texts = spark.createDataFrame(rows, "id long, body string").repartition(3)
    shown = near.groups_of(texts, texts.limit(0).select("id"), 5, 80, 240 * 80)
    assert shown.count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in near.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_near_edges(edge, nothing):
    out = near.near_duplicates(edge).collect()
    assert len(out) == 10
    assert all(r["component_id"] == r["doc_id"] for r in out)
    assert near.near_duplicates(nothing).count() == 0


def test_targets_stop_and_are_reshared(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, None: 300, "B": 0, "d": 2000}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    stopped = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)) / sum(
            weight[s] for s in order if s not in stopped
        )
        more = {s for s in order if s not in stopped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    for s in order:
        assert got[s]["target"] == pytest.approx(3 * sizes[s] if s in stopped else level * weight[s])


def test_mixture_meets_targets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(3)
    rows = [(i, "w " * int(rng.lognormvariate(3, 1)), rng.choice(["x", "x", "x", "y", "z"])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.copies(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again
    taken, target = defaultdict(int), {}
    for _, source, size, _, aim, times in first:
        assert 0 <= times <= 3
        taken[source] += size * times
        target[source] = aim
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.03)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[5] for r in first)


def test_mixed_rows_are_the_copies(spark):
    """Each row as often as its document is taken; rows that differ in one column only stay apart."""
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}", None if i % 5 else "x") for i in range(400)]
    rows += [(1000, "w w w w", "s0", None), (1000, "w w w w", None, "s0"), (None, "w w", "s1", "a"), (None, "w w", "s1", None), (None, "w w", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __number string").repartition(5)
    taken = {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect() if r["doc_id"] is not None and r["doc_id"] < 1000}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    seen = defaultdict(int)
    for r in mixed.collect():
        seen[tuple(r)] += 1
    assert set(seen) <= set(rows)
    assert all(seen[r] == taken[r[0]] for r in rows[:400])
    # Everything three times where the target allows it, so no row can hide another.
    every = spark.createDataFrame([(7, "w w", "a", None), (7, "w w", "a", "x"), (8, "v " * 400, "b", None)], docs.schema)
    assert {tuple(r) for r in mixing.mix(every).collect()} >= {(7, "w w", "a", None), (7, "w w", "a", "x")}


def test_taken_words_meet_targets_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in mixing.copies(docs).collect():
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(size.values())) and len(target) > 5
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.05)


def test_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 50, 12).astype(float))[::-1]
    shares = np.full(12, 0.3)
    mean = np.zeros(12)
    for _ in range(4000):
        out, held = mixing.round_pairs(sizes, shares, rng.random(12))
        assert sizes @ out == pytest.approx(sizes @ shares)
        assert sum(0 < x < 1 for x in out) <= 1 and (held < 0 or 0 < out[held] < 1)
        mean += out / 4000
    assert np.abs(mean - 0.3).max() < 0.04
    large = np.array([500.0, *[10.0] * 200])
    mean = np.zeros(201)
    for _ in range(2000):
        shares = np.full(201, 0.3)
        done = mixing.settle_large(large, shares, rng.random(201))
        assert done >= 1 and large @ shares == pytest.approx(large.sum() * 0.3)
        mean += shares / 2000
    assert np.abs(mean - 0.3).max() < 0.04


def test_mixture_edges(edge, nothing):
    out = mixing.copies(edge).collect()
    assert len(out) == 10 and all(0 <= r["copies"] <= 3 for r in out)
    assert mixing.mix(edge).columns == edge.columns
    assert mixing.copies(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_lines_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["h", "h", "h", "g", None]), ["top", f"own {i}", "top", rng.choice("abcdefgh")]) for i in range(200)]
    rows += [(200, "lone", ["top"]), (201, "h", None), (202, "h", [])]
    pages = spark.createDataFrame(rows, "page_id long, site string, body array<string>")
    out = lines.drop_boilerplate(pages, "page_id", F.col("site"), F.col("body"), ratio=0.2, min_pages=5).collect()
    holds, total = defaultdict(set), defaultdict(int)
    for i, site, body in rows:
        total[site] += 1
        for x in body or []:
            holds[site, x].add(i)
    got = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out}
    for i, site, body in rows:
        drop = site is not None and total[site] >= 5
        kept = [x for x in body or [] if not (drop and len(holds[site, x]) > 0.2 * total[site])]
        text = None if body is None else "\n".join(kept)
        assert got[i] == (len(body or []), len(body or []) - len(kept), text)


def test_lines_of_a_very_large_host(spark, monkeypatch):
    """Parts of hosts change nothing: repeated rows, rows without an id, a very long page, one host with most pages."""
    rows = [(None if i % 9 == 0 else i % 300, "h" if i % 4 else f"g{i % 40}", ["nav", f"own {i}", "x" * 50_000 if i == 5 else "foot"]) for i in range(1200)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, site string, body array<string>, part int, parts int").repartition(6)
    found = []
    for size in (lines.PART_PAGES, 7):
        monkeypatch.setattr(lines, "PART_PAGES", size)
        out = lines.drop_boilerplate(pages, "page_id", F.col("site"), F.col("body"))
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] and len(found[0]) == 1200
    host = [r for r in lines.drop_boilerplate(pages, "page_id", F.col("site"), F.col("body")).collect() if r["host"] == "h"]
    assert {r["n_dropped"] for r in host} == {1, 2} and sum(r["n_dropped"] == 1 for r in host) == 1


def test_lines_edges(spark):
    schema = "page_id long, url string, html string, host string, text string"
    rows = [(None, None, None, "x", "y"), (1, "http://U@Ex.org:80/p", "<p>a</p>b<br/>", None, None), (2, "nope", "", "", "")]
    for data in (rows, []):
        pages = spark.createDataFrame(data, schema)
        out = lines.drop_boilerplate(pages, "page_id", lines.host_of(F.col("url")), lines.page_lines(F.col("html")))
        found = {r["page_id"]: tuple(r)[1:] for r in out.collect()}
        if data:
            assert found == {None: (None, 0, 0, None), 1: ("ex.org", 2, 0, "a\nb"), 2: (None, 0, 0, "")}
        else:
            assert not found


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.WordBpe.load(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(word_bpe):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    ranges = [(32, 127), (0, 0x250), (0x250, 0x3000), (0x10000, 0x10400)]
    texts = ["", "  ", "\x00a\x1c b\x85c\xa0d", "ΣΑΣ ÉCOLE İstanbul", "<|endoftext|>Hi<|startoftext|> <|endoftext|"]
    texts += ["it's We'LL don't", "a" * 700, "\U0001f600\U0001f600 日本", "ǅ ŉ ﬁ ½"]
    texts += ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(50)) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert word_bpe.encode(text) == want
        assert word_bpe.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_queue_merges_like_the_scan(word_bpe):
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("abcdeinthor'1") for _ in range(rng.randrange(1, 40)))
        parts = [word_bpe.vocab[c] for c in word[:-1]] + [word_bpe.vocab[word[-1] + word_bpe.suffix]]
        assert word_bpe._scan(parts[:]) == word_bpe._queue(parts[:])


def test_bpe_edges(edge, nothing, word_bpe):
    out = bpe.decode(bpe.encode(edge, word_bpe), word_bpe).collect()
    assert len(out) == 10 and [r["ids"] for r in out if r["doc_id"] in (2, 3, 7)] == [[], [], []]
    assert bpe.encode(nothing, word_bpe).count() == 0


@pytest.mark.parametrize("shard_rows", [topk.SHARD_ROWS, 40])
def test_top_k_by_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 256]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, []), (304, [1.0] * 3), (306, [1.0] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 6 == 0, k=4, shard_rows=shard_rows).collect()))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:300] + rows[-2:]}
    want = []
    for q in (i for i in whole if i % 6 == 0):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:4])]
    assert got == sorted(want)


def brute_top_k(rows, is_query, k):
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v]
    out = []
    for q in sorted({i for i, _ in whole if is_query(i)}):
        v = min(list(x) for i, x in rows if i == q and x)
        ints = [math.floor(256 * Fraction(x)) for x in v]
        scored = sorted((-sum(a * b for a, b in zip(ints, w)), i) for i, w in whole if i != q and len(w) == len(ints))
        out += [(q, n + 1, i, max(-topk.LARGEST, min(topk.LARGEST, -s))) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("shard_rows", [topk.SHARD_ROWS, 12])
def test_top_k_edges(spark, shard_rows):
    """Null and repeated ids, clashing columns, integers beyond 64 bits, negative ones, equal rows."""
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-9, 9) for _ in range(4)]) for i in range(60)]
    rows += [(None, [1.0] * 4), (7, [0.5] * 4), (7, [0.5] * 4), (100, [1e200, 0.0, 1.0, 2.0]), (105, [-1e200, 1.0, 0.0, 3.0])]
    rows += [(110, [2.0**58, 1.0, 0.0, 0.0]), (111, [2.0**58, 1.0, 0.0, 0.0]), (115, [3e30, -2e30, 1e9, 0.25]), (5, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, id int, width int, floor string")
    got = sorted(map(tuple, topk.top_k(docs.repartition(3), F.col("vec_id") % 5 == 0, k=3, shard_rows=shard_rows).collect()))
    # Scores beyond 64 bits are ranked by their nearest doubles, which differ here.
    assert got == sorted(brute_top_k(rows, lambda i: i % 5 == 0, 3))


def test_queries_visit_few_shards_and_leaves(spark, monkeypatch):
    """Vectors in directions: most shards cannot reach the k-th score, nor most leaves of a shard."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(4000, 16)) * 0.05
    data[:, :4] += 5 * rng.choice([-1, 1], (4000, 4))
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    visits, real = [], topk.materialise

    def counted(df, name):
        out = real(df, name)
        if name in ("second-shards", "visits"):
            visits.append(out.count())
        return out

    monkeypatch.setattr(topk, "materialise", counted)
    got = topk.top_k(docs, F.col("vec_id") % 40 == 0, shard_rows=250).collect()
    assert len(got) == 500 and sum(visits) < 0.35 * 100 * 16
    ints = np.floor(256 * data)
    for r in got[:50]:
        scores = ints @ ints[r["query_id"]]
        scores[r["query_id"]] = -np.inf
        assert r["score"] == np.sort(scores)[-r["rank"]]
    compared = []
    topk.search(ints, np.arange(4000), ints[:50], list(range(50)), [-np.inf] * 50, 5, compared)
    assert compared[0] < 0.3 * 50 * 4000


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, score int")
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark, edge, nothing, prose, tmp_path):
    rows = near_rows(prose)
    docs = spark.createDataFrame(
        [(i, t, "aa", f"s{i % 3}", len(t)) for i, t in rows] + [(10_000, "1 2 3", "aa", "s0", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        counts.append(kept.count())
    lettered = [(i, t) for i, t in rows if any(c.isalpha() for c in t)]
    assert counts[0] == len(lettered)
    first = {}
    for i, t in lettered:
        first.setdefault(BLANK.sub(" ", t), i)
    assert counts[1] == len(first)
    left = [(i, t) for i, t in lettered if first[BLANK.sub(" ", t)] == i]
    want = {i for i, _, c in classes_by_hand(left, 5, 80) if i == c}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= want
    for some in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, "")
        some.count()


def test_stages_leave_other_columns_alone(spark, prose, nothing):
    """Columns that are called like those the stages work with come back as they were."""
    extra = ["score", "lang_pred", "__row", "__times", "__copy", "__held", "__sha256", "__number", "id", "n_tokens"]
    rows = [(i, " ".join(prose(i, 30)), "aa", "s", 5, *[float(i * 100 + k) for k in range(len(extra))]) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` double" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= set(rows) and out.count() > 10
    assert {tuple(r) for r in corpus_pipeline.keep_language(spark, docs, "").collect()} == set(rows)


def test_rows_point_to_the_smallest_of_their_key():
    keys, ids = np.array([5] * 3 + [7] + [9] * 2), np.array([4, 6, 8, 1, 2, 9])
    assert near.roots(keys, ids).tolist() == [4, 4, 4, 1, 2, 2]
    assert not len(near.roots(keys[:0], ids[:0]))


def test_a_large_family_and_many_chunks(spark, prose, monkeypatch):
    """One text with many near copies: chunks of a few documents, partners and copies in parts."""
    from daymark.llm import parts

    for module, name, value in ((near, "CHUNK_KEYS", 2000), (near, "RANGE_KEYS", 5000), (near, "PARTNERS", 7), (parts, "PART_ROWS", 9)):
        monkeypatch.setattr(module, name, value)
    rng, base = random.Random(4), prose(1, 120)
    rows = []
    for i in range(220):
        words = list(base)
        words[rng.randrange(120)] = f"new{i}"
        rows.append(" ".join(words) if i % 3 else " ".join(base).upper())
    rows += [" ".join(prose(100 + i, 80)) for i in range(30)]
    rows = list(enumerate(rows))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=5, percent=80).collect()
    assert {tuple(r) for r in got} == classes_by_hand(rows, 5, 80)


def test_near_stage_takes_ids_of_32_bits(spark, prose):
    schema = "doc_id {}, text string, lang string, source string, n_chars long"
    rows = [(i, t, "aa", "s", len(t)) for i, t in near_rows(prose)]
    left = [
        {r["doc_id"] for r in corpus_pipeline.drop_near(spark, spark.createDataFrame(rows, schema.format(t)), "").collect()}
        for t in ("long", "int")
    ]
    assert left[0] == left[1] and len(left[0]) < len(rows)


def test_language_stage_keeps_short_and_mixed_texts(spark, prose):
    alphabets = {"aa": "abcde", "mm": "fghij", "nn": "klmno", "pp": "pqrst", "uu": "uvwxy"}
    texts = [(k, " ".join(prose(i, 40, a))) for i in range(60) for k, a in alphabets.items()]
    mixed = [("aa", " ".join(" ".join(prose(n, 12, a)) for a in alphabets.values())) for n in range(20)]
    short = [(k, a[n]) for k, a in alphabets.items() for n in range(5)]
    loose = [(None, " ".join(prose(900, 40, "abcde"))), (None, "12 34"), ("aa", "12 34")]
    rows = [(i, t, k, "s", len(t)) for i, (k, t) in enumerate(texts + mixed + short + loose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_language(spark, docs, "").collect()}
    assert kept == set(range(len(rows) - 2))


def python_operators(plan):
    """Most Python operators that one stage of a printed plan runs on a row; exchanges end a stage."""
    path, most = [], 0
    for line in plan.splitlines():
        name = line.lstrip(" :+-")
        depth = len(line) - len(name)
        while path and path[-1][0] >= depth:
            path.pop()
        above = path[-1][1] if path else 0
        count = 0 if re.match(r"(\w*Exchange|\w*QueryStage)", name) else above + bool(re.search(r"^(\*\(\d+\) )?(MapInArrow|FlatMap\w+InArrow|ArrowEvalPython)", name))
        path.append((depth, count))
        most = max(most, count)
    return most


def test_no_near_stage_holds_two_python_workers_a_core(spark, prose, monkeypatch):
    """Tables small enough for broadcast joins must not chain Python operators: executors keep the workers."""
    plans, real = {}, near.materialise

    def seen(df, name, *more):
        plans.setdefault(name, []).append(python_operators(df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, *more)

    monkeypatch.setattr(near, "materialise", seen)
    base = prose(3, 120)
    texts = [" ".join(base[: 100 + i % 4]) for i in range(40)] + [" ".join(prose(50 + i, 60)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs).collect()}
    assert got == {i: 0 if i < 40 else i for i in range(60)}
    assert plans["groups"] and plans["unrefuted"] and plans["pairs"]
    assert {k: max(v) for k, v in plans.items() if max(v) > 1} == {}


def test_bpe_remembers_a_bounded_number_of_words(word_bpe):
    """Every Python worker of an executor has its own memory of words."""
    model = word_bpe
    words = [f"w{i:x}q" for i in range(70_000)]
    ids = model.encode(" ".join(words))
    assert model.short.cache_info().currsize <= 1 << 16
    assert ids == [i for w in words for i in model.encode(w)]
