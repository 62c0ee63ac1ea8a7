"""Language, toxicity, quality and personal data."""

import dataclasses
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.llm import language, personal, quality, toxicity
from daymark.llm.common import code_points, gram_codes, word_hashes


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def two_languages(spark, prose):
    rows = []
    for i in range(80):
        alphabet = "abcdefgh" if i % 2 else "mnopqrst"
        rows.append((i, " ".join(prose(i, 40, alphabet)), "aa" if i % 2 else "mm"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_rows_kept_out(spark, two_languages):
    model = language.train(two_languages.filter("doc_id < 60"))
    assert model.languages == ["aa", "mm"]
    assert (model.weights == 0).mean() > 0.5
    found = language.identify(two_languages.filter("doc_id >= 60"), model)
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in found.collect())


def test_language_edges(edge, nothing, two_languages):
    model = language.train(two_languages)
    out = language.identify(edge, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "kept", "lang_pred", "score"]
    found = [(r["text"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert len(found) == 10
    for text, lang, score in found:
        lettered = bool(text) and any(c.isalpha() for c in text)
        assert (lang == "und") == (not lettered) and (lettered or score == 0)
    assert language.train(nothing) is None
    assert [r["lang_pred"] for r in language.identify(edge, None, keep=["doc_id"]).collect()] == ["und"] * 10
    assert language.identify(nothing, model).count() == 0


def test_language_training_does_not_depend_on_partitions(two_languages):
    one, many = (language.train(two_languages.repartition(n)) for n in (1, 7))
    assert np.array_equal(one.weights, many.weights) and one.temperature == many.temperature


def test_document_frequencies_count_every_document(two_languages):
    counts = language.document_frequencies(two_languages, "text")
    assert counts.max() == 80


def gram_code(text):
    points = code_points(text)
    return int(gram_codes(points, (len(text),), language.BITS)[0][0])


def test_language_scores_by_hand(two_languages, prose):
    """Every n-gram of the normalised text, counted, weighed and added up one by one."""
    model = language.train(two_languages)
    texts = ["Ab cd, 12 ef!", "mnop  qrst?ab", *(" ".join(prose(i, 12, "abcdmnop")) for i in range(12))]
    for text in texts:
        plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        plain = re.sub(" +", " ", plain)
        counts = Counter(gram_code(plain[i : i + n]) for n in language.ORDERS for i in range(len(plain) - n + 1))
        x = {c: (1 + math.log(n)) * float(model.idf[c]) for c, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        margins = [
            (sum(v / norm * float(model.weights[c, k]) for c, v in x.items()) + float(model.bias[k])) / model.temperature
            for k in range(len(model.languages))
        ]
        shares = [math.exp(m - max(margins)) for m in margins]
        told, score = language.predict(text, model)
        assert score == pytest.approx(max(shares) / sum(shares), abs=1e-5)
        assert told == model.languages[margins.index(max(margins))]
    # Equally likely languages: the first by name.
    even = dataclasses.replace(model, weights=np.zeros_like(model.weights), bias=np.zeros_like(model.bias))
    assert language.predict("abc", even) == (model.languages[0], 0.5)


def test_language_sample_is_bounded(spark):
    rows = [(i % 7, f"word {i}", "aa") for i in range(3000)] + [(i, "wort", "bb") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = language.fit_sample(docs, "doc_id", "text", "lang", 10)
    assert Counter(r[0] for r in found) == {"aa": 10, "bb": 10}


@pytest.fixture(scope="module")
def insults(spark, prose):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        words = prose(i, 60)
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(60)] = rng.choice(["scoundrel", "nitwit"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad), int(not bad)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
    )


def test_toxicity_restores_and_scores(spark, insults):
    docs, labels = insults
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 1"))
    for disguised in ("you n1tw1t", "a sc0undr3l", "n i t w i t", "n.i.t.w.i.t", "niiiitwit", "$coundrel!!"):
        assert re.search("nitwit|scoundrel", model.decoder().restore(disguised)), disguised
    held = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 1")
    assert all(r["predicted"] == r["toxic"] for r in held.collect())
    hidden = spark.createDataFrame([(1, "what a n1tw1t and sc0undrel"), (2, "what a day")], "doc_id long, text string")
    found = rows_by_id(toxicity.score_toxicity(hidden, model, restored=True))
    assert found[1]["predicted"] == 1 and found[1]["restored"] == "what a nitwit and scoundrel"
    assert found[2]["predicted"] == 0


def test_disguises_at_the_end_of_words_and_in_uneven_gaps_are_undone(spark, prose):
    told = ["idiot", "scum", "ass", "piss"]
    docs = [(i, " ".join([*prose(i, 40, "abcdefghijklmnoprstu"), *told, "you", "hello"])) for i in range(200)]
    counts = toxicity.trigram_counts(spark.createDataFrame(docs, "doc_id long, text string"), "text")
    decoder = toxicity.Decoder(toxicity.character_costs(counts))
    for disguised, plain in (
        ("a$$", "ass"), ("you a$$!", "you ass!"), ("pis$", "piss"), ("idio+", "idiot"), ("(idio+.", "idiot"),
        ("i d i o t  s c u m", "idiot  scum"), ("you i d i o t.", "you idiot."), ("s c u m!", "scum!"),
        ("s c u m", "scum"), ("i  d  i  o  t", "idiot"), ("i d  i o t", "idiot"), ("'i d i o t' you", "'idiot' you"),
        ("hello!", "hello!"), ("hello!!", "hello!!"), ("hello$$$", "hello$$$"), ("hello, you", "hello, you"),
    ):
        assert plain in decoder.restore(disguised), (disguised, decoder.restore(disguised))


def test_viterbi_is_the_cheapest_path(insults):
    """Against every path through small lattices."""
    docs, _ = insults
    decoder = toxicity.Decoder(toxicity.character_costs(toxicity.trigram_counts(docs, "text")))

    def cost(text, channel):
        total, a, b = channel, 0, 0
        for c in text:
            k = toxicity.letter(c)
            if k or b:
                total += decoder.costs[(a * 64 + b) * 64 + k]
                a, b = b, k
        return total + (decoder.costs[(a * 64 + b) * 64] if b else 0.0)

    def paths(span, edges, i=0):
        if i == len(span):
            yield "", 0.0
            return
        for j, out, c in edges[i]:
            for rest, more in paths(span, edges, j):
                yield out + rest, c + more

    for span in ("n1tw1t", "b4ad", "caaat", "1a1b", "a.b.c.d"):
        best = min(cost(t, c) for t, c in paths(span, toxicity.lattice(span)))
        got = decoder.viterbi(span)
        assert min(cost(t, c) for t, c in paths(span, toxicity.lattice(span)) if t == got) == pytest.approx(best)


def test_quality_learns_from_words_and_parts(spark, prose):
    rows = []
    for i in range(240):
        words = prose(i, 50)
        if i % 4 == 0:
            words = [w.upper() + "!!" if n % 3 else w for n, w in enumerate(words)]
        rows.append((i, " ".join(words), int(i % 4 != 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text"), labels.filter("doc_id % 3 <> 0"))
    held = quality.score_quality(docs, model).filter("doc_id % 3 = 0").collect()
    assert all(r["predicted"] == r["quality"] for r in held)
    again = quality.train(docs.select("doc_id", "text").repartition(5), labels.filter("doc_id % 3 <> 0"))
    assert np.array_equal(model.odds, again.odds)


def test_quality_scores_by_hand(prose):
    """The mean over words and the n-grams inside them, one by one."""
    rng = np.random.default_rng(5)
    model = quality.QualityModel(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    for text in ["One two,  three.\n x", "a", *(" ".join(prose(i, 9)) for i in range(10))]:
        values = []
        for word in text.split():
            points = code_points(word)
            code = word_hashes(points, np.array([0]), np.array([len(points)])) >> np.uint64(64 - quality.BITS)
            values.append(float(model.odds[int(code[0])]))
            marked = f" {word} "
            values += [float(model.odds[gram_code(marked[i : i + n])]) for n in quality.ORDERS for i in range(len(marked) - n + 1)]
        want = 1 / (1 + math.exp(-(model.prior + sum(values) / len(values))))
        assert quality.probability(text, model) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("operator", ["toxicity", "quality"])
def test_scores_on_edges(spark, edge, nothing, insults, operator):
    docs, labels = insults
    module, score = (toxicity, toxicity.score_toxicity) if operator == "toxicity" else (quality, quality.score_quality)
    model = module.train(docs, labels)
    out = score(edge, model).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
    assert score(nothing, model).count() == 0
    blank = module.train(nothing, labels.filter("false"))
    assert {r["score"] for r in score(edge, blank).collect()} == {0.5}
    untold = labels.withColumn("toxic", F.lit(None).cast("int")).withColumn("quality", F.lit(None).cast("int"))
    assert {r["score"] for r in score(edge, module.train(docs, untold)).collect()} == {0.5}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_patterns(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    texts = ["".join(rng.choice("0123456789.@+-( )a4 5.") for _ in range(rng.randrange(80))) for _ in range(20_000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (555) 123-4567+44 20 7946 0958", "1" * 5000]
    none = personal.PersonalModel()
    for text in texts:
        assert [s[:3] for s in personal.spans(text, none)] == by_patterns(text)


def with_luhn(rng):
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + d for d in "0123456789" if personal.luhn(head + d))


def test_boosted_candidates(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        good = with_luhn(rng)
        poor = good[:-1] + str((int(good[-1]) + 5) % 10)
        rows.append((i, f"pay by card {good} now or call +1 555 010 {i:04d} ref {poor} id ab{good}cd host 10.0.{i % 400}.7"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal.train(docs)
    assert "card" in model.thresholds
    other = with_luhn(rng)
    failing = other[:-1] + str((int(other[-1]) + 5) % 10)
    for digits, selected in ((other, True), (failing, False)):
        text = f"pay by card {digits} now"
        at = text.index(digits)
        p = model.probabilities(np.array([personal.features(text, "card", at, at + 16)]))[0]
        assert (p >= model.thresholds["card"]) == selected
    dotted = ".".join(other[i : i + 4] for i in range(0, 16, 4))
    eager = dataclasses.replace(model, thresholds=dict.fromkeys(personal.KINDS, 0.0))
    added = personal.spans(f"pay by card {dotted} now, {other}", eager)
    assert [s[3] for s in added] == [False, True] and added[0][2] <= added[1][1]
    for i, text in rows[:50]:
        told = [s[:3] for s in personal.spans(text, model) if s[3]]
        assert told == by_patterns(text)
    found = personal.find_personal(docs.limit(1), model)
    clean = personal.redact(found).first()["text"]
    assert "<card>" in clean and "<phone>" in clean


def test_candidates_without_a_base_pattern_are_added(spark):
    """Thresholds as trained, in every kind; what only looks like personal data stays."""
    rng = random.Random(3)

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def prose():
        return " ".join(rng.choice(["now", "then", "the", "thing", "where"]) for _ in range(8))

    rows = []
    for i in range(400):
        found = [f"{prose()[:3]}.{i}@mail{i % 9}.example.org", f"+1 ({number(3)}) 555-{number(4)}", with_luhn(rng)]
        found.append(".".join(str(rng.randrange(256)) for _ in range(4)))
        rng.shuffle(found)
        rows.append((i, " ".join(f"{prose()} {x}" for x in found) + " " + prose()))
    model = personal.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(model.thresholds) == set(personal.KINDS)
    good = with_luhn(rng)
    poor = good[:-1] + str((int(good[-1]) + 5) % 10)
    dotted, wrong = (".".join(d[i : i + 4] for i in range(0, 16, 4)) for d in (good, poor))
    wanted = [
        ("email", "jane.doe (at) mail3.example (dot) org"), ("email", "JANE.DOE [AT] MAIL.EXAMPLE [DOT] ORG"),
        ("email", "andr\xe9@mail4.example.org"), ("email", "jane@m\xfcller.example.org"), ("phone", "(212) 555-0143"),
        ("phone", "1 (212) 555-0143"), ("phone", "212-555-0143"), ("card", dotted), ("ip", "10[.]20[.]30[.]40"),
    ]
    for kind, span in wanted:
        found = personal.spans(f"then where {span} the thing", model)
        assert [(s[0], s[1], s[2], s[3]) for s in found] == [(kind, 11, 11 + len(span), False)], span
    for span in ("jane@host", "look (at) 3.50", "2019-04-17 12:30", wrong, poor, "2125550143", "10[.]20[.]300[.]40"):
        assert not personal.spans(f"then where {span} the thing", model), span


def test_addresses_with_very_many_zeros():
    text = "host " + "0" * 5000 + "10.0.0.1 and 1." + "0" * 6000 + ".2.3 but not 1." + "9" * 5000 + ".2.3"
    found = [(text[a:b], k) for k, a, b, base, _ in personal.spans(text, personal.PersonalModel()) if base]
    assert [k for _, k in found] == ["ip", "ip"] and found[0][0].endswith("10.0.0.1")
    assert list(personal.examples(text))


def test_long_contact_lists_take_seconds():
    import time

    line = "Ann Lee, ann.lee{0}@example.org, +49 30 1234{1:04}, 10.0.{2}.{3}, bob (at) host (dot) org\n"
    text = "".join(line.format(i, i % 9000, i % 256, i % 199) for i in range(110_000))
    assert len(text) > 9_000_000
    start = time.perf_counter()
    found = personal.spans(text, personal.PersonalModel())
    assert len(found) == 330_000 and time.perf_counter() - start < 120


def test_selected_spans_by_brute_force(spark):
    """Base spans, then candidates by falling score that overlap nothing chosen so far."""
    rng = random.Random(7)
    pieces = ["ann@ex.org", "+49 30 1234567", "10.0.0.1", "4111 1111 1111 1111", "bob (at) host (dot) org", "1[.]2[.]3[.]4",
              "call 030 1234567", "+1 (555) 010-9999 12", "2024-01-02 10", "\xe9va@\xfcmit.de", "x", "tel 0049301234567"]
    docs = spark.createDataFrame(
        [(i, " ".join(rng.choice(pieces) for _ in range(8))) for i in range(400)], "doc_id long, text string"
    )
    model = personal.train(docs)
    model.thresholds = {k: 0.2 for k in personal.KINDS}
    for row in docs.limit(60).collect():
        text = row["text"]
        found = personal.candidates(text)
        want = [(k, a, b, True) for k, a, b, label in found if label == 1]
        rest = [(k, a, b) for k, a, b, label in found if label != 1 and not personal.fails(k, text[a:b])]
        scored = sorted(((-model.probabilities(np.array([personal.features(text, *c)]))[0], n) for n, c in enumerate(rest)))
        for score, n in scored:
            k, a, b = rest[n]
            if -score >= 0.2 and all(b <= x or y <= a for _, x, y, _ in want):
                want.append((k, a, b, False))
        assert sorted(want) == sorted((k, a, b, base) for k, a, b, base, _ in personal.spans(text, model))


def test_personal_edges(edge, nothing):
    model = personal.train(edge)
    out = personal.find_personal(edge, model)
    assert out.count() == 10 and out.columns[-1] == "spans"
    assert personal.redact(out).count() == 10
    assert personal.find_personal(nothing, personal.train(nothing)).count() == 0


def test_a_tokenizer_model_is_gone_with_its_last_use():
    """A worker's next task must not find the model and the remembered words of the one before."""
    import gc
    import pickle
    import weakref

    from public_tokenizers import path as tokenizer_path

    from daymark.llm import bpe

    model = pickle.loads(pickle.dumps(bpe.WordBpe.load(tokenizer_path("word_bpe_49k.json"))))
    assert model.encode("Old words, old WORDS") and model.short.cache_info().hits
    gone, gathering = weakref.ref(model), gc.isenabled()
    gc.disable()
    try:
        del model
        assert gone() is None
    finally:
        if gathering:
            gc.enable()
