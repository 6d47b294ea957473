"""The fitted models: held-out accuracy, exact parts by brute force, and odd inputs."""

import itertools
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import labelled, langid, quality, toxicity
from tracemill.llm.common import slices

SF = "/root/testdata/sf0.01"


def auc(pairs):
    pairs = sorted(pairs)
    ranks = {}
    for k, g in itertools.groupby(range(len(pairs)), key=lambda i: pairs[i][0]):
        g = list(g)
        ranks[k] = sum(g) / len(g) + 1
    good = [ranks[s] for s, y in pairs if y]
    return (sum(good) - len(good) * (len(good) + 1) / 2) / (len(good) * (len(pairs) - len(good)))


def test_quality_ranks_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.op6_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) > 0.95


def test_quality_features_are_counts(spark):
    texts = ["A a b", "", "b!! 12 12"]
    for _, data, offsets in slices(pa.array(texts)):
        f, v, ptr = quality.features(data, offsets)
    assert ptr[1] == ptr[2] and abs((v[ptr[0] : ptr[1]] ** 2).sum() - 1) < 1e-9
    # of "A a b": a, <again>, b and the pairs a <again>, <again> b
    assert ptr[1] == 5


def toxic_rows():
    clean = [(i, f"the weather in town{i % 37} was fine and the garden{i % 11} grew well") for i in range(300)]
    bad = [(1000 + i, f"the weather in town{i % 37} was fine you {w}{'' if i % 3 else 's'} and the garden grew") for i, w in enumerate(["nasty", "horrid", "vileness"] * 60)]
    return clean + bad, [(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad]


def test_toxicity_of_unseen_misspellings(frame):
    rows, labels = toxic_rows()
    new = [(5000, "the garden in town3 was horridd and fine"), (5001, "the garden in town3 was fine"), (5002, None), (5003, "")]
    out = {r.doc_id: r for r in toxicity.toxicity(frame(rows + new), frame(labels, "doc_id long, toxic int")).collect()}
    assert out[5000].score > out[5001].score and out[5001].predicted == 0
    held = [(out[i].score, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc(held) > 0.97
    assert out[5002].score == out[5003].score and out[5002].predicted == 0


def test_toxicity_keeps_the_share_of_labels_beyond_its_cap(frame):
    # 400 and 40 rows with one text, of which the fit sees 20 and 20: the score is the share in the whole
    labels = [(i, int(i >= 400)) for i in range(440)]
    learned = [y for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    out = toxicity.toxicity(frame([(i, "the garden grew well") for i, _ in labels]), frame(labels, "doc_id long, toxic int"), most=40).first()
    assert abs(out.score - sum(learned) / len(learned)) < 0.02 and out.predicted == 0


def test_the_end_of_a_long_run_counts():
    run = "".join(f"ab{i}" for i in range(60))
    assert toxicity.words_of(run + "vileness") != toxicity.words_of(run + "fineness")
    grams = lambda text: {g for w in toxicity.words_of(text) for g in toxicity.subwords(w)}
    assert {zlib.crc32((run + "vileness")[i : i + 5].encode()) % toxicity.BUCKETS for i in range(len(run) + 4)} <= grams(run + "vileness")


def test_quality_steps_equal_plain_loops():
    rows = [("good plain words here", 1), ("BAD BAD 12 12", 0), ("good words again again", 1)]
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    docs = []
    for _, data, offsets in slices(pa.array([t for t, _ in rows])):
        f, v, ptr = quality.features(data, offsets)
        docs = [([*f[ptr[i] : ptr[i + 1]].tolist(), quality.BUCKETS], [*v[ptr[i] : ptr[i + 1]].tolist(), 1.0], rows[i][1]) for i in range(3)]
    z, n, order = {}, {}, np.random.default_rng(5)
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    for _ in range(quality.PASSES):
        for k in order.permutation(3):
            fs, vs, y = docs[k]
            w = {i: weight(i) for i in fs}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in zip(fs, vs, strict=True))))
            for i, x in zip(fs, vs, strict=True):
                g, old = (p - y) * x, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / a * w[i]
    weights, offset = quality.fit(rows)
    assert abs(offset - weight(quality.BUCKETS)) < 1e-9 and all(abs(weights[i] - weight(i)) < 1e-6 for i in z if i < quality.BUCKETS)


def test_a_toxicity_step_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 1)
    rows = [("you nasty thing", 1), ("a fine day", 0), ("nasty day", 1), ("", 0)]
    weights, offset = toxicity.fit(rows)
    rng = np.random.default_rng(7)
    e, w, b = rng.normal(0, 0.01, (toxicity.BUCKETS, toxicity.WIDTH)), rng.normal(0, 1.0, (toxicity.WIDTH, 2)), np.zeros(2)
    ge, gw, gb = {}, toxicity.DECAY * w, np.zeros(2)
    for text, y in rows:
        words = sorted(toxicity.words_of(text))
        scale = toxicity.SCALE / max(1, len(words)) ** toxicity.POWER
        doc = sum((np.mean([e[i] for i in toxicity.subwords(x)], 0) for x in words), np.zeros(toxicity.WIDTH)) * scale
        p = np.exp(doc @ w + b)
        dz = (p / p.sum() - [1 - y, y]) / len(rows)
        gw, gb = gw + np.outer(doc, dz), gb + dz
        for x in words:
            own = toxicity.subwords(x)
            for i in own:
                ge[i] = ge.get(i, 0) + w @ dz * scale / len(own)
    move = lambda g: toxicity.RATE * g / (np.abs(g) + 1e-9)
    new_w, new_b = w - move(gw), b - move(gb)
    assert abs(offset - (new_b[1] - new_b[0])) < 1e-6
    for i, g in ge.items():
        assert abs(weights[i] - toxicity.SCALE * (e[i] - move(g)) @ (new_w[:, 1] - new_w[:, 0])) < 1e-4


def test_samples_are_bounded_in_rows_and_bytes(frame):
    rows = [(i, "x" * (1 + i % 50)) for i in range(300)] + [(3, "twice")] * 4
    labels = frame([(i, i % 2) for i in range(300)] + [(3, 0), (5, None)], "doc_id long, toxic int")
    picked, counts = labelled.sample(frame(rows), labels, "toxic", 60, 1000)
    got = picked.collect()
    assert len(got) <= 60 and all(sum(len(r.text) for r in got if r.y == y) <= 500 for y in (0, 1)) and {r.y for r in got} == {0, 1}
    assert sorted(map(tuple, got)) == sorted(map(tuple, labelled.sample(frame(rows).repartition(5), labels, "toxic", 60, 1000)[0].collect()))
    assert sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)) + (zlib.crc32(b"3") % 5 != 0)


def test_classifiers_on_repeated_and_very_long_rows(frame):
    rows, labels = toxic_rows()
    long = "the garden grew " * 40_000
    out = toxicity.toxicity(frame([*rows, (1, long), (1, long), (2, "z" * 100_000)]), frame(labels, "doc_id long, toxic int")).where("length(text) > 1000").collect()
    assert len(out) == 3 and out[0].score == out[1].score
    marks = frame([(i, 1 - y) for i, y in labels], "doc_id long, quality int")
    out = quality.quality(frame([*rows, (1, long), (1, long), (2, "z" * 100_000)]), marks).where("length(text) > 1000").collect()
    assert len(out) == 3 and out[0].score == out[1].score


def test_classifiers_without_labels_or_rows(frame):
    none = frame([], "doc_id long, toxic int, quality int")
    assert [r.predicted for r in toxicity.toxicity(frame([(1, "x")]), none).collect()] == [0]
    assert [r.score for r in quality.quality(frame([(1, "x")]), none).collect()] == [0.5]
    assert toxicity.toxicity(frame([]), none).count() == 0 and quality.quality(frame([]), none).count() == 0
    one = frame([(1, 1, None)], "doc_id long, toxic int, quality int")
    wide = frame([(1, "x", "mine")], "doc_id long, text string, score string")
    assert toxicity.toxicity(wide, one).first().score > 0.9


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(langid.default_path())


def test_forward_sums_all_segmentations(pieces, monkeypatch):
    prob = np.stack([langid.fit(t, pieces) for t in (["the cat sat on the mat"] * 3, ["der hund und die katze"] * 3)], 1)
    known = {int(c): i for i, c in enumerate(pieces.codes)}
    assert np.allclose(prob.sum(0), 1)
    words = ["the", "katze", "zzq", "über"]
    for word in words:
        w = b" " + word.encode()

        @lru_cache(None)
        def total(i, lang):
            if i == len(w):  # noqa: B023
                return 1.0
            return sum(prob[known[c], lang] * total(j, lang) for j in range(i + 1, len(w) + 1) if (c := pieces.code(w[i:j])) in known)  # noqa: B023

        assert np.allclose(langid.word_scores(pieces, prob, [word])[0], [math.log(total(0, k)) for k in (0, 1)])
    short = langid.word_scores(pieces, prob, words)
    monkeypatch.setattr(langid, "SHORT", 0)  # all words go the way of the long ones
    assert np.allclose(langid.word_scores(pieces, prob, words), short)


def test_expected_counts_equal_those_of_all_segmentations(pieces, monkeypatch):
    known = {int(c): i for i, c in enumerate(pieces.codes)}
    monkeypatch.setattr(langid, "ROUNDS", 1)

    def cuts(w):
        return [[w[:i], *rest] for i in range(1, len(w) + 1) if pieces.code(w[:i]) in known for rest in (cuts(w[i:]) if w[i:] else [[]])]

    expected = np.full(pieces.n, langid.ADDED)
    for w in (b" the", b" cat", b" the"):
        all_of = cuts(w)
        like = [(1 / pieces.n) ** len(x) for x in all_of]
        for x, p in zip(all_of, like, strict=True):
            for c in x:
                expected[known[pieces.code(c)]] += p / sum(like)
    assert np.allclose(langid.fit(["the cat", "the"], pieces), expected / expected.sum())
    monkeypatch.setattr(langid, "SHORT", 0)
    assert np.allclose(langid.fit(["the cat", "the"], pieces), expected / expected.sum())


def test_every_piece_and_word_counts(pieces):
    word = b" administration"
    assert (len(word), len(word)) in pieces.spans([word, b" a"])[1]
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(31_000)]
    often = " ".join(words[:30_000] * 2)
    assert not np.array_equal(langid.fit([often, " ".join(words[30_000:])], pieces), langid.fit([often], pieces))
    run = "ab" * 40
    prob = langid.fit(["the cat sat"], pieces)[:, None]
    scores = langid.word_scores(pieces, prob, [run, run + "the", run + "q", "x" * 20_000])[:, 0]
    assert np.isfinite(scores).all() and scores[0] > scores[1] and scores[1] != scores[2]


def test_numerals_are_no_letters():
    assert langid.words_of("½ ① ② x½y Ⅷ 12 a1b_c é") == ["x", "y", "a", "b", "c", "é"]


def test_a_language_is_learned_from_a_bounded_sample(frame):
    rows = [(i, "the cat sat", "en") for i in range(400)] + [(7, "the cat sat", "en")] * 300 + [(1000 + i, "der hund " * i, "de") for i in range(30)]
    found = langid._learned(frame(rows, "doc_id long, text string, lang string"), 50, 1000).collect()
    by = {k: [r.text for r in found if r.lang == k] for k in ("en", "de")}
    assert len(by["en"]) == 50 and 0 < sum(len(t) for t in by["de"]) <= 1000


def test_copies_and_long_texts_cost_only_themselves(spark, frame):
    """A row that is repeated very often is one row of a sample; a text over the bytes leaves the others in."""
    rows = frame([(i, f"the cat {i}", "en") for i in range(400)] + [(5000 + i, f"der hund {i}", "de") for i in range(60)], "doc_id long, text string, lang string")
    copies = spark.range(200_000).select(F.lit(9999).cast("long").alias("doc_id"), F.lit("one row").alias("text"), F.lit("en").alias("lang"))
    found = [r.lang for r in langid._learned(rows.unionByName(copies), 50, 100_000).collect()]
    assert found.count("en") == 50 and found.count("de") == 50
    # bytes for most but not for one of them, whatever its place by hash
    for k in range(10):
        long_one = frame([(7000 + k, "lang " * 1000, "de")], "doc_id long, text string, lang string")
        again = [r.lang for r in langid._learned(rows.unionByName(long_one), 50, 1000).collect()]
        assert again.count("en") == 50 and again.count("de") == 50
    docs = frame([(i, "y" * 2000 if i % 7 == 0 else f"text {i}") for i in range(280)])
    labels = frame([(i, i % 2) for i in range(280)] * 3, "doc_id long, toxic int")
    picked, counts = labelled.sample(docs, labels, "toxic", 100, 1000)
    got = picked.collect()
    assert min(sum(r.y == y for r in got) for y in (0, 1)) >= 35 and all(len(r.text) < 100 for r in got)
    assert sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(280))
    # one id with very many texts is one row
    many = docs.unionByName(spark.range(100_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")))
    assert min(sum(r.y == y for r in labelled.sample(many, labels, "toxic", 100, 100_000)[0].collect()) for y in (0, 1)) == 50


def test_language_of_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op10_language(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.98 * len(held)


def test_language_of_odd_texts(frame):
    learn = frame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, "x", None), (4, None, "en")], "doc_id long, text string, lang string")
    docs = frame([(1, None), (2, ""), (3, "½ ① 123 !!"), (4, "the cat"), (5, "die katze"), (6, "a" * 500)])
    out = {r.doc_id: r for r in langid.language(docs, langid.default_path(), learn).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "en", "de"] and out[1].score == 0.0 and out[6].lang_pred in ("en", "de")
    assert langid.language(docs.limit(0), langid.default_path(), learn).count() == 0
    assert {r.lang_pred for r in langid.language(docs, langid.default_path(), learn.where(F.lit(False))).collect()} == {"und"}
