"""N-gram join, substring dedup and decontamination against brute force, and on odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import common, components, decontaminate, ngram_join, substring_dedup
from tracemill.llm.common import Workspace, scratch, slices

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def near(text, changes):
    w = text.split()
    for _ in range(changes):
        w[RNG.randrange(len(w))] = RNG.choice(VOCABULARY)
    return " ".join(w)


def corpus():
    base = [sentence(RNG.randrange(1, 120)) for _ in range(25)]
    rows, i = [], 0
    for t in base:
        for _ in range(RNG.randrange(1, 7)):
            rows.append((i, near(t, RNG.randrange(0, 4))))
            i += 1
    common = sentence(40)
    rows += [(i + k, common + " " + sentence(k % 6)) for k in range(30)]
    i += 30
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two"), (i + 6, "x " * 3000)]
    return rows


def test_the_text_that_stays_equals_brute_force(frame):
    """Only exact passages: every word in a run of 28 or more that an earlier text has goes, and no other."""
    rng = random.Random(11)
    some = lambda n: [f"v{rng.randrange(400)}" + "." * (rng.random() < 0.07) for _ in range(n)]
    shared, rows = [some(rng.randrange(20, 70)) for _ in range(6)], []
    for i in range(24):
        parts = [some(rng.randrange(5, 60)) for _ in range(3)]
        rows.append((i, [w for k, p in enumerate(parts) for w in (*p, *(shared[rng.randrange(6)] if k < 2 else ()))]))
    wanted, seen = {}, {}
    for i, words in rows:
        gone, here = set(), {}
        for at in range(len(words) - 27):
            key = tuple(words[at : at + 28])
            if key in seen or key in here:
                gone.update(range(at, at + 28))
            here.setdefault(key, at)
        seen |= dict.fromkeys(here)
        wanted[i] = [w for k, w in enumerate(words) if k not in gone]
    got = {r.doc_id: r.text.split() for r in substring_dedup.substring_dedup(frame([(i, " ".join(w)) for i, w in rows])).collect()}
    assert got == wanted and sum(len(w) for _, w in rows) > sum(map(len, wanted.values()))


def test_paragraph_bands_find_all_alike_pairs(spark):
    """The bands against all pairs of paragraphs: recall at least 0.9 at similarity 0.8 and more."""
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(60, 100))]
        near = list(w)
        near[rng.randrange(len(w))] = "new"
        texts += [" ".join(w), " ".join(near)]
    p = substring_dedup.Paragraphs(*next(slices(pa.array(["\n".join(texts)])))[1:])
    _, first, words = p.blocks()
    nodes, _ = p.nodes(first, words, 11)
    values, sizes = p.sets(first, words)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.view(np.int32)))
    met = {}
    for b in substring_dedup._bands(iter([pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), lists], ["node", "s"])])):
        for bucket, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            met.setdefault(bucket, set()).add(node)
    found = {(x, y) for m in met.values() for x in m for y in m if x < y}
    sets, ids = [set(x) for x in lists.to_pylist()], nodes.view(np.int64).tolist()
    alike = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i) if ids[i] != ids[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(alike) > 100 and len(alike & found) >= 0.9 * len(alike)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_join_equals_brute_force(frame, k, percent):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(rows), k, percent).collect()}
    assert got == ngram_join.brute_force(rows, k, percent)


@pytest.mark.parametrize("percent", [90, 80])
def test_only_tokens_of_several_sets_are_in_the_index(frame, monkeypatch, percent):
    """Texts that share nothing have no posting, however many there are; of a common passage few tokens have one."""
    rng, seen = random.Random(5), {}
    some = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    passage, twin = some(30), some(100)
    rows = [(i, f"{some(150)} {passage}") for i in range(60)] + [(60, twin), (61, f"{twin} end")]

    def kept(postings, *rest):
        seen["postings"] = postings.count()
        return components.bucket_components(postings, *rest)

    monkeypatch.setattr(ngram_join, "bucket_components", kept)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(rows), 3, percent).collect()}
    assert got == {i: (178, i) for i in range(60)} | {60: (98, 60), 61: (99, 60)}
    assert 2 <= seen["postings"] < 62 * ngram_join.prefix_length(178, percent) // 5


def test_a_group_whose_members_do_not_all_link_to_one(frame):
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(12):  # a chain: each document is near the next one only
        w = list(base)
        w[: 3 * i] = [f"u{j}" for j in range(3 * i)]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(rows), 3, 90).collect()}
    assert got == ngram_join.brute_force(rows, 3, 90)
    assert len({c for _, c in got.values()}) == 1


def test_join_on_odd_inputs(frame):
    assert ngram_join.ngram_join(frame([])).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "other words here now ok"), (6, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(rows)).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6), (6, 1, 6)]
    wide = frame([(1, "a b c d e f g", 9, "x")], "doc_id long, text string, node long, component_id string")
    assert ngram_join.ngram_join(wide).first().component_id == 1


def test_one_of_each_group_stays(frame):
    rows = [(3, "a b c d e f g h i j"), (1, "A b c d e f g h i j"), (2, "quite another text is this one here"), (4, None), (5, ""), (2, "quite another text is this one here")]
    kept = ngram_join.one_of_each(frame(rows).withColumn("lang", F.lit("en")))
    assert sorted(map(tuple, kept.collect())) == [(1, rows[1][1], "en"), (2, rows[2][1], "en"), (4, None, "en"), (5, "", "en")]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    work = Workspace(spark)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), work).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def test_linked_rows_are_told_apart_by_id_and_text(frame):
    a, near_a, other = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "totally different words stand in this text here"
    keep = lambda rows: sorted(map(tuple, ngram_join.one_of_each(frame(rows)).collect()), key=str)
    assert keep([(5, a), (5, other)]) == sorted([(5, a), (5, other)], key=str)
    assert keep([(3, a), (7, a), (7, other)]) == sorted([(3, a), (7, other)], key=str)
    assert keep([(7, a), (7, a), (7, "\t\n")]) == sorted([(7, a), (7, "\t\n")], key=str)
    assert keep([(None, a), (None, None), (9, near_a)]) == sorted([(None, None), (9, near_a)], key=str)
    assert keep([(None, a), (None, a)]) == [(None, a)]
    assert keep([]) == []
    clash = frame([(1, a, "x", 5), (2, a, "y", 6)], "doc_id long, text string, _tie string, n int")
    assert [tuple(r) for r in ngram_join.one_of_each(clash).collect()] == [(1, a, "x", 5)]


def test_nothing_large_is_left_in_the_shared_folder(spark, frame):
    import pathlib

    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    tables = lambda: {p for p in root.glob("tracemill-*/t*")}
    before = tables()
    ngram_join.one_of_each(frame([(1, PASSAGE), (2, PASSAGE)]))
    assert len(tables() - before) == 1
    before = tables()
    substring_dedup.substring_dedup(frame([(1, PASSAGE), (2, PASSAGE)]))
    assert len(tables() - before) == 1
    with scratch():
        substring_dedup.substring_dedup(frame([(1, PASSAGE), (2, PASSAGE)])).count()
    assert len(tables() - before) == 1


def test_joins_that_shuffle_equal_those_that_broadcast(frame, monkeypatch):
    for module in (common, components, ngram_join, substring_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(common.Workspace.small, "__defaults__", (0,))
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(rows), 3, 90).collect()}
    assert got == ngram_join.brute_force(rows, 3, 90)
    cut = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame([(1, PASSAGE), (2, PASSAGE), (3, "x y")])).collect()}
    assert cut[1] == cut[3] == 0 < cut[2]


def test_of_rows_that_find_no_key_few_travel(spark, monkeypatch):
    work = Workspace(spark)
    table = work.write(spark.range(0, 60_000, 3).withColumnRenamed("id", "node"))
    df = spark.range(60_000).select(F.col("id").alias("node"), (F.col("id") % 7).alias("x"))
    may, rest = (work.sift(df, ["node"], table, ["node"], how) for how in ("left_semi", "left_anti"))
    assert 20_000 <= may.count() <= 25_000 and may.count() + rest.count() == 60_000
    assert not rest.where("node % 3 = 0").count()
    for how in ("inner", "left_semi", "left"):
        got = work.among(df, table, "node", how, 0)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.join(table, "node", how).collect()))
    monkeypatch.setattr(common, "SIEVE_ROWS", 2)
    full = work.write(table.where("node >= 0"))
    assert work.among(df, full, "node", "left_semi", 0).count() == 20_000  # more keys than bits: all travel, none is lost
    work.keep(full)
    assert [x[0] for x in work.tables if x[0] is full] and len(work.tables) == 2
    work.forget(full)
    assert not work.tables and not work.sieves


def test_join_by_shuffle_leaves_texts_that_are_not_cut_where_they_are(frame, monkeypatch):
    whole = substring_dedup.substring_dedup(frame([(1, PASSAGE), (2, PASSAGE), (3, "x y"), (None, PASSAGE), (4, None)]))
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common.Workspace.small, "__defaults__", (0,))
    monkeypatch.setattr(common.Workspace.among, "__defaults__", ("inner", 0))
    by_shuffle = substring_dedup.substring_dedup(frame([(1, PASSAGE), (2, PASSAGE), (3, "x y"), (None, PASSAGE), (4, None)]))
    assert sorted(map(str, by_shuffle.collect())) == sorted(map(str, whole.collect()))
    assert "_sieve_bits" in by_shuffle._jdf.queryExecution().optimizedPlan().toString()


PASSAGE = "The quick brown fox jumps over the lazy dog near the old river bank today. It then runs across the wide green field and hides behind some tall trees. Nobody saw where it went after that, and the dog went back to sleep. In the evening it came back to the river and drank some water quietly."


def test_passages_go_but_once(frame):
    rows = [(i, f"{sentence(12)}. {PASSAGE} {sentence(20)}.") for i in range(1, 6)] + [(9, f"{sentence(30)}.\n{sentence(25)}."), (10, "All rights reserved.\n" + sentence(30) + "."), (11, "All rights reserved.\n" + sentence(30) + ".")]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(rows)).collect()}
    assert len(got) == len(rows)
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    for i in range(2, 6):
        assert "brown fox" not in got[i].text and "came back" not in got[i].text and got[i].same_as == [1] and got[i].removed_words >= 50
        assert got[i].text.split()[:12] == rows[i - 1][1].split()[:12]
    for i, t in rows[5:]:
        assert got[i].text == t


def test_near_passages_go(frame):
    words = [f"word{i}" for i in range(60)]
    edited = [*words]
    edited[5] = "leaps"  # a changed word near the start of a long sentence
    rows = [(1, " ".join(words) + "."), (2, " ".join(edited) + ".")]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 1 and "leaps" not in got[2].text


def test_near_paragraphs_with_an_inner_edit_go(frame):
    rows = []
    for i in range(60):
        words = PASSAGE.split() if not i else sentence(60).split()
        words[5], words[20], words[40] = words[5] + ".", words[20] + ".", words[40] + "."
        edited = [*words]
        edited[30 if i else 5] = "leaps"  # leaves no run of 28 words in the passage's sentences
        rows += [(i, sentence(30) + ".\n" + " ".join(words) + "\n" + sentence(30)), (1000 + i, sentence(30) + ".\n" + " ".join(edited) + "\n" + sentence(30))]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(rows)).collect()}
    assert all(got[i].n_removed == 0 for i in range(60))
    gone = [i for i in range(60) if "leaps" not in got[1000 + i].text]
    assert len(gone) >= 54 and all(i in got[1000 + i].same_as and len(got[1000 + i].text.split()) >= 55 for i in gone)


def test_passages_from_any_word_to_any_word_go(frame):
    rows, size = [], {}
    for i in range(120):
        text = [f"{sentence(RNG.randrange(9, 20))}." for _ in range(12)]
        words, n = " ".join(text).split(), RNG.randrange(28, 60)
        a, b = RNG.randrange(len(words) - n), RNG.randrange(10, 40)
        other = " ".join(f"{sentence(RNG.randrange(9, 20))}." for _ in range(8)).split()
        rows += [(i, " ".join(words)), (1000 + i, " ".join([*other[:b], *words[a : a + n], *other[b:]]))]
        size[i] = (n, len(other))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(rows)).collect()}
    assert all(got[i].n_removed == 0 for i in range(120))
    # a word beyond either end may be equal by chance
    assert all(n <= got[1000 + i].removed_words <= n + 6 and len(got[1000 + i].text.split()) == n + m - got[1000 + i].removed_words for i, (n, m) in size.items())


def test_units_that_do_not_repeat_are_not_written(frame, monkeypatch):
    rng, rows, write = random.Random(9), [], Workspace.write
    some = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    texts = [(i, some(400)) for i in range(40)] + [(40, PASSAGE), (41, PASSAGE), (41, PASSAGE)]

    def counted(self, df, **metrics):
        out = write(self, df, **metrics)
        rows.append(self.rows(out))
        return out

    monkeypatch.setattr(Workspace, "write", counted)
    got = {r.doc_id: (r.text, r.same_as) for r in substring_dedup.substring_dedup(frame(texts)).collect()}
    assert all(got[i] == (t, []) for i, t in texts[:41]) and got[41][0] != PASSAGE and got[41][1] == [40]
    assert max(rows) < 1000  # anchors alone are some 55 a text


def test_dedup_on_odd_inputs(frame):
    assert substring_dedup.substring_dedup(frame([])).count() == 0
    rows = [(1, None), (2, ""), (3, "x " * 5000), (None, PASSAGE), (4, PASSAGE), (4, PASSAGE), (5, PASSAGE)]
    out = [(r.doc_id, r.text, r.n_removed) for r in substring_dedup.substring_dedup(frame(rows)).collect()]
    assert len(out) == 7 and (1, None, 0) in out and (2, "", 0) in out and (None, PASSAGE, 0) in out
    wide = frame([(1, PASSAGE, "a"), (2, PASSAGE, "b")], "doc_id long, text string, n_removed string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(wide).collect()}[2] > 0
    clash = frame([(1, PASSAGE, "a", 1), (2, PASSAGE, "b", 2)], "doc_id long, text string, _id string, _marks int")
    assert sorted((r.doc_id, r._id, r._marks, r.n_removed > 0) for r in substring_dedup.substring_dedup(clash).collect()) == [(1, "a", 1, False), (2, "b", 2, True)]


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "short item here"), (20, None), (21, " ... "), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def test_hits_equal_brute_force(frame):
    docs = [(1, "x ALPHA, beta-gamma delta epsilon zeta eta theta iota kappa y"), (2, "a short item here and short item here"), (3, "clean text"), (4, None), (5, ""), (6, "alpha beta gamma delta epsilon zeta eta theta iota"), (7, ITEMS[0][1] + " " + ITEMS[1][1]), (8, "ü ÜBER alpha")]
    bench = frame(ITEMS, "item_id long, text string")
    found = decontaminate.find_hits(frame(docs), bench)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.s) for r in found.select("doc_id", "n_words", "n_hit", F.size("hit_items").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("s")).collect()}
    known = [x for x in ITEMS if x[0] is not None]
    assert got == {i: decontaminate.brute_force(t, known) for i, t in docs}
    cut = {r.doc_id: r.text for r in decontaminate.find_hits(frame(docs), bench, action="remove_spans").collect()}
    assert cut[1] == "x  y" and cut[2] == "a  and " and cut[3] == "clean text" and cut[4] is None and cut[8] == "ü ÜBER alpha"
    assert {r.doc_id for r in decontaminate.find_hits(frame(docs), bench, action="remove_documents").collect()} == {3, 4, 5, 6, 8}
    assert decontaminate.find_hits(frame(docs), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(frame([]), bench).count() == 0
    long = [(1, "alpha beta gamma " * 100_000 + ITEMS[0][1]), (1, "x"), (1, "x")]
    assert sorted(r.n_hit for r in decontaminate.find_hits(frame(long), bench).collect()) == [0, 0, 11]


@pytest.mark.parametrize("action", ["report", "remove_spans", "remove_documents"])
def test_a_large_benchmark_gives_the_same_hits(frame, monkeypatch, action):
    docs = frame([(1, "x ALPHA, beta-gamma delta epsilon zeta eta theta iota kappa y", 1), (1, "short item here", 2), (2, "a short item here and short item here", 3), (3, "clean text", 4), (4, None, 5), (None, "short item here", 6), (7, ITEMS[0][1] + " " + ITEMS[1][1], 7), (7, ITEMS[0][1] + " " + ITEMS[1][1], 7)], "doc_id long, text string, k int")
    bench = frame([*ITEMS, (30, "Short ITEM here")], "item_id long, text string")
    answer = lambda: sorted(map(repr, decontaminate.find_hits(docs, bench, action=action).collect()))
    first = answer()
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 0)
    assert answer() == first and (action != "report" or any("'30'" in r for r in first))
