"""Manifests, mixes and prefix tries against plain Python, and odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import merkle, mixing, trie
from tracemill.llm.common import Workspace
from tracemill.llm.scans import running

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_running_numbers_and_totals(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(50), rng.randrange(1000)) for _ in range(900)] + [("same", 1, 7)] * 300 + [(f"g{i % 40}", i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    out = running(Workspace(spark), df, "g", [F.col("o"), F.col("v")], sums=("v",), xors=("o",)).collect()
    plain = []
    for g in {r[0] for r in rows}:
        total = bits = 0
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == g)):
            total, bits = total + v, bits ^ o
            plain.append((g, o, v, n + 1, total, bits))
    assert sorted((r.g, r.o, r.v, r.nth, r.run_v, r.run_o) for r in out) == sorted(plain)
    assert running(Workspace(spark), df.where("false"), "g", [F.col("o")]).count() == 0


def plain_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([sha("".join(d[i : i + 16])) for i in range(0, len(d), 16)])
    return levels


def plain_proof(levels, i):
    out = []
    for d in levels[:-1]:
        low = i // 16 * 16
        out.append((i - low, "".join(x for k, x in enumerate(d[low : low + 16]) if k != i - low)))
        i //= 16
    return out


def test_manifest_equals_a_plain_tree(spark):
    sizes = {"a": 1, "b": 16, "c": 17, None: 256, "": 257, "é": 4097, "z": 273}
    rows = [(i, s, sha(f"{s}/{i}")) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "a", sha("x")), (3, "b", sha("b/3")), (3, "b", sha("b/3"))]
    random.Random(1).shuffle(rows)
    out = merkle.merkle(spark.createDataFrame(rows, "doc_id long, source string, leaf string"), ["doc_id"]).collect()
    trees = defaultdict(list)
    for i, s, d in rows:
        trees[s].append((i is not None, i or 0, d))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: plain_tree([x[2] for x in sorted(trees[s])]) for s in order}
    top = plain_tree([levels[s][-1][0] for s in order])
    assert len(out) == len(rows)
    for r in out:
        want = plain_proof(levels[r.source], r.idx) + plain_proof(top, order.index(r.source))
        assert sorted(trees[r.source])[r.idx][2] == r.leaf and r.subroot == levels[r.source][-1][0] and r.root == top[-1][0]
        assert [(p.place, p.siblings) for p in r.proof] == want
    assert sorted((str(r.source), r.idx) for r in out) == sorted((str(s), i) for s, v in trees.items() for i in range(len(v)))


def test_manifest_on_odd_rows(spark):
    kinds = "doc_id long, source string, lang string, n_chars int, text string"
    digest = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    odd = spark.createDataFrame([(None,) * 5, (1, "", "", 0, ""), (2, "-", None, None, "é" * 300_000)], kinds).withColumn("leaf", digest)
    found = {r.doc_id: r for r in merkle.merkle(odd, ["doc_id"]).collect()}
    assert found[None].leaf == sha("-----") and found[1].leaf == sha("1:10:0:1:00:") and found[2].leaf == sha("1:21:---600000:" + "é" * 300_000)
    lone = merkle.merkle(odd.where("doc_id = 1"), ["doc_id"]).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof == []
    empty = merkle.merkle(odd.where("false"), ["doc_id"])
    assert empty.count() == 0 and empty.columns == merkle.merkle(odd, ["doc_id"]).columns
    names = spark.createDataFrame([(i, "s", sha(str(i)), 5, 6, 7, 8) for i in range(40)], "doc_id long, source string, leaf string, idx int, nth int, tree int, r_part int")
    wide = merkle.merkle(names, ["doc_id"]).collect()
    assert {(r.nth, r.tree, r.r_part) for r in wide} == {(6, 7, 8)} and sorted(r.idx for r in wide) == list(range(40))


def test_tampering_shows(spark):
    rows = merkle.op11_manifest(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in docs[r.doc_id] or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)
    assert {r.verified for r in rows} == {True, False}


def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = sum(sizes.values()) * share, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = left - sum(sizes[s] * most for s in capped)
        t = {s: sizes[s] * most for s in capped} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > sizes[s] * most}
        if not over:
            return t
        capped |= over


def text_of(rng, n):
    return " \t".join("w%d" % rng.randrange(99) for _ in range(n))


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, ["a", "b", "é", None, "c", "hot"][min(i % 9, 5)], text_of(rng, int(rng.paretovariate(0.9) * 5) % 5000), i) for i in range(3000)]
    rows += [(9000 + i, "tiny", "one two three", 0) for i in range(3)] + [(9100, "void", "", 0), (9101, "void", None, 0)]
    rows += [(777, "c", text_of(random.Random(1), 40), 4)] * 2000
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, m int")
    out = mixing.mix(df, [3, 1, 2]).collect()
    assert len(out) == len(rows) and sorted(out[0].asDict()) == sorted(["doc_id", "source", "text", "m", "size", "source_size", "target", "copies", "taken"])
    assert sorted((r.doc_id, r.m) for r in out) == sorted((r[0], r[3]) for r in rows)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes, [3, 1, 2], 1.5, 2)
    took = defaultdict(int)
    for r in out:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(3, 0.002 * want[s]), (s, took[s], want[s])
    again = mixing.mix(df.repartition(7, "text"), [3, 1, 2]).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in again) == sorted((r.doc_id, r.size, r.taken) for r in out)


def test_inclusion_follows_the_weights(spark):
    rows = [(i, "s", text_of(random.Random(i), 20), 16 if i % 2 else 48) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, weight int")
    n = defaultdict(list)
    for r in mixing.mix(df, [1], share=0.4, level=F.col("weight")).collect():
        n[r.weight].append(r.copies)
    # 0.4 in all, three to one: 0.6 and 0.2; ranks are random, so a sixteenth is three deviations off
    assert abs(sum(n[48]) / 1000 - 0.6) < 0.05 and abs(sum(n[16]) / 1000 - 0.2) < 0.05
    certain = mixing.mix(df, [1], share=1.7, level=F.col("weight")).collect()
    assert {r.copies for r in certain if r.weight == 48} == {2} and {r.copies for r in certain if r.weight == 16} == {1, 2}


def test_mix_by_salted_joins(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, f"s{i % 5}", text_of(rng, rng.randrange(1, 60))) for i in range(400)], "doc_id long, source string, text string")
    one = sorted((r.doc_id, r.taken) for r in mixing.mix(df, [3, 1, 2]).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(df, [3, 1, 2]).collect()) == one


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df, [1]).count() == 0
    void = mixing.mix(spark.createDataFrame([(None, None, None), (1, None, "")], df.schema), [1]).collect()
    assert [(r.size, r.taken, r.target) for r in void] == [(0, 0, 0.0)] * 2


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    at = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            at[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in at:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(at, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(at[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    ends = lambda p: sha(",".join(str(c) for c in sorted(at[p]) if len(convs[c]) == len(p)))
    return sorted((min(v), len(p), min(at[p[:-1]]) if p else -1, len(v), len(kids[p]), leaves[p], saved[p], ends(p)) for p, v in at.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rng = random.Random(8)
    convs = {}
    for c in range(250):
        convs[c] = [(rng.choice("ua"), rng.choice(["x", "yy", "é" * 3, ""])) for _ in range(rng.randrange(1, 7))]
    long = [("u", str(i % 3)) for i in range(700)]
    convs |= {300: long, 301: long[:600] + [("a", "other")], 302: long[:256], 303: long[:257] + [("u", "z")], 304: long}
    convs |= {400 + i: [("u", "hello"), ("a", "hi")] for i in range(100)}
    # each chain hangs from the one before it
    convs |= {600 + i: [("u", "nest")] * (i + 1) + [("a", "end")] for i in range(12)}
    rows = [(c, None if i == 0 else i, r, t) for c, v in convs.items() for i, (r, t) in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(trie.conversation_trie(df)) == plain_trie(convs)


def test_trie_by_shuffled_joins(spark, monkeypatch):
    from tracemill.llm import common

    monkeypatch.setattr(common.Workspace, "small", lambda self, table, most=0: table)
    convs = {c: [("u", str(c % 3)), ("a", str(c % 7)), ("u", str(c % 2))] for c in range(60)}
    df = spark.createDataFrame([(c, i, r, t) for c, v in convs.items() for i, (r, t) in enumerate(v)], "conv_id long, turn long, role string, text string")
    assert found(trie.conversation_trie(df)) == plain_trie(convs)


def test_trie_on_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string, nth int, own int"
    none = spark.createDataFrame([], kind)
    assert trie.conversation_trie(none).count() == 0
    odd = spark.createDataFrame([(None, 1, "u", "x", 1, 1), (5, None, None, None, 2, 2), (5, 1, "u", "a" * 200_000, 3, 3), (6, None, "", "", 1, 1), (6, 0, "u", "b", 1, 1), (6, 0, "u", "b", 1, 1)], kind)
    assert found(trie.conversation_trie(odd)) == plain_trie({5: [("", ""), ("u", "a" * 200_000)], 6: [("", ""), ("u", "b"), ("u", "b")]})


def test_rebuilt_conversations(spark, tmp_path):
    """Heads of another, absent bases, and conversations left without turns."""
    rows = [(c, i, "u", f"{c % 4}.{i}") for c in (100, 101, 102, 150, 205, 206, 207, 208, 300, 301) for i in range(1 + c % 3)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    own = defaultdict(list)
    for c, _, r, t in sorted(rows):
        own[c].append((r, t))
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    assert any(not v for v in convs.values())
    assert found(trie.op13_prefix_trie(spark, str(tmp_path))) == plain_trie(convs)
