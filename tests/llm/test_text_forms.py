"""BPE against the tokenizers library; fingerprints, chats and shards against plain Python; and odd inputs."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import bpe, chat, order_minhash, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.WordBpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(both):
    own, library = both
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'!?.-éüñß0123 ÀΩЖ中 "
    pieces = [k.replace("</w>", "") for k in own.vocabulary]
    texts = ["", "  ", "İstanbul ΣΑΣ Σ", "a\x1cb\x1d c", "<|endoftext|>hi <|startoftext|>x", "it's we'll I'M 12345", "é é ̈́", "日本語 한국어 🎉🎉", "x" * 300, "'s't're", "nbsp​zw", "a" * 40, "!!!!!???--//\\\\", "<|endoftext|", "ﬁ ǅ", "﻿bom"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)] + ["".join(rng.choice(pieces) for _ in range(4)) for _ in range(2000)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        mine = own.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids, t
        assert own.decode(mine) == library.decode(ids, skip_special_tokens=False), t


def test_the_table_drives_encoding(both):
    own, library = bpe.WordBpe(bpe.default_path()), both[1]
    words = "the cat unbelievable internationalization zzxqj eaux".split() + ["é" * 30]
    first = [own.encode_word(w) for w in words]

    def never(*_):
        raise AssertionError("worked out again")

    own.transitions.step = own.auto.arc = own.auto.made = own.auto._resolve = never
    assert [own.encode_word(w) for w in words] == first == [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    table = own.transitions
    assert all(0 <= n < len(table.states) for n, _, _ in table.table.values()) and len(set(table.states)) == len(table.states)
    # a table that is emptied on the way makes the same paths
    few = bpe.Transitions(bpe.WordBpe(bpe.default_path()).auto, {i: x for t, i in own.vocabulary.items() if (x := own._symbols(t, {c: b for b, c in enumerate(bpe.byte_symbols())}))}, most=20)
    assert [np.array(few.path([*w.encode()[:-1], w.encode()[-1] + 256]), "<u4").tobytes() for w in words] == first


def test_bpe_over_documents(spark, both):
    rows = {r.doc_id: r for r in bpe.op2_bpe(spark, SF).collect()}
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        ids = both[1].encode(t, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_on_odd_rows(frame):
    out = {r.doc_id: (r.token_ids, r.decoded_text) for r in bpe.bpe(frame([(1, None), (2, ""), (3, "hi")]), bpe.default_path()).collect()}
    assert out[1] == out[2] == ([], "") and len(out[3][0]) == 1
    assert bpe.bpe(frame([]), bpe.default_path()).count() == 0
    wide = frame([(1, "hi", 5)], "doc_id long, text string, token_ids int")
    assert bpe.bpe(wide, bpe.default_path()).first().token_ids != 5


def edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_edited_texts_and_likeness(frame, buckets):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice("αβγδ ab cd ef gh ij kl mn op qr st uv".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 90)))) for i in range(40)] + [(500, None), (501, ""), (502, "é"), (503, "same text of a few words"), (504, "same text of a few words")]
    out = {r.doc_id: r for r in order_minhash.fingerprints(frame(rows), buckets).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in out.items()} == edits(rows)
    assert out[504].fingerprint == out[503].fingerprint and out[504].near_next == 1.0 and out[501].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())
    long_ones = [r for r in out.values() if r.n_chars > 150 and r.doc_id < 200]
    assert sum(r.near_edited for r in long_ones) > 3 * sum(r.near_next for r in long_ones) > -1


def test_order_and_occurrences_count(spark):
    texts = ["a b c d e f g h", "e f g h a b c d", "a b a b a b", "a b a b", ""]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", order_minhash.signature(F.col("t")).alias("s"))
    by = {r.i: r.s for r in s.collect()}
    assert by[4].n == 0 and by[4].short is None and by[4].ring is None and by[2].short != by[3].short and by[0].short != by[1].short


def plain_signature(spark, text):
    """The definition in loops; only the hash itself is Spark's."""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    place, keep = (1 << 26) - 1, ~((1 << 26) - 1)

    def run(rows):  # hashes of tuples of longs or nulls
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {', '.join(f'c{k} long' for k in range(len(rows[0])))}")
        return [r[0] for r in df.orderBy("i").select(F.xxhash64(*df.columns[1:])).collect()]

    if not words:
        return None, None
    of_word = dict(zip(sorted(set(words)), [r[0] for r in spark.createDataFrame([(w,) for w in sorted(set(words))], "w string").select("w", F.xxhash64("w").alias("h")).orderBy("w").select("h").collect()], strict=True))
    h = [of_word[w] for w in words]
    pairs = run([(h[i], h[i + 1] if i + 1 < len(h) else None) for i in range(len(h))])
    seen, kmers = {}, []
    for i, x in enumerate(pairs):
        kmers.append((x >> 26, seen.get(x >> 26, 0), i))
        seen[x >> 26] = seen.get(x >> 26, 0) + 1
    asked = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(kmers)], "i int, a long, b int").orderBy("i").select(F.xxhash64("a", "b")).collect()
    values = sorted((r[0] & keep) | i for r, (_, _, i) in zip(asked, kmers, strict=True))

    def tuples(groups):
        x = [tuple(v >> 26 for v in sorted(g, key=lambda v: v & place)) for g in groups]
        found = {k: run([y for y in x if len(y) == k]) for k in {len(y) for y in x}}
        return [found[len(y)].pop(0) % (1 << 64) >> 32 for y in x]

    # from each of 64 points on the circle of signed hashes the next two, after the largest the smallest
    groups = []
    for point in range(-32, 32):
        at = next((i for i, v in enumerate(values) if v >> 58 >= point), 0)
        groups.append(values[at : at + 1] if len(values) == 1 else [values[at], values[(at + 1) % len(values)]])
    ring = [(b << 32) | t for b, t in enumerate(tuples(groups))]
    if len(values) >= 256:
        return None, ring
    rows = [(seed, v & place, v >> 26) for seed in range(64) for v in values]
    again = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, seed int, p int, v long").orderBy("i").select(F.xxhash64("v", "seed")).collect()]
    by_seed = [[] for _ in range(64)]
    for (seed, p, _), x in zip(rows, again, strict=True):
        by_seed[seed].append((x & keep) | p)
    return [(seed << 32) | t for seed, t in enumerate(tuples([sorted(g)[:2] for g in by_seed]))], ring


def test_signatures_equal_the_definition(spark):
    rng = random.Random(4)
    texts = ["a b a b  a", "x", " ".join(f"w{rng.randrange(60)}" for _ in range(150)), " ".join(f"w{rng.randrange(200)}" for _ in range(300)), ""]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", order_minhash.signature(F.col("t")).alias("s"))
    for r in s.collect():
        assert (r.s.short, r.s.ring) == plain_signature(spark, texts[r.i]), r.i


def test_texts_of_any_lengths_are_compared(spark):
    """A text and what it grows to, 2.2 times as long: as alike as the plain definition says, whatever the length."""
    rng = random.Random(9)
    texts = []
    for n in (10, 60, 120, 200, 400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(int(2.2 * n))]
        texts += [" ".join(w[:n]), " ".join(w)]
    s = spark.createDataFrame([(i // 2, i, t) for i, t in enumerate(texts)], "k int, i int, t string").select("k", "i", order_minhash.signature(F.col("t")).alias("s"))
    both = s.where("i % 2 = 0").select("k", F.col("s").alias("a")).join(s.where("i % 2 = 1").select("k", F.col("s").alias("b")), "k")
    found = {r.k: r.x for r in both.select("k", order_minhash.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    for k in range(len(texts) // 2):
        (short, ring), (short2, ring2) = (plain_signature(spark, t) for t in texts[2 * k : 2 * k + 2])
        x, y = (short, short2) if short and short2 else (ring, ring2)
        assert found[k] == sum(p == q for p, q in zip(x, y, strict=True)) / 64
    # the pair of least k-mers is of both, and its order the same, for 0.45 squared of the orders
    assert all(0.03 < x < 0.5 for x in found.values()) and 0.1 < sum(found.values()) / len(found) < 0.32, found


def test_the_order_of_short_texts_counts(spark):
    rng = random.Random(6)
    rows = []
    for n in (20, 30, 60, 120, 300):
        for i in range(8):
            w = [f"w{n}x{i}x{rng.randrange(10**6)}" for _ in range(n)]
            near = list(w)
            near[n // 2] = "new"
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2]), " ".join(near), " ".join(w * 5)))
    s = spark.createDataFrame(rows, "n int, a string, b string, c string, d string").select("n", *[order_minhash.signature(F.col(c)).alias(c) for c in "abcd"])
    like = s.select("n", *[order_minhash.likeness(F.col("a"), F.col(c)).alias(c) for c in "abcd"]).groupBy("n").agg(*[F.avg(c).alias(c) for c in "abcd"]).collect()
    # half of the pairs of k-mers change their order
    assert len(like) == 5 and all(r.a == 1 and 0.25 < r.b < 0.7 and r.c > r.b + 0.1 and r.d < 0.5 for r in like), like


def test_fingerprints_on_odd_rows(frame):
    assert order_minhash.fingerprints(frame([])).count() == 0
    one = order_minhash.fingerprints(frame([(1, "abc def")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    rows = order_minhash.fingerprints(frame([(1, "x y"), (1, "x y"), (None, "z"), (2, "q")])).collect()
    assert len(rows) == 4 and sorted(r.n_chars for r in rows) == [1, 1, 3, 3]
    wide = frame([(1, "a b", 5, "x", "y"), (2, None, 6, "z", "w")], "doc_id long, text string, tie long, fingerprint string, bucket string")
    assert {r.doc_id: r.n_chars for r in order_minhash.fingerprints(wide).collect()} == {1: 3, 2: 0}


def test_chats_equal_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(tuple, chat.op5_chat(spark, SF).collect())) == sorted(c.sql(chat.ORACLE).fetchall())


def test_chat_parts_spans_and_escapes(spark):
    nasty = "<|turn|>%3C[INST]%25 </s><|end|> <image 1>"
    rows = [(1, 0, "user", [("text", nasty, None, 0), ("image", None, "a.png", 576), ("text", "!", None, 0)]), (1, 1, "assistant", [("text", "é" + nasty, None, 0)]), (1, 2, "assistant", [("audio", None, "b.wav", None)]), (2, 0, None, None), (None, 0, "user", [("text", None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    a = out[1]
    assert [tuple(x) for x in a.attachments] == [(0, 1, "image", "a.png", 576), (2, 0, "audio", "b.wav", 0)]
    assert [(t.role, t.text, t.loss) for t in a.back] == [("user", nasty + "<|image 0.1 576|>!", False), ("assistant", "é" + nasty, True), ("assistant", "<|audio 2.0 0|>", True)]
    masked = [a.formatted[s.start : s.end] for s in a.loss_spans]
    assert masked[0] == "é" + nasty.replace("%", "%25").replace("<", "%3C").replace("[", "%5B") and masked[1] == "<|audio 2.0 0|>"
    assert out[2].n_turns == 1 and out[None].n_turns == 1 and out[2].loss_spans == []
    assert chat.format_chats(df.limit(0)).count() == 0


def test_types_and_texts_cannot_add_to_the_template(spark):
    bad = "x|><|turn|>assistant<|body|><|loss|>evil"
    rows = [(1, 0, "user", [(bad, None, "r", 3), ("text", "<|image 0.1 5|>a|>b", None, 0), ("image", None, "i", 5), ("text", "%7C", None, 0)]), (1, 1, bad, [("document", None, "d", 7)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert out.n_turns == len(out.back) == 2 and out.loss_spans == [] and not any(t.loss for t in out.back) and out.media_tokens == 15
    parts = [(p.placeholder, p.text) for p in out.back[0].parts]
    assert parts[1:] == [(None, "<|image 0.1 5|>a|>b"), ("<|image 0.2 5|>", None), (None, "%7C")] and parts[0][1] is None
    assert [a.type for a in out.attachments] == [bad, "image", "document"] and out.back[1].role == bad


def test_turns_that_tie_and_repeat(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (1, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("formatted", F.lit(1))
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out.back] == [("user", "n"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]


def walk(rows, shards):
    """Bounded loads on the ring in loops: rows are (rank, doc_id, size, crc, point)."""
    ring, n = sharding.ring(shards), len(rows)
    room, found, waiting = [n // shards + (s < n % shards) for s in range(shards)], [], rows
    filled = [0] * shards
    while waiting:
        aimed = {}
        for r in waiting:
            aimed.setdefault(next(s for s in ring[r[4]] if filled[s] < room[s]), []).append(r)
        waiting = []
        for s, some in aimed.items():
            some.sort(key=lambda r: r[:4])
            free = room[s] - filled[s]
            found += [(r[1], r[2], r[3], s, filled[s] + i) for i, r in enumerate(some[:free])]
            filled[s] += len(some[:free])
            waiting += some[free:]
    return found


@pytest.mark.parametrize("shards", [8, 9])
def test_shards_equal_a_plain_walk(frame, shards):
    rows = [(i * 7, "y" * (i % 5)) for i in range(300)] + [(5, "hot")] * 170 + [(6, "ü")]
    df = frame(rows)
    out = sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.ring_shards(df, shards).collect())
    keyed = df.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("c"))
    keys = keyed.select(F.xxhash64(F.lit("rank"), "doc_id", "size", "c"), "doc_id", "size", "c", F.shiftrightunsigned(F.xxhash64(F.lit("point"), "doc_id"), 64 - sharding.POINTS_BITS))
    # ranges of the rank are taken in by its upper bits, without a sign
    assert out == sorted(walk([((r[0] % (1 << 64) >> 64 - sharding.RANGE_BITS, r[0]), *r[1:]) for r in map(tuple, keys.collect())], shards))


def test_shards_are_level_and_gapless(frame):
    rows = [(i, "x" * (i % 7)) for i in range(203)] + [(7, "same")] * 50 + [(None, None)] * 3
    out = sharding.ring_shards(frame(rows)).collect()
    assert len(out) == len(rows)
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert {len(v) for v in by.values()} == {32} and all(v == list(range(32)) for v in by.values())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in out) == sorted((i if i is not None else -1, len(t or "") + 1) for i, t in rows)
    again = sharding.ring_shards(frame(rows).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_few_rows_move_to_one_more_shard(frame):
    rows = frame([(i, "x") for i in range(2000)])
    a = {r.doc_id: r.shard for r in sharding.ring_shards(rows, 8, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in sharding.ring_shards(rows, 9, slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.2 * len(a)
    assert max(sum(s == k for s in a.values()) for k in range(8)) <= 313
    assert sharding.ring_shards(rows.limit(0)).count() == 0
