"""N-gram Jaccard join with filters under several global token orders.

A text's tokens are its distinct word shingles. Under any total order of all tokens, two sets with a Jaccard
similarity of t or more share a token among the first n - ceil(t n) + 1 of each. The first order is by bands of a hash,
and within a band by document frequency, rarest first, so that common passages make no large buckets; its prefixes are
the index. A set takes part in the counts with the tokens of as many bands as hold its prefix: frequencies are exact,
whatever the number of documents, for a share of the tokens' cost, and a token that no other set counts is in no bucket.
Of the second order, by a hash, each set keeps a longer prefix, of n - ceil(t n) + l tokens, of which a pair must share
l; of the third, by another hash, a pair must share one. Only pairs that pass all three have their texts fetched and
their whole sets compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import BROADCAST_ROWS, SPACE, Words, Workspace, distinct, doc_columns, fresh, list_array, mix, parity_sketch, parts, shingle, slices
from tracemill.llm.components import apart, bucket_components, pack, place_of, size_of

#: A band of the first order has so many percent of the tokens that a prefix has; any bands give right results.
BAND = 150
#: Seeds of the orders.
FIRST, SECOND, THIRD = 3, 11, 23
#: Words of 64 bits of a set's parity sketch, which bounds from below in how many tokens two sets differ.
SKETCH = 6


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes)."""
    for first, data, offsets in slices(texts):
        w = Words(data, offsets, SPACE)
        hashes = w.hashes
        for r in range(len(offsets) - 1):
            yield first + r, distinct(shingle(hashes[w.ptr[r] : w.ptr[r + 1]], k))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def shared_least(n: int, percent: int) -> int:
    """How many tokens of their longer prefixes two sets must share, by the size of the smaller one."""
    return min(prefix_length(n, percent), (percent * n + 99) // 100)


def least_tokens(s: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The first k tokens under the order of a hash, as the lower halves of its values; none if two of these are equal."""
    m = mix(s, seed)
    low = (np.partition(m, k - 1)[:k] if k < len(m) else m) & np.uint64(0xFFFFFFFF)
    out = distinct(low.astype(np.uint32)).view(np.int32)
    return out if len(out) == k else out[:0]


def further_prefixes(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The longer prefix under the second order, of which a pair must share shared_least(), and that under the third."""
    p = prefix_length(len(s), percent)
    return least_tokens(s, p - 1 + shared_least(len(s), percent), SECOND), least_tokens(s, p, THIRD)


def first_bands(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The tokens, by their hashes, of as many bands of the first order as hold the prefix, and how many are of lower bands than the last."""
    m, p = mix(s, FIRST), prefix_length(len(s), percent)
    upper = m >> np.uint64(32)
    width = np.uint64(max(1, BAND * (100 - percent)) * (1 << 32) // 10_000 or 1)
    last = np.partition(upper, p - 1)[p - 1] // width
    band = upper // width
    lower = m[band < last]
    return np.concatenate((lower, m[band == last])), len(lower)


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Every row of docs as (doc_id, n_shingles, set_key, component_id), linked where 100 * intersection >= percent * union.

    docs: doc_id, text, and other columns, which are ignored. A-Z is lower-cased; words are what stands between the
    ASCII spaces; a text of fewer than k words has one shingle of all of them. n_shingles is the size of the set,
    component_id the smallest doc_id that links reach, set_key a 128-bit digest of the set: rows of equal sets are one
    node of the graph, so copies are never paired with each other.

    A null or empty text, and one of white space only, has no shingle, a null set_key, and its own doc_id as
    component_id; repeated rows are returned as often as they occur; a null doc_id takes part, but is never the
    smallest unless all of its component are null; no rows give no rows. The result is a table in the shared folder.
    """
    work = Workspace(docs.sparkSession)
    joined = work.write(_joined(docs, k, percent, work).select("doc_id", F.col("n").alias("n_shingles"), "set_key", "component_id"))
    work.keep(joined)
    return joined


def _joined(docs: DataFrame, k: int, percent: int, work: Workspace) -> DataFrame:
    """doc_id, tie, n, set_key, component_id, cluster: of each row of docs.

    tie is a hash of the text, cluster a number that the rows of a component have in common and no others; null if n is 0.
    """
    docs = doc_columns(docs).withColumn("tie", F.xxhash64("text"))
    parity = [f"parity{i}" for i in range(SKETCH)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes, keys, counts, lows, tokens = [], [], [], [], [np.zeros(0, np.uint64)]
            seconds, thirds, lengths, sketches = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], ([], []), np.zeros((len(batch), SKETCH), np.uint64)
            for r, s in _sets(batch.column(1), k):
                for x, out, sizes_of in zip(further_prefixes(s, percent) if len(s) else (s[:0].astype(np.int32),) * 2, (seconds, thirds), lengths, strict=True):
                    out.append(x)
                    sizes_of.append(len(x))
                if len(s):
                    sketches[r] = parity_sketch(s, np.zeros(1, np.int64), SKETCH)
                some, low = first_bands(s, percent) if len(s) else (s, 0)
                tokens.append(some)
                counts.append(len(some))
                lows.append(low)
                sizes.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), list_array(np.concatenate(tokens), counts, pa.int64()), pa.array(lows, pa.int32()), list_array(np.concatenate(seconds), lengths[0], pa.int32()), list_array(np.concatenate(thirds), lengths[1], pa.int32()), *[pa.array(sketches[:, i].view(np.int64)) for i in range(SKETCH)]], ["doc_id", "tie", "n", "set_key", "tokens", "low", "second", "third", *parity])

    table = work.write(docs.mapInArrow(prefixes, ", ".join(["doc_id long, tie long, n long, set_key binary, tokens array<long>, low int, second array<int>, third array<int>", *(f"{x} long" for x in parity)])).withColumn("row", F.monotonically_increasing_id()))
    classes = work.write(table.where("n > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    # only sets that repeat are looked up, so that the tokens of the others need not travel for it
    repeated = work.write(classes.where("copies > 1").select("set_key", "node"))
    chosen = table.where("n > 0").join(work.small(repeated), "set_key", "left").where("node is null or node = row").drop("node")
    # spare: how many tokens of the last band are beyond the prefix, and -1 for tokens of the bands below it
    share = F.expr(f"({percent} * n + 99) div 100")
    spread = chosen.select(F.posexplode("tokens").alias("at", "bucket"), F.col("row").alias("node"), "n", (F.size("tokens") - (F.col("n") - share + 1)).alias("spare"), "low")
    spread = spread.select("bucket", "node", pack(F.col("n"), F.when(F.col("at") < F.col("low"), 0).otherwise(F.col("spare") + 1)).alias("about"))
    several = spread.withColumn("docs", F.count("*").over(Window.partitionBy("bucket"))).where("docs > 1")
    n, spare = size_of(F.col("about")), place_of(F.col("about")) - 1
    # from the end of the order; tokens that no other set counts come first and take no place in what is left here
    from_end = F.row_number().over(Window.partitionBy("node").orderBy((spare >= 0).desc(), F.desc("docs"), F.desc("bucket")))
    ranked = several.withColumn("from_end", from_end).where(F.col("from_end") > spare)
    place = F.when(spare < 0, 0).otherwise(n - F.expr(f"({percent} * shiftright(about, 32) + 99) div 100") + 1 + spare - F.col("from_end"))
    postings = work.write(ranked.select("bucket", "node", pack(n, place).alias("packed")))

    def sketches(nodes: DataFrame) -> DataFrame:
        return table.select(F.col("row").alias("node"), *parity).join(work.small(nodes), "node", "left_semi")

    def possible(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        # the sizes may differ so far, the sets may differ in so many elements, and from the first token that they share
        # on there must be enough for the overlap that is needed; a pair is lost at no later token if it is found there
        nx, ny, px, py = size_of(x("packed")), size_of(y("packed")), place_of(x("packed")), place_of(y("packed"))
        rest = F.least(nx - px, ny - py)
        near = (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (rest * (100 + percent) >= (nx + ny) * percent)
        return near & (apart(x, y, parity) * (100 + percent) <= (nx + ny) * (100 - percent))

    def verify(pairs: DataFrame) -> DataFrame:
        """Keeps the pairs that share enough under the further orders, then fetches their texts and compares whole sets."""
        ends = lambda p: p.select(F.col("a").alias("row")).union(p.select(F.col("b").alias("row"))).distinct()
        rows = work.write(ends(pairs))
        known = work.write(table.select("row", "doc_id", "tie", "n", "second", "third").join(work.small(rows), "row", "left_semi"))
        share = F.expr(f"({percent} * n + 99) div 100")
        known_by = known.withColumn("least", F.least(F.col("n") - share + 1, share))
        x, y = (known_by.select(F.col("row").alias(e), F.col("second").alias(f"second_{e}"), F.col("third").alias(f"third_{e}"), F.col("least").alias(f"least_{e}")) for e in "ab")
        unknown = lambda c: (F.size(f"{c}_a") == 0) | (F.size(f"{c}_b") == 0)
        second = unknown("second") | (F.size(F.array_intersect("second_a", "second_b")) >= F.least("least_a", "least_b"))
        third = unknown("third") | F.arrays_overlap("third_a", "third_b")
        likely = work.write(pairs.join(x, "a").join(y, "b").where(third & second).select("a", "b"))
        left = work.write(ends(likely))
        wanted = work.write(known.join(work.small(left), "row", "left_semi").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "tie", "row"))
        found = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(work.small(wanted), ["doc_id", "tie"]).groupBy("row").agg(F.max("text").alias("text"))
        texts = work.write(found)
        both = likely.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep: list[bool] = []
                for at in range(0, len(batch), 64):
                    part = batch.slice(at, 64)
                    keep += [similar(x, y, percent) for (_, x), (_, y) in zip(_sets(part.column(2), k), _sets(part.column(3), k), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        out = work.write(both.mapInArrow(check, "a long, b long"))
        work.forget(rows, known, likely, left, wanted, texts)
        return out

    found = bucket_components(postings, verify, work, possible, sketches)
    ids = work.write(found.join(classes, "node").select("node", "set_key", "low", "component"))
    least = work.write(ids.groupBy("component").agg(F.min("low").alias("component_id")))
    linked = ids.join(work.small(least), "component").select("node", "component", "component_id")
    # what stands alone and has no copy needs no join
    several = classes.join(linked, "node", "left").where("copies > 1 or component is not null")
    of_set = work.write(several.select("set_key", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("component", "node").alias("cluster")))
    base = table.select("doc_id", "tie", "n", "set_key", "row")
    columns = ["doc_id", "tie", "n", "set_key", F.coalesce("component_id", "doc_id").alias("component_id")]
    full = base.where("n > 0").join(work.small(of_set), "set_key", "left").select(*columns, F.coalesce("cluster", "row").alias("cluster"))
    empty = base.where("n = 0").select("doc_id", "tie", "n", "set_key", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("cluster"))
    out = work.write(full.unionByName(empty))
    work.keep(out)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (len(a) + len(b) - common)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are near copies of one kept: of each component the first row by doc_id stays.

    docs: doc_id, text and other columns, all returned. Rows without a shingle (null, empty and blank texts) all stay. A
    row is known by its doc_id and text, so rows of one doc_id with other texts are judged by themselves, and of rows of
    one doc_id in one component the one whose text has the smallest hash stays. A null doc_id comes after all others and
    goes or stays like them. Of rows equal in doc_id and text one stays, the smallest in all columns.
    """
    work = Workspace(docs.sparkSession)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    rows = _joined(docs, k, percent, work)
    placed = rows.where("cluster is not null").select("cluster", key.alias("key"))
    first = work.write(placed.groupBy("cluster").agg(F.min("key").alias("first"), F.count("*").alias("m")).where("m > 1").select("cluster", "first"))
    several = placed.join(work.small(first), "cluster")
    judged = work.write(several.groupBy("key").agg((F.min("first") == F.col("key")).alias("stays"), F.count("*").alias("m")).where("not stays or m > 1").select("key.none", "key.id", "key.tie", "stays"))
    names = [fresh(docs, f"_{x}") for x in ("none", "id", "tie")]
    goes, twice = (judged.where(c).select(*(F.col(x).alias(y) for x, y in zip(("none", "id", "tie"), names, strict=True))) for c in ("not stays", "stays"))
    work.keep(judged)
    few = work.rows(judged) <= BROADCAST_ROWS
    goes, twice = (F.broadcast(x) if few else x for x in (goes, twice))
    doc_id = F.col("doc_id").cast("long")
    of = [x == F.col(y) for x, y in zip((doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64(F.col("text").cast("string"))), names, strict=True)]
    left = docs.join(goes, of, "left_anti")
    once = left.join(twice, of, "left_anti")
    again = left.join(twice, of, "left_semi")
    number = fresh(docs, "n")
    again = again.groupBy(*[F.col(c) for c in ("doc_id", "text")]).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(number)).select(f"{number}.*")
    return once.unionByName(again)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, over sets of 3-word shingles and a similarity of 0.9."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90).select("doc_id", "n_shingles", "component_id")


def brute_force(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) by comparing all pairs of exact word tuples, for tests."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[j]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
