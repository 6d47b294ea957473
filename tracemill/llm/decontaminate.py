"""Benchmark decontamination: windows of test words, found in training texts by a broadcast hash set and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import ALNUM, Words, Workspace, distinct, fresh, parts, shingle, slices

WINDOW = 10
#: The benchmark's texts may have so many bytes in all to be broadcast, some 20 MB as a table of windows; beyond it windows
#: meet in a join.
BENCHMARK_BYTES = 4 << 20
#: Bits of the benchmark's hashes, 8 MB whatever its size, by which most of the documents' windows stay out of that join.
FILTER_BITS = 26


def windows_in(text: str | None, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, hash, the words with spaces between) of each window of an item."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), ALNUM)
    k = min(size, len(w.starts))
    for at, h in enumerate(shingle(w.hashes, size).tolist() if k else ()):
        yield k, h, b" ".join(w.text(i) for i in range(at, at + k))


class Windows:
    """Windows by length: for each its hash, in order, where its words stand in one text, and the items that have it.

    An item's windows are parts of its own words with single spaces between, so a benchmark of some MB is as many MB here
    and 20 bytes a window.
    """

    def __init__(self) -> None:
        self.ids: list[str] = []
        self.text = b""
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def of_items(cls, rows: Iterable[tuple[str, str | None]], size: int) -> Windows:
        """All windows of items (id, text)."""
        new, texts, at, found = cls(), [], 0, {}
        number: dict[str, int] = {}
        for item, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(data, np.array([0, len(data)]), ALNUM)
            if not len(w.starts):
                continue
            texts.append(b" ".join(w.text(i) for i in range(len(w.starts))))
            ends = np.cumsum(w.ends - w.starts + 1) - 1
            starts = ends - (w.ends - w.starts)
            k = min(size, len(starts))
            n = len(starts) - k + 1
            who = np.full(n, number.setdefault(item, len(number)), np.int32)
            found.setdefault(k, []).append((shingle(w.hashes, size), at + starts[:n], at + ends[k - 1 :], who))
            at += len(texts[-1]) + 1
        new.ids, new.text = list(number), b" ".join(texts)
        for k, parts_of in found.items():
            new._set(k, *[np.concatenate(x) for x in zip(*parts_of, strict=True)])
        return new

    @classmethod
    def of_entries(cls, entries: Iterable[tuple[int, int, bytes, list[str]]]) -> Windows:
        """Windows (words, hash, their words, items)."""
        new, texts, at, found = cls(), [], 0, {}
        number: dict[str, int] = {}
        for k, h, words, items in entries:
            texts.append(words)
            found.setdefault(k, []).extend((h, at, at + len(words), number.setdefault(i, len(number))) for i in items)
            at += len(words) + 1
        new.ids, new.text = list(number), b" ".join(texts)
        for k, rows in found.items():
            new._set(k, np.array([r[0] for r in rows], np.uint64), *[np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3)])
        return new

    def _set(self, k: int, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray) -> None:
        """Equal windows as one, by a number for each distinct words of a hash."""
        order = np.argsort(hashes, kind="stable")
        hashes, starts, ends, items = (x[order] for x in (hashes, starts, ends, items))
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        same = np.cumsum(new) - 1
        # the first window of each hash; those of another text, which hardly are, are told apart one by one
        first = np.flatnonzero(new)
        other = [i for i in np.flatnonzero(~new).tolist() if self.text[starts[i] : ends[i]] != self.text[starts[f := first[same[i]]] : ends[f]]]
        if other:
            ids: dict[tuple[int, bytes], int] = {}
            same = np.array([ids.setdefault((int(hashes[i]), self.text[starts[i] : ends[i]]), len(ids)) for i in range(len(hashes))])
            order = np.argsort(same, kind="stable")
            hashes, starts, ends, items, same = (x[order] for x in (hashes, starts, ends, items, same))
            new[1:] = same[1:] != same[:-1]
            first = np.flatnonzero(new)
        spans = np.stack([starts[first], ends[first]], 1).astype(np.int32 if len(self.text) < 1 << 31 else np.int64)
        self.by_length[k] = (hashes[first], spans, np.append(first, len(hashes)).astype(np.int32), items.astype(np.int32))

    def scan(self, w: Words, hashes: np.ndarray, row: int) -> tuple[np.ndarray, set[int], list[tuple[int, int]]]:
        """For one text: which of its words are hit, the items found, and the windows (first word, words)."""
        a, b = w.ptr[row], w.ptr[row + 1]
        hit, items, spans = np.zeros(b - a, bool), set(), []
        for k, (keys, where, ptr, owners) in self.by_length.items():
            if b - a < k:
                continue
            mine = shingle(hashes[a:b], k)
            at = np.searchsorted(keys, mine)
            at[at == len(keys)] = 0
            for i in np.flatnonzero(keys[at] == mine).tolist():
                words, j = b" ".join(w.text(x) for x in range(a + i, a + i + k)), int(at[i])
                while j < len(keys) and keys[j] == mine[i]:
                    if self.text[where[j, 0] : where[j, 1]] == words:
                        hit[i : i + k] = True
                        items.update(owners[ptr[j] : ptr[j + 1]].tolist())
                        spans.append((i, k))
                        break
                    j += 1
        return hit, items, spans


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each value of the upper bits of the hashes that occurs; or-ed by Spark, at most 2 ** (FILTER_BITS - 6) words."""
    at = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _met(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(doc_id, tie, entries): the benchmark's windows whose hash occurs in a text, found by a join, for any size of benchmark."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, h, words = ([x[i] for x in windows_in(text, size)] for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(words, pa.binary()), pa.array([item] * len(k), pa.string())], ["k", "h", "words", "item"])

    work = Workspace(docs.sparkSession)
    windows = work.write(benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null").mapInArrow(of_items, "k int, h long, words binary, item string").distinct())
    keys = work.write(windows.select("k", "h").distinct())
    lengths = sorted(r[0] for r in keys.select("k").distinct().collect())  # at most ``size`` of them
    bits = docs.sparkSession.sparkContext.broadcast(_filter(keys))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(2)):
                w = Words(data, offsets, ALNUM)
                hashes = w.hashes
                for r in range(len(offsets) - 1):
                    mine = hashes[w.ptr[r] : w.ptr[r + 1]]
                    for k in lengths:
                        if len(mine) >= k:
                            h = distinct(shingle(mine, k))
                            at = h >> np.uint64(64 - FILTER_BITS)
                            h = h[(bits.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
                            if len(h):
                                same = [pa.array([c[first + r].as_py()] * len(h), pa.int64()) for c in batch.columns[:2]]
                                yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64))], ["doc_id", "tie", "k", "h"])

    mine = docs.mapInArrow(of_docs, "doc_id long, tie long, k int, h long").distinct()
    hits = work.write(mine.join(work.small(keys), ["k", "h"], "left_semi"))
    owners = windows.groupBy("k", "h", "words").agg(F.collect_set("item").alias("items"))
    out = work.write(hits.join(owners, ["k", "h"]).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("k", "h", "words", "items")).alias("entries")))
    work.keep(out)
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, action: str = "report") -> DataFrame:
    """Documents with the benchmark windows that occur in them.

    docs: doc_id, text, and any other columns. benchmark: item_id, text. A window is ``size`` consecutive words of an
    item; an item of fewer words, but not none, is one window. Words are runs of letters and digits (bytes outside
    ASCII count as letters), A-Z lower-cased. A candidate found by its hash counts only if its words are equal.

    action "report" adds n_words, n_hit, hit_items (array of item ids as strings, sorted as strings) and hit_spans
    (array of first byte and end byte, merged); "remove_spans" gives docs' own columns with the hit bytes cut out of
    text; "remove_documents" gives docs' own columns for the documents without a hit.

    Null and empty texts have no words and no hits, and stay as they are; benchmark rows with a null id are ignored,
    with a null text have no window; an empty benchmark hits nothing; repeated rows are judged one by one; columns
    of docs named like an added one are replaced by it. Texts are read whole. A benchmark of more than BENCHMARK_BYTES is
    not broadcast: its windows are joined with the documents' by their hashes, and each text gets those it may have.
    """
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    small = total <= BENCHMARK_BYTES
    rows = [(str(r[0]), r[1]) for r in benchmark.select("item_id", "text").where("item_id is not null").collect()] if small else []
    table = docs.sparkSession.sparkContext.broadcast(Windows.of_items(rows, size))
    added = "n_words long, n_hit long, hit_items array<string>, hit_spans array<struct<first:long,last:long>>"
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items", "hit_spans")]
    base = docs.select(*own)
    text_at, names = own.index("text"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    if not small:
        met = _met(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("string")), benchmark, size)
        of_id, of_tie, of_entries = (fresh(base, x) for x in ("_id", "_tie", "_entries"))
        met = met.select(F.col("doc_id").alias(of_id), F.col("tie").alias(of_tie), F.col("entries").alias(of_entries))
        base = base.join(met, F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_tie)), "left").select(*own, of_entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = table.value
        for batch in parts(batches):
            entries = batch.column(len(own)) if not small else None
            batch = batch.select(own) if not small else batch
            n_words, n_hit, items, spans = [], [], [], []
            texts = batch.column(text_at)
            new = [] if action == "remove_spans" else None
            for first, data, offsets in slices(texts):
                w = Words(data, offsets, ALNUM)
                hashes = w.hashes
                for r in range(len(offsets) - 1):
                    if entries is not None:
                        windows = Windows.of_entries((e["k"], e["h"] % (1 << 64), e["words"], e["items"]) for e in entries[first + r].as_py() or ())
                    hit, found, _ = windows.scan(w, hashes, r)
                    a = w.ptr[r]
                    n_words.append(len(hit))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(windows.ids[i] for i in found))
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    cut = [{"first": int(w.starts[a + x] - offsets[r]), "last": int(w.ends[a + y - 1] - offsets[r])} for x, y in zip(edges[::2], edges[1::2])]
                    spans.append(cut)
                    if new is not None:
                        if not cut:
                            new.append(texts[first + r].as_py())
                        else:
                            raw, at, kept = data[offsets[r] : offsets[r + 1]].tobytes(), 0, []
                            for s in cut:
                                kept.append(raw[at : s["first"]])
                                at = s["last"]
                            new.append(b"".join([*kept, raw[at:]]).decode())
            if action == "report":
                columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*own, "n_words", "n_hit", "hit_items", "hit_spans"])
            elif action == "remove_spans":
                columns = [pa.array(new, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, own)
            else:
                yield batch.filter(pa.array([not x for x in n_hit], pa.bool_()))

    return base.mapInArrow(run, f"{names}, {added}" if action == "report" else names)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
b AS (SELECT item_id, {_SPLIT} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS k, array_to_string(ws[p:p + least({WINDOW}, len(ws)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS t(p) WHERE len(ws) > 0),
dw AS (SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM iw) AS ks, unnest(range(1, len(ws) - k + 2)) AS t(p)),
h AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, s)),
c AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM h, unnest(range(k)) AS u(j) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) AS x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""


def brute_force(text: str | None, items: list[tuple[object, str | None]], size: int = WINDOW) -> tuple[int, int, int, str]:
    """The same digest for one text by plain comparison, for tests."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        k = min(size, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
