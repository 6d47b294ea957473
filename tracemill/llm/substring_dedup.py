"""Substring dedup: paragraphs, MinHash banding, exact verification, components, and removal of repeated runs.

A sentence goes up to a full stop, question or exclamation mark, or a line end; those of fewer than LEAST_WORDS words in
a row are put together. They are compared whole. So are anchors, some of the runs of ANCHOR words, chosen so that every
repeat long enough to go has one; a repeated anchor is extended word by word as far as the copy that stays is equal, so
it does not matter where in a sentence a passage begins and ends. What is compared for likeness is a paragraph: a line,
short lines in a row together, or a part of a long line, cut at sentences, or words where there are none, that have the
least hash far and wide. Where any of them begins and ends depends on its own words, so a passage has the same ones
wherever it stands.

Units are equal if 96 bits of hashes of their words are; shingles are compared by 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import BROADCAST_ROWS, SPACE, Runs, U, Words, Workspace, distinct, fresh, list_array, mix, parity_sketch, parts, ranges, shingle, slices
from tracemill.llm.components import apart, bucket_components

SHINGLE, PERCENT = 5, 80
LEAST_WORDS, ANCHOR = 8, 16
#: Lines of fewer words are put together, of more are cut at sentences that are the least of so many to either side; what
#: is still longer is cut at words that are the least of so many; paragraphs of fewer words than the last have no bands.
LINE_LEAST, LINE_MOST, NEAR_SENTENCES, PART_MOST, NEAR_WORDS, BLOCK_LEAST = 40, 100, 3, 200, 32, 20
#: Bands of rows each: a pair of similarity 0.8 meets with probability 0.97, of 0.9 with 0.999; equal ones always do.
BANDS, ROWS = 5, 3
#: Words of 64 bits of a paragraph's parity sketch, which bounds from below in how many shingles two differ.
SKETCH = 4
#: A run of repeated words is removed if it has so many words; shorter ones are the language's or the site's habits.
RUN_WORDS = 28
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F]] = True


def _least(keys: np.ndarray, reach: int) -> np.ndarray:
    """Where a key is the least of those up to reach places before and after it, and of all that many."""
    if len(keys) < 2 * reach + 1:
        return np.flatnonzero(keys == keys.min())[:1] if len(keys) > reach else np.zeros(0, np.int64)
    padded = np.concatenate((np.full(reach, ~U(0)), keys, np.full(reach, ~U(0))))
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1).min(1) == keys)


def _sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """f over each run of width elements."""
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _binary(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """values[first] to values[first + count] as the bytes of each row."""
    offsets = np.concatenate(([0], np.cumsum(4 * count))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values[ranges(first, count)].tobytes())])


class Paragraphs:
    """Sentences of a slice of texts: of text r, those numbered ptr[r]:ptr[r+1], words first[i]:first[i] + words[i].

    blocks() has the paragraphs.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sentences: bool = True):
        w = self.w = Words(data, offsets, SPACE)
        self.raw = data
        if not sentences:
            return
        n = len(w.starts)
        lines = np.concatenate(([0], np.cumsum(data == 0x0A)))
        stop = np.zeros(n, bool)
        if n:
            stop[:-1] = _STOP[data[w.ends[:-1] - 1]] | (lines[w.starts[1:]] > lines[w.ends[:-1]])
            stop[w.ptr[1:][w.ptr[1:] > w.ptr[:-1]] - 1] = True
        self.stop, self.lines = stop, lines
        first, words, ptr = [], [], [0]
        stops = np.flatnonzero(stop)
        at = np.searchsorted(stops, w.ptr)
        for r in range(len(offsets) - 1):
            start, held = int(w.ptr[r]), int(w.ptr[r])  # of the sentence, and of the short ones before it
            for end in (stops[at[r] : at[r + 1]] + 1).tolist():
                if end - start >= LEAST_WORDS:
                    if held < start:
                        first.append(held)
                        words.append(start - held)
                    first.append(start)
                    words.append(end - start)
                    held = end
                elif end - held >= LEAST_WORDS:
                    first.append(held)
                    words.append(end - held)
                    held = end
                start = end
            if held < w.ptr[r + 1]:
                first.append(held)
                words.append(int(w.ptr[r + 1]) - held)
            ptr.append(len(first))
        self.first, self.words, self.ptr = first, words, ptr

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.w.hashes

    @cached_property
    def runs(self) -> tuple[Runs, Runs]:
        return Runs(self.hashes), Runs(mix(self.hashes, 1))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of each paragraph of at least BLOCK_LEAST words."""
        w, h = self.w, self.hashes
        n = len(h)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        with np.errstate(over="ignore"):
            keys = mix(h + np.concatenate((h[:1], h[:-1])) * U(0x9E3779B97F4A7C15), 12)  # of each word and the one before
        ends = np.flatnonzero(self.stop) + 1
        of_line = self.stop.copy()
        of_line[:-1] &= self.lines[w.starts[1:]] > self.lines[w.ends[:-1]]
        of_line[w.ptr[1:][w.ptr[1:] > w.ptr[:-1]] - 1] = True
        line_ends = np.flatnonzero(of_line) + 1
        at = np.searchsorted(line_ends, w.ptr, "right")
        text, first, last = [], [], []

        def add(r: int, a: int, b: int) -> None:
            cuts = [a, b]
            if b - a > LINE_MOST:
                some = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b)]
                cuts = [a, *some[_least(keys[some - 1], NEAR_SENTENCES)].tolist(), b]
            for x, y in zip(cuts, cuts[1:], strict=False):
                parts = [x, y] if y - x <= PART_MOST else [x, *(_least(keys[x : y - 1], NEAR_WORDS) + x + 1).tolist(), y]
                for c, d in zip(parts, parts[1:], strict=False):
                    if d - c >= BLOCK_LEAST:
                        text.append(r)
                        first.append(c)
                        last.append(d)

        for r in range(len(w.ptr) - 1):
            start = held = int(w.ptr[r])
            for end in line_ends[at[r] : at[r + 1]].tolist():
                if end - start >= LINE_LEAST:
                    if held < start:
                        add(r, held, start)
                    add(r, start, end)
                    held = end
                elif end - held >= LINE_LEAST:
                    add(r, held, end)
                    held = end
                start = end
            if held < start:
                add(r, held, start)
        first = np.array(first, np.int64)
        return np.array(text, np.int64), first, np.array(last, np.int64) - first

    def anchors(self, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of each anchor: in each run of run_words words, the run of least hash."""
        size, n = min(ANCHOR, run_words), len(self.hashes)
        wide, m = run_words - size + 1, len(self.hashes) - run_words + 1
        if m <= 0:
            return (np.zeros(0, np.int64),) * 3
        keys = mix(self.runs[0].of(np.arange(n - size + 1), np.full(n - size + 1, size)), 13)
        row = np.repeat(np.arange(len(self.w.ptr) - 1), np.diff(self.w.ptr))
        least = np.zeros(m + 2 * (wide - 1), U)
        least[wide - 1 : wide - 1 + m] = np.where(row[:m] == row[run_words - 1 :], _sliding(np.minimum, keys, wide), U(0))
        # the least of a run that it is in: of the least hashes of those runs, none of which is more, the largest
        first = np.flatnonzero((_sliding(np.maximum, least, wide) == keys) & (keys > 0))
        return row[first], first, np.full(len(first), size)

    def contexts(self, place: np.ndarray, row: np.ndarray, words: np.ndarray, far: int) -> tuple[pa.Array, pa.Array]:
        """The hashes, in 32 bits, of the far words before and after each unit, fewer at the ends of its text."""
        at, short = self.w.ptr[row] + place, (self.hashes >> U(32)).astype(np.uint32)
        before, after = np.minimum(far, place), np.minimum(far, self.w.ptr[row + 1] - at - words)
        return _binary(short, at - before, before), _binary(short, at + words, after)

    def nodes(self, first: np.ndarray, words: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of the words in order, other for each kind of unit, and 32 bits of one of other hashes of them."""
        return mix(self.runs[0].of(first, words), kind), (mix(self.runs[1].of(first, words), kind) >> U(32)).astype(np.uint32)

    def sets(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles, in order, of all units, of SHINGLE words at least, and how many each has."""
        n = words - SHINGLE + 1
        at = ranges(first, n)
        all_of = shingle(self.hashes, SHINGLE) if len(self.hashes) >= SHINGLE else self.hashes[:0]
        keyed = distinct((np.repeat(np.arange(len(n)), n).astype(np.uint64) << U(32)) | (all_of[at] >> U(32)))
        return (keyed & U(0xFFFFFFFF)).astype(np.uint32), np.bincount((keyed >> U(32)).astype(np.int64), minlength=len(n))

    def cut(self, r: int, drop: list[tuple[int, int]]) -> bytes:
        """Text r without the given ranges of its words, which are apart and in order."""
        w, base = self.w, int(self.w.ptr[r])
        begin, end = int(w.offsets[r]), int(w.offsets[r + 1])
        raw, kept, at = self.raw[begin:end].tobytes(), [], 0
        for first, last in drop:
            a = int(w.starts[base + first]) - begin
            b = int(w.starts[base + last]) - begin if base + last < w.ptr[r + 1] else end - begin
            kept.append(raw[at:a])
            at = b
        return b"".join([*kept, raw[at:]])

    def touched(self, r: int, drop: list[tuple[int, int]]) -> int:
        """How many sentences of text r have a word in the given ranges."""
        begin, end = int(self.w.offsets[r]), int(self.w.offsets[r + 1])
        one = Paragraphs(self.raw[begin:end], np.array([0, end - begin]))
        first = np.array(one.first, np.int64)
        last = first + np.array(one.words, np.int64)
        hit = np.zeros(len(first), bool)
        for a, b in drop:
            hit |= (first < b) & (last > a)
        return int(hit.sum())


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements are equal from the start on."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _paragraphs(rows: DataFrame) -> DataFrame:
    """doc_id, tie, place, words, node, s: every paragraph with its shingles. place: the number of the first word in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, ties = batch.column(0), batch.column(1)
            for at, data, offsets in slices(batch.column(2)):
                p = Paragraphs(data, offsets)
                row, first, words = p.blocks()
                nodes, (values, sizes), of = p.nodes(first, words, 11)[0], p.sets(first, words), pa.array(row + at)
                yield pa.RecordBatch.from_arrays([ids.take(of), ties.take(of), pa.array((first - p.w.ptr[row]).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(nodes.view(np.int64)), list_array(values.view(np.int32), sizes, pa.int32())], ["doc_id", "tie", "place", "words", "node", "s"])

    return rows.mapInArrow(run, "doc_id long, tie long, place int, words int, node long, s array<int>")


def _exact_units(rows: DataFrame, run_words: int) -> DataFrame:
    """doc_id, tie, place, words, anchor, class, proof: every sentence and anchor. proof: further bits of the class's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, ties = batch.column(0), batch.column(1)
            for at, data, offsets in slices(batch.column(2)):
                p = Paragraphs(data, offsets)
                sentences = np.repeat(np.arange(len(offsets) - 1), np.diff(p.ptr)), np.array(p.first, np.int64), np.array(p.words, np.int64)
                for anchor, (row, first, words) in enumerate((sentences, p.anchors(run_words))):
                    nodes, proofs = p.nodes(first, words, 9 + anchor)
                    of = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays([ids.take(of), ties.take(of), pa.array((first - p.w.ptr[row]).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(np.full(len(row), anchor == 1)), pa.array(nodes.view(np.int64)), pa.array(proofs.view(np.int32))], ["doc_id", "tie", "place", "words", "anchor", "class", "proof"])

    return rows.mapInArrow(run, "doc_id long, tie long, place int, words int, anchor boolean, class long, proof int")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node, packed) for each band of each paragraph; one that repeats within a batch is taken once.

    packed: the number of shingles in 16 bits, and in 48 the parity of the shingles that fall on each.
    """
    for batch in batches:
        nodes, lists = batch.column(0).to_numpy(), batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        _, once = np.unique(nodes, return_index=True)
        once = once[sizes[once] > 0]
        if not len(once):
            continue
        n = sizes[once]
        values = lists.values.to_numpy().view(np.uint32)[ranges(offsets[once], n)].astype(np.uint64)
        starts = np.cumsum(n) - n
        bits = np.bitwise_xor.reduceat(U(1) << (values % U(48)), starts)
        packed = ((np.minimum(n, 0x7FFF).astype(np.uint64) << U(48)) | bits).view(np.int64)
        for b in range(BANDS):
            key = np.full(len(once), U(b + 1))
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(values, 100 + b * ROWS + r), starts), 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes[once]), pa.array(packed)], ["bucket", "node", "packed"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the parity sketch of each paragraph's shingles."""
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint32).astype(np.uint64)
        out = parity_sketch(values, offsets[:-1] - offsets[0], SKETCH) if len(batch) else np.zeros((0, SKETCH), U)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, i].view(np.int64)) for i in range(SKETCH)]], ["node", *[f"parity{i}" for i in range(SKETCH)]])


def _contexts(kept: DataFrame, far: int) -> DataFrame:
    """class, proof, before, after: the words around anchors, as 32-bit hashes. kept: text and at, their (class, proof, place, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for first, data, offsets in slices(batch.column(0)):
                p = Paragraphs(data, offsets, sentences=False)
                lists = batch.column(1).slice(first, len(offsets) - 1)
                units, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                around = p.contexts(units.field("place").to_numpy().astype(np.int64), row, units.field("words").to_numpy().astype(np.int64), far)
                yield pa.RecordBatch.from_arrays([units.field("class"), units.field("proof"), *around], ["class", "proof", "before", "after"])

    return kept.select("text", "at").mapInArrow(run, "class long, proof int, before binary, after binary")


def _merged(doc: np.ndarray, place: np.ndarray, words: np.ndarray, anchor: np.ndarray, far: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What matters of the marks of several documents, given as numbers from 0 on.

    Marks that can't be part of run_words words, however far they reach, are left out. Of the others the runs that they
    make: first and last word, counted from doc * 2 ** 33, and for each mark its run, or -1. And the anchors that may
    reach out of their run.
    """
    a, wide = doc * _APART + place, np.where(anchor, far, 0)
    b = a + words
    low, high = np.maximum(a - wide, doc * _APART), b + wide
    order = np.argsort(low, kind="stable")
    group = np.empty(len(a), np.int64)
    top = np.maximum.accumulate(high[order])
    group[order] = np.cumsum(np.concatenate(([0], low[order][1:] > top[:-1])))
    start, end = np.full(group.max() + 1, np.iinfo(np.int64).max), np.zeros(group.max() + 1, np.int64)
    np.minimum.at(start, group, low)
    np.maximum.at(end, group, high)
    use = np.flatnonzero((end - start)[group] >= run_words)
    run = np.full(len(a), -1)
    if not len(use):
        return use, use, run, use, use
    use = use[np.argsort(a[use], kind="stable")]
    top = np.maximum.accumulate(b[use])
    new = np.concatenate(([True], a[use][1:] > top[:-1]))
    run[use] = np.cumsum(new) - 1
    first, last = a[use][new], top[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(use) - 1]))]
    reach = use[anchor[use] & ((low[use] < first[run[use]]) | (high[use] > last[run[use]]))]
    return first, last, run, reach, use


def _pieces(far: int, run_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the marks of each text, which come in order of texts: PIECES, runs without a class and anchors with one."""

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, ties = t.column("doc_id").to_numpy(), t.column("tie").to_numpy()
        doc = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]))))
        place, words, anchor = (t.column(c).to_numpy().astype(np.int64) for c in ("place", "words", "anchor"))
        first, last, run, reach, use = _merged(doc, place, words, anchor.astype(bool), far, run_words)
        head = np.searchsorted(doc, first // _APART)
        # the distinct ids of the documents that keep what is in a run
        kept, known = t.column("kept").fill_null(0).to_numpy(), np.asarray(t.column("kept").is_valid())
        use = use[known[use]] if len(use) else use
        order = use[np.lexsort((kept[use], run[use]))]
        once = order[np.concatenate(([True], (kept[order][1:] != kept[order][:-1]) | (run[order][1:] != run[order][:-1])))] if len(order) else order
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(run[once], minlength=len(first))))).astype(np.int32)), pa.array(kept[once]))
        none = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(ties[head]), pa.array(first % _APART), pa.array(last - first // _APART * _APART), lists, *none], _PIECES)
        of = pa.array(reach)
        yield pa.RecordBatch.from_arrays([pa.array(ids[reach]), pa.array(ties[reach]), pa.array(place[reach]), pa.array((place + words)[reach]), pa.nulls(len(reach), pa.list_(pa.int64())), t.column("class").take(of).combine_chunks(), t.column("proof").take(of).combine_chunks()], _PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # with the text that has begun
        for batch in batches:
            if not len(batch):
                continue
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.flatnonzero((ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])) + 1
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(ids[0]), int(ties[0])):
                yield from made(pa.Table.from_batches(held))
                held = []
            if not len(ends):
                held.append(batch)
                continue
            yield from made(pa.Table.from_batches([*held, batch.slice(0, int(ends[-1]))]))
            held = [batch.slice(int(ends[-1]))]
        if held:
            yield from made(pa.Table.from_batches(held))

    return run


_APART = 1 << 33
_PIECES = ["doc_id", "tie", "first", "last", "kept", "class", "proof"]


def _long_runs(ranges_of: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The ranges, in order, put together where they meet, that have at least so many words."""
    out: list[tuple[int, int]] = []
    for a, b in ranges_of:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [x for x in out if x[1] - x[0] >= least]


def substring_dedup(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """docs' columns, with text less its repeated passages, and n_removed, removed_words and same_as.

    docs: doc_id, text, and any other columns, which stay unless named like an added one, which replaces it.
    Sentences are alike if their words are equal but for the case of A-Z, paragraphs also if the exact Jaccard similarity
    of their 5-word shingles is 0.8 or more; classes are the components of that relation. Of each class the first one, by
    doc_id, the text's hash, and place, stays. An anchor that goes takes with it the words before and after it that are
    equal around the one that stays, as far as the next anchor can be. The words of the others are removed where a run of them has at least
    run_words words in all. n_removed and removed_words count sentences, whole or in part, and words taken out, same_as
    lists the ids of documents that keep the passages, in order.

    Null and empty texts stay as they are; a row that repeats another whole row is the same document and gets the same
    result; rows with a null doc_id are compared but not cut; no rows give no rows.
    """
    work = Workspace(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_removed", "removed_words", "same_as")]
    docs = docs.select(*own)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    blocks = work.write(_paragraphs(keyed))
    sets_of = blocks.select("node", "s").where("size(s) > 0")
    parity = [f"parity{i}" for i in range(SKETCH)]
    postings = sets_of.mapInArrow(_bands, "bucket long, node long, packed long")

    met: list[DataFrame] = []  # the sets of all that meet another, which are few beside all sets

    def possible(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        # sets so alike differ in at most (100 - PERCENT) / (100 + PERCENT) of their sizes' sum; each bit that differs
        # is one such shingle at least, and the count of a very long paragraph is only known to be large
        nx, ny = F.shiftrightunsigned(x("packed"), 48), F.shiftrightunsigned(y("packed"), 48)
        differ = F.greatest(F.bit_count(x("packed").bitwiseXOR(y("packed")).bitwiseAND(F.lit((1 << 48) - 1))), apart(x, y, parity))
        return (F.greatest(nx, ny) == 0x7FFF) | ((F.least(nx, ny) * 100 >= F.greatest(nx, ny) * PERCENT) & (differ * (100 + PERCENT) <= (nx + ny) * (100 - PERCENT)))

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = work.write(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        sets = work.write(work.among(met[0], nodes, "node", "left_semi"))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        out = work.write(both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * PERCENT).select("a", "b"))
        work.forget(nodes, sets)
        return out

    def sketches(nodes: DataFrame) -> DataFrame:
        met.append(work.write(work.among(sets_of, nodes, "node", "left_semi").groupBy("node").agg(F.max("s").alias("s"))))
        return met[0].mapInArrow(_sketches, ", ".join(["node long", *(f"{x} long" for x in parity)]))

    found = bucket_components(postings, verify, work, possible, sketches)
    # the shingles, which are as large as the texts, go before the other units are made; these go into one shuffle unwritten
    near = work.write(work.among(blocks.select("doc_id", "tie", "place", "words", "node"), found, "node", "left").select("doc_id", "tie", "place", "words", F.lit(False).alias("anchor"), F.coalesce("component", "node").alias("class"), F.lit(0).alias("proof")))
    work.forget(blocks, found, *met)
    where = F.struct("doc_id", "tie", "place")
    units = _exact_units(keyed, run_words).unionByName(near)
    again = units.withColumn("low", F.min(where).over(Window.partitionBy("class", "proof"))).where(where != F.col("low")).where("doc_id is not null")
    again = work.write(again.select("doc_id", "tie", "place", "words", "anchor", "class", "proof", F.col("low.doc_id").alias("kept"), F.col("low.tie").alias("kept_tie"), F.col("low.place").alias("kept_place")))
    # texts that occur in several rows of one doc_id
    twice = work.write(keyed.groupBy("doc_id", "tie").count().where("count > 1").select("doc_id", "tie"))
    work.forget(near)
    marked = again.drop("kept_tie", "kept_place")
    if work.rows(twice):
        marked = marked.join(work.small(twice), ["doc_id", "tie"], "left_anti").unionByName(marked.join(work.small(twice), ["doc_id", "tie"], "left_semi").distinct())
    far = max(0, run_words - ANCHOR)  # from an end of a repeat of run_words words or more to its next anchor at most
    in_order = marked.repartition("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "place")
    pieces = work.write(in_order.mapInArrow(_pieces(far, run_words), "doc_id long, tie long, first long, last long, kept array<long>, class long, proof int"), anchors=F.count("class"))
    work.forget(twice)
    # the words around the anchors that stay, where one that goes may reach out of its run
    asked = work.write(pieces.where("class is not null").select("class", "proof").distinct())
    of_anchor = again.where("anchor").join(work.small(asked), ["class", "proof"], "left_semi")
    first = of_anchor.groupBy("class", "proof").agg(F.first("kept").alias("_id"), F.first("kept_tie").alias("_tie"), F.first("kept_place").alias("place"), F.first("words").alias("words"))
    stay = first.groupBy("_id", "_tie").agg(F.collect_list(F.struct("class", "proof", "place", "words")).alias("at"))
    stay = work.write(stay)
    holding = keyed if work.rows(stay) <= BROADCAST_ROWS else work.sift(keyed, ["doc_id", "tie"], stay, ["_id", "_tie"])
    kept = holding.join(work.small(stay), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    around = work.write(_contexts(kept, far).groupBy("class", "proof").agg(F.min(F.struct("before", "after")).alias("c")).select("class", "proof", "c.before", "c.after"))
    work.forget(again, asked, stay)
    full = pieces.join(work.small(around, BROADCAST_ROWS // 2), ["class", "proof"], "left")
    marks = work.write(full.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first", "last", "kept", "before", "after")).alias("marks")))
    of_id, of_tie, of_marks = (fresh(docs, x) for x in ("_id", "_tie", "_marks"))
    to = marks.select(F.col("doc_id").alias(of_id), F.col("tie").alias(of_tie), F.col("marks").alias(of_marks))
    of = [F.col("doc_id").cast("long") == F.col(of_id), F.xxhash64("text") == F.col(of_tie)]
    # only texts that are cut, or may be, travel to their marks
    if work.rows(marks) <= BROADCAST_ROWS:
        ids = F.broadcast(to.select(of_id, of_tie))
        cuts, others = docs.join(ids, of, "left_semi"), docs.join(ids, of, "left_anti")
    else:
        cuts, others = (work.sift(docs, [F.col("doc_id").cast("long"), F.xxhash64("text")], marks, ["doc_id", "tie"], how) for how in ("left_semi", "left_anti"))
    work.keep(marks)
    hit = cuts.join(to, of, "left").select(*own, of_marks).unionByName(others.withColumn(of_marks, F.lit(None).cast(to.schema[of_marks].dataType)))
    at = own.index("text")
    added = ["n_removed", "removed_words", "same_as"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            removed, words, same, new = [0] * len(batch), [0] * len(batch), [[]] * len(batch), {}
            marks = batch.column(len(own))
            rows = np.flatnonzero(np.asarray(marks.is_valid()))
            for first, data, offsets in slices(batch.column(at).take(pa.array(rows))):
                p = Paragraphs(data, offsets, sentences=False)
                for r in range(len(offsets) - 1):
                    row, ranges_of, of_kept, short = int(rows[first + r]), [], [], None
                    for m in marks[row].as_py():
                        a, b = m["first"], m["last"]
                        if m["kept"] is not None:
                            of_kept.append((a, b, m["kept"]))
                        else:
                            before, after = (np.frombuffer(m[c], np.uint32) for c in ("before", "after"))
                            if short is None:
                                short = (p.hashes[p.w.ptr[r] : p.w.ptr[r + 1]] >> U(32)).astype(np.uint32)
                            a, b = a - _equal(short[max(0, a - far) : a][::-1], before[::-1]), b + _equal(short[b : b + far], after)
                        ranges_of.append((a, b))
                    drop = _long_runs(sorted(ranges_of), run_words)
                    if drop:
                        removed[row], words[row] = p.touched(r, drop), sum(y - x for x, y in drop)
                        same[row] = sorted({k for a, b, ids in of_kept if any(x <= a and b <= y for x, y in drop) for k in ids})
                        new[row] = p.cut(r, drop).decode()
            texts = batch.column(at)
            if new:
                mask = np.zeros(len(batch), bool)
                mask[list(new)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type))
            columns = [texts if i == at else c for i, c in enumerate(batch.columns[: len(own)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(words, pa.int64()), pa.array(same, pa.list_(pa.int64()))], [*own, *added])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return hit.mapInArrow(cut, f"{names}, n_removed long, removed_words long, same_as array<long>")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, text (without its repeated passages), n_removed, removed_words, same_as."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
