"""Quality: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates.

Words are runs of letters, runs of digits and runs of other signs. Before they make n-grams, a word equal to the one
before it becomes <again>, a word in capitals <upper>, and digits <number>: what makes a text repetitive, shouted or
tabular then has the same n-grams whatever its words are. A text is scored as a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import SPACE, U, Words, mix, slices
from tracemill.llm.labelled import fit_in_a_task, fold, sample

#: Labelled rows to fit on, at most; hashed features; passes; and the update's alpha, beta, L1 and L2.
TRAIN_ROWS, BUCKETS, PASSES = 10_000, 1 << 18, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
AGAIN, UPPER, NUMBER = (mix(np.array([i], U), 99)[0] for i in range(3))
_KIND = np.full(256, 3, np.int8)  # 0: space, 1: letter, 2: digit, 3: other sign
_KIND[~SPACE] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2


class Kinds(Words):
    """Runs of bytes of one kind, space left out."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        from tracemill.llm.common import LOWER

        kind = _KIND[data]
        self.data, self.offsets = LOWER[data], offsets
        n = len(data)
        change = np.ones(n + 1, bool)
        if n:
            change[1:n] = kind[1:] != kind[:-1]
            change[offsets] = True
        cuts = np.flatnonzero(change)
        starts, ends = cuts[:-1], cuts[1:]
        keep = kind[starts] != 0 if n else np.zeros(0, bool)
        self.starts, self.ends = starts[keep] if n else cuts[:0], ends[keep] if n else cuts[:0]
        self.kind = kind[self.starts] if n else kind
        small = np.concatenate(([0], np.cumsum((data >= 0x61) & (data < 0x7B))))
        big = np.concatenate(([0], np.cumsum((data >= 0x41) & (data < 0x5B))))
        self.upper = (self.kind == 1) & (big[self.ends] - big[self.starts] >= 2) & (small[self.ends] == small[self.starts])
        self.ptr = np.searchsorted(self.starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, ptr) of each text: 1- and 2-grams, with the root of the count, scaled to length 1."""
    w = Kinds(data, offsets)
    raw = w.hashes
    h = raw.copy()
    letters = np.flatnonzero(w.kind == 1)
    same = letters[1:][(raw[letters[1:]] == raw[letters[:-1]]) & (np.searchsorted(w.ptr, letters[1:], "right") == np.searchsorted(w.ptr, letters[:-1], "right"))]
    h[w.upper] = UPPER
    h[same] = AGAIN
    h[w.kind == 2] = NUMBER
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:], 5) if len(h) > 1 else h[:0]
    one, two = (h >> U(46)).astype(np.int64), (pairs >> U(46)).astype(np.int64)
    out_f, out_v, ptr = [], [], [0]
    for r in range(len(offsets) - 1):
        a, b = w.ptr[r], w.ptr[r + 1]
        f, c = np.unique(np.concatenate((one[a:b], two[a : max(a, b - 1)])), return_counts=True)
        v = np.sqrt(c)
        out_f.append(f)
        out_v.append(v / max(1e-9, np.sqrt((v * v).sum())))
        ptr.append(ptr[-1] + len(f))
    return np.concatenate([np.zeros(0, np.int64), *out_f]), np.concatenate([np.zeros(0), *out_v]), np.array(ptr)


def step(z: np.ndarray, n: np.ndarray, f: np.ndarray, v: np.ndarray, y: int) -> None:
    """One follow-the-regularised-leader update, per coordinate, with a text's features f, their values v and label y."""
    zf, nf = z[f], n[f]
    root = np.sqrt(nf)
    w = np.where(np.abs(zf) > L1, -(zf - np.sign(zf) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
    g = (1 / (1 + np.exp(-max(-30.0, min(30.0, float(w @ v))))) - y) * v
    z[f] = zf + g - (np.sqrt(nf + g * g) - root) / ALPHA * w
    n[f] = nf + g * g


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and offset, which is a feature of all texts. Without rows of both labels the offset says the only label, or 0.5."""
    y = [r[1] for r in rows]
    if len(set(y)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0 if not y else 8.0 * (2 * y[0] - 1)
    docs = []
    for first, data, offsets in slices(pa.array([r[0] for r in rows], pa.string())):
        f, v, ptr = features(data, offsets)
        docs += [(np.append(f[ptr[i] : ptr[i + 1]], BUCKETS), np.append(v[ptr[i] : ptr[i + 1]], 1.0), y[first + i]) for i in range(len(ptr) - 1)]
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    order = np.random.default_rng(5)
    for _ in range(PASSES):
        for i in order.permutation(len(docs)):
            step(z, n, *docs[i])
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w[:BUCKETS].astype(np.float32), float(w[BUCKETS])


def quality(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, most: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """docs' columns and score (0 to 1) and predicted (1 if score >= threshold, else 0).

    docs: doc_id, text, and any other columns, which stay unless named like an added one, which replaces it; only text
    is an input of the score. labels: doc_id, quality; rows to learn from are taken from train_docs, or docs, as
    labelled.sample() says. A null or empty text has no features and scores by the offset alone. Empty labels score 0.5
    throughout. Texts are read whole; repeated rows are scored each; no rows give no rows.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(fit_in_a_task(*sample(train_docs if train_docs is not None else docs, labels, "quality", most), fit))
    base = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    at = base.columns.index("text")
    names = [*base.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = model.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, data, offsets in slices(batch.column(at)):
                f, v, ptr = features(data, offsets)
                # each text's sum is of its own products only, so equal texts have equal scores
                total = np.where(ptr[1:] > ptr[:-1], np.add.reduceat(np.append(weights[f] * v, 0.0), ptr[:-1]), 0.0)
                out.append(1 / (1 + np.exp(-np.clip(total + offset, -30, 30))))
            scores = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names)

    return base.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "score double", "predicted int"]))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
