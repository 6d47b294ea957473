"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of itself, a text the average of its distinct words;
misspelt words share most n-grams with the words they come from. The softmax is linear, so once the model is fitted a
word adds one number to a text's score, which workers remember.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import parts
from tracemill.llm.labelled import fit_in_a_task, fold, sample

#: Labelled rows to fit on, at most, half of either label where there are as many; hashed subwords; embedding width;
#: sizes of character n-grams; steps of the fit.
TRAIN_ROWS, BUCKETS, WIDTH, GRAMS, STEPS = 8_000, 1 << 17, 3, (3, 4, 5), 60
#: Step size; decay of the softmax; the scale of a text's mean, and the power of its number of words that divides the
#: sum: less than 1, or a few words of abuse drown in a long text.
RATE, DECAY, SCALE, POWER = 0.1, 1e-4, 6.0, 0.5
#: A subword counts as known if it stands in so many of the texts that are learned from.
LEAST_TEXTS = 4
#: Longer runs of letters and digits are words of so many, each of which has the last characters of the one before it.
LONGEST, OVERLAP = 64, 16
CACHE = 200_000
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> set[str]:
    out = set()
    for w in _WORDS.findall(text.lower()):
        if len(w) <= LONGEST:
            out.add(w)
        else:
            out.update(w[i : i + LONGEST] for i in range(0, len(w) - OVERLAP, LONGEST - OVERLAP))
    return out


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    marked = f"<{word}>"
    out = {crc32(marked.encode()) % buckets}
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            out.add(crc32(marked[i : i + n].encode()) % buckets)
    return sorted(out)


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and the word and the text of each occurrence."""
    number: dict[str, int] = {}
    words, sizes = [], []
    for t in texts:
        own = words_of(t)
        words.append(np.fromiter((number.setdefault(w, len(number)) for w in sorted(own)), np.int32, len(own)))
        sizes.append(len(own))
    return list(number), np.concatenate(words), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def _spread(index: np.ndarray, row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of values[row] by index, in blocks, so that no temporary array is long."""
    out = np.zeros((n, values.shape[1]))
    for at in range(0, len(index), 1 << 20):
        i, v = index[at : at + (1 << 20)], values[row[at : at + (1 << 20)]]
        for j in range(values.shape[1]):
            out[:, j] += np.bincount(i, v[:, j], minlength=n)
    return out


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """The score of each subword (NaN: not known) and the offset: the product of the fitted embeddings and softmax.

    Trained jointly with Adam on all rows at each step. Without rows of both labels the score is the share of label 1,
    or 0 without rows.
    """
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return np.full(BUCKETS, np.nan, np.float32), 8.0 if len(y) and y.min() else -8.0
    words, dw, dr = _numbered([t for t, _ in rows])
    in_texts = np.bincount(dw, minlength=len(words))
    flat, sizes = array("i"), array("i")
    for w in words:
        own = subwords(w)
        flat.extend(own)
        sizes.append(len(own))
    gw, gr = np.frombuffer(flat, np.int32), np.repeat(np.arange(len(words), dtype=np.int32), np.frombuffer(sizes, np.int32))
    reach = np.zeros(BUCKETS)
    for at in range(0, len(gw), 1 << 20):
        reach += np.bincount(gw[at : at + (1 << 20)], in_texts[gr[at : at + (1 << 20)]], minlength=BUCKETS)
    known = reach >= LEAST_TEXTS
    gw, gr = gw[known[gw]], gr[known[gw]]
    del flat
    per_doc, per_word = 1 / np.maximum(1, np.bincount(dr, minlength=len(rows))) ** POWER, 1 / np.maximum(1, np.bincount(gr, minlength=len(words)))
    rng = np.random.default_rng(7)
    params = [rng.normal(0, 0.01, (BUCKETS, WIDTH)), rng.normal(0, 1.0, (WIDTH, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    onehot = np.stack([1 - y, y], 1)

    for step in range(1, STEPS + 1):
        e, w, b = params
        word = _spread(gr, gw, e, len(words)) * per_word[:, None]
        doc = _spread(dr, dw, word, len(rows)) * (SCALE * per_doc[:, None])
        z = doc @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - onehot) / len(rows)
        g_doc = (dz @ w.T) * (SCALE * per_doc[:, None])
        g_word = _spread(dw, dr, g_doc, len(words)) * per_word[:, None]
        grads = [_spread(gw, gr, g_word, BUCKETS), doc.T @ dz + DECAY * w, dz.sum(0)]
        for x, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    e, w, b = params
    return np.where(known, SCALE * (e @ (w[:, 1] - w[:, 0])), np.nan).astype(np.float32), float(b[1] - b[0])


class Scorer:
    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset, self.known = weights, offset, {}

    def word(self, w: str) -> float:
        found = self.known.get(w)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            parts = [x for x in self.weights[subwords(w)].tolist() if x == x]
            found = self.known[w] = sum(parts) / max(1, len(parts))
        return found

    def score(self, text: str | None) -> float:
        words = words_of(text or "")
        z = self.offset + sum(map(self.word, words)) / max(1, len(words)) ** POWER
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """docs' columns and score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    docs: doc_id, text, and any other columns, which stay unless named like an added one, which replaces it; only text
    is an input of the score. labels: doc_id, toxic; rows to learn from are taken from train_docs, or docs, as
    labelled.sample() says. A null or empty text has the score of no words, the model's offset. Empty labels score 0
    (nearly) throughout. Texts are read whole; repeated rows are scored each; no rows give no rows.
    """
    sc = docs.sparkSession.sparkContext
    rows, counts = sample(train_docs if train_docs is not None else docs, labels, "toxic", most)
    model = sc.broadcast(fit_in_a_task(rows, counts, fit))
    base = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    at = base.columns.index("text")
    names = [*base.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for part in parts(batches, 500):
            scores = [float(scorer.score(t)) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names)

    return base.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "score double", "predicted int"]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
