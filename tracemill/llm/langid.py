"""Language ID by unigrams over pieces of a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each piece. A word's likelihood is the sum, over all ways to cut it into pieces,
of the product of their probabilities, by the forward algorithm over its bytes; a text's is the product over its
words. Single bytes are pieces, so every text has a segmentation. The probabilities are fitted by expectation
maximisation: a forward and a backward pass give each piece's expected count.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.labelled import fold, within_bytes

#: Rows of a language to fit on, at most, and bytes of their texts; rounds; the count added to every piece.
TRAIN_ROWS, TRAIN_BYTES, ROUNDS, ADDED = 1_500, 16 << 20, 3, 0.05
#: Words of so many bytes go through the algorithm many at a time, longer ones one by one, in logarithms.
SHORT = 40
CACHE = 400_000
_WORDS = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # numerals that are no digits stand among them
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def _marked(word: str) -> bytes:
    return b" " + word.encode()


class Pieces:
    """The vocabulary's pieces as sorted 64-bit codes, looked up for all substrings of many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        found = sorted({p.lower() for p in found} | {bytes([b]) for b in range(256)})
        codes = np.array([self.code(p) for p in found], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        if (self.codes[1:] == self.codes[:-1]).any():
            raise ValueError("two pieces have the same code")
        self.n, self.longest = len(found), max(map(len, found))

    @staticmethod
    def code(piece: bytes) -> int:
        out = 0
        for b in piece:
            out = (out * int(_MULT) + b + 1) % (1 << 64)
        return out

    def spans(self, words: list[bytes]) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """Lengths, and for (end, size) the piece of each word that ends there and has that size, or -1."""
        lengths = np.array([len(w) for w in words])
        top = int(lengths.max(initial=0))
        chars = np.zeros((len(words), top), np.uint64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        chars[np.arange(top) < lengths[:, None]] = flat.astype(np.uint64) + np.uint64(1)
        out = {}
        with np.errstate(over="ignore"):
            for start in range(top):
                rows = np.flatnonzero(lengths > start)
                code = np.zeros(len(rows), np.uint64)
                for size in range(1, min(self.longest, top - start) + 1):
                    keep = lengths[rows] >= start + size
                    rows, code = rows[keep], code[keep]
                    code = code * _MULT + chars[rows, start + size - 1]
                    at = np.searchsorted(self.codes, code)
                    at[at == self.n] = 0
                    hit = self.codes[at] == code
                    if hit.any():
                        out[start + size, size] = piece = np.full(len(words), -1)
                        piece[rows[hit]] = at[hit]
        return lengths, out

    def arcs(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, size, piece) of all pieces in one word, in order of their ends."""
        chars = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        code, found = np.zeros(len(chars), np.uint64), []
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, len(chars)) + 1):
                code = code[: len(chars) - size + 1] * _MULT + chars[size - 1 :]
                at = np.searchsorted(self.codes, code)
                at[at == self.n] = 0
                start = np.flatnonzero(self.codes[at] == code)
                found.append((start + size, np.full(len(start), size), at[start]))
        end, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((size, end))
        return end[order], size[order], piece[order]


def long_forward(log_prob: np.ndarray, arcs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """forward() of one word in logarithms: alpha[end, language]."""
    end, size, piece = arcs
    alpha = np.full((n + 1, log_prob.shape[1]), -np.inf)
    alpha[0] = 0
    at = np.searchsorted(end, np.arange(1, n + 2))
    for i in range(1, n + 1):
        s = slice(at[i - 1], at[i])
        alpha[i] = np.logaddexp.reduce(alpha[i - size[s]] + log_prob[piece[s]], axis=0)
    return alpha


def forward(prob: np.ndarray, words: int, spans: dict, top: int) -> np.ndarray:
    """alpha[end, word, language]: the sum over all segmentations of the first ``end`` bytes."""
    alpha = np.zeros((top + 1, words, prob.shape[1]))
    alpha[0] = 1
    for (end, size), piece in sorted(spans.items()):
        rows = np.flatnonzero(piece >= 0)
        alpha[end, rows] += alpha[end - size, rows] * prob[piece[rows]]
    return alpha


def word_scores(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word (rows) in each language."""
    raw = [_marked(w) for w in words]
    out = np.zeros((len(raw), prob.shape[1]))
    short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
    for at in range(0, len(short), 4096):
        some = short[at : at + 4096]
        lengths, spans = pieces.spans([raw[i] for i in some])
        alpha = forward(prob, len(some), spans, int(lengths.max()))
        out[some] = np.log(np.maximum(alpha[lengths, np.arange(len(some))], 1e-300))
    long = [i for i, w in enumerate(raw) if len(w) > SHORT]
    log_prob = np.log(prob) if long else None
    for i in long:
        out[i] = long_forward(log_prob, pieces.arcs(raw[i]), len(raw[i]))[-1]
    return out


def _long_counts(pieces: Pieces, prob: np.ndarray, word: bytes) -> np.ndarray:
    """The expected count of each piece in one word."""
    log_prob, arcs, n = np.log(prob)[:, None], pieces.arcs(word), len(word)
    end, size, piece = arcs
    alpha = long_forward(log_prob, arcs, n)[:, 0]
    # backwards is forwards over the arcs turned round
    order = np.lexsort((size, n - end + size))
    turned = ((n - end + size)[order], size[order], piece[order])
    beta = long_forward(log_prob, turned, n)[::-1, 0]
    return np.bincount(piece, np.exp(alpha[end - size] + log_prob[piece, 0] + beta[end] - alpha[n]), minlength=pieces.n)


def fit(texts: list[str], pieces: Pieces) -> np.ndarray:
    """The probability of each piece in one language."""
    counts = sorted(Counter(w for t in texts for w in words_of(t)).items(), key=lambda x: (-x[1], x[0]))
    prob = np.full(pieces.n, 1 / pieces.n)
    words = [(_marked(w), c) for w, c in counts]
    short, long = [x for x in words if len(x[0]) <= SHORT], [x for x in words if len(x[0]) > SHORT]
    for _ in range(ROUNDS if words else 0):
        expected = np.full(pieces.n, ADDED)
        for word, c in long:
            expected += c * _long_counts(pieces, prob, word)
        for at in range(0, len(short), 4096):
            some = short[at : at + 4096]
            lengths, spans = pieces.spans([p for p, _ in some])
            weight = np.array([c for _, c in some], float)
            alpha = forward(prob[:, None], len(some), spans, int(lengths.max()))[:, :, 0]
            total = alpha[lengths, np.arange(len(some))]
            beta = np.zeros_like(alpha)
            beta[lengths, np.arange(len(some))] = 1
            for (end, size), piece in sorted(spans.items(), reverse=True):
                rows = np.flatnonzero(piece >= 0)
                beta[end - size, rows] += beta[end, rows] * prob[piece[rows]]
            for (end, size), piece in spans.items():
                rows = np.flatnonzero(piece >= 0)
                expected += np.bincount(piece[rows], weight[rows] * alpha[end - size, rows] * prob[piece[rows]] * beta[end, rows] / total[rows], minlength=pieces.n)
        prob = expected / expected.sum()
    return prob


class Scorer:
    def __init__(self, pieces: Pieces, langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces, langs, prob
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text with its share of the likelihood; und and 0 without a letter."""
        words = [words_of(t or "") for t in texts]
        if len(self.known) > CACHE:
            self.known, self.table = {}, self.table[:0]
        new = list({w for x in words for w in x if w not in self.known})
        if new:
            self.known.update((w, len(self.table) + i) for i, w in enumerate(new))
            self.table = np.concatenate((self.table, word_scores(self.pieces, self.prob, new)))
        out, shares = [], []
        for x in words:
            if not x or not self.langs:
                out.append("und")
                shares.append(0.0)
                continue
            total = self.table[list(map(self.known.__getitem__, x))].sum(0)
            p = np.exp(total - total.max())
            best = int(p.argmax())
            out.append(self.langs[best])
            shares.append(float(p[best] / p.sum()))
        return out, shares


def _learned(learn: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(lang, text) of the rows of each language whose ids and texts come first by hash, at most so many and of so many bytes.

    Rows with one id and text are one; a text that is too long for the bytes is left out alone."""
    known = learn.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    known = known.withColumn("key", F.xxhash64("doc_id", "text"))
    # repeated rows count once; the estimate is off by a few hundredths, the share twice as large as need be
    counts = known.groupBy("lang").agg(F.approx_count_distinct("key", 0.03).alias("n"))
    drawn = known.join(F.broadcast(counts), "lang").where(F.shiftrightunsigned("key", 1) < F.lit(float(1 << 63)) * F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("n")))
    once = drawn.groupBy("lang", "doc_id", "key").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text"))
    fit = once.where(F.col("size") <= most_bytes)
    order = Window.partitionBy("lang").orderBy(F.col("size") > most_bytes // 8, "key", "doc_id")
    ranked = fit.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return within_bytes(ranked, "lang", ["key", "doc_id"], most_bytes).select("lang", "text")


def language(docs: DataFrame, path: str, learn: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """docs' columns and lang_pred (string) and score (0 to 1).

    docs: doc_id, text, and any other columns, which stay unless named like an added one, which replaces it; only text
    is an input of the prediction. learn: rows (doc_id, text, lang) to learn from; null languages and texts are
    ignored; of each language the ``most`` distinct rows that come first by a hash are taken, as far as their texts have
    ``most_bytes`` (a text of more is left out alone); each is fitted in a task of its own, and the driver gets one number for each piece and language. A
    null or empty text, or one without a letter, has und and 0, as has every text if there is nothing to learn from.
    Texts are read whole, words of any length; repeated rows are judged each, and learned from once; of equally likely
    languages the first by name is taken; no rows give no rows.
    """
    pieces = Pieces(path)
    shared = docs.sparkSession.sparkContext.broadcast((pieces.codes, pieces.longest))

    def known() -> Pieces:
        out = Pieces.__new__(Pieces)
        out.codes, out.longest = shared.value
        out.n = len(out.codes)
        return out

    def fitted(frame: pa.Table) -> pa.Table:
        prob = fit(frame.column("text").to_pylist(), known())
        return pa.table({"lang": frame.column("lang").slice(0, 1), "prob": pa.array([prob.tobytes()], pa.binary())})

    # one row for each language
    models = sorted((r[0], np.frombuffer(r[1])) for r in _learned(learn, most, most_bytes).groupBy("lang").applyInArrow(fitted, "lang string, prob binary").collect())
    model = docs.sparkSession.sparkContext.broadcast(([x for x, _ in models], np.stack([p for _, p in models], 1) if models else np.zeros((pieces.n, 0))))
    base = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    at = base.columns.index("text")
    names = [*base.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known(), *model.value)
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = batch.slice(first, 200)
                found, shares = scorer.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(shares, pa.float64())], names)

    return base.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "lang_pred string", "score double"]))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = language(docs.select("doc_id", "text"), default_path(), docs.select("doc_id", "text", "lang").where(fold("doc_id", 4) != 2))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
