"""A bounded sample of labelled rows for fitting, and scoring of whole tables with a small model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Bytes of the sample's texts, at most: texts beyond it are left out whole.
SAMPLE_BYTES = 64 << 20


def within_bytes(rows: DataFrame, group: str, order: list[str | Column], most_bytes: int) -> DataFrame:
    """Of each group the rows (with a column size) that come first in the order, of at most so many bytes together.

    A text of more bytes alone is left out by itself. Those of more than an eighth of the bytes come after all others, so
    that a few of them don't crowd out the rest.
    """
    fit = rows.where(F.col("size") <= most_bytes)
    first = Window.partitionBy(group).orderBy(F.col("size") > most_bytes // 8, *order).rowsBetween(Window.unboundedPreceding, 0)
    return fit.withColumn("sum", F.sum("size").over(first)).where(F.col("sum") <= most_bytes).drop("sum")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most`` rows (text, y) of ``most_bytes`` of the folds to learn from, in one partition, and how many rows each label has.

    Learns only where crc32(doc_id as text) mod 5 is not 0. Each label gives up to half of the rows and bytes, those whose
    ids come first by hash, so the sample is the same however the tables are partitioned. A text that is too long for its
    label's bytes is left out alone. Null labels are ignored; an id with both labels counts for both, a repeated label
    once; of the texts of one id the first by hash is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(fold("doc_id", 5) != 0).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # at most ``most`` ids, a proven bound; the texts travel only once their sizes are known
    sizes = texts.select("doc_id", "tie", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id")
    sizes = sizes.groupBy("doc_id", "y").agg(F.min(F.struct("tie", "size")).alias("t")).select("doc_id", "y", "t.*")
    within = within_bytes(sizes, "y", [F.xxhash64("doc_id"), "doc_id"], most_bytes // 2).select("doc_id", "tie", "y")
    picked = texts.join(F.broadcast(within), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie", "y"])
    return picked.repartition(1).sortWithinPartitions("doc_id", "tie", "y").select("text", "y"), counts


def share_shift(counts: dict[int, int], used: list[int]) -> float:
    """The log-odds to add to an offset fitted on used rows of labels 0 and 1, for the share of label 1 in the whole."""
    if not all(used) or not all(counts.get(k) for k in (0, 1)):
        return 0.0
    return math.log(counts[1] / counts[0]) - math.log(used[1] / used[0])


def fit_in_a_task(rows: DataFrame, counts: dict[int, int], fit: Callable[[list[tuple[str, int]]], tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """fit(rows) in one executor's task, which can be run again elsewhere; only the model comes to the driver.

    Its offset is moved to the share of label 1 among all labelled rows, of which counts tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        weights, offset = fit(some)
        offset += share_shift(counts, [sum(1 for _, y in some if y == k) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([offset], pa.float64())], ["weights", "offset"])

    found = rows.mapInArrow(run, "weights binary, offset double").first()
    return (np.frombuffer(found[0], np.float32), found[1]) if found else fit([])
