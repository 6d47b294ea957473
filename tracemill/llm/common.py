"""Shared parts: tables written to the shared folder, and byte-level word kernels for Arrow batches.

The kernels work on slices of an Arrow string column of about ``CHUNK_BYTES`` bytes, so a worker's memory
does not depend on the length of a partition, only on the longest single text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: So many rows of a few longs, some 4 MB as a hash table, may be broadcast; beyond that a join shuffles both sides. Many
#: such tables live on the driver at once, until it collects its garbage.
BROADCAST_ROWS = 50_000
#: So many rows for each task may be hashed in it; beyond that both sides are sorted.
HASHED_ROWS = 250_000
#: Bits in a row of a sieve, and its rows at most: some 5 MB, however many keys there are.
SIEVE_BITS, SIEVE_ROWS = 1024, 1 << 15
#: While a table is written, Spark deletes a query's shuffle files when it ends, and not when the driver happens to collect
#: garbage; and passes texts to Python in batches of a few MB, so that neither side of a task holds ten thousand of them.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Settings of the C library and of Arrow under which a worker gives memory that it has freed back to the system.
LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "131072", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark: SparkSession) -> None:
    """Python workers of what is planned from now on are started with LEAN: many stages in one application share them.

    The session passes texts to Python in batches as small as WRITING's from now on, since it is the caller who writes a
    stage's result: a batch of ten thousand texts is held several times over, by the executor and its worker.
    """
    spark.sparkContext.environment.update(LEAN)
    for k in (k for k in WRITING if ".arrow." in k):
        if not 0 < int(spark.conf.get(k).removesuffix("b")) <= int(WRITING[k]):
            spark.conf.set(k, WRITING[k])


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v.removesuffix("b"))


class Workspace:
    """Intermediate tables of one run, as Parquet in the shared folder, so that a lost executor costs no recomputation."""

    #: Those made within scratch(), which drops them at its end.
    opened: ContextVar[list[Workspace] | None] = ContextVar("opened", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[tuple[DataFrame, str, dict]] = []
        self.sieves: list[tuple[DataFrame, DataFrame]] = []
        if (opened := self.opened.get()) is not None:
            opened.append(self)

    def write(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """df as a table of its own; its rows are counted, and further metrics taken, as it is written."""
        self.n += 1
        path, seen = f"{self.root}/t{self.n}", Observation()
        with tidy(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path, seen.get))
        return out

    def seen(self, table: DataFrame) -> dict:
        return next(x[2] for x in self.tables if x[0] is table)

    def rows(self, table: DataFrame) -> int:
        return self.seen(table)["rows"]

    def small(self, table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
        """A written table of distinct keys, marked to be broadcast if it has few rows, or hashed if few for each task."""
        rows = self.rows(table)
        if rows <= most:
            return F.broadcast(table)
        return table.hint("shuffle_hash") if rows <= HASHED_ROWS * int(self.spark.conf.get("spark.sql.shuffle.partitions")) else table

    def sift(self, df: DataFrame, columns: list[str | Column], table: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
        """df's rows whose columns may be a written table's keys, or with "left_anti" all others.

        Rows whose columns are keys are always among the first; of the rest one in 32 or fewer while there are no more than
        a million keys, and more beyond (one in eight at four million). It is a broadcast Bloom filter with one hash, so that what a join
        needs few rows of doesn't travel whole.
        """
        rows = min(SIEVE_ROWS, 1 << (32 * self.rows(table) // SIEVE_BITS).bit_length())

        def place(of: list[str | Column]) -> tuple[Column, Column, Column]:
            h = F.xxhash64(*of)
            low = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(SIEVE_BITS - 1))
            return h.bitwiseAND(F.lit(rows - 1)), F.shiftright(low, 6).cast("int"), low.bitwiseAND(F.lit(63)).cast("int")

        found = [x[1] for x in self.sieves if x[0] is table]
        if not found:
            row, word, bit = place([F.col(k) for k in keys])
            one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
            words = table.select(row.alias("row"), word.alias("word"), one.alias("bits")).groupBy("row", "word").agg(F.bit_or("bits").alias("bits"))
            bits = F.array(*[F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")) for k in range(SIEVE_BITS // 64)])
            found = [self.write(words.groupBy("row").agg(bits.alias("bits")).select(F.col("row").alias("_sieve_row"), F.col("bits").alias("_sieve_bits")))]
            self.sieves.append((table, found[0]))
        row, word, bit = place(columns)
        return df.join(F.broadcast(found[0]), (row == F.col("_sieve_row")) & (F.getbit(F.get("_sieve_bits", word), bit) == 1), how)

    def among(self, df: DataFrame, table: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
        """df joined with a written table of distinct keys, inner, left_semi or left; of df only rows that may find a key travel."""
        if self.rows(table) <= most:
            return df.join(F.broadcast(table), key, how)
        found = self.sift(df, [key], table, [key]).join(self.small(table, most), key, how)
        return found.unionByName(self.sift(df, [key], table, [key], "left_anti"), allowMissingColumns=True) if how == "left" else found

    def forget(self, *tables: DataFrame | None) -> None:
        """Deletes written tables that nothing will read again."""
        for df in tables:
            for x in [x for x in self.tables if x[0] is df]:
                self._delete(x[1])
            self.tables = [x for x in self.tables if x[0] is not df]
            gone, self.sieves = [x[1] for x in self.sieves if x[0] is df], [x for x in self.sieves if x[0] is not df]
            self.forget(*gone)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all other tables, except the sieves of these."""
        stay = [*tables, *[s for t, s in self.sieves if any(t is df for df in tables)]]
        self.forget(*[x[0] for x in self.tables if not any(x[0] is df for df in stay)])

    def drop(self) -> None:
        self.tables, self.sieves = [], []
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Drops at its end what operators called within it have left: for callers that write the result inside."""
    mark = Workspace.opened.set([])
    try:
        yield
    finally:
        for work in Workspace.opened.get() or []:
            work.drop()
        Workspace.opened.reset(mark)


def fresh(df: DataFrame, name: str) -> str:
    """A name that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, whatever else there is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


U = np.uint64
_P, _A = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93)
_INV = U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the public splitmix64 finaliser)."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the hash base and of its inverse, as far as they have been needed."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, _P))), dtype=U)
                cls.down = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, _INV))), dtype=U)
        return cls.up, cls.down


def byte_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Fixed sets of separator bytes.
SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """Words of a slice of texts: start and end bytes, 64-bit hashes of the lower-cased bytes, and row r's words at ptr[r]:ptr[r+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data = low = LOWER[data]
        n = len(low)
        inside = table[low]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            full = offsets[:-1] < offsets[1:]
            before[offsets[:-1][full]] = False
            after[offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        self.offsets = offsets

    @property
    def hashes(self) -> np.ndarray:
        up, down = _Powers.get(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, U), np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], dtype=U)))
            return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def shingle(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; one of all of them if there are fewer, none if there are none."""
    k = min(k, len(hashes))
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - k + 1].copy()
        for i in range(1, k):
            out = out * _A + hashes[i : len(hashes) - k + 1 + i]
        return mix(out, k)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same for the others."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


class Runs:
    """Hashes of runs of words, in their order, from the hashes of the words."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _Powers.get(len(hashes) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, U), np.cumsum(hashes * self.up[: len(hashes)], dtype=U)))

    def of(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A hash of the words first[i] to first[i] + count[i]."""
        with np.errstate(over="ignore"):
            return (self.total[first + count] - self.total[first]) * self.down[first] + count.astype(U)


def parity_sketch(values: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """For each set of 64-bit hashes, beginning at starts, words * 64 bits: each the parity of the elements that fall on it.

    Two sketches differ in no more bits than the sets have elements that only one of them has.
    """
    out = np.zeros((len(starts), words), U)
    at = mix(values, 77)
    bit, word = U(1) << (at & U(63)), (at >> U(32)) % U(words)
    for k in range(words):
        out[:, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, U(0)), starts)
    return out


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that what a worker makes of them is small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for consecutive rows of about CHUNK_BYTES; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    buffers, n = texts.buffers(), len(texts)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def list_array(values: np.ndarray, counts: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: row i has the next counts[i] values."""
    offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind) if values.dtype != np.uint64 else pa.array(values.view(np.int64)))
