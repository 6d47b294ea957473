"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are pairs of neighbouring words, numbered by occurrence. For each of 64 orders the two smallest of them
are put back into text order and hashed as a pair. Texts agree under an order if they share the minimal k-mers and their
sequence, so the likeness follows edits and moves, not only the set of words.

The orders are those of one hash on a circle from 64 points on: from each point the next two k-mers clockwise. That costs
a 64th of 64 hashes and is defined alike for texts of any length, so any two can be compared. A short text has few k-mers
between the points, so its 64 orders say little more than as many as it has k-mers; one of fewer than SHORT has the orders
of 64 hashes as well, which two such texts are compared by. Both estimate the same likeness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points are 2 ** BIN_BITS; a k-mer's place takes PLACE_BITS, enough for 67 million words in a text.
BIN_BITS, PLACE_BITS = 6, 26
SHORT = 256


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


_PLACE = (1 << PLACE_BITS) - 1


def _ordered(a: Column, b: Column) -> Column:
    """A hash of two numbered k-mers in text order, or of the only one."""
    x, y = F.shiftright(a, PLACE_BITS), F.shiftright(b, PLACE_BITS)
    return F.when(b.isNull(), F.xxhash64(x)).when(a.bitwiseAND(F.lit(_PLACE)) < b.bitwiseAND(F.lit(_PLACE)), F.xxhash64(x, y)).otherwise(F.xxhash64(y, x))


def numbered(text: Column) -> Column:
    """array<long>: a hash of each k-mer and its number of occurrence in the upper bits, its place in the lower, sorted."""
    keep = F.lit(~_PLACE)
    words = F.filter(F.split(text, "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")
    kmers = _bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)).bitwiseAND(keep).bitwiseOR(i.cast("long"))))

    def occurrences(s: Column) -> Column:
        # s is sorted, so equal k-mers stand together in text order
        new = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (F.shiftright(x, PLACE_BITS) != F.shiftright(F.get(s, j - 1), PLACE_BITS)), j)), lambda j: j.isNotNull())
        numbers = _bind(new, lambda st: F.flatten(F.transform(st, lambda a, q: F.sequence(F.lit(0), F.coalesce(F.get(st, q + 1), F.size(s)) - a - 1))))
        return F.zip_with(s, numbers, lambda x, o: F.xxhash64(F.shiftright(x, PLACE_BITS), o).bitwiseAND(keep).bitwiseOR(x.bitwiseAND(F.lit(_PLACE))))

    return F.sort_array(_bind(F.sort_array(kmers), occurrences))


def _ring(s: Column) -> Column:
    """point * 2**32 + hash for each of the 64 points: of the two k-mers at or after it on the circle of hashes.

    s is sorted as signed numbers, which is clockwise from the point of the least of them. Only the first two k-mers of
    each arc between points count: the one after an arc's first is the next of those, whichever arc it is of.
    """
    half = 1 << (BIN_BITS - 1)
    arc = lambda x: F.shiftright(x, 64 - BIN_BITS).cast("int")

    def of(t: Column) -> Column:
        at = lambda j: arc(F.get(t, j))
        opens = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda j: (j == 0) | (at(j) != at(j - 1)))

        def points(o: Column) -> Column:
            # the points since the arc before the one of k-mer j lead to it; those after the last arc with one to the first
            lead = F.flatten(F.transform(o, lambda j, k: F.array_repeat(j, at(j) - F.coalesce(at(F.get(o, k - 1)), F.lit(-half - 1)))))
            return F.concat(lead, F.array_repeat(F.lit(0), half - 1 - at(F.size(t) - 1)))

        def pair(j: Column, b: Column) -> Column:
            after = F.when(F.size(t) > 1, F.get(t, (j + 1) % F.size(t)))
            return F.shiftleft(b.cast("long"), 32).bitwiseOR(F.shiftrightunsigned(_ordered(F.get(t, j), after), 32))

        return _bind(_bind(opens, points), lambda p: F.transform(p, pair))

    return _bind(F.filter(s, lambda x, j: (j < 2) | (arc(x) != arc(F.get(s, j - 2)))), of)


def _hashed(s: Column) -> Column:
    """order * 2**32 + hash for each of the 64 orders."""

    def one(seed: Column) -> Column:
        again = F.transform(s, lambda x: F.xxhash64(F.shiftright(x, PLACE_BITS), seed).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE))))
        two = _bind(again, lambda t: _bind(F.array_min(t), lambda least: F.array(least, F.array_min(F.filter(t, lambda x: x != least)))))
        # the pair's hash is of the k-mers under this order, so that it has their whole hashes
        return F.shiftleft(seed.cast("long"), 32).bitwiseOR(F.shiftrightunsigned(_bind(two, lambda m: _ordered(m[0], m[1])), 32))

    return F.transform(F.sequence(F.lit(0), F.lit((1 << BIN_BITS) - 1)), one)


def signature(text: Column) -> Column:
    """struct<n: k-mers, short: array<long>, ring: array<long>>, null without words; short also from SHORT k-mers on."""

    def both(s: Column) -> Column:
        n = F.size(s)
        return F.struct(n.alias("n"), F.when((n > 0) & (n < SHORT), _hashed(s)).alias("short"), F.when(n > 0, _ring(s)).alias("ring"))

    return _bind(numbered(text), both)


def likeness(a: Column, b: Column) -> Column:
    """The share of the 64 orders under which two signatures agree: of 64 hashes if both are of short texts, or of the circle.

    1 for two empty ones, 0 for an empty one and another.
    """
    share = lambda x, y: F.size(F.array_intersect(x, y)) / float(1 << BIN_BITS)
    short = a["short"].isNotNull() & b["short"].isNotNull()
    return F.when((a["n"] == 0) & (b["n"] == 0), F.lit(1.0)).when(short, share(a["short"], b["short"])).when((a["n"] > 0) & (b["n"] > 0), share(a["ring"], b["ring"])).otherwise(F.lit(0.0))


def as_text(s: Column) -> Column:
    """Both kinds as hex, with a comma between; the empty text for a text without words."""
    part = lambda kind: F.coalesce(F.array_join(F.transform(s[kind], lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), ""), F.lit(""))
    return F.when(s["n"] == 0, F.lit("")).otherwise(F.concat(part("short"), F.lit(","), part("ring")))


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are at most doc_id, in two steps of about the square root of their number; null is below all."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds[step - 1 :: step]]), lambda b: b <= F.col("doc_id")))
    fine = F.size(F.filter(F.slice(table, coarse * step + 1, step), lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(coarse * step + fine)


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id, text, and other columns, which are ignored. The edited text has its last floor(n_chars / 3) code
    points replaced by the first as many, or all, of the next document's, in descending doc_id, after the last the
    first. Rows of one doc_id follow each other by the hash of their text; a null doc_id comes last; a single row is
    its own next. A null text is empty; texts without words have an empty fingerprint, and two such are alike (1.0).
    Texts of any lengths are compared. A text may have 67 million words; of a longer one places repeat, which only changes
    the order of far k-mers. No rows give no rows.

    The order is cut into ranges of ids of about equal size; each range gets a copy of the row after its last one, so
    one exchange of the texts is enough and no task holds more than a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cut = rows.withColumn("bucket", _bucket(sorted(set(found))))
    # at most n rows of numbers
    heads = [(r[0], r[1][0], r[1][1]) for r in cut.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie"))).collect()]
    heads.sort(reverse=True)
    after = ", ".join(f"({heads[i][0]}, {'NULL' if heads[(i + 1) % len(heads)][1] is None else heads[(i + 1) % len(heads)][1]}, {heads[(i + 1) % len(heads)][2]})" for i in range(len(heads)))
    if heads:
        wanted = F.broadcast(spark.sql(f"SELECT CAST(b AS INT) AS bucket, CAST(i AS BIGINT) AS i, CAST(t AS BIGINT) AS t FROM VALUES {after} AS v(b, i, t)"))
        copies = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t"))).select("doc_id", "text", "tie", "bucket").dropDuplicates(["bucket"])
        cut = cut.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    else:
        cut = cut.withColumn("copy", F.lit(False))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("tie"))
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    edited = F.concat(F.substring("text", 1, chars - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    with_next = cut.withColumn("next", F.lead("text").over(order))
    with_edit = with_next.select("doc_id", "tie", "bucket", "copy", "text", F.when(~F.col("copy"), edited).alias("edited"))
    made = with_edit.select("doc_id", "tie", "bucket", "copy", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("text")).alias("own"), F.when(~F.col("copy"), signature(F.col("edited"))).alias("other"))
    out = made.withColumn("following", F.lead("own").over(order)).where(~F.col("copy"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
