"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A document is expected e times in the mix, 0 to 2: floor(e) whole copies are certain, and one more is drawn with the rest
as its inclusion probability p. Documents are ranked by the odds of a random number over the odds of p, and a source takes
the first of them until its words are those of its target: a sample of fixed size with unequal probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import BROADCAST_ROWS, Workspace
from tracemill.llm.scans import running

#: Weights of documents come in so many steps; ranks in so many ranges, one of which is looked at row by row.
LEVELS, RANGES = 64, 4096
#: Rounds in which a source fills what is left of its target, each with texts of at most a quarter of it.
FILLS = 4
#: So many keys stand for one of a table that is too large to be broadcast.
SALTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_level(size: Column, half: int = 16) -> Column:
    """The weight of a text of so many words, in steps of 1 / LEVELS: half of a long one's at half words.

    Very short texts are the likeliest to be scraps, and repeating them teaches the least.
    """
    return F.greatest(F.lit(1), F.ceil(F.lit(LEVELS) * size / (size + half)).cast("int"))


def targets(work: Workspace, sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """sources (source_key, source_size) with target, in words.

    Sources by code point, null last, have the weights in turn; together they have share of all words, each at most
    most times its own, and what is above that goes to the others by weight, until none is above.
    """
    # "" is null; others begin with "+"
    order = [F.col("source_key") == "", F.col("source_key")]
    named = running(work, sources.withColumn("all_of_them", F.lit("")), "all_of_them", order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    named = work.write(named.select("source_key", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("top")))
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:
        free = F.col("top") > F.col("w") * level
        # two sums and a count come to the driver
        r = named.agg(F.sum(F.when(free, 0.0).otherwise(F.col("top"))), F.sum(F.when(free, F.col("w")).otherwise(0.0)), F.count(F.when(~free, 1))).first()
        if r[2] == capped or not r[1]:
            break
        level, capped = max(level, (total - r[0]) / r[1]), r[2]
    return named.select("source_key", "source_size", F.least("top", F.col("w") * level).alias("target"))


def expected_copies(by_level: DataFrame, most: float) -> DataFrame:
    """by_level (source_key, level, words, target) with e: level * c, at most most, so that a source's words meet its target.

    c is found among the at most LEVELS rows of a source: the highest levels that reach most are as few as will do.
    """
    down = Window.partitionBy("source_key").orderBy(F.col("level").desc())
    all_rows = Window.partitionBy("source_key")
    full_before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("level") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = by_level.withColumn("c", F.when(below > 0, (F.col("target") - most * full_before) / below))
    # the first level, from above, that stays at or below most; none: all are at most
    c = F.max_by(F.when(F.col("c") * F.col("level") <= most, F.col("c")), F.when(F.col("c") * F.col("level") <= most, F.col("level"))).over(all_rows)
    e = F.coalesce(F.least(F.lit(most), c * F.col("level")), F.lit(most))
    return rows.withColumn("e", F.greatest(F.lit(0.0), e)).drop("c")


def looked_up(work: Workspace, rows: DataFrame, table: DataFrame, keys: list[str], columns: list[str], salt: str = "mark") -> DataFrame:
    """rows with those columns of a written table of distinct keys: broadcast if it is small, or else joined on the keys and a
    salt made of a column of rows, so that no key is one task's."""
    small, table = work.rows(table) <= BROADCAST_ROWS, table.select(*keys, *columns)
    if small:
        return rows.join(F.broadcast(table), keys, "left")
    salted = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.col(salt), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt_"], "left").drop("salt_")


def odds(p: Column) -> Column:
    return p / (1 - p)


def drawn_in(fills: Column, size: Column, q: Column) -> Column:
    """How many of m equal items of this size and rank the fills take."""
    left = lambda f, got: F.col("m") - got
    takes = lambda f, got: F.when((size <= f["largest"]) & (q < f["cut"]), left(f, got)).when((size <= f["largest"]) & (q == f["cut"]), F.least(left(f, got), f["at_cut"])).otherwise(F.lit(0).cast("long"))
    return F.aggregate(fills, F.lit(0).cast("long"), lambda got, f: got + takes(f, got))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, level: Column | None = None, seed: int = 0) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken: how often the mix has it, and its words there.

    docs: doc_id, source, text, and other columns, of which those of the five names are replaced. size is the text's words
    (null: none). level is a weight of 1 to LEVELS from the columns of docs and size (null: of its size), by which a
    source's documents are expected in the mix; they have the weights of expected_copies(), at most most each. The last
    document in a source's order that would go beyond its target is passed over, and texts of at most a quarter of what is
    left are taken in the same order, FILLS rounds in all; the last one is taken if that is nearer to the target. Ranks come from a hash of doc_id, text and seed, so the result doesn't depend on partitioning.

    Null is a source of its own, the last; null and empty texts have size 0 and are taken as often as their weight says,
    with no words; equal rows are drawn one by one, in no order; no rows give no rows. Texts are read twice and not
    shuffled, but for equal rows of which only some are taken.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.withColumn("size", n_words(text))
    lv = length_level(F.col("size")) if level is None else F.greatest(F.lit(1), F.least(F.lit(LEVELS), level.cast("int")))
    mark = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), text)
    of_row = {"source_key": F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")), "level": lv, "mark": mark}
    # the caller's columns have names of ours on the way
    names = [f"c{i}_" for i in range(len(docs.columns))]
    sized = sized.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], *[c.alias(k) for k, c in of_row.items()], "size")
    keyed = sized.select(*of_row, "size")
    # equal rows are one item; the sums are made before anything is shuffled
    items = work.write(keyed.groupBy("source_key", "level", "mark", "size").agg(F.count("*").alias("m")))
    levels = work.write(items.groupBy("source_key", "level").agg(F.sum(F.col("size") * F.col("m")).alias("words")))
    wanted = work.write(targets(work, levels.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, share, most))
    copies = expected_copies(levels.join(wanted, "source_key"), most)
    whole = F.least(F.floor("e"), F.floor(F.lit(most))).cast("long")
    copies = work.write(copies.select("source_key", "level", "words", "source_size", "target", whole.alias("whole"), (F.col("e") - whole).alias("p")))
    need = copies.groupBy("source_key").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("need"))
    plan = ["source_size", "target", "whole", "p"]

    u = (F.shiftrightunsigned("mark", 11).cast("double") + 0.5) / float(1 << 53)
    rank = F.when(F.col("p") > 0, odds(u) / odds(F.least("p", F.lit(1 - 1e-12))))
    ranked = work.write(looked_up(work, items, copies, ["source_key", "level"], plan).where("p > 0 AND size > 0").select("source_key", "size", "mark", "m", rank.alias("q")))
    none = "array<struct<largest:double,cut:double,at_cut:long>>"
    fills = work.write(need.select("source_key", "need", F.array().cast(none).alias("fills")))
    for i in range(FILLS):
        new = work.write(_fill(work, ranked, fills, i == FILLS - 1, quarter=4 if i else 0))
        work.forget(fills)
        fills = new
    work.forget(items, levels, ranked)

    rows = sized.withColumn("m", F.lit(1).cast("long"))
    rows = looked_up(work, rows, copies, ["source_key", "level"], plan)
    rows = looked_up(work, rows, fills, ["source_key"], ["fills"]).withColumn("q", rank)
    fits = (F.col("p") > 0) & (F.col("size") > 0)
    got = F.when(fits, drawn_in(F.coalesce("fills", F.array().cast(none)), F.col("size"), F.col("q"))).otherwise(0)
    # ranks at which a fill ends: items of which perhaps only some rows are taken
    at_end = F.coalesce(F.exists("fills", lambda f: f["cut"] == F.col("q")) & fits, F.lit(False))
    rows = rows.withColumn("at_end", at_end)
    out = [*names, "size", "source_size", "target", "whole"]
    clear = rows.where(~F.col("at_end")).select(*out, got.alias("extra"))
    # such items have all columns of the first of their rows; few texts, so their columns are taken apart
    same = rows.where("at_end").groupBy("source_key", "mark", F.col("size").alias("size_"), "q").agg(*[F.first(c).alias(c) for c in out], F.count("*").alias("n_"), F.first("fills").alias("fills"))
    # a large count is laid out in two steps, so that no array is long
    step = 4096
    laid = same.withColumnRenamed("n_", "m").select(*out, "m", drawn_in(F.col("fills"), F.col("size_"), F.col("q")).alias("got"))
    laid = laid.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / step))))
    each = F.explode(F.sequence(F.col("block") * step, F.least(F.col("m"), (F.col("block") + 1) * step) - 1))
    laid = laid.withColumn("i", each).select(*out, F.when(F.col("i") < F.col("got"), 1).otherwise(0).cast("long").alias("extra"))
    mixed = clear.unionByName(laid).withColumn("copies", F.col("whole") + F.col("extra"))
    return mixed.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _fill(work: Workspace, ranked: DataFrame, fills: DataFrame, last: bool, quarter: int) -> DataFrame:
    """fills with one more (largest, cut, at_cut): the items of at most largest words and of ranks below cut, and at_cut of
    those at it, all that are not taken yet; need becomes what they leave. Only the last round may go above need."""
    rows = looked_up(work, ranked, fills, ["source_key"], ["need", "fills"])
    rows = rows.withColumn("left", F.col("m") - drawn_in(F.col("fills"), F.col("size"), F.col("q")))
    largest = F.col("need") / quarter if quarter and not last else F.col("need") * 2 if last else F.lit(float("inf"))
    rows = rows.withColumn("largest", largest).where("left > 0 AND need > 0 AND size <= largest")
    rows = rows.withColumn("range", F.floor(F.col("q") / (1 + F.col("q")) * RANGES).cast("int"))
    # at most RANGES rows a source
    sums = rows.groupBy("source_key", "range", "need").agg(F.sum(F.col("size") * F.col("left")).alias("words"))
    up = Window.partitionBy("source_key").orderBy("range")
    sums = sums.withColumn("start", F.sum("words").over(up) - F.col("words"))
    crossed = sums.where("start <= need AND start + words > need").select("source_key", "range", "start")
    crossed = work.write(crossed)
    inside = looked_up(work, rows, crossed, ["source_key", "range"], ["start"]).where("start IS NOT NULL")
    order = Window.partitionBy("source_key").orderBy("q", "mark", "size")
    inside = inside.withColumn("start", F.col("start") + F.sum(F.col("size") * F.col("left")).over(order) - F.col("size") * F.col("left"))
    over = F.least(F.col("left").cast("double"), (F.round if last else F.floor)((F.col("need") - F.col("start")) / F.col("size"))).cast("long")
    ends = inside.where("start <= need AND start + size * left > need")
    ends = ends.groupBy("source_key").agg(F.min(F.struct("q", over.alias("k"), "start", "size", "largest")).alias("e"))
    # sources that are not crossed take all that fits
    all_of = sums.groupBy("source_key").agg(F.sum("words").alias("all_words"))
    both = fills.join(ends, "source_key", "left").join(all_of, "source_key", "left").withColumn("all_words", F.when(F.col("e").isNull(), F.coalesce("all_words", F.lit(0))))
    cap = F.coalesce(F.col("e")["largest"], largest)
    one = F.struct(cap.cast("double").alias("largest"), F.coalesce(F.col("e")["q"], F.lit(float("inf"))).alias("cut"), F.coalesce(F.col("e")["k"], F.lit(0)).cast("long").alias("at_cut"))
    took = F.coalesce(F.col("all_words"), F.col("e")["start"] + F.col("e")["k"] * F.col("e")["size"])
    return both.select("source_key", (F.col("need") - took).alias("need"), F.when(F.col("need") > 0, F.array_append("fills", one)).otherwise(F.col("fills")).alias("fills"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, size, source_size, target, taken."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), [3, 1, 2])
    return out.select("doc_id", "size", "source_size", "target", "taken")
