"""Retrieval: exact cosine neighbours among earlier decisions, their vote, and its evaluation.

A pair is compared only if the neighbour is earlier. The earlier rows are cut into blocks, each block is multiplied
with all targets by an Arrow batch of the matrix product, and only pairs over the floor leave it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.plans import shared

FLOOR, MOST, LEAST, HALF_LIFE_S, THRESHOLD, COLD, GRADUATION = 0.75, 12, 5, 30 * 86400.0, 0.5, 8, 300
#: Rows of a block of vectors, at most, and of the slices in which a block is multiplied.
BLOCK_ROWS, SLICE_ROWS = 20_000, 500


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for vectors of different lengths or of length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def usable(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows whose vector has the projection's dimension and is not all zeros."""
    ok = F.exists("vec", lambda x: x != 0)
    return rows.where(ok if dim is None else ok & (F.size("vec") == dim))


def earlier_pairs(rows: DataFrame, floor: float = FLOOR, most: int | None = None, firewall: bool = False) -> DataFrame:
    """(target, neighbor, sim) with the neighbour strictly earlier than the target and sim at least floor.

    most: only the most similar of each target and block, ties by the neighbour's id; firewall: without pairs of an organic
    target and a neighbour made by a simulator. rows: route_id, vec, ts; with firewall source as well. Targets come in blocks of time; a block meets only blocks that start before its end, as an
    equi-join of block numbers, and each meeting is one matrix product.
    """
    import numpy as np

    n = rows.count()
    blocks = max(1, min(n // 500, max(64, n // BLOCK_ROWS)))
    cuts = sorted(set(rows.agg(F.percentile_approx("ts", [i / blocks for i in range(1, blocks)] or [0.5], 10000)).first()[0] or []))
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("ts")))
    source = F.coalesce("source", F.lit("")) if firewall else F.lit("")
    placed = rows.select("route_id", "vec", "ts", source.alias("source"), number.alias("block"))
    columns = ["block", "other", "route_id", "vec", "ts", "source"]
    left = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))).select(*columns, F.lit(True).alias("target"))
    right = placed.withColumn("other", F.col("block")).withColumn("block", F.explode(F.sequence(F.col("other"), F.lit(len(cuts))))).select(*columns, F.lit(False).alias("target"))

    def product(g: pd.DataFrame) -> pd.DataFrame:
        t, o = g[g.target], g[~g.target]
        if not len(t) or not len(o):
            return pd.DataFrame({"target": [], "neighbor": [], "sim": []})
        x, y = (np.array(v.tolist(), np.float64) for v in (t.vec, o.vec))
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        found = []
        for at in range(0, len(x), SLICE_ROWS):
            sim = x[at : at + SLICE_ROWS] @ y.T
            sim[o.ts.to_numpy()[None, :] >= t.ts.to_numpy()[at : at + SLICE_ROWS, None]] = -2
            if firewall:
                sim[np.ix_((t.source.to_numpy() == "organic")[at : at + SLICE_ROWS], o.source.to_numpy() == "simulator")] = -2
            i, j = np.nonzero(sim >= floor)
            if most is not None:
                order = np.lexsort((o.route_id.to_numpy()[j], -sim[i, j], i))
                i, j = i[order], j[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < most
                i, j = i[kept], j[kept]
            found.append(pd.DataFrame({"target": t.route_id.to_numpy()[i + at], "neighbor": o.route_id.to_numpy()[j], "sim": sim[i, j]}))
        return pd.concat(found)

    return left.unionByName(right).groupBy("block", "other").applyInPandas(product, "target long, neighbor long, sim double")


def nearest_earlier(rows: DataFrame, floor: float = FLOOR, most: int = MOST, firewall: bool = True) -> DataFrame:
    """nearest() of earlier_pairs(), of which at most ``most`` a target and block leave a block's product.

    rows: route_id, vec, ts, source, hard. The floor and the firewall hold inside the product, so a block's best are the
    best of those that count; the blocks' best are few, and the best of them are the target's.
    """
    rows = shared.written(rows.select("route_id", "vec", "ts", "source", "hard"), f"{shared.folder(rows.sparkSession, 'nearest')}/rows")
    return nearest(earlier_pairs(rows, floor, most, firewall), rows, most, firewall)


def nearest(pairs: DataFrame, rows: DataFrame, most: int = MOST, firewall: bool = True) -> DataFrame:
    """The most similar neighbours of each target, after the filter and not before; ties by the neighbour's id.

    firewall: neighbours made by a simulator don't count for organic targets.
    """
    t = rows.select(F.col("route_id").alias("target"), F.col("source").alias("t_source"), F.col("ts").alias("t_ts"), F.col("hard").alias("t_hard"))
    n = rows.select(F.col("route_id").alias("neighbor"), "source", "ts", "hard")
    both = pairs.join(t, "target").join(n, "neighbor")
    if firewall:
        both = both.where("NOT coalesce(t_source = 'organic' AND source = 'simulator', false)")
    w = Window.partitionBy("target").orderBy(F.desc("sim"), "neighbor")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def votes(near: DataFrame, least: int = LEAST, half_life_s: float = HALF_LIFE_S, weigh_age: bool = True) -> DataFrame:
    """One row per target with enough neighbours: hard_fraction, verdict, confidence; now is the target's own time."""
    from tracemill.functions.stats import recency_weight

    w = F.col("sim") * (recency_weight(F.col("ts"), F.col("t_ts"), half_life_s) if weigh_age else F.lit(1.0))
    v = near.withColumn("w", w).groupBy("target").agg(
        F.count("*").alias("neighbors"), F.sum(F.when(F.col("w") > 0, F.col("w"))).alias("total"), F.sum(F.when((F.col("w") > 0) & F.col("hard"), F.col("w"))).alias("for_hard"), F.any_value("t_hard").alias("hard"))
    f = F.when(F.coalesce("total", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("for_hard", F.lit(0.0)) / F.col("total"))
    v = v.where(F.col("neighbors") >= least).withColumn("hard_fraction", f)
    return v.select("target", "neighbors", "hard_fraction", F.when(F.col("hard_fraction") >= THRESHOLD, "frontier").otherwise("local").alias("verdict"), F.least(F.lit(1.0), F.abs(F.col("hard_fraction") - THRESHOLD) / max(THRESHOLD, 1 - THRESHOLD)).alias("confidence"), "hard")


def warm(voted: DataFrame, outcomes: DataFrame, least: int = COLD) -> DataFrame:
    """The votes, or none while fewer than ``least`` outcomes are closed. outcomes: status."""
    closed = outcomes.agg((F.count_if(F.col("status").isin("closed_turn", "closed_final")) >= least).alias("_warm"))  # one row
    return voted.crossJoin(F.broadcast(closed)).where("_warm").drop("_warm")


def graduation(confused: DataFrame, least: int = GRADUATION) -> DataFrame:
    """confusion() with evaluated, missing (decisions still wanted) and sufficient."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return confused.withColumns({"evaluated": n, "missing": F.greatest(F.lit(least) - n, F.lit(0)), "sufficient": n >= least})


def confusion(voted: DataFrame, targets: int) -> DataFrame:
    """Counts, coverage, accuracy and recall of the votes; 0 where there is nothing to divide by."""
    from tracemill.functions.stats import ratio

    said, was = F.col("verdict") == "frontier", F.coalesce("hard", F.lit(False))
    c = voted.agg(F.count_if(said & was).alias("tp"), F.count_if(said & ~was).alias("fp"), F.count_if(~said & ~was).alias("tn"), F.count_if(~said & was).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return c.withColumns({"coverage": ratio(n, F.lit(targets)), "accuracy": ratio(F.col("tp") + F.col("tn"), n), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def decode_blob(rows: DataFrame) -> DataFrame:
    """Rows with vec from blob (little-endian float32) and dim; a blob of another size, or a dim below 1, is dropped.

    An import boundary only: everything inside keeps arrays.
    """
    import numpy as np

    @F.pandas_udf("array<float>")
    def decode(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: np.frombuffer(b, "<f4"))

    good = rows.where((F.col("dim") > 0) & (F.octet_length("blob") == F.col("dim") * 4))
    return good.withColumn("vec", decode("blob")).drop("blob")
