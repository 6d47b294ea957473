"""Connected components, and components of a similarity graph given by buckets of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import BROADCAST_ROWS, Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component): for every node of an edge (a, b) the smallest node that it can reach.

    Alternating large-star and small-star rounds; each contracts towards the smallest neighbour, needs only
    aggregates and equi-joins, and ends after a number of rounds logarithmic in the longest path.
    Null ends are ignored; loops and repeated edges do no harm; no edges give no rows.
    """

    def put(e: DataFrame) -> tuple[DataFrame, dict]:
        out = work.write(e.distinct(), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        return out, work.seen(out)

    parts: list[DataFrame] = []

    def solid(df: DataFrame) -> DataFrame:
        """Of many edges a table of its own: a node with very many neighbours can then be split among tasks."""
        if state["rows"] <= BROADCAST_ROWS:
            return df
        parts.append(work.write(df))
        return parts[-1]

    e, state = put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b"))
    while state["rows"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = solid(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = solid(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = solid(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, last = state, e
        e, state = put(small)
        work.forget(last, *parts)
        parts.clear()
        if before == state:
            break
    out = work.write(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    work.forget(e)
    return out


#: Rounds, at most, in which a node is compared with leaders of its buckets. They end when comparing all that is left in
#: full takes no more than so many pairs for each member of a bucket.
ROUNDS, FEW = 4, 1


def pack(n: Column, pos: Column) -> Column:
    """A member's size and the place of the bucket's token in it, as one long."""
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(pos.cast("long"))


def size_of(packed: Column) -> Column:
    return F.shiftright(packed, 32)


def place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF))


def apart(x: Callable[[str], Column], y: Callable[[str], Column], names: list[str]) -> Column:
    """A lower bound of the size of two sets' symmetric difference, from their parity sketches."""
    total = F.lit(0)
    for k in names:
        total = total + F.bit_count(x(k).bitwiseXOR(y(k)))
    return total


def bucket_components(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], work: Workspace, possible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], of_nodes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of the graph that has an edge where two nodes share a bucket and verify() keeps the pair.

    postings: (bucket, node, packed), all longs; a row may occur often. of_nodes: written DataFrame (node) -> (node, ...),
    one row for each. possible(x, y): a condition on two members that is false only where the pair can't be verified; x
    and y give a member's packed, or a column of of_nodes(), by its name. verify: written DataFrame (a, b) -> the verified
    pairs of it, written too.

    First come rounds that compare each node with its buckets' leaders outside its own component; a bucket's leader is a
    node of the bucket's largest component, another one each time. In the first round only the smallest leader counts. So
    a round has at most a pair for each member, whatever the size of the buckets, and what it links needs no more
    comparing. Then, in the buckets that still hold more than one component, the members outside the largest one are
    compared with all of the other components. So every pair of a bucket is either verified or already connected, and a
    large group of copies costs no more than its size. Returns (node, component) for the nodes with an edge, as a written
    table.
    """
    several = work.write(postings.groupBy("bucket").agg(F.min("node").alias("top"), F.max("node").alias("high")).where("top <> high").select("bucket", "top"))
    members = work.write(work.among(postings, several, "bucket").groupBy("bucket", "node").agg(F.min("packed").alias("packed"), F.min("top").alias("top")))
    nodes = work.write(members.select("node").distinct())
    known = work.write(of_nodes(nodes))
    about = ["packed", *[c for c in known.columns if c != "node"]]
    mixed = work.write(members.join(work.small(known, BROADCAST_ROWS // 3), "node").withColumn("c", F.col("node")))
    work.forget(several, members, nodes)
    tried = found = None
    tables: list[DataFrame] = [known]
    for i in range(ROUNDS):
        # a bucket's leader and its packed value go by bucket, what else is known of it by node: both tables stay narrow
        leader = F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "packed")).alias("l")
        of_lead = work.write(mixed.where("c = top").groupBy("bucket").agg(leader).select("bucket", F.col("l.node").alias("lead"), F.col("l.packed").alias("lead_packed")))
        pairs = mixed.where("c <> top").join(work.small(of_lead), "bucket")
        renamed = known.select(F.col("node").alias("lead"), *[F.col(k).alias(f"lead_{k}") for k in about[1:]])
        pairs = pairs.join(F.broadcast(renamed) if work.rows(known) <= BROADCAST_ROWS // 3 else renamed, "lead")
        pairs = pairs.where(possible(F.col, lambda k: F.col(f"lead_{k}"))).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"), "node")
        if not i:
            pairs = pairs.groupBy("node").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        pairs = pairs.select("a", "b").distinct()
        pairs = work.write(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tables.append(pairs)
        work.forget(of_lead)
        if not work.rows(pairs):
            break
        linked = verify(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        before = found
        found = connected_components(_with(found, linked), work)
        work.forget(linked, before)
        labelled = mixed.drop("c", "top").join(work.small(found), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        sizes = labelled.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", (-F.col("c")).alias("m"))).alias("t"), F.sum("k").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        out = F.col("n") - F.col("t.k")
        tops = work.write(sizes.select("bucket", (-F.col("t.m")).alias("top"), (out * F.col("t.k") + out * (out - 1) / 2).alias("pairs")), pairs=F.sum("pairs"))
        last, mixed = mixed, work.write(labelled.join(work.small(tops).drop("pairs"), "bucket"))
        left = work.seen(tops)["pairs"] or 0
        work.forget(last, tops)
        if left <= FEW * work.rows(mixed):
            break
    outside = mixed.where("c <> top").select("bucket", F.col("node").alias("other"), F.col("c").alias("d"), *[F.col(k).alias(f"of_{k}") for k in about])
    rest = outside.join(mixed, "bucket").where("c <> d").where(possible(F.col, lambda k: F.col(f"of_{k}"))).where("c = top or node > other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    rest = work.write(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"))
    work.forget(mixed, *tables)
    if found is not None and not work.rows(rest):
        work.forget(rest)
        return found
    linked = verify(rest)
    out = connected_components(_with(found, linked), work)
    work.forget(rest, linked, found)
    return out


def _with(found: DataFrame | None, linked: DataFrame) -> DataFrame:
    return linked if found is None else found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked)
