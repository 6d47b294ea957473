"""The ledger as a property graph of two tables, and walks over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracemill.operators.policy import LADDER
from tracemill.plans import shared


def _node(kind: str, key: str) -> Column:
    return F.xxhash64(F.lit(kind), F.col(key).cast("string"))


def project(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of decisions with outcomes: turns, sessions, rungs, rules and trip-wires.

    ledger: route_id, session_id, rung, layer, fired_rules (array), status, escalated, tripwire_name. A turn without
    fired rules has its layer as rule; only closed outcomes give escalated and tripped edges. A decision is read once and
    gives all its edges; the nodes are those and their ends.
    """
    c = F.col
    closed = F.coalesce(c("status").startswith("closed"), F.lit(False))
    ladder = F.create_map(*[F.lit(x) for pair in LADDER.items() for x in pair])
    up = F.when(closed & F.coalesce("escalated", F.lit(False)), F.try_element_at(ladder, c("rung")))
    rules = F.when(F.size(F.coalesce("fired_rules", F.array())) > 0, c("fired_rules")).otherwise(F.array("layer"))
    end = lambda kind, to, key: F.struct(F.lit(kind).alias("kind"), F.lit(to).alias("to"), key.cast("string").alias("key"))
    one = F.array(end("in_session", "session", c("session_id")), end("routed_to", "rung", c("rung")), end("escalated_to", "rung", up), end("tripped", "tripwire", F.when(closed, c("tripwire_name"))))
    ends = F.filter(F.concat(one, F.transform(rules, lambda r: end("fired", "rule", r))), lambda x: x["key"].isNotNull())
    pairs = ledger.select(c("route_id").cast("string").alias("turn"), ends.alias("ends"))
    both = pairs.select(F.explode(F.concat(F.array(F.struct(F.lit("turn").alias("kind"), c("turn").alias("key"))), F.transform("ends", lambda x: F.struct(x["to"].alias("kind"), x["key"].alias("key"))))).alias("n"))
    nodes = both.select("n.*").where("key IS NOT NULL").distinct().select(F.xxhash64("kind", "key").alias("id"), "kind", "key")
    edges = pairs.select("turn", F.explode("ends").alias("e")).select(_node("turn", "turn").alias("src"), F.xxhash64("e.to", "e.key").alias("dst"), "e.kind").distinct()
    return nodes, edges.select(F.xxhash64("src", "dst", "kind").alias("id"), "src", "dst", "kind")


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with those of new that they lack, rows of new with reasons why they aren't added).

    new: src, dst, kind. An edge between nodes that are both there is added once, whatever its repetitions; a null kind is
    none. Ends are looked up by joins, so that neither side is gathered.
    """
    known = lambda end: nodes.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}"))
    j = new.select("src", "dst", "kind").distinct().join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    j = j.join(edges.select("src", "dst", "kind", F.lit(True).alias("there")), ["src", "dst", "kind"], "left")
    reasons = F.array_compact(F.array(F.when(F.col("has_src").isNull(), "no source"), F.when(F.col("has_dst").isNull(), "no target"), F.when(F.col("kind").isNull(), "no kind"), F.when(F.col("there"), "there already")))
    j = j.withColumn("reasons", reasons)
    added = j.where(F.size("reasons") == 0).select(F.xxhash64("src", "dst", "kind").alias("id"), "src", "dst", "kind")
    return edges.unionByName(added), j.where(F.size("reasons") > 0).select("src", "dst", "kind", "reasons")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """One node per kind and key; the last props that are not null win. new: kind, key, props, seq."""
    old = nodes.select("kind", "key", "props", F.lit(-1).cast("long").alias("seq"))
    return old.unionByName(new.select("kind", "key", "props", F.col("seq").cast("long").alias("seq"))).groupBy("kind", "key").agg(F.max_by("props", F.when(F.col("props").isNotNull(), F.col("seq"))).alias("props"))


def neighbors(nodes: DataFrame, edges: DataFrame, start: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """(start, edge, kind, id) of the edges at each start; "both" lists a loop twice."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    out = e.select(F.col("src").alias("start"), F.col("id").alias("edge"), "kind", F.col("dst").alias("id"))
    into = e.select(F.col("dst").alias("start"), F.col("id").alias("edge"), "kind", F.col("src").alias("id"))
    found = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return found.join(start.select(F.col("id").alias("start")), "start", "left_semi").join(nodes.select("id"), "id", "left_semi")


def k_hop(edges: DataFrame, start: DataFrame, k: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """(start, id, distance): the least number of steps, at most k, from each start; a start is 0 from itself.

    Each round's front is written to one folder, which is also what has been seen: a round reads the edges' table and that
    folder, whatever the depth, and the walk ends when a front is empty.
    """
    spark = edges.sparkSession
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    out, into = e.select(F.col("src").alias("id"), F.col("dst").alias("to")), e.select(F.col("dst").alias("id"), F.col("src").alias("to"))
    root = shared.folder(spark, "walk")
    step = shared.written({"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct(), f"{root}/edges")
    first = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance")).distinct()
    _add_front(first, f"{root}/seen")
    for n in range(1, k + 1):
        seen = spark.read.schema(first.schema).parquet(f"{root}/seen")
        front = seen.where(F.col("distance") == n - 1).join(step, "id").select("start", F.col("to").alias("id")).distinct()
        front = front.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(n))
        if not _add_front(front, f"{root}/seen"):
            break
    return spark.read.schema(first.schema).parquet(f"{root}/seen")


def _add_front(rows: DataFrame, path: str) -> int:
    found = Observation()
    rows.observe(found, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return found.get["n"]


def ancestry(edges: DataFrame, start: DataFrame, max_depth: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """(start, depth, id): the path along each node's first edge by id; ends at a dead end, a cycle or max_depth.

    Rounds are written as those of k_hop(); a path carries its at most max_depth nodes.
    """
    spark = edges.sparkSession
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    root = shared.folder(spark, "walk")
    first = shared.written(e.groupBy(F.col("src").alias("id")).agg(F.min_by("dst", "id").alias("to")), f"{root}/first")
    path = start.select(F.col("id").alias("start"), F.lit(0).alias("depth"), "id", F.array("id").alias("seen"))
    _add_front(path, f"{root}/paths")
    for n in range(1, max_depth + 1):
        at = spark.read.schema(path.schema).parquet(f"{root}/paths").where(F.col("depth") == n - 1)
        on = at.join(first, "id").where(~F.array_contains("seen", F.col("to")))
        if not _add_front(on.select("start", F.lit(n).alias("depth"), F.col("to").alias("id"), F.array_append("seen", F.col("to")).alias("seen")), f"{root}/paths"):
            break
    return spark.read.schema(path.schema).parquet(f"{root}/paths").select("start", "depth", "id")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").count().select(F.lit("node").alias("what"), "kind", F.col("count").alias("n")).unionByName(edges.groupBy("kind").count().select(F.lit("edge").alias("what"), "kind", F.col("count").alias("n")))


def first_k(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")

