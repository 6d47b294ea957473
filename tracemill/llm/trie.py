"""The trie of conversations' prefixes, as chains of nodes that each belong to one conversation.

A node is a distinct sequence of first turns; it belongs to the smallest conversation that starts with it. If a prefix is a
conversation's own, all its longer ones are, so a conversation owns a chain of depths from some first one on, which a binary
search finds by joins with the minima of prefix digests. The chain hangs from a node of another conversation's chain, and
what subtrees add up to is summed over the tree of chains from below, by doubling, then along each chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import Workspace
from tracemill.llm.scans import running
from tracemill.llm.sql import crc32

#: Depths of a conversation that one row of the search holds; conversation ids that are joined into one piece of a list.
SPAN, PIECE = 256, 1024


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, chars): digest is of role and text, null ones empty; a null conv_id is left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.select("conv_id", "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("long").alias("chars"))


def numbered(work: Workspace, turns: DataFrame) -> DataFrame:
    """turns_of rows as (conv_id, nth, digest, chars), by turn (null first), then role and digest."""
    return running(work, turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]).select("conv_id", "nth", "digest", "chars")


def shared_heads(work: Workspace, turns: DataFrame) -> DataFrame:
    """Conversations that begin as another: numbered rows of each conv_id c from the first h turns of c - c % 100 and c's
    own after its first h, h = crc32(c) % 6; by (own, at), own 0 for the former and 1 for the latter."""
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    turns = work.write(turns)
    convs = turns.groupBy("conv_id").agg(h.alias("h")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    # at most 5 rows a base, each for at most 199 conversations
    heads = turns.where("nth <= 5 AND conv_id % 100 = 0").withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("nth <= h").select("conv_id", F.lit(0).alias("own"), F.col("nth").alias("at"), "digest", "chars")
    return heads.unionByName(turns.where(F.col("nth") > h).select("conv_id", F.lit(1).alias("own"), F.col("nth").alias("at"), "digest", "chars"))


def prefixes(work: Workspace, turns: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, depth, x, y, chars) of turns in the order of those columns; x and y are 128 bits of the first depth turns.

    Each is the exclusive or of 64-bit hashes of (place, turn digest), which can be taken in any order and in parts.
    """
    rows = running(work, turns, "conv_id", [F.col(c) for c in order])
    lane = lambda seed: F.xxhash64(F.lit(seed), F.col("nth"), F.col("digest"))
    rows = running(work, rows.drop(*order).withColumn("depth", F.col("nth")).withColumns({"x": lane(1), "y": lane(2)}).drop("nth"), "conv_id", [F.col("depth")], xors=("x", "y"))
    return rows.select("conv_id", "depth", F.col("run_x").alias("x"), F.col("run_y").alias("y"), "chars")


def first_owned(work: Workspace, prefix: DataFrame, shared: DataFrame) -> DataFrame:
    """(conv_id, depth, px, py): each conversation's first own depth, if any, and the digest of the prefix before it.

    shared: (depth, x, y, owner) of nodes that several conversations have; others are their conversation's own. A row is
    SPAN depths of a conversation, so rows are bounded and a span takes at most log2(SPAN) + 1 rounds.
    """
    at = F.struct("depth", "x", "y")
    spans = prefix.groupBy("conv_id", F.floor((F.col("depth") - 1) / SPAN).alias("span")).agg(F.array_sort(F.collect_list(at)).alias("at"))
    # among at[lo .. hi - 1] the first own one; hi: none so far
    open_, done = work.write(spans.withColumns({"lo": F.lit(0), "hi": F.size("at")})), None
    found = "conv_id long, at array<struct<depth:long,x:long,y:long>>, lo int"
    while work.rows(open_):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        asked = open_.withColumn("mid", mid).withColumn("a", F.get("at", F.col("mid"))).select("*", "a.*")
        answered = asked.join(work.small(shared), ["depth", "x", "y"], "left")
        own = F.coalesce(F.col("owner"), F.col("conv_id")) == F.col("conv_id")
        moved = answered.withColumns({"hi": F.when(own, F.col("mid")).otherwise(F.col("hi")), "lo": F.when(own, F.col("lo")).otherwise(F.col("mid") + 1)})
        moved = work.write(moved.select("conv_id", "span", "at", "lo", "hi"))
        work.forget(open_)
        ended = moved.where("lo = hi AND lo < size(at)").select("conv_id", "at", "lo")
        done = ended if done is None else done.unionByName(ended)
        open_ = work.write(moved.where("lo < hi"))
    spark = prefix.sparkSession
    done = done if done is not None else spark.range(0).select(F.from_json(F.lit("{}"), found).alias("r")).select("r.*")
    # a span's earliest one; of a conversation's spans the earliest
    firsts = done.groupBy("conv_id").agg(F.min(F.get("at", F.col("lo"))["depth"]).alias("depth"))
    before = prefix.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"))
    return firsts.join(before, ["conv_id", "depth"], "left").select("conv_id", "depth", F.coalesce("px", F.lit(0)).alias("px"), F.coalesce("py", F.lit(0)).alias("py"))


def from_below(work: Workspace, chains: DataFrame) -> DataFrame:
    """chains (conv_id, up, leaves, saved) with the sums of leaves and saved over each chain and all that hang from it.

    Each round sends what is summed so far twice as far up: chains at a distance of 1, 2, 4, ... In the last round none
    has a chain so far above it.
    """
    state = work.write(chains)
    while True:
        sent = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sent = work.write(sent)
        if not work.rows(sent):
            return state
        # where a chain that is sent to will send, known for each that is sent to
        further = work.write(sent.select("conv_id").join(state.select("conv_id", F.col("up").alias("next")), "conv_id").select(F.col("conv_id").alias("up"), "next"))
        added = state.join(work.small(sent), "conv_id", "left").join(work.small(further), "up", "left")
        new = work.write(added.select("conv_id", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]))
        work.forget(state, sent, further)
        state = new


def joined_ids(work: Workspace, ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of ends (conv_id, depth, x, y): the digest of their ids, ascending, joined by commas.

    Ids are joined by PIECE in tasks of their own; a list of one piece is hashed there. The pieces of longer ones follow
    each other through one hash, so a task holds a piece, and the list of a hot node is PIECE times fewer rows.
    """
    key = F.concat_ws(" ", "depth", "x", "y")
    rows = running(work, ends.withColumn("key", key), "key", [F.col("conv_id")])
    pieces = rows.groupBy("key", "depth", "x", "y", F.floor((F.col("nth") - 1) / PIECE).alias("piece")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids"))
    pieces = work.write(pieces)
    long_ones = work.write(pieces.where("piece = 1").select("key"))
    short = pieces.join(work.small(long_ones), "key", "left_anti").select("depth", "x", "y", F.sha2("ids", 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["depth"], row["x"], row["y"])
                if at != last:
                    if state:
                        yield one(last, state)
                    last, state = at, hashlib.sha256(row["ids"].encode())
                else:
                    state.update(b"," + row["ids"].encode())
        if state:
            yield one(last, state)

    def one(at: tuple, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": at[0], "x": at[1], "y": at[2], "ends_sha256": state.hexdigest()}])

    rest = pieces.join(work.small(long_ones), "key", "left_semi").select("depth", "x", "y", "piece", "ids")
    # 1 kB rows: a node's list comes in order, batch by batch
    rest = rest.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "piece")
    return short.unionByName(rest.mapInArrow(hashed, "depth long, x long, y long, ends_sha256 string"))


def prefix_trie(work: Workspace, convs: DataFrame, turns: DataFrame, order: list[str]) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: distinct conv_id, those without a row of turns included. turns: (conv_id, columns of order, digest, chars), in
    that order within a conversation; rows equal in it follow each other in any order. No conversations give no nodes.
    """
    prefix = work.write(prefixes(work, turns, order))
    convs = work.write(convs)
    if not work.rows(convs):
        return convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"))
    nodes = prefix.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = work.write(nodes.unionByName(root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "owner", "n_convs", zero.alias("chars"))))
    first = root.select("owner").first()[0]
    shared = work.write(nodes.where("n_convs > 1 AND depth > 0").select("depth", "x", "y", "owner"))

    heads = first_owned(work, prefix, shared)
    above = nodes.where("n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("owner").alias("up"))
    heads = heads.join(above, ["depth", "px", "py"], "left").select("conv_id", "depth", F.when(F.col("conv_id") != first, F.col("up")).alias("up"))
    heads = work.write(heads)
    hung = work.write(heads.where("up IS NOT NULL").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("hung")))

    own = nodes.groupBy("owner").agg(F.max("depth").alias("depth"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = own.join(hung, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), "saved", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    up = heads.select("conv_id", F.col("depth").alias("head"), "up")
    chains = own.join(up, "conv_id", "left").select("conv_id", "up", "leaves", "saved")
    sums = from_below(work, chains)
    on_nodes = sums.join(heads.select("conv_id", "depth", F.col("up").alias("owner")).where("owner IS NOT NULL"), "conv_id")
    on_nodes = on_nodes.groupBy("owner", (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))

    ends = prefix.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x", "y"), "depth").alias("end"))
    ends = convs.join(ends, "conv_id", "left").select("conv_id", *[F.coalesce(F.col("end")[c], zero).alias(c) for c in ("depth", "x", "y")])
    lists = joined_ids(work, ends)

    rows = nodes.join(on_nodes, ["owner", "depth"], "left").join(heads.select(F.col("conv_id").alias("owner"), "depth", "up"), ["owner", "depth"], "left")
    counts = {c: F.coalesce(c, zero) for c in ("hung", "hung_leaves", "hung_saved")}
    rows = rows.withColumns(counts).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars") + F.col("hung_saved")).withColumn("back", -F.col("depth"))
    # from a chain's end: the first row is its last node
    rows = running(work, rows, "owner", [F.col("back")], sums=("saved", "hung_leaves"))
    ending = F.col("nth") == 1
    children = F.col("hung") + F.when(ending, 0).otherwise(1)
    # the end of a chain is a leaf if nothing hangs from it
    rows = rows.withColumn("n_children", children.cast("long"))
    leaf_ends = own.select(F.col("conv_id").alias("owner"), F.col("leaves").alias("end_leaf"))
    rows = rows.join(leaf_ends, "owner")
    parent = F.when(F.col("depth") > 0, F.coalesce(F.col("up"), F.col("owner")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = rows.select("depth", "x", "y", F.col("owner").alias("conv_id"), parent.alias("parent_conv_id"), "n_convs", "n_children", (F.col("run_hung_leaves") + F.col("end_leaf")).alias("n_leaves"), F.col("run_saved").alias("saved_tokens"))
    out = rows.join(lists, ["depth", "x", "y"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text, and other columns, which are ignored) as they are.

    Turns are ordered by turn (null first), those of one turn by role and a digest of the text; null role and text are
    empty; rows of a null conv_id are left out; repeated rows are repeated turns. See prefix_trie() for the columns.
    """
    work = Workspace(conversations.sparkSession)
    turns = work.write(numbered(work, turns_of(conversations)))
    return prefix_trie(work, turns.select("conv_id").distinct(), turns.withColumnRenamed("nth", "at"), ["at"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    work = Workspace(spark)
    turns = work.write(numbered(work, turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return prefix_trie(work, turns.select("conv_id").distinct(), shared_heads(work, turns), ["own", "at"])


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, 0 AS part, nth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.nth <= c.h
  UNION ALL SELECT c.conv_id, 1, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.nth > c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
    sha256(string_agg(sha256(strlen(role) || ':' || role || text), ',') OVER w) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS ends FROM p),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM e GROUP BY node, depth),
k AS (SELECT above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
under AS (
  SELECT e.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved
  FROM m JOIN e ON e.conv_id = m.conv_id AND e.depth <= m.depth GROUP BY e.node)
SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN under u USING (node) LEFT JOIN n a ON a.node = m.above AND m.depth > 0
"""
