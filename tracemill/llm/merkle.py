"""A manifest of a table as a Merkle tree, built and proved by traversals of aligned blocks.

Leaves are ordered within their tree (a source) and ``ARITY`` consecutive nodes make one of the next level. A block is
``ARITY ** HEIGHT`` leaves from a multiple of that on: one group of bounded size. Its traversal is a recursion in
postorder that returns the subtree's digest and, while it unwinds, appends to the leaves below each child the digests
of the child's siblings. The roots of blocks are the leaves of another distributed traversal, until each tree has one
root; the roots of the trees, in their order, are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import Workspace
from tracemill.llm.scans import running
from tracemill.llm.sql import crc32

ARITY, HEIGHT = 16, 2
BLOCK = ARITY**HEIGHT
#: A node's place in its run and the run's other digests, one after the other, from the lowest level up.
PROOF = "array<struct<place:int,siblings:string>>"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value's unambiguous form: its UTF-8 length, a colon and the value; a dash for null."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    put = lambda d, p: F.concat(F.left(p["siblings"], p["place"] * 64), d, F.substr(p["siblings"], p["place"] * 64 + 1))
    return F.aggregate(proof, digest, lambda d, p: F.sha2(put(d, p), 256))


def height_of(block: int, n: int) -> int:
    """Levels within a block of n nodes: all, unless it is its tree's only one."""
    height = 0
    while ARITY**height < n:
        height += 1
    return HEIGHT if block else height


def traverse(digests: list[str], height: int, proofs: list[list[tuple[int, str]]] | None = None) -> str:
    """The digest of the subtree over digests; proofs[i] gets the siblings on leaf i's way up."""

    def visit(level: int, low: int, high: int) -> str:
        if not level:
            return digests[low]
        span = ARITY ** (level - 1)
        starts = range(low, high, span)
        kids = [visit(level - 1, a, min(a + span, high)) for a in starts]
        if proofs is not None:
            for i, a in enumerate(starts):
                step = (i, "".join(kids[:i] + kids[i + 1 :]))
                for leaf in range(a, min(a + span, high)):
                    proofs[leaf].append(step)
        return sha256("".join(kids))

    return visit(height, 0, len(digests))


def _ordered(nodes: pa.Table) -> tuple[pa.Table, list[str]]:
    nodes = nodes.sort_by("idx")
    return nodes, nodes["digest"].to_pylist()


def block_roots(nodes: DataFrame) -> DataFrame:
    """nodes (tree, idx from 0, digest) as the roots of their blocks, numbered in their trees."""

    def roots(group: pa.Table) -> pa.Table:
        group, digests = _ordered(group)
        block = group["idx"][0].as_py() // BLOCK
        return pa.table({"tree": group["tree"].slice(0, 1), "idx": pa.array([block]), "digest": pa.array([traverse(digests, height_of(block, len(digests)))])})

    nodes = nodes.select("tree", "idx", "digest", F.floor(F.col("idx") / BLOCK).alias("block"))
    return nodes.groupBy("tree", "block").applyInArrow(roots, "tree string, idx long, digest string")


def with_proofs(nodes: DataFrame, upper: DataFrame, carried: list[str]) -> DataFrame:
    """nodes with their proofs and the carried columns of upper, which has both for the roots of their blocks."""
    kinds = dict(upper.dtypes)

    def prove(group: pa.Table, above: pa.Table) -> pa.Table:
        group, digests = _ordered(group)
        proofs: list[list[tuple[int, str]]] = [[] for _ in digests]
        traverse(digests, height_of(group["idx"][0].as_py() // BLOCK, len(digests)), proofs)
        top = [(p["place"], p["siblings"]) for p in above["proof"][0].as_py()]
        own = len(proofs[0])
        flat = [step for p in proofs for step in (*p, *top)]
        steps = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.string())], ["place", "siblings"])
        offsets = pa.array(range(0, (own + len(top)) * len(digests) + 1, own + len(top)) if own + len(top) else [0] * (len(digests) + 1), pa.int32())
        out = {c: group[c] for c in names}
        out |= {c: pa.array([above[c][0].as_py()] * len(digests), above.schema.field(c).type) for c in carried}
        return pa.table(out | {"proof": pa.ListArray.from_arrays(offsets, steps)})

    names = nodes.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in nodes.dtypes] + [f"`{c}` {kinds[c]}" for c in carried] + [f"proof {PROOF}"])
    left = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).groupBy("tree", "block")
    right = upper.select("tree", F.col("idx").alias("block"), "proof", *carried).groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(prove, schema)


def climb(work: Workspace, nodes: DataFrame, trees: int) -> list[DataFrame]:
    """nodes and the levels of block roots above them, the last with one node a tree."""
    levels = [nodes]
    while True:
        levels.append(work.write(block_roots(levels[-1])))
        if work.rows(levels[-1]) == trees:
            return levels


def descend(work: Workspace, levels: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest level with proofs, from those of the topmost; only levels between are written."""
    for nodes in levels[-2:0:-1]:
        top = work.write(with_proofs(nodes, top, carried))
    return with_proofs(levels[0], top, carried)


def merkle(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (source, leaf, and other columns) with idx, subroot, root and proof.

    leaf is a row's digest in lowercase hex. The leaves of a source are its tree, in the order of the columns of order and
    then of leaf, numbered by idx from 0; its root is subroot (a lone leaf itself). The subroots by source, null first and
    then by bytes, are the tree of root (a lone subroot itself). proof is an array of (place, siblings) from the leaf to
    root; fold() leads from a leaf and its proof to the root. Rows that are equal in all that orders them are leaves of
    their own, one after the other; null is a source like any other; null order columns come first; no rows give no rows.
    Other columns are passed on, but for idx, subroot, root and proof.
    """
    spark, work = leaves.sparkSession, Workspace(leaves.sparkSession)
    made = ("idx", "subroot", "root", "proof")
    kept = [c for c in leaves.columns if c.lower() not in made]
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    # the caller's columns travel as one, so that none clashes with ours
    packed = F.struct(*[F.col(c) for c in kept]).alias("row")
    named = leaves.select(packed, F.col("leaf").alias("digest"), tree.alias("tree"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    places = [f"o{i}" for i in range(len(order))]
    lowest = running(work, named, "tree", [F.col(c).asc_nulls_first() for c in places] + [F.col("digest")]).drop(*places)
    lowest = work.write(lowest.withColumn("idx", F.col("nth") - 1).drop("nth"))
    if not work.rows(lowest):
        return lowest.select("row.*", "idx", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(PROOF).alias("proof"))
    trees = lowest.select("tree").distinct().count()
    levels = climb(work, lowest, trees)
    # one row a source, numbered as one tree
    one = running(work, levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "tree", [F.col("of")])
    subroots = work.write(one.withColumn("idx", F.col("nth") - 1).drop("nth"))
    above = climb(work, subroots, 1)
    top = above[-1].select("tree", "idx", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    proved = descend(work, above, top, ["root"])
    roots = work.write(proved.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "root", "proof"))
    out = descend(work, levels, roots, ["subroot", "root"])
    return out.select("row.*", "idx", "subroot", "root", "proof")


#: The letters that tampering lower-cases.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, from the manifest's proofs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    shown = F.when(touched, digest(F.translate("text", UPPER, UPPER.lower()))).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", digest(F.col("text"))).withColumn("shown", shown).select("doc_id", "source", "leaf", "shown")
    out = merkle(leaves, ["doc_id"])
    out = out.withColumn("proof_sha256", F.sha2(F.array_join(F.col("proof.siblings"), ""), 256)).withColumn("folded_root", fold(F.col("shown"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))



def _field_sql(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Levels one by one, with each leaf's siblings and fold; the height is that of the table, whatever it is.
ORACLE = f"""
WITH RECURSIVE shown AS (
  SELECT *, CASE WHEN {crc32("doc_id")} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS other FROM documents),
leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf_sql("text")} AS leaf, {_leaf_sql("other")} AS shown FROM shown),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM numbered
  UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), count(*) OVER (PARTITION BY tree)
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), count(*) OVER () FROM tops WHERE n > 1 GROUP BY level, idx // 16),
runs AS (SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS digests FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16),
top_runs AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS digests FROM tops WHERE n > 1 GROUP BY level, idx // 16),
up AS (
  SELECT doc_id, leaf, tree, 0 AS level, idx, shown AS folded, '' AS proof FROM numbered
  UNION ALL
  SELECT doc_id, leaf, u.tree, u.level + 1, idx // 16,
    sha256(array_to_string(digests[:idx % 16] || [folded] || digests[idx % 16 + 2:], '')),
    proof || array_to_string(digests[:idx % 16] || digests[idx % 16 + 2:], '')
  FROM up u JOIN runs r ON r.tree = u.tree AND r.level = u.level AND r.run = u.idx // 16),
below AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY doc_id, leaf, tree ORDER BY level DESC) = 1),
over_all AS (
  SELECT doc_id, leaf, s.digest AS subroot, 0 AS level, s.idx, folded, proof FROM below b JOIN subroots s ON s.tree = b.tree
  UNION ALL
  SELECT doc_id, leaf, subroot, u.level + 1, idx // 16,
    sha256(array_to_string(digests[:idx % 16] || [folded] || digests[idx % 16 + 2:], '')),
    proof || array_to_string(digests[:idx % 16] || digests[idx % 16 + 2:], '')
  FROM over_all u JOIN top_runs r ON r.level = u.level AND r.run = u.idx // 16),
done AS (SELECT * FROM over_all QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM done, (SELECT digest FROM tops WHERE n = 1) t
"""
