"""Evidence governance: contracts, pairs, splits, audits, gates and hash chains. A doubtful row is refused, with reasons."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import stats as S
from tracemill.operators.scans import Running, running

#: The contract's features (name, type, least, most) and the fields that may not or need not be there.
VERBS = ("trivial", "explain", "small_edit", "write", "fix", "hard", "unknown")
FEATURES = [
    ("verb_class", "string", None, None), ("verb_score", "number", 0.0, 1.0), ("broad_scope", "boolean", None, None), ("narrow_scope", "boolean", None, None), ("context_tokens", "integer", 0, None),
    ("turn_index", "integer", 0, None), ("recent_errors", "integer", 0, None), ("recent_edit_failures", "integer", 0, None), ("prev_turn_interrupted", "boolean", None, None),
]
DROPPED = ("privacy_pinned", "escalated_this_episode", "is_terse_continuation", "extra")
FORBIDDEN = ("instruction_text", "instr_sha256", "route_id", "session_id", "source", "layer", "rung", "cascade", "score", "reason", "classifier_tier", "status", "escalated", "tripwire_name", "output_tokens", "interrupted", "user_retried", "outcome_proxy_hard", "task_signal_hard", "verified_success", "quality_score")
GATES = ("feature_contract", "organic_verifier_labels", "classifier_provenance", "label_precision", "paired_counterfactual_integrity", "representative_pairs", "learned_router_authority")
TIERS = ("trivial", "standard", "hard")
PAIR_FIELDS = ("task_id", "repository", "base_commit", "verifier", "feature_sha256")


def _lit(names) -> Column:
    return F.array(*map(F.lit, names))


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with value evaluated once however often made reads it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _parsed(payload: Column) -> Column:
    """v, the payload as a VARIANT, and its keys."""
    return F.struct(F.try_parse_json(payload).alias("v"), F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")).alias("keys"))


def feature_reasons(payload: Column) -> Column:
    """Why a feature payload (JSON) breaks the contract, in order; an empty array if it does not. A boolean is no integer."""
    return _with(_parsed(payload), lambda p: _feature_reasons(p["v"], p["keys"]))


def _feature_reasons(v: Column, keys: Column) -> Column:
    names = [f[0] for f in FEATURES]
    lists = [("forbidden", F.array_intersect(keys, _lit(FORBIDDEN))), ("unknown", F.array_except(keys, _lit([*names, *DROPPED, *FORBIDDEN]))), ("missing", F.array_except(_lit(names), keys))]
    show = lambda k: lambda x: F.when(v.isNotNull() & (F.size(x) > 0), F.concat(F.lit(f"{k}: "), F.array_join(F.array_sort(x), ",")))
    listed = [_with(x, show(k)) for k, x in lists]
    # all features at once, as they are and as numbers, then what each is
    parts = F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")
    values = F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:{'string' if k == 'string' else 'double'}" for n, k, _, _ in FEATURES) + ">")
    kinds = _with(parts, lambda f: F.struct(*[F.schema_of_variant(f[n]).alias(n) for n in names]))
    bad = _with(F.struct(kinds.alias("kinds"), values.alias("values")), lambda x: F.array(*[_is_bad(f, keys, x["kinds"][f[0]], x["values"][f[0]]) for f in FEATURES]))
    return F.array_compact(F.concat(F.array(F.when(v.isNull(), F.lit("not json")), *listed), bad))


def _is_bad(feature: tuple, keys: Column, is_a: Column, value: Column) -> Column:
    name, kind, least, most = feature
    ok = {"boolean": lambda: is_a == "BOOLEAN", "integer": lambda: is_a == "BIGINT", "number": lambda: is_a.isin("BIGINT", "DOUBLE") | is_a.startswith("DECIMAL"), "string": lambda: value.isin(*VERBS) & (is_a == "STRING")}[kind]()
    if least is not None:
        ok = ok & (value >= least)
    if most is not None:
        ok = ok & (value <= most)
    return F.when(~F.coalesce(ok, F.lit(False)) & F.array_contains(keys, F.lit(name)), F.lit(f"bad: {name}"))


def canonical_features(payload: Column) -> Column:
    """The contract's fields only, in its order, as JSON."""
    return F.to_json(F.struct(*[F.try_variant_get(F.try_parse_json(payload), f"$.{n}", {"string": "string", "number": "double", "boolean": "boolean", "integer": "long"}[k]).alias(n) for n, k, _, _ in FEATURES]))


def eligibility_reasons(source: Column, layer: Column, payload: Column) -> Column:
    """Why a decision can't be learned from, in order."""
    gates = sorted(("privacy_pinned", "escalated_this_episode", "is_terse_continuation"))

    def reasons(v: Column, keys: Column) -> Column:
        active = [F.when(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(f"gate active: {k}")) for k in gates]
        own = F.array_compact(F.array(F.when(~F.coalesce(source == "organic", F.lit(False)), "ineligible source"), F.when(~F.coalesce(layer.isin("middle_default", "classifier"), F.lit(False)), "outside the ambiguous layer"), *active))
        return F.concat(own, _feature_reasons(v, keys))

    return _with(_parsed(payload), lambda p: reasons(p["v"], p["keys"]))


def provenance_complete(trace: Column, tier: Column) -> Column:
    v = F.try_parse_json(trace)
    called, abstained = (F.try_variant_get(v, f"$.{k}", "boolean") for k in ("called", "abstained"))
    return F.coalesce(F.when(~called, F.try_variant_get(v, "$.resolver", "string").isin("none", "llm_classifier")).when(called, F.coalesce(abstained, F.lit(False)) | (~abstained & tier.isin(*TIERS))), F.lit(False))


def pair_problems(records: DataFrame) -> DataFrame:
    """pair_id, reasons: a candidate twice, no local or no frontier one, or fields that differ within the pair.

    records: pair_id, candidate, rung and the fields of PAIR_FIELDS.
    """
    g = records.groupBy("pair_id").agg(
        F.count("*").alias("n"), F.countDistinct("candidate").alias("c"), F.bool_or(F.col("rung").startswith("local")).alias("l"), F.bool_or(F.col("rung") == "frontier").alias("f"),
        *[(F.min(F.xxhash64(k)) != F.max(F.xxhash64(k))).alias(f"_{k}") for k in PAIR_FIELDS])
    reasons = F.array(F.when(F.col("n") > F.col("c"), "repeated candidate"), F.when(~F.coalesce("l", F.lit(False)), "no local"), F.when(~F.coalesce("f", F.lit(False)), "no frontier"), *[F.when(F.col(f"_{k}"), f"differs: {k}") for k in PAIR_FIELDS])
    return g.select("pair_id", F.array_compact(reasons).alias("reasons"))


def split(records: DataFrame, cutoff: Column, held_repositories: list[str], held_tasks: list[str] | None = None) -> DataFrame:
    """records with split: repository, task, train, temporal, or straddle, which is an error. A pair is never divided.

    records: pair_id, repository, task_id, at. A pair is before the cutoff only with all of its records.
    """
    before = F.col("at") < cutoff
    g = records.groupBy("pair_id").agg(F.bool_or(F.col("repository").isin(*held_repositories or [""])).alias("r"), F.bool_or(F.col("task_id").cast("string").isin(*(held_tasks or [""]))).alias("t"), F.bool_and(before).alias("all"), F.bool_or(before).alias("any"))
    kind = F.when(F.col("r"), "repository").when(F.col("t"), "task").when(F.col("all"), "train").when(~F.col("any"), "temporal").otherwise("straddle")
    return records.join(g.select("pair_id", kind.alias("split")), "pair_id")


def leakage(splits: DataFrame, key: str) -> DataFrame:
    """Keys of held-out rows that training rows have as well."""
    train, held = splits.where("split = 'train'"), splits.where("split IN ('repository', 'task')")
    return train.select(key).intersect(held.select(key))


def label_audit(reviews: DataFrame, evidence: DataFrame, z: float = 1.95996, least: float = 0.9) -> DataFrame:
    """stratum, reviews, agreed, lower_bound, passes; a second review of a record, and one of an unknown record, is invalid.

    reviews: evidence_id, agrees, reviewed_at; evidence: evidence_id, stratum.
    """
    w = Window.partitionBy("evidence_id").orderBy("reviewed_at")
    valid = reviews.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(evidence.select("evidence_id", "stratum"), "evidence_id")
    g = valid.groupBy("stratum").agg(F.count("*").alias("reviews"), F.count_if("agrees").alias("agreed"))
    return g.withColumn("lower_bound", S.wilson_lower_bound(F.col("agreed"), F.col("reviews"), z)).withColumn("passes", F.col("lower_bound") >= least)


def bucket_index(profile: DataFrame, weights: DataFrame) -> DataFrame:
    """index: decisions weigh the same within a bucket, buckets by their weights. profile: bucket, points, n; weights: bucket, weight."""
    b = profile.groupBy("bucket").agg((F.sum(F.col("points") * F.col("n")) / F.sum("n")).alias("score"))
    return b.join(F.broadcast(weights), "bucket").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("index"))


def gates(counts: DataFrame) -> DataFrame:
    """gate, status: the seven gates of one row of counts: invalid, usable, complete, audit_passes, pairs, organic_pairs."""
    c = F.col
    status = [
        F.when(c("invalid") == 0, "pass").otherwise("blocked"), F.when(c("usable") > 0, "pass").otherwise("blocked"), F.when(c("usable") == 0, "not_evaluated").when(c("complete") == c("usable"), "pass").otherwise("blocked"),
        F.when(c("audit_passes"), "pass").otherwise("blocked"), F.when(c("pairs") > 0, "pass").otherwise("blocked"), F.when(c("organic_pairs") > 0, "pass").otherwise("blocked"), F.lit("blocked")]
    made = F.array(*[F.struct(F.lit(g).alias("gate"), s.alias("status")) for g, s in zip(GATES, status, strict=True)])
    return counts.select(F.explode(made).alias("g")).select("g.*")


def verification(checks: DataFrame, required: int = 1) -> DataFrame:
    """candidate, outcome, cause, quality: a failed check is definite, a missing or broken one leaves it unknown.

    checks: candidate, name, status (pass, fail, error, timeout, skipped), baseline (same or null), violations.
    """
    fail, odd = F.bool_or(F.col("status") == "fail"), F.bool_or(F.col("status").isin("error", "timeout"))
    g = checks.groupBy("candidate").agg(
        fail.alias("f"), odd.alias("o"), F.count("*").alias("n"), F.count_if(F.col("status") == "pass").alias("p"), F.coalesce(F.max("violations"), F.lit(0)).alias("v"),
        F.array_sort(F.collect_list(F.when((F.col("baseline") == "pass") & (F.col("status") != "pass"), F.col("name")))).alias("regressions"), F.array_sort(F.collect_list(F.when((F.col("baseline") == "fail") & (F.col("status") == "pass"), F.col("name")))).alias("improvements"))
    outcome = F.when(F.col("f") | (F.col("v") > 0), "fail").when(F.col("o") | (F.col("n") < required), "unknown").otherwise("pass")
    return g.select("candidate", outcome.alias("outcome"), F.when(F.col("f") | (F.col("v") > 0), "task_capability").when(F.col("o"), "infrastructure").alias("cause"), ((F.col("p") + (F.col("v") == 0).cast("int")) / (F.col("n") + 1)).alias("quality"), "regressions", "improvements")


def change_violations(paths: Column, allowed: list[str], forbidden: list[str], most: int) -> Column:
    """Why a set of changed files is not what was asked for."""
    from tracemill.functions.text import glob_match, is_test_path

    hit = lambda p, patterns: reduce(lambda a, b: a | b, [glob_match(p, g) for g in patterns], F.lit(False))
    return F.array_compact(F.array(
        F.when(F.size(paths) > most, "too many files"), F.when(F.exists(paths, lambda p: hit(p, forbidden)), "forbidden path"),
        F.when(F.exists(paths, lambda p: ~hit(p, allowed)) if allowed else F.lit(False), "path not allowed"), F.when((F.size(paths) > 0) & F.forall(paths, is_test_path), "tests only")))


#: The buckets of the decision table, in order, the states of a decision and its levels.
BUCKETS = ("FND", "SEM", "SAF", "RTG", "CAS", "MEM", "LRN", "EVL", "OPS")
STATES = ("Proposed", "Accepted", "Deferred", "Rejected", "Superseded")
LEVELS = ("D0 Design", "D1 Code", "D2 Tested", "D3 Shadow", "D4 Pilot", "D5 Graduated")


def taxonomy_problems(rows: DataFrame, prefix: str) -> DataFrame:
    """line, reasons of the rows of a decision table that have any: a malformed or repeated id, an unknown bucket, state or
    level, an empty cell, and a number that doesn't follow its bucket's last one (from 1 on).

    rows: line, id (<prefix>-<bucket>-<three digits>), decision, state, maturity, evidence. Null cells are empty.
    """
    form = rf"^{prefix}-([A-Z]{{3}})-(\d{{3}})$"
    bucket, number = F.regexp_extract("id", form, 1), F.regexp_extract("id", form, 2)
    w = Window.partitionBy("_bucket").orderBy("line")
    r = rows.withColumns({"id": F.coalesce("id", F.lit("")), "_bucket": F.coalesce(bucket, F.lit(""))})
    r = r.withColumns({"_number": F.coalesce(number, F.lit("")).try_cast("int"), "_i": F.row_number().over(w), "_again": F.row_number().over(Window.partitionBy("id").orderBy("line")) > 1})
    good, known = F.col("_bucket") != "", F.col("_bucket").isin(*BUCKETS)
    out = lambda c, allowed: good & ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    empty = (F.coalesce("decision", F.lit("")) == "") | (F.coalesce("evidence", F.lit("")) == "")
    reasons = F.array_compact(F.array(
        F.when(~good, "malformed id"), F.when(good & F.col("_again"), "repeated id"), F.when(good & ~known, "unknown bucket"), F.when(out("state", STATES), "unknown state"),
        F.when(out("maturity", LEVELS), "unknown maturity"), F.when(good & empty, "empty cell"), F.when(known & (F.col("_number") != F.col("_i")), "number does not follow")))
    return r.select("line", reasons.alias("reasons")).where(F.size("reasons") > 0)


def broken_links(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """target of each local Markdown link, once, whose file isn't among the paths; web and mail links and anchors are none.

    lines: value; paths: path, as the links write it.
    """
    found = lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"\]\(([^)]+)\)"), F.lit(1))).alias("target")).distinct()
    local = found.withColumn("path", F.split("target", "#")[0]).where("path <> '' AND NOT contains(path, '://') AND NOT startswith(path, 'mailto:')")
    return local.join(paths.select("path"), "path", "left_anti").select("target")


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def chain_entry(payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(previous, F.lit("")), payload), 256)


def next_entries(history: DataFrame, reports: DataFrame) -> DataFrame:
    """The rows that an append of one report adds to a history: one, or none where its snapshot is there already.

    reports: snapshot_id, payload, one row. A known snapshot with another payload fails the job.
    """
    last = history.agg(F.max("seq").alias("_seq"), F.max_by("entry_sha256", "seq").alias("_last"))  # one row
    known = history.select("snapshot_id", F.col("payload").alias("_payload"))
    r = reports.join(F.broadcast(reports.select("snapshot_id").join(known, "snapshot_id")), "snapshot_id", "left").crossJoin(F.broadcast(last))
    differs = F.raise_error(F.concat(F.lit("snapshot maps to different evidence: "), "snapshot_id")).cast("boolean")
    new = F.when(F.col("_payload").isNull(), True).when(F.col("_payload") == F.col("payload"), False).otherwise(differs)
    return r.where(new).select((F.coalesce("_seq", F.lit(-1)) + 1).alias("seq"), "snapshot_id", "payload", F.col("_last").alias("previous_sha256"), chain_entry(F.col("payload"), F.col("_last")).alias("entry_sha256"))


def not_finite(rows: DataFrame) -> DataFrame:
    """rows that an append of JSON refuses, with fields: the names of their columns that are infinite or not a number."""
    bad = [F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), F.lit(c)) for c, t in rows.dtypes if t in ("float", "double")]
    return rows.withColumn("fields", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")).where(F.size("fields") > 0)


def chain_problems(history: DataFrame) -> DataFrame:
    """Entries that break the chain: seq, reasons. history: seq, snapshot_id, payload, previous_sha256, entry_sha256.

    The entry before each comes with it from a scan over ranges of seq, so a history of any length is many tasks' work.
    Entries of one seq are taken in order of their hash.
    """
    repeated = history.groupBy("snapshot_id").count().where("count > 1").select("snapshot_id", F.lit(True).alias("_twice"))
    h = running(history.withColumn("_all", F.lit(0)), "_all", ["seq", "entry_sha256"], {"_before": Running("lag", "entry_sha256")}).drop("_all", "nth")
    h = h.join(repeated, "snapshot_id", "left").withColumn("_twice", F.coalesce("_twice", F.lit(False)))
    reasons = F.array_compact(F.array(F.when(F.col("_twice"), "snapshot repeats"), F.when(~F.col("previous_sha256").eqNullSafe(F.col("_before")), "predecessor differs"), F.when(F.col("entry_sha256") != chain_entry(F.col("payload"), F.col("previous_sha256")), "content differs")))
    return h.select("seq", reasons.alias("reasons")).where(F.size("reasons") > 0)


#: Rows of a leaf of a data set's tree, on average; a level's nodes have a digit of a hash more than those above it.
LEAF_ROWS = 64


def dataset_rows(records: DataFrame, split: str | None = None) -> DataFrame:
    """(split, h, n): the hash of each distinct row, its columns in order of name, and how often it is there."""
    columns = sorted(c for c in records.columns if c != split)
    part = F.coalesce(F.col(split).cast("string"), F.lit("")) if split else F.lit("")
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return records.select(part.alias("split"), h.alias("h")).groupBy("split", "h").agg(F.count("*").alias("n"))


def tree_depth(rows: int) -> int:
    """Levels below the root, so that leaves have LEAF_ROWS distinct rows or fewer on average."""
    depth = 0
    while LEAF_ROWS * 16**depth < rows:
        depth += 1
    return depth


def dataset_tree(rows: DataFrame, depth: int) -> DataFrame:
    """(split, level, prefix, rows, sha256) of the nodes of each split's tree, from the root, level 0, to the leaves.

    rows: dataset_rows(). A leaf has the rows whose hashes begin with its prefix, so leaves are of about equal size
    whatever the keys are, and equal rows are one with a count. A leaf's hash is of its rows' in order, a node's of those of
    its at most 16 children; every level is one aggregate of the one below it, and no list grows with the data.
    """
    line = lambda *c: F.concat_ws(":", *c)
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    level = rows.groupBy("split", F.substring("h", 1, depth).alias("prefix")).agg(F.sum("n").alias("rows"), digest(line("h", F.col("n").cast("string"))).alias("sha256"))
    out = level.select("split", F.lit(depth).alias("level"), "prefix", "rows", "sha256")
    for k in range(depth - 1, -1, -1):
        level = level.groupBy("split", F.substring("prefix", 1, k).alias("up")).agg(F.sum("rows").alias("rows"), digest(line("prefix", "sha256")).alias("sha256")).withColumnRenamed("up", "prefix")
        out = out.unionByName(level.select("split", F.lit(k).alias("level"), "prefix", "rows", "sha256"))
    return out


def changed_rows(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """(split, h, a, b): rows of dataset_rows() a and b, with how often each has them, where these differ.

    The trees are compared first: only rows below leaves that differ are.
    """
    leaves = [dataset_tree(x, depth).where(F.col("level") == depth).select("split", "prefix", F.col("sha256").alias(n)) for x, n in ((a, "x"), (b, "y"))]
    differ = leaves[0].join(leaves[1], ["split", "prefix"], "full_outer").where("NOT x <=> y").select("split", "prefix")
    below = [x.withColumn("prefix", F.substring("h", 1, depth)).join(differ, ["split", "prefix"], "left_semi").select("split", "h", F.col("n").alias(n)) for x, n in ((a, "a"), (b, "b"))]
    both = below[0].join(below[1], ["split", "h"], "full_outer").select("split", "h", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.where("a <> b")


def dataset_sha256(records: DataFrame) -> str:
    """Of a data set: the root of its tree, whatever its rows' order."""
    rows = dataset_rows(records)
    roots = dataset_tree(rows, tree_depth(rows.count())).where("level = 0").select("sha256").collect()  # one row, or none
    return roots[0][0] if roots else hashlib.sha256(b"").hexdigest()
