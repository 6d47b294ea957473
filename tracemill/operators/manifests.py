"""Evidence rows, manifests and score artefacts: checks that refuse with reasons. The single documents are driver work."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.governance import canonical_features, canonical_sha256, dataset_rows, dataset_tree, feature_reasons, tree_depth

#: The strings that evidence must have, its sources, and the fields a snapshot's id covers.
REQUIRED = ("evidence_id", "pair_id", "task_id", "verification_plan_sha256", "source", "rung", "model", "harness", "verifier_source")
SOURCES = ("organic",)
SNAPSHOT_FIELDS = ("schema_version", "score_contract", "baseline", "production_readiness", "blockers", "architecture_evidence_index", "counts", "label_audit", "gates")
EFFECTS = ("implements", "amends", "supersedes", "evidences", "none")


def evidence_reasons(e: DataFrame) -> DataFrame:
    """e with reasons: blank strings, a source that is not permitted, ids that are no hashes, numbers out of range, features that are not the contract's projection."""
    bad = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    number = lambda c: ~F.coalesce((F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    found = [F.when(bad(c), F.lit(f"blank: {c}")) for c in REQUIRED]
    found += [F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), F.lit("source not permitted"))]
    found += [F.when(~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit(f"no hash: {c}")) for c in ("repository_sha256", "verification_plan_sha256")]
    found += [F.when(~F.coalesce(F.col("snapshot_commit").rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False)), F.lit("no commit"))]
    found += [F.when(number(c), F.lit(f"not a count: {c}")) for c in ("decided_at", "cost_estimate", "latency_ms")]
    found += [F.when(F.col(c).isNotNull() & ~F.coalesce(F.col(c).between(0, 1), F.lit(False)), F.lit(f"out of range: {c}")) for c in ("quality_score", "verifier_confidence")]
    reasons = F.concat(F.array_compact(F.array(*found)), feature_reasons(F.col("features")))
    return e.withColumn("reasons", reasons)


def cause_clean(success: Column, cause: Column, confidence: Column, source: Column, least: float = 0.9) -> Column:
    """Whether a label says something about the task: verified, with confidence, and not failed for another cause."""
    return F.coalesce((source == "organic") & success.isNotNull() & (confidence >= least) & (success | F.coalesce(cause == "task_capability", F.lit(False))), F.lit(False))


def from_counterfactual(records: DataFrame) -> DataFrame:
    """Evidence rows of counterfactual records: candidate, execution and verification flattened, features canonical."""
    return records.select(
        F.concat_ws(":", "pair_id", "candidate.name").alias("evidence_id"), "pair_id", "task_id", F.col("candidate.name").alias("candidate"), F.col("candidate.rung").alias("rung"), F.col("candidate.model").alias("model"),
        F.col("execution.cost").alias("cost_estimate"), F.col("execution.latency_ms").alias("latency_ms"), (F.col("verification.outcome") == "pass").alias("verified_success"),
        F.col("verification.confidence").alias("verifier_confidence"), canonical_features(F.col("features")).alias("features"))


def dataset_manifest(splits: DataFrame, cutoff: float) -> dict:
    """Rows and hash of each split, and the hash of them all: one aggregate over the rows, whatever the number of splits."""
    rows = dataset_rows(splits, "split")
    n = rows.count()
    roots = dataset_tree(rows, tree_depth(n)).where("level = 0").orderBy("split").collect()  # a row for each split
    parts = {r["split"]: {"rows": r["rows"], "sha256": r["sha256"]} for r in roots}
    return {"temporal_cutoff": cutoff, "splits": parts, "dataset_sha256": canonical_sha256(parts)}


def manifest_reasons(manifest: Mapping, required: tuple[str, ...], forbidden: tuple[str, ...] = ()) -> list[str]:
    missing = [f"missing: {k}" for k in required if k not in manifest]
    return missing + [f"forbidden: {k}" for k in forbidden if k in manifest] + [f"no hash: {k}" for k in manifest if k.endswith("_sha256") and not re.fullmatch("[0-9a-f]{64}", str(manifest[k]))]


def snapshot_id(report: Mapping) -> str:
    return "readiness:" + canonical_sha256({k: report[k] for k in SNAPSHOT_FIELDS})


def baseline_reasons(baseline: Mapping, profile_index: float, contract_sha256: str, digits: int = 1) -> list[str]:
    """A baseline must name its contract, and its score must follow from its profile."""
    found = [] if baseline.get("contract_sha256") == contract_sha256 else ["another contract"]
    return found + ([] if round(profile_index, digits) == baseline.get("score") else ["score does not follow from the profile"])


def cross_check(report: Mapping, contract: Mapping, baseline: Mapping) -> list[str]:
    """Persisted artefacts that must agree."""
    found = [] if report.get("score_contract", {}).get("sha256") == canonical_sha256(contract) else ["report names another contract"]
    found += [] if report.get("baseline", {}).get("sha256") == canonical_sha256(baseline) else ["report names another baseline"]
    return found + ([] if report.get("snapshot_id") == snapshot_id(report) else ["snapshot id differs"])


def change_form_reasons(fields: Mapping[str, str], known: set[str]) -> list[str]:
    """What a change's form leaves open or gets wrong."""
    get = lambda k: fields.get(k, "").strip()
    found = [] if get("primary id") in known else ["primary id unknown"]
    second = get("secondary ids")
    if not second:
        found.append("secondary ids missing")
    elif second.lower() != "none":
        found += [f"secondary id unknown: {x}" for x in (p.strip(" `") for p in second.split(",")) if x not in known]
    if get("decision effect").lower() not in EFFECTS:
        found.append("effect unknown")
    step = get("maturity transition")
    if step.lower() != "none" and not re.fullmatch(r"D[0-5](\s+[A-Za-z]+)?\s*->\s*D[0-5](\s+[A-Za-z]+)?", step):
        found.append("transition malformed")
    return found + [f"{k} missing" for k in ("evidence produced", "non-goals") if not get(k)]
