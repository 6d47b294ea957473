"""Outcome labels. Booleans have three values: null is unknown, and becomes false only where it says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAUSES = ["harness_dialect", "task_capability", "user_abort", "infrastructure"]
TYPE_OF = {"parse_schema": "dialect", "edit_apply": "dialect", "loop": "difficulty", "no_progress": "difficulty", "turn_budget": "cost", "user_interrupt": "quality"}
CHEAPER = ("local", "local-code", "local-small", "cheap-cloud")


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def proxy_hard(edit_failures: Column, errors: Column, interrupted: Column, continuations: Column) -> Column:
    return (_zero(edit_failures) >= 1) | (_zero(errors) >= 1) | _false(interrupted) | (_zero(continuations) >= 10)


def failure_cause(tripwire_type: Column, infrastructure: Column) -> Column:
    t = F.lower(F.coalesce(tripwire_type, F.lit("")))
    return F.when(t == "dialect", "harness_dialect").when(t.isin("difficulty", "cost"), "task_capability").when(t == "quality", "user_abort").when(_false(infrastructure), "infrastructure")


def task_signal(tripwire_type: Column, retried: Column, continuations: Column) -> Column:
    return _false(retried) | (_zero(continuations) >= 10) | F.lower(F.coalesce(tripwire_type, F.lit(""))).isin("difficulty", "cost", "quality")


def went_hard(escalated: Column, retried: Column, proxy: Column) -> Column:
    return _false(escalated) | _false(retried) | _false(proxy)


def effective_hard(signal: Column, escalated: Column, retried: Column, proxy: Column, verified: Column, rung: Column, cause: Column) -> Column:
    """The label that votes and reports share.

    A verified failure of the task itself, or without a cause, is hard; a verified success below the frontier is not;
    otherwise the cause-clean signal where there is one, or the older mixture.
    """
    kind = F.lower(F.coalesce(cause, F.lit("")))
    at = F.lower(F.replace(F.coalesce(rung, F.lit("")), F.lit("_"), F.lit("-")))
    return F.when(~verified & kind.isin("", "task_capability"), True).when(verified & at.isin(*CHEAPER), False).otherwise(F.coalesce(signal, went_hard(escalated, retried, proxy)))


def insight_hard(signal: Column, proxy: Column, verified: Column, rung: Column, cause: Column) -> Column:
    """The insight report's own variant: falls back to the proxy alone, and wants a cause of task_capability in words."""
    at = F.coalesce(rung, F.lit(""))
    return F.when(~verified & (F.coalesce(cause, F.lit("task_capability")) == "task_capability"), True).when(verified & at.isin("local", "local-code", "local-small", "cheap-cloud", "cheap_cloud"), False).otherwise(F.coalesce(signal, proxy))


def migrate_v2(retried: Column, proxy: Column, tripwire_type: Column) -> Column:
    """The task signal that old rows get: retries are hard, dialect failures not, other trip-wires are."""
    t = F.lower(tripwire_type)
    return F.when(_false(retried), True).when(F.coalesce(t.like("%dialect"), F.lit(False)), False).when(F.coalesce(t.rlike("(difficulty|cost|quality)$"), F.lit(False)), True).otherwise(F.lit(None).cast("boolean"))
