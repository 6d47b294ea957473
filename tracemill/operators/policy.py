"""The routing policy as one expression, and the trajectory columns that it reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EASY, HARD, HEADROOM = 0.35, 0.70, 0.8


@dataclass(frozen=True)
class Rung:
    name: str
    max_context: int
    cost_rank: int
    healthy: bool = True


#: The rungs of the registry.
REGISTRY = (Rung("local", 32_768, 0), Rung("cheap_cloud", 200_000, 1), Rung("frontier", 200_000, 2))
LADDER = {"local": "cheap_cloud", "local-code": "cheap-cloud", "local-small": "cheap-cloud", "cheap_cloud": "frontier", "cheap-cloud": "frontier"}


def fits(rung: Rung, context_tokens: Column) -> Column:
    """Within the headroom, the bound included."""
    return context_tokens <= F.lit(HEADROOM * rung.max_context)


def cheapest_feasible(context_tokens: Column, registry: tuple[Rung, ...] = REGISTRY) -> Column:
    """By cost, then name, among the healthy rungs that fit; the frontier if none does."""
    fitting = [F.when(fits(r, context_tokens), F.struct(F.lit(r.cost_rank).alias("rank"), F.lit(r.name).alias("name"))) for r in registry if r.healthy]
    if not fitting:
        return F.lit("frontier")
    return F.coalesce(F.array_min(F.filter(F.array(*fitting), lambda x: x.isNotNull()))["name"], F.lit("frontier"))


def route(f: dict[str, Column], registry: tuple[Rung, ...] = REGISTRY, verdict: Column | None = None) -> Column:
    """STRUCT<rung, cascade, layer, score, pinned, conflict>; the order of the cases is the policy.

    f: context_tokens, pinned, escalated, route (of the session), terse, interrupted, score. verdict, where a classifier
    takes part: a boolean, true for the frontier, null for no opinion.
    """
    local = next((r for r in registry if r.name == "local"), None)
    usable = bool(local and local.healthy)
    outgrown = F.col("x") if local is None else ~fits(local, f["context_tokens"])
    needs_other = outgrown if usable else F.lit(True)
    to = lambda rung, cascade, layer, score=None, pinned=False, conflict=None: F.struct(
        (rung if isinstance(rung, Column) else F.lit(rung)).alias("rung"), F.lit(cascade).alias("cascade"), F.lit(layer).alias("layer"),
        (F.lit(None).cast("double") if score is None else score).alias("score"), F.lit(pinned).alias("pinned"), F.lit(conflict).cast("string").alias("conflict"))
    s = f["score"]
    out = (
        F.when(f["pinned"] & outgrown, to("local", False, "gate:pin_context_conflict", pinned=True, conflict="pin_context"))
        .when(f["pinned"], to("local", True, "gate:privacy", pinned=True))
        .when(needs_other, to(cheapest_feasible(f["context_tokens"], registry), False, "gate:feasibility"))
        .when(f["escalated"], to(F.when(f["route"] != "local", f["route"]).otherwise("frontier"), False, "gate:hysteresis"))
        .when(f["terse"], to(F.coalesce(F.nullif(f["route"], F.lit("")), F.lit("local")), True, "continuation"))
        .when(f["interrupted"], to("frontier", False, "heuristic:retry_signal", s))
        .when(s < EASY, to("local", True, "heuristic", s))
        .when(s > HARD, to("frontier", False, "heuristic", s))
    )
    if verdict is not None:
        out = out.when(verdict, to("frontier", False, "classifier", s)).when(~verdict, to("local", True, "classifier", s))
    return out.otherwise(to("local", True, "middle_default", s))


def trajectory(turns: DataFrame, session: str, order: list[str], population: Column | None = None, leak: bool = False) -> DataFrame:
    """turns with recent_errors, recent_edit_failures and prev_interrupted of the session's turn before.

    population: which turns count as "before" (all without it); turns outside it get nulls and are kept. leak: a turn's
    own errors instead, as one of the replays has them. turns: n_error_results, n_edit_failures, interrupted.
    """
    if leak:
        return turns.withColumns({"recent_errors": F.col("n_error_results"), "recent_edit_failures": F.col("n_edit_failures"), "prev_interrupted": F.coalesce(F.lag("interrupted").over(Window.partitionBy(session).orderBy(*order)), F.lit(False))})
    keys = [session] if population is None else [session, population]
    w = Window.partitionBy(*keys).orderBy(*order)
    before = {"recent_errors": ("n_error_results", 0), "recent_edit_failures": ("n_edit_failures", 0), "prev_interrupted": ("interrupted", False)}
    lagged = {k: F.coalesce(F.lag(c).over(w), F.lit(none)) for k, (c, none) in before.items()}
    return turns.withColumns(lagged if population is None else {k: F.when(population, c) for k, c in lagged.items()})


def one_way_pin(turns: DataFrame, session: str, order: list[str], pin: Column) -> DataFrame:
    """pinned: true from the first turn on for which pin is true."""
    return turns.withColumn("pinned", F.max(F.coalesce(pin, F.lit(False))).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def replay_with_hysteresis(turns: DataFrame) -> DataFrame:
    """Routes where each depends on the one before: an escalated episode stays up until a boundary.

    turns: session_id, turn_index, rung (by the policy alone), fired (a trip-wire), boundary. Adds replayed_rung and
    escalated. Rows of a session are taken by turn_index; nulls count as false. Until the first trip-wire of an episode a
    turn's rung is its own; from then on it is as many steps up the ladder from the rung of that turn as trip-wires have
    fired before it, so windows over an episode say what a loop over the session would.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_session = Window.partitionBy("session_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    episode = Window.partitionBy("session_id", "h_episode").orderBy("turn_index")
    so_far, before = episode.rowsBetween(Window.unboundedPreceding, 0), episode.rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("h_episode", F.count_if(yes("boundary")).over(by_session))
    t = t.withColumns({"h_from": F.first(F.when(yes("fired"), F.col("rung")), ignorenulls=True).over(before), "h_fired": F.coalesce(F.count_if(yes("fired")).over(before), F.lit(0)), "escalated": F.count_if(yes("fired")).over(so_far) > 0})
    ladder = F.create_map(*[F.lit(x) for pair in LADDER.items() for x in pair])
    up = lambda c: F.coalesce(F.try_element_at(ladder, c), F.lit("frontier"))
    one = up(F.coalesce("h_from", F.lit("")))
    rung = F.when(F.col("h_fired") == 0, F.col("rung")).when(F.col("h_fired") == 1, one).when(F.col("h_fired") == 2, up(one)).otherwise("frontier")
    return t.withColumn("replayed_rung", rung).select(*turns.columns, "replayed_rung", "escalated")


def invariant_checks(routed: DataFrame) -> DataFrame:
    """Violations of what the policy promises: check, violations. routed: pinned, context_tokens, verb_class, interrupted, rung, layer."""
    gate = F.col("layer").startswith("gate:")
    return routed.agg(
        F.count_if(F.col("pinned") & (F.col("rung") != "local")).alias("a"),
        F.count_if(~F.col("pinned") & (F.col("context_tokens") > HEADROOM * REGISTRY[0].max_context) & (F.col("rung") == "local")).alias("b"),
        F.count_if(~gate & (F.col("verb_class") == "hard") & ~F.col("interrupted") & (F.col("rung") != "frontier")).alias("c"),
        F.count_if(~gate & F.col("interrupted") & (F.col("rung") != "frontier")).alias("d"),
    ).select(F.expr("stack(4, 'pinned_stays_local', a, 'oversized_never_local', b, 'hard_to_frontier', c, 'interrupt_escalates', d) AS (check, violations)"))
