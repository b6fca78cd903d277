"""Is each invocation's trail complete and in order?

The order of steps is an automaton: invocation, detections, policy, call, end. A trail follows it if no
step stands after a later one, each step that is due is there, and none that comes once comes
twice. Each of these can be said of the first time, last time and number of the steps, so a
trail is folded map-side into a few numbers however many events it has, and never sorted.

Results. One row for each invocation, with its faults in the order of steps. Steps at the same time count as
being in order. Events of unknown kinds or without a time take no part; an invocation that only
has such events misses its steps. Events with a null invocation are one trail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sql import array, lit


@dataclass(frozen=True)
class Step:
    """A step of the order: the kinds of events that make it, when it is due, and whether it may come more than once."""

    name: str
    kinds: tuple[str, ...]
    due: str | None = "always"  # or the name of a step whose presence makes it due, or None
    once: bool = True


STEPS = (
    Step("invocation", ("tool_invocation",)),
    Step("detection", ("pii_detected",), due=None, once=False),
    Step("policy", ("policy_applied",), due="detection", once=False),
    Step("call", ("backend_call", "query_executed"), due="success", once=False),
    Step("end", ("session_end", "error", "access_denied")),
)
#: Kinds that end a trail without a call.
REFUSALS = ("error", "access_denied")


def trail_faults(events: DataFrame, key: str = "invocation_id", ts: str = "ts", steps: tuple[Step, ...] = STEPS, refusals: tuple[str, ...] = REFUSALS) -> DataFrame:
    """``key``, ``n_events``, ``faults`` (``missing:``, ``repeated:``, ``misplaced:`` and the step), ``complete``."""
    whens = " ".join(f"WHEN event_type IN ({', '.join(map(lit, s.kinds))}) THEN {i}" for i, s in enumerate(steps))
    marked = events.selectExpr(f"`{key}`", f"`{ts}` AS __ts", f"IF(`{ts}` IS NULL, NULL, CASE {whens} END) AS __step", f"event_type IN ({', '.join(map(lit, refusals))}) AS __no")
    of = lambda i: F.col("__step") == i
    folded = marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.bool_or("__no"), F.lit(False)).alias("__refused"),
        *[F.count_if(of(i)).alias(f"__n{i}") for i in range(len(steps))],
        *[F.min(F.when(of(i), F.col("__ts"))).alias(f"__a{i}") for i in range(len(steps))],
        *[F.max(F.when(of(i), F.col("__ts"))).alias(f"__z{i}") for i in range(len(steps))],
    )
    at = {s.name: i for i, s in enumerate(steps)}
    faults = []
    for i, s in enumerate(steps):
        if s.due is not None:
            due = {"always": "true", "success": "NOT __refused"}.get(s.due) or f"__n{at[s.due]} > 0"
            faults.append(f"IF(__n{i} = 0 AND {due}, {lit('missing:' + s.name)}, NULL)")
        if s.once:
            faults.append(f"IF(__n{i} > 1, {lit('repeated:' + s.name)}, NULL)")
        later = ", ".join(f"__a{j}" for j in range(i + 1, len(steps)))
        if later:
            first = f"array_min(array({later}))"
            faults.append(f"IF(coalesce(__z{i} > {first}, false), {lit('misplaced:' + s.name)}, NULL)")
    return folded.selectExpr(f"`{key}`", "n_events", f"array_compact({array(faults, 'STRING')}) AS faults").withColumn("complete", F.size("faults") == 0)
