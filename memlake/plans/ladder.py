"""The relaxation ladder: when a question finds nothing, loosen one constraint at a time and say so."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from memlake.plans.answer import Answer, _accepted
from memlake.plans.query_plan import QueryPlan
from memlake.sources.memory import Memory

WIDEN_FACTOR, WIDEN_CAP_SECONDS, STEPS_AT_MOST = 1.5, 6 * 3600.0, 3


@dataclass(frozen=True)
class Rung:
    step: str
    loosened: str
    plan: QueryPlan
    meaning_only: bool = False


def widen(plan: QueryPlan) -> QueryPlan | None:
    """The window padded on both sides, by its length times a factor but no more than the cap."""
    if plan.start is None and plan.end is None:
        return None
    pad = WIDEN_CAP_SECONDS
    if plan.start is not None and plan.end is not None and plan.end > plan.start:
        pad = min(WIDEN_FACTOR * (plan.end - plan.start), WIDEN_CAP_SECONDS)
    return plan.but(
        start=None if plan.start is None else plan.start - pad, end=None if plan.end is None else plan.end + pad
    )


def _amount(plan: QueryPlan, wide: QueryPlan) -> str:
    pad = plan.start - wide.start if plan.start is not None else wide.end - plan.end
    return f"{pad / 3600:.3g}h" if pad >= 3600 else f"{pad / 60:.3g}min"


def rungs(mem: Memory, plan: QueryPlan, most: int = STEPS_AT_MOST) -> list[Rung]:
    """Each loosens one thing of the original plan, the gentlest first.

    A zone or name is only dropped if it is known: to drop one that matches nothing
    would answer about somebody else.  Exclusions, type and confidence always hold.
    """
    out = []
    wide = widen(plan)
    if wide is not None:
        out.append(Rung("widen_window", f"window: {_amount(plan, wide)} more at each end", wide))
    if plan.zones and mem.zone_ids(plan.zones):
        out.append(Rung("drop_zone", f"zones: any instead of {', '.join(plan.zones)}", plan.but(zones=())))
    if plan.entity_labels and not mem.subjects().where(_accepted(plan)).isEmpty():
        out.append(
            Rung("drop_entity_label", f"subjects: any instead of {', '.join(plan.entity_labels)}", plan.but(entity_labels=()))
        )
    if plan.text and (plan.zones or plan.cameras or plan.entity_labels):
        bare = plan.but(zones=(), cameras=(), entity_labels=(), predicate_contains="")
        out.append(Rung("text_only", "zones, cameras and subjects: any, ranked by meaning only", bare, True))
    return out[: max(0, most)]


def execute(mem: Memory, plan: QueryPlan, run: Callable[[QueryPlan, bool], Answer], most: int = STEPS_AT_MOST) -> Answer:
    """The answer as asked or, if that is empty, of the first rung that finds something.

    ``run(plan, meaning_only)`` answers one plan.  What was tried is told either way.
    """
    asked = run(plan, False)
    if not asked.is_dead_end():
        return asked
    tried = []
    for rung in rungs(mem, plan, most):
        got = run(rung.plan, rung.meaning_only)
        dead = got.is_dead_end()
        tried.append({"step": rung.step, "loosened": rung.loosened, "found": 0 if dead else got.entities.count()})
        if not dead:
            got.relaxation = {"attempted": tried, "answered_by": rung.step, "loosened": rung.loosened}
            return got
    asked.relaxation = {"attempted": tried, "answered_by": None, "loosened": None}
    return asked
