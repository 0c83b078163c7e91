"""The catalogue's plan: which analyses stay, on which axis and chart, and what a person's decision leaves of it.

Each analysis has a state: what it could be grouped by, the axis it has, whether its metric is defined or confirmed, and whether it is approved.
A decision changes states; the plan that one sees is derived from them by one function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from ..errors import WorkflowError
from ..operators.charts import fit_chart
from .metrics import metric
from .steps import MAX_STEPS, Candidate, Step
from .summary import Summary

MAX_TITLE = 120


@dataclass(frozen=True)
class Proposal:
    """What a draft says of one analysis of the catalogue."""

    analysis: str
    axis: str | None = None
    chart: str | None = None
    title: str = ""


@dataclass(frozen=True)
class State:
    """Where an analysis stands. charts: the chart that suits each axis, and None the one while the axis is open."""

    candidate: Candidate
    title: str
    charts: dict[str | None, str]
    axis: str | None = None
    defined: bool = False
    confirmed: bool = False
    approved: bool = True
    #: whether a person has decided: only then an undefined metric is excluded
    decided: bool = False

    @property
    def step(self) -> Step:
        return Step(self.candidate.metric, (self.axis,) if self.axis else (), None, self.charts[self.axis], self.title)

    @property
    def undefined(self) -> str:
        return f"{self.candidate.metric} has no document, and its formula ({metric(self.candidate.metric).formula}) is not confirmed"

    @property
    def where(self) -> str:
        return next(place for place, here in PLACES if here(self))


#: The first that holds says where a state belongs.
PLACES: tuple[tuple[str, Callable[[State], bool]], ...] = (
    ("unavailable", lambda s: not s.candidate.available),
    ("left out", lambda s: not s.approved),
    ("open", lambda s: s.axis is None),
    ("undefined", lambda s: s.decided and not s.defined and not s.confirmed),
    ("ready", lambda s: True),
)


@dataclass
class CataloguePlan:
    #: by analysis; a step whose axis is open groups by nothing yet
    steps: dict[str, Step] = field(default_factory=dict)
    open: dict[str, tuple[str, ...]] = field(default_factory=dict)
    excluded: dict[str, str] = field(default_factory=dict)
    #: metrics that no document defines
    gaps: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    states: dict[str, State] = field(default_factory=dict)


def derive(states: Iterable[State], notes: list[str]) -> CataloguePlan:
    """The plan that states make up."""
    by = {s.candidate.id: s for s in states}
    shown = {i: s for i, s in by.items() if s.where in ("open", "ready")}
    excluded = {i: "; ".join(s.candidate.reasons) if s.where == "unavailable" else s.undefined for i, s in by.items() if s.where in ("unavailable", "undefined")}
    gaps = list(dict.fromkeys(s.candidate.metric for s in shown.values() if not s.defined))
    return CataloguePlan({i: s.step for i, s in shown.items()}, {i: s.candidate.axes for i, s in shown.items() if s.axis is None}, excluded, gaps, notes, by)


def selection(requested: list[str] | None, found: list[Candidate]) -> list[str]:
    """The known ones of the requested analyses; all that are available if none is."""
    known = {c.id for c in found}
    return [r for r in requested or [] if r in known] or [c.id for c in found if c.available]


def _charts(candidate: Candidate, asked: str | None, summary: Summary) -> dict[str | None, str]:
    """The chart for each axis; while the axis is open, the one with the most values decides."""
    sizes = {a: summary.statistics[a].get("distinct") or 0 for a in candidate.axes}
    timed = bool(candidate.axes) and set(candidate.axes) <= set(summary.times)
    return {a: fit_chart(timed, asked or candidate.chart, n) for a, n in (*sizes.items(), (None, max(sizes.values(), default=0)))}


def finalise_catalogue(found: list[Candidate], proposals: list[Proposal], summary: Summary, selected: list[str] | None = None, documented: frozenset[str] = frozenset(), choices: dict[str, str] | None = None) -> CataloguePlan:
    """The selected analyses in the catalogue's order, four at most; those that the data don't allow are excluded with the reason.

    An axis is chosen, else proposed, else the only one, else open. documented: metrics with a definition in a document.
    """
    by = {p.analysis: p for p in reversed(proposals)}  # the first one counts
    notes = [f"{p.analysis} was proposed twice; the first proposal counts." for p in proposals if by[p.analysis] is not p]
    wanted, states = set(selection(selected, found)), []
    for c in found:
        if c.id in wanted:
            p = by.get(c.id, Proposal(c.id))
            preferred = [a for a in ((choices or {}).get(c.id), p.axis, *(c.axes if len(c.axes) == 1 else ())) if a in c.axes]
            states.append(State(c, (p.title.strip() or c.id)[:MAX_TITLE], _charts(c, p.chart, summary), next(iter(preferred), None), c.metric in documented))
    ready = [s for s in states if s.candidate.available]
    notes += [f"A plan has {MAX_STEPS} charts at most; {s.candidate.id} is left out." for s in ready[MAX_STEPS:]]
    late = {s.candidate.id for s in ready[MAX_STEPS:]}
    notes += [f"{s.title}: {s.step.chart} instead of {by[s.candidate.id].chart}." for s in ready[:MAX_STEPS] if s.candidate.id in by and by[s.candidate.id].chart not in (None, "", s.step.chart)]
    return derive([replace(s, approved=s.candidate.id not in late) for s in states], notes)


def choose(plan: CataloguePlan, choices: dict[str, str], summary: Summary) -> CataloguePlan:
    """The plan with open axes chosen; a choice for a step that isn't open changes nothing, one that doesn't fit is an error."""
    wrong = [f"{plan.steps[i].title}: {choices[i]} is none of {', '.join(axes)}." for i, axes in plan.open.items() if i in choices and choices[i] not in axes]
    if wrong:
        raise WorkflowError(" ".join(wrong))
    return derive((replace(s, axis=choices[i]) if i in plan.open and i in choices else s for i, s in plan.states.items()), plan.notes)


def approve(plan: CataloguePlan, approved: list[str], summary: Summary, choices: dict[str, str] | None = None, confirmed: frozenset[str] = frozenset()) -> CataloguePlan:
    """What an approval leaves. While an approved step has no axis, the plan comes back with it open, to ask again.

    A metric that no document defines stays only if its formula is confirmed.
    """
    chosen = choose(plan, choices or {}, summary)
    if not set(approved) & set(chosen.steps):
        raise WorkflowError("No chart is approved.")
    asked = {i: axes for i, axes in chosen.open.items() if i in approved}
    if asked:
        return replace(chosen, open=asked)
    decided = derive((replace(s, decided=True, approved=s.approved and i in approved, confirmed=s.candidate.metric in confirmed) for i, s in chosen.states.items()), chosen.notes)
    if not decided.steps:
        raise WorkflowError("No document defines the metrics and no formula is confirmed.")
    return decided


def behaviour(plan: CataloguePlan) -> str:
    """answer, if some step can run; clarify, if only open ones are there; else reject."""
    return "answer" if plan.steps.keys() - plan.open.keys() else "clarify" if plan.open else "reject"
