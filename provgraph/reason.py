"""Reasoning as a graph of thoughts over the engine's tools, within a budget of calls."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .engine import Engine

# How much reasoning a question is worth.
BUDGET, BRANCH, PRUNE_BELOW = 16, 3, 0.2


@dataclass
class Thought:
    """One step: what it says, how it was made, on what evidence."""

    id: str
    role: str
    text: str
    score: float
    evidence: list[str] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)


@dataclass
class Thoughts:
    items: list[Thought] = field(default_factory=list)
    calls: int = 0

    def add(self, role: str, text: str, score: float, evidence: list[str], parents: list[str]) -> Thought:
        """Steps that state something need evidence."""
        if role in ("finding", "answer") and not evidence:
            raise ValueError("a finding needs evidence")
        thought = Thought(f"t{len(self.items)}", role, text, score, sorted(set(evidence))[:6], parents)
        self.items.append(thought)
        return thought


def reason(engine: Engine, question: str, adaptive: bool = True, budget: int = BUDGET) -> Thoughts:
    """Search, expand the focus, connect it where there are two, keep what is supported.

    Adaptive: one focus needs no paths, and weak branches aren't refined; otherwise
    every step is taken until the budget is spent.
    """
    out = Thoughts()

    def may() -> bool:
        out.calls += out.calls < budget
        return out.calls <= budget

    root = out.add("question", question, 1.0, [], [])
    words = set(re.findall("[a-z0-9]{2,}", question.lower()))
    may()
    hits = engine.search(question, k=10).collect()
    focus = [h for h in hits if h.kind == "entity" and words & set(re.findall("[a-z0-9]{2,}", h.name.lower()))][: BRANCH]
    found: list[Thought] = []
    for h in focus or hits[:1]:
        if out.calls >= budget:
            break
        may()
        for n in engine.neighbors(h.id, BRANCH).collect():
            found.append(out.add("finding", f"{h.name} {n.predicate} {n.name}", float(n.confidence), [n.edge_id], [root.id]))
    if len(focus) > 1 or not adaptive:
        for a, b in zip(focus, focus[1:], strict=False):
            if out.calls < budget and may():
                for p in engine.path(a.id, b.id, 1).collect():
                    found.append(out.add("finding", " - ".join(p.path), float(p.likelihood), list(p.path), [root.id]))
    for t in sorted(found, key=lambda t: (-t.score, t.id))[:BRANCH]:
        if out.calls >= budget or adaptive and t.score < PRUNE_BELOW:
            continue
        may()
        support = engine.why(t.text.split(" ")[0]).count()
        t.score = min(1.0, t.score * (1.5 if support else 0.5))
    best = sorted((t for t in found if t.score >= PRUNE_BELOW), key=lambda t: (-t.score, t.id))[:BRANCH]
    if best:
        out.add("answer", "; ".join(t.text for t in best), max(t.score for t in best), [e for t in best for e in t.evidence], [t.id for t in best])
    return out
