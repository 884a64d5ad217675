"""Questions in plain words: routed to a tool, answered with citations, or declined."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .engine import Engine
from .functions.text import PATH_CUES, STRATEGIES, TRACE_CUES

ABSTAIN = "There is not enough evidence in the graph to answer that."


@dataclass
class Answer:
    tool: str
    strategy: str
    text: str
    citations: list[str] = field(default_factory=list)
    confidence: float = 1.0
    focus: str | None = None


def classify(question: str) -> str:
    """The tool for one question, by the rules of ``functions.text.route_tool``."""
    low = question.lower().strip()
    has = lambda *cues: any(c in low for c in cues)
    if low.startswith("match ") or has(" return "):
        return "gql"
    rules = (
        (has(*PATH_CUES), "path"), (low.startswith("why") or has("explain"), "why"), (has("neighbo", "related to"), "neighbors"), (has("timeline", "when did", "over time", "history of"), "timeline"),
        (has("contradict"), "contradictions"), (has("conflict"), "conflicts"), (has("decision", "rationale"), "trace" if has(*TRACE_CUES) else "decisions"),
        (has("communit", "cluster", "topic"), "communities"), (low.startswith(("stats", "count")) or has("how many"), "stats"),
    )
    return next((tool for fits, tool in rules if fits), "reason")


def two_names(question: str) -> tuple[str, str] | None:
    """Both ends of a question about a connection."""
    for pattern in (r"between (.+?) and (.+)", r"(?:is|are|was) (.+?) (?:connected|linked) to (.+)", r"path from (.+?) to (.+)", r"(.+?) connects? to (.+)"):
        m = re.search(pattern, question.strip(" ?."), re.IGNORECASE)
        if m:
            return m.group(1).strip(), m.group(2).strip()
    return None


def grounding(tool: str, evidence: int, has_focus: bool) -> tuple[float, bool]:
    """Confidence, and whether to decline."""
    if tool not in ("search", "why", "path", "neighbors", "timeline", "reason"):
        return 1.0, False
    if evidence <= 0:
        return 0.0, True
    c = min(1.0, 0.45 + 0.15 * min(evidence, 4)) * (1.0 if has_focus else 0.8)
    return round(c, 3), c < 0.25


def answer(engine: Engine, question: str, focus: str | None = None, k: int = 5) -> Answer:
    """Runs the tool; a question without a name of its own is about the last one's focus."""
    tool = classify(question)
    capital = re.findall(r"[A-Z][\w&-]*(?:\s+[A-Z][\w&-]*)*", question)
    named = next((i for i in (engine.resolve(c) for c in sorted(capital, key=len, reverse=True)) if i), None) or focus
    rows, cited = [], []
    if tool == "gql":
        rows = engine.gql(question).limit(k).collect()
    elif tool == "path" and (ends := two_names(question)):
        rows = engine.path(*ends).collect()
        cited = [x for r in rows for x in r.path]
    elif tool in ("why", "timeline", "neighbors"):
        rows = getattr(engine, tool)(named).limit(k).collect() if named else []
        cited = [r[0] if tool != "neighbors" else r.edge_id for r in rows]
    elif tool in ("contradictions", "conflicts", "communities", "stats"):
        rows = getattr(engine, tool)().limit(k).collect()
    elif tool in ("decisions", "trace"):
        rows = engine.find_decisions(question, k).collect()
        if tool == "trace" and rows:
            rows = engine.trace(rows[0].id).collect() or rows
    else:
        tool = "reason"
        rows = engine.search(question, k).collect()
        cited = [r.id for r in rows]
    confidence, decline = grounding(tool, len(set(cited)), named is not None)
    body = ABSTAIN if decline else "\n".join(", ".join(str(v) for v in r) for r in rows) or "Nothing found."
    return Answer(tool, STRATEGIES.get(tool, "hybrid-multi-tool"), body, sorted(set(cited)), confidence, named)
