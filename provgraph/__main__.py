"""Command line: ``python -m provgraph VERB PATH [ARGUMENTS]``."""

from __future__ import annotations

import argparse
import importlib.util
import sys

from .session import local_session


def doctor() -> list[tuple[str, bool]]:
    """What is installed of what the engine can use."""
    return [(name, importlib.util.find_spec(name) is not None) for name in ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "yaml", "pypdf")]


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="provgraph", description=__doc__)
    sub = parser.add_subparsers(dest="verb", required=True)
    sub.add_parser("doctor")
    for verb, arguments in {
        "build": ["out"], "query": ["question"], "neighbors": ["name"], "path": ["start", "goal"], "explain": ["name"], "timeline": ["name"], "contradictions": [], "conflicts": [],
        "communities": [], "find-decisions": ["question"], "trace-decision": ["decision"], "stats": [], "gql": ["text"], "vision": ["question"], "report": [], "export": ["what", "out"], "reason": ["question"],
    }.items():
        p = sub.add_parser(verb)
        p.add_argument("corpus")
        for a in arguments:
            p.add_argument(a)
    args = parser.parse_args(argv)
    if args.verb == "doctor":
        for name, ok in doctor():
            print(f"{name}: {'found' if ok else 'missing'}")
        return 0
    from .engine import Engine

    engine = Engine.from_path(local_session(), args.corpus)
    match args.verb:
        case "build":
            engine.export("parquet", args.out)
        case "export":
            engine.export(args.what, args.out)
        case "report":
            from .sinks.store import report

            print(report(engine.nodes, engine.edges))
        case "reason":
            from .reason import reason

            for t in reason(engine, args.question).items:
                print(f"{t.id} {t.role} {t.score:.2f} {t.text}")
        case "query":
            engine.search(args.question).show(truncate=False)
        case "explain":
            engine.why(args.name).show(truncate=False)
        case "find-decisions":
            engine.find_decisions(args.question).show(truncate=False)
        case "trace-decision":
            engine.trace(args.decision).show(truncate=False)
        case verb:
            given = {k: v for k, v in vars(args).items() if k not in ("verb", "corpus")}
            given = {"query": given["question"]} if verb == "vision" else given
            getattr(engine, verb)(**given).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
